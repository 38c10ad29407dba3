"""Queries that go through model hooks, SQL table functions and the builder registry, each with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from docweft import builders, models
from docweft.plans import search as P
from docweft.plans.records import pairs
from docweft.plans.text import BLOCKS, t


def vectors(s, d):
    found = models.embed(t(s, d, "documents").select("doc_id", "text"))
    return found.select("doc_id", "text_hash", F.size("vector").alias("dims"), F.transform("vector", lambda x: F.round(x.cast("double"), 5)).alias("vector"))


def chunk_words(s, d):
    models.register_chunkers(s)
    t(s, d, "documents").createOrReplaceTempView("docweft_documents")
    return s.sql("SELECT d.doc_id, c.chunk_no, c.n_words, c.text FROM docweft_documents d, LATERAL chunk_words(d.text, 300, 50) c")


def rebuilt(s, d):
    """Rows of what must be built anew after the layout graph's nodes have changed; blocks come from what is stored."""
    registry = builders.documents()
    docs = t(s, d, "documents")
    stored = registry.run(["blocks"], {"documents": docs})
    made = registry.rebuild(["graph"], {"documents": docs, **stored})
    out = None
    for name, df in made.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("representation"), "n")
        out = one if out is None else out.unionByName(one)
    return out


QUERIES = {
    "embed_vectors": (vectors, None),
    "rerank_scored": (
        lambda s, d: models.rerank(pairs(s, d)),
        P.BASE + f"""pr AS (SELECT bm.query_id, bm.doc_id, d.text, list_distinct({P.TOKENS.format(c='asked.text')}) AS q, {P.TOKENS.format(c='d.text')} AS w FROM bm JOIN asked USING (query_id) JOIN documents d USING (doc_id)),
sr AS (SELECT query_id, doc_id, CASE WHEN trim(coalesce(text, '')) = '' THEN 0.0::DOUBLE ELSE round(1.0 / (1.0 + exp(-(4.0::DOUBLE * CASE WHEN len(q) > 0 THEN len(list_filter(q, lambda x: list_contains(w, x)))::DOUBLE / len(q) ELSE 0.0 END - 2.0))), 6) END AS rerank_score FROM pr)
SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, doc_id)::INTEGER AS place, doc_id, rerank_score FROM sr) WHERE place <= 5""",
    ),
    "chunk_words": (
        chunk_words,
        r"""WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '[\s\x0B\x{1C}-\x{1F}\x{85}\p{Z}]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 51, 0) + 1, 250)) AS start FROM w WHERE len(w) > 0)
SELECT doc_id, (start // 250)::INTEGER AS chunk_no, len(w[start + 1 : start + 300])::INTEGER AS n_words, array_to_string(w[start + 1 : start + 300], ' ') AS text FROM s""",
    ),
    "rebuild_counts": (
        rebuilt,
        f"WITH b AS ({BLOCKS}), n AS (SELECT count(*) AS n, count(DISTINCT doc_id) AS docs FROM b) SELECT 'graph' AS representation, n FROM n UNION ALL SELECT 'edges', 2 * n - docs FROM n UNION ALL SELECT 'layout', docs FROM n",
    ),
}
