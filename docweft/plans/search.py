"""Search queries, each with its SQL. Queries are the benchmark items; true documents contain them."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from docweft import functions as T
from docweft.operators import index as I
from docweft.operators import search as S
from docweft.plans.text import t
from docweft.shared import cut, folder


def asked(s, d):
    return t(s, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def truth(s, d):
    """Documents that contain the query."""
    return S.containing(t(s, d, "documents"), asked(s, d))


def bm25(s, d, k=10):
    return S.bm25(t(s, d, "documents"), asked(s, d), k)


def asked_vectors(s, d):
    return t(s, d, "embeddings").filter("vec_id % 100 = 0").select("vec_id", "embedding")


def quick(s, d):
    return S.keyword_search(t(s, d, "documents"), asked(s, d)).withColumn("score", F.lit(1.0))


def lists(s, d):
    ranked = S.top(quick(s, d), "query_id", 10, F.col("doc_id")).select("query_id", F.lit("keyword").alias("source"), "rank", "doc_id")
    return bm25(s, d).select("query_id", F.lit("bm25").alias("source"), "rank", "doc_id").unionByName(ranked)


def metrics(s, d):
    """What is true is a table first, as it is counted and met."""
    return S.ir_metrics(asked(s, d), bm25(s, d), cut(truth(s, d)))


def changed_index(s, d):
    """The index of all documents after two batches: documents in Spanish go, and those of each source but the first in order of names get the second half of their text."""
    root = f"{folder(s).rstrip('/')}/index-{uuid.uuid4().hex}"
    docs = t(s, d, "documents").select("doc_id", "text", "lang", "source")
    I.build(docs, root)
    I.update(docs.filter("lang = 'es'").select("doc_id", "text", F.lit("delete").alias("op")), root, 1)
    first = docs.agg(F.min("source").alias("first"))
    half = F.substring("text", F.floor(F.length("text") / 2).cast("int") + 1, F.length("text"))
    I.update(docs.join(F.broadcast(first), F.col("source") > F.col("first")).select("doc_id", half.alias("text"), F.lit("upsert").alias("op")), root, 2)
    return root


def compacted(s, d):
    root = changed_index(s, d)
    I.compact(s, root, f"{root}-compact")
    return I.search(s, f"{root}-compact", asked(s, d), 10)


TOKENS = "list_filter(string_split_regex(lower({c}), '[^\\p{{L}}\\p{{N}}_]+'), lambda x: x <> '')"
BASE = f"""WITH asked AS (SELECT item_id AS query_id, text FROM benchmark),
docs AS (SELECT doc_id, {TOKENS.format(c='text')} AS w FROM documents),
terms AS (SELECT query_id, unnest(list_distinct({TOKENS.format(c='text')})) AS term FROM asked),
post AS (SELECT doc_id, len(w) AS length, unnest(w) AS term FROM docs),
tf AS (SELECT doc_id, term, length, count(*) AS tf FROM post GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
st AS (SELECT count(*) AS n, avg(len(w)) AS av FROM docs),
sc AS (SELECT query_id, doc_id, round(sum(ln(1.0 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5::DOUBLE / (tf + 1.5 * (0.25 + 0.75 * length::DOUBLE / av))), 6) AS score
  FROM tf JOIN df USING (term) JOIN terms USING (term), st GROUP BY query_id, doc_id),
bm AS (SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM sc) WHERE rank <= 10),
kw AS (SELECT query_id, doc_id FROM (SELECT DISTINCT doc_id, term FROM post) JOIN terms USING (term) JOIN (SELECT query_id, count(*) AS n FROM terms GROUP BY 1) USING (query_id) GROUP BY query_id, doc_id, n HAVING count(*) = n),
truth AS (SELECT query_id, doc_id FROM asked JOIN documents d ON contains(d.text, asked.text)),
"""
#: The documents as the two batches of changed_index leave them; a text without a word leaves its document as it was.
CHANGED = BASE.replace(
    f"docs AS (SELECT doc_id, {TOKENS.format(c='text')} AS w FROM documents)",
    f"""docs AS (SELECT * FROM (SELECT doc_id, CASE WHEN source > (SELECT min(source) FROM documents) AND len({TOKENS.format(c="substr(text, length(text) // 2 + 1)")}) > 0 THEN {TOKENS.format(c="substr(text, length(text) // 2 + 1)")}
  WHEN lang = 'es' THEN [] ELSE {TOKENS.format(c="text")} END AS w FROM documents) WHERE len(w) > 0)""",
)
RRF = BASE + """lists AS (SELECT query_id, 'bm25' AS source, rank, doc_id FROM bm UNION ALL SELECT * FROM (SELECT query_id, 'keyword', row_number() OVER (PARTITION BY query_id ORDER BY doc_id)::INTEGER AS rank, doc_id FROM kw) WHERE rank <= 10)
SELECT query_id, doc_id, round(sum(0.5 / (60 + rank)), 8) AS score, count(DISTINCT source) AS n_sources FROM lists GROUP BY query_id, doc_id"""
METRICS = BASE + """nt AS (SELECT query_id, count(*) AS n_true FROM truth GROUP BY 1),
m AS (SELECT bm.*, (truth.doc_id IS NOT NULL)::INTEGER AS hit FROM bm LEFT JOIN truth USING (query_id, doc_id)),
g AS (SELECT query_id, sum(CASE WHEN rank <= 1 THEN hit ELSE 0 END) AS h1, sum(CASE WHEN rank <= 3 THEN hit ELSE 0 END) AS h3, sum(CASE WHEN rank <= 5 THEN hit ELSE 0 END) AS h5, sum(CASE WHEN rank <= 10 THEN hit ELSE 0 END) AS h10,
  sum((rank <= 1)::INTEGER) AS n1, sum((rank <= 5)::INTEGER) AS n5, min(CASE WHEN hit = 1 THEN rank END) AS first, sum(CASE WHEN rank <= 5 AND hit = 1 THEN 1.0::DOUBLE / log2(rank + 1.0::DOUBLE) ELSE 0.0 END) AS dcg FROM m GROUP BY 1),
e AS (SELECT query_id, coalesce(n_true, 0) AS n_true, coalesce(h1, 0) AS h1, coalesce(h3, 0) AS h3, coalesce(h5, 0) AS h5, coalesce(h10, 0) AS h10, coalesce(n1, 0) AS n1, coalesce(n5, 0) AS n5, first, coalesce(dcg, 0.0) AS dcg FROM asked LEFT JOIN nt USING (query_id) LEFT JOIN g USING (query_id)),
metrics AS (SELECT query_id, """ + ", ".join(f"round(CASE WHEN n_true > 0 THEN h{k}::DOUBLE / n_true ELSE 0.0 END, 6)::DOUBLE AS recall_{k}" for k in (1, 3, 5, 10)) + ", " + ", ".join(f"round(CASE WHEN n{k} > 0 THEN h{k}::DOUBLE / n{k} ELSE 0.0 END, 6)::DOUBLE AS precision_{k}" for k in (1, 5)) + """,
  round(CASE WHEN n_true > 0 AND first IS NOT NULL THEN 1.0::DOUBLE / first ELSE 0.0 END, 6)::DOUBLE AS mrr,
  round(CASE WHEN n_true > 0 THEN dcg / list_sum(list_transform(range(1, least(n_true, 5) + 1), lambda i: 1.0::DOUBLE / log2(i + 1.0::DOUBLE))) ELSE 0.0 END, 6)::DOUBLE AS ndcg_5 FROM e)
"""

QUERIES = {
    "bm25_index_stats": (lambda s, d: S.index_stats(t(s, d, "documents")), BASE + "x AS (SELECT 1) SELECT count(*) AS n_docs, sum(len(w))::BIGINT AS n_tokens, round(avg(len(w)), 6) AS avg_length FROM docs"),
    "bm25_search": (bm25, BASE + "x AS (SELECT 1) SELECT * FROM bm"),
    "bm25_after_updates": (lambda s, d: I.search(s, changed_index(s, d), asked(s, d), 10), CHANGED + "x AS (SELECT 1) SELECT * FROM bm"),
    "bm25_after_compaction": (compacted, CHANGED + "x AS (SELECT 1) SELECT * FROM bm"),
    "index_counts": (
        lambda s, d: I.index_counts(s, changed_index(s, d)),
        CHANGED + "x AS (SELECT 1) SELECT count(*) AS n_docs, sum(len(w))::BIGINT AS n_tokens, (SELECT count(DISTINCT term) FROM post) AS n_terms, 3 AS n_batches FROM docs",
    ),
    "keyword_search": (lambda s, d: S.keyword_search(t(s, d, "documents"), asked(s, d)), BASE + "x AS (SELECT 1) SELECT * FROM kw"),
    "dense_search": (
        lambda s, d: S.dense(t(s, d, "embeddings"), asked_vectors(s, d)),
        """WITH u AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE / n) AS v FROM (SELECT vec_id, embedding, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM embeddings) WHERE n > 0),
p AS (SELECT q.vec_id AS query_id, u.vec_id, round(list_sum(list_transform(list_zip(q.v, u.v), lambda p: p[1] * p[2])), 4) AS score FROM u q JOIN u ON q.vec_id % 100 = 0 AND q.vec_id <> u.vec_id)
SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM p WHERE score >= 0.3) WHERE rank <= 15""",
    ),
    "minmax_scores": (
        lambda s, d: S.minmax(bm25(s, d), "score", "query_id").select("query_id", "doc_id", F.round("score_norm", 5).alias("score_norm")),
        BASE + "x AS (SELECT *, min(score) OVER w AS lo, max(score) OVER w AS hi FROM bm WINDOW w AS (PARTITION BY query_id)) SELECT query_id, doc_id, round(CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 0.0 END, 5) AS score_norm FROM x",
    ),
    "rrf_fusion": (lambda s, d: S.rrf(lists(s, d), {"bm25": 0.5, "keyword": 0.5}), RRF),
    "hybrid_pool": (
        lambda s, d: S.hybrid_pool(bm25(s, d), quick(s, d)),
        BASE + "x AS (SELECT 1) SELECT query_id, doc_id, concat_ws('+', CASE WHEN b.score IS NOT NULL THEN 'left' END, CASE WHEN k.doc IS NOT NULL THEN 'right' END) AS sources, coalesce(b.score, 0.0) AS left_score, CASE WHEN k.doc IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS right_score FROM bm b FULL JOIN (SELECT query_id, doc_id, doc_id AS doc FROM kw) k USING (query_id, doc_id)",
    ),
    "ir_metrics": (metrics, METRICS + "SELECT * FROM metrics"),
    "worst_queries": (lambda s, d: S.worst_queries(metrics(s, d)), METRICS + "SELECT query_id, mrr FROM metrics ORDER BY mrr, query_id LIMIT 20"),
    "quality_gates": (
        lambda s, d: S.gates(metrics(s, d), {"recall_5": 0.8, "mrr": 0.7}),
        METRICS + "SELECT 'recall_5' AS gate, round(avg(recall_5), 6) AS value, round(avg(recall_5), 6) >= 0.8 AS passed FROM metrics UNION ALL SELECT 'mrr', round(avg(mrr), 6), round(avg(mrr), 6) >= 0.7 FROM metrics",
    ),
}
