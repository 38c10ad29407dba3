"""Queries over derived records, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from docweft.operators import records as R
from docweft.plans import runlog as L
from docweft.plans import search as P
from docweft.plans.text import t

REPS = ("blocks", "sections", "graph", "chunks")


def changed(s, d):
    return t(s, d, "documents").select("doc_id", F.get(F.array(*[F.lit(r) for r in REPS]), (F.col("doc_id") % 4).cast("int")).alias("representation"))


def candidates(s, d):
    return P.lists(s, d).select("query_id", "doc_id", "source", F.round(1.0 / F.col("rank"), 6).alias("score"), F.round(1.0 / (F.col("rank") + 1.0), 6).alias("confidence"))


def pairs(s, d):
    found = P.bm25(s, d).join(P.asked(s, d).withColumnRenamed("text", "query"), "query_id")
    return found.join(t(s, d, "documents").select("doc_id", "text"), "doc_id")


def chats(s, d):
    return t(s, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")


def rows(s, d):
    docs = t(s, d, "documents").select("doc_id", "lang", "source", "n_chars")
    return docs.filter("doc_id % 10 <> 3"), docs.filter("doc_id % 10 <> 4").withColumn("n_chars", F.when(F.col("doc_id") % 10 == 5, F.col("n_chars") + 1).otherwise(F.col("n_chars")))


CAND = P.BASE + """lists AS (SELECT query_id, 'bm25' AS source, rank, doc_id FROM bm UNION ALL SELECT * FROM (SELECT query_id, 'keyword', row_number() OVER (PARTITION BY query_id ORDER BY doc_id)::INTEGER AS rank, doc_id FROM kw) WHERE rank <= 10),
cand AS (SELECT query_id, doc_id, source, round(1.0::DOUBLE / rank, 6) AS score, round(1.0::DOUBLE / (rank + 1.0::DOUBLE), 6) AS confidence FROM lists)
"""
NAMES = r"SELECT doc_id, unnest(regexp_extract_all(text, '\b[A-Z][a-z]{3,}\b')) AS name FROM documents"
ENT = f"WITH w AS ({NAMES}), ent AS (SELECT 'ent-' || substr(sha256(name), 1, 16) AS entity_id, name, count(DISTINCT doc_id) AS n_docs, count(*) AS n_mentions FROM w GROUP BY name HAVING count(DISTINCT doc_id) >= 3)"
TOK = "list_filter(string_split_regex(lower({c}), '[^\\p{{L}}\\p{{N}}_]+'), lambda x: x <> '')"
VALUES = ", ".join(f"('{a}', '{b}')" for a, b in R.DEPENDS)

QUERIES = {
    "invalidated": (
        lambda s, d: R.invalidated(changed(s, d)),
        f"WITH RECURSIVE dep(a, b) AS (VALUES {VALUES}), r AS (SELECT doc_id, ['blocks', 'sections', 'graph', 'chunks'][doc_id % 4 + 1] AS representation FROM documents UNION SELECT doc_id, b FROM r JOIN dep ON dep.a = r.representation) SELECT DISTINCT * FROM r",
    ),
    "entities": (lambda s, d: R.entities(ascii_words(s, d)), ENT.replace("FROM documents", "FROM (SELECT doc_id, regexp_replace(text, '[^ -~\\n]+', ' ', 'g') AS text FROM documents)") + " SELECT * FROM ent"),
    "tag_entities": (
        lambda s, d: R.tag_entities(ascii_words(s, d), R.entities(ascii_words(s, d))),
        ENT.replace("FROM documents", "FROM (SELECT doc_id, regexp_replace(text, '[^ -~\\n]+', ' ', 'g') AS text FROM documents)") + " SELECT doc_id, count(DISTINCT name) AS n_entities, min(name) AS first_entity FROM w JOIN ent USING (name) GROUP BY 1",
    ),
    "embed_texts": (
        lambda s, d: R.embed(t(s, d, "documents")),
        "WITH h AS (SELECT DISTINCT sha256(coalesce(text, '')) AS text_hash FROM documents) SELECT text_hash, " + " || ' ' || ".join(f"printf('%.6f', round(('0x' || substr(text_hash, {4 * i + 1}, 4))::BIGINT / 32767.5::DOUBLE - 1.0::DOUBLE, 6))" for i in range(8)) + " AS vector FROM h",
    ),
    "fuse_candidates": (lambda s, d: R.fuse(candidates(s, d)), CAND + "SELECT query_id, doc_id, round(max(score) + 0.2::DOUBLE * avg(confidence) + 0.15::DOUBLE * (count(DISTINCT source) - 1), 4) AS score FROM cand GROUP BY 1, 2"),
    "calibrate_sources": (lambda s, d: R.calibrate(candidates(s, d)), CAND + "SELECT source, round(avg(confidence), 4) AS confidence, count(*) AS n FROM cand GROUP BY 1"),
    "rerank": (
        lambda s, d: R.rerank(pairs(s, d)),
        P.BASE + f"""pr AS (SELECT bm.query_id, bm.doc_id, bm.score, d.text, list_distinct({TOK.format(c='asked.text')}) AS q, {TOK.format(c='d.text')} AS w FROM bm JOIN asked USING (query_id) JOIN documents d USING (doc_id)),
sr AS (SELECT *, CASE WHEN trim(text) = '' THEN 0.0::DOUBLE ELSE round(1.0 / (1.0 + exp(2.0::DOUBLE - 4.0::DOUBLE * CASE WHEN len(q) > 0 THEN len(list_filter(q, lambda x: list_contains(w, x)))::DOUBLE / len(q) ELSE 0.0 END)), 6) END AS s FROM pr)
SELECT query_id, place, doc_id, s AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, score DESC, doc_id)::INTEGER AS place FROM sr) WHERE place <= 5""",
    ),
    "reuse_results": (
        lambda s, d: R.reuse(chats(s, d)),
        r"SELECT sha256(lower(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')))) AS key, count(*) AS requests, min(conv_id * 1000 + turn) AS first_id, count(*) - 1 AS hits FROM conversations GROUP BY 1",
    ),
    "answer_costs": (
        lambda s, d: R.answer_costs(chats(s, d).withColumnRenamed("id", "answer_id")),
        "SELECT conv_id * 1000 + turn AS answer_id, ceil(length(coalesce(text, '')) / 4.0)::BIGINT AS tokens, round(ceil(length(coalesce(text, '')) / 4.0)::DOUBLE * 0.002::DOUBLE / 1000.0::DOUBLE, 8) AS cost FROM conversations",
    ),
    "golden_diff": (
        lambda s, d: R.golden_diff(*rows(s, d)),
        "WITH a AS (SELECT * FROM documents WHERE doc_id % 10 <> 3), b AS (SELECT * FROM documents WHERE doc_id % 10 <> 4) SELECT CASE WHEN a.doc_id IS NULL THEN 'MISSING' WHEN b.doc_id IS NULL THEN 'EXTRA' WHEN a.doc_id % 10 = 5 THEN 'FAIL' ELSE 'PASS' END AS status, count(*) AS n FROM a FULL JOIN b ON a.doc_id = b.doc_id GROUP BY 1",
    ),
    "precision_at_k": (
        lambda s, d: R.precision_at(P.bm25(s, d), P.truth(s, d)),
        P.BASE + "x AS (SELECT 1) SELECT bm.query_id, round(count(truth.doc_id)::DOUBLE / 5.0::DOUBLE, 6) AS precision_k FROM bm LEFT JOIN truth ON truth.query_id = bm.query_id AND truth.doc_id = bm.doc_id WHERE rank <= 5 GROUP BY 1",
    ),
    "task_depths": (
        lambda s, d: R.depths(L.tasks(s, d)),
        L.TASKS + """, f AS (SELECT run_id, task_no, 0 AS d FROM n UNION SELECT f.run_id, e.task_no, f.d + 1 FROM f JOIN e ON e.run_id = f.run_id AND e.p = f.task_no)
SELECT run_id, max(d)::INTEGER AS max_depth, 1 AS n_roots FROM f GROUP BY 1""",
    ),
    "event_heatmap": (
        lambda s, d: R.heatmap(L.log(s, d).withColumn("hour", F.hour("ts")), "hour", "status"),
        L.LOG + ", g AS (SELECT hour(ts)::INTEGER AS \"row\", status AS \"column\", count(*) AS n FROM log GROUP BY 1, 2) SELECT *, round(n::DOUBLE / (SELECT max(n) FROM g), 4) AS heat FROM g",
    ),
    "completion_forecast": (
        lambda s, d: R.forecast(L.seg(s, d)),
        L.ATT + """, fc AS (SELECT worker, count(*) FILTER (outcome = 'open') AS open, round(avg(CASE WHEN duration_ms >= 0 THEN duration_ms END), 3) AS mean_ms, count(CASE WHEN duration_ms >= 0 THEN 1 END) AS ended FROM seg GROUP BY 1)
SELECT worker, open, mean_ms, round(open * coalesce(mean_ms, 0.0), 3) AS remaining_ms, CASE WHEN ended >= 100 THEN 'high' WHEN ended >= 20 THEN 'medium' ELSE 'low' END AS confidence FROM fc""",
    ),
    "consistency_report": (
        lambda s, d: R.consistency(L.log(s, d), "2024-01-25 00:00:00", 12),
        L.LOG + """, g AS (SELECT run_id, arg_max(status, (ts, event_id)) AS last, max(ts) AS newest, count(*) FILTER (status = 'queued') AS queued FROM log WHERE ts <= TIMESTAMP '2024-01-25 00:00:00' GROUP BY 1)
SELECT run_id, 'stalled' AS issue FROM g WHERE last IN ('running', 'heartbeat') AND epoch_us(TIMESTAMP '2024-01-25 00:00:00') - epoch_us(newest) >= 12 * 3600000000 UNION ALL SELECT run_id, 'never_queued' FROM g WHERE queued = 0""",
    ),
    "trace_metrics": (
        lambda s, d: R.traces(L.log(s, d)),
        L.LOG + ", g AS (SELECT status, count(*) AS events, round(avg(value), 4) AS mean_value, round(quantile_cont(value, 0.9), 4) AS p90_value FROM log GROUP BY 1) SELECT *, round(events::DOUBLE / (sum(events) OVER ()), 4) AS share FROM g",
    ),
}


def ascii_words(s, d):
    """Texts with runs of other than ASCII characters made spaces: word borders are then the same everywhere."""
    return t(s, d, "documents").select("doc_id", F.regexp_replace("text", r"[^ -~\n]+", " ").alias("text"))
