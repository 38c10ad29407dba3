"""Queries over query kinds, evidence, answers and evaluation, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from docweft import functions as T
from docweft.operators import answers as A
from docweft.operators import evidence as V
from docweft.operators import graph as G
from docweft.operators import search as S
from docweft.plans import documents as D
from docweft.plans import search as P
from docweft.plans.text import t
from docweft.shared import cut


def chats(s, d):
    return t(s, d, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("query_id"), "text")


def ranked(s, d):
    """The found documents with text and group. What was found is a table first: it is ranked once, and where it is small, texts aren't shuffled to meet it."""
    return cut(P.bm25(s, d)).join(t(s, d, "documents").select("doc_id", "text", F.col("source").alias("group")), "doc_id")


def cited(s, d):
    """Extracted answers as texts, each sentence with the rank of its document in brackets."""
    best = A.extract(P.asked(s, d), D.ranked(s, d)).join(P.bm25(s, d).select("query_id", "doc_id", "rank", F.col("score").alias("bm25")), ["query_id", "doc_id"])
    parts = F.sort_array(F.collect_list(F.struct("place", F.concat("sentence", F.lit(" ["), "rank", F.lit("].")).alias("s"))))
    return best.groupBy("query_id").agg(F.array_join(F.transform(parts, lambda x: x["s"]), " ").alias("text"))


def normed(s, d):
    return S.minmax(P.bm25(s, d), "score", "query_id").select("query_id", "rank", "doc_id", F.col("score_norm").alias("score"))


def expanded_groups(s, d):
    found = ranked(s, d)
    return V.group_expansion(found.filter("rank <= 5").select("query_id", "rank", "doc_id", "group"), found.select("query_id", "doc_id", "group"))


def configs(s, d):
    """Metrics of each configuration: each list by itself, and both fused."""
    lists, truth = cut(P.lists(s, d)), cut(P.truth(s, d))
    fused = S.top(S.rrf(lists, {"bm25": 0.5, "keyword": 0.5}), "query_id", 10, F.desc("score"), F.col("doc_id")).select("query_id", "rank", "doc_id")
    out = None
    for name, results in (("bm25", lists.filter("source = 'bm25'")), ("keyword", lists.filter("source = 'keyword'")), ("hybrid", fused)):
        one = S.ir_metrics(P.asked(s, d), results.select("query_id", "rank", "doc_id"), truth).withColumn("config", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def any_of(col: str, phrases) -> str:
    return "(" + " OR ".join(f"contains({col}, '{p}')" for p in phrases) + ")"


X = f"(SELECT conv_id || '-' || turn AS query_id, lower(text) AS x, trim(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g')) AS bare FROM conversations)"
GREET = f"(bare IN ({', '.join(repr(g) for g in V.GREETINGS)}) OR (({' OR '.join(f'starts_with(bare, {p!r})' for p in V.GREETING_STARTS)}) AND NOT (starts_with(bare, 'hi ') AND len(regexp_extract_all(bare, '{T.NOT_SPACE}')) > 3)))"
NAME = "CASE " + " ".join(f"WHEN {any_of('x', ps)} THEN '{k}'" for k, ps, _, _ in V.INTENTS) + " ELSE 'hybrid' END"
SURE = "CASE " + " ".join(f"WHEN {any_of('x', ps)} THEN " + (f"CASE WHEN regexp_matches(x, '[0-9]') THEN 0.98 ELSE {c} END" if k == "table_lookup" else str(c)) for k, ps, c, _ in V.INTENTS) + " ELSE 0.75 END"
PLAN = "CASE " + " ".join(f"WHEN {any_of('x', ps)} THEN '{p}'" for _, ps, _, p in V.INTENTS) + " ELSE 'semantic,bm25,graph' END"
FAMS = "[" + ", ".join(f"CASE WHEN regexp_matches(x, '{p}') THEN '{k}' END" for k, p in V.FAMILIES.items()) + "]"
KIND = "CASE " + " ".join(f"WHEN {any_of('x', ps)} THEN '{k}'" for k, ps in V.TYPES) + " ELSE 'ENTITY_LOOKUP' END"
GENERAL = any_of("x", ("what is it about", "what is this", "summarize", "summary", "what does it talk about", "tell me about this", "what is the document about", "what is the file about"))
NORMED = P.BASE + """nm AS (SELECT query_id, rank, doc_id, CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 0.0 END AS score FROM bm WINDOW w AS (PARTITION BY query_id)),
"""
CITED = "WITH " + D.SCORED.replace("WITH ", "", 1) + """, best AS (SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank, doc_id, pos)::INTEGER AS place, doc_id, rank, sentence FROM one) WHERE place <= 4),
cited AS (SELECT query_id, string_agg(sentence || ' [' || rank || '].', ' ' ORDER BY place) AS text FROM best GROUP BY query_id)"""

QUERIES = {
    "query_intents": (lambda s, d: V.intents(chats(s, d)), f"SELECT query_id, CASE WHEN {GREET} THEN 'conversational' ELSE {NAME} END AS intent, (CASE WHEN {GREET} THEN 0.99 ELSE {SURE} END)::DOUBLE AS confidence, CASE WHEN {GREET} THEN '' ELSE {PLAN} END AS plan FROM {X}"),
    "intent_families": (
        lambda s, d: V.families(chats(s, d)),
        f"""SELECT query_id, array_to_string(f, ',') AS families, concat_ws(',', CASE WHEN len(list_filter(f, lambda k: k NOT IN ('factual', 'table'))) > 0 THEN 'chunks' END, 'paragraphs', CASE WHEN list_contains(f, 'table') THEN 'tables' END) AS collections
FROM (SELECT query_id, CASE WHEN len(g) = 0 THEN ['factual'] ELSE g END AS f FROM (SELECT query_id, list_filter({FAMS}, lambda k: k IS NOT NULL) AS g FROM {X}))""",
    ),
    "query_types": (lambda s, d: V.query_types(chats(s, d)), f"SELECT query_id, {KIND} AS type, {GENERAL} AS general FROM {X}"),
    "expand_evidence": (
        lambda s, d: V.expand_evidence(P.bm25(s, d).select("query_id", "doc_id").join(D.nodes(s, d).filter("type = 'heading' or pos = 0").select("doc_id", "node_id"), "doc_id").select("query_id", "doc_id", "node_id"), D.edges(s, d)),
        P.BASE.replace("WITH asked", D.E.replace("WITH RECURSIVE", "WITH RECURSIVE", 1) + ", asked", 1) + """ev AS (SELECT query_id, doc_id, node_id FROM bm JOIN n USING (doc_id) WHERE type = 'heading' OR pos = 0)
SELECT * FROM ev UNION SELECT query_id, doc_id, target FROM ev JOIN e USING (doc_id) WHERE source = node_id AND e.type IN ('next', 'contains') UNION SELECT query_id, doc_id, source FROM ev JOIN e USING (doc_id) WHERE target = node_id AND e.type IN ('next', 'contains')""",
    ),
    "group_expansion": (
        expanded_groups,
        P.BASE + """r AS (SELECT bm.*, source AS grp FROM bm JOIN documents USING (doc_id))
SELECT query_id, doc_id, false AS added FROM r WHERE rank <= 5 UNION ALL SELECT DISTINCT query_id, doc_id, true FROM r WHERE rank > 5 AND (query_id, grp) IN (SELECT (query_id, grp) FROM r WHERE rank <= 3 AND grp IS NOT NULL)""",
    ),
    "importance_boost": (
        lambda s, d: V.importance_boost(P.bm25(s, d).join(t(s, d, "documents").select("doc_id", F.col("n_chars").cast("double").alias("importance")), "doc_id")),
        P.BASE + """i AS (SELECT query_id, doc_id, score, n_chars::DOUBLE AS i FROM bm JOIN documents USING (doc_id))
SELECT query_id, doc_id, round(score + 0.15::DOUBLE * CASE WHEN max(i) OVER w > min(i) OVER w THEN (i - min(i) OVER w) / (max(i) OVER w - min(i) OVER w) ELSE 0.0 END, 6)::DOUBLE AS final_score FROM i WINDOW w AS (PARTITION BY query_id)""",
    ),
    "validate_context": (
        lambda s, d: V.validate_context(ranked(s, d).select("query_id", "rank", "doc_id", "text")),
        P.BASE + r"""v AS (SELECT query_id, rank, doc_id, list_distinct(regexp_extract_all(lower(text), '\b[a-zA-Z]{4,}\b')) AS w, list_distinct(regexp_extract_all(text, '\b[0-9]{3,}\b')) AS n FROM bm JOIN documents USING (doc_id)
  QUALIFY row_number() OVER (PARTITION BY query_id, trim(regexp_replace(lower(trim(text)), '\s+', ' ', 'g')) ORDER BY rank) = 1)
SELECT a.query_id, a.rank, a.doc_id, count(b.rank) AS n_conflicts FROM v a LEFT JOIN v b ON a.query_id = b.query_id AND b.rank < a.rank AND len(a.n) > 0 AND len(b.n) > 0 AND list_has_any(a.w, b.w) AND NOT list_has_any(a.n, b.n) GROUP BY ALL""",
    ),
    "postprocess_answers": (lambda s, d: t(s, d, "conversations").filter("role = 'assistant'").select(F.concat_ws("-", "conv_id", "turn").alias("answer_id"), V.postprocess("text").alias("text")), None),
    "citations": (
        lambda s, d: V.citations(cited(s, d).withColumnRenamed("query_id", "answer_id"), P.bm25(s, d).select(F.col("query_id").alias("answer_id"), "rank", "doc_id")),
        CITED + r""" SELECT query_id AS answer_id, rank, doc_id FROM (SELECT DISTINCT query_id, unnest(regexp_extract_all(text, '\[(\d{1,6})\]', 1))::INTEGER AS rank FROM cited) JOIN bm USING (query_id, rank)""",
    ),
    "answer_report": (
        lambda s, d: V.answer_report(cited(s, d), normed(s, d).join(t(s, d, "documents").select("doc_id", "text"), "doc_id")),
        CITED + f""", nm AS (SELECT query_id, rank, doc_id, CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 0.0 END AS score FROM bm WINDOW w AS (PARTITION BY query_id)),
g AS (SELECT query_id, lower(string_agg(text, chr(10) ORDER BY rank)) AS context, count(DISTINCT doc_id) AS n_sources, max(score) AS best FROM (SELECT nm.*, text FROM nm JOIN documents USING (doc_id) WHERE score >= 0.3 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank) <= 3) GROUP BY query_id),
w AS (SELECT query_id, list_filter({P.TOKENS.format(c="text")}, lambda x: length(x) > 3) AS w FROM cited),
f AS (SELECT query_id, coalesce(n_sources, 0) AS n_sources, round(CASE WHEN context IS NULL THEN 0.0 WHEN len(w) > 0 THEN len(list_filter(w, lambda x: contains(context, x)))::DOUBLE / len(w) ELSE 1.0 END, 4)::DOUBLE AS grounding, coalesce(best, 0.0) AS best FROM w LEFT JOIN g USING (query_id))
SELECT query_id, n_sources, grounding, CASE WHEN grounding >= 0.85 AND best >= 0.65 THEN 'high' WHEN (grounding >= 0.85 AND best >= 0.5) OR (grounding >= 0.5 AND grounding < 0.85 AND best >= 0.7) THEN 'medium' ELSE 'low' END AS label FROM f""",
    ),
    "answer_confidence": (
        lambda s, d: V.answer_confidence(
            cited(s, d).select(F.col("query_id").alias("answer_id"), "text", F.lit(0.5).alias("retrieval")),
            normed(s, d).join(t(s, d, "documents").select("doc_id", "source"), "doc_id").select(F.col("query_id").alias("answer_id"), "score", "source"),
            cited(s, d).select(F.col("query_id").alias("answer_id"), F.lit(1.0).alias("score")),
        ),
        CITED + r""", nm AS (SELECT query_id, doc_id, CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 0.0 END AS score FROM bm WINDOW w AS (PARTITION BY query_id)),
o AS (SELECT query_id, avg(score) AS mean, count(DISTINCT source) AS n FROM nm JOIN documents USING (doc_id) GROUP BY 1),
k AS (SELECT query_id, list_filter(list_filter(list_transform(string_split(regexp_replace(trim(text), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> ''), lambda x: length(x) > 15) AS l FROM cited),
c AS (SELECT query_id, CASE WHEN len(l) > 0 THEN len(list_filter(l, lambda x: regexp_matches(x, '\[\d+\]')))::DOUBLE / len(l) ELSE 0.0 END AS coverage FROM k)
SELECT query_id AS answer_id, round(coverage, 4)::DOUBLE AS coverage, round(least(greatest(0.5::DOUBLE * 0.25 + least(greatest(coalesce(mean, 0.5), 0.0), 1.0) * 0.25 + coverage * 0.2::DOUBLE + 0.2::DOUBLE + least(coalesce(n, 0)::DOUBLE / 3.0, 1.0) * 0.1::DOUBLE, 0.0), 1.0), 4)::DOUBLE AS confidence FROM c LEFT JOIN o USING (query_id)""",
    ),
    "ablation": (
        lambda s, d: V.ablation(configs(s, d)),
        None,
    ),
    "rollout": (
        lambda s, d: V.rollout(G.parity(D.nodes(s, d)).filter("structural is not null and textual is not null")),
        D.B + """, u AS (SELECT doc_id // 2 AS pair, text, max((doc_id % 2 = 0)::INTEGER) AS a, max((doc_id % 2 = 1)::INTEGER) AS b FROM n GROUP BY 1, 2), v AS (SELECT pair, sum(a) AS l, sum(b) AS r, sum(a * b) AS c FROM u GROUP BY 1),
p AS (SELECT round(least(l, r)::DOUBLE / greatest(l, r), 4) AS st, round(c::DOUBLE / (l + r - c), 4) AS tx FROM v), a AS (SELECT count(*) AS n, count(*) FILTER (st >= 0.9 AND tx >= 0.9) AS n_passed, coalesce(bool_and(st >= 0.9), false) AS structural_ok, coalesce(bool_and(tx >= 0.9), false) AS textual_ok FROM p)
SELECT *, (CASE WHEN structural_ok THEN 30 ELSE 0 END + CASE WHEN textual_ok THEN 30 ELSE 0 END + CASE WHEN n = n_passed THEN 40 ELSE 0 END)::INTEGER AS confidence, CASE WHEN structural_ok AND textual_ok AND n = n_passed THEN 'READY' ELSE 'NOT READY' END AS decision FROM a""",
    ),
    "class_recall": (
        lambda s, d: V.class_recall(P.bm25(s, d), P.truth(s, d), V.query_types(P.asked(s, d)).select("query_id", "type")),
        P.BASE + f"""h AS (SELECT truth.query_id, count(bm.doc_id)::DOUBLE / count(*) AS r FROM truth LEFT JOIN bm ON bm.query_id = truth.query_id AND bm.doc_id = truth.doc_id GROUP BY 1), k AS (SELECT query_id, {KIND} AS type FROM (SELECT query_id, lower(text) AS x FROM asked))
SELECT type, count(*) AS n_queries, round(avg(coalesce(r, 0.0)), 6)::DOUBLE AS recall FROM k LEFT JOIN h USING (query_id) GROUP BY type""",
    ),
}
