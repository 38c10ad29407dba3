"""Queries over canonical documents, records and prompts, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from docweft import functions as T
from docweft.operators import artifacts as R
from docweft.operators import evidence as V
from docweft.operators import text as X
from docweft.plans import evidence as EV
from docweft.plans import search as P
from docweft.plans.text import BLOCKS, CHUNKS, quality_sql, t


def raw(s, d):
    lines = F.transform(F.split(T.text_of("text"), "\n"), lambda x, i: F.struct(F.concat(F.lit("b"), i.cast("string")).alias("id"), x.alias("text"), F.when(i % 2 == 0, F.lit(2)).alias("page"), F.when(i % 3 == 0, F.array(F.lit(0.1), F.lit(0.2), F.lit(0.3), F.lit(0.4))).alias("bbox")))
    return t(s, d, "documents").select(F.to_json(F.struct(F.concat(F.lit("doc_"), "doc_id").alias("document_path"), lines.alias("blocks"))).alias("json"))


def cells(s, d):
    at = F.struct(F.col("l_linenumber").cast("int").alias("row"), (F.col("l_suppkey") % 7).cast("int").alias("column"))
    return t(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("table_id")).agg(F.count("*").cast("int").alias("rows"), F.lit(3).alias("columns"), F.collect_list(at).alias("cells"))


def parts(s, d):
    docs = t(s, d, "documents")
    chunks = X.chunks(docs).select(F.lit("chunk").alias("kind"), F.col("chunk_id").alias("ref"), "text")
    heads = X.blocks(docs).filter("is_heading").select(F.lit("heading"), F.concat_ws("-", "doc_id", "pos"), "text")
    return chunks.union(heads)


def grouped(s, d):
    return P.bm25(s, d).join(t(s, d, "documents").select("doc_id", F.col("source").alias("group"), "text"), "doc_id").select("query_id", "rank", "group", "text")


VECTOR = " || ' ' || ".join(f"printf('%.6f', round(('0x' || substr(text_hash, {4 * i + 1}, 4))::BIGINT / 32767.5::DOUBLE - 1.0::DOUBLE, 6))" for i in range(8))
CONTEXT = r"""gr AS (SELECT query_id, coalesce(source, 'unknown') AS grp, min(rank) AS best, string_agg('[' || rank || '] ' || substr(regexp_replace(text, '\s+', ' ', 'g'), 1, 120), chr(10) ORDER BY rank) AS lines FROM bm JOIN documents USING (doc_id) GROUP BY 1, 2),
ctx AS (SELECT query_id, string_agg('## ' || grp || chr(10) || lines, chr(10) || chr(10) ORDER BY best) AS context FROM gr GROUP BY 1)"""
PLAN = "CASE intent " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in R.PLANS.items()) + " ELSE 'Answer from the context only.' END"
INTENT = f"""it AS (SELECT query_id, text, CASE WHEN {EV.GREET} THEN 'conversational' ELSE {EV.NAME} END AS intent FROM (SELECT query_id, text, lower(text) AS x, trim(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g')) AS bare FROM asked))"""

QUERIES = {
    "normalize_documents": (
        lambda s, d: R.normalize_documents(raw(s, d)),
        """SELECT sha256('doc_' || doc_id) AS document_id, 'b' || i AS block_id, 'paragraph' AS type, text, CASE WHEN i % 2 = 0 THEN 2 ELSE 1 END::INTEGER AS page, 1.0::DOUBLE AS confidence, (CASE WHEN i % 3 = 0 THEN 0.1 ELSE 0.0 END)::DOUBLE AS x1, (CASE WHEN i % 3 = 0 THEN 0.2 ELSE 0.0 END)::DOUBLE AS y1, (CASE WHEN i % 3 = 0 THEN 0.3 ELSE 1.0 END)::DOUBLE AS x2, (CASE WHEN i % 3 = 0 THEN 0.4 ELSE 1.0 END)::DOUBLE AS y2
FROM (SELECT doc_id, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS i, unnest(string_split(coalesce(text, ''), chr(10))) AS text FROM documents)""",
    ),
    "table_records": (
        lambda s, d: R.table_records(cells(s, d)),
        "SELECT l_orderkey AS table_id, greatest(count(*), max(l_linenumber) + 1)::INTEGER AS rows, greatest(3, max(l_suppkey % 7) + 1)::INTEGER AS columns, count(*)::INTEGER AS n_cells FROM lineitem GROUP BY 1",
    ),
    "document_records": (
        lambda s, d: R.document_records(t(s, d, "documents"), X.quality(t(s, d, "documents")), X.chunks(t(s, d, "documents"))),
        CHUNKS + f""", q AS ({quality_sql("documents")}), c AS (SELECT doc_id, count(*) AS n_chunks, sum(len(regexp_extract_all(text, '{T.NOT_SPACE}')))::BIGINT AS n_words FROM chunks GROUP BY 1)
SELECT doc_id, CASE WHEN contains(lower(source), 'invoice') THEN 'invoice' WHEN contains(lower(source), 'report') THEN 'report' WHEN contains(lower(source), 'manual') THEN 'manual' ELSE 'text' END AS type, score, coalesce(n_chunks, 0) AS n_chunks, coalesce(n_words, 0) AS n_words FROM documents LEFT JOIN q USING (doc_id) LEFT JOIN c USING (doc_id)""",
    ),
    "embedding_records": (
        lambda s, d: R.embedding_records(parts(s, d)),
        CHUNKS + f""", p AS (SELECT 'chunk' AS kind, chunk_id AS ref, text FROM chunks UNION ALL SELECT 'heading', doc_id || '-' || pos, text FROM ({BLOCKS}) WHERE is_heading), h AS (SELECT kind, ref, sha256(text) AS text_hash FROM p WHERE trim(text) <> '')
SELECT kind, ref, text_hash, sha256({VECTOR}) AS vector_hash FROM h""",
    ),
    "format_context": (lambda s, d: R.format_context(grouped(s, d)), P.BASE + CONTEXT + " SELECT query_id, context FROM ctx"),
    "build_prompts": (
        lambda s, d: R.build_prompts(P.asked(s, d), V.intents(P.asked(s, d)), R.format_context(grouped(s, d))),
        P.BASE + CONTEXT + ", " + INTENT + f""" SELECT query_id, 'Plan: ' || {PLAN} || chr(10) || 'Question: ' || it.text || chr(10) || 'Context:' || chr(10) || coalesce(context, 'none') || chr(10) || 'Answer with sources in brackets.' AS prompt FROM it LEFT JOIN ctx USING (query_id)""",
    ),
}
