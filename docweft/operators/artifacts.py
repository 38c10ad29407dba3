"""Canonical documents from JSON, table and document records, embedding records, formatted evidence and prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweft import functions as T
from docweft.operators.experts import bbox
from docweft.operators.records import embed

BLOCK = "array<struct<id:string,type:string,text:string,page:int,confidence:double,bbox:string>>"
#: How an answer is to be given, by intent.
PLANS = {
    "table_lookup": "Read the rows and columns of the tables, then give the values.",
    "figure_lookup": "Describe the figures that are named, then what they show.",
    "comparison": "Compare the items point by point, then sum up.",
    "definition": "Give the definition first, then its context.",
    "multi-hop": "Follow the links from one source to the next, then conclude.",
}
TEMPLATE = "Plan: {plan}\nQuestion: {question}\nContext:\n{context}\nAnswer with sources in brackets."


def normalize_documents(raw: DataFrame) -> DataFrame:
    """document_id, block_id, type, text, page, confidence, x1, y1, x2, y2 of every block. raw: json (document_path, blocks).

    document_id is the SHA-256 of the path. Missing fields: type paragraph, empty text, page 1, confidence 1, the whole page
    as box; a box may be an object or a list. JSON that can't be read has no blocks.
    """
    doc = F.from_json("json", f"document_path string, blocks {BLOCK}")
    each = raw.select(doc.alias("d")).select(F.sha2(F.coalesce("d.document_path", F.lit("")), 256).alias("document_id"), F.explode("d.blocks").alias("b"))
    each = each.select("document_id", "b.*", bbox(F.col("b.bbox")).alias("box"))
    filled = lambda c, v: F.coalesce(F.col(c), F.lit(v)).alias(c)
    return each.select("document_id", F.col("id").alias("block_id"), filled("type", "paragraph"), filled("text", ""), filled("page", 1), filled("confidence", 1.0), "box.*")


def table_records(tables: DataFrame) -> DataFrame:
    """table_id, rows, columns, n_cells: the declared size or what the cells need, whichever is larger. tables: table_id, rows, columns, cells (array of row, column from 0)."""
    need = lambda f: F.coalesce(F.array_max(F.transform("cells", lambda c: c[f])) + 1, F.lit(0))
    return tables.select("table_id", F.greatest(F.coalesce("rows", F.lit(0)), need("row")).alias("rows"), F.greatest(F.coalesce("columns", F.lit(0)), need("column")).alias("columns"), F.size("cells").alias("n_cells"))


def document_records(docs: DataFrame, scores: DataFrame, chunks: DataFrame) -> DataFrame:
    """doc_id, type, score, n_chunks, n_words: type by the first of the marks `invoice`, `report`, `manual` in the source's name, else text. scores: doc_id, score; chunks: doc_id, text."""
    name = F.lower(T.text_of("source"))
    kind = F.when(name.contains("invoice"), "invoice").when(name.contains("report"), "report").when(name.contains("manual"), "manual").otherwise("text")
    parts = chunks.groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.sum(T.n_tokens("text")).alias("n_words"))
    return docs.select("doc_id", kind.alias("type")).join(scores.select("doc_id", "score"), "doc_id", "left").join(parts, "doc_id", "left").select("doc_id", "type", "score", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), F.coalesce("n_words", F.lit(0)).alias("n_words"))


def embedding_records(parts: DataFrame) -> DataFrame:
    """kind, ref, text_hash, vector_hash of every part (kind, ref, text) with text: each different text is embedded once."""
    some = parts.filter(F.trim(T.text_of("text")) != "").select("kind", "ref", F.sha2("text", 256).alias("text_hash"), "text")
    vectors = embed(some.select("text")).select("text_hash", F.sha2("vector", 256).alias("vector_hash"))
    return some.select("kind", "ref", "text_hash").join(vectors, "text_hash").select("kind", "ref", "text_hash", "vector_hash")


def format_context(ranked: DataFrame, chars: int = 120) -> DataFrame:
    """query_id, context: the ranked texts (query_id, rank, group, text), `chars` characters each, numbered by rank and grouped; groups in order of their best rank."""
    line = F.concat(F.lit("["), "rank", F.lit("] "), F.substring(F.regexp_replace(T.text_of("text"), r"\s+", " "), 1, chars))
    lines = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"]), "\n")
    groups = ranked.withColumn("group", F.coalesce("group", F.lit("unknown"))).groupBy("query_id", "group").agg(F.min("rank").alias("best"), lines.alias("lines"))
    part = F.concat(F.lit("## "), "group", F.lit("\n"), "lines")
    return groups.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("best", part.alias("part")))), lambda x: x["part"]), "\n\n").alias("context"))


def build_prompts(queries: DataFrame, intents: DataFrame, context: DataFrame) -> DataFrame:
    """query_id, prompt: the template with the plan of the query's intent (else a general one), its text and its context."""
    plan = F.lit("Answer from the context only.")
    for name, text in PLANS.items():
        plan = F.when(F.col("intent") == name, text).otherwise(plan)
    each = queries.join(intents.select("query_id", "intent"), "query_id").join(context, "query_id", "left")
    out = F.replace(F.lit(TEMPLATE), F.lit("{plan}"), plan)
    out = F.replace(out, F.lit("{question}"), T.text_of("text"))
    return each.select("query_id", F.replace(out, F.lit("{context}"), F.coalesce("context", F.lit("none"))).alias("prompt"))
