"""Corpora and registries: reading, admission, upserts, manifests, paging, sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MAX_BYTES = 16 << 20
#: What may be uploaded.
MIME_TYPES = ("application/pdf", "text/plain", "image/png", "image/jpeg", "application/json")
EXTENSIONS = ("pdf", "txt", "png", "jpg", "jpeg", "json")


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """path, content, document_id (SHA-256 of the bytes) of every file below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content", F.sha2("content", 256).alias("document_id"))


def identify(docs: DataFrame) -> DataFrame:
    """Adds document_id, the SHA-256 of the text's bytes."""
    return docs.withColumn("document_id", F.sha2(F.coalesce("text", F.lit("")), 256))


def new_documents(corpus: DataFrame, registry: DataFrame, force: bool = False) -> DataFrame:
    """What the registry doesn't have, each document_id once (smallest doc_id)."""
    fresh = corpus if force else corpus.join(registry.select("document_id"), "document_id", "left_anti")
    return fresh.groupBy("document_id").agg(F.min("doc_id").alias("doc_id"))


def upsert_registry(old: DataFrame, new: DataFrame) -> DataFrame:
    """Both: document_id, version, created_at. The latest version wins and keeps the first created_at."""
    both = old.unionByName(new)
    return both.groupBy("document_id").agg(F.max("version").alias("version"), F.min("created_at").alias("created_at"))


def manifest(reps: dict[str, DataFrame]) -> DataFrame:
    """doc_id, representation, version (rows), content_hash of every representation (doc_id, item, in order of item)."""
    out = None
    for name, df in reps.items():
        items = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "item"))), lambda x: x["item"]), "\n")
        one = df.groupBy("doc_id").agg(F.lit(name).alias("representation"), F.count("*").alias("version"), F.sha2(items, 256).alias("content_hash"))
        out = one if out is None else out.unionByName(one)
    return out


def page(df: DataFrame, order: str, number: int, size: int) -> DataFrame:
    """One page of a listing, newest first, with total, has_next, has_prev. Only the rows up to the page's end are ranked."""
    total = df.agg(F.count("*").alias("total"))
    rows = df.orderBy(F.desc(order)).limit(number * size).withColumn("_r", F.row_number().over(Window.orderBy(F.desc(order)))).filter(F.col("_r") > (number - 1) * size).drop("_r")
    return rows.crossJoin(F.broadcast(total)).withColumn("has_next", F.col("total") > number * size).withColumn("has_prev", F.lit(number > 1))


def admit(files: DataFrame) -> DataFrame:
    """name, reason (null: admitted). files: name, mime, bytes."""
    extension = F.lower(F.regexp_extract("name", r"\.([^.]*)$", 1))
    reason = F.when(F.col("bytes") > MAX_BYTES, "too_large").when(~F.col("mime").isin(*MIME_TYPES), "mime_type").when(~extension.isin(*EXTENSIONS), "extension")
    return files.select("name", reason.alias("reason"))


def split_tables(rows: DataFrame, by: str, line: str, order: str, most: int = 50) -> DataFrame:
    """Tables longer than `most` rows in parts: table, part, parts, n_rows, text."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1
    n = F.count("*").over(Window.partitionBy(by))
    cut = rows.select(F.col(by).alias("table"), F.col(line).alias("line"), place.alias("i"), n.alias("n")).withColumn("part", F.floor(F.col("i") / most) + 1)
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "line"))), lambda x: x["line"]), "\n")
    return cut.groupBy("table", "part").agg(F.ceil(F.first("n") / most).alias("parts"), F.count("*").alias("n_rows"), text.alias("text"))


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_representation(df: DataFrame, root: str, name: str, buckets: int = 64) -> None:
    """One dataset for each representation, in buckets of documents; a rewrite replaces only the buckets it has rows of."""
    bucketed = df.withColumn("doc_bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int"))
    bucketed.repartition("doc_bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("doc_bucket").parquet(f"{root}/{name}")


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """One row for each question of QA files ({"questions": [...]})."""
    return spark.read.option("multiLine", True).json(path).select(F.explode("questions").alias("q")).select("q.*")
