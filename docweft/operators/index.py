"""An incremental BM25 index in a folder: a base and deltas of postings, tombstones, and document frequencies kept up to date from deltas.

Tables below the folder, each in parts batch=N: postings (doc_id, term, tf, length; by slot of the term), docs (doc_id, length, n_terms, terms: its terms with their tf; no length where the batch deletes), dead (doc_id, dead: the batch whose version of the
document no longer counts), terms (term, df: how the term's document frequency changes), stats (n_docs, n_tokens: likewise) and commits. A batch counts once its commit is
written, and is computed from the batches committed before it, so applying it again changes nothing. Only changed documents are split into tokens, once. What a batch or a
compaction takes back or keeps is found in docs, a row a document, not in the postings.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docweft import functions as T
from docweft.operators.search import MOST_TERMS, add_up, top
from docweft.shared import cut

SLOTS = 16
SCHEMAS = {
    "postings": "doc_id long, term string, tf long, length int, batch long, slot int",
    "docs": "doc_id long, length int, n_terms int, terms array<struct<term:string,tf:long>>, batch long",
    "dead": "doc_id long, dead long, batch long",
    "terms": "term string, df long, batch long",
    "stats": "n_docs long, n_tokens long, batch long",
}
#: Tombstones since the last compaction are sent to all tasks up to this number, else joined by a shuffle.
FEW = 1_000_000
#: Postings are written by tasks of about POSTED of them at most, which sort them by slot in memory, but of at least LEAST where there are enough.
POSTED, LEAST = 4_000_000, 250_000


def _write(df: DataFrame, root: str, name: str, batch: int, by: list[str] = []) -> None:
    df.write.mode("overwrite").partitionBy(*by).parquet(f"{root}/{name}/batch={batch}")


def committed(spark: SparkSession, root: str) -> list[int]:
    """The numbers of the batches that count; compaction keeps them few."""
    return sorted(r[0] for r in spark.read.schema("batch long").parquet(f"{root}/commits").distinct().collect())


def read(spark: SparkSession, root: str, name: str, batches: list[int]) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{root}/{name}").filter(F.col("batch").isin(*batches))


def slot(term: Column | str) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(SLOTS)).cast("int")


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, length (null without tokens), n_terms, terms (the different tokens with their tf) of doc_id, tokens, a batch of documents at once."""
    for batch in batches:
        sizes = pc.fill_null(pc.list_value_length(batch.column("tokens")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        words = batch.column("tokens").flatten().dictionary_encode()
        many = max(len(words.dictionary), 1)
        pairs, tf = np.unique(np.repeat(np.arange(len(sizes)), sizes) * many + words.indices.to_numpy(zero_copy_only=False), return_counts=True)
        starts = np.searchsorted(pairs, np.arange(len(sizes) + 1) * many).astype(np.int32)
        terms = pa.StructArray.from_arrays([words.dictionary.take(pa.array(pairs % many)), pa.array(tf.astype(np.int64))], ["term", "tf"])
        columns = [batch.column("doc_id"), pa.array(sizes.astype(np.int32), mask=sizes == 0), pa.array(np.diff(starts)), pa.ListArray.from_arrays(pa.array(starts), terms)]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "length", "n_terms", "terms"])


def _post(docs: DataFrame, root: str, batch: int) -> None:
    """Writes the postings of docs (doc_id, length, n_terms, terms). Documents are dealt, not their postings."""
    total = docs.agg(F.coalesce(F.sum("n_terms"), F.lit(0))).first()[0]
    tasks = max(1, -(-total // POSTED), min(docs.sparkSession.sparkContext.defaultParallelism, total // LEAST))
    each = docs.select("doc_id", "length", "terms.term", "terms.tf").repartition(tasks, "doc_id").select("doc_id", "length", F.inline(F.arrays_zip("term", "tf")))
    _write(each.select("doc_id", "term", "tf", "length", slot("term").alias("slot")).sortWithinPartitions("slot"), root, "postings", batch, ["slot"])


def build(docs: DataFrame, root: str) -> None:
    """A new index of docs (doc_id, text; texts without a word are left out), as batch 0."""
    _apply(docs.select(F.col("doc_id").cast("long"), "text", F.lit("upsert").alias("op")), root, 0, [])


def update(changes: DataFrame, root: str, batch: int) -> None:
    """Applies changes (doc_id, text, op: upsert or delete; seq, if there, orders the changes of one document, of which the last counts) as one batch.

    A batch that is committed is not applied again. An upsert without a word is left out, and the document stays as it was; deleting an unknown document does
    nothing. A null doc_id is left out.
    """
    done = committed(changes.sparkSession, root)
    if batch not in done:
        _apply(changes, root, batch, [b for b in done if b < batch])


def _apply(changes: DataFrame, root: str, batch: int, done: list[int]) -> None:
    spark = changes.sparkSession
    usable = changes.filter(F.col("doc_id").isNotNull() & ((F.col("op") == "delete") | F.lower(T.text_of("text")).rlike(T.WORD)))
    last = Window.partitionBy("doc_id").orderBy(F.desc("seq") if "seq" in changes.columns else F.xxhash64("op", "text"))
    tokens = F.when(F.col("op") == "upsert", T.tokens("text")).alias("tokens")
    one = usable.withColumn("_r", F.row_number().over(last)).filter("_r = 1").select(F.col("doc_id").cast("long"), tokens)
    _write(one.mapInArrow(count_terms, "doc_id long, length int, n_terms int, terms array<struct<term:string,tf:long>>"), root, "docs", batch)
    changed = read(spark, root, "docs", [batch])
    new = changed.filter("length is not null")
    _post(new, root, batch)
    sizes = new.select("doc_id", "length")
    plus = read(spark, root, "postings", [batch]).select("term", F.lit(1).alias("df"))
    counts = sizes.agg(F.count("*").alias("n_docs"), F.coalesce(F.sum("length"), F.lit(0)).alias("n_tokens"))
    if done:
        # The versions that the batch replaces: of its documents only.
        live = read(spark, root, "docs", done).filter("length is not null").join(changed.select("doc_id"), "doc_id", "left_semi").join(read(spark, root, "dead", done).select("doc_id", F.col("dead").alias("batch")), ["doc_id", "batch"], "left_anti")
        old = cut(live.select("doc_id", "batch", "length"))
        gone = old.select("doc_id", F.col("batch").alias("dead"))
        minus = read(spark, root, "docs", done).select("doc_id", "batch", "terms.term").join(old.select("doc_id", "batch"), ["doc_id", "batch"], "left_semi").select(F.explode("term").alias("term"), F.lit(-1).alias("df"))
        plus = plus.unionByName(minus)
        counts = counts.unionByName(old.agg((-F.count("*")).alias("n_docs"), (-F.coalesce(F.sum("length"), F.lit(0))).alias("n_tokens"))).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    else:
        gone = changed.limit(0).select("doc_id", F.lit(0).cast("long").alias("dead"))
    _write(gone, root, "dead", batch)
    _write(plus.groupBy("term").agg(F.sum("df").alias("df")).filter("df <> 0"), root, "terms", batch)
    _write(counts, root, "stats", batch)
    _write(spark.range(1).select(F.lit(1).alias("done")), root, "commits", batch)


def index_counts(spark: SparkSession, root: str) -> DataFrame:
    """One row: n_docs, n_tokens, n_terms, n_batches."""
    done = committed(spark, root)
    terms = read(spark, root, "terms", done).groupBy("term").agg(F.sum("df").alias("df")).filter("df > 0").agg(F.count("*").alias("n_terms"))
    return read(spark, root, "stats", done).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).crossJoin(F.broadcast(terms)).withColumn("n_batches", F.lit(len(done)))  # one row each


def living(spark: SparkSession, root: str, done: list[int], found: DataFrame) -> DataFrame:
    """The rows of found (doc_id, batch) whose document's version counts."""
    dead = read(spark, root, "dead", done).select("doc_id", F.col("dead").alias("batch"))
    few = dead.limit(FEW + 1).count() <= FEW
    return found.join(F.broadcast(dead) if few else dead, ["doc_id", "batch"], "left_anti")


def search(spark: SparkSession, root: str, queries: DataFrame, k: int = 30, b: float = 0.75, k1: float = 1.5) -> DataFrame:
    """query_id, rank, doc_id, score as of search.bm25 over the documents that the index holds. Of the postings, the slots of the queries' terms are read; no text is split but the queries'."""
    done = committed(spark, root)
    terms = cut(queries.select("query_id", F.explode(F.array_distinct(T.tokens("text"))).alias("term")))
    few = terms.limit(MOST_TERMS + 1).count() <= MOST_TERMS
    small = F.broadcast if few else lambda df: df
    asked = small(terms.select("term").distinct().withColumn("slot", slot("term")))
    found = living(spark, root, done, read(spark, root, "postings", done).join(asked, ["slot", "term"]))
    df = small(read(spark, root, "terms", done).join(asked.select("term"), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df")))
    stats = read(spark, root, "stats", done).agg(F.sum("n_docs").alias("n_docs"), (F.sum("n_tokens") / F.sum("n_docs")).alias("avg_length"))
    idf = F.log(1.0 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = F.col("tf") + k1 * (1.0 - b + b * F.col("length") / F.col("avg_length"))
    weighted = found.join(df, "term").crossJoin(F.broadcast(stats)).select("term", "doc_id", (idf * F.col("tf") * (k1 + 1.0) / norm).alias("w"))  # one row of statistics
    n_docs = read(spark, root, "stats", done).agg(F.coalesce(F.sum("n_docs"), F.lit(0))).first()[0]
    scores = add_up(weighted, terms, n_docs, queries.count())
    return top(scores, "query_id", k, F.desc("score"), F.col("doc_id")).select("query_id", "rank", "doc_id", "score")


def compact(spark: SparkSession, root: str, to: str) -> None:
    """The index without dead postings and in one batch, in a new folder; its number is that of the last batch, so later ones go on from there."""
    done = committed(spark, root)
    batch = done[-1]
    live = living(spark, root, done, read(spark, root, "docs", done).filter("length is not null")).drop("batch")
    _write(live, to, "docs", batch)
    _post(read(spark, to, "docs", [batch]), to, batch)
    dead = read(spark, root, "dead", done)
    _write(dead.limit(0).select("doc_id", "dead"), to, "dead", batch)
    _write(read(spark, root, "terms", done).groupBy("term").agg(F.sum("df").alias("df")).filter("df <> 0"), to, "terms", batch)
    _write(read(spark, root, "stats", done).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")), to, "stats", batch)
    _write(spark.range(1).select(F.lit(1).alias("done")), to, "commits", batch)
