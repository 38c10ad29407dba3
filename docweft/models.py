"""Hooks for models: embedders and pair scorers that are loaded once a worker process, with deterministic fallbacks, and chunkers as table functions for SQL.

A loader is a function without arguments that returns the model: for embedders, a function from a list of texts to a list of vectors; for scorers, from lists of queries and texts to a list
of numbers. It runs on the workers, when the first batch comes; a process that is used again has its model already.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docweft import functions as T

_loaded: dict[str, object] = {}


def once(name: str, load: Callable[[], object]) -> object:
    """The model of this name in this process."""
    if name not in _loaded:
        _loaded[name] = load()
    return _loaded[name]


def hashed(dims: int = 64) -> Callable[[], Callable[[list[str]], np.ndarray]]:
    """The fallback embedder: a unit vector drawn by a generator whose seed is the first eight hex digits of the text's MD5."""

    def encode(texts: list[str]) -> np.ndarray:
        out = np.empty((len(texts), dims), np.float32)
        for i, text in enumerate(texts):
            out[i] = np.random.RandomState(int(hashlib.md5(text.encode()).hexdigest()[:8], 16)).randn(dims)
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), np.float32(1e-30))

    return lambda: encode


def overlap() -> Callable[[list[str], list[str]], list[float]]:
    """The fallback scorer: the share of the query's different words that the text has, as -2 to 2."""
    words = lambda x: set(re.findall(r"\w+", x.lower()))
    return lambda queries, texts: [4.0 * len(q & words(t)) / len(q) - 2.0 if (q := words(a)) else -2.0 for a, t in zip(queries, texts)]


def embedder(load: Callable[[], Callable], name: str):
    """A column function: the vectors of a column of texts."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = None
        for texts in batches:
            encode = encode or once(name, load)
            yield pd.Series([np.round(np.asarray(v, np.float64), 6).astype(np.float32).tolist() for v in encode(texts.tolist())] if len(texts) else [], dtype=object)

    return run


def scorer(load: Callable[[], Callable], name: str):
    """A column function: the raw scores of a column of queries and one of texts."""

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        score = None
        for queries, texts in batches:
            score = score or once(name, load)
            yield pd.Series(score(queries.tolist(), texts.tolist()) if len(queries) else [], dtype="float64")

    return run


def embed(rows: DataFrame, text: str = "text", load: Callable | None = None, name: str = "hashed-64", dims: int = 64) -> DataFrame:
    """rows with text_hash and vector: each different text goes to the model once. A null or blank text, and a row whose column embed is false, has the zero vector."""
    wanted = F.trim(T.text_of(text)) != ""
    if "embed" in rows.columns:
        wanted = wanted & F.coalesce(F.col("embed"), F.lit(True))
    keyed = rows.withColumn("text_hash", F.when(wanted, F.sha2(F.col(text), 256)))
    one = keyed.filter("text_hash is not null").groupBy("text_hash").agg(F.first(text).alias("_text"))
    vectors = one.select("text_hash", embedder(load or hashed(dims), name)("_text").alias("vector"))
    zero = F.array_repeat(F.lit(0.0).cast("float"), dims)
    return keyed.join(vectors, "text_hash", "left").withColumn("vector", F.coalesce("vector", zero))


def rerank(pairs: DataFrame, k: int = 5, load: Callable | None = None, name: str = "overlap") -> DataFrame:
    """query_id, place, doc_id, rerank_score of the k best pairs of each query (query_id, query, doc_id, text; graph, semantic and bm25 scores where there are such columns).

    The scorer's number is clamped to -60 to 60 and goes through a sigmoid (6 dp); a blank text has 0. Equal scores go by graph, semantic and bm25 score, then by the smaller doc_id.
    """
    raw = scorer(load or overlap, name)(T.text_of("query"), T.text_of("text"))
    scored = pairs.withColumn("_raw", raw).withColumn("rerank_score", F.when(F.trim(T.text_of("text")) == "", 0.0).otherwise(F.round(1.0 / (1.0 + F.exp(-F.greatest(F.lit(-60.0), F.least(F.lit(60.0), F.col("_raw"))))), 6)))
    ties: list[Column] = [F.desc(c) for c in ("graph", "semantic", "bm25") if c in pairs.columns]
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), *ties, "doc_id"))
    return scored.withColumn("place", place).filter(F.col("place") <= k).select("query_id", "place", "doc_id", "rerank_score")


class WordChunks:
    """chunk_words(text, size, overlap): windows of `size` words, each `overlap` words into the one before; the last one ends with the text."""

    def eval(self, text: str, size: int, overlap: int):
        words = (text or "").split()
        for k, start in enumerate(range(0, max(len(words) - overlap - 1, 0) + 1, size - overlap) if words else ()):
            part = words[start : start + size]
            yield k, len(part), " ".join(part)


class LineChunks:
    """chunk_lines(text, most): lines that aren't blank, packed in order up to `most` characters; a longer line stands alone."""

    def eval(self, text: str, most: int):
        held: list[str] = []
        size = k = 0
        for line in filter(None, map(str.strip, (text or "").split("\n"))):
            if held and size + 1 + len(line) > most:
                yield k, len(held), "\n".join(held)
                held, size, k = [], 0, k + 1
            size += len(line) + (1 if held else 0)
            held.append(line)
        if held:
            yield k, len(held), "\n".join(held)


def register_chunkers(spark: SparkSession) -> None:
    """Makes chunk_words and chunk_lines known to SQL: SELECT d.doc_id, c.* FROM documents d, LATERAL chunk_words(d.text, 300, 50) c."""
    spark.udtf.register("chunk_words", F.udtf(WordChunks, returnType="chunk_no int, n_words int, text string", useArrow=True))
    spark.udtf.register("chunk_lines", F.udtf(LineChunks, returnType="chunk_no int, n_lines int, text string", useArrow=True))
