"""Toxicity: a linear classifier over character n-grams, whose features are scaled by naive Bayes log-count ratios.

Training: of the labelled documents that may be learned from, at most `most` (by a hash of the id) are taken. Counts of
n-grams by label give the log-count ratios; the n-grams whose ratio stands out most against chance are the features; a
feature's value is its ratio if the text has the n-gram, else 0; logistic regression (pyspark.ml) gives the weights.
Characters are code points, A-Z in lower case; n-grams are known by 64-bit hashes. Scoring reads each whole text once, in the tasks; the
model is at most `n_features` numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweft.llm import bytehash as bh
from docweft.llm.common import cut, table, tasks

ORDERS = (3, 4, 5, 6)
BUCKET_BITS = 20


def held_out(doc_id) -> F.Column:
    """True for the documents that are kept for tests: crc32 of the id as text, mod 4, is 2."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def characters(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code points of texts given as bytes of UTF-8, A-Z in lower case, and where each text begins and ends among them.

    If the bytes aren't UTF-8, each byte is a character.
    """
    try:
        points = np.frombuffer(bh.LOWER[data].tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    except UnicodeDecodeError:
        return bh.LOWER[data].astype(np.uint32), ends
    before = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
    return points, before[ends]


def grams(points: np.ndarray, n: int) -> np.ndarray:
    """Each n-gram of code points as one number."""
    m = max(0, len(points) - n + 1)
    out = np.full(m, n, np.uint64)
    for k in range(n):
        out = out * bh.BASE + points[k : k + m].astype(np.uint64)
    return out


def bucket(keys: np.ndarray) -> np.ndarray:
    return (bh.mix(keys) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


@dataclass
class Model:
    keys: np.ndarray  # sorted n-grams
    weights: np.ndarray
    intercept: float

    def __post_init__(self):
        self.flags = np.zeros(1 << BUCKET_BITS, bool)
        self.flags[bucket(self.keys)] = True

    def present(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text, feature) pairs, each once, sorted. data, ends: bytes of UTF-8 and where each text begins and ends."""
        pairs = []
        data, ends = characters(data, ends)
        for n in ORDERS if len(self.keys) else ():
            keys = grams(data, n)
            at = np.flatnonzero(self.flags[bucket(keys)])
            keys = keys[at]
            k = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            doc = np.searchsorted(ends, at, "right") - 1
            good = (self.keys[k] == keys) & (at + n <= ends[doc + 1])
            pairs.append(doc[good] * len(self.keys) + k[good])
        both = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
        return both // max(1, len(self.keys)), both % max(1, len(self.keys))

    def scores(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        doc, k = self.present(data, ends)
        z = self.intercept + np.bincount(doc, self.weights[k], len(ends) - 1)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _counts(sample: DataFrame, keep: np.ndarray | None) -> DataFrame:
    """(k, p, n): in how many texts of either label each bucket is found, or, with keep, each n-gram of those buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[np.ndarray] = [[], []]
        total = np.zeros((2, 1 << BUCKET_BITS), np.int32)
        for batch in batches:
            toxic = batch.column("toxic").to_numpy(zero_copy_only=False)
            for a, b, data, ends in bh.parts(batch.column("text")):
                data, ends = characters(data, ends)
                for d in range(a, b):
                    keys = [grams(data[ends[d - a] : ends[d - a + 1]], n) for n in ORDERS]
                    keys = np.concatenate(keys)
                    if keep is None:
                        total[toxic[d], np.unique(bucket(keys))] += 1
                    else:
                        found[toxic[d]].append(np.unique(keys[keep[bucket(keys)]]))
        if keep is None:
            k = np.flatnonzero(total.sum(0))
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(total[1, k].astype(np.int64)), pa.array(total[0, k].astype(np.int64))], names=["k", "p", "n"])
        else:
            for label, lists in enumerate(found):
                k, c = np.unique(np.concatenate(lists), return_counts=True) if lists else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
                zero = np.zeros(len(k), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int64)), pa.array(c if label else zero), pa.array(zero if label else c)], names=["k", "p", "n"])

    rows = sample.select("text", "toxic").mapInArrow(run, "k long, p long, n long")
    return rows.groupBy("k").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))


def _ratio(n_pos: int, n_neg: int) -> tuple[F.Column, F.Column]:
    """The log-count ratio and how many standard errors it is from 0."""
    p, n = F.col("p") + 1.0, F.col("n") + 1.0
    r = F.log(p / (n_pos + 2.0)) - F.log(n / (n_neg + 2.0))
    return r, F.abs(r) / F.sqrt(1.0 / p + 1.0 / n)


def fit(docs: DataFrame, labels: DataFrame, most: int = 16_000, n_features: int = 4096, reg: float = 1e-3) -> Model:
    """docs: doc_id, text; labels: doc_id, toxic (0/1; null and other values are left out; the larger counts if an id has both).

    `most` bounds the sample that is learned from; it is broadcast as ids to find its texts. With no labelled rows the
    model scores 0 for all, with one label only the share of that label.
    """
    spark = docs.sparkSession
    labelled = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = labelled.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    sample = cut(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").repartition(min(8, tasks(spark))))
    n = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    pos, neg = n.get(1, 0), n.get(0, 0)
    if not pos or not neg:
        return Model(np.zeros(0, np.uint64), np.zeros(0), 30.0 if pos else -30.0)
    r, z = _ratio(pos, neg)
    keep = np.zeros(1 << BUCKET_BITS, bool)
    keep[[x["k"] for x in _counts(sample, None).orderBy(z.desc(), "k").limit(n_features).select("k").collect()]] = True
    best = _counts(sample, keep).select("k", r.alias("r"), z.alias("z")).orderBy(F.desc("z"), "k").limit(n_features).select("k", "r").toPandas()
    order = np.argsort(best["k"].to_numpy().astype(np.uint64))
    keys, ratios = best["k"].to_numpy().astype(np.uint64)[order], best["r"].to_numpy()[order]
    finder = Model(keys, ratios, 0.0)

    def sparse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            at, values = [], []
            for a, b, data, ends in bh.parts(pa.array(batch["text"], pa.string())):
                doc, k = finder.present(data, ends)
                for d in range(b - a):
                    own = k[np.searchsorted(doc, d) : np.searchsorted(doc, d, "right")]
                    at.append(own.tolist())
                    values.append(ratios[own].tolist())
            yield pd.DataFrame({"label": batch["toxic"].astype(float).to_numpy(), "at": at, "v": values})

    found = sample.select("text", "toxic").mapInPandas(sparse, "label double, at array<int>, v array<double>")
    size = len(keys)
    vector = F.udf(lambda at, v: SparseVector(size, at, v), VectorUDT())  # a row each of the bounded sample
    data = found.select("label", vector("at", "v").alias("features")).cache()
    model = LogisticRegression(regParam=reg, standardization=False, maxIter=60).fit(data)
    data.unpersist()
    return Model(keys, model.coefficients.toArray() * ratios, float(model.intercept))


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """doc_id, score, predicted of every row. Null and empty texts have no n-grams and get the model's base score; a null doc_id stays. Repeated rows give repeated rows with equal scores, an empty table an empty result; other columns are not looked at."""
    held = docs.sparkSession.sparkContext.broadcast((model.keys, model.weights, model.intercept))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*held.value)
        for batch in batches:
            found = [model.scores(data, ends) for _, _, data, ends in bh.parts(batch.column("text"))]
            s = np.concatenate(found) if found else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, predicted int")


def clean(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows of docs, all columns, whatever their names, whose text scores below the threshold; null and empty texts by the model's base score. Repeated rows stay or go together; an empty table gives an empty result."""
    held = docs.sparkSession.sparkContext.broadcast((model.keys, model.weights, model.intercept))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*held.value)
        for batch in batches:
            for a, b, data, ends in bh.parts(batch.column("text")):
                yield batch.slice(a, b - a).filter(pa.array(model.scores(data, ends) < threshold))

    return docs.mapInArrow(run, docs.schema)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
