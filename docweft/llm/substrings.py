"""Substring dedup over words with difference-cover anchors.

A set D of residues mod v such that every residue is a difference of two of its members (a difference cover) has this
property: any two positions i and j have a shift below v that takes both to positions whose residues are in D. So of two
equal passages of 20 words, whatever their places, some two anchors (windows of 20 - v + 1 words at cover positions)
lie at the same place in both.
1. Anchors of all documents are hashed and dealt into buckets by hash; those that occur twice are told to their documents.
2. Each such anchor is extended: the 20-word windows that contain it are hashed and dealt into buckets; in each
   bucket a window that isn't the first of its kind is told to its document.
3. Documents drop the words which those windows cover.
What goes into a bucket comes packed, and of one hash each batch of documents sends two anchors or one window at most (the
others need no answer from outside), so that a passage that is in every third document loads no bucket.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweft.llm import bytehash as bh
from docweft.llm.common import table, tasks

#: Difference covers: period and residues. Every residue mod the period is a difference of two of them.
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}
#: So many anchors or windows are gathered before they are sent.
SEND = 1_000_000

PACKED = "bucket int, h binary, doc binary, at binary"
TOLD = "doc_id long, told binary"


def pack(n: int, h: np.ndarray, doc: np.ndarray, at: np.ndarray, known_doc: np.ndarray, known_at: np.ndarray) -> pa.RecordBatch:
    """One row for each bucket with its hashes, documents and places, and one with what is known already (h null)."""
    to = ((h >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)
    order = np.argsort(to, kind="stable")
    edges = np.searchsorted(to[order], np.arange(n + 1))
    h, doc, at = h[order], doc[order], at[order]
    full = np.flatnonzero(np.diff(edges))
    rows = [(int(b), h[edges[b] : edges[b + 1]].tobytes(), doc[edges[b] : edges[b + 1]].tobytes(), at[edges[b] : edges[b + 1]].astype(np.int32).tobytes()) for b in full]
    if len(known_doc):
        rows.append((int(known_doc[0]) % n, None, known_doc.tobytes(), known_at.astype(np.int32).tobytes()))
    cols = list(zip(*rows)) or [(), (), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *[pa.array(c, pa.binary()) for c in cols[1:]]], names=["bucket", "h", "doc", "at"])


def unpack(rows: pa.Table) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, np.ndarray]]:
    """(hashes, documents, places) of a bucket, and (documents, places) known already."""
    joined: list[list[bytes]] = [[], [], [], [], []]
    for h, doc, at in zip(*(rows.column(c).to_pylist() for c in ("h", "doc", "at"))):
        if h is None:
            joined[3].append(doc)
            joined[4].append(at)
        else:
            for k, x in enumerate((h, doc, at)):
                joined[k].append(x)
    kinds = (np.uint64, np.int64, np.int32, np.int64, np.int32)
    a = [np.frombuffer(b"".join(x), t) for x, t in zip(joined, kinds)]
    return (a[0], a[1], a[2]), (a[3], a[4])


def tell(doc: np.ndarray, at: np.ndarray) -> pa.Table:
    """One row for each document with its places."""
    order = np.lexsort((at, doc))
    doc, at = doc[order], at[order]
    starts = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]) if len(doc) else np.zeros(0, np.int64)
    ends = np.r_[starts[1:], len(doc)]
    return pa.table({"doc_id": pa.array(doc[starts]), "told": pa.array([at[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary())})


def nth_of_kind(h: np.ndarray, *order: np.ndarray) -> np.ndarray:
    """For each entry how many entries with its hash come before it, in the given order."""
    by = np.lexsort((*order[::-1], h))
    s = h[by]
    new = np.r_[True, s[1:] != s[:-1]] if len(s) else np.zeros(0, bool)
    first = np.maximum.accumulate(np.where(new, np.arange(len(s)), 0))
    out = np.empty(len(h), np.int64)
    out[by] = np.arange(len(s)) - first
    return out


def follows(h: np.ndarray, doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Entries that come strictly after the first place of their kind."""
    by = np.lexsort((at, doc, h))
    s = h[by]
    new = np.r_[True, s[1:] != s[:-1]] if len(s) else np.zeros(0, bool)
    first = by[np.maximum.accumulate(np.where(new, np.arange(len(s)), 0))]
    out = np.empty(len(h), bool)
    out[by] = (doc[by] != doc[first]) | (at[by] != at[first])
    return out


def gathered(found: DataFrame) -> DataFrame:
    """All that is told to a document in one row."""
    return found.groupBy("doc_id").agg(F.collect_list("told").alias("told"))


def texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), "text")


class Words:
    """The words of a part of a batch: where they are, their hashes, and which text's they are."""

    def __init__(self, data: np.ndarray, ends: np.ndarray):
        self.starts, self.stops, self.first = bh.words(data, ends)
        self.hashes = bh.runs(bh.BYTE[data], self.starts, self.stops)

    def place(self) -> np.ndarray:
        """Of each word, its number within its text."""
        return np.arange(len(self.starts)) - np.repeat(self.first[:-1], np.diff(self.first))


def anchor_rows(docs: DataFrame, length: int, period: int, n: int) -> DataFrame:
    width = length - period + 1
    cover = np.zeros(period, bool)
    cover[list(COVERS[period])] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def send() -> pa.RecordBatch:
            h, doc, at = (np.concatenate(x) for x in zip(*held))
            held.clear()
            known = nth_of_kind(h, np.arange(len(h))) >= 2
            return pack(n, h[~known], doc[~known], at[~known], doc[known], at[known])

        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for a, b, data, ends in bh.parts(batch.column("text")):
                w = Words(data, ends)
                place, size = w.place(), np.diff(w.first)
                left = np.repeat(size, size) - place  # words from here to the end of the text
                at = np.flatnonzero(cover[place % period] & (left >= width) & (np.repeat(size, size) >= length))
                held.append((bh.runs(w.hashes, at, at + width), np.repeat(ids[a:b], size)[at], place[at]))
                if sum(len(x[0]) for x in held) >= SEND:
                    yield send()
        if held:
            yield send()

    return texts(docs).filter("doc_id is not null").mapInArrow(run, PACKED)


def repeated(rows: DataFrame) -> DataFrame:
    """What occurs twice or more in a bucket, told to its documents."""

    def run(group: pa.Table) -> pa.Table:
        (h, doc, at), (known_doc, known_at) = unpack(group)
        _, kind, count = np.unique(h, return_inverse=True, return_counts=True)
        again = count[kind] >= 2
        return tell(np.r_[doc[again], known_doc], np.r_[at[again], known_at])

    return rows.groupBy("bucket").applyInArrow(run, TOLD)


def not_first(rows: DataFrame) -> DataFrame:
    """Windows of a bucket that another one of their kind precedes (smaller document, or earlier in the same one), told to their documents."""

    def run(group: pa.Table) -> pa.Table:
        (h, doc, at), (known_doc, known_at) = unpack(group)
        later = follows(h, doc, at)
        return tell(np.r_[doc[later], known_doc], np.r_[at[later], known_at])

    return rows.groupBy("bucket").applyInArrow(run, TOLD)


def _told(value: pa.Scalar) -> np.ndarray:
    parts = value.as_py()
    return np.frombuffer(b"".join(parts), np.int32).astype(np.int64) if parts else np.zeros(0, np.int64)


def window_rows(docs: DataFrame, anchors: DataFrame, length: int, period: int, n: int) -> DataFrame:
    """The windows that contain a repeated anchor. The join keeps all texts, so that it and the last one read one shuffle of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def send() -> pa.RecordBatch:
            h, doc, at = (np.concatenate(x) for x in zip(*held))
            held.clear()
            known = follows(h, doc, at)
            return pack(n, h[~known], doc[~known], at[~known], doc[known], at[known])

        for batch in batches:
            ids = batch.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False)  # rows without an id are told nothing
            told = batch.column("told")
            rows = np.flatnonzero(told.is_valid().to_numpy(zero_copy_only=False))
            if not len(rows):
                continue
            some = batch.take(pa.array(rows))
            for a, b, data, ends in bh.parts(some.column("text")):
                w = Words(data, ends)
                for d in range(a, b):
                    lo, hi = w.first[d - a], w.first[d - a + 1]
                    mark = np.zeros(hi - lo + 2, np.int64)
                    at = _told(some.column("told")[d])
                    at = at[at + length - period + 1 <= hi - lo]  # rows of one id can differ in text
                    np.add.at(mark, np.maximum(at - period + 1, 0), 1)
                    np.add.at(mark, at + 1, -1)
                    start = np.flatnonzero(np.cumsum(mark)[: max(0, hi - lo - length + 1)])
                    if len(start):
                        held.append((bh.runs(w.hashes[lo:hi], start, start + length), np.full(len(start), ids[rows[d]]), start))
                if sum(len(x[0]) for x in held) >= SEND:
                    yield send()
        if held:
            yield send()

    return texts(docs).join(anchors, "doc_id", "left").mapInArrow(run, PACKED)


def covered(n: int, starts: np.ndarray, length: int) -> np.ndarray:
    """Which of n places lie within `length` places from one of the starts."""
    mark = np.zeros(n + 1, np.int64)
    starts = starts[starts + length <= n]
    np.add.at(mark, starts, 1)
    np.add.at(mark, starts + length, -1)
    return np.cumsum(mark)[:n] > 0


def dedup(docs: DataFrame, length: int = 20, period: int = 13, digest: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and the kept words joined by one space (text), or with digest=True their SHA-256 (kept_sha256).

    A word goes if a window of `length` words that covers it also starts earlier: in a document with a smaller id or earlier
    in its own. Words are runs without ASCII white space, unchanged. Null and empty texts have no words. Rows with one id
    are at the same place: none is earlier than the other by that, and what is told to an id holds for all its rows; rows with a null id lose nothing and precede nothing. An empty
    table gives an empty result. Other columns are not looked at.
    """
    n = 4 * tasks(docs.sparkSession)
    anchors = gathered(repeated(anchor_rows(docs, length, period, n)))
    windows = gathered(not_first(window_rows(docs, anchors, length, period, n)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, removed, kept = [], [], []
            for a, b, data, ends in bh.parts(batch.column("text")):
                starts, stops, first = bh.words(data, ends)
                raw = data.tobytes()
                for d in range(a, b):
                    lo, hi = first[d - a], first[d - a + 1]
                    gone = covered(hi - lo, _told(batch.column("told")[d]), length)
                    words = raw[ends[d - a] : ends[d - a + 1]].split()
                    total.append(hi - lo)
                    removed.append(int(gone.sum()))
                    text = b" ".join([w for w, g in zip(words, gone) if not g] if removed[-1] else words)
                    kept.append(hashlib.sha256(text).hexdigest() if digest else text.decode())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", name])

    name = "kept_sha256" if digest else "text"
    return texts(docs).join(windows, "doc_id", "left").mapInArrow(run, f"doc_id long, n_words long, n_removed long, {name} string")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"), digest=True)
