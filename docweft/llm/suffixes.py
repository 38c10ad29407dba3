"""Repeated strings of bytes, found with the common-prefix interval trees of sorted suffixes.

One suffix array of all bytes would not fit any task, and nearly all suffixes are alone anyway. So suffixes are sorted
where they can meet:
1. Each string of `length` bytes has one anchor: among its substrings of `width` bytes the one with the least hash. Strings
   in a row share anchors (one in about 140 positions is one), equal strings have equal anchors at equal places. Anchors whose
   bytes occur once in all documents take no further part.
2. Around each other anchor, a document sends the bytes of the strings that the anchor stands for. Per anchor, the suffixes that
   begin there are sorted; the array of their common prefixes is scanned with a stack, which yields the intervals of the tree:
   sets of occurrences with a common extension to the right. Within an interval, occurrences are compared by what stands
   left of the anchor: those that agree on enough of it, while others differ (left diversity), form the maximal repeats.
   All occurrences in the interval are looked at, not neighbours in the array only.
3. Documents drop the bytes which the repeated strings cover.
A batch of documents sends an equal surrounding twice at most. An anchor with more than `heavy` occurrences is not sorted in one
task: hashes of the strings themselves are dealt into buckets instead, and those that occur twice are told to their documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweft.llm import bytehash as bh
from docweft.llm.common import cut, small, table, tasks
from docweft.llm.substrings import TOLD, nth_of_kind, pack, texts, unpack

ROWS = "bucket int, f long, doc_id long, place long, off int, seg binary, h binary, doc binary, at binary"
NAMES = [c.split()[0] for c in ROWS.split(", ")]
#: Positions are packed below 40 bits of a hash; texts are taken in pieces of so many strings.
PIECE = 1 << 23


def anchors(data: np.ndarray, ends: np.ndarray, length: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first string, last string, hash of the anchor's bytes): runs of strings (by where they start) with one anchor."""
    out = []
    for a in range(0, max(1, len(data)), PIECE):
        piece = data[a : a + PIECE + length - 1]
        n = len(piece) - length + 1
        if n <= 0:
            break
        at = np.arange(len(piece) - width + 1)
        h = bh.runs(bh.BYTE[piece], at, at + width)
        least = h >> np.uint64(24) << np.uint64(24) | at.astype(np.uint64)
        window, size = length - width + 1, 1
        while size * 2 <= window:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        if size < window:
            least = np.minimum(least[: len(least) - (window - size)], least[window - size :])
        anchor = (least[:n] & np.uint64(0xFFFFFF)).astype(np.int64)
        text = np.searchsorted(ends, np.arange(a, a + n), "right") - 1 if len(ends) > 2 else np.zeros(n, np.int64)
        inside = np.arange(a, a + n) + length <= ends[text + 1]
        change = np.r_[True, (anchor[1:] != anchor[:-1]) | (inside[1:] != inside[:-1]), True]
        edges = np.flatnonzero(change)
        first, last = edges[:-1], edges[1:] - 1
        good = inside[first]
        first, last = first[good], last[good]
        out.append((anchor[first] + a, first + a, last + a, h[anchor[first]]))
    if not out:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64))
    return tuple(np.concatenate(x) for x in zip(*out))


def anchor_rows(docs: DataFrame, length: int, width: int) -> DataFrame:
    """(f, doc_id, at): the anchors of all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for a, b, data, ends in bh.parts(batch.column("text")):
                at, _, _, f = anchors(data, ends, length, width)
                text = np.searchsorted(ends, at, "right") - 1
                yield pa.RecordBatch.from_arrays([pa.array(f.astype(np.int64)), pa.array(ids[a + text]), pa.array(at - ends[text])], names=["f", "doc_id", "at"])

    return texts(docs).filter("doc_id is not null").mapInArrow(run, "f long, doc_id long, at long")


def common(a: bytes, b: bytes) -> int:
    """How many bytes two strings have in common from their beginning."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


def intervals(prefixes: list[int]) -> Iterator[tuple[int, int, int]]:
    """(common prefix, first, last) of each interval of the tree, children before parents. prefixes[i]: of suffixes i - 1 and i."""
    stack: list[tuple[int, int]] = []
    for i in range(1, len(prefixes) + 1):
        now, begin = (prefixes[i] if i < len(prefixes) else -1), i - 1
        while stack and stack[-1][0] > now:
            size, begin = stack.pop()
            yield size, begin, i - 1
        if now >= 0 and (not stack or stack[-1][0] < now):
            stack.append((now, begin))


def repeats(segments: list[tuple[int, bytes]], length: int) -> Iterator[tuple[int, int, int]]:
    """(k, first, last): starts in segment k of strings that another segment has at the same distance from the anchor.

    segments: different ones, as (where the anchor is, bytes).
    """
    right = [s[off:] for off, s in segments]
    left = [s[:off][::-1] for off, s in segments]
    order = sorted(range(len(segments)), key=right.__getitem__)
    place = np.empty(len(left), np.int64)
    place[sorted(range(len(left)), key=left.__getitem__)] = np.arange(len(left))
    prefixes = [0, *(common(right[a], right[b]) for a, b in zip(order, order[1:]))]
    most = max(map(len, left))
    for size, begin, end in intervals(prefixes):
        if size + most < length:
            continue
        members = sorted(order[begin : end + 1], key=place.__getitem__)
        agree = [0, *(common(left[a], left[b]) for a, b in zip(members, members[1:])), 0]
        for i, k in enumerate(members):
            far = max(agree[i], agree[i + 1])  # the longest common left side with any other occurrence in the interval
            off, n = len(left[k]), len(segments[k][1]) - length
            first, last = off - min(off, far), min(n, off - max(0, length - size))
            if first <= last:
                yield k, first, last


def surroundings(docs: DataFrame, told: DataFrame, length: int, width: int, n: int) -> DataFrame:
    """ROWS for the anchors told to documents (at * 2, + 1 if heavy)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            rows = np.flatnonzero(batch.column("told").is_valid().to_numpy(zero_copy_only=False))
            if not len(rows):
                continue
            some = batch.take(pa.array(rows))
            sent: dict[bytes, int] = {}
            light: list[tuple] = []
            known: list[tuple[int, int, int]] = []
            heavy: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for a, b, data, ends in bh.parts(some.column("text")):
                at, first, last, f = anchors(data, ends, length, width)
                edges = np.searchsorted(at, ends)
                raw = data.tobytes()
                for d in range(a, b):
                    base, doc = int(ends[d - a]), int(ids[rows[d]])
                    lo, hi = edges[d - a], edges[d - a + 1]
                    asked = np.array(some.column("told")[d].as_py(), np.int64)
                    flag = dict(zip((asked >> 1).tolist(), (asked & 1).tolist()))
                    for k in range(lo, hi):
                        is_heavy = flag.get(int(at[k]) - base)
                        if is_heavy is None:
                            continue
                        p, q = int(first[k]), int(last[k])
                        if is_heavy:
                            s = np.arange(p, q + 1)
                            heavy.append((bh.runs(bh.BYTE[data[p : q + length]], s - p, s - p + length), np.full(len(s), doc), s - base))
                            continue
                        seg = raw[p : q + length]
                        key = hashlib.blake2b(seg + (int(at[k]) - p).to_bytes(4, "big"), digest_size=16).digest()
                        sent[key] = times = sent.get(key, 0) + 1
                        if times <= 2:
                            light.append((int(f[k].astype(np.int64)) % n, int(f[k].astype(np.int64)), doc, p - base, int(at[k]) - p, seg))
                        else:
                            known.append((doc, p - base, q - base))
            cols = list(zip(*light)) or [()] * 6
            empty = pa.nulls(len(cols[0]), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *[pa.array(c, pa.int64()) for c in cols[1:4]], pa.array(cols[4], pa.int32()), pa.array(cols[5], pa.binary()), empty, empty, empty], names=NAMES)
            h, doc, at = (np.concatenate(x) for x in zip(*heavy)) if heavy else (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
            more = nth_of_kind(h, np.arange(len(h))) >= 2
            known_doc = np.r_[np.array([k[0] for k in known], np.int64), doc[more]]
            known_at = np.r_[np.array([k[1:] for k in known], np.int64).reshape(-1, 2), np.stack([at[more], at[more]], 1)]
            packed = pack(n, h[~more], doc[~more], at[~more], np.repeat(known_doc, 2), known_at.ravel())
            m = packed.num_rows
            yield pa.RecordBatch.from_arrays([packed.column(0), *[pa.nulls(m, pa.int64())] * 3, pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary()), *packed.columns[1:]], names=NAMES)

    return texts(docs).join(told, "doc_id").mapInArrow(run, ROWS)


def told_ranges(doc: np.ndarray, ranges: np.ndarray) -> pa.Table:
    order = np.argsort(doc, kind="stable")
    doc, ranges = doc[order], ranges[order].astype(np.int32)
    starts = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]) if len(doc) else np.zeros(0, np.int64)
    edges = np.r_[starts, len(doc)]
    return pa.table({"doc_id": pa.array(doc[starts]), "told": pa.array([ranges[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:])], pa.binary())})


def repeated(rows: DataFrame, length: int) -> DataFrame:
    """Ranges of starts of repeated strings, told to their documents."""

    def run(group: pa.Table) -> pa.Table:
        packed = group.filter(pc.is_valid(group.column("at")))
        (h, doc, at), (known_doc, known_at) = unpack(packed)
        _, kind, count = np.unique(h, return_inverse=True, return_counts=True)
        again = count[kind] >= 2
        found_doc, found = [known_doc[::2], doc[again]], [known_at.reshape(-1, 2), np.stack([at[again], at[again]], 1)]
        light = group.filter(pc.is_valid(group.column("seg"))).sort_by("f")
        f = light.column("f").to_numpy()
        edges = np.flatnonzero(np.r_[True, f[1:] != f[:-1], True]) if len(f) else np.zeros(1, np.int64)
        docs, places, offs = (light.column(c).to_numpy() for c in ("doc_id", "place", "off"))
        segs = light.column("seg")
        one: list[tuple[int, int, int]] = []
        for a, b in zip(edges[:-1], edges[1:]):
            if b - a < 2:
                continue
            alike: dict[tuple[int, bytes], list[int]] = {}
            for k in range(a, b):
                alike.setdefault((int(offs[k]), segs[k].as_py()), []).append(k)
            each = list(alike.items())
            for (_, seg), ks in each:
                if len(ks) > 1:
                    one += [(int(docs[k]), int(places[k]), int(places[k]) + len(seg) - length) for k in ks]
            if len(each) > 1:
                for i, first, last in repeats([x for x, _ in each], length):
                    one += [(int(docs[k]), int(places[k]) + first, int(places[k]) + last) for k in each[i][1]]
        table = np.array(one, np.int64).reshape(-1, 3)
        return told_ranges(np.concatenate([*found_doc, table[:, 0]]), np.concatenate([*found, table[:, 1:]]))

    return rows.groupBy("bucket").applyInArrow(run, TOLD)


def dedup(docs: DataFrame, length: int = 400, width: int = 128, heavy: int = 20_000, digest: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the remaining bytes (kept), or with digest=True their SHA-256 (kept_sha256).

    A byte goes if a string of `length` bytes that covers it also starts anywhere else, in its own text too. Null text is empty.
    Rows with one id are different texts, which can repeat each other; a range told to an id holds for its rows as far as they
    reach. Rows with a null id lose nothing and repeat nothing. An empty table gives an empty result. Other columns are
    not looked at.
    """
    rows = cut(anchor_rows(docs, length, width))
    n = max(4 * tasks(docs.sparkSession), rows.count() // 100_000)  # so a bucket doesn't grow with the input
    shared = rows.groupBy("f").agg(F.count("*").alias("c")).filter("c > 1").select("f", (F.col("c") > heavy).cast("long").alias("heavy"))
    # A table of its own: it is sent to all tasks if it is small; else Spark can split a hot anchor's rows in the join.
    told = rows.join(small(cut(shared)), "f").groupBy("doc_id").agg(F.collect_list(F.col("at") * 2 + F.col("heavy")).alias("told"))
    found = repeated(surroundings(docs, told, length, width, n), length).groupBy("doc_id").agg(F.collect_list("told").alias("told"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for a, b, data, ends in bh.parts(batch.column("text")):
                for d in range(a, b):
                    own = data[ends[d - a] : ends[d - a + 1]]
                    told = batch.column("told")[d].as_py()
                    removed = spans = 0
                    if told:
                        ranges = np.frombuffer(b"".join(told), np.int32).reshape(-1, 2).astype(np.int64)
                        ranges = ranges[ranges[:, 1] + length <= len(own)]
                        mark = np.zeros(len(own) + 1, np.int64)
                        np.add.at(mark, ranges[:, 0], 1)
                        np.add.at(mark, ranges[:, 1] + length, -1)
                        gone = np.cumsum(mark)[:-1] > 0
                        removed, spans = int(gone.sum()), int((gone & ~np.r_[False, gone[:-1]]).sum())
                        rest = own[~gone].tobytes()
                    else:
                        rest = own.tobytes()
                    out.append((len(own), removed, spans, hashlib.sha256(rest).hexdigest() if digest else rest))
            cols = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in cols[:3]], pa.array(cols[3], pa.string() if digest else pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", name])

    name = "kept_sha256" if digest else "kept"
    return texts(docs).join(found, "doc_id", "left").mapInArrow(run, f"doc_id long, n_bytes long, n_removed long, n_spans long, {name} {'string' if digest else 'binary'}")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"), digest=True)
