"""SimHash near-duplicates: fingerprints partitioned by Hamming distances from vantage points, exact pairs within a radius, components.

Documents with one fingerprint are one point, of which the smallest doc_id goes on, so copies meet only in a sum. A level of the
vantage-point tree looks at one byte of the fingerprints: a point's branch is its distance there from the vantage point. Distances of
the bytes add up, so the triangle bounds of the levels do, too: a branch that is g away from a point's own costs g of its radius, and what would cost
more than the radius is pruned.

The upper levels have one vantage point each, chosen from a bounded sample for the widest spread; as many levels are used as keep the largest
shard, as the sample shows it, below SHARD points. A point lives in the shard of its own distances and visits those in reach, that is those at the
boundary of its own; of two shards that reach each other, only the points of the first visit the second. In a shard, the tree
goes on over the other bytes with vantage points of its own, until a node's points and visitors can be compared one by one. Of the pairs found in a shard only
as many links go out as connect its points.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweft.llm import bytehash as bh
from docweft.llm.common import cut, table
from docweft.llm.components import components

WIDTH, RADIUS = 3, 3
#: Points in the largest shard; points in the sample that vantage points are chosen from; pairs that are compared at once.
SHARD, SAMPLE, AT_ONCE = 20_000, 2_000, 1 << 18
#: Shingles of one text that are hashed at once.
PIECE = 1 << 15


def fingerprint(text: bytes, width: int = WIDTH) -> int:
    """The bits that are set in over half of the hashes of the text's shingles, repeats included; A-Z lower-cased. Without words: zero."""
    words = text.lower().split()  # bytes: A-Z and the six ASCII white-space characters only
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    count = np.zeros(64, np.int64)
    for a in range(0, n, PIECE):
        part = words[a : a + PIECE + width - 1] if n > 1 else words
        shingles = map(b" ".join, zip(*(part[i:] for i in range(width)))) if len(words) >= width else [b" ".join(words)]
        h = np.fromiter((xxhash.xxh64_intdigest(x, 42) for x in shingles), np.uint64)
        count += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * count > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, fp of each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for a, b, data, ends in bh.parts(batch.column("text")):
                out.extend(fingerprint(data[ends[i] : ends[i + 1]].tobytes(), width) for i in range(b - a))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.array(out, np.uint64).view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def bytes_of(fp: np.ndarray) -> np.ndarray:
    """The eight bytes of each fingerprint, as columns."""
    return np.ascontiguousarray(fp).view(np.uint8).reshape(-1, 8)


def upper_levels(sample: np.ndarray, n: int, shard: int = SHARD) -> list[tuple[int, int]]:
    """(byte, vantage) of the upper levels for n points: bytes in order of how evenly distances from their vantage point are spread, two levels at least."""
    found = []
    for k in range(8):
        own = bytes_of(sample)[:, k]
        counts = np.array([np.bincount(np.bitwise_count(own ^ np.uint8(v)), minlength=9) for v in range(256)])
        squares = (counts.astype(float) ** 2).sum(1)
        found.append((squares.min(), k, int(squares.argmin())))
    levels = [(k, v) for _, k, v in sorted(found)]
    for used in range(2, 9):
        most = np.unique(shards_of(sample, levels[:used]), return_counts=True)[1].max(initial=0)
        if used == 8 or most * n <= shard * max(1, len(sample)):
            return levels[:used]


def shards_of(fp: np.ndarray, levels: list[tuple[int, int]]) -> np.ndarray:
    code = np.zeros(len(fp), np.int64)
    for k, v in levels:
        code = code * 9 + np.bitwise_count(bytes_of(fp)[:, k] ^ np.uint8(v))
    return code


def visits(points: DataFrame, levels: list[tuple[int, int]], radius: int) -> DataFrame:
    """(shard, fp, id, left): each point in its own shard (left is null there), and in each later one in reach, with what is left of the radius."""
    steps = np.array([s for s in itertools.product(range(-radius, radius + 1), repeat=len(levels)) if sum(map(abs, s)) <= radius and s >= (0,) * len(levels)], np.int64).reshape(-1, len(levels))
    weight = 9 ** np.arange(len(levels) - 1, -1, -1, dtype=np.int64)
    left = radius - np.abs(steps).sum(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 1000):
                batch = whole.slice(a, 1000)
                fp, ids = batch.column("fp").to_numpy(), batch.column("id").to_numpy()
                d = np.stack([np.bitwise_count(bytes_of(fp)[:, k] ^ np.uint8(v)) for k, v in levels], 1).astype(np.int64)
                to = d[:, None, :] + steps[None]
                row, step = np.nonzero(((to >= 0) & (to <= 8)).all(2))
                shard = (to[row, step] * weight).sum(1)
                own = ~steps[step].any(1)
                yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(fp[row]), pa.array(ids[row]), pa.array(left[step].astype(np.int32), mask=own)], names=["shard", "fp", "id", "left"])

    return points.mapInArrow(run, "shard long, fp long, id long, left int")


class Links:
    """Which of n points are connected; pairs are taken in heaps."""

    def __init__(self, n: int):
        self.root = np.arange(n)
        self.heap: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, u: np.ndarray, v: np.ndarray) -> None:
        self.heap.append((u, v))
        self.held += len(u)
        if self.held > AT_ONCE:
            self.settle()

    def settle(self) -> None:
        if not self.heap:
            return
        u, v = (np.concatenate(x) for x in zip(*self.heap))
        self.heap, self.held = [], 0
        while True:
            a, b = self.root[u], self.root[v]
            apart = a != b
            if not apart.any():
                return
            u, v, a, b = u[apart], v[apart], a[apart], b[apart]
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
            while (further := self.root[self.root]).tobytes() != self.root.tobytes():
                self.root = further


def connect(fp: np.ndarray, left: np.ndarray, home: np.ndarray, order: list[int], radius: int) -> np.ndarray:
    """For each point the least place among those that it is connected with, by pairs of points of which one is at home here.

    left: what the levels above have left of a point's radius; order: the bytes that they haven't looked at.
    """
    links = Links(len(fp))
    parts = bytes_of(fp)
    whole = fp.view(np.uint64)

    def node(data: np.ndarray, others: np.ndarray, rest: np.ndarray, level: int) -> None:
        if not len(data) or not len(others):
            return
        label = links.root[data[0]]
        if (links.root[data] == label).all() and (links.root[others] == label).all():
            return  # all are connected already
        if level == len(order) or len(data) * len(others) <= AT_ONCE:
            step = max(1, AT_ONCE // len(others))
            for a in range(0, len(data), step):
                u, v = np.nonzero(np.bitwise_count(whole[data[a : a + step], None] ^ whole[None, others]) <= radius)
                links.add(data[a + u], others[v])
            return
        vantage = data[len(data) // 2]
        for group in (data, others):  # what is in reach of the vantage point needs no pairs among itself
            close = group[np.bitwise_count(whole[group] ^ whole[vantage]) <= radius]
            links.add(np.full(len(close), vantage), close)
        if links.held > len(data) // 8:
            links.settle()
        own, far = (np.bitwise_count(parts[x, order[level]] ^ parts[vantage, order[level]]).astype(np.int64) for x in (data, others))
        for d in np.unique(own):
            after = rest - np.abs(far - d)
            reach = after >= 0
            node(data[own == d], others[reach], after[reach], level + 1)

    node(np.flatnonzero(home), np.arange(len(fp)), left, 0)
    links.settle()
    return links.root


def near_links(points: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """(u, v): links that connect what fingerprints within `radius` connect. points: fp (each once), id.

    Every such pair meets in one shard: that of one of the two, which the other visits.
    """
    n = points.count()
    sample = np.array([r[0] for r in points.select("fp").orderBy(F.xxhash64("fp")).limit(SAMPLE).collect()], np.int64)
    levels = upper_levels(sample, n, shard)
    order = [k for k in range(8) if k not in {b for b, _ in levels}]

    def run(rows: pa.Table) -> pa.Table:
        fp, ids = (rows.column(c).to_numpy() for c in ("fp", "id"))
        left = rows.column("left").fill_null(-1).to_numpy().astype(np.int64)
        home = left < 0
        root = connect(fp, np.where(home, radius, left), home, order, radius) if home.any() else np.arange(len(fp))
        far = np.flatnonzero(root != np.arange(len(fp)))
        return pa.table({"u": ids[far], "v": ids[root[far]]})

    return visits(points, levels, radius).groupBy("shard").applyInArrow(run, "u long, v long")


def classes_of(docs: DataFrame, width: int = WIDTH, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits), component_id of each row of docs (doc_id, text; other columns are not looked at).

    Fingerprints with `radius` or fewer differing bits link their documents; component_id is the smallest doc_id that links reach.
    Null, empty and blank texts have fingerprint zero and are linked like any other. Rows that repeat an id with other texts link what
    each of them links. A row without an id links nothing; its component is that of the others with its fingerprint, null if there
    are none. An empty table gives an empty result.
    """
    rows = cut(fingerprints(docs, width))
    points = cut(rows.filter("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("id")))
    found = components(cut(near_links(points, radius)))
    of = points.join(found, "id", "left").select("fp", F.coalesce("component", "id").alias("component_id"))
    return rows.join(of, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes_of(table(spark, sf_dir, "documents"))
