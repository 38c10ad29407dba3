"""Near-duplicate documents: MinHash signatures, banding, signature checks, exact checks on whole shingle sets, components.

Documents with equal shingle sets form one class, of which the smallest id goes on; so copies, however many, meet only in
sums. Classes that share a band are candidates; which of them are compared, components.connected says.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docweft.llm import bytehash as bh
from docweft.llm.common import cut, most_odd, small, table
from docweft.llm.components import connected

#: At a similarity of 0.8, all bands fail with a chance of 3e-6.
BANDS, ROWS = 54, 7
#: Words of a sketch: four bits each of 64 minima, then 1,024 bits that tell how many shingles are in one set only.
AGREE, ODD = 4, 16
_rng = np.random.default_rng(5)
FACTOR = _rng.integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
SHIFT = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)
STEP = _rng.integers(0, 1 << 63, ROWS, dtype=np.uint64) | np.uint64(1)


def shingle_sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text: `width` words in a row, or all words if there are fewer; A-Z lower-cased."""
    for a, b, data, ends in bh.parts(column):
        starts, stops, first = bh.words(data, ends)
        words = bh.runs(bh.BYTE[bh.LOWER[data]], starts, stops)
        n = len(words)
        at = np.arange(max(0, n - width + 1))
        hashes = bh.runs(words, at, at + width) if len(at) else np.zeros(0, np.uint64)
        for d in range(b - a):
            lo, hi = first[d], first[d + 1]
            if hi - lo >= width:
                yield np.unique(hashes[lo : hi - width + 1])
            elif hi > lo:
                yield bh.runs(words, np.array([lo]), np.array([hi]))
            else:
                yield np.zeros(0, np.uint64)


def minima(shingles: np.ndarray) -> np.ndarray:
    """The least value of each universal hash function over the set."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(FACTOR), 0xFFFFFFFF, np.uint32)
    for k in range(0, len(x), 4096):
        np.minimum(out, (FACTOR[:, None] * x[None, k : k + 4096] + SHIFT[:, None]).min(1), out=out)
    return out


def bands(least: np.ndarray) -> np.ndarray:
    rows = least.reshape(BANDS, ROWS).astype(np.uint64)
    return bh.mix((rows * STEP).sum(1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * bh.BASE)


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n (size of the set), f1 and f2 (a 128-bit fingerprint of it), sketch (of AGREE + ODD words), bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 2000):
                part = batch.slice(k, 2000)
                n, f1, f2, sketch, keys = [], [], [], [], []
                for s in shingle_sets(part.column("text"), width):
                    n.append(len(s))
                    f1.append(s.sum(dtype=np.uint64).astype(np.int64))
                    f2.append(np.bitwise_xor.reduce(s, initial=np.uint64(0)).astype(np.int64))
                    if len(s):
                        least = minima(s)
                        four = (bh.mix(least[: AGREE * 16].astype(np.uint64)) & np.uint64(15)).astype(np.uint8)
                        odd = np.packbits((np.bincount((s >> np.uint64(8) & np.uint64(ODD * 64 - 1)).astype(np.int64), minlength=ODD * 64) & 1).astype(np.uint8))
                        sketch.append(np.concatenate([(four[::2] << 4 | four[1::2]).view(np.int64), odd.view(np.int64)]))
                        keys.append(bands(least).astype(np.int64))
                    else:
                        sketch.append(None)
                        keys.append(None)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(sketch, pa.list_(pa.int64())), pa.array(keys, pa.list_(pa.int64()))],
                    names=["doc_id", "n", "f1", "f2", "sketch", "bands"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n long, f1 long, f2 long, sketch array<bigint>, bands array<bigint>")


def sets(docs: DataFrame, width: int) -> DataFrame:
    """id, s: the shingle hashes of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 2000):
                part = batch.slice(k, 2000)
                found = pa.array([s.astype(np.int64) for s in shingle_sets(part.column("text"), width)], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column("id"), found], names=["id", "s"])

    return docs.mapInArrow(run, "id long, s array<bigint>")


def close_enough(share: tuple[int, int]):
    """Whether the sketches allow for the wanted share: enough minima agree (4.5 standard errors less than expected: a chance of 4e-6), and few enough shingles are in one set only."""
    n = AGREE * 16
    p = share[0] / share[1] * 15 / 16 + 1 / 16  # four bits agree by chance, too
    most = n - (n * p - 4.5 * (n * p * (1 - p)) ** 0.5)

    def differ(a: str, b: str, i: int) -> Column:
        x = F.col(f"{a}.s{i}").bitwiseXOR(F.col(f"{b}.s{i}"))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        return F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))

    def near(a: str, b: str) -> Column:
        k, m = F.col(f"{a}.n"), F.col(f"{b}.n")
        sizes = (F.least(k, m) * share[1]) >= (F.greatest(k, m) * share[0])
        odd = sum(F.bit_count(F.col(f"{a}.s{i}").bitwiseXOR(F.col(f"{b}.s{i}"))) for i in range(AGREE, AGREE + ODD))
        apart = (k + m) * ((share[1] - share[0]) / (share[1] + share[0]))
        return sizes & (sum(differ(a, b, i) for i in range(AGREE)) <= F.lit(int(most))) & (odd <= most_odd(apart, ODD * 64))

    return near


def verified(pairs: DataFrame, full: DataFrame, share: tuple[int, int]) -> DataFrame:
    """The pairs (u, v) whose whole sets have the wanted share in common."""
    both = pairs.join(full.select(F.col("id").alias("u"), F.col("s").alias("a")), "u").join(full.select(F.col("id").alias("v"), F.col("s").alias("b")), "v")
    enough = F.size(F.array_intersect("a", "b")) * (share[0] + share[1]) >= (F.size("a") + F.size("b")) * share[0]
    return both.filter(enough).select("u", "v")


def classes_of(docs: DataFrame, width: int = 5, share: tuple[int, int] = (80, 100)) -> DataFrame:
    """doc_id, n_shingles, component_id of each row of docs (doc_id, text; other columns are not looked at).

    Documents are linked if share[1] * |A and B| >= share[0] * |A or B|, for A and B their sets of shingles; component_id is the
    smallest doc_id that links reach. Null, empty and blank texts have no shingles and no links: they are their own component.
    Repeated rows give repeated rows; rows of one id with different texts link what each of them links, and the class of
    each row gives its component. A null id takes part in no links. An empty table gives an empty result.
    """
    rows = cut(signatures(docs, width))
    some = rows.filter("n > 0 and doc_id is not null")
    # One id stands for all documents with one set.
    groups = cut(some.groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("id")))
    reps = some.join(groups.select("f1", "f2", "n", F.col("id").alias("doc_id")), ["f1", "f2", "n", "doc_id"]).select(F.col("doc_id").alias("id"), "n", "sketch", "bands")
    dealt = reps.select("id", F.explode("bands").alias("band")).repartition("band")  # once for both uses below
    shared = dealt.groupBy("band").agg(F.min("id").alias("leader"), F.max("id").alias("last")).filter("leader < last").drop("last")
    members = cut(dealt.join(shared, "band").select("band", "id", "leader"))
    involved = cut(members.select("id").distinct())
    sketches = reps.join(involved, "id", "left_semi").dropDuplicates(["id"]).select("id", "n", *[F.col("sketch")[i].alias(f"s{i}") for i in range(AGREE + ODD)])
    members = cut(members.distinct().join(sketches, "id"))
    full = cut(sets(docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(small(involved), "id", "left_semi"), width))
    # An id with rows of different texts has one set each in `full`; links are then links of any of them.
    found = connected(members, lambda pairs: verified(pairs, full, share), close_enough(share))
    of_group = groups.join(found, "id", "left").select("f1", "f2", "n", F.coalesce("component", "id").alias("component_id"))
    placed_rows = rows.select("doc_id", "n", "f1", "f2").join(of_group, ["f1", "f2", "n"], "left")
    return placed_rows.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, width: int = 5, share: tuple[int, int] = (80, 100)) -> DataFrame:
    """The rows of docs that stand for their group: those whose id is their component's, and those without an id. Null, empty and blank texts stay; repeated rows stay or go together; all columns stay, whatever their names; an empty table gives an empty result."""
    found = classes_of(docs, width, share)
    gone = found.filter(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti")


def kept() -> Column:
    return F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classes_of(table(spark, sf_dir, "documents"), width=4)
    return found.withColumn("kept", kept())
