"""SimHash fingerprints bit by bit, and links by vantage-point trees against all pairs."""

from __future__ import annotations

import numpy as np
import pytest
import xxhash

from docweft.llm import simhash

TEXTS = [(1, None), (2, ""), (3, " \t"), (4, "One two"), (5, "one TWO"), (6, "One two three four"), (7, "one two three four"), (8, "word " * 70_000), (9, "word " * 70_001), (None, "nobody has this"), (None, "one two"), (4, "Another text of this id"), (10, "é É ß")]


def fingerprint(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode()
    words = low.split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(x, 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(rows, radius=3):
    """Components over (id, fingerprint) by all pairs."""
    up = {i: i for i, _ in rows}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    fps = np.array([f for _, f in rows], np.uint64)
    for k, (i, f) in enumerate(rows):
        for j in np.flatnonzero(np.bitwise_count(fps[:k] ^ np.uint64(f)) <= radius):
            a, b = sorted((find(i), find(rows[j][0])))
            up[b] = a
    return {i: find(i) for i, _ in rows}


def test_awkward_texts(spark):
    docs = spark.createDataFrame([(i, t, 7, "x") for i, t in TEXTS], "doc_id long, text string, fp long, id string")
    found = sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.classes_of(docs).collect()), key=str)
    rows = [(i, fingerprint(t)) for i, t in TEXTS]
    of = classes([r for r in rows if r[0] is not None])
    least = {}
    for i, f in rows:
        if i is not None:
            least[f] = min(least.get(f, i), i)
    want = [(i, f"{f:016x}", of[least[f]] if f in least else None) for i, f in rows]
    assert found == sorted(want, key=str)
    assert simhash.classes_of(docs.limit(0)).count() == 0


def test_query_on_given_documents(spark, data):
    docs = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    rows = [(i, fingerprint(t)) for i, t in docs]
    of = classes(rows)
    assert {tuple(r) for r in simhash.op12(spark, data).collect()} == {(i, f"{f:016x}", of[i]) for i, f in rows}


@pytest.mark.parametrize("shard, at_once", [(20_000, 1 << 18), (60, 64)])
def test_links_of_crowded_fingerprints(spark, monkeypatch, shard, at_once):
    """Near copies of random points at 1 to 4 bits, one dense cluster, chains, few shards and many."""
    monkeypatch.setattr(simhash, "AT_ONCE", at_once)
    rng = np.random.default_rng(1)

    def flipped(x, k):
        for b in rng.choice(64, k, replace=False):
            x ^= 1 << int(b)
        return x

    points = [int(x) for x in rng.integers(0, 1 << 64, 400, dtype=np.uint64)]
    points += [flipped(x, int(rng.integers(1, 5))) for x in points[:150]] + [flipped(points[0], int(rng.integers(1, 4))) for _ in range(300)]
    for _ in range(40):
        points.append(flipped(points[-1], 3))
    points = sorted(set(points))
    rows = list(enumerate(points))
    table = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in rows], "id long, fp long")
    links = [tuple(r) for r in simhash.near_links(table, 3, shard).collect()]
    assert all((points[u] ^ points[v]).bit_count() >= 1 for u, v in links)
    up = {i: i for i, _ in rows}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for u, v in links:
        a, b = sorted((find(u), find(v)))
        up[b] = a
    assert {i: find(i) for i, _ in rows} == classes(rows)
