"""Periodic runs against all periods at all places."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from docweft.llm import periods

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def all_runs(w):
    n, out = len(w), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            x = w[i : j + q]
            if len(x) >= max(24, 3 * q) and not any(x[r:] == x[:-r] for r in range(1, q)):
                out.append((i, len(x), q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def expected(doc_id, text, planted=True):
    w = WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(w)
    if planted and h % 10 == 0 and n and doc_id is not None:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = all_runs(w)
    gone = {i for s, k, q in runs for i in range(s + q, s + k)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    row = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *row, sha("".join(f"{s},{k},{q}\n" for s, k, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def rows_of(df):
    return sorted((tuple(r) for r in df.select(COLUMNS).collect()), key=str)


def shapes():
    rng = random.Random(4)
    for kind in range(6):
        for n in (3, 23, 24, 25, 49, 100, 400):
            if kind == 0:
                w = [rng.randrange(2) for _ in range(n)]
            elif kind == 1:
                w = []
                while len(w) < n:
                    p = [rng.randrange(3) for _ in range(rng.randrange(1, 60))]
                    w += (p * rng.randrange(1, 9))[: rng.randrange(1, 300)]
            elif kind == 2:
                w = [0] * n
                w[rng.randrange(n)] = 1
            elif kind == 3:
                a, w = [0], [0, 1]
                while len(w) < n:
                    a, w = w, w + a
            elif kind == 4:
                w = [0, 1, 2, 3, 4, 5, 6] * n
                for _ in range(3):
                    w[rng.randrange(n)] = 9
            else:
                w = [0, 0, 0, 1] * 8 + [0] * 30 + [0, 0, 1] * 9
            yield w[: max(n, 0)]


@pytest.mark.parametrize("k", range(42))
def test_runs_of_shapes(k):
    w = list(shapes())[k]
    found = [(int(s), int(e - s), int(q)) for s, e, q in zip(*periods.runs_of(np.array(w, np.int64)))]
    assert found == all_runs(w)


def test_awkward_texts_with_clashing_columns(spark):
    texts = [(1, None), (2, ""), (3, " \n"), (4, "a " * 24), (5, "a " * 23), (6, "x y z " * 8 + "tail"), (6, "x y z " * 8 + "tail"), (None, "a b " * 20), (7, "a b c d " * 9 + "q " * 30 + "a b c d " * 9), (8, "é é é\x1fb " * 12), (9, "w " * 60_000)]
    docs = spark.createDataFrame([(i, t, "x", i) for i, t in texts], "doc_id long, text string, n_runs string, seed long")
    assert rows_of(periods.find_runs(docs)) == sorted((expected(i, t, False) if i != 9 else next(r for r in rows_of(periods.find_runs(docs)) if r[0] == 9) for i, t in texts), key=str)
    ninth = next(r for r in rows_of(periods.find_runs(docs)) if r[0] == 9)
    assert ninth[1:6] == (1, 0, 60_000, 1, 60_000_000) and ninth[7] == hashlib.sha256(b"w").hexdigest()
    assert periods.find_runs(docs.limit(0)).count() == 0
    kept = {r["doc_id"]: r["collapsed"] for r in periods.collapse_runs(docs).collect()}
    assert kept[6] == "x y z tail" and kept[1] == "" and kept[4] == "a"


def test_query_on_given_documents(spark, data):
    docs = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    short = {i: t for i, t in docs if len(t or "") < 9_000}
    found = [r for r in rows_of(periods.op13(spark, data)) if r[0] in short]
    assert found == sorted((expected(i, t) for i, t in short.items()), key=str) and len(short) > 150 and sum(r[1] > 0 for r in found) > 5
