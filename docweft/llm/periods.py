"""Periodic runs of words: stretches that repeat a block of words three times or more, caught as words are appended.

Words are appended one after the other, and blocks of a power of two of them are complete at every multiple of their size. A
catcher holds such a block [s, s + L). It is on duty for the words that end a string of L words at s + L to s + 2L - 1: when the
last L words are the block again, they follow it at a distance of q words (L <= q < 2L), and comparisons to the left and to the right tell how
far words q apart agree around it. If that is q words or more there is a square, and all squares of one stretch are one run. A
stretch of two periods holds a whole block of every size up to q, so none is missed; at each size only one catcher is on duty for a word.
The smallest blocks have eight words and look after all periods below 16, since a run of 24 words or more leaves room for them.

Which words are on duty for which catcher is known beforehand, so that each size is one numpy comparison over all words of a part
of the batch: the hash of the last L words with the hash of the block on duty. Sizes go up, so shorter periods are known first, and a catch inside of
a run whose period divides its own is no news.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweft.llm import bytehash as bh
from docweft.llm.common import table

#: A run has so many words at least, and so many periods.
LEAST, TIMES = 24, 3
#: The smallest blocks; they look after all periods below twice their size.
BLOCK = 8
ROWS = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


class Words:
    """Words as numbers, with hashes of their strings of each power of two."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.strings = [bh.mix(words.astype(np.uint64) + bh.BASE)]

    def grow(self) -> bool:
        """Adds the strings of twice the length, unless the words are fewer."""
        h, size = self.strings[-1], 1 << (len(self.strings) - 1)
        if len(h) <= size:
            return False
        self.strings.append(bh.mix(h[:-size] * bh.BASE + h[size:]))  # mixed, as sums of powers alone have known collisions
        return True

    def right(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How many words from x and from y on agree (x < y)."""
        return self._agree(x, y, len(self.words) - y, lambda at, done, size: at + done)

    def left(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How many words before x and before y agree (x < y)."""
        return self._agree(x, y, x, lambda at, done, size: at - done - size)

    def _agree(self, x, y, most, place):
        done = np.zeros(len(x), np.int64)
        for k in range(len(self.strings) - 1, -1, -1):
            size, h = 1 << k, self.strings[k]
            going = np.flatnonzero(done + size <= most)
            while len(going):  # once a size, but for the largest
                going = going[h[place(x[going], done[going], size)] == h[place(y[going], done[going], size)]]
                done[going] += size
                going = going[done[going] + size <= most[going]]
                if k < len(self.strings) - 1:
                    break
        return done


def runs_of(words: np.ndarray, longest: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs, by start and period: maximal stretches with that smallest period, of LEAST words and TIMES periods.

    longest: no run has more words (for many texts in a row, each with a word of its own behind it).
    """
    none = np.zeros(0, np.int64)
    found = (none, none, none)
    n = len(words)
    longest = n if longest is None else longest
    text = Words(words)
    while (2 << len(text.strings)) <= max(4 * BLOCK, longest) and text.grow():
        pass
    size = BLOCK
    while size * TIMES <= max(longest, LEAST) and n >= 2 * size:
        k = size.bit_length() - 1
        if k >= len(text.strings):
            break
        h = text.strings[k]
        blocks = np.arange(0, len(h), size)
        for first, last in ([(q, q) for q in range(1, 2 * size)] if size == BLOCK else [(size, 2 * size - 1)]):
            if first == last:
                s = blocks[: np.searchsorted(blocks, len(h) - first)]
                s = s[h[s] == h[s + first]]
                q = np.full(len(s), first, np.int64)
            else:
                end = np.arange(size, len(h))  # where a string begins that may be a block again
                duty = (end // size - 1) * size
                hit = np.flatnonzero(h[end] == h[duty])
                s, q = duty[hit], (end - duty)[hit]
            if len(s):
                found = _merged(found, _caught(text, *_news(found, s, q, size), size))
        size *= 2
    return found


def _news(found, s: np.ndarray, q: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The catches that don't lie in a run whose period divides theirs. Of the runs that begin at or before s, the one that ends last is the only one that can hold so long a stretch."""
    start, end, period = found
    if not len(start):
        return s, q
    last = np.maximum.accumulate(end)
    which = np.maximum.accumulate(np.where(end == last, np.arange(len(end)), 0))
    at = np.searchsorted(start, s, "right") - 1
    run = which[np.maximum(at, 0)]
    old = (at >= 0) & (end[run] >= s + q + size) & (q % period[run] == 0)
    return s[~old], q[~old]


def _caught(text: Words, s: np.ndarray, q: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The runs around blocks [s, s + size) that come again q words later."""
    left = text.left(s, s + q)
    right = size + text.right(s + size, s + size + q)
    start, length = s - left, left + right + q
    good = length >= np.maximum(LEAST, TIMES * q)
    return start[good], start[good] + length[good], q[good]


def _merged(found, new):
    start, end, period = (np.concatenate(x) for x in zip(found, new))
    order = np.lexsort((period, start))
    start, end, period = start[order], end[order], period[order]
    first = np.r_[True, (start[1:] != start[:-1]) | (period[1:] != period[:-1])] if len(start) else np.zeros(0, bool)
    return start[first], end[first], period[first]


def collapsed(n: int, start: np.ndarray, end: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Which of n words stay: those that no run holds behind its first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, start + period, 1)
    np.add.at(change, end, -1)
    return np.cumsum(change[:n]) == 0


def planted(words: list, seed: int) -> list:
    """The words of a text, in the tenth of the texts whose seed says so with a period from some place on."""
    g, n = seed // 10, len(words)
    if seed % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def find_runs(docs: DataFrame, text: str = "text", seed: str | None = None) -> DataFrame:
    """docs with n_runs, start, length, period and exponent_milli of the run with the greatest length / period (ties: smallest start, then period), and digests
    of all runs and of the words that stay, in place of columns of these names; other columns stay.

    runs: every run's `start,length,period` and LF, by start and period. collapsed: the kept words, joined by one space. A null, empty
    or blank text has no words and no runs: n_runs is 0, the run's columns are null, both digests are those of an empty
    string. seed names a column of numbers by which texts are given a period first (see planted; null: none). Repeated rows give repeated rows, an
    empty table an empty result. One pass without a shuffle; a task holds about 1 MB of texts, or one longer text.
    """
    return _mapped(docs, text, seed, False)


def collapse_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs as from find_runs with one more column, collapsed: the words that stay, joined by one space."""
    return _mapped(docs, text, None, True)


def _mapped(docs: DataFrame, text: str, seed: str | None, texts: bool) -> DataFrame:
    more = [c.split() for c in (ROWS + (", collapsed string" if texts else "")).split(", ")]
    names = {name for name, _ in more}
    keep = [c for c in docs.columns if c.lower() not in names]
    at = keep.index(text)
    by = keep.index(seed) if seed else None
    schema = docs.select(*keep).schema
    for name, kind in more:
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seeds = batch.column(by).to_pylist() if by is not None else [None] * batch.num_rows
            for a, b, data, ends in bh.parts(batch.column(at)):
                yield pa.RecordBatch.from_arrays([c.slice(a, b - a) for c in batch.columns] + described(data, ends, seeds[a:b], texts), names=schema.names)

    return docs.select(*keep).mapInArrow(run, schema)


def described(data: np.ndarray, ends: np.ndarray, seeds: list, texts: bool) -> list[pa.Array]:
    """The columns of ROWS for the texts of a part of a batch."""
    known: dict[bytes, int] = {}
    lists, numbers, sizes = [], [], []
    for a, b, seed in zip(ends[:-1], ends[1:], seeds):
        words = data[a:b].tobytes().split()  # at the six ASCII white-space characters
        if seed is not None:
            words = planted(words, seed)
        lists.append(words)
        sizes.append(len(words))
        numbers.extend([known.setdefault(w, len(known)) for w in words])
        numbers.append(-len(lists))  # a word of its own behind each text
    first = np.concatenate([[0], np.cumsum(np.array(sizes, np.int64) + 1)])
    start, end, period = runs_of(np.array(numbers, np.int64), max(sizes, default=0))
    cut = np.searchsorted(start, first)
    out: list[list] = [[] for _ in range(8)]
    for d, words in enumerate(lists):
        lo, hi = cut[d], cut[d + 1]
        s, e, q = start[lo:hi] - first[d], end[lo:hi] - first[d], period[lo:hi]
        told = "".join(f"{x},{y - x},{z}\n" for x, y, z in zip(s.tolist(), e.tolist(), q.tolist()))
        if hi > lo:
            best = max(range(hi - lo), key=_by_exponent(s.tolist(), e.tolist(), q.tolist()))
            size = int(e[best] - s[best])
            row = [int(s[best]), size, int(q[best]), 1000 * size // int(q[best])]
            words = [words[i] for i in np.flatnonzero(collapsed(len(words), s, e, q)).tolist()]
        else:
            row = [None] * 4
        kept = b" ".join(words)
        for column, value in zip(out, [int(hi - lo), *row, hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(kept).hexdigest(), kept.decode() if texts else ""]):
            column.append(value)
    kinds = [pa.int64()] * 5 + [pa.string()] * 3
    return [pa.array(c, t) for c, t in zip(out, kinds)][: 8 if texts else 7]


def _by_exponent(start: list, end: list, period: list):
    return lambda i: (Fraction(end[i] - start[i], period[i]), -start[i], -period[i])


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.crc32(F.col("doc_id").cast("string")).alias("seed"))
    return find_runs(docs, seed="seed").drop("text", "seed")
