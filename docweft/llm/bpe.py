"""Encoding texts with a given byte-pair vocabulary, and decoding them again.

The vocabulary file (a `tokenizers` JSON with a BPE model, byte-level symbols and an end-of-word suffix) is a parameter;
nothing is trained here. Its text is read on the driver and broadcast (1.7 MB, whatever the corpus). A text goes through
the file's steps: strings of special tokens are cut out of the raw text; the rest is put in NFC and lower case and split
by the file's pattern into words; each word's UTF-8 bytes become symbols, the last one with the end-of-word suffix; and
merges are applied, lowest rank first, leftmost first.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from docweft.llm.common import table

#: Words with more symbols than this are merged with a heap: the repeated scan is quadratic in a word's length.
LONG_WORD = 256
#: Encodings of so many words are kept by each Python worker; beyond that it starts anew.
CACHE = 150_000

#: Ranges that Python's tables take for letters and numbers and the library's don't.
NOT_LETTERS = (
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F), (0xA7CE, 0xA7CF),
    (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF),
    (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB), (0x11DF1, 0x11DF1), (0x16EA0, 0x16EB8),
    (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF3), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2), (0x18E00, 0x19191),
    (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96),
    (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF),
    (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
)
NOT_NUMBERS = ((0x11DE0, 0x11DE9), (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686), (0x16FF4, 0x16FF6))
#: Upper-case characters that only the library's tables have: first, last, lower case of the first.
UPPER = (
    (0x1C89, 0x1C89, 0x1C8A), (0xA7CB, 0xA7CB, 0x264), (0xA7CC, 0xA7CC, 0xA7CD), (0xA7CE, 0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2, 0xA7D3), (0xA7D4, 0xA7D4, 0xA7D5),
    (0xA7DA, 0xA7DA, 0xA7DB), (0xA7DC, 0xA7DC, 0x19B), (0x10D50, 0x10D65, 0x10D70), (0x16EA0, 0x16EB8, 0x16EBB),
)
LOWER = {c: to + c - a for a, b, to in UPPER for c in range(a, b + 1)}


def one_of(ranges: tuple) -> str:
    """A set of characters for patterns."""
    return "[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges) + "]"


RARE = regex.compile("|".join(map(one_of, (NOT_LETTERS, NOT_NUMBERS, tuple(u[:2] for u in UPPER)))))


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself if printable in Latin-1, else the next one from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = {b: chr(b) for b in shown}, 256
    for b in range(256):
        if b not in out:
            out[b] = chr(extra)
            extra += 1
    return [out[b] for b in range(256)]


Encoded = tuple[str, str, int, list[int]]


class Vocabulary:
    def __init__(self, text: str):
        spec = json.loads(text)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.special.items()}
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"])
        # For texts with rare characters: letters and numbers as the library has them.
        less = split["pattern"]["Regex"].replace(r"\p{L}", rf"[\p{{L}}--{one_of(NOT_LETTERS)}]").replace(r"\p{N}", rf"[\p{{N}}--{one_of(NOT_NUMBERS)}]")
        self.rare_words = regex.compile(less, regex.V1)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        # (left id << 32 | right id) -> rank; rank -> merged id
        self.rank: dict[int, int] = {}
        self.merged: list[int] = []
        for k, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.rank.setdefault(self.ids[left] << 32 | self.ids[right], k)
            self.merged.append(self.ids[left + right])
        inner = byte_symbols()
        self.inner = [self.ids[s] for s in inner]
        self.last = [self.ids[s + self.suffix] for s in inner]
        self.cache: dict[str, Encoded] = {}

    def merge(self, word: str) -> list[int]:
        """The ids of one word. `bounds` holds where its parts begin, `ids` the parts, `ranks` those of adjacent parts."""
        raw = word.encode()
        ids = [self.inner[b] for b in raw[:-1]]
        ids.append(self.last[raw[-1]])
        if len(ids) > LONG_WORD:
            return self.merge_long(ids)
        none, rank = len(self.merged), self.rank.get
        bounds = list(range(len(ids) + 1))
        ranks = [rank(a << 32 | b, none) for a, b in zip(ids, ids[1:])]
        while ranks:
            least = min(ranks)
            if least == none:
                break
            i = ranks.index(least)
            del bounds[i + 1], ids[i + 1], ranks[i]
            ids[i] = self.merged[least]
            if i:
                ranks[i - 1] = rank(ids[i - 1] << 32 | ids[i], none)
            if i < len(ranks):
                ranks[i] = rank(ids[i] << 32 | ids[i + 1], none)
        return ids

    def merge_long(self, ids: list[int]) -> list[int]:
        """The same result in n log n steps: pairs wait in a heap by rank and place, parts are a linked list."""
        n, rank = len(ids), self.rank.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := rank(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i] if ids[i] >= 0 else n
            if j >= n or rank(ids[i] << 32 | ids[j]) != r:
                continue  # one of the two parts has changed meanwhile
            ids[i], ids[j], after[i] = self.merged[r], -1, after[j]
            if after[i] < n:
                before[after[i]] = i
                if (s := rank(ids[i] << 32 | ids[after[i]])) is not None:
                    heapq.heappush(heap, (s, i))
            if (h := before[i]) >= 0 and (s := rank(ids[h] << 32 | ids[i])) is not None:
                heapq.heappush(heap, (s, h))
        return [x for x in ids if x >= 0]

    def word(self, word: str) -> Encoded:
        """A word's ids and tokens, each joined by spaces, how many there are, and the ids."""
        ids = self.merge(word)
        found = (" ".join(map(str, ids)), " ".join([self.tokens[i] for i in ids]), len(ids), ids)
        if len(self.cache) >= CACHE:
            self.cache.clear()
        self.cache[word] = found
        return found

    def encode(self, text: str) -> list[Encoded]:
        out: list[Encoded] = []
        get, word = self.cache.get, self.word
        for part in self.cut.split(text) if "<|" in text else (text,):
            if (i := self.special.get(part)) is not None:
                out.append((str(i), part, 1, [i]))
            elif part:
                plain = unicodedata.normalize("NFC", part)
                rare = not part.isascii() and RARE.search(plain)
                plain = (plain.translate(LOWER) if rare else plain).replace("Σ", "σ").lower()  # sigma: each character by itself
                out += [get(w) or word(w) for w in (self.rare_words if rare else self.words).findall(plain)]
        return out

    def decode(self, ids: list[int]) -> str:
        return " ".join([self.tokens[i] for i in ids])


def _broadcast(spark: SparkSession, path: str):
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, vocabulary: str, decoded: bool = False) -> DataFrame:
    """doc_id and ids (array<int>) of every text, and with decoded=True the decoded text too. Null or empty: no ids.

    One row for each row of docs, repeated rows and null ids included, so an empty table gives an empty result; other columns are not looked at.
    """
    held = _broadcast(docs.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = Vocabulary(held.value)
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                found = [voc.encode(t or "") for t in part.column("text").to_pylist()]
                ids = pa.array([[i for w in x for i in w[3]] for x in found], pa.list_(pa.int32()))
                cols = [part.column("doc_id"), ids] + ([pa.array([" ".join([w[1] for w in x]) for x in found], pa.string())] if decoded else [])
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "ids", "decoded"][: len(cols)])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>" + ", decoded string" * decoded)


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id and decoded text of (doc_id, ids): tokens joined by one space, special tokens kept. Null ids: empty."""
    held = _broadcast(encoded.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = Vocabulary(held.value)
        for batch in batches:
            texts = pa.array([voc.decode(ids or []) for ids in batch.column("ids").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), texts], names=["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded string")


def digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Like encode, but instead of ids and decoded text their number and SHA-256 digests; a null or empty text has 0 ids and the digests of an empty string."""
    held = _broadcast(docs.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = Vocabulary(held.value)
        for batch in batches:
            counts, ids, texts = [], [], []
            for t in batch.column("text"):
                found = voc.encode(t.as_py() or "")
                counts.append(sum([w[2] for w in found]))
                ids.append(hashlib.sha256(" ".join([w[0] for w in found]).encode()).hexdigest())
                texts.append(hashlib.sha256(" ".join([w[1] for w in found]).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids), pa.array(texts)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
