"""Each operator against brute force, on the small tables and on awkward rows."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from docweft.llm import bpe, extraction, lines, mixing, neardup, quality, queries, substrings, suffixes, topk, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i * i % 977}" for i in range(30_000))
#: Nulls, empty and blank texts, ties, repeated rows, a very long text, copies that differ a little.
TEXTS = [
    (1, None, "en", None, "x"),
    (2, "", "en", "a", "x"),
    (3, " \t\n", None, "a", "x"),
    (4, "one two", "de", "b", "x"),
    (5, "one two", "de", "b", "x"),
    (6, "one two", "de", "b", "x"),
    (7, "one two", "de", "b", "x"),
    (8, LONG, "en", "b", "x"),
    (9, LONG + " tail", "en", "c", "x"),
    (10, "\n".join(["same line again and again, with some words in it"] * 30), "en", "c", "x"),
    (11, "é" * 900 + "\n" + "é" * 900, "fr", "a", "x"),
    (None, "no id at all in this row, but words", "fr", "a", "x"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, lang, src, len(t or ""), x, x) for i, t, lang, src, x in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _id string, id string")


@pytest.fixture(scope="module")
def documents(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


def words(t):
    return WORD.findall(t or "")


class Sets:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = sorted((self.find(a), self.find(b)))
        self.up[b] = a


def similar(sets: dict):
    """Pairs of keys whose sets have 0.8 of their union in common."""
    held: dict = {}
    for k, s in sets.items():
        shared = Counter(o for x in s for o in held.get(x, ()))
        for o, c in shared.items():
            if 100 * c >= 80 * (len(s) + len(sets[o]) - c):
                yield o, k
        for x in s:
            held.setdefault(x, []).append(k)


# op1


def test_extraction_tree_fits_its_table(spark):
    nodes = extraction.train(spark)
    assert all(extraction.predict(nodes, x) == b[3] for page in extraction.LABELLED for b, x in zip(page, extraction.features([b[:3] for b in page])))


def test_extraction_keeps_the_article_only(spark):
    page = """<html><head><title>T</title><style>p{}</style></head><body class="menu"><header><p>Site slogan of some words</p></header>
    <div id="cookie-notice">We use cookies, many of them, please say yes to all of them.</div><nav><a href=x>Home</a></nav>
    <main><article><h1>Real &amp; title</h1><p>Text with <a href="a>b">a link</a>,&nbsp;caf&eacute;<br>and <b>more.<p>Short.
    <div class="adBox"><p>Buy this very nice product today, it is cheap.</p></div><form><label>Name</label></form><script>if(a<b){x="</p>"}</script>
    <p>Last.</article><section id=comments><p>Nice article, I liked it very much.</p></section></main><footer>&copy; me</footer>"""
    rows = spark.createDataFrame([(1, "u", page), (2, "u", None), (3, None, ""), (4, "u", "<p>"), (4, "u", "<p>"), (5, "u", "<!-- never closed <p>x")], "page_id long, url string, html string")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in extraction.extract(rows).collect()}
    want = "Real & title\nText with a link, café and more.\nShort.\nLast."
    assert got == {1: (want, len(want)), 2: ("", 0), 3: ("", 0), 4: ("", 0), 5: ("", 0)}
    assert extraction.extract(rows.limit(0)).count() == 0


CASES = [
    ('<article><h1>T</h1><p>One two.</p><p class="advert">Buy this now and save.</p><p>Three four.</p></article>', "T\nOne two.\nThree four."),
    ('<main><article><h1>T</h1><p>One two three.</p></article><article class="comment"><p>I liked this a lot, thank you.</p></article></main>', "T\nOne two three."),
    ('<article><h1>T</h1><p>One two three.</p><h3 class="related">More like this</h3></article>', "T\nOne two three."),
    ('<article><h1>T</h1><section class="side-effects"><p>They are mild and pass soon.</p></section></article>', "T\nThey are mild and pass soon."),
    ('<article><h1>T</h1><section id="menu-history"><p>The first menus were tables.</p></section></article>', "T\nThe first menus were tables."),
    ('<article><h1>T</h1><div class="share-of-wealth"><p>A tenth owns half.</p></div></article>', "T\nA tenth owns half."),
    ('<article><h1>T</h1><section class="copyright-law"><p>The law of 1909.</p></section></article>', "T\nThe law of 1909."),
    ('<body><header class="site-header"><a href="/">Home</a></header><article><h1>T</h1><p>One two three.</p><ul class="comment-list"><li>Nice one!</li></ul></article></body>', "T\nOne two three."),
]


def test_extraction_of_marks_and_of_names_that_only_hold_one(spark):
    pages = spark.createDataFrame([(i, "u", h) for i, (h, _) in enumerate(CASES)], "page_id long, url string, html string")
    got = [r["text"] for r in extraction.extract(pages).orderBy("page_id").collect()]
    assert got == [w for _, w in CASES]


def test_extraction_of_a_very_long_page_with_clashing_columns(spark):
    html = "<nav><a href='/'>Home</a></nav><article><h1>T</h1>" + "<p>One two three four five.</p>" * 50_000 + "</article>"
    pages = spark.createDataFrame([(1, "u", html, "x", 7), (1, "u", html, "x", 7), (2, None, None, None, None)], "page_id long, url string, html string, text string, n_chars long")
    got = sorted((r["page_id"], r["n_chars"]) for r in extraction.extract(pages).collect())
    n = 1 + 50_000 * (1 + len("One two three four five."))
    assert got == [(1, n), (1, n), (2, 0)]


def test_extraction_of_pages_that_were_not_labelled(spark):
    """The article of each given page, less five that are in the labelled table, by a plain reading of its markup."""
    import html
    import re

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").filter("page_id not in (1, 3, 4, 5, 6)")
    rows = {r["page_id"]: r["html"] for r in pages.collect()}
    got = {r["page_id"]: r["text"] for r in extraction.extract(pages).collect()}

    def article(page):
        inside = re.search(r"<article>(.*)</article>", page, re.S)
        parts = re.split(r"</?(?:p|h1)>", inside[1]) if inside else []
        texts = [" ".join(html.unescape(re.sub(r"<[^>]+>", " " if "br" in x else "", re.sub("<br>", " ", x))).split()) for x in parts]
        return "\n".join(x for x in texts if x)

    same = sum(got[i] == article(page) for i, page in rows.items() if page)
    assert same >= 0.95 * sum(bool(page) for page in rows.values()), same


# op2


def brute_lines(rows):
    up = str.maketrans({**{chr(c): chr(c + 32) for c in range(65, 91)}, **dict.fromkeys("\t\x0b\f\r", " ")})
    places: dict = {}
    for i, t in rows:
        for k, x in enumerate((t or "").split("\n")):
            if i is not None and (x := x.translate(up).strip(" ")):
                places.setdefault(x, []).append((i, k))
    groups = Sets()
    for a, b in similar({x: {x[i : i + 5] for i in range(max(1, len(x) - 4))} for x in places}):
        groups.join(a, b)
    first: dict = {}
    for x, at in places.items():
        first[groups.find(x)] = min([*at, first.get(groups.find(x), at[0])])
    gone = {p for x, at in places.items() for p in at if p != first[groups.find(x)]}
    return sorted((str(i), "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone) if t is not None else None) for i, t in rows)


@pytest.mark.parametrize("which", ["docs", "documents"])
def test_lines(request, which):
    table = request.getfixturevalue(which).filter("doc_id is null or doc_id not in (8, 9)")
    got = lines.dedup_lines(table)
    assert got.columns[: len(table.columns)] == table.columns
    rows = [(r["doc_id"], r["text"]) for r in table.collect()]
    key = lambda x: (x[0], x[1] or "")
    assert sorted(((str(r["doc_id"]), r["text"]) for r in got.collect()), key=key) == sorted(brute_lines(rows), key=key)


def test_lines_of_all_lengths_and_scripts(spark):
    made = lambda k, n, letters: "".join(letters[int(hashlib.md5(f"{k}-{i}".encode()).hexdigest(), 16) % len(letters)] for i in range(n)).strip().ljust(n, "q")
    latin, han = "abcdefghijklmnopqrstuvwxyz      ", [chr(0x4E00 + i) for i in range(900)]
    texts = []
    for k in range(40):
        short, dense = made(k, 78, latin), made(k, 300, han)
        texts += [short, short + " abc", dense, "\u4e8c" + dense, dense + "\u4e8c" * 3]  # across 80 characters; long ones without spaces
    rows = list(enumerate([*texts, "abc", "abd", "ABC "]))
    got = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((str(r["doc_id"]), r["text"]) for r in got.collect()) == brute_lines(rows)
    assert sum(1 for _, t in brute_lines(rows) if t == "") == 40 * 3 + 1


# op3


def test_topk_against_sql_and_awkward_vectors(spark, data):
    rows = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, None), (4, [float("nan"), 1.0]), (50, [-1.0, 0.5]), (51, [1.0]), (0, [1.0, 2.0]), (None, [1.0, 1.0]), (52, [])]
    table = spark.createDataFrame(rows, "id long, e array<float>").select("id", topk.whole_numbers(F.col("e")).alias("v"))
    got = [tuple(r) for r in topk.search(table.filter("id % 50 = 0"), table, k=2).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 327680), (0, 2, 2, 327680), (50, 1, 0, 0), (50, 2, 1, 0)]
    assert topk.search(table.limit(0), table).count() == 0


# op4


def test_toxicity_learns_words_of_the_labels(spark):
    import random

    rnd = random.Random(3)
    clean = ["stone", "river", "green", "walks", "house", "under", "seven"]
    rows = [(i, " ".join(rnd.choices(clean, k=30) + ["vilegrump"] * (i % 3 == 0)), i % 3 == 0) for i in range(240)]
    table = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(1000, None), (1001, ""), (1001, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(x)) for i, _, x in rows] + [(5000, 1), (2, None)], "doc_id long, toxic int")
    model = toxicity.fit(table, labels)
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score(table, model).collect()}
    assert all(got[i] == int(x) for i, _, x in rows) and got[1000] == got[1001] == 0
    assert toxicity.clean(table, model).count() == sum(not x for _, _, x in rows) + 3
    none = toxicity.fit(table, labels.limit(0))
    assert {r["predicted"] for r in toxicity.score(table, none).collect()} == {0}


def test_toxicity_on_held_out_documents(spark):
    data = "/root/testdata/sf0.01"
    got = toxicity.op4(spark, data).join(spark.read.parquet(f"{data}/labels.parquet"), "doc_id").filter("held_out").toPandas()
    assert ((got["score"] >= 0.3) == (got["predicted"] == 1)).all()
    assert (got["predicted"] == got["toxic"]).mean() > 0.9 and got["predicted"][got["toxic"] == 1].mean() > 0.5


# op5


@pytest.mark.parametrize(("which", "width"), [("docs", 4), ("documents", 4), ("documents", 5)])
def test_near_duplicates(request, which, width):
    rows = [(r["doc_id"], r["text"]) for r in request.getfixturevalue(which).collect()]
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = {}
    for i, t in rows:
        w = words((t or "").translate(lower))
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} - {()}
    groups = Sets()
    for a, b in similar({i: s for i, s in sets.items() if i is not None}):
        groups.join(a, b)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.classes_of(request.getfixturevalue(which), width).collect()}
    assert got == {i: (len(s), groups.find(i)) for i, s in sets.items()}


def test_one_of_each_group_stays(docs):
    assert sorted(str(r["doc_id"]) for r in neardup.keep_one(docs).collect()) == sorted(["1", "2", "3", "4", "8", "10", "11", "None"])


def test_large_group_of_near_copies(spark):
    base = [f"word{i}" for i in range(100)]
    rows = [(i, " ".join(base[: i % 97] + [f"x{i}"] + base[i % 97 + 1 :])) for i in range(400)]
    got = neardup.classes_of(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["component_id"] for r in got} == {0}


# op6


def test_mix_awkward_rows(docs):
    got = mixing.mix(docs).collect()
    assert len(got) == len(TEXTS)
    assert all(r["copies"] <= 3 and r["taken"] == r["size"] * r["copies"] for r in got)
    whole = sum(r["size"] for r in got)
    assert abs(sum({r["source"]: r["target"] for r in got}.values()) - whole) < 1e-6 * whole
    assert mixing.mix(docs.limit(0)).count() == 0


def test_mix_takes_what_the_targets_say_and_reruns_agree(documents):
    one, two = ({r["doc_id"]: tuple(r) for r in mixing.mix(documents).collect()} for _ in range(2))
    assert one == two
    by: dict = {}
    for r in mixing.mix(documents).collect():
        x = by.setdefault(r["source"], [0, r["target"], 0])
        x[0] += r["taken"]
        x[2] = max(x[2], r["size"])
    assert all(abs(taken - target) <= largest for taken, target, largest in by.values())


def test_mix_inclusion_follows_size(spark):
    """400 sources with documents of the same sizes: how often each size is taken is what its probability says."""
    sizes = [1, 2, 3, 4, 5, 6, 8, 10, 14, 47]
    rows = [(k * 100 + i, f"s{k:03d}", " ".join(["w"] * n)) for k in range(400) for i, n in enumerate(sizes)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string"), weights=(1,), share=0.6)
    taken = {r["size"]: r["m"] for r in got.groupBy("size").agg(F.avg("copies").alias("m")).collect()}
    rate = (60 - 47) / sum(n * n for n in sizes[:-1])  # the largest one is certain, the others share what is left
    want = {n: min(1.0, n * rate) for n in sizes}
    assert taken[47] == 1 and all(abs(taken[n] - want[n]) < 0.1 for n in sizes), (taken, want)
    assert taken[1] < taken[5] < taken[14]


# op7


def brute_signals(t):
    w, seen = words(t), {}
    for i in range(len(w) - 2):
        seen.setdefault(tuple(w[i : i + 3]), []).append(i)
    again = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(3)}
    full = [x for x in (t or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in quality.SYMBOLS for c in t or ""), len(full) - len(set(full)), len(again)


@pytest.mark.parametrize("which", ["docs", "documents"])
def test_quality_signals(request, spark, data, which):
    table = request.getfixturevalue(which)
    got = quality.judge(table, spark.read.parquet(f"{data}/labels.parquet")).collect()
    want = {r["doc_id"]: brute_signals(r["text"]) for r in table.collect()}
    assert len(got) == table.count()
    for r in got:
        assert tuple(r[1:6]) == want[r["doc_id"]]
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["kept"] and r["base_failed"])


def test_exact_binomial_bound(spark):
    from math import comb

    def brute(n, p, error):
        k, total = -1, 0.0
        while k + 1 <= n and (total := total + comb(n, k + 1) * p ** (k + 1) * (1 - p) ** (n - k - 1)) <= error:
            k += 1
        return k

    cases = [(n, p, e) for n in (1, 30, 200, 997) for p in (0.004, 0.05) for e in (0.05, 0.001)]
    got = spark.createDataFrame(cases, "n long, p double, e double").select("n", "p", "e", quality.most_rejected(F.col("n"), F.col("p"), F.col("e")).alias("k")).collect()
    assert all(r["k"] == brute(r["n"], r["p"], r["e"]) for r in got)


def test_cutoffs_reject_no_more_than_the_bound_allows(spark):
    rows = [(i, "en", 100, 500, 90 if i % 400 == 0 else i % 5, 10, 0, 0) for i in range(4000)]
    good = spark.createDataFrame(rows, "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long")
    found = {r["rule"]: r["cutoff"] for r in quality.cutoffs(good, "lang", 0.05, 0.05).collect()}
    assert 16 < found["symbols"] <= 360  # the ten bad ones may go, those with up to four symbols may not
    assert {r["rule"]: r["cutoff"] for r in quality.cutoffs(good.limit(50), "lang", 0.05, 0.05).collect()} == dict.fromkeys(quality.RULES, quality.STEPS + 1)


# op8


@pytest.mark.parametrize(("which", "heavy"), [("docs", 20_000), ("documents", 20_000), ("documents", 2)])
def test_repeated_bytes(request, which, heavy):
    table = request.getfixturevalue(which).filter("doc_id is not null")
    raw = {r["doc_id"]: (r["text"] or "").encode() for r in table.collect()}
    seen = Counter(b[i : i + 400] for b in raw.values() for i in range(len(b) - 399))
    want = {}
    for k, b in raw.items():
        gone = bytearray(len(b))
        for i in range(len(b) - 399):
            if seen[b[i : i + 400]] > 1:
                gone[i : i + 400] = b"\1" * 400
        want[k] = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())
    assert {r["doc_id"]: tuple(r[1:]) for r in suffixes.dedup(table, heavy=heavy, digest=True).collect()} == want


def test_interval_tree():
    """Occurrences that share different lengths with different others, on both sides."""
    import random

    rnd = random.Random(1)
    anchor = b"ANCHOR"
    segments = list({(20, bytes(rnd.choices(b"ab", k=20)) + anchor + bytes(rnd.choices(b"ab", k=20))) for _ in range(60)})
    want = {(i, p) for i, (_, s) in enumerate(segments) for p in range(len(s) - 17) if any(t[p : p + 18] == s[p : p + 18] for j, (_, t) in enumerate(segments) if j != i) and p <= 20 and p + 18 >= 26}
    got = {(k, p) for k, a, b in suffixes.repeats(segments, 18) for p in range(a, b + 1)}
    assert {x for x in got if x[1] <= 20 and x[1] + 18 >= 26} == want


# op9


def test_encoding_as_the_library_does(spark, docs, documents):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    odd = spark.createDataFrame([(k, t) for k, t in enumerate(["a<|endoftext|>b<|startoftext|", "İ ΣΑΣ ﬁ é é \x1c\x85 ", "it's 12345 ...!?", "x" * 2000 + "é" * 300, "😀漢字 don't<|end"])], "doc_id long, text string")
    for table in (docs, documents, odd):
        rows = {r["doc_id"]: r["text"] or "" for r in table.collect()}
        want = {i: library.encode(t, add_special_tokens=False).ids for i, t in rows.items()}
        encoded = bpe.encode(table, path)
        assert {r["doc_id"]: r["ids"] for r in encoded.collect()} == want
        back = {i: library.decode(ids, skip_special_tokens=False) for i, ids in want.items()}
        assert {r["doc_id"]: r["decoded"] for r in bpe.decode(encoded, path).collect()} == back
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        assert {r["doc_id"]: tuple(r[1:]) for r in bpe.digests(table, path).collect()} == {i: (len(ids), sha(" ".join(map(str, ids))), sha(back[i])) for i, ids in want.items()}


def test_bpe_every_character_of_the_first_planes():
    import public_tokenizers
    import tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    library = tokenizers.Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        voc = bpe.Vocabulary(f.read())
    points = [c for c in [*range(0x80, 0xD800), *range(0xE000, 0x20000)] if c % 3 == 0 or bpe.RARE.search(chr(c))]
    texts = [f"a{chr(c)}b 1{chr(c)}?!" for c in points]
    want = library.encode_batch(texts, add_special_tokens=False)
    assert not [hex(c) for c, t, w in zip(points, texts, want) if [i for x in voc.encode(t) for i in x[3]] != w.ids]


# op10


@pytest.mark.parametrize("which", ["docs", "documents"])
@pytest.mark.parametrize("period", [13, 7, 1])
def test_repeated_words(request, which, period):
    table = request.getfixturevalue(which).filter("doc_id is not null")
    seen, want = set(), {}
    for r in sorted(table.collect(), key=lambda r: r["doc_id"]):
        w = words(r["text"])
        gone = [False] * len(w)
        for i in range(len(w) - 19):
            k = tuple(w[i : i + 20])
            if k in seen:
                gone[i : i + 20] = [True] * 20
            seen.add(k)
        want[r["doc_id"]] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))
    assert {r["doc_id"]: tuple(r[1:]) for r in substrings.dedup(table, period=period).collect()} == want


@pytest.mark.parametrize("period", substrings.COVERS)
def test_difference_covers(period):
    d = substrings.COVERS[period]
    assert {(a - b) % period for a in d for b in d} == set(range(period))


# all


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, data, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    want = con.execute(queries.ORACLE_SQL[name])
    columns = sorted(c[0] for c in want.description)
    got = queries.QUERIES[name](spark, data)
    assert sorted(got.columns) == columns
    want = sorted(want.df()[columns].itertuples(index=False, name=None))
    assert sorted(tuple(r) for r in got.select(columns).collect()) == want


def test_empty_tables(docs, spark):
    none = docs.limit(0)
    assert lines.dedup_lines(none).count() == neardup.classes_of(none).count() == substrings.dedup(none).count() == suffixes.dedup(none).count() == 0
    assert quality.judge(none, spark.createDataFrame([], "doc_id long, quality int")).count() == 0


# rows that repeat an id, rows without one, columns with names that the operators use


def letters(k, n):
    return "".join(hashlib.sha256(f"{k}-{i}".encode()).hexdigest() for i in range(n // 64 + 1))[:n]


def test_repeated_and_null_ids(spark):
    a, b = letters("a", 500), letters("b", 700)
    rows = [(1, a + letters("x", 300)), (1, a + letters("y", 300)), (None, a), (2, b), (2, b), (3, None), (3, "")]
    table = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'z' as kept", "7 as n_bytes", "1L as n_words", "'q' as told", "'r' as lang")
    got = sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"]) for r in suffixes.dedup(table).collect())
    assert got == [("1", 800, 500, 1), ("1", 800, 500, 1), ("2", 700, 700, 1), ("2", 700, 700, 1), ("3", 0, 0, 0), ("3", 0, 0, 0), ("None", 500, 0, 0)]
    words = [" ".join(f"w{hashlib.md5(f'{k}{i}'.encode()).hexdigest()[:5]}" for i in range(40)) for k in "cd"]
    rows = [(5, words[0]), (6, words[0]), (6, words[1]), (None, words[0]), (None, words[0]), (7, words[1] + " " + words[1])]
    table = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n_removed", "'z' as told")
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_removed"]) for r in substrings.dedup(table).collect())
    # what is told to id 6 holds for both its rows
    assert got == [("5", 40, 0), ("6", 40, 40), ("6", 40, 40), ("7", 80, 80), ("None", 40, 0), ("None", 40, 0)]
    table = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as component_id", "2 as n", "3 as f1", "4 as id")
    got = sorted((str(r["doc_id"]), r["n_shingles"], r["component_id"]) for r in neardup.classes_of(table).collect())
    # both texts of id 6 link what each of them links; the last text repeats the shingles of its first half and has four more
    assert [(i, n) for i, n, _ in got] == [("5", 36), ("6", 36), ("6", 36), ("7", 40), ("None", 36), ("None", 36)]
    assert {c for i, _, c in got if i in ("5", "6")} <= {5, 6}


def test_toxicity_of_very_long_and_odd_texts(spark):
    rows = [(i, ("vile mud " if i % 2 else "calm sea ") * 20, i % 2) for i in range(80)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(i, x) for i, _, x in rows], "doc_id long, toxic int"))
    odd = spark.createDataFrame([(1, "vile mud " * 200_000), (2, "\u0437\u043b\u043e \U0001f600"), (2, None), (None, "")], "doc_id long, text string").selectExpr("*", "1 as score", "2 as predicted", "'x' as toxic")
    got = toxicity.score(odd, model).collect()
    assert [r["predicted"] for r in got if r["doc_id"] == 1] == [1] and len(got) == 4 and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.score(odd.limit(0), model).count() == 0 and toxicity.clean(odd, model).columns == odd.columns


def test_lines_with_clashing_columns_and_a_very_long_line(spark):
    long = "x" + letters("l", 120_000)
    rows = [(1, long + "\nshort line here"), (2, "y" + long[1:] + "\nshort line here"), (None, long), (3, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "5 as n_lines", "6 as n_removed", "'b' as band", "1 as removed", "2 as of_doc")
    got = {str(r["doc_id"]): r for r in lines.dedup_lines(table, counts=True).collect()}
    assert got["1"]["text"] == rows[0][1] and got["2"]["text"] == "" and (got["2"]["n_lines"], got["2"]["n_removed"]) == (2, 2)
    assert got["None"]["text"] == long and got["3"]["text"] is None and got["1"]["removed"] == 1 and got["1"]["of_doc"] == 2


def test_components_of_a_hub_and_of_a_path(spark):
    from docweft.llm.components import components, merged

    edges = [(0, i) for i in range(1, 400)] + [(1000 + i, 1001 + i) for i in range(60)] + [(7, 7), (None, 3), (5, 0)]
    found = components(spark.createDataFrame(edges, "u long, v long"))
    got = {r["id"]: r["component"] for r in found.collect()}
    assert got == {**{i: 0 for i in range(400)}, **{1000 + i: 1000 for i in range(61)}}
    more = {r["id"]: r["component"] for r in merged(found, spark.createDataFrame([(3, 1040), (5000, 4000)], "u long, v long")).collect()}
    assert more == {**{i: 0 for i in range(400)}, **{1000 + i: 0 for i in range(61)}, 5000: 4000, 4000: 4000}


def test_substring_dedup_shuffles_texts_once(spark):
    words = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, words), (2, words), (None, words), (3, "short"), (4, None)], "doc_id long, text string")
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = substrings.dedup(docs)
        assert "ReusedExchange [doc_id" in found._jdf.queryExecution().executedPlan().toString()
        assert sorted((str(r["doc_id"]), r["n_words"], r["n_removed"]) for r in found.collect()) == [("1", 40, 0), ("2", 40, 40), ("3", 1, 0), ("4", 0, 0), ("None", 40, 0)]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
