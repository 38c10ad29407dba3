"""Each stage of the pipeline on what the one before it kept, against brute force."""

from __future__ import annotations

from collections import Counter

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from docweft.llm import mixing, toxicity
from docweft.llm.common import cut, table

from .test_operators import Sets, brute_lines, similar, words


def test_stages(spark, data):
    docs = table(spark, data, "documents")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        kept[name] = cut(stage(spark, docs, data))
        if name != "bpe":
            assert kept[name].columns == columns
            docs = kept[name]
    rows = {name: [r.asDict() for r in df.collect()] for name, df in kept.items()}
    first = {r["doc_id"]: r["text"] for r in table(spark, data, "documents").collect()}

    model = toxicity.fit(table(spark, data, "documents"), table(spark, data, "labels"))
    toxic = {r["doc_id"] for r in toxicity.score(table(spark, data, "documents"), model).filter("predicted = 1").collect()}
    assert {r["doc_id"]: r["text"] for r in rows["toxicity"]} == {i: t for i, t in first.items() if i not in toxic}

    want = brute_lines([(r["doc_id"], r["text"]) for r in rows["toxicity"]])
    assert sorted((str(r["doc_id"]), r["text"]) for r in rows["line_dedup"]) == sorted(want)
    assert all(r["n_chars"] == len(r["text"]) for r in rows["line_dedup"])

    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = {}
    for r in rows["line_dedup"]:
        w = words(r["text"].translate(lower))
        sets[r["doc_id"]] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}
    groups = Sets()
    for a, b in similar(sets):
        groups.join(a, b)
    assert sorted(r["doc_id"] for r in rows["near_dedup"]) == sorted(i for i in sets if groups.find(i) == i)

    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(kept["near_dedup"]).collect() if r["copies"]}
    assert Counter(r["doc_id"] for r in rows["mix"]) == copies

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {r["doc_id"]: library.encode(r["text"], add_special_tokens=False).ids for r in rows["mix"]}
    assert len(rows["bpe"]) == len(rows["mix"])
    assert all(r["ids"] == ids[r["doc_id"]] and r["n_tokens"] == len(r["ids"]) for r in rows["bpe"])
    assert all(r["decoded"] == library.decode(r["ids"], skip_special_tokens=False) for r in rows["bpe"])


def test_awkward_rows_pass_through(spark, data):
    docs = spark.createDataFrame([(1, None, None, None, None, 1, 2), (2, "", "en", "a", 0, 1, 2), (3, "x y", "en", "a", 3, 1, 2), (3, "x y", "en", "a", 3, 1, 2)], "doc_id long, text string, lang string, source string, n_chars long, of_doc int, removed int")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, data)
        if name != "bpe":
            assert out.columns == docs.columns
            assert out.count() >= 2
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), data).count() == 0
