"""Model hooks, table functions and the builder registry."""

from __future__ import annotations

import hashlib
import os
import uuid

import numpy as np
import pytest

from docweft import builders, models
from docweft.operators import graph, text

DATA = "/root/testdata/sf0.001"


def test_embedding_of_different_texts_only(spark):
    rows = spark.createDataFrame([(1, "a b", True), (2, "a b", None), (3, " ", True), (4, None, True), (5, "a b", False), (6, "c", True)], "doc_id long, text string, embed boolean")
    found = {r["doc_id"]: r for r in models.embed(rows, dims=8).collect()}
    rng = np.random.RandomState(int(hashlib.md5(b"a b").hexdigest()[:8], 16))
    want = rng.randn(8).astype(np.float32)
    assert np.allclose(found[1]["vector"], want / np.linalg.norm(want), atol=2e-6) and found[1]["vector"] == found[2]["vector"] != found[6]["vector"]
    assert all(found[i]["vector"] == [0.0] * 8 for i in (3, 4, 5)) and abs(np.linalg.norm(found[6]["vector"]) - 1) < 1e-5
    assert models.embed(rows.limit(0)).count() == 0


def test_a_model_is_loaded_once_a_worker(spark, tmp_path):
    folder, name = str(tmp_path), f"counted-{uuid.uuid4().hex}"

    def load():
        open(f"{folder}/{os.getpid()}-{uuid.uuid4().hex}", "w").close()
        return lambda texts: [[float(len(t)), 1.0] for t in texts]

    rows = spark.range(400).selectExpr("id AS doc_id", "concat('text ', id) AS text").repartition(16)
    for _ in range(2):
        found = models.embed(rows, load=load, name=name, dims=2)
        assert {tuple(r["vector"]) for r in found.collect()} == {(6.0, 1.0), (7.0, 1.0), (8.0, 1.0)}
    loads = [f.split("-")[0] for f in os.listdir(folder)]
    assert loads and len(loads) == len(set(loads))


def test_reranking_with_a_scorer_of_ones_own(spark):
    pairs = spark.createDataFrame([(1, "q", 1, "aaa", 0.5), (1, "q", 2, "a", 0.1), (1, "q", 3, " ", 0.9), (1, "q", 4, "b", 0.7), (1, "q", 5, None, 0.1), (2, None, 6, "z", 0.0)], "query_id long, query string, doc_id long, text string, semantic double")
    found = [tuple(r) for r in models.rerank(pairs, 4, lambda: lambda queries, texts: [1000.0 if t == "aaa" else 0.0 for t in texts], "own").orderBy("query_id", "place").collect()]
    assert found == [(1, 1, 1, 1.0), (1, 2, 4, 0.5), (1, 3, 2, 0.5), (1, 4, 3, 0.0), (2, 1, 6, 0.5)]


def test_fallback_scorer(spark):
    pairs = spark.createDataFrame([(1, "red apple", 1, "An APPLE, red"), (1, "red apple", 2, "apple"), (1, "red apple", 3, "sky")], "query_id long, query string, doc_id long, text string")
    assert [(r["doc_id"], r["rerank_score"]) for r in models.rerank(pairs).orderBy("place").collect()] == [(1, 0.880797), (2, 0.5), (3, 0.119203)]


def test_line_chunks_in_sql(spark):
    models.register_chunkers(spark)
    spark.createDataFrame([(1, "aa\n\n bb \ncccccc\ndd"), (2, None), (3, "x" * 20)], "doc_id long, text string").createOrReplaceTempView("lines_in")
    found = [tuple(r) for r in spark.sql("SELECT d.doc_id, c.chunk_no, c.n_lines, c.text FROM lines_in d, LATERAL chunk_lines(d.text, 8) c").orderBy("doc_id", "chunk_no").collect()]
    assert found == [(1, 0, 2, "aa\nbb"), (1, 1, 1, "cccccc"), (1, 2, 1, "dd"), (3, 0, 1, "x" * 20)]


def test_registry_builds_what_a_request_needs(spark):
    calls = []
    noted = lambda b: builders.Builder(b.name, b.needs, lambda *x: calls.append(b.name) or b.build(*x))
    registry = builders.Registry(map(noted, builders.documents().builders.values()))
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(30)
    blocks = text.blocks(docs)
    made = registry.run(["edges"], {"documents": docs})
    assert calls == ["blocks", "graph", "edges"] and made["edges"].count() == graph.edges(graph.nodes(blocks)).count()
    calls.clear()
    made = registry.rebuild(["graph"], {"documents": docs, "blocks": blocks})
    assert sorted(calls) == ["edges", "graph", "layout"] == sorted(made) and calls[0] == "graph"
    assert registry.downstream(["chunks"]) == ["chunks", "hints"] and registry.downstream(["documents"])[0] == "blocks"
    with pytest.raises(KeyError):
        registry.run(["edges"], {})
    registry.add(builders.Builder("blocks", ("layout",), lambda x: x))
    with pytest.raises(ValueError):
        registry.order(["edges"], ["documents"])


def test_rebuild_set_of_a_document(spark):
    """The registry's rebuild order holds what records.invalidated finds for the same dependencies."""
    from docweft.operators import records

    registry = builders.documents()
    depends = tuple((need, b.name) for b in registry.builders.values() for need in b.needs)
    changed = spark.createDataFrame([(1, "graph"), (2, "chunks"), (3, "blocks")], "doc_id long, representation string")
    found = {}
    for r in records.invalidated(changed, depends).collect():
        found.setdefault(r["doc_id"], set()).add(r["representation"])
    assert found == {1: set(registry.downstream(["graph"])), 2: set(registry.downstream(["chunks"])), 3: set(registry.downstream(["blocks"]))}
