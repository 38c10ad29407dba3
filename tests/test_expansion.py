"""Expansion over a small chunk graph, worked out by hand."""

from __future__ import annotations

from docweft.operators import expansion, search


def test_hops_merging_and_limits(spark):
    relations = spark.createDataFrame(
        [(1, 0, "neighbor", 1, 1), (1, 0, "parent", 1, 9), (1, 2, "child", 1, 9), (1, 9, "cross_ref", 2, 0), (1, 1, "neighbor", 1, 0), *[(3, 0, "child", 3, k) for k in range(1, 15)]],
        "doc_id long, pos int, relation string, to_doc long, to_pos int",
    )
    seeds = spark.createDataFrame([(1, 1, 0, 1.0), (1, 1, 0, 0.5), (1, 1, 2, 0.8), (2, 3, 0, 1.0)], "query_id long, doc_id long, pos int, score double")
    found = [tuple(r) for r in expansion.expand_chunks(seeds, relations, 2).orderBy("query_id", "place").collect()]
    first = [r[1:] for r in found if r[0] == 1]
    assert first == [(1, 1, 0, 1.0, 0, "original"), (2, 1, 9, 0.9, 1, "child,parent"), (3, 1, 1, 0.8, 1, "neighbor"), (4, 1, 2, 0.8, 0, "original"), (5, 2, 0, 0.42, 2, "cross_ref")]
    assert [r[3] for r in found if r[0] == 2] == list(range(11))  # the seed and ten children
    assert [r[1] for r in expansion.expand_chunks(seeds, relations, 2, limit=3).filter("query_id = 1").orderBy("place").collect()] == [1, 2, 3]
    assert expansion.expand_chunks(seeds.limit(0), relations).count() == 0


def test_a_frequent_text_makes_no_pairs_of_all_its_blocks(spark):
    blocks = spark.range(300).selectExpr("id AS doc_id", "1 AS page", "0 AS pos", "'same' AS text")
    found = expansion.block_relations(blocks)
    assert found.count() == 300 * 11 - 11 and {r["to_doc"] for r in found.select("to_doc").distinct().collect()} == set(range(11))


def test_a_hop_ranks_the_relations_of_its_own_chunks(spark, monkeypatch):
    plans, real = [], expansion.cut
    monkeypatch.setattr(expansion, "cut", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or real(df))
    blocks = spark.range(300).selectExpr("id AS doc_id", "1 AS page", "0 AS pos", "'same' AS text")
    seeds = spark.createDataFrame([(1, 7, 0, 1.0)], "query_id long, doc_id long, pos int, score double")
    found = expansion.expand_chunks(seeds, expansion.block_relations(blocks), 1)
    assert {r["doc_id"] for r in found.collect()} == set(range(11))
    ranked = [p for p in plans if "Window" in p]
    assert ranked and all("LeftSemi" in p for p in ranked)


def test_scores_are_added_up_by_document_in_bounded_tasks(spark, monkeypatch):
    monkeypatch.setattr(search, "PAIRS", 10)
    docs = spark.range(50).selectExpr("id AS doc_id", "concat('common w', id) AS text")
    queries = spark.createDataFrame([(1, "common w3"), (2, "w4")], "query_id long, text string")
    found = search.bm25(docs, queries, 2)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(doc_id" in plan and ", 10), REPARTITION_BY_NUM" in plan
    assert sorted((r["query_id"], r["rank"], r["doc_id"]) for r in found.collect()) == [(1, 1, 3), (1, 2, 0), (2, 1, 4)]
