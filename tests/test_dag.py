"""Task graphs on shapes that the given tables lack, against plain Python."""

from __future__ import annotations

import os
import random

from pyspark.sql import functions as F

from docweft import shared
from docweft.operators import dag
from docweft.operators.graph import compare


def graph(spark, tasks, edges):
    return spark.createDataFrame(tasks, "run_id long, task long, weight double, status string"), spark.createDataFrame(edges, "run_id long, parent long, child long")


def test_random_graphs(spark):
    rng, tasks, edges = random.Random(9), [], []
    for run in range(25):
        order = rng.sample(range(100), rng.randrange(1, 15))
        tasks += [(run, x, float(rng.randrange(1, 9)), rng.choice(["completed", "pending", "pending", "failed", "running"])) for x in order]
        edges += [(run, order[i], order[j]) for j in range(len(order)) for i in range(j) if rng.random() < 0.3]
    edges += edges[:5] + [(0, 999, tasks[0][1]), (77, 1, 2)]  # repeated, from an unknown task, of an unknown run
    t, e = graph(spark, tasks, edges)
    weight = {(r, x): w for r, x, w, _ in tasks}
    status = {(r, x): s for r, x, _, s in tasks}
    parents = {k: {(r, p) for r, p, c in edges if (r, c) == k and (r, p) in weight} for k in weight}

    def finish(k):
        return weight[k] + max(map(finish, parents[k]), default=0.0)

    found = {(r["run_id"], r["task"]): r for r in dag.propagate(t, e, F.coalesce("at", F.lit(0.0)) + F.col("weight")).collect()}
    assert {k: r["end"] for k, r in found.items()} == {k: finish(k) for k in weight}
    paths = {}
    for r in dag.critical_paths(t, e).orderBy("run_id", "step").collect():
        paths.setdefault(r["run_id"], []).append(r)
    for run, path in paths.items():
        assert sum(r["weight"] for r in path) == max(finish(k) for k in weight if k[0] == run) == path[-1]["finish"]
        assert all((run, a["task"]) in parents[run, b["task"]] and b["via"] == a["task"] for a, b in zip(path, path[1:]))
    want = set()
    for k in weight:
        if status[k] == "failed":
            front, seen, depth = {k}, set(), 0
            while front:
                depth += 1
                front = {c for c in weight if parents[c] & front and status[c] == "pending" and c not in seen}
                want |= {(k[0], k[1], c[1], depth) for c in front}
                seen |= front
    assert {tuple(r) for r in dag.blocked(t, e).select("run_id", "root", "task", "depth").collect()} == want and len(want) > 5


def test_cycles_are_peeled_off_and_closures_end(spark):
    tasks = [(1, i, 1.0, "pending") for i in range(6)] + [(2, 0, 1.0, "pending"), (3, 0, 1.0, "failed"), (3, 1, 1.0, "pending"), (3, 2, 1.0, "blocked")]
    edges = [(1, 0, 1), (1, 1, 2), (1, 2, 3), (1, 3, 2), (1, 3, 4), (2, 0, 0), (3, 0, 1), (3, 1, 2), (3, 2, 1)]
    t, e = graph(spark, tasks, edges)
    assert sorted(tuple(r) for r in dag.cycles(t, e).collect()) == [(1, 3), (2, 1), (3, 2)]
    assert sorted(tuple(r) for r in dag.blocked(t, e).select("run_id", "root", "task", "depth").collect()) == [(3, 0, 1, 1), (3, 0, 2, 2)]
    assert {r["run_id"]: (r["status"], r["n_blocked"], r["n_roots"]) for r in dag.run_status(t, e).collect()} == {1: ("running", 0, 0), 2: ("running", 0, 0), 3: ("failed", 2, 1)}
    assert dag.propagate(t.limit(0), e, F.lit(0.0)).count() == 0 and dag.blocked(t.limit(0), e).count() == 0


def test_a_long_chain(spark):
    n = 20
    t, e = graph(spark, [(1, i, 2.0, "pending") for i in range(n)], [(1, i + 1, i) for i in range(n - 1)])
    assert [r["task"] for r in dag.critical_paths(t, e).orderBy("step").collect()] == list(range(n))[::-1]


def test_every_issue_of_a_layout(spark):
    nodes = spark.createDataFrame(
        [(1, "a", 0, 0, "b"), (1, "a", 1, 1, "b"), (1, None, 2, 2, "b"), (1, "c", 3, 2, None), (1, "d", 4, 9, "b"), (1, "e", 5, 10, "b"), (1, "f", 6, 11, "b"), (1, "lone", 7, 12, "b")],
        "doc_id long, node_id string, pos int, reading_order int, bbox string",
    )
    edges = spark.createDataFrame([(1, "a", "c", "contains"), (1, "d", "e", "contains"), (1, "e", "d", "references"), (1, "e", "f", "contains"), (1, "f", "a", "next"), (1, "c", "gone", "next")], "doc_id long, source string, target string, type string")
    found = {(r["issue"], r["n"]) for r in dag.layout_issues(nodes, edges).collect()}
    assert found == {("missing_id", 1), ("duplicate_id", 1), ("missing_bbox", 1), ("reading_order", 1), ("unknown_end", 1), ("orphan", 1), ("cycle", 3)}
    assert dag.layout_issues(nodes.limit(0), edges.limit(0)).count() == 0


def timed(spark):
    rng, rows, edges = random.Random(4), [], []
    for run in range(6):
        order = rng.sample(range(100), rng.randrange(1, 9))
        rows += [(run, x, rng.choice("AB"), float(rng.randrange(1, 9)), rng.choice(["completed", "pending", "running"]), float(i), float(i + rng.randrange(1, 9)), 2.0, rng.randrange(1, 3)) for i, x in enumerate(order)]
        edges += [(run, order[i], order[j]) for j in range(len(order)) for i in range(j) if rng.random() < 0.5]
    edges += [(0, 999, rows[0][1]), edges[0], (5, rows[-1][1], rows[-1][1])]  # from an unknown task, repeated, a cycle
    return spark.createDataFrame(rows, "run_id long, task long, stage string, weight double, status string, start_ms double, end_ms double, wait_ms double, attempts int"), spark.createDataFrame(edges, "run_id long, parent long, child long")


def test_long_runs_have_the_results_of_short_ones(spark, monkeypatch):
    t, e = timed(spark)
    ask = lambda: [sorted(map(str, df.collect())) for df in (dag.task_forecast(t, e), dag.critical_paths(t, e))]
    short = ask()
    monkeypatch.setattr(dag, "RUN", 8)
    assert ask() == short and all(short)


def test_tables_written_do_not_grow_with_the_depth(spark):
    n = 30
    rows = [(1, i, "A", 1.0, "pending", 0.0, 1.0, 2.0, 1) for i in range(n)]
    t = spark.createDataFrame(rows, "run_id long, task long, stage string, weight double, status string, start_ms double, end_ms double, wait_ms double, attempts int")
    e = spark.createDataFrame([(1, i, i + 1) for i in range(n - 1)], "run_id long, parent long, child long")
    before = len(os.listdir(shared.folder(spark)))
    assert dag.run_outlook(t, e).count() == 1 and dag.task_forecast(t, e).count() == n
    assert len(os.listdir(shared.folder(spark))) - before <= 2


def test_graphs_dealt_by_document_are_compared_and_checked_in_place(spark):
    nodes = spark.createDataFrame([(d, f"n{i}", f"n{i - 1}" if i % 3 else None, i, i, f"Word {i % 2}", None if i % 2 else "b") for d in range(5) for i in range(9)], "doc_id long, node_id string, parent string, pos int, reading_order int, text string, bbox string").repartition(3, "doc_id")
    right = nodes.filter("pos < 6 or pos = 8").withColumn("parent", F.when(F.col("pos") != 1, F.col("parent")))
    edges = lambda n, c="parent is not null": n.filter(c).select("doc_id", F.col("parent").alias("source"), F.col("node_id").alias("target"), F.lit("contains").alias("type"))
    found = compare(nodes, edges(nodes), right, edges(right, "parent is not null and pos < 4"))
    rows = {tuple(r) for r in found.collect()}
    # 9 nodes and 7 of them; 6 keep their parent; 6 edges and 1 of them, from n1 to n2; n0 and n3 have neither parent nor edge.
    assert rows == {(d, round((0.4 * (1 - 2 / 9) + 0.3 * (6 / 9) + 0.3 * (1 / 6)) * 100, 2), 100.0, 0, 2, 0, 5, 2) for d in range(5)}
    assert found._jdf.queryExecution().executedPlan().toString().count("ENSURE_REQUIREMENTS") == 0
    issues = dag.layout_issues(nodes, edges(nodes))
    assert {tuple(r) for r in issues.collect()} == {(d, "missing_bbox", 4) for d in range(5)}
    assert "Join" not in issues._jdf.queryExecution().executedPlan().toString()
