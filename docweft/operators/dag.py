"""Task graphs of any shape, all runs at once: earliest finish, critical paths, spans, forecasts, blocked tasks, cycles.

tasks: run_id, task, and what an operator names; edges: run_id, parent, child. Repeated edges count once, edges with an unknown end not at all. Work goes level by level: a round joins only the tasks
that became ready in the round before with their edges, so there are as many rounds as the longest chain of any run, and what never becomes ready lies on a cycle or behind one.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as S

from docweft.operators.outline import chains
from docweft.shared import cut, none_in

#: What is taken for a stage without a finished task; shares of the buffer that decide about an agreed time.
DURATION, SLA = 1000.0, 30_000.0
#: Runs of at most RUN tasks and edges are worked off within a task of Spark, some BUCKET rows of many runs at a time; longer ones level by level over all tasks.
RUN, BUCKET = 50_000, 200_000


def by_levels() -> tuple[Column, ...]:
    """A plan of schedule() that only asks for levels."""
    return F.lit(False), F.lit(0.0), F.lit(0.0), F.lit(0.0)


def by_weights() -> tuple[Column, ...]:
    """A plan of schedule(): each task takes its weight."""
    return F.lit(True), F.lit(None), F.lit(0.0), F.col("weight")


def known_edges(tasks: DataFrame, edges: DataFrame) -> DataFrame:
    ids = tasks.select("run_id", "task")
    return edges.select("run_id", "parent", "child").distinct().join(ids.withColumnRenamed("task", "parent"), ["run_id", "parent"], "left_semi").join(ids.withColumnRenamed("task", "child"), ["run_id", "child"], "left_semi")


def propagate(tasks: DataFrame, edges: DataFrame, end: Column) -> DataFrame:
    """tasks with at (the latest end of a task's parents, null without parents), via (the parent that ends then, the least of several), end and level (0 without parents).

    end is an expression over the columns of tasks and `at`. Tasks on a cycle or behind one have no end and no level.
    """
    edges = cut(known_edges(tasks, edges))
    parents = edges.groupBy("run_id", F.col("child").alias("task")).agg(F.count("*").alias("_left"))
    best = F.lit(None).cast("struct<at:double,other:long>")
    waiting = cut(tasks.join(parents, ["run_id", "task"], "left").withColumn("_left", F.coalesce("_left", F.lit(0))).withColumn("_best", best))
    done, level = [], 0
    shape = lambda df: df.withColumn("at", F.col("_best.at")).withColumn("via", -F.col("_best.other")).withColumn("end", end.cast("double"))
    while True:
        ready = cut(shape(waiting.filter("_left = 0")).withColumn("level", F.lit(level)).drop("_left", "_best"))
        if none_in(ready):
            break
        done.append(ready)
        told = ready.select("run_id", F.col("task").alias("parent"), F.struct(F.col("end").alias("at"), (-F.col("task")).cast("long").alias("other")).alias("b")).join(edges, ["run_id", "parent"])
        news = told.groupBy("run_id", F.col("child").alias("task")).agg(F.count("*").alias("n"), F.max("b").alias("b"))
        more = waiting.filter("_left > 0").join(news, ["run_id", "task"], "left")
        waiting = cut(more.withColumn("_left", F.col("_left") - F.coalesce("n", F.lit(0))).withColumn("_best", F.greatest("_best", "b")).drop("n", "b"))
        level += 1
    none = lambda kind: F.lit(None).cast(kind)
    out = waiting.withColumns({"at": none("double"), "via": none("long"), "end": none("double"), "level": none("int")}).drop("_left", "_best")
    for part in done:
        out = out.unionByName(part)
    return out


def _peel(n: int, source: np.ndarray, target: np.ndarray, free: np.ndarray, told: np.ndarray, first: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """at, end (NaN: none) and level (-1: none) of n tasks as propagate() has them: a free task ends `length` after at (first, without), another one as told."""
    order = np.argsort(source, kind="stable")
    target = target[order]
    start = np.searchsorted(source[order], np.arange(n + 1))
    left, at, end, level = np.bincount(target, minlength=n), np.full(n, -np.inf), np.full(n, np.nan), np.full(n, -1, np.int32)
    front, depth = np.flatnonzero(left == 0), 0
    while len(front):
        level[front] = depth
        end[front] = np.where(free[front], np.where(at[front] == -np.inf, first[front], at[front]) + length[front], told[front])
        many = start[front + 1] - start[front]
        ahead = target[np.repeat(start[front] - np.cumsum(many) + many, many) + np.arange(many.sum())]
        np.maximum.at(at, ahead, np.repeat(np.where(np.isnan(end[front]), -np.inf, end[front]), many))
        np.subtract.at(left, ahead, 1)
        front, depth = np.unique(ahead[left[ahead] == 0]), depth + 1
    at[(level < 0) | (at == -np.inf)] = np.nan
    return at, end, level


def _worked_off(plans: list[str]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The tasks of a bucket of whole runs with what schedule() adds."""

    def codes(*columns: pa.ChunkedArray) -> list[np.ndarray]:
        all_codes = pa.chunked_array([c for x in columns for c in x.cast(pa.int64()).chunks], type=pa.int64()).combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        return np.split(all_codes, np.cumsum([len(x) for x in columns])[:-1])

    def run(tasks: pa.Table, edges: pa.Table) -> pa.Table:
        n, m = len(tasks), len(edges)
        runs, edge_runs = codes(tasks["run_id"], edges["run_id"])
        own, parent, child = codes(tasks["task"], edges["parent"], edges["child"])
        key = np.where((runs >= 0) & (own >= 0), runs * (n + 2 * m + 1) + own, -1 - np.arange(n))
        order = np.argsort(key)
        place = lambda task: np.minimum(np.searchsorted(key[order], edge_runs * (n + 2 * m + 1) + task), n - 1)
        known = lambda task: (edge_runs >= 0) & (task >= 0) & (key[order][place(task)] == edge_runs * (n + 2 * m + 1) + task)
        some = known(parent) & known(child) if n else np.zeros(m, bool)
        pairs = np.unique(order[place(parent)][some] * n + order[place(child)][some]) if n else np.zeros(0, np.int64)
        source, target = pairs // max(n, 1), pairs % max(n, 1)
        number = tasks["task"].cast(pa.int64()).fill_null(0).to_numpy()
        out = tasks.drop_columns(["_bucket"])
        for p in plans:
            free = tasks[f"{p}_free"].combine_chunks().fill_null(False).to_numpy(zero_copy_only=False)
            told, first, length = (tasks[f"{p}_{c}"].combine_chunks().cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False) for c in ("told", "first", "length"))
            at, end, level = _peel(n, source, target, free, told, first, length)
            tail = np.nan_to_num(_peel(n, target, source, free, np.zeros(n), np.zeros(n), length)[0])
            # via: of the parents that end last the least; none for tasks without a level.
            ends = np.where(np.isnan(end[source]), -np.inf, end[source])
            best = np.lexsort((number[source], -ends, target))
            best = best[level[target[best]] >= 0]
            heads = best[np.append(True, target[best][1:] != target[best][:-1])] if len(best) else best
            via = np.full(n, -1)
            via[target[heads]] = source[heads]
            # The path: back from the task that ends last (the least of several).
            ended = np.flatnonzero(~np.isnan(end))
            ended = ended[np.lexsort((number[ended], -end[ended], runs[ended]))]
            last = ended[np.append(True, runs[ended][1:] != runs[ended][:-1])] if len(ended) else ended
            finish = np.full(max(runs.max(initial=-1), 0) + 2, np.nan)
            finish[runs[last]] = end[last]
            back, longest, now, steps = np.full(n, -1), np.zeros(max(runs.max(initial=-1), 0) + 2, np.int64), last, 0
            while len(now):
                back[now], longest[runs[now]] = steps, steps
                now, steps = via[now][via[now] >= 0], steps + 1
            add = {"at": pa.array(at, mask=np.isnan(at)), "via": pa.array(number[via] if n else number, pa.int64(), mask=via < 0), "end": pa.array(end, mask=np.isnan(end)), "level": pa.array(level, mask=level < 0)}
            add |= {"step": pa.array((longest[runs] - back + 1).astype(np.int32), mask=back < 0), "tail": pa.array(tail), "finish": pa.array(finish[runs], mask=np.isnan(finish[runs]))}
            out = out.drop_columns([f"{p}_{c}" for c in ("free", "told", "first", "length")])
            for name, column in add.items():
                out = out.append_column(f"{p}_{name}", column)
        return out

    return run


def schedule(tasks: DataFrame, edges: DataFrame, **plans: tuple[Column, Column, Column, Column]) -> DataFrame:
    """tasks with <plan>_at, via, end and level as of propagate(), <plan>_step (place on the run's critical path, from 1, or null) <plan>_tail (how long what must follow by way of free tasks takes at most) and <plan>_finish (the run's latest end).

    A plan is free, told, first and length, expressions over the columns of tasks: a free task ends `length` after its parents (after first, without), another one as told. tasks and edges are read twice and
    shuffled once, whole runs together; run_id and task are longs, and a task comes once in a run.
    """
    fields = ("free", "told", "first", "length")
    given = tasks.withColumns({f"{p}_{f}": c.cast("boolean" if f == "free" else "double") for p, plan in plans.items() for f, c in zip(fields, plan)})
    pairs = edges.select("run_id", "parent", "child")
    sizes = tasks.select("run_id").unionByName(pairs.select("run_id")).groupBy("run_id").agg(F.count("*").alias("n"))
    rows, most = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max(F.when(F.col("run_id").isNotNull(), F.col("n"))), F.lit(0))).first()
    long = cut(sizes.filter((F.col("n") > RUN) & F.col("run_id").isNotNull()).select("run_id")) if most > RUN else None
    short = (lambda df: df.join(long, "run_id", "left_anti")) if long is not None else (lambda df: df)
    kinds = {"at": S.DoubleType(), "via": S.LongType(), "end": S.DoubleType(), "level": S.IntegerType(), "step": S.IntegerType(), "tail": S.DoubleType(), "finish": S.DoubleType()}
    schema = S.StructType([S.StructField(f.name, f.dataType) for f in tasks.schema] + [S.StructField(f"{p}_{k}", v) for p in plans for k, v in kinds.items()])
    bucket = F.pmod(F.xxhash64(F.coalesce("run_id", F.lit(0)), F.when(F.col("run_id").isNull(), F.col("_salt"))), F.lit(max(1, -(-rows // BUCKET)))).cast("int")
    dealt = lambda df, salt: df.withColumn("_salt", salt).withColumn("_bucket", bucket).drop("_salt").groupBy("_bucket")
    out = dealt(short(given), F.col("task")).cogroup(dealt(short(pairs), F.col("child"))).applyInArrow(_worked_off(list(plans)), schema)
    if long is not None:
        out = out.unionByName(_schedule_long(given.join(long, "run_id", "left_semi"), pairs.join(long, "run_id", "left_semi"), list(plans)).select(out.columns))
    return out


def _schedule_long(given: DataFrame, edges: DataFrame, plans: list[str]) -> DataFrame:
    """schedule() of runs that are too long for one task of Spark, by propagate() and chains()."""
    out = given = cut(given)
    for p in plans:
        free, length, c = F.coalesce(F.col(f"{p}_free"), F.lit(False)), F.col(f"{p}_length"), ["run_id", "task"]
        one = given.select(*c, *[f"{p}_{f}" for f in ("free", "told", "first", "length")])
        ahead = cut(propagate(one, edges, F.when(free, F.coalesce("at", f"{p}_first") + length).otherwise(F.col(f"{p}_told"))).select(*c, *[F.col(x).alias(f"{p}_{x}") for x in ("at", "via", "end", "level")]))
        back = edges.select("run_id", F.col("child").alias("parent"), F.col("parent").alias("child"))
        after = propagate(one, back, F.when(free, F.coalesce("at", F.lit(0.0)) + length).otherwise(F.lit(0.0))).select(*c, F.coalesce("at", F.lit(0.0)).alias(f"{p}_tail"))
        nodes = ahead.select("run_id", F.col("task").cast("string").alias("node_id"), F.col(f"{p}_via").cast("string").alias("parent"), "task")
        last = ahead.filter(F.col(f"{p}_end").isNotNull()).groupBy("run_id").agg(F.max(F.struct(f"{p}_end", (-F.col("task")).alias("t"))).alias("e")).select("run_id", (-F.col("e.t")).cast("string").alias("node_id"))
        steps = chains(nodes, F.col("task"), "run_id").join(last, ["run_id", "node_id"]).select("run_id", F.posexplode("chain").alias("s", "task")).select(*c, (F.col("s") + 1).alias(f"{p}_step"))
        out = out.drop(*[f"{p}_{f}" for f in ("free", "told", "first", "length")]).join(ahead, c).join(after, c).join(steps, c, "left").withColumn(f"{p}_finish", F.max(f"{p}_end").over(Window.partitionBy("run_id")))
    return out


def cycles(tasks: DataFrame, edges: DataFrame) -> DataFrame:
    """run_id, n: how many tasks lie on a cycle or behind one, of the runs that have such, by peeling off tasks without an open parent until nothing changes."""
    return schedule(tasks.select("run_id", "task"), edges, p=by_levels()).filter("p_level is null").groupBy("run_id").agg(F.count("*").alias("n"))


def critical_paths(tasks: DataFrame, edges: DataFrame) -> DataFrame:
    """run_id, step (from 1), task, via, weight, finish: the heaviest path of each run (tasks: weight), walked back from the task that ends last (the least of several) by the parent that ends last.

    A run whose tasks all lie on cycles has no path; the weights of a path's tasks add up to the last one's finish.
    """
    found = schedule(tasks.select("run_id", "task", "weight"), edges, p=by_weights()).filter("p_step is not null")
    return found.select("run_id", F.col("p_step").alias("step"), "task", F.col("p_via").alias("via"), "weight", F.round("p_end", 2).alias("finish"))


def spans(tasks: DataFrame, edges: DataFrame) -> DataFrame:
    """run_id, task, parent (the first of its parents), depth (how many parents lie above it at most), start_ms, duration_ms, place: spans of a flame graph, in order of start, depth, duration (longest first) and task. tasks: start_ms, duration_ms."""
    found = schedule(tasks, edges, p=by_levels()).withColumnRenamed("p_level", "level")
    first = known_edges(tasks, edges).groupBy("run_id", F.col("child").alias("task")).agg(F.min("parent").alias("parent"))
    place = F.row_number().over(Window.partitionBy("run_id").orderBy("start_ms", "level", F.desc("duration_ms"), "task"))
    return found.join(first, ["run_id", "task"], "left").select("run_id", "task", "parent", F.col("level").alias("depth"), "start_ms", "duration_ms", place.alias("place"))


def now_of(tasks: DataFrame) -> DataFrame:
    """run_id, now_ms: the latest end of a completed task or start of a running one, 0 without any."""
    return tasks.groupBy("run_id").agg(F.coalesce(F.max(F.when(F.col("status") == "completed", F.col("end_ms")).when(F.col("status") == "running", F.col("start_ms"))), F.lit(0)).cast("double").alias("now_ms"))


def stage_means(tasks: DataFrame) -> DataFrame:
    """run_id, stage, mean_ms (of completed tasks, DURATION without any), mean_wait_ms, retry_ms: the mean by how often its tasks were tried again."""
    c = tasks.groupBy("run_id", "stage").agg(F.avg(F.when(F.col("status") == "completed", F.col("end_ms") - F.col("start_ms"))).alias("mean"), F.avg(F.when(F.col("status").isin("completed", "running"), F.col("wait_ms"))).alias("wait"), F.sum(F.col("attempts") - 1).alias("retries"), F.count("*").alias("n"))
    mean = F.coalesce("mean", F.lit(DURATION))
    return c.select("run_id", "stage", mean.alias("mean_ms"), F.coalesce("wait", F.lit(0.0)).alias("mean_wait_ms"), (F.col("retries") / F.col("n") * mean).alias("retry_ms"))


def with_means(tasks: DataFrame) -> DataFrame:
    """tasks with now_ms as of now_of() and mean_ms, mean_wait_ms and retry_ms of their stage as of stage_means(), in place: runs stay together, so nothing is shuffled for it where tasks come by run_id."""
    run, stage = Window.partitionBy("run_id"), Window.partitionBy("run_id", "stage")
    status = F.col("status")
    now = F.max(F.when(status == "completed", F.col("end_ms")).when(status == "running", F.col("start_ms"))).over(run)
    mean = F.coalesce(F.avg(F.when(status == "completed", F.col("end_ms") - F.col("start_ms"))).over(stage), F.lit(DURATION))
    wait = F.coalesce(F.avg(F.when(status.isin("completed", "running"), F.col("wait_ms"))).over(stage), F.lit(0.0))
    out = tasks.withColumns({"now_ms": F.coalesce(now, F.lit(0)).cast("double"), "mean_ms": mean, "mean_wait_ms": wait, "_again": F.sum(F.col("attempts") - 1).over(stage) / F.count("*").over(stage)})
    return out.withColumn("retry_ms", F.col("_again") * F.col("mean_ms")).drop("_again")


def by_forecast() -> tuple[Column, ...]:
    """A plan of schedule() over with_means(): what has begun can't be moved."""
    status = F.col("status")
    running = F.col("now_ms") + F.greatest(F.lit(0.0), F.col("mean_ms") - (F.col("now_ms") - F.col("start_ms")))
    told = F.when(status == "completed", F.col("end_ms")).when(status == "running", running)
    return ~status.isin("completed", "running"), told, F.col("now_ms"), F.col("mean_wait_ms") + F.col("mean_ms") + F.col("retry_ms")


def task_forecast(tasks: DataFrame, edges: DataFrame) -> DataFrame:
    """run_id, task, stage, status, predicted_start_ms, predicted_end_ms, slack_ms of each task (tasks: stage, status, start_ms, end_ms, wait_ms, attempts).

    A completed task keeps its times, a running one ends when its stage's mean is over; any other begins after the last of its parents (now, without parents) and the stage's mean wait, and takes the mean and
    what retries add. slack is how much later a task could end without its run ending later. Tasks on a cycle or behind one have no forecast.
    """
    told = with_means(tasks).select("run_id", "task", "stage", "status", "start_ms", "end_ms", "now_ms", "mean_ms", "mean_wait_ms", "retry_ms")
    found = schedule(told, edges, f=by_forecast())
    start = F.when(by_forecast()[0], F.coalesce("f_at", "now_ms") + F.col("mean_wait_ms")).otherwise(F.col("start_ms")).cast("double")
    slack = F.col("f_finish") - F.col("f_end") - F.col("f_tail")
    return found.select("run_id", "task", "stage", "status", F.round(F.when(F.col("f_end").isNotNull(), start), 3).alias("predicted_start_ms"), F.round("f_end", 3).alias("predicted_end_ms"), F.round(slack, 3).alias("slack_ms"))


def run_outlook(tasks: DataFrame, edges: DataFrame, sla_ms: float = SLA) -> DataFrame:
    """run_id, now_ms, finish_ms, remaining_ms, progress, critical_remaining_ms, sla_status, confidence of each run (tasks: as task_forecast, and weight for its critical path).

    On Track with more than 20 % of the agreed time left, At Risk with 5 % or more, else Likely Miss; Missed once it has passed. Confidence starts at 100, less 20 (10) below 30 % (60 %) of progress, 15 each for
    retries of more than a fifth of the tasks and for a stage's mean wait over 2 s: High from 75, Medium from 45.
    """
    told = with_means(tasks).select("run_id", "task", "status", "weight", "start_ms", "end_ms", "attempts", "now_ms", "mean_ms", "mean_wait_ms", "retry_ms")
    each = schedule(told, edges, f=by_forecast(), w=by_weights())
    left = F.when(F.col("status") == "completed", 0.0).when(F.col("status") == "running", F.greatest(F.lit(0.0), F.col("mean_ms") - (F.col("now_ms") - F.col("start_ms")))).otherwise(F.col("mean_ms") + F.col("mean_wait_ms") + F.col("retry_ms"))
    both = each.groupBy("run_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("status") == "completed").alias("done"), F.sum(F.col("attempts") - 1).alias("retries"), F.max("mean_wait_ms").alias("wait"), F.max("now_ms").alias("now_ms"),
        F.round(F.max("f_end"), 3).alias("finish_ms"), F.round(F.sum(F.when(F.col("w_step").isNotNull(), left)), 3).alias("critical_remaining_ms"),
    )
    progress = F.round(F.col("done") / F.col("n") * 100, 2)
    remaining = F.when(F.col("done") == F.col("n"), 0.0).otherwise(F.greatest(F.lit(0.0), F.col("finish_ms") - F.col("now_ms")))
    total = F.col("now_ms") + F.col("remaining_ms")
    buffer = (sla_ms - total) / sla_ms * 100
    status = F.when(total > sla_ms, F.when(F.col("now_ms") > sla_ms, "Missed").otherwise("Likely Miss")).when(buffer > 20, "On Track").when(buffer >= 5, "At Risk").otherwise("Likely Miss")
    trust = 100 - F.when(F.col("progress") < 30, 20).when(F.col("progress") < 60, 10).otherwise(0) - F.when(F.col("retries") / F.col("n") > 0.2, 15).otherwise(0) - F.when(F.col("wait") > 2000, 15).otherwise(0)
    out = both.withColumn("progress", F.when(F.col("done") == F.col("n"), 100.0).otherwise(progress)).withColumn("remaining_ms", F.round(remaining, 3))
    return out.select("run_id", "now_ms", "finish_ms", "remaining_ms", "progress", "critical_remaining_ms", status.alias("sla_status"), F.when(trust >= 75, "High").when(trust >= 45, "Medium").otherwise("Low").alias("confidence"))


def blocked(tasks: DataFrame, edges: DataFrame) -> DataFrame:
    """run_id, root, task, depth: each task that waits (pending or blocked) behind a failed one, by way of waiting tasks only, and its least distance from it (tasks: status).

    The closure of the pairs is semi-naive: a round joins only the pairs found in the round before, and new pairs go on; cycles end by that.
    """
    edges = cut(known_edges(tasks, edges))
    waits = cut(tasks.filter(F.col("status").isin("pending", "blocked")).select("run_id", F.col("task").alias("child")))
    front = cut(tasks.filter("status = 'failed'").select("run_id", F.col("task").alias("root"), F.col("task").alias("parent")))
    found, depth = [], 0
    while True:
        depth += 1
        step = front.join(edges, ["run_id", "parent"]).join(waits, ["run_id", "child"], "left_semi").select("run_id", "root", F.col("child").alias("task")).distinct()
        for known in found:
            step = step.join(known, ["run_id", "root", "task"], "left_anti")
        new = cut(step.withColumn("depth", F.lit(depth)))
        if none_in(new):
            break
        found.append(new)
        front = new.select("run_id", "root", F.col("task").alias("parent"))
    out = new
    for part in found:
        out = out.unionByName(part)
    return out


def run_status(tasks: DataFrame, edges: DataFrame) -> DataFrame:
    """run_id, status, n_blocked, n_roots: the run's status from those of its tasks, waiting tasks behind failed ones being blocked.

    completed if all tasks are; running while one runs or can still be started; else failed, blocked or cancelled by the first that there is.
    """
    closure = blocked(tasks, edges)
    held = closure.select("run_id", "task").distinct().withColumn("held", F.lit(True))
    roots = closure.groupBy("run_id").agg(F.countDistinct("root").alias("n_roots"))
    now = tasks.join(held, ["run_id", "task"], "left").withColumn("status", F.when(F.col("held"), "blocked").otherwise(F.col("status")))
    n = lambda *s: F.count_if(F.col("status").isin(*s))
    status = F.when(n("completed") == F.count("*"), "completed").when(n("running", "pending") > 0, "running").when(n("failed") > 0, "failed").when(n("blocked") > 0, "blocked").when(n("cancelled") > 0, "cancelled").otherwise("failed")
    return now.groupBy("run_id").agg(status.alias("status"), n("blocked").alias("n_blocked")).join(roots, "run_id", "left").fillna({"n_roots": 0})


def layout_issues(nodes: DataFrame, edges: DataFrame, kinds: tuple[str, ...] = ("contains", "references", "caption_of")) -> DataFrame:
    """doc_id, issue, n: missing_id, duplicate_id (further nodes with an id), missing_bbox, reading_order (not above that of the node before), unknown_end (edges with an end that is no node), orphan (no edge at all), cycle.

    nodes: doc_id, node_id, pos (place in the file), reading_order, bbox; edges: doc_id, source, target, type. A cycle is looked for among edges of the given kinds; n is the number of nodes on one or behind one. Edges of reading order, long chains
    that lead nowhere back, are left out of that.
    """
    # Nodes and edges meet in groups and windows of one document's rows: nothing is shuffled for it where they are dealt by doc_id.
    own = Window.partitionBy("doc_id").orderBy("pos")
    told = nodes.withColumn("_before", F.lag("reading_order").over(own)).groupBy("doc_id").agg(F.count_if(F.col("node_id").isNull()).alias("missing_id"), F.count_if(F.col("bbox").isNull()).alias("missing_bbox"), F.count_if(F.col("reading_order") <= F.col("_before")).alias("reading_order"))
    named = nodes.filter("node_id is not null").select("doc_id", "node_id", F.col("pos").cast("long").alias("at"))
    ends = edges.select("doc_id", F.explode(F.array("source", "target")).alias("node_id"), F.lit(None).cast("long").alias("at")).filter("node_id is not null")
    ids = named.unionByName(ends).groupBy("doc_id", "node_id").agg(F.count("at").alias("n"), F.count("*").alias("all"), F.min("at").alias("at")).filter("n > 0")
    ids = cut(ids.select("doc_id", "at", "n", (F.col("all") == F.col("n")).alias("alone")))
    met = ids.groupBy("doc_id").agg(F.sum(F.col("n") - 1).alias("duplicate_id"), F.sum(F.when(F.col("alone"), F.col("n")).otherwise(0)).alias("orphan"))

    def placed(rows: DataFrame, end: str) -> DataFrame:
        """rows with the place of the node that their end names."""
        held = [c for c in rows.columns if c != end]
        both = rows.select(*held, F.col(end).alias("node_id"), F.lit(None).cast("long").alias("at"), F.lit(True).alias("edge"))
        both = both.unionByName(named.withColumn("edge", F.lit(False)), allowMissingColumns=True)
        found = F.when(F.col("node_id").isNotNull(), F.min("at").over(Window.partitionBy("doc_id", "node_id")))
        return both.withColumn(f"at_{end}", found).filter("edge").select(*held, f"at_{end}")

    known = placed(placed(edges.select("doc_id", "source", "target", F.coalesce(F.col("type").isin(*kinds), F.lit(False)).alias("counts")), "source"), "target")
    known = cut(known.filter(F.col("counts") | F.col("at_source").isNull() | F.col("at_target").isNull()))
    unknown = F.col("at_source").isNull() | F.col("at_target").isNull()
    graph = known.filter(F.col("counts") & ~unknown).select(F.col("doc_id").alias("run_id"), F.col("at_source").alias("parent"), F.col("at_target").alias("child"))
    loops = cycles(ids.select(F.col("doc_id").alias("run_id"), F.col("at").alias("task")), graph).select(F.col("run_id").alias("doc_id"), F.lit("cycle").alias("issue"), "n")
    each = lambda df, *names: df.select("doc_id", F.explode(F.array(*[F.struct(F.lit(c).alias("issue"), F.col(c).alias("n")) for c in names])).alias("x")).select("doc_id", "x.issue", "x.n").filter("n > 0")
    lost = known.filter(unknown).groupBy("doc_id").agg(F.count("*").alias("n")).select("doc_id", F.lit("unknown_end").alias("issue"), "n")
    return each(told, "missing_id", "missing_bbox", "reading_order").unionByName(each(met, "duplicate_id", "orphan")).unionByName(lost).unionByName(loops)


def _severity(value: Column, *steps: tuple[float, str], least: str) -> Column:
    out = F.lit(least)
    for limit, name in sorted(steps):
        out = F.when(value > limit, name).otherwise(out)
    return out


def run_bottlenecks(tasks: DataFrame, edges: DataFrame) -> DataFrame:
    """run_id, place, id, severity, impact (cut to 6 dp), affected_ms (cut to 3 dp): what holds a run up, worst first: by severity, impact, affected time and id.

    tasks: task, stage, worker, weight, start_ms, end_ms, duration_ms, wait_ms, attempts. Ten rules, each once a run at most; D is the time from the run's first start to its last end:
    queue-delay (the stage with the longest mean wait, over 500 ms), worker-saturation (the busiest worker, over 50 % of D), slow-stage (the stage with the longest total, over 100 ms), retry-hotspot (the task tried
    again most), idle-workers (busy below 15 % of D), critical-path-length, longest-serial-chain (over 3 tasks on it), excessive-retries (tasks tried again twice or more), worker-starvation (waits over 1 s and
    three times the duration) and queue-imbalance (stages' mean waits more than 1 s apart). Of equals, the least name counts.
    """
    names = ["run_id", "task", "stage", "worker", "weight", "start_ms", "end_ms", "duration_ms", "wait_ms", "attempts"]
    each = cut(schedule(tasks.select(*names), edges, w=by_weights()).select(*names, F.col("w_step").isNotNull().alias("critical")).drop("weight"))
    critical, retries, wait, duration = F.col("critical"), F.col("attempts") - 1, F.col("wait_ms"), F.col("duration_ms")
    run = each.groupBy("run_id").agg(
        (F.max("end_ms") - F.min("start_ms")).alias("d"), F.max(F.struct(retries.alias("retries"), (-F.col("task")).alias("t"))).alias("hot"), F.sum(F.when(critical, 1)).alias("n_path"),
        F.sum(F.when(critical, duration).otherwise(0.0)).alias("path_ms"), F.sum(F.when(critical, wait).otherwise(0.0)).alias("path_wait"),
        F.count_if(retries >= 2).alias("often"), F.sum(F.when(retries > 0, duration).otherwise(0.0)).alias("again_ms"),
        F.sum(F.when((wait > 1000) & (wait > duration * 3), wait)).alias("starved"),
    )
    # Of the groups with the greatest value the one with the least name.
    most = lambda value, name: F.min(F.struct(F.isnull(value).alias("no"), (-F.col(value)).alias("minus"), F.col(name).alias("name"), F.col(value).alias("v")))
    stage = each.groupBy("run_id", "stage").agg(F.avg("wait_ms").alias("wait"), F.sum("duration_ms").alias("total"))
    stage = stage.groupBy("run_id").agg(most("wait", "stage").alias("slow"), most("total", "stage").alias("long"), (F.max("wait") - F.min("wait")).alias("gap"))
    worker = each.groupBy("run_id", "worker").agg(F.sum("duration_ms").alias("busy")).join(run.select("run_id", "d"), "run_id").withColumn("share", F.when(F.col("d") > 0, F.col("busy") / F.col("d") * 100.0).otherwise(0.0))
    worker = worker.groupBy("run_id").agg(most("share", "worker").alias("busiest"), F.bool_or(F.col("share") < 15).alias("idle"))
    both = run.join(stage, "run_id", "left").join(worker, "run_id", "left")
    d = F.greatest("d", F.lit(1.0))
    one = F.lit(1.0)

    def rule(when: Column, name: Column, severity: Column, impact: Column, affected: Column) -> Column:
        impact, affected = F.floor(impact.cast("double") * 1e6) / 1e6, F.floor(affected.cast("double") * 1e3) / 1e3
        rank = F.when(severity == "critical", 4).when(severity == "high", 3).when(severity == "medium", 2).otherwise(1)
        after = lambda c: F.coalesce(-c, F.lit(float("inf")))
        return F.when(when, F.struct((-rank).alias("a"), after(impact).alias("b"), after(affected).alias("c"), name.alias("id"), severity.alias("severity"), impact.alias("impact"), affected.alias("affected_ms")))

    w, share, total = F.col("slow.v"), F.col("busiest.v"), F.col("long.v")
    pct, hot = total / d * 100.0, F.col("hot.retries")
    found = F.array(
        rule(w > 500, F.concat(F.lit("queue-delay-"), "slow.name"), _severity(w, (5000.0, "critical"), (2000.0, "high"), least="medium"), F.least(one, w / d), w),
        rule(share > 50, F.concat(F.lit("worker-saturation-"), "busiest.name"), _severity(share, (90.0, "critical"), (75.0, "high"), least="medium"), share / 100.0, F.floor(F.col("d") * share / 100.0)),
        rule(total > 100, F.concat(F.lit("slow-stage-"), "long.name"), _severity(pct, (40.0, "critical"), (25.0, "high"), least="low"), F.least(one, pct / 100.0), total),
        rule(hot > 0, F.concat(F.lit("retry-hotspot-task-"), -F.col("hot.t")), _severity(hot, (2.0, "critical"), (1.0, "high"), least="medium"), F.least(one, hot * 500.0 / d), hot * 1000.0),
        rule(F.col("idle") & (F.col("d") > 1000), F.lit("idle-workers"), F.lit("low"), F.lit(0.2), F.floor(F.col("d") * 0.15)),
        rule(F.col("n_path") > 0, F.lit("critical-path-length"), F.when(F.col("path_ms") / d > 0.6, "high").otherwise("medium"), F.col("path_ms") / d, F.floor(F.col("path_ms") + F.col("path_wait"))),
        rule(F.col("n_path") > 3, F.lit("longest-serial-chain"), F.when(F.col("n_path") > 6, "high").otherwise("medium"), F.lit(0.5), F.floor("path_ms")),
        rule(F.col("often") > 0, F.lit("excessive-retries"), F.lit("high"), F.lit(0.4), F.floor("again_ms")),
        rule(F.col("starved").isNotNull(), F.lit("worker-starvation"), F.lit("medium"), F.lit(0.3), F.floor("starved")),
        rule(F.col("gap") > 1000, F.lit("queue-imbalance"), F.lit("medium"), F.lit(0.2), F.floor("gap")),
    )
    placed = both.select("run_id", F.posexplode(F.sort_array(F.array_compact(found))).alias("place", "x"))
    return placed.select("run_id", (F.col("place") + 1).alias("place"), "x.id", "x.severity", "x.impact", "x.affected_ms")
