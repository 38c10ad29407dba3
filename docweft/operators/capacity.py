"""Run-log analytics for planning: summaries, retention, histories, provider comparison, capacity, forecasts and load advice."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docweft.shared import cut

#: The longest backlog that is accepted, the backlog that is safe, seconds in which a backlog is to be gone, most workers, a task's seconds without measurements.
MAX_BACKLOG, SAFE_BACKLOG, DRAIN_S, MAX_WORKERS, TASK_S = 100, 10, 30.0, 15, 1.5
SATURATED = 9999.0


def triage_log(log: DataFrame, first: int = 5) -> DataFrame:
    """run_id, n_flagged, first_flagged: how many of a run's log lines name a failure, and the first ones, in order of time."""
    lines = log.filter(F.col("status") == "failed").select("run_id", "ts", "event_id", F.concat(F.lit("FAILED event "), "event_id", F.lit(" value "), F.round("value", 2).cast("string")).alias("line"))
    top = lines.withColumn("_r", F.row_number().over(Window.partitionBy("run_id").orderBy("ts", "event_id"))).filter(F.col("_r") <= first)
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_r", "line"))), lambda x: x["line"]), "\n")
    return lines.groupBy("run_id").agg(F.count("*").alias("n_flagged")).join(top.groupBy("run_id").agg(text.alias("first_flagged")), "run_id")


def compact(log: DataFrame, days: int = 7) -> DataFrame:
    """run_id, event_id of the events that stay: telemetry (heartbeats) only of the last `days` days before the newest event, and none of runs whose last event ends them."""
    newest = log.agg(F.max("ts").alias("newest"))
    ended = log.groupBy("run_id").agg(F.max_by("status", F.struct("ts", "event_id")).alias("last")).filter(F.col("last") == "completed").select("run_id")
    kept = log.crossJoin(F.broadcast(newest))  # one row
    kept = kept.join(ended.withColumn("ended", F.lit(True)), "run_id", "left")
    telemetry = F.col("status") == "heartbeat"
    return kept.filter(~telemetry | (F.col("ended").isNull() & (F.col("ts") >= F.col("newest") - F.expr(f"INTERVAL {days} DAYS")))).select("run_id", "event_id")


def events_by(log: DataFrame, category: str, most: int = 100) -> DataFrame:
    """The newest events of each run of a category (a status): run_id, event_id, place. `most` is what a listing shows."""
    newest = F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc("ts"), F.desc("event_id")))
    return log.filter(F.col("status") == category).select("run_id", "event_id", newest.alias("place")).filter(F.col("place") <= most)


def ownership(log: DataFrame) -> DataFrame:
    """run_id, event_id, owner, previous_owner of the events at which a run's owner (the payload's k mod 4) changes."""
    own = Window.partitionBy("run_id").orderBy("ts", "event_id")
    owned = log.filter("status = 'running'").select("run_id", "ts", "event_id", F.concat(F.lit("worker-"), F.get_json_object("payload", "$.k").cast("long") % 4).alias("owner"))
    return owned.withColumn("previous_owner", F.lag("owner").over(own)).filter("owner is not null and (previous_owner is null or previous_owner <> owner)").select("run_id", "event_id", "owner", "previous_owner")


def percentiles(values: DataFrame, by: str, value: str, shares: list[int]) -> DataFrame:
    """`by` and a column p<share> for each share (thousandths): the least whole value that at least that share of a group's values doesn't exceed. Nulls don't count.

    Spans of 2**20 are counted first; only the different values of the span in which a share falls are put in order, so no task holds a group's values.
    """
    span = F.shiftright(value, 20)
    own = values.filter(F.col(value).isNotNull()).select(F.col(by).alias("_by"), F.col(value).alias("v"), span.alias("span"))
    spans = own.groupBy("_by", "span").agg(F.count("*").alias("c"))
    until = lambda *keys: F.sum("c").over(Window.partitionBy("_by", *keys[:-1]).orderBy(keys[-1]))
    each = spans.withColumn("until", until("span")).withColumn("n", F.sum("c").over(Window.partitionBy("_by")))
    wanted = F.explode(F.array(*[F.struct(F.lit(x).alias("share"), F.greatest(F.lit(1), F.expr(f"(n * {x} + 999) div 1000")).alias("k")) for x in shares]))
    hit = each.withColumn("w", wanted).filter("w.k > until - c and w.k <= until").select(F.col("_by").alias("_of"), F.col("span").alias("_span"), "w.share", (F.col("w.k") - F.col("until") + F.col("c")).alias("k"))
    inside = own.join(hit, F.col("_by").eqNullSafe(F.col("_of")) & (F.col("span") == F.col("_span"))).groupBy("_by", "share", "k", "v").agg(F.count("*").alias("c"))
    found = inside.withColumn("until", until("share", "v")).filter("k > until - c and k <= until")
    return found.groupBy(F.col("_by").alias(by)).agg(*[F.max(F.when(F.col("share") == x, F.col("v"))).alias(f"p{x}") for x in shares])


def provider_stats(segments: DataFrame) -> DataFrame:
    """provider, n, success_rate, p50_ms, p90_ms, mean_ms, unfinished: attempts of each worker, latencies of successful ones only. Percentiles are exact."""
    segments = cut(segments.select(F.col("worker").alias("provider"), "outcome", "duration_ms"))
    good = F.col("outcome") == "completed"
    ranks = percentiles(segments.filter(good), "provider", "duration_ms", [500, 900]).withColumnRenamed("provider", "_of")
    means = segments.groupBy("provider").agg(F.count("*").alias("n"), F.round(F.avg(good.cast("double")), 6).alias("success_rate"), F.round(F.avg(F.when(good, F.col("duration_ms"))), 2).alias("mean_ms"), F.count_if(F.col("outcome") == "open").alias("unfinished"))
    both = means.join(ranks, F.col("provider").eqNullSafe(F.col("_of")), "left")
    return both.select("provider", "n", "success_rate", F.col("p500").alias("p50_ms"), F.col("p900").alias("p90_ms"), "mean_ms", "unfinished")


def perf_summary(segments: DataFrame) -> DataFrame:
    """run_id, attempts, wait_ms, execution_ms, retry_ms, their percentages of the span from first wait to last end, longest attempt.

    segments: run_id, attempt, wait_ms, duration_ms; retries are the attempts after the first.
    """
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    each = segments.select("run_id", "attempt", zero("wait_ms").alias("w"), zero("duration_ms").alias("x"))
    a = each.groupBy("run_id").agg(F.count("*").alias("attempts"), F.sum("w").alias("wait_ms"), F.sum("x").alias("execution_ms"), F.sum(F.when(F.col("attempt") > 1, F.col("x")).otherwise(0)).alias("retry_ms"), F.max(F.struct("x", -F.col("attempt"))).alias("m"))
    whole = F.greatest(F.col("wait_ms") + F.col("execution_ms"), F.lit(1))
    return a.select("run_id", "attempts", "wait_ms", "execution_ms", "retry_ms", *[F.round(F.col(f"{c}_ms") * 100.0 / whole, 2).alias(f"{c}_pct") for c in ("wait", "execution", "retry")], (-F.col("m")["col2"]).alias("longest_attempt"))


def capacity(log: DataFrame, workers: int = 4) -> DataFrame:
    """hour, backlog, arrivals and task seconds, and what follows: recommended workers, to start or stop, seconds to drain, to recover, to saturate.

    Per hour of the log: the backlog is what was queued until its end less what was started; sums by hour come first, so that the
    running sum goes over hours. A drain that never ends is 9999; no saturation is null.
    """
    hour = F.date_trunc("hour", "ts")
    n = lambda s: F.count_if(F.col("status") == s)
    by = log.groupBy(hour.alias("hour")).agg(n("queued").alias("queued"), n("running").alias("started"), n("completed").alias("completed"), F.round(F.coalesce(F.avg(F.when(F.col("status") == "completed", F.col("value"))), F.lit(0.0)), 4).alias("task_s"))
    until = Window.orderBy("hour").rowsBetween(Window.unboundedPreceding, 0)  # one row an hour
    m = by.withColumn("backlog", F.greatest(F.sum(F.col("queued") - F.col("started")).over(until), F.lit(0)))
    m = m.withColumn("rate", F.col("queued") / 3600.0).withColumn("task_s", F.when(F.col("task_s") == 0, TASK_S).otherwise(F.col("task_s")))
    wanted = F.ceil(F.round(F.col("rate") * F.col("task_s") + F.col("backlog") * F.col("task_s") / DRAIN_S, 6))
    m = m.withColumn("recommended", F.when((F.col("backlog") == 0) & (F.col("rate") == 0), 0).otherwise(F.greatest(F.lit(1), F.least(F.lit(MAX_WORKERS), wanted))).cast("int"))

    cents = lambda c: F.floor(c * 100.0 + 0.5) / 100.0

    def drain(crew, tasks):
        net = crew / F.col("task_s") - F.col("rate")
        return cents(F.when(tasks <= 0, 0.0).when(net > 0, tasks / net).otherwise(SATURATED))

    growth = (F.col("queued") - F.col("started")) / 3600.0
    return m.select(
        "hour", "backlog", F.round("rate", 6).alias("rate"), "task_s", "recommended",
        F.greatest(F.col("recommended") - workers, F.lit(0)).alias("start"), F.greatest(workers - F.col("recommended"), F.lit(0)).alias("stop"),
        drain(F.lit(float(workers)), F.col("backlog")).alias("drain_s"), drain(F.col("recommended").cast("double"), F.col("backlog")).alias("drain_after_s"),
        drain(F.lit(float(workers)), F.col("backlog") - SAFE_BACKLOG).alias("recovery_s"),
        F.when((growth > 0) & (F.col("backlog") < MAX_BACKLOG), cents((MAX_BACKLOG - F.col("backlog")) / growth)).alias("saturation_s"),
    )


def run_forecast(tasks: DataFrame, done_share: float = 0.5) -> DataFrame:
    """run_id, n_tasks, n_done, progress, remaining, critical_remaining, sla: what is left of each run when its first tasks are done.

    tasks: run_id, task_no, weight; tasks run in order. remaining is the weight of the rest; critical_remaining its largest task;
    sla is `on_track` if no more is left than was done, else `at_risk`.
    """
    n = Window.partitionBy("run_id")
    marked = tasks.withColumn("done", F.col("task_no") <= F.floor(F.count("*").over(n) * done_share))
    rest = F.when(~F.col("done"), F.col("weight")).otherwise(0.0)
    a = marked.groupBy("run_id").agg(F.count("*").alias("n_tasks"), F.count_if("done").alias("n_done"), F.round(F.sum(rest), 4).alias("remaining"), F.round(F.max(rest), 4).alias("critical_remaining"), F.round(F.sum(F.col("weight") - rest), 4).alias("spent"))
    return a.select("run_id", "n_tasks", "n_done", F.round(F.col("n_done") / F.col("n_tasks"), 4).alias("progress"), "remaining", "critical_remaining", F.when(F.col("remaining") <= F.col("spent"), "on_track").otherwise("at_risk").alias("sla"))


def load_advice(segments: DataFrame) -> DataFrame:
    """worker, n, busy_ms, share of all work, advice: overloaded above 1.25 of the mean, idle below 0.75, retry_hotspot if over 30 % failed, else balanced."""
    a = segments.groupBy("worker").agg(F.count("*").alias("n"), F.sum(F.coalesce("duration_ms", F.lit(0))).cast("long").alias("busy_ms"), F.avg((F.col("outcome") == "failed").cast("double")).alias("failed"))
    every = Window.partitionBy()  # one row a worker
    mean = F.avg("busy_ms").over(every)
    advice = F.when(F.col("failed") > 0.3, "retry_hotspot").when(F.col("busy_ms") > mean * 1.25, "overloaded").when(F.col("busy_ms") < mean * 0.75, "idle").otherwise("balanced")
    return a.select("worker", "n", "busy_ms", F.round(F.col("busy_ms") / F.greatest(F.sum("busy_ms").over(every), F.lit(1)), 6).alias("share"), advice.alias("advice"))
