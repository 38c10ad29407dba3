"""Run-log analytics. A log: run_id, event_id, ts, status, value, payload. Times are in UTC; nothing asks for the time of day."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Statuses by event type, and the category of each status.
STATUS = {"signup": "queued", "view": "running", "click": "heartbeat", "purchase": "completed", "error": "failed"}
CATEGORY = {"queued": "queue", "running": "execution", "heartbeat": "worker", "completed": "execution", "failed": "recovery"}
MAX_PAYLOAD = 1 << 20


def lookup(col: Column, table: dict[str, str]) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), col)


def log(events: DataFrame) -> DataFrame:
    """The events table as a run log: a user is a run."""
    return events.select(F.col("user_id").alias("run_id"), "event_id", "ts", lookup(F.col("event_type"), STATUS).alias("status"), "value", F.col("props").alias("payload"))


def millis(ts: Column | str) -> Column:
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.timestamp_diff("MILLISECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def validate(events: DataFrame) -> DataFrame:
    """event_id, reason (null if valid): unknown type, missing run or time, value below 1, payload no JSON object or too large."""
    reason = (
        F.when(lookup(F.col("event_type"), STATUS).isNull(), "unknown_type")
        .when(F.col("user_id").isNull() | F.col("ts").isNull(), "missing_field")
        .when(F.col("value") < 1.0, "value_out_of_range")
        .when(F.length("props") > MAX_PAYLOAD, "payload_too_large")
        .when(F.get_json_object("props", "$.k").isNull(), "payload_without_k")
    )
    return events.select("event_id", reason.alias("reason"))


def classify(log: DataFrame) -> DataFrame:
    return log.select("event_id", "status", lookup(F.col("status"), CATEGORY).alias("category"))


def dedupe(log: DataFrame) -> DataFrame:
    """The first event of each idempotency key: run, status, time, value and payload; a retried send repeats them under a later id."""
    first = Window.partitionBy("run_id", "status", "ts", "value", "payload").orderBy("event_id")
    return log.withColumn("_r", F.row_number().over(first)).filter("_r = 1").drop("_r")


def state(log: DataFrame, until_event: int | None = None) -> DataFrame:
    """The state of each run after its events up to one: status of the last event that isn't a heartbeat, counts, progress."""
    seen = log if until_event is None else log.filter(F.col("event_id") <= until_event)
    last = F.max_by("status", F.when(F.col("status") != "heartbeat", F.col("event_id")))
    return seen.groupBy("run_id").agg(
        F.coalesce(last, F.lit("unknown")).alias("status"),
        F.max("event_id").alias("last_event"),
        F.count_if(F.col("status") == "completed").alias("completed"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.round(F.sum(F.when(F.col("status") == "completed", F.col("value")).otherwise(0.0)), 2).alias("work_done"),
    )


def first_half(log: DataFrame) -> DataFrame:
    """The events up to half of the largest event_id: an as-of point that moves with the log."""
    point = log.agg(F.floor(F.max("event_id") / 2).alias("_point"))  # one row
    return log.join(F.broadcast(point), F.col("event_id") <= F.col("_point")).drop("_point")


def second_half(log: DataFrame) -> DataFrame:
    """The events after those of first_half."""
    point = log.agg(F.floor(F.max("event_id") / 2).alias("_point"))  # one row
    return log.join(F.broadcast(point), F.col("event_id") > F.col("_point")).drop("_point")


def until_middle(log: DataFrame) -> DataFrame:
    """The events up to the middle of the log's time: an as-of time that moves with the log."""
    us = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts").cast("timestamp_ntz"))
    timed = log.withColumn("_us", us)
    point = timed.agg(F.expr("(min(_us) + max(_us)) div 2").alias("_point"))  # one row
    return timed.join(F.broadcast(point), F.col("_us") <= F.col("_point")).drop("_us", "_point")


def snapshot(states: DataFrame) -> DataFrame:
    """run_id and the checksum of its state."""
    text = F.concat_ws("|", "status", F.col("last_event").cast("string"), F.col("completed").cast("string"), F.col("failed").cast("string"))
    return states.select("run_id", F.sha2(text, 256).alias("checksum"))


def resume(saved: DataFrame, later: DataFrame) -> DataFrame:
    """States from saved ones and the events after them; equal to a replay of all events."""
    new = state(later).select("run_id", *[F.col(c).alias(f"n_{c}") for c in ("status", "last_event", "completed", "failed", "work_done")])
    both = saved.join(new, "run_id", "full_outer")
    status = F.when(F.coalesce("n_status", F.lit("unknown")) == "unknown", F.coalesce("status", F.lit("unknown"))).otherwise(F.col("n_status"))
    add = lambda c: F.coalesce(c, F.lit(0)) + F.coalesce(f"n_{c}", F.lit(0))
    return both.select("run_id", status.alias("status"), F.coalesce("n_last_event", "last_event").alias("last_event"), add("completed").alias("completed"), add("failed").alias("failed"), F.round(add("work_done"), 2).alias("work_done"))


def timeline(log: DataFrame) -> DataFrame:
    """run_id, seq, event_id, status, offset_ms (from the run's first event), attempt payload filled from the last one known."""
    own = Window.partitionBy("run_id").orderBy("ts", "event_id")
    start = F.first("ts").over(own.rowsBetween(Window.unboundedPreceding, 0))
    correlation = F.last(F.when(F.col("status") == "queued", F.col("event_id")), ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, 0))
    return log.select("run_id", F.row_number().over(own).alias("seq"), "event_id", "status", (millis("ts") - millis(start)).alias("offset_ms"), correlation.alias("correlation_id"))


def run_summary(log: DataFrame) -> DataFrame:
    return log.groupBy("run_id").agg(F.count("*").alias("events"), F.countDistinct("status").alias("statuses"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), (millis(F.max("ts")) - millis(F.min("ts"))).alias("duration_ms"))


def attempts(log: DataFrame) -> DataFrame:
    """Attempts: a queued event opens one and closes an unfinished one as failed; the first completed or failed event ends it.

    run_id, attempt, queued_ms, started_ms, ended_ms (since 1970), outcome.
    """
    own = Window.partitionBy("run_id").orderBy("ts", "event_id")
    marked = log.withColumn("attempt", F.sum(F.when(F.col("status") == "queued", 1).otherwise(0)).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    at = lambda *s: F.min(F.when(F.col("status").isin(*s), millis("ts")))
    end = F.min(F.when(F.col("status").isin("completed", "failed"), F.struct(millis("ts").alias("ms"), "event_id", "status")))
    each = marked.filter("attempt > 0").groupBy("run_id", "attempt").agg(at("queued").alias("queued_ms"), at("running").alias("started_ms"), end.alias("e"))
    newest = F.max("attempt").over(Window.partitionBy("run_id"))
    outcome = F.coalesce(F.col("e.status"), F.when(F.col("attempt") < newest, "failed").otherwise("open"))
    return each.select("run_id", "attempt", "queued_ms", "started_ms", F.col("e.ms").alias("ended_ms"), outcome.alias("outcome"))


def segments(attempts: DataFrame, workers: int = 8) -> DataFrame:
    """run_id, attempt, worker, lane, wait_ms, duration_ms, outcome. A worker is the run's number mod `workers`."""
    worker = (F.col("run_id") % workers).cast("int")
    lane = F.dense_rank().over(Window.partitionBy("run_id").orderBy("attempt"))
    return attempts.select("run_id", "attempt", worker.alias("worker"), lane.alias("lane"), (F.col("started_ms") - F.col("queued_ms")).alias("wait_ms"), (F.col("ended_ms") - F.col("started_ms")).alias("duration_ms"), "outcome")


def worker_stats(segments: DataFrame) -> DataFrame:
    good = F.when(F.col("duration_ms") > 0, F.col("duration_ms")).otherwise(0)
    return segments.groupBy("worker").agg(F.count("*").alias("attempts"), F.sum(good).alias("busy_ms"), F.count_if(F.col("outcome") == "failed").alias("failures"), F.count_if(F.col("attempt") > 1).alias("retries"))


def distribution(df: DataFrame, by: str, col: str) -> DataFrame:
    """count, missing, min, max, mean, median, p95, p99 (between neighbours), standard deviation of the population; 4 dp."""
    c = F.col(col).cast("double")
    p = lambda q: F.round(F.percentile(c, F.lit(q)), 4)
    return df.groupBy(by).agg(F.count(c).alias("n"), F.count_if(c.isNull()).alias("missing"), F.min(c).alias("min"), F.max(c).alias("max"), F.round(F.avg(c), 4).alias("mean"), p(0.5).alias("median"), p(0.95).alias("p95"), p(0.99).alias("p99"), F.round(F.stddev_pop(c), 4).alias("sd"))


def rolling_rates(log: DataFrame, seconds: tuple[int, ...] = (600, 1800, 3600)) -> DataFrame:
    """event_id and, for each window, the events of the last so many seconds in the same hash shard of runs.

    Time is cut into spans as long as the longest window; each event is also put into the span after its own, so that a
    window never looks beyond its span, and spans, not shards, are what tasks share.
    """
    span = max(seconds) * 1000
    each = log.select("event_id", (F.col("run_id") % 16).alias("shard"), millis("ts").alias("ms")).withColumn("k", F.explode(F.array(F.lit(0), F.lit(1))))
    each = each.withColumn("span", F.floor(F.col("ms") / span) + F.col("k"))
    own = Window.partitionBy("shard", "span").orderBy("ms")
    counted = each.select("event_id", "k", *[F.count("*").over(own.rangeBetween(-s * 1000, 0)).alias(f"last_{s}s") for s in seconds])
    return counted.filter("k = 0").drop("k")


def recovery_delay(log: DataFrame) -> DataFrame:
    """Each failure with the run's next running event: run_id, failed_event, delay_ms."""
    own = Window.partitionBy("run_id").orderBy("ts", "event_id")
    following = F.first(F.when(F.col("status") == "running", millis("ts")), ignorenulls=True).over(own.rowsBetween(1, Window.unboundedFollowing))
    return log.select("run_id", F.col("event_id").alias("failed_event"), "status", (following - millis("ts")).alias("delay_ms")).filter("status = 'failed' and delay_ms is not null").drop("status")


def reliability(log: DataFrame) -> DataFrame:
    """100, less 10 for each failure, 15 for a storm (three failures in an hour) and 20 without a completion; 0 at least."""
    own = Window.partitionBy("run_id").orderBy("ms")
    failed = log.filter("status = 'failed'").withColumn("ms", millis("ts"))
    storms = failed.withColumn("c", F.count("*").over(own.rangeBetween(-3_600_000, 0))).groupBy("run_id").agg(F.count("*").alias("failures"), (F.max("c") >= 3).alias("storm"))
    done = log.groupBy("run_id").agg(F.count_if(F.col("status") == "completed").alias("completions"))
    both = done.join(storms, "run_id", "left").fillna({"failures": 0, "storm": False})
    score = F.lit(100) - F.col("failures") * 10 - F.when(F.col("storm"), 15).otherwise(0) - F.when(F.col("completions") == 0, 20).otherwise(0)
    return both.select("run_id", "failures", "storm", "completions", F.greatest(score, F.lit(0)).cast("long").alias("score"))


def health(log: DataFrame) -> DataFrame:
    """Each day's class by backlog (queued less ended) and share of failures."""
    days = log.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count_if(F.col("status") == "queued").alias("queued"), F.count_if(F.col("status").isin("completed", "failed")).alias("ended"), F.count_if(F.col("status") == "failed").alias("failed"))
    backlog, share = F.col("queued") - F.col("ended"), F.col("failed") / F.greatest(F.col("ended"), F.lit(1))
    kind = F.when(backlog > 20, "critical").when((backlog > 0) | (share > 0.6), "saturated").when(share > 0.5, "degraded").otherwise("healthy")
    return days.select("day", backlog.alias("backlog"), F.round(share, 4).alias("failed_share"), kind.alias("health"))


def ewma(log: DataFrame, alpha: float = 0.15, providers: int = 10) -> DataFrame:
    """Exponentially weighted success of each provider (run mod `providers`), from 100: a fold written as a weighted sum."""
    ended = log.filter("status in ('completed', 'failed')").withColumn("provider", F.col("run_id") % providers).withColumn("day", F.to_date("ts"))
    # How many are newer: those of later days, counted by day, and those of its own day.
    days = ended.groupBy("provider", "day").agg(F.count("*").alias("c"))
    newer = days.select("provider", "day", F.coalesce(F.sum("c").over(Window.partitionBy("provider").orderBy(F.desc("day")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("newer"))
    back = F.row_number().over(Window.partitionBy("provider", "day").orderBy(F.desc("ts"), F.desc("event_id"))) + F.col("newer")
    x = F.when(F.col("status") == "completed", 100.0).otherwise(0.0)
    weighed = ended.join(newer, ["provider", "day"]).withColumn("r", back).withColumn("w", alpha * F.pow(F.lit(1 - alpha), F.col("r") - 1) * x)
    return weighed.groupBy("provider").agg(F.count("*").alias("n"), F.round(F.sum("w") + 100.0 * F.pow(F.lit(1 - alpha), F.count("*")), 4).alias("score"))


def rate_limit(requests: DataFrame, most: int = 60, seconds: int = 60) -> DataFrame:
    """client, event_id, allowed. A request is refused if `most` allowed ones lie within the last `seconds`; refused ones don't count.

    requests: client, event_id, ts. The decision depends on earlier decisions, so each client's requests go through one fold:
    they are sorted by Spark, which can spill, and read as a stream of batches; only the allowed times within reach are held.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from collections import deque

        client, held = None, deque()
        for rows in batches:
            allowed = []
            for own, nobody, ms in zip(rows["client"], rows["nobody"], rows["ms"], strict=True):
                if (own, nobody) != client:
                    client, held = (own, nobody), deque()
                while held and ms - held[0] >= seconds * 1000:
                    held.popleft()
                allowed.append(len(held) < most)
                if allowed[-1]:
                    held.append(ms)
            yield rows[["client", "nobody", "event_id"]].assign(allowed=allowed)

    # A null client is a client; nulls are marked, so that pandas keeps the ids whole.
    each = requests.select(F.coalesce("client", F.lit(0)).cast("long").alias("client"), F.col("client").isNull().alias("nobody"), "event_id", millis("ts").alias("ms"))
    dealt = each.repartition("client", "nobody").sortWithinPartitions("client", "nobody", F.asc_nulls_last("ms"), "event_id")
    folded = dealt.mapInPandas(fold, "client long, nobody boolean, event_id long, allowed boolean")
    return folded.select(F.when(~F.col("nobody"), F.col("client")).alias("client"), "event_id", "allowed")


def rates_by_minute(log: DataFrame, minutes: int = 60) -> DataFrame:
    bucket = F.window("ts", f"{minutes} minutes")
    c = log.groupBy(bucket.alias("w")).agg(F.count("*").alias("requests"), F.round(F.sum("value"), 2).alias("load"), F.count_if(F.col("status") == "failed").alias("failures"))
    share = F.col("failures") / F.col("requests")
    pace = F.when(share > 0.5, 4.0).when(share > 0.3, 2.0).when(share > 0.1, 1.5).otherwise(1.0)
    return c.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "requests", "load", "failures", pace.alias("pacing"))


def fairness(log: DataFrame) -> DataFrame:
    """Jain's index over the runs' work, and the number of runs."""
    each = log.groupBy("run_id").agg(F.sum("value").alias("x"))
    return each.agg(F.count("*").alias("runs"), F.round(F.pow(F.sum("x"), F.lit(2.0)) / (F.count("*") * F.sum(F.col("x") * F.col("x"))), 6).alias("jain"))


def root_cause(log: DataFrame) -> DataFrame:
    """Of each run that didn't complete last: the first failure after its last completion, else a stall."""
    last = log.groupBy("run_id").agg(F.coalesce(F.max(F.when(F.col("status") == "completed", F.col("event_id"))), F.lit(-1)).alias("good"), F.max("event_id").alias("last_event"))
    after = log.join(last, "run_id").filter(F.col("event_id") > F.col("good"))
    cause = after.groupBy("run_id").agg(F.min(F.when(F.col("status") == "failed", F.col("event_id"))).alias("cause_event"), F.count_if(F.col("status") == "queued").alias("retries"))
    return cause.select("run_id", F.when(F.col("cause_event").isNotNull(), "failure").otherwise("stall").alias("cause"), "cause_event", "retries")


def bottlenecks(segments: DataFrame) -> DataFrame:
    """Workers whose mean wait or failure share stands out: rule, worker, value, severity."""
    stats = segments.groupBy("worker").agg(F.avg("wait_ms").alias("wait"), F.avg(F.when(F.col("outcome") == "failed", 1.0).otherwise(0.0)).alias("failed"))
    rules = F.array(
        F.struct(F.lit("slow_queue").alias("rule"), F.round(F.col("wait") / 1000.0, 3).alias("value"), F.lit(20_000.0).alias("least"), F.lit(60_000.0).alias("high")),
        F.struct(F.lit("failures").alias("rule"), F.round("failed", 4).alias("value"), F.lit(0.4).alias("least"), F.lit(0.6).alias("high")),
    )
    each = stats.select("worker", F.explode(rules).alias("r")).select("worker", "r.*").filter("value >= least")
    return each.select("rule", "worker", "value", F.when(F.col("value") >= F.col("high"), "high").otherwise("medium").alias("severity"))


def tasks(lines: DataFrame) -> DataFrame:
    """Task graphs of orders: run_id, task_no (1, 2, ...), weight, parents. Task n depends on n // 2 and, if 3 divides n, on n - 1."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    n = lines.select(F.col("l_orderkey").alias("run_id"), F.row_number().over(order).alias("task_no"), F.col("l_quantity").cast("double").alias("weight"), F.col("l_linestatus").alias("line_status"))
    parents = F.array_distinct(F.filter(F.array(F.floor(F.col("task_no") / 2).cast("int"), F.when(F.col("task_no") % 3 == 0, F.col("task_no") - 1).otherwise(0)), lambda p: p > 0))
    return n.withColumn("parents", parents)


def critical_path(tasks: DataFrame) -> DataFrame:
    """run_id, n_tasks, length (the heaviest path), total. Parents come before their tasks, so one pass in order finds all finish times."""
    each = tasks.groupBy("run_id").agg(F.sort_array(F.collect_list(F.struct("task_no", "weight", "parents"))).alias("t"), F.sum("weight").alias("total"))
    done = F.aggregate("t", F.array().cast("array<double>"), lambda acc, t: F.array_append(acc, t["weight"] + F.coalesce(F.array_max(F.transform(t["parents"], lambda p: F.get(acc, p - 1))), F.lit(0.0))))
    return each.select("run_id", F.size("t").alias("n_tasks"), F.round(F.array_max(done), 2).alias("length"), F.round("total", 2).alias("total"))


def releasable(tasks: DataFrame) -> DataFrame:
    """Tasks that aren't done (status F is done) and whose parents all are: run_id, task_no."""
    edges = tasks.select("run_id", "task_no", "line_status", F.explode_outer("parents").alias("p"))
    parents = tasks.select("run_id", F.col("task_no").alias("p"), (F.col("line_status") == "F").alias("done"))
    met = edges.filter("line_status <> 'F'").join(parents, ["run_id", "p"], "left").groupBy("run_id", "task_no").agg(F.bool_and(F.coalesce("done", F.lit(True))).alias("ready"))
    return met.filter("ready").drop("ready")


def lineage(tasks: DataFrame) -> DataFrame:
    """Edges parent task -> child task, by way of the parent's artifact if it is done: run_id, source, target, kind."""
    edges = tasks.select("run_id", "task_no", F.explode("parents").alias("p"))
    both = edges.join(tasks.select("run_id", F.col("task_no").alias("p"), (F.col("line_status") == "F").alias("made")), ["run_id", "p"])
    name = lambda kind, n: F.concat_ws("-", F.lit(kind), F.col(n))
    direct = both.filter("not made").select("run_id", name("task", "p").alias("source"), name("task", "task_no").alias("target"), F.lit("direct").alias("kind"))
    made = both.filter("made").select("run_id", name("task", "p").alias("source"), name("artifact", "p").alias("target"), F.lit("produces").alias("kind"))
    used = both.filter("made").select("run_id", name("artifact", "p").alias("source"), name("task", "task_no").alias("target"), F.lit("feeds").alias("kind"))
    return direct.unionByName(made).unionByName(used).distinct()


def replay_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """What one log has and the other hasn't, repeats counted: side, and the columns."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, user_turns, last_turn, last_role, session order (latest conversations have the highest turn count first)."""
    return conversations.groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.count_if(F.col("role") == "user").alias("user_turns"), F.max("turn").alias("last_turn"), F.max_by("role", "turn").alias("last_role"))


def session_state(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, n_words_so_far, n_questions_so_far: what a session has gathered by each turn."""
    own = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^ \t\n]+"))
    return conversations.select("conv_id", "turn", F.sum(words).over(own).alias("n_words_so_far"), F.count_if(F.col("role") == "user").over(own).alias("n_questions_so_far"))
