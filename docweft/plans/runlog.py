"""Run-log queries, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from docweft.operators import runlog as R
from docweft.plans.text import t


def log(s, d):
    return R.log(t(s, d, "events"))


def seg(s, d):
    return R.segments(R.attempts(log(s, d)))


def tasks(s, d):
    return R.tasks(t(s, d, "lineitem"))


CASES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in R.STATUS.items())
LOG = f"WITH log AS (SELECT user_id AS run_id, event_id, ts, CASE event_type {CASES} END AS status, value, props AS payload FROM events)"
CATS = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in R.CATEGORY.items())
STATE = """SELECT run_id, coalesce(arg_max(status, CASE WHEN status <> 'heartbeat' THEN event_id END) FILTER (status <> 'heartbeat'), 'unknown') AS status, max(event_id) AS last_event, count(*) FILTER (status = 'completed') AS completed,
  count(*) FILTER (status = 'failed') AS failed, round(sum(CASE WHEN status = 'completed' THEN value ELSE 0.0 END), 2) AS work_done FROM log GROUP BY run_id"""
ATT = LOG + """, m AS (SELECT *, (epoch_us(ts) // 1000) AS ms, sum((status = 'queued')::INTEGER) OVER (PARTITION BY run_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS attempt FROM log),
g AS (SELECT run_id, attempt, min(CASE WHEN status = 'queued' THEN ms END) AS queued_ms, min(CASE WHEN status = 'running' THEN ms END) AS started_ms,
  min(CASE WHEN status IN ('completed', 'failed') THEN ms END) AS ended_ms, arg_min(status, (ms, event_id)) FILTER (status IN ('completed', 'failed')) AS st FROM m WHERE attempt > 0 GROUP BY ALL),
att AS (SELECT run_id, attempt::BIGINT AS attempt, queued_ms, started_ms, ended_ms, coalesce(st, CASE WHEN attempt < max(attempt) OVER (PARTITION BY run_id) THEN 'failed' ELSE 'open' END) AS outcome FROM g),
seg AS (SELECT run_id, attempt, (run_id % 8)::INTEGER AS worker, dense_rank() OVER (PARTITION BY run_id ORDER BY attempt)::INTEGER AS lane, started_ms - queued_ms AS wait_ms, ended_ms - started_ms AS duration_ms, outcome FROM att) """
TASKS = """WITH RECURSIVE n AS (SELECT l_orderkey AS run_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate)::INTEGER AS task_no, l_quantity::DOUBLE AS weight, l_linestatus AS line_status FROM lineitem),
e AS (SELECT DISTINCT run_id, task_no, p FROM (SELECT run_id, task_no, task_no // 2 AS p FROM n UNION ALL SELECT run_id, task_no, task_no - 1 FROM n WHERE task_no % 3 = 0) WHERE p > 0)"""


def dist(by, col, source):
    c = f"{col}::DOUBLE"
    return f"""SELECT {by}, count({c}) AS n, count(*) - count({c}) AS missing, min({c}) AS min, max({c}) AS max, round(avg({c}), 4) AS mean, round(quantile_cont({c}, 0.5), 4) AS median,
  round(quantile_cont({c}, 0.95), 4) AS p95, round(quantile_cont({c}, 0.99), 4) AS p99, round(stddev_pop({c}), 4) AS sd FROM {source} GROUP BY {by}"""


QUERIES = {
    "validate_events": (
        lambda s, d: R.validate(t(s, d, "events")),
        f"SELECT event_id, CASE WHEN CASE event_type {CASES} END IS NULL THEN 'unknown_type' WHEN user_id IS NULL OR ts IS NULL THEN 'missing_field' WHEN value < 1.0 THEN 'value_out_of_range' WHEN length(props) > 1048576 THEN 'payload_too_large' WHEN json_extract_string(props, '$.k') IS NULL THEN 'payload_without_k' END AS reason FROM events",
    ),
    "classify_events": (lambda s, d: R.classify(log(s, d)), LOG + f" SELECT event_id, status, CASE status {CATS} END AS category FROM log"),
    "dedupe_events": (
        # every third event is sent twice
        lambda s, d: R.dedupe(log(s, d).unionByName(log(s, d).filter("event_id % 3 = 0").withColumn("event_id", F.col("event_id") + 1_000_000_000))).select("run_id", "event_id", "status"),
        LOG + ", twice AS (SELECT * FROM log UNION ALL SELECT * REPLACE (event_id + 1000000000 AS event_id) FROM log WHERE event_id % 3 = 0) SELECT run_id, event_id, status FROM twice QUALIFY row_number() OVER (PARTITION BY run_id, status, ts, value, payload ORDER BY event_id) = 1",
    ),
    "reconstruct_state": (lambda s, d: R.state(log(s, d)), LOG + STATE),
    "state_as_of": (lambda s, d: R.state(R.until_middle(log(s, d))), LOG.replace("FROM events", "FROM events WHERE epoch_us(ts) <= (SELECT (min(epoch_us(ts)) + max(epoch_us(ts))) // 2 FROM events)") + STATE),
    "state_as_of_half": (lambda s, d: R.state(R.first_half(log(s, d))), LOG.replace("FROM events", "FROM events WHERE event_id <= (SELECT max(event_id) // 2 FROM events)") + STATE),
    "state_checksums": (
        lambda s, d: R.snapshot(R.state(log(s, d))),
        LOG + f", st AS ({STATE}) SELECT run_id, sha256(concat_ws('|', status, last_event::VARCHAR, completed::VARCHAR, failed::VARCHAR)) AS checksum FROM st",
    ),
    "resume_state": (lambda s, d: R.resume(R.state(R.first_half(log(s, d))), R.second_half(log(s, d))), LOG + STATE),
    "timeline": (
        lambda s, d: R.timeline(log(s, d)),
        LOG + """ SELECT run_id, row_number() OVER w AS seq, event_id, status, (epoch_us(ts) // 1000) - (epoch_us(first_value(ts) OVER w) // 1000) AS offset_ms,
  last_value(CASE WHEN status = 'queued' THEN event_id END IGNORE NULLS) OVER (PARTITION BY run_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS correlation_id FROM log WINDOW w AS (PARTITION BY run_id ORDER BY ts, event_id)""",
    ),
    "run_summary": (
        lambda s, d: R.run_summary(log(s, d)),
        LOG + " SELECT run_id, count(*) AS events, count(DISTINCT status) AS statuses, min(ts) AS first_ts, max(ts) AS last_ts, (epoch_us(max(ts)) // 1000) - (epoch_us(min(ts)) // 1000) AS duration_ms FROM log GROUP BY 1",
    ),
    "attempts": (lambda s, d: R.attempts(log(s, d)), ATT + "SELECT * FROM att"),
    "segments": (seg, ATT + "SELECT * FROM seg"),
    "worker_stats": (
        lambda s, d: R.worker_stats(seg(s, d)),
        ATT + "SELECT worker, count(*) AS attempts, sum(CASE WHEN duration_ms > 0 THEN duration_ms ELSE 0 END)::BIGINT AS busy_ms, count(*) FILTER (outcome = 'failed') AS failures, count(*) FILTER (attempt > 1) AS retries FROM seg GROUP BY 1",
    ),
    "wait_distribution": (lambda s, d: R.distribution(seg(s, d), "worker", "wait_ms"), ATT + dist("worker", "wait_ms", "seg")),
    "value_distribution": (lambda s, d: R.distribution(t(s, d, "events"), "event_type", "value"), dist("event_type", "value", "events")),
    "rolling_rates": (
        lambda s, d: R.rolling_rates(log(s, d)),
        LOG + " SELECT event_id, " + ", ".join(f"count(*) OVER (PARTITION BY run_id % 16 ORDER BY (epoch_us(ts) // 1000) RANGE BETWEEN {x}000 PRECEDING AND CURRENT ROW) AS last_{x}s" for x in (600, 1800, 3600)) + " FROM log",
    ),
    "recovery_delay": (
        lambda s, d: R.recovery_delay(log(s, d)),
        LOG + """, x AS (SELECT *, (epoch_us(ts) // 1000) AS ms, first_value(CASE WHEN status = 'running' THEN (epoch_us(ts) // 1000) END IGNORE NULLS) OVER (PARTITION BY run_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nx FROM log)
SELECT run_id, event_id AS failed_event, nx - ms AS delay_ms FROM x WHERE status = 'failed' AND nx IS NOT NULL""",
    ),
    "reliability": (
        lambda s, d: R.reliability(log(s, d)),
        LOG + """, f AS (SELECT run_id, count(*) OVER (PARTITION BY run_id ORDER BY (epoch_us(ts) // 1000) RANGE BETWEEN 3600000 PRECEDING AND CURRENT ROW) AS c FROM log WHERE status = 'failed'),
s AS (SELECT run_id, count(*) AS failures, max(c) >= 3 AS storm FROM f GROUP BY 1), g AS (SELECT run_id, count(*) FILTER (status = 'completed') AS completions FROM log GROUP BY 1)
SELECT run_id, coalesce(failures, 0) AS failures, coalesce(storm, false) AS storm, completions, greatest(100 - coalesce(failures, 0) * 10 - CASE WHEN coalesce(storm, false) THEN 15 ELSE 0 END - CASE WHEN completions = 0 THEN 20 ELSE 0 END, 0)::BIGINT AS score FROM g LEFT JOIN s USING (run_id)""",
    ),
    "health_by_day": (
        lambda s, d: R.health(log(s, d)),
        LOG + """, g AS (SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) FILTER (status = 'queued') - count(*) FILTER (status IN ('completed', 'failed')) AS backlog, count(*) FILTER (status = 'failed')::DOUBLE / greatest(count(*) FILTER (status IN ('completed', 'failed')), 1) AS sh FROM log GROUP BY 1)
SELECT day, backlog, round(sh, 4) AS failed_share, CASE WHEN backlog > 20 THEN 'critical' WHEN backlog > 0 OR sh > 0.6 THEN 'saturated' WHEN sh > 0.5 THEN 'degraded' ELSE 'healthy' END AS health FROM g""",
    ),
    "provider_health": (
        lambda s, d: R.ewma(log(s, d)),
        LOG + """, x AS (SELECT run_id % 10 AS provider, status, row_number() OVER (PARTITION BY run_id % 10 ORDER BY ts DESC, event_id DESC) AS r FROM log WHERE status IN ('completed', 'failed'))
SELECT provider, count(*) AS n, round(sum(0.15 * pow(0.85, r - 1) * CASE WHEN status = 'completed' THEN 100.0 ELSE 0.0 END) + 100.0 * pow(0.85, count(*)), 4) AS score FROM x GROUP BY 1""",
    ),
    "rate_limit": (lambda s, d: R.rate_limit(t(s, d, "events").select(F.col("user_id").alias("client"), "event_id", "ts"), most=3, seconds=7200), None),
    "rates_by_hour": (
        lambda s, d: R.rates_by_minute(log(s, d)),
        LOG + """, g AS (SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS requests, round(sum(value), 2) AS load, count(*) FILTER (status = 'failed') AS failures FROM log GROUP BY 1)
SELECT *, (CASE WHEN failures::DOUBLE / requests > 0.5 THEN 4.0 WHEN failures::DOUBLE / requests > 0.3 THEN 2.0 WHEN failures::DOUBLE / requests > 0.1 THEN 1.5 ELSE 1.0 END)::DOUBLE AS pacing FROM g""",
    ),
    "fairness": (lambda s, d: R.fairness(log(s, d)), LOG + ", g AS (SELECT run_id, sum(value) AS x FROM log GROUP BY 1) SELECT count(*) AS runs, round(pow(sum(x), 2) / (count(*) * sum(x * x)), 6) AS jain FROM g"),
    "root_cause": (
        lambda s, d: R.root_cause(log(s, d)),
        LOG + """, l AS (SELECT run_id, coalesce(max(CASE WHEN status = 'completed' THEN event_id END), -1) AS good FROM log GROUP BY 1),
g AS (SELECT run_id, min(CASE WHEN status = 'failed' THEN event_id END) AS cause_event, count(*) FILTER (status = 'queued') AS retries FROM log JOIN l USING (run_id) WHERE event_id > good GROUP BY 1)
SELECT run_id, CASE WHEN cause_event IS NOT NULL THEN 'failure' ELSE 'stall' END AS cause, cause_event, retries FROM g""",
    ),
    "bottlenecks": (
        lambda s, d: R.bottlenecks(seg(s, d)),
        ATT + """, w AS (SELECT worker, avg(wait_ms) AS wait, avg(CASE WHEN outcome = 'failed' THEN 1.0 ELSE 0.0 END) AS failed FROM seg GROUP BY 1),
r AS (SELECT 'slow_queue' AS rule, worker, round(wait / 1000.0, 3) AS value, 20000.0 AS least, 60000.0 AS high FROM w UNION ALL SELECT 'failures', worker, round(failed, 4), 0.4, 0.6 FROM w)
SELECT rule, worker, value, CASE WHEN value >= high THEN 'high' ELSE 'medium' END AS severity FROM r WHERE value >= least""",
    ),
    "critical_path": (
        lambda s, d: R.critical_path(tasks(s, d)),
        TASKS + """, f AS (SELECT run_id, task_no, weight AS len FROM n UNION ALL SELECT f.run_id, e.task_no, f.len + n.weight FROM f JOIN e ON e.run_id = f.run_id AND e.p = f.task_no JOIN n ON n.run_id = e.run_id AND n.task_no = e.task_no),
m AS (SELECT run_id, max(len) AS len FROM f GROUP BY 1) SELECT run_id, count(*)::INTEGER AS n_tasks, round(any_value(len), 2) AS length, round(sum(weight), 2) AS total FROM n JOIN m USING (run_id) GROUP BY run_id""",
    ),
    "releasable_tasks": (
        lambda s, d: R.releasable(tasks(s, d)),
        TASKS + " SELECT run_id, task_no FROM n WHERE line_status <> 'F' AND NOT EXISTS (SELECT 1 FROM e JOIN n q ON q.run_id = e.run_id AND q.task_no = e.p WHERE e.run_id = n.run_id AND e.task_no = n.task_no AND q.line_status <> 'F')",
    ),
    "lineage": (
        lambda s, d: R.lineage(tasks(s, d)),
        TASKS + """, b AS (SELECT e.*, q.line_status = 'F' AS made FROM e JOIN n q ON q.run_id = e.run_id AND q.task_no = e.p)
SELECT DISTINCT run_id, 'task-' || p AS source, 'task-' || task_no AS target, 'direct' AS kind FROM b WHERE NOT made UNION SELECT run_id, 'task-' || p, 'artifact-' || p, 'produces' FROM b WHERE made UNION SELECT run_id, 'artifact-' || p, 'task-' || task_no, 'feeds' FROM b WHERE made""",
    ),
    "replay_diff": (
        # the log against its first half with all failures sent again
        lambda s, d: R.replay_diff(log(s, d).select("run_id", "status"), R.first_half(log(s, d)).unionByName(log(s, d).filter("status = 'failed'")).select("run_id", "status")).groupBy("side", "status").agg(F.count("*").alias("n")),
        LOG + """, a AS (SELECT run_id, status FROM log), b AS (SELECT run_id, status FROM log WHERE event_id <= (SELECT max(event_id) // 2 FROM log) UNION ALL SELECT run_id, status FROM log WHERE status = 'failed')
SELECT 'left' AS side, status, count(*) AS n FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) GROUP BY ALL UNION ALL SELECT 'right', status, count(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a) GROUP BY ALL""",
    ),
    "conversation_turns": (
        lambda s, d: R.turns(t(s, d, "conversations")),
        "SELECT conv_id, count(*) AS n_turns, count(*) FILTER (role = 'user') AS user_turns, max(turn) AS last_turn, arg_max(role, turn) AS last_role FROM conversations GROUP BY 1",
    ),
    "session_state": (
        lambda s, d: R.session_state(t(s, d, "conversations")),
        r"SELECT conv_id, turn, sum(len(regexp_extract_all(coalesce(text, ''), '[^ \t\n]+'))) OVER w::BIGINT AS n_words_so_far, count(*) FILTER (role = 'user') OVER w AS n_questions_so_far FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)",
    ),
}
