"""Queries over task graphs of any shape, each with its SQL. An order is a run, its lines are tasks under shuffled numbers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docweft.operators import dag as D
from docweft.plans.text import t

#: Task n of a run has the number n * SHUFFLED[0] mod SHUFFLED[1], so numbers say nothing about the order of tasks.
SHUFFLED = (5003, 10007)
AGREED_MS = 12_000.0


def number(n):
    return (n * SHUFFLED[0] % SHUFFLED[1]).cast("long")


def lines(s, d):
    own = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    return t(s, d, "lineitem").withColumn("n", F.row_number().over(own).cast("long"))


def tasks(s, d, **more):
    """Stages by return flag, status by discount, times by quantity, attempts by tax."""
    start = (F.col("n") - 1) * 1000.0
    status = F.when(F.col("l_discount") < 0.04, "completed").when(F.col("l_discount") < 0.06, "running").when(F.col("l_discount") < 0.07, "failed").otherwise("pending")
    return lines(s, d).select(
        F.col("l_orderkey").alias("run_id"), number(F.col("n")).alias("task"), F.col("l_returnflag").alias("stage"), F.col("l_quantity").alias("weight"), status.alias("status"), start.alias("start_ms"),
        (F.col("l_quantity") * 100.0).alias("duration_ms"), (start + F.col("l_quantity") * 100.0).alias("end_ms"), (F.col("l_quantity") * 10.0).alias("wait_ms"), (1 + F.round(F.col("l_tax") * 100).cast("int") % 3).alias("attempts"),
        *[c.alias(name) for name, c in more.items()],
    )


def worked(s, d):
    """Tasks with the supplier as worker, and waits by price."""
    own = tasks(s, d, worker=F.col("l_suppkey").cast("string"), waited=F.round(F.col("l_extendedprice") / 10.0))
    return own.drop("wait_ms").withColumnRenamed("waited", "wait_ms")


def edges(s, d):
    """Task n waits for n // 2 and, if 3 divides n, for n - 1. A run's tasks are numbered from 1, so their count tells all of them."""
    n = t(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("run_id")).agg(F.count("*").alias("n"))
    parents = F.filter(F.array(F.floor(F.col("n") / 2), F.when(F.col("n") % 3 == 0, F.col("n") - 1).otherwise(F.lit(0))), lambda p: p > 0)
    each = n.select("run_id", F.explode(F.sequence(F.lit(1), "n")).alias("n"))
    return each.select("run_id", "n", F.explode(parents).alias("p")).select("run_id", number(F.col("p")).alias("parent"), number(F.col("n")).alias("child"))


def looped(s, d):
    """The edges, and for each failed task in stage R one back to what it waits for."""
    failed = tasks(s, d).filter("status = 'failed' and stage = 'R'").select("run_id", F.col("task").alias("child"))
    return edges(s, d).unionByName(edges(s, d).join(failed, ["run_id", "child"], "left_semi").select("run_id", F.col("child").alias("parent"), F.col("parent").alias("child")))


A, M = SHUFFLED
BASE = f"""WITH RECURSIVE g AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS n FROM lineitem),
tk AS (SELECT l_orderkey AS run_id, n * {A} % {M} AS task, l_returnflag AS stage, l_quantity::DOUBLE AS weight, CASE WHEN l_discount < 0.04::DOUBLE THEN 'completed' WHEN l_discount < 0.06::DOUBLE THEN 'running' WHEN l_discount < 0.07::DOUBLE THEN 'failed' ELSE 'pending' END AS status,
  (n - 1) * 1000.0::DOUBLE AS start_ms, l_quantity * 100.0::DOUBLE AS duration_ms, (n - 1) * 1000.0::DOUBLE + l_quantity * 100.0::DOUBLE AS end_ms, l_quantity * 10.0::DOUBLE AS wait_ms, 1 + round(l_tax * 100)::INTEGER % 3 AS attempts FROM g),
e AS (SELECT DISTINCT run_id, p * {A} % {M} AS parent, n * {A} % {M} AS child FROM (SELECT l_orderkey AS run_id, n, n // 2 AS p FROM g UNION ALL SELECT l_orderkey, n, n - 1 FROM g WHERE n % 3 = 0) WHERE p > 0)"""
PATH = """, f AS (SELECT run_id, task, weight AS len, 0 AS depth FROM tk UNION ALL SELECT f.run_id, e.child, f.len + k.weight, f.depth + 1 FROM f JOIN e ON e.run_id = f.run_id AND e.parent = f.task JOIN tk k ON k.run_id = e.run_id AND k.task = e.child),
fin AS (SELECT run_id, task, max(len) AS fin, max(depth) AS depth FROM f GROUP BY ALL),
via AS (SELECT e.run_id, e.child AS task, arg_min(e.parent, (-fin.fin, e.parent)) AS via FROM e JOIN fin ON fin.run_id = e.run_id AND fin.task = e.parent GROUP BY ALL),
walk AS (SELECT run_id, arg_min(task, (-fin, task)) AS task, 0 AS back FROM fin GROUP BY run_id UNION ALL SELECT w.run_id, v.via, w.back + 1 FROM walk w JOIN via v ON v.run_id = w.run_id AND v.task = w.task),
path AS (SELECT w.run_id, (max(w.back) OVER (PARTITION BY w.run_id) - w.back + 1)::INTEGER AS step, w.task, via.via, tk.weight, round(fin.fin, 2) AS finish FROM walk w JOIN fin USING (run_id, task) JOIN tk USING (run_id, task) LEFT JOIN via USING (run_id, task))"""
FORECAST = """, sm AS (SELECT run_id, stage, coalesce(avg(end_ms - start_ms) FILTER (status = 'completed'), 1000.0) AS mean_ms, coalesce(avg(wait_ms) FILTER (status IN ('completed', 'running')), 0.0) AS mean_wait_ms, sum(attempts - 1)::DOUBLE / count(*) AS rate FROM tk GROUP BY ALL),
nw AS (SELECT run_id, coalesce(max(CASE status WHEN 'completed' THEN end_ms WHEN 'running' THEN start_ms END), 0.0)::DOUBLE AS now_ms FROM tk GROUP BY 1),
c AS (SELECT tk.*, mean_ms, mean_wait_ms, now_ms, mean_wait_ms + mean_ms + rate * mean_ms AS length, mean_ms + mean_wait_ms + rate * mean_ms AS rest, status IN ('completed', 'running') AS fixed,
  CASE status WHEN 'completed' THEN end_ms ELSE now_ms + greatest(0.0, mean_ms - (now_ms - start_ms)) END AS told FROM tk JOIN sm USING (run_id, stage) JOIN nw USING (run_id)),
p AS (SELECT run_id, task, CASE WHEN fixed THEN told ELSE now_ms + length END AS fin FROM c WHERE fixed OR NOT EXISTS (SELECT 1 FROM e WHERE e.run_id = c.run_id AND e.child = c.task)
  UNION ALL SELECT p.run_id, c.task, p.fin + c.length FROM p JOIN e ON e.run_id = p.run_id AND e.parent = p.task JOIN c ON c.run_id = e.run_id AND c.task = e.child AND NOT c.fixed),
pe AS (SELECT run_id, task, max(fin) AS fin FROM p GROUP BY ALL),
b AS (SELECT run_id, task, length AS tail FROM c WHERE NOT fixed
  UNION ALL SELECT b.run_id, c.task, b.tail + c.length FROM b JOIN e ON e.run_id = b.run_id AND e.child = b.task JOIN c ON c.run_id = e.run_id AND c.task = e.parent AND NOT c.fixed),
tl AS (SELECT e.run_id, e.parent AS task, max(b.tail) AS tail FROM e JOIN b ON b.run_id = e.run_id AND b.task = e.child GROUP BY ALL),
st AS (SELECT c.run_id, c.task, max(pe.fin) AS ended FROM c LEFT JOIN e ON e.run_id = c.run_id AND e.child = c.task LEFT JOIN pe ON pe.run_id = e.run_id AND pe.task = e.parent GROUP BY ALL)"""
BLOCKED = """, bl AS (SELECT run_id, task AS root, task, 0 AS depth FROM tk WHERE status = 'failed' UNION ALL SELECT bl.run_id, bl.root, e.child, bl.depth + 1 FROM bl JOIN e ON e.run_id = bl.run_id AND e.parent = bl.task JOIN tk k ON k.run_id = e.run_id AND k.task = e.child AND k.status = 'pending'),
cl AS (SELECT run_id, root, task, min(depth)::INTEGER AS depth FROM bl WHERE depth > 0 GROUP BY ALL)"""

QUERIES = {
    "critical_path_edges": (lambda s, d: D.critical_paths(tasks(s, d).select("run_id", "task", "weight"), edges(s, d)), BASE + PATH + " SELECT * FROM path"),
    "flame_spans": (
        lambda s, d: D.spans(tasks(s, d).select("run_id", "task", "start_ms", "duration_ms"), edges(s, d)),
        BASE + PATH + """, fp AS (SELECT run_id, child AS task, min(parent) AS parent FROM e GROUP BY ALL)
SELECT run_id, task, parent, depth, start_ms, duration_ms, row_number() OVER (PARTITION BY run_id ORDER BY start_ms, depth, duration_ms DESC, task)::INTEGER AS place FROM tk JOIN fin USING (run_id, task) LEFT JOIN fp USING (run_id, task)""",
    ),
    "task_forecast": (
        lambda s, d: D.task_forecast(tasks(s, d), edges(s, d)),
        BASE + FORECAST + """ SELECT run_id, task, stage, status, round(CASE WHEN fixed THEN start_ms ELSE coalesce(ended, now_ms) + mean_wait_ms END, 3) AS predicted_start_ms, round(fin, 3) AS predicted_end_ms,
  round(max(fin) OVER (PARTITION BY run_id) - fin - coalesce(tail, 0.0), 3) AS slack_ms FROM c JOIN pe USING (run_id, task) JOIN st USING (run_id, task) LEFT JOIN tl USING (run_id, task)""",
    ),
    "run_outlook": (
        lambda s, d: D.run_outlook(tasks(s, d), edges(s, d), AGREED_MS),
        BASE + PATH + FORECAST + f""", cr AS (SELECT run_id, round(sum(CASE status WHEN 'completed' THEN 0.0 WHEN 'running' THEN greatest(0.0, mean_ms - (now_ms - start_ms)) ELSE rest END), 3) AS critical_remaining_ms FROM path JOIN c USING (run_id, task) GROUP BY run_id),
r AS (SELECT run_id, any_value(now_ms) AS now_ms, round(max(fin), 3) AS finish_ms, count(*) AS n, count(*) FILTER (status = 'completed') AS done, sum(attempts - 1)::DOUBLE / count(*) AS rate, max(mean_wait_ms) AS wait FROM c JOIN pe USING (run_id, task) GROUP BY run_id),
q AS (SELECT *, CASE WHEN done = n THEN 0.0 ELSE round(greatest(0.0, finish_ms - now_ms), 3) END AS remaining_ms, CASE WHEN done = n THEN 100.0 ELSE round(done::DOUBLE / n * 100, 2) END AS progress FROM r),
w AS (SELECT *, 100 - CASE WHEN progress < 30 THEN 20 WHEN progress < 60 THEN 10 ELSE 0 END - CASE WHEN rate > 0.2 THEN 15 ELSE 0 END - CASE WHEN wait > 2000 THEN 15 ELSE 0 END AS trust, ({AGREED_MS} - (now_ms + remaining_ms)) / {AGREED_MS} * 100 AS buffer FROM q)
SELECT run_id, now_ms, finish_ms, remaining_ms::DOUBLE AS remaining_ms, progress::DOUBLE AS progress, critical_remaining_ms, CASE WHEN now_ms + remaining_ms > {AGREED_MS} THEN CASE WHEN now_ms > {AGREED_MS} THEN 'Missed' ELSE 'Likely Miss' END WHEN buffer > 20 THEN 'On Track' WHEN buffer >= 5 THEN 'At Risk' ELSE 'Likely Miss' END AS sla_status,
  CASE WHEN trust >= 75 THEN 'High' WHEN trust >= 45 THEN 'Medium' ELSE 'Low' END AS confidence FROM w JOIN cr USING (run_id)""",
    ),
    "run_bottlenecks": (
        lambda s, d: D.run_bottlenecks(worked(s, d), edges(s, d)),
        BASE + PATH + f""", x AS (SELECT tk.* EXCLUDE (wait_ms), l_suppkey::VARCHAR AS worker, round(l_extendedprice / 10.0::DOUBLE) AS wait_ms, attempts - 1 AS retries, path.task IS NOT NULL AS critical
  FROM tk JOIN g ON g.l_orderkey = tk.run_id AND g.n * {A} % {M} = tk.task LEFT JOIN path ON path.run_id = tk.run_id AND path.task = tk.task),
rn AS (SELECT run_id, max(end_ms) - min(start_ms) AS d, max(retries) AS hot, arg_min(task, (-retries, task)) AS hot_task, count(*) FILTER (critical) AS n_path, coalesce(sum(duration_ms) FILTER (critical), 0.0) AS path_ms, coalesce(sum(wait_ms) FILTER (critical), 0.0) AS path_wait,
  count(*) FILTER (retries >= 2) AS often, coalesce(sum(duration_ms) FILTER (retries > 0), 0.0) AS again_ms, sum(wait_ms) FILTER (wait_ms > 1000 AND wait_ms > duration_ms * 3) AS starved FROM x GROUP BY 1),
sg AS (SELECT run_id, stage, avg(wait_ms) AS wait, sum(duration_ms) AS total, any_value(d) AS d FROM x JOIN rn USING (run_id) GROUP BY ALL),
wk AS (SELECT run_id, worker, CASE WHEN any_value(d) > 0 THEN sum(duration_ms) / any_value(d) * 100.0::DOUBLE ELSE 0.0 END AS share, any_value(d) AS d FROM x JOIN rn USING (run_id) GROUP BY ALL),
r AS (SELECT run_id, 'queue-delay-' || stage AS id, CASE WHEN wait > 5000 THEN 'critical' WHEN wait > 2000 THEN 'high' ELSE 'medium' END AS severity, least(1.0::DOUBLE, wait / greatest(d, 1.0)) AS impact, wait AS affected FROM (SELECT * FROM sg QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY wait DESC, stage) = 1) WHERE wait > 500
UNION ALL SELECT run_id, 'worker-saturation-' || worker, CASE WHEN share > 90 THEN 'critical' WHEN share > 75 THEN 'high' ELSE 'medium' END, share / 100.0::DOUBLE, floor(d * share / 100.0::DOUBLE) FROM (SELECT * FROM wk QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY share DESC, worker) = 1) WHERE share > 50
UNION ALL SELECT run_id, 'slow-stage-' || stage, CASE WHEN pct > 40 THEN 'critical' WHEN pct > 25 THEN 'high' ELSE 'low' END, least(1.0::DOUBLE, pct / 100.0::DOUBLE), total FROM (SELECT *, total / greatest(d, 1.0) * 100.0::DOUBLE AS pct FROM sg QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY total DESC, stage) = 1) WHERE total > 100
UNION ALL SELECT run_id, 'retry-hotspot-task-' || hot_task, CASE WHEN hot >= 3 THEN 'critical' WHEN hot >= 2 THEN 'high' ELSE 'medium' END, least(1.0::DOUBLE, hot * 500.0::DOUBLE / greatest(d, 1.0)), hot * 1000.0::DOUBLE FROM rn WHERE hot > 0
UNION ALL SELECT DISTINCT run_id, 'idle-workers', 'low', 0.2::DOUBLE, floor(d * 0.15::DOUBLE) FROM wk WHERE share < 15 AND d > 1000
UNION ALL SELECT run_id, 'critical-path-length', CASE WHEN path_ms / greatest(d, 1.0) > 0.6::DOUBLE THEN 'high' ELSE 'medium' END, path_ms / greatest(d, 1.0), floor(path_ms + path_wait) FROM rn WHERE n_path > 0
UNION ALL SELECT run_id, 'longest-serial-chain', CASE WHEN n_path > 6 THEN 'high' ELSE 'medium' END, 0.5::DOUBLE, floor(path_ms) FROM rn WHERE n_path > 3
UNION ALL SELECT run_id, 'excessive-retries', 'high', 0.4::DOUBLE, floor(again_ms) FROM rn WHERE often > 0
UNION ALL SELECT run_id, 'worker-starvation', 'medium', 0.3::DOUBLE, floor(starved) FROM rn WHERE starved IS NOT NULL
UNION ALL SELECT run_id, 'queue-imbalance', 'medium', 0.2::DOUBLE, floor(max(wait) - min(wait)) FROM sg GROUP BY run_id HAVING max(wait) - min(wait) > 1000),
q AS (SELECT run_id, id, severity, floor(impact * 1e6::DOUBLE) / 1e6::DOUBLE AS impact, floor(affected * 1e3::DOUBLE) / 1e3::DOUBLE AS affected_ms FROM r)
SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END DESC, impact DESC, affected_ms DESC, id)::INTEGER AS place, id, severity, impact, affected_ms FROM q""",
    ),
    "blocked_tasks": (lambda s, d: D.blocked(tasks(s, d), edges(s, d)), BASE + BLOCKED + " SELECT * FROM cl"),
    "run_status": (
        lambda s, d: D.run_status(tasks(s, d), edges(s, d)),
        BASE + BLOCKED + """, h AS (SELECT DISTINCT run_id, task FROM cl), nr AS (SELECT run_id, count(DISTINCT root) AS n_roots FROM cl GROUP BY 1),
x AS (SELECT tk.run_id, CASE WHEN h.task IS NOT NULL THEN 'blocked' ELSE status END AS status FROM tk LEFT JOIN h USING (run_id, task))
SELECT run_id, CASE WHEN bool_and(status = 'completed') THEN 'completed' WHEN bool_or(status IN ('running', 'pending')) THEN 'running' WHEN bool_or(status = 'failed') THEN 'failed' ELSE 'blocked' END AS status, count(*) FILTER (status = 'blocked') AS n_blocked, coalesce(any_value(n_roots), 0) AS n_roots
FROM x LEFT JOIN nr USING (run_id) GROUP BY run_id""",
    ),
    "task_cycles": (
        lambda s, d: D.cycles(tasks(s, d).select("run_id", "task"), looped(s, d)),
        BASE + """, l AS (SELECT * FROM e UNION SELECT e.run_id, e.child, e.parent FROM e JOIN tk ON tk.run_id = e.run_id AND tk.task = e.child AND status = 'failed' AND stage = 'R'),
hit AS (SELECT DISTINCT run_id FROM l GROUP BY run_id), reach AS (SELECT run_id, parent AS a, child AS b FROM l UNION SELECT r.run_id, r.a, l.child FROM reach r JOIN l ON l.run_id = r.run_id AND l.parent = r.b),
onc AS (SELECT run_id, a FROM reach WHERE a = b), bad AS (SELECT run_id, a AS task FROM onc UNION SELECT r.run_id, r.b FROM reach r JOIN onc ON onc.run_id = r.run_id AND onc.a = r.a)
SELECT run_id, count(*) AS n FROM bad GROUP BY run_id""",
    ),
}
