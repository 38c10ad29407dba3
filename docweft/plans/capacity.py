"""Queries for planning over the run log, each with its SQL."""

from __future__ import annotations

from docweft.operators import capacity as K
from docweft.plans.runlog import ATT, LOG, TASKS, log, seg, tasks

DRAIN = lambda crew, left: f"floor((CASE WHEN {left} <= 0 THEN 0.0 WHEN {crew} / task_s - rate > 0 THEN ({left}) / ({crew} / task_s - rate) ELSE 9999.0 END)::DOUBLE * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE"

QUERIES = {
    "triage_log": (
        lambda s, d: K.triage_log(log(s, d)),
        LOG + """, f AS (SELECT run_id, 'FAILED event ' || event_id || ' value ' || round(value, 2)::DOUBLE AS line, row_number() OVER (PARTITION BY run_id ORDER BY ts, event_id) AS r FROM log WHERE status = 'failed')
SELECT run_id, count(*) AS n_flagged, string_agg(line, chr(10) ORDER BY r) FILTER (r <= 5) AS first_flagged FROM f GROUP BY run_id""",
    ),
    "compact_log": (
        lambda s, d: K.compact(log(s, d)),
        LOG + """, l AS (SELECT run_id, arg_max(status, (ts, event_id)) AS last FROM log GROUP BY 1)
SELECT run_id, event_id FROM log LEFT JOIN l USING (run_id) WHERE status IS DISTINCT FROM 'heartbeat' AND status IS NOT NULL OR status = 'heartbeat' AND last IS DISTINCT FROM 'completed' AND ts >= (SELECT max(ts) FROM log) - INTERVAL 7 DAY""",
    ),
    "newest_failures": (
        lambda s, d: K.events_by(log(s, d), "failed"),
        LOG + " SELECT run_id, event_id, row_number() OVER (PARTITION BY run_id ORDER BY ts DESC, event_id DESC)::INTEGER AS place FROM log WHERE status = 'failed' QUALIFY place <= 100",
    ),
    "ownership_changes": (
        lambda s, d: K.ownership(log(s, d)),
        LOG + """, o AS (SELECT run_id, ts, event_id, 'worker-' || (json_extract_string(payload, '$.k')::BIGINT % 4) AS owner FROM log WHERE status = 'running'),
p AS (SELECT run_id, event_id, owner, lag(owner) OVER (PARTITION BY run_id ORDER BY ts, event_id) AS previous_owner FROM o) SELECT * FROM p WHERE owner IS NOT NULL AND owner IS DISTINCT FROM previous_owner""",
    ),
    "provider_stats": (
        lambda s, d: K.provider_stats(seg(s, d)),
        ATT + """SELECT worker AS provider, count(*) AS n, round(avg((outcome = 'completed')::INTEGER), 6)::DOUBLE AS success_rate, quantile_disc(duration_ms, 0.5) FILTER (outcome = 'completed') AS p50_ms, quantile_disc(duration_ms, 0.9) FILTER (outcome = 'completed') AS p90_ms,
  round(avg(duration_ms) FILTER (outcome = 'completed'), 2)::DOUBLE AS mean_ms, count(*) FILTER (outcome = 'open') AS unfinished FROM seg GROUP BY 1""",
    ),
    "perf_summary": (
        lambda s, d: K.perf_summary(seg(s, d)),
        ATT + """, p AS (SELECT run_id, attempt, coalesce(wait_ms, 0)::BIGINT AS w, coalesce(duration_ms, 0)::BIGINT AS x FROM seg), a AS (SELECT run_id, count(*) AS attempts, sum(w)::BIGINT AS wait_ms, sum(x)::BIGINT AS execution_ms, sum(CASE WHEN attempt > 1 THEN x ELSE 0 END)::BIGINT AS retry_ms, arg_max(attempt, (x, -attempt)) AS longest_attempt FROM p GROUP BY 1)
SELECT run_id, attempts, wait_ms, execution_ms, retry_ms, round(wait_ms * 100.0::DOUBLE / greatest(wait_ms + execution_ms, 1), 2)::DOUBLE AS wait_pct, round(execution_ms * 100.0::DOUBLE / greatest(wait_ms + execution_ms, 1), 2)::DOUBLE AS execution_pct, round(retry_ms * 100.0::DOUBLE / greatest(wait_ms + execution_ms, 1), 2)::DOUBLE AS retry_pct, longest_attempt FROM a""",
    ),
    "capacity": (
        lambda s, d: K.capacity(log(s, d)),
        LOG + f""", h AS (SELECT date_trunc('hour', ts) AS hour, count(*) FILTER (status = 'queued') AS queued, count(*) FILTER (status = 'running') AS started, round(coalesce(avg(value) FILTER (status = 'completed'), 0.0), 4) AS ts0 FROM log GROUP BY 1),
m AS (SELECT hour, queued, started, greatest(sum(queued - started) OVER (ORDER BY hour ROWS UNBOUNDED PRECEDING), 0)::BIGINT AS backlog, queued / 3600.0::DOUBLE AS rate, CASE WHEN ts0 = 0 THEN 1.5 ELSE ts0 END::DOUBLE AS task_s FROM h),
r AS (SELECT *, (CASE WHEN backlog = 0 AND rate = 0 THEN 0 ELSE greatest(1, least(15, ceil(round(rate * task_s + backlog * task_s / 30.0::DOUBLE, 6)))) END)::INTEGER AS recommended, (queued - started) / 3600.0::DOUBLE AS growth FROM m)
SELECT hour, backlog, round(rate, 6)::DOUBLE AS rate, task_s, recommended, greatest(recommended - 4, 0)::INTEGER AS start, greatest(4 - recommended, 0)::INTEGER AS stop, {DRAIN("4.0::DOUBLE", "backlog")} AS drain_s, {DRAIN("recommended::DOUBLE", "backlog")} AS drain_after_s,
  {DRAIN("4.0::DOUBLE", "backlog - 10")} AS recovery_s, CASE WHEN growth > 0 AND backlog < 100 THEN floor((100 - backlog) / growth * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE END AS saturation_s FROM r""",
    ),
    "run_forecast": (
        lambda s, d: K.run_forecast(tasks(s, d)),
        TASKS + """, c AS (SELECT *, task_no <= floor(count(*) OVER (PARTITION BY run_id) * 0.5::DOUBLE) AS done FROM n),
a AS (SELECT run_id, count(*) AS n_tasks, count(*) FILTER (done) AS n_done, round(sum(CASE WHEN done THEN 0.0 ELSE weight END), 4)::DOUBLE AS remaining, round(max(CASE WHEN done THEN 0.0 ELSE weight END), 4)::DOUBLE AS critical_remaining, round(sum(CASE WHEN done THEN weight ELSE 0.0 END), 4)::DOUBLE AS spent FROM c GROUP BY 1)
SELECT run_id, n_tasks, n_done, round(n_done::DOUBLE / n_tasks, 4)::DOUBLE AS progress, remaining, critical_remaining, CASE WHEN remaining <= spent THEN 'on_track' ELSE 'at_risk' END AS sla FROM a""",
    ),
    "load_advice": (
        lambda s, d: K.load_advice(seg(s, d)),
        ATT + """, a AS (SELECT worker, count(*) AS n, sum(coalesce(duration_ms, 0))::BIGINT AS busy_ms, avg((outcome = 'failed')::INTEGER) AS failed FROM seg GROUP BY 1)
SELECT worker, n, busy_ms, round(busy_ms::DOUBLE / greatest(sum(busy_ms) OVER (), 1), 6)::DOUBLE AS share, CASE WHEN failed > 0.3 THEN 'retry_hotspot' WHEN busy_ms > avg(busy_ms) OVER () * 1.25 THEN 'overloaded' WHEN busy_ms < avg(busy_ms) OVER () * 0.75 THEN 'idle' ELSE 'balanced' END AS advice FROM a""",
    ),
}
