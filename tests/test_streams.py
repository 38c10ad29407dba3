"""Streams with timers and state against their batch forms; the incremental index against a rebuild."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from docweft import streaming
from docweft.operators import index, runlog, search

DATA = "/root/testdata/sf0.001"
FAR = "timestamp'2031-01-01 00:00:00'"


@pytest.fixture
def rocks(spark):
    pytest.importorskip("google.protobuf", reason="Spark's Python state API needs protobuf")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def ran(spark, tmp_path, df, name, mode="append"):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name), query


def files(spark, tmp_path, parts, schema):
    """A stream that reads one part after the other."""
    for k, part in enumerate(parts):
        part.coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")


def test_attempts_of_late_events_equal_the_batch(spark, tmp_path, rocks):
    log = runlog.log(spark.read.parquet(f"{DATA}/events.parquet")).select("run_id", "event_id", "ts", "status")
    end = spark.range(2).selectExpr("-1 AS run_id", "10000000 + id AS event_id", f"{FAR} + make_interval(0, 0, 0, cast(id AS int) * 400) AS ts", "'heartbeat' AS status").select(log.columns)
    # The first part has every other event, the second the rest, later than others but within the watermark's delay; then time moves on.
    parts = [log.filter("event_id % 2 = 1"), log.filter("event_id % 2 = 0"), end.filter("event_id = 10000000"), end.filter("event_id = 10000001")]
    stream = files(spark, tmp_path, [p.withColumn("ts", F.col("ts").cast("timestamp")) for p in parts], "run_id long, event_id long, ts timestamp, status string")
    got, _ = ran(spark, tmp_path, streaming.attempt_sessions(stream, "100 days", timeout_ms=300 * 86_400_000), "attempts")
    want = {tuple(r) for r in runlog.attempts(log).collect()}
    assert {tuple(r) for r in got.collect()} == want and len(want) > 50


def test_an_open_attempt_closes_by_its_timer(spark, tmp_path, rocks):
    rows = [(1, 1, "queued"), (1, 10, "running"), (2, 5, "queued"), (2, 400, "completed"), (2, 8000, "running"), (2, 9000, "queued")]
    schema = "run_id long, event_id long, ts timestamp, status string"
    made = [spark.createDataFrame([(r, s)], "run_id long, status string").select("run_id", F.lit(i).cast("long").alias("event_id"), F.timestamp_seconds(F.lit(sec)).alias("ts"), "status") for i, (r, sec, s) in enumerate(rows)]
    first = made[0].union(made[1]).union(made[2]).union(made[3])
    later = made[4].union(made[5])
    tick = lambda sec: spark.range(1).select(F.lit(-1).cast("long").alias("run_id"), F.lit(99).cast("long").alias("event_id"), F.timestamp_seconds(F.lit(sec)).alias("ts"), F.lit("heartbeat").alias("status"))
    stream = files(spark, tmp_path, [first, later, tick(30_000), tick(60_000)], schema)
    got, _ = ran(spark, tmp_path, streaming.attempt_sessions(stream, "0 seconds", timeout_ms=3_600_000), "timers")
    assert sorted(tuple(r) for r in got.collect()) == [(1, 1, 1_000, 10_000, None, "open"), (2, 1, 5_000, None, 400_000, "completed"), (2, 2, 9_000_000, None, None, "open")]


def test_session_memory_equals_a_fold_and_goes_when_closed(spark, tmp_path, rocks):
    talks = spark.read.parquet(f"{DATA}/conversations.parquet").filter("conv_id is not null and turn is not null")
    at = F.timestamp_seconds(F.col("conv_id") * 3600 + F.col("turn") * 60 + 1000)  # a watermark begins at 0
    turns = talks.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), at.alias("ts"), F.lit("turn").alias("kind"), "role", "text")
    ends = turns.groupBy("session_id").agg(F.max("seq").alias("s"), F.max("ts").alias("t")).select("session_id", (F.col("s") + 1).alias("seq"), F.expr("t + interval 30 seconds").alias("ts"), F.lit("close").alias("kind"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
    ends = ends.filter(F.pmod(F.col("session_id"), F.lit(4)) > 0)  # the others are dropped when they are idle
    tick = lambda t: spark.range(1).select(F.lit(-1).cast("long").alias("session_id"), F.lit(0).cast("long").alias("seq"), F.timestamp_seconds(F.lit(t)).alias("ts"), F.lit("close").alias("kind"), F.lit("").alias("role"), F.lit("").alias("text"))
    both = turns.union(ends)
    parts = [both.filter("seq % 2 = 1"), both.filter("seq % 2 = 0"), tick(10_000_000), tick(20_000_000), tick(20_000_001)]
    stream = files(spark, tmp_path, parts, both.schema)
    got, query = ran(spark, tmp_path, streaming.session_memory(stream, "30 days"), "memory")
    want = {}
    for r in turns.collect():
        n, q, words = want.get(r["session_id"], (0, 0, frozenset()))
        want[r["session_id"]] = (n + 1, q + (r["role"] == "user"), words | set(re.findall("[a-z]{5,}", (r["text"] or "").lower())))
    found = {r["session_id"]: (r["n_turns"], r["n_questions"], frozenset(r["keywords"].split()), r["closed_by"]) for r in got.filter("session_id >= 0").collect()}
    assert found == {s: (*w, "close" if s % 4 else "idle") for s, w in want.items()}
    rows = [sum(o["numRowsTotal"] for o in p["stateOperators"]) for p in query.recentProgress]
    assert max(rows) >= len(want) and rows[-1] < max(rows) // 4  # what closed sessions held is gone


def test_health_scores_equal_the_batch(spark, tmp_path):
    log = runlog.log(spark.read.parquet(f"{DATA}/events.parquet")).withColumn("provider", F.col("run_id") % 10)
    middle = log.agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY event_id)")).first()[0]
    parts = [log.filter(F.col("event_id") <= middle), log.filter(F.col("event_id") > middle)]
    got, _ = ran(spark, tmp_path, streaming.health_scores(files(spark, tmp_path, parts, log.schema)), "scores", "update")
    last = {r["provider"]: (r["n"], round(r["score"], 3)) for r in sorted(got.collect(), key=lambda r: r["n"])}
    assert last == {r["provider"]: (r["n"], round(r["score"], 3)) for r in runlog.ewma(log).collect()}


def test_exactly_once_by_the_idempotency_key(spark, tmp_path):
    log = runlog.log(spark.read.parquet(f"{DATA}/events.parquet"))
    again = log.withColumn("event_id", F.col("event_id") + 1_000_000)  # retried sends come under later ids
    got, _ = ran(spark, tmp_path, streaming.exactly_once(files(spark, tmp_path, [log, again], log.schema), "60 days"), "retried")
    assert {r[0] for r in got.select("event_id").collect()} == {r[0] for r in runlog.dedupe(log).select("event_id").collect()}


def test_limiter_takes_late_requests_by_their_own_time():
    import pandas as pd

    from tests.test_core import Held

    limiter = streaming.Limiter(2, 1000, 5000)
    limiter.init(type("Handle", (Held,), {})())
    batch = lambda *ms: next(limiter.handleInputRows((1,), iter([pd.DataFrame({"client": 1, "event_id": range(len(ms)), "ms": ms})]), None))["allowed"].tolist()
    assert batch(5000, 5010, 5020) == [True, True, False]
    assert batch(1000, 1010, 1020) == [True, True, False]  # late, and before all that is held
    assert batch(5500, 6000, 6005) == [False, True, False]


def test_index_after_changes_equals_a_rebuild(spark, tmp_path):
    docs = spark.createDataFrame([(1, "red apple pie"), (2, "green apple"), (3, "blue sky"), (4, None), (5, " .,")], "doc_id long, text string")
    root = f"{tmp_path}/index"
    index.build(docs, root)
    first = spark.createDataFrame([(2, "old apple text", "upsert", 1), (2, "green pear pear", "upsert", 2), (3, None, "delete", 1), (9, "unknown", "delete", 1), (6, "apple sky", "upsert", 1), (1, " ", "upsert", 1), (None, "apple", "upsert", 1)], "doc_id long, text string, op string, seq int")
    index.update(first, root, 1)
    index.update(spark.createDataFrame([(6, None, "delete", 5), (3, "sky again", "upsert", 1)], "doc_id long, text string, op string, seq int"), root, 2)
    index.update(spark.createDataFrame([(1, "never", "upsert", 1)], "doc_id long, text string, op string, seq int"), root, 2)  # batch 2 is committed already
    now = spark.createDataFrame([(1, "red apple pie"), (2, "green pear pear"), (3, "sky again")], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "apple sky"), (2, "pear"), (3, "nothing here"), (4, "")], "query_id long, text string")
    want = sorted(tuple(r) for r in search.bm25(now, queries).collect())
    assert sorted(tuple(r) for r in index.search(spark, root, queries).collect()) == want and len(want) == 3
    assert tuple(index.index_counts(spark, root).first()) == (3, 8, 7, 3)
    index.compact(spark, root, f"{root}-2")
    assert sorted(tuple(r) for r in index.search(spark, f"{root}-2", queries).collect()) == want
    index.update(spark.createDataFrame([(7, "pear apple", "upsert", 1)], "doc_id long, text string, op string, seq int"), f"{root}-2", 3)
    more = now.union(spark.createDataFrame([(7, "pear apple")], "doc_id long, text string"))
    assert sorted(tuple(r) for r in index.search(spark, f"{root}-2", queries).collect()) == sorted(tuple(r) for r in search.bm25(more, queries).collect())


def test_an_update_splits_changed_documents_only(spark, tmp_path):
    """An update reads of older texts their postings only: it doesn't get the texts."""
    root = f"{tmp_path}/index"
    index.build(spark.range(50).selectExpr("id AS doc_id", "concat('word', id, ' common') AS text"), root)
    index.update(spark.createDataFrame([(3, "other common", "upsert")], "doc_id long, text string, op string"), root, 1)
    assert spark.read.parquet(f"{root}/postings").filter("batch = 1").count() == 2
    assert {tuple(r) for r in spark.read.parquet(f"{root}/terms").filter("batch = 1").select("term", "df").collect()} == {("word3", -1), ("other", 1)}


def test_index_fed_by_a_stream(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").limit(60)
    schema = "doc_id long, text string, op string, seq int"
    root = f"{tmp_path}/index"
    index.build(docs.limit(0), root)
    part = lambda cond, op, seq: docs.filter(cond).selectExpr("doc_id", "text", f"'{op}' AS op", f"{seq} AS seq")
    stream = files(spark, tmp_path, [part("true", "upsert", 1), part("doc_id % 3 = 0", "delete", 2)], schema)
    streaming.ingest_index(stream, root, f"{tmp_path}/progress").awaitTermination()
    streaming.ingest_index(stream, root, f"{tmp_path}/progress").awaitTermination()  # nothing new
    queries = spark.createDataFrame([(1, "the of and"), (2, "une les de")], "query_id long, text string")
    left = docs.filter("doc_id % 3 <> 0").filter("text is not null")
    assert sorted(tuple(r) for r in index.search(spark, root, queries, 5).collect()) == sorted(tuple(r) for r in search.bm25(left, queries, 5).collect())


def test_counted_terms(spark):
    rows = spark.createDataFrame([(1, ["b", "a", "b", "ç", "b"]), (3, None), (4, ["x"])], "doc_id long, tokens array<string>")
    got = {r["doc_id"]: (r["length"], r["n_terms"], sorted(tuple(x) for x in r["terms"])) for r in rows.mapInArrow(index.count_terms, "doc_id long, length int, n_terms int, terms array<struct<term:string,tf:long>>").collect()}
    assert got == {1: (5, 3, [("a", 1), ("b", 3), ("ç", 1)]), 3: (None, 0, []), 4: (1, 1, [("x", 1)])}


def test_index_is_written_by_tasks_of_bounded_size(spark, tmp_path, monkeypatch):
    """A slot was one task's work, however many postings it had; what a batch takes back is found without reading postings."""
    monkeypatch.setattr(index, "POSTED", 25)
    root = f"{tmp_path}/index"
    docs = spark.range(100).selectExpr("id AS doc_id", "'common words' AS text")
    index.build(docs, root)
    slots = {p.parent.name: 0 for p in tmp_path.glob("index/postings/batch=0/slot=*/*.parquet")}
    for p in tmp_path.glob("index/postings/batch=0/slot=*/*.parquet"):
        slots[p.parent.name] += 1
    assert max(slots.values()) > 1
    (tmp_path / "index/postings").rename(tmp_path / "index/aside")
    (tmp_path / "index/postings").mkdir()
    index.update(docs.filter("doc_id < 40").selectExpr("doc_id", "text", "'delete' AS op"), root, 1)
    index.compact(spark, root, f"{root}-2")
    assert tuple(index.index_counts(spark, root).first())[:3] == (60, 120, 2)
    queries = spark.createDataFrame([(1, "common")], "query_id long, text string")
    assert sorted(tuple(r) for r in index.search(spark, f"{root}-2", queries, 5).collect()) == sorted(tuple(r) for r in search.bm25(docs.filter("doc_id >= 40"), queries, 5).collect())
