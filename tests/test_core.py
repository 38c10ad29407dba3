"""Queries against their SQL, folds and streams against brute force, and the shapes of the design's fixtures."""

from __future__ import annotations

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from docweft import catalog, functions, sources, streaming
from docweft.operators import answers, capacity, records, runlog, search, text
from docweft.plans import search as search_plans

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(rows):
    out = [tuple(None if x is None or x is pd.NaT or x is pd.NA or x != x else x for x in r) for r in rows]
    return sorted(out, key=lambda r: [(x is not None, str(x)) for x in r])


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got = catalog.QUERIES[name](spark, DATA)
    want = con.execute(catalog.ORACLE_SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert plain(got.select(columns).toPandas().itertuples(index=False, name=None)) == plain(want[columns].itertuples(index=False, name=None))


def test_rate_limit_fold(spark):
    rows = [(e["client"], e["event_id"], e["ms"], e["allowed"]) for e in catalog.QUERIES["rate_limit"](spark, DATA).join(spark.read.parquet(f"{DATA}/events.parquet").select("event_id", runlog.millis("ts").alias("ms")), "event_id").collect()]
    held: dict = {}
    for client, _, ms, allowed in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        mine = held.setdefault(client, [])
        want = sum(ms - x < 7_200_000 for x in mine) < 3
        assert allowed == want
        if want:
            mine.append(ms)


def test_pack_sentences(spark):
    docs = spark.createDataFrame([(1, "One two three. Four five. Six seven eight nine. Ten."), (2, None), (3, "a b c d e f g h")], "doc_id long, text string")
    got = [tuple(r) for r in answers.pack_sentences(docs, most=6).orderBy("doc_id", "chunk_no").collect()]
    assert got == [(1, 0, 5, "One two three. Four five."), (1, 1, 6, "Four five. Six seven eight nine."), (1, 2, 5, "Six seven eight nine. Ten."), (3, 0, 8, "a b c d e f g h")]


def test_metrics_of_known_results(spark):
    queries = spark.createDataFrame([(1,), (2,)], "query_id long")
    results = spark.createDataFrame([(1, 1, 0), (1, 2, 1), (1, 3, 2)], "query_id long, rank int, doc_id long")
    truth = spark.createDataFrame([(1, 0), (1, 2)], "query_id long, doc_id long")
    got = {r["query_id"]: r for r in search.ir_metrics(queries, results, truth).collect()}
    assert got[1]["recall_5"] == 1 and got[1]["precision_1"] == 1 and got[1]["mrr"] == 1 and round(got[1]["ndcg_5"], 4) == 0.9197
    assert got[2]["recall_5"] == got[2]["mrr"] == got[2]["ndcg_5"] == 0


def test_routing_of_known_queries(spark):
    rows = [(1, "Extract table of results comparing parameters"), (2, "How does scheduling relate to tasks execution?"), (3, "scheduling details list query options")]
    got = {r["query_id"]: r["intent"] for r in answers.route(spark.createDataFrame(rows, "query_id long, text string")).collect()}
    assert got == {1: "table_lookup", 2: "multi_hop", 3: "hybrid"}


def test_verification_of_known_answers(spark):
    context = spark.createDataFrame([(1, "The money came from Zapperer."), (2, "The money came from Zapperer.")], "answer_id long, text string")
    told = spark.createDataFrame([(1, "The funding came from Zapperer."), (2, "The funding came from Microsoft.")], "answer_id long, text string")
    assert {r["answer_id"]: r["n_unsupported"] for r in answers.verify(told, context).collect()} == {1: 0, 2: 1}


def test_content_types(spark):
    rows = [("a | b\nc | d", "table"), ("- x\n- y\nz", "list"), ("Short title", "heading"), ("", "paragraph"), (None, "paragraph"), ("one two three four five six seven", "paragraph")]
    got = spark.createDataFrame(rows, "text string, want string").select("want", functions.content_type("text").alias("got")).collect()
    assert all(r["got"] == r["want"] for r in got)


def test_critical_path_with_any_parents(spark):
    rows = [(1, 1, 2.0, []), (1, 2, 3.0, [1]), (1, 3, 10.0, []), (1, 4, 1.0, [2, 3]), (2, 1, 5.0, [])]
    got = {r["run_id"]: r["length"] for r in runlog.critical_path(spark.createDataFrame(rows, "run_id long, task_no int, weight double, parents array<int>")).collect()}
    assert got == {1: 11.0, 2: 5.0}


def test_sinks_and_sources(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    sources.write_representation(docs, str(tmp_path), "chunks", buckets=4)
    sources.write_representation(docs.filter("doc_id = 1").withColumn("text", F.lit("new")), str(tmp_path), "chunks", buckets=4)
    assert {r["text"] for r in spark.read.parquet(f"{tmp_path}/chunks").filter("doc_id = 1").collect()} == {"new"}
    sources.write_jsonl(docs, f"{tmp_path}/log")
    sources.write_jsonl(docs, f"{tmp_path}/log")
    assert spark.read.json(f"{tmp_path}/log").count() == 4
    sources.write_csv(docs, f"{tmp_path}/csv")
    assert spark.read.option("header", True).csv(f"{tmp_path}/csv").count() == 2
    (tmp_path / "files").mkdir()
    (tmp_path / "files" / "x.txt").write_bytes(b"abc")
    assert sources.read_corpus(spark, f"{tmp_path}/files").first()["document_id"].startswith("ba7816bf")
    (tmp_path / "qa.json").write_text('{"questions": [{"question": "q1"}, {"question": "q2"}]}')
    assert sources.read_questions(spark, f"{tmp_path}/qa.json").count() == 2


def started(spark, tmp_path, df, name, mode):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)


@pytest.fixture
def stream(spark, tmp_path):
    events = spark.read.parquet(f"{DATA}/events.parquet")
    for k in range(2):
        events.filter(F.col("event_id") % 2 == k).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    return runlog.log(spark.readStream.schema(events.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"))


def test_stream_counts(spark, tmp_path, stream):
    got = started(spark, tmp_path, streaming.windowed_counts(stream, "1 day", late="60 days"), "counts", "complete")
    want = runlog.log(spark.read.parquet(f"{DATA}/events.parquet")).groupBy(F.to_date("ts").alias("d"), "status").count()
    assert {(r["start"].date(), r["status"], r["n"]) for r in got.collect()} == {(r["d"], r["status"], r["count"]) for r in want.collect()}


def test_stream_exactly_once(spark, tmp_path, stream):
    assert started(spark, tmp_path, streaming.exactly_once(stream.union(stream), "60 days"), "once", "append").count() == spark.read.parquet(f"{DATA}/events.parquet").count()


def test_stream_ingest(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    docs.limit(50).write.parquet(f"{tmp_path}/docs")
    streaming.ingest(spark.readStream.schema(docs.schema).parquet(f"{tmp_path}/docs"), f"{tmp_path}/out").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out/blocks").count() == text.blocks(spark.read.parquet(f"{tmp_path}/docs")).count()


STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def test_stream_states_and_limits(spark, tmp_path, stream):
    pytest.importorskip("google.protobuf", reason="Spark's Python state API needs protobuf")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    try:
        got = started(spark, tmp_path, streaming.run_states(stream), "states", "update")
        last = got.groupBy("run_id").agg(F.max("last_event").alias("last_event"), F.max("completed").alias("completed"))
        want = runlog.state(runlog.log(spark.read.parquet(f"{DATA}/events.parquet")))
        assert {tuple(r) for r in last.collect()} == {(r["run_id"], r["last_event"], r["completed"]) for r in want.collect()}
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_entities_in_most_documents(spark):
    rows = [(i, "Common words, Common Rarely" if i < 3 else "Common Once" if i == 3 else "Common") for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = records.entities(docs)
    assert {(r["name"], r["n_docs"], r["n_mentions"]) for r in found.collect()} == {("Common", 120, 123), ("Rarely", 3, 3)}
    got = {r["doc_id"]: (r["n_entities"], r["first_entity"]) for r in records.tag_entities(docs, found).collect()}
    assert got == {i: (2 if i < 3 else 1, "Common") for i in range(120)}


def test_as_of_point_moves_with_the_log(spark):
    for n in (10, 9001):
        log = spark.range(n).selectExpr("id % 7 AS run_id", "id AS event_id", "'completed' AS status", "1.0D AS value")
        got = runlog.state(runlog.first_half(log)).agg(F.sum("completed"), F.max("last_event")).first()
        assert tuple(got) == ((n - 1) // 2 + 1, (n - 1) // 2)
    whole = spark.read.parquet(f"{DATA}/events.parquet")
    half = whole.agg(F.floor(F.max("event_id") / 2)).first()[0]
    assert catalog.QUERIES["state_as_of_half"](spark, DATA).agg(F.sum("completed")).first()[0] == whole.filter((F.col("event_id") <= half) & F.col("event_type").isin([k for k, v in runlog.STATUS.items() if v == "completed"])).count()


def test_rate_limit_reads_a_stream_of_batches(spark):
    rows = spark.range(3000).selectExpr("IF(id % 3 = 2, NULL, 9007199254740992 + id % 3) AS client", "id AS event_id", "timestamp_millis(id * 100) AS ts")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = runlog.rate_limit(rows, most=2, seconds=1)
        found = got.collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert "FlatMapGroupsInPandas" not in got._jdf.queryExecution().toString()  # no client is held whole
    held: dict = {}
    assert len(found) == 3000
    for client, k, allowed in sorted(found, key=lambda r: r["event_id"]):
        assert client == (None if k % 3 == 2 else 9007199254740992 + k % 3)
        mine = held.setdefault(client, [])
        assert allowed == (sum(100 * k - x < 1000 for x in mine) < 2)
        if allowed:
            mine.append(100 * k)


def test_postprocessing_of_answers(spark):
    from docweft.operators import evidence

    texts = ["A b c d e f g h. A b c d e f g h. Other [1] [2] text .", "One two three. Four. Five. Six. One two three.", None, ""]
    got = [r["x"] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string").orderBy("id").select(evidence.postprocess("text").alias("x")).collect()]
    assert got == ["A b c d e f g h. Other [1, 2] text.", "One two three. Four. Five. Six. One two three.", "", ""]


def test_ablation_is_the_mean_by_configuration(spark):
    from docweft.operators import evidence

    rows = [("a", 1.0, 0.5), ("a", 0.0, 0.25), ("b", 0.5, 1.0)]
    got = {r["config"]: (r["n_queries"], r["recall_5"], r["mrr"]) for r in evidence.ablation(spark.createDataFrame(rows, "config string, recall_5 double, mrr double")).collect()}
    assert got == {"a": (2, 0.5, 0.375), "b": (1, 0.5, 1.0), None: (3, 0.5, 0.583333)}
    assert evidence.ablation(spark.createDataFrame([], "config string, recall_5 double, mrr double")).count() <= 1


class Held:
    """A state handle that keeps values in memory, for the processors' logic alone."""

    def getValueState(self, name, schema):  # noqa: N802
        return self

    getListState = getValueState  # noqa: N815
    value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value or []

    def update(self, value):
        self.value = value

    put = update


def test_run_state_of_late_events():
    state = streaming.RunState()
    state.init(Held())
    batch = lambda *rows: iter([pd.DataFrame(rows, columns=["event_id", "status"])])
    first = next(state.handleInputRows((1,), batch((1, "queued"), (5, "completed")), None))
    late = next(state.handleInputRows((1,), batch((3, "running"), (6, "heartbeat")), None))
    assert first["status"][0] == late["status"][0] == "completed" and late["last_event"][0] == 6 and late["completed"][0] == 1


def test_limiter_against_brute_force():
    limiter = streaming.Limiter(2, 1000)
    limiter.init(Held())
    times = [0, 10, 20, 900, 1005, 1011, 1500, 2010, 2011, 2012]
    got = []
    for part in (times[:4], times[4:]):
        rows = pd.DataFrame({"client": 1, "event_id": range(len(part)), "ms": part})
        got += next(limiter.handleInputRows((1,), iter([rows]), None))["allowed"].tolist()
    held, want = [], []
    for ms in times:
        want.append(sum(ms - x < 1000 for x in held) < 2)
        if want[-1]:
            held.append(ms)
    assert got == want and True in got and False in got


def test_percentiles_of_providers_are_exact(spark):
    rows = spark.range(120_000).select((F.col("id") % 3).alias("worker"), (F.col("id") * 7919 % 100_003 * 977 - 40_000_000).alias("duration_ms"), F.when(F.col("id") % 5 == 0, "failed").otherwise("completed").alias("outcome"))
    few = spark.createDataFrame([(7, 5, "completed"), (7, 4, "completed"), (8, None, "open"), (None, 3, "completed")], "worker long, duration_ms long, outcome string")
    got = {r["provider"]: (r["p50_ms"], r["p90_ms"]) for r in capacity.provider_stats(rows.union(few)).collect()}
    for w in range(3):
        values = sorted(r["duration_ms"] for r in rows.filter(f"worker = {w} and outcome = 'completed'").collect())
        assert got[w] == tuple(values[-(-len(values) * p // 10) - 1] for p in (5, 9))
    assert got[7] == (4, 5) and got[8] == (None, None) and got[None] == (3, 3)


@pytest.mark.parametrize("name, step", [("ablation", "truth"), ("ablation", "lists"), ("group_expansion", "bm25")])
def test_a_search_is_made_once_a_query(spark, monkeypatch, name, step):
    made, whole = [], getattr(search_plans, step)
    monkeypatch.setattr(search_plans, step, lambda s, d: made.append(whole(s, d)) or made[-1])
    assert catalog.QUERIES[name](spark, DATA).count() and len(made) == 1


def test_contexts_are_fused_from_one_search(spark, monkeypatch):
    made, whole = [], search_plans.bm25
    monkeypatch.setattr(search_plans, "bm25", lambda s, d: made.append(whole(s, d)) or made[-1])
    assert catalog.QUERIES["fuse_context"](spark, DATA).count() and len(made) == 1


@pytest.mark.parametrize("most", [50_000, 0])
def test_truth_is_what_contains_the_query(spark, monkeypatch, tmp_path, most):
    monkeypatch.setattr(search, "MOST_QUERIES", most, raising=False)
    texts = ["one two three four", "xone two three fourth", "One two three four", "one  two", "two", "a\none two three", "", None, "two three"]
    asked = ["one two three four", "two three", "e two thr", "two", " two ", "", "  ", None, "e\nx", "one two\tthree"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(asked)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {tuple(r) for r in search_plans.truth(spark, str(tmp_path)).collect()}
    assert got == {(q, x) for q, a in enumerate(asked) for x, b in enumerate(texts) if a is not None and b is not None and a in b}
