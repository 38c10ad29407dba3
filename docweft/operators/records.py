"""Records derived from texts and results: entities, representations, fused and re-ranked candidates, costs, comparisons, forecasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweft import functions as T

#: Which representation is built from which.
DEPENDS = (("blocks", "sections"), ("blocks", "graph"), ("sections", "chunks"), ("graph", "chunks"), ("chunks", "embeddings"), ("chunks", "bm25"))


def invalidated(changed: DataFrame, depends: tuple = DEPENDS) -> DataFrame:
    """doc_id, representation: what must be rebuilt, the changed ones (doc_id, representation) and all that depends on them.

    The table of dependencies is a handful of rows; it is closed first, so that the documents are joined once.
    """
    reach: dict[str, set] = {}
    for a, b in depends:
        reach.setdefault(a, set()).add(b)
        reach.setdefault(b, set())
    for _ in reach:
        for a in reach:
            reach[a] |= {c for b in reach[a] for c in reach[b]}
    pairs = [F.struct(F.lit(a).alias("a"), F.array(*[F.lit(x) for x in sorted({a, *b})]).alias("all")) for a, b in reach.items()]
    found = F.get(F.filter(F.array(*pairs), lambda p: p["a"] == F.col("representation")), F.lit(0))["all"]
    return changed.select("doc_id", F.explode(found).alias("representation")).distinct()


def entities(docs: DataFrame, least: int = 3) -> DataFrame:
    """entity_id, name, n_docs, n_mentions of the capitalised words (four ASCII letters or more) found in `least` documents or more."""
    words = docs.select("doc_id", F.explode(F.regexp_extract_all(T.text_of("text"), F.lit(r"\b[A-Z][a-z]{3,}\b"), F.lit(0))).alias("name"))
    counts = words.groupBy("doc_id", "name").agg(F.count("*").alias("c")).groupBy("name").agg(F.count("*").alias("n_docs"), F.sum("c").alias("n_mentions"))
    return counts.filter(F.col("n_docs") >= least).select(F.concat(F.lit("ent-"), F.substring(F.sha2("name", 256), 1, 16)).alias("entity_id"), "name", "n_docs", "n_mentions")


def tag_entities(docs: DataFrame, entities: DataFrame) -> DataFrame:
    """doc_id, n_entities, first_entity of the documents that mention some; words meet entities in one equi-join."""
    words = docs.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all(T.text_of("text"), F.lit(r"\b[A-Z][a-z]{3,}\b"), F.lit(0)))).alias("name"))
    return words.join(entities.select("name"), "name").groupBy("doc_id").agg(F.count("*").alias("n_entities"), F.min("name").alias("first_entity"))


def embed(texts: DataFrame, dims: int = 8) -> DataFrame:
    """text_hash, vector: a vector for each different text, from the digits of its hash (the fallback where no model is at hand)."""
    one = texts.select(F.sha2(T.text_of("text"), 256).alias("text_hash")).distinct()
    part = lambda i: F.round(F.conv(F.substring("text_hash", 4 * i + 1, 4), 16, 10).cast("double") / 32767.5 - 1.0, 6)
    return one.select("text_hash", F.array_join(F.transform(F.array(*[part(i) for i in range(dims)]), lambda x: F.format_string("%.6f", x)), " ").alias("vector"))


def fuse(candidates: DataFrame) -> DataFrame:
    """query_id, doc_id, score: best score, 0.2 of the mean confidence, 0.15 for each further source; candidates: query_id, doc_id, source, score, confidence."""
    both = candidates.groupBy("query_id", "doc_id").agg(F.max("score").alias("s"), F.avg("confidence").alias("c"), F.countDistinct("source").alias("n"))
    return both.select("query_id", "doc_id", F.round(F.col("s") + 0.2 * F.col("c") + 0.15 * (F.col("n") - 1), 4).alias("score"))


def calibrate(candidates: DataFrame) -> DataFrame:
    """source, mean confidence, candidates."""
    return candidates.groupBy("source").agg(F.round(F.avg("confidence"), 4).alias("confidence"), F.count("*").alias("n"))


def overlap(a: Column, b: Column) -> Column:
    """The share of a's different tokens that b has."""
    words = F.array_distinct(T.tokens(a))
    return T.share(F.size(F.array_intersect(words, T.tokens(b))), F.size(words))


def rerank(pairs: DataFrame, k: int = 5) -> DataFrame:
    """query_id, place, doc_id, score: pairs (query_id, query, doc_id, text, score) by a sigmoid of lexical overlap, then by their own score."""
    scored = pairs.withColumn("s", F.when(F.trim(T.text_of("text")) == "", 0.0).otherwise(F.round(1.0 / (1.0 + F.exp(2.0 - 4.0 * overlap(F.col("query"), F.col("text")))), 6)))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("s"), F.desc("score"), "doc_id"))
    return scored.withColumn("place", place).filter(F.col("place") <= k).select("query_id", "place", "doc_id", F.col("s").alias("score"))


def reuse(requests: DataFrame) -> DataFrame:
    """key, requests, hits: requests (id, text) with one text, white space and case aside, are answered once."""
    key = F.sha2(F.lower(F.trim(F.regexp_replace(T.text_of("text"), r"\s+", " "))), 256)
    return requests.groupBy(key.alias("key")).agg(F.count("*").alias("requests"), F.min("id").alias("first_id")).select("key", "requests", "first_id", (F.col("requests") - 1).alias("hits"))


def answer_costs(answers: DataFrame, per_thousand: float = 0.002) -> DataFrame:
    """answer_id, tokens (a quarter of the characters), cost (8 dp)."""
    tokens = F.ceil(F.length(T.text_of("text")) / 4.0)
    return answers.select("answer_id", tokens.alias("tokens"), F.round(tokens * per_thousand / 1000.0, 8).alias("cost"))


def golden_diff(current: DataFrame, golden: DataFrame) -> DataFrame:
    """status, n: PASS, FAIL, MISSING or EXTRA by the hash of each document's canonical row. Both: doc_id and other columns."""
    canon = lambda df, name: df.select("doc_id", F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in sorted(df.columns) if c != "doc_id"]), 256).alias(name))
    both = canon(current, "a").join(canon(golden, "b"), "doc_id", "full_outer")
    status = F.when(F.col("a").isNull(), "MISSING").when(F.col("b").isNull(), "EXTRA").when(F.col("a") == F.col("b"), "PASS").otherwise("FAIL")
    return both.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


def precision_at(results: DataFrame, truth: DataFrame, k: int = 5) -> DataFrame:
    """query_id, precision_k: true documents among the first k, over k."""
    hits = results.filter(F.col("rank") <= k).join(truth.distinct().withColumn("hit", F.lit(1)), ["query_id", "doc_id"], "left")
    return hits.groupBy("query_id").agg(F.round(F.sum(F.coalesce("hit", F.lit(0))) / float(k), 6).alias("precision_k"))


def depths(tasks: DataFrame) -> DataFrame:
    """run_id, max_depth, n_roots of each run's task graph (run_id, task_no, parents), parents before children."""
    each = tasks.groupBy("run_id").agg(F.sort_array(F.collect_list(F.struct("task_no", "parents"))).alias("t"))
    d = F.aggregate("t", F.array().cast("array<int>"), lambda acc, t: F.array_append(acc, F.coalesce(F.array_max(F.transform(t["parents"], lambda p: F.get(acc, p - 1))), F.lit(-1)) + 1))
    return each.select("run_id", F.array_max(d).alias("max_depth"), F.size(F.filter("t", lambda t: F.size(t["parents"]) == 0)).alias("n_roots"))


def heatmap(counts: DataFrame, row: str, col: str) -> DataFrame:
    """row, column, n, heat: counts over the largest one."""
    n = counts.groupBy(F.col(row).alias("row"), F.col(col).alias("column")).agg(F.count("*").alias("n"))
    top = n.agg(F.max("n").alias("top"))
    return n.crossJoin(F.broadcast(top)).select("row", "column", "n", F.round(F.col("n") / F.col("top"), 4).alias("heat"))  # one row


def forecast(segments: DataFrame) -> DataFrame:
    """worker, open attempts, mean duration of its ended ones (ms, 3 dp), expected remaining ms and confidence by how many ended."""
    good = F.when(F.col("duration_ms") >= 0, F.col("duration_ms"))
    g = segments.groupBy("worker").agg(F.count_if(F.col("outcome") == "open").alias("open"), F.round(F.avg(good), 3).alias("mean_ms"), F.count(good).alias("ended"))
    level = F.when(F.col("ended") >= 100, "high").when(F.col("ended") >= 20, "medium").otherwise("low")
    return g.select("worker", "open", "mean_ms", F.round(F.col("open") * F.coalesce("mean_ms", F.lit(0.0)), 3).alias("remaining_ms"), level.alias("confidence"))


def consistency(log: DataFrame, as_of: str, stalled_hours: int = 48) -> DataFrame:
    """run_id, issue: runs whose last event is a running one and lies `stalled_hours` back, and runs with work but no queued event."""
    g = log.filter(F.col("ts") <= F.lit(as_of).cast("timestamp_ntz")).groupBy("run_id").agg(F.max_by("status", F.struct("ts", "event_id")).alias("last"), F.max("ts").alias("at"), F.count_if(F.col("status") == "queued").alias("queued"))
    age = F.timestamp_diff("HOUR", F.col("at").cast("timestamp_ntz"), F.lit(as_of).cast("timestamp_ntz"))
    stalled = g.filter(F.col("last").isin("running", "heartbeat") & (age >= stalled_hours)).select("run_id", F.lit("stalled").alias("issue"))
    return stalled.unionByName(g.filter("queued = 0").select("run_id", F.lit("never_queued").alias("issue")))


def traces(log: DataFrame) -> DataFrame:
    """status, events, mean and p90 of value, share of all events; 4 dp."""
    g = log.groupBy("status").agg(F.count("*").alias("events"), F.round(F.avg("value"), 4).alias("mean_value"), F.round(F.percentile("value", F.lit(0.9)), 4).alias("p90_value"))
    return g.withColumn("share", F.round(F.col("events") / F.sum("events").over(Window.partitionBy()), 4))  # a row for each status
