"""Search of whole query tables over whole corpora: BM25, keywords, cosine; fusion and measures of retrieval."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweft import functions as T


def top(df: DataFrame, by: str, k: int, *order: Column) -> DataFrame:
    """The first k rows of each `by` with their rank; partial ranks cut each task's rows before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("rank") <= k)


def postings(docs: DataFrame) -> DataFrame:
    """doc_id, term, tf, length. docs: doc_id, text."""
    terms = docs.select("doc_id", T.tokens("text").alias("terms")).withColumn("length", F.size("terms"))
    return terms.select("doc_id", "length", F.explode("terms").alias("term")).groupBy("doc_id", "term", "length").agg(F.count("*").alias("tf"))


def index_stats(docs: DataFrame) -> DataFrame:
    """One row: documents, tokens, mean length."""
    sizes = docs.select(F.size(T.tokens("text")).alias("n"))
    return sizes.agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_tokens"), F.round(F.avg("n"), 6).alias("avg_length"))


#: A term that every document has: its postings give the number of documents and their lengths. No token is empty.
EVERY = ""
#: Tables of so many asked terms are sent to all tasks; larger ones are joined by shuffles.
MOST_TERMS = 500_000
#: A task adds up at most about so many scores of documents for queries; of tasks there are at most TASKS.
PAIRS, TASKS = 1_000_000, 20_000


def sent(df: DataFrame, terms: DataFrame) -> DataFrame:
    """df, which has a row for each different term at most, to be broadcast if the terms are counted to be few."""
    return F.broadcast(df) if terms.select("term").distinct().limit(MOST_TERMS + 1).count() <= MOST_TERMS else df


def asked_terms(terms: DataFrame) -> DataFrame:
    """The different terms of the queries, to be broadcast if they are few."""
    return sent(terms.select("term").distinct(), terms)


def asked_postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """doc_id, term, length, tf of the asked terms and of EVERY; other tokens go before anything is shuffled."""
    tokens = docs.select("doc_id", T.tokens("text").alias("terms"))
    each = tokens.select("doc_id", F.size("terms").alias("length"), F.explode(F.concat(F.array(F.lit(EVERY)), "terms")).alias("term"))
    kept = each.join(asked_terms(terms.select("term").union(terms.sparkSession.range(1).select(F.lit(EVERY)))), "term", "left_semi")
    return kept.filter(F.col("term").isNotNull()).groupBy("doc_id", "term", "length").agg(F.count("*").alias("tf"))


def add_up(weighted: DataFrame, terms: DataFrame, n_docs: int, n_queries: int) -> DataFrame:
    """query_id, doc_id, score: the sums of what documents have (weighted: term, doc_id, w) of each query's terms (query_id, term).

    Where the queries' terms are few, weights are dealt by document before they meet the queries, so a score is added up in one task and no pairs are shuffled.
    """
    if terms.limit(MOST_TERMS + 1).count() <= MOST_TERMS:
        weighted, terms = weighted.repartition(max(1, min(TASKS, -(-n_docs * n_queries // PAIRS))), "doc_id"), F.broadcast(terms)
    return weighted.join(terms, "term").groupBy("query_id", "doc_id").agg(F.round(F.sum("w"), 6).alias("score"))


def bm25(docs: DataFrame, queries: DataFrame, k: int = 30, b: float = 0.75, k1: float = 1.5) -> DataFrame:
    """query_id, rank, doc_id, score of the k best documents of each query (query_id, text); any term may match.

    idf is ln(1 + (N - df + 0.5) / (df + 0.5)). Only terms of queries leave the scan (see asked_postings). Ties go to the smaller doc_id.
    """
    terms = queries.select("query_id", F.explode(F.array_distinct(T.tokens("text"))).alias("term"))
    found = asked_postings(docs, terms)
    # All three uses read the same rows and columns, so that texts are read and split once: a filter on one of them alone would move below the shuffle and make it another one.
    every = F.when(F.col("term") == EVERY, F.col("tf"))
    stats = found.agg(F.sum(every).alias("n_docs"), (F.sum(F.col("length") * every) / F.sum(every)).alias("avg_length"))
    df = found.groupBy("term").agg(F.sum(F.when(F.col("tf") > 0, 1).otherwise(F.col("length"))).alias("df"))
    weighted = found.join(sent(df, terms), "term").crossJoin(F.broadcast(stats))  # one row of statistics
    idf = F.log(1.0 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = F.col("tf") + k1 * (1.0 - b + b * F.col("length") / F.col("avg_length"))
    scores = add_up(weighted.select("term", "doc_id", (idf * F.col("tf") * (k1 + 1.0) / norm).alias("w")), terms, docs.count(), queries.count())
    return top(scores, "query_id", k, F.desc("score"), F.col("doc_id")).select("query_id", "rank", "doc_id", "score")


def keyword_search(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, doc_id of the documents that have every token of the query.

    A query meets documents by its rarest term only; the others are tested on what else each document has of all asked terms.
    """
    asked = queries.select("query_id", F.array_distinct(T.tokens("text")).alias("terms")).filter(F.size("terms") > 0)
    terms = asked.select("query_id", F.explode("terms").alias("term"))
    own = docs.select("doc_id", F.explode(F.array_distinct(T.tokens("text"))).alias("term")).join(asked_terms(terms), "term", "left_semi")
    df = own.groupBy("term").agg(F.count("*").alias("df"))
    rarest = terms.join(df, "term", "left").groupBy("query_id").agg(F.min_by("term", F.struct(F.coalesce("df", F.lit(0)), "term")).alias("term"))
    have = own.groupBy("doc_id").agg(F.collect_set("term").alias("have"))
    met = own.join(rarest, "term").select("query_id", "doc_id").join(asked, "query_id").join(have, "doc_id")
    return met.filter(F.size(F.array_except("terms", "have")) == 0).select("query_id", "doc_id")


#: Texts of so many queries (some 12 MB) are sent to all tasks; more are joined by shuffles.
MOST_QUERIES = 50_000


def containing(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, doc_id of the documents whose text contains the query's, character by character. docs: doc_id, text; queries: query_id, text.

    What stands between the first and the last space of a query is between spaces in each such document, too: the longest of these
    pieces leads to the documents that are tested. A query without one is tested on all. Documents are tested where they are
    read; only what is found is shuffled.
    """
    pieces = F.split("text", " ")
    inner = F.slice(pieces, 2, F.greatest(F.size(pieces) - 2, F.lit(0)))
    longest = F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    asked = queries.select("query_id", "text", F.coalesce(longest, F.lit(EVERY)).alias("term"))
    each = docs.select("doc_id", F.col("text").alias("doc"), F.explode(F.array_distinct(F.concat(F.array(F.lit(EVERY)), pieces))).alias("term"))
    if asked.limit(MOST_QUERIES + 1).count() > MOST_QUERIES:  # texts don't move with their tokens: pairs come first, then what they say
        pairs = each.select("doc_id", "term").join(asked_terms(asked), "term", "left_semi").join(asked, "term").select("query_id", "doc_id", "text").distinct()
        met = pairs.join(docs.select("doc_id", F.col("text").alias("doc")), "doc_id")
    else:
        met = each.join(F.broadcast(asked), "term")
    return met.filter(F.contains("doc", "text")).select("query_id", "doc_id").distinct()


#: A block product takes so many queries and vectors.
QUERY_BLOCK, VECTOR_BLOCK = 1024, 20_000


def block_products(k: int, least: float | None):
    """Of two blocks of unit vectors, the pairs that can be among the k best of their query; scores are not rounded yet."""

    def run(queries: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        out = []
        for n in set(map(len, queries["v"])) & set(map(len, vectors["v"])) if len(queries) and len(vectors) else ():
            q, v = queries[queries["v"].map(len) == n], vectors[vectors["v"].map(len) == n]
            ids, mine = v["vec_id"].to_numpy(), np.stack(v["v"].to_numpy())
            for a in range(0, len(q), 128):
                part = q.iloc[a : a + 128]
                scores = np.stack(part["v"].to_numpy()) @ mine.T
                for query, row in zip(part["vec_id"].to_numpy(), scores):
                    row[ids == query] = -np.inf
                    floor = -np.inf if least is None else least - 1e-4
                    if len(row) > k:
                        floor = max(floor, np.partition(row, -k)[-k] - 1e-4)  # what rounding can make equal stays
                    good = np.flatnonzero((row >= floor) & (row > -np.inf))
                    out.append(pd.DataFrame({"query_id": query, "vec_id": ids[good], "score": row[good]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})

    return run


def dense(vectors: DataFrame, queries: DataFrame, k: int = 15, least: float | None = 0.3) -> DataFrame:
    """query_id, rank, vec_id, score: the k best cosines (4 dp) at `least` or more. Both tables: vec_id, embedding; a query never finds itself.

    Every query meets every vector by definition: they are dealt into a grid of blocks, whose products are taken in numpy,
    and a block gives no more than each query's k best (and what is level with them).
    """
    norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    unit = lambda df: df.withColumn("n", norm(F.col("embedding"))).filter("n > 0").select("vec_id", F.transform("embedding", lambda x: x.cast("double") / F.col("n")).alias("v"))
    rows, cols = (max(1, -(-df.count() // most)) for df, most in ((queries, QUERY_BLOCK), (vectors, VECTOR_BLOCK)))
    own = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = unit(queries).withColumn("r", own(rows)).withColumn("c", every(cols))
    v = unit(vectors).withColumn("c", own(cols)).withColumn("r", every(rows))
    pairs = q.groupBy("r", "c").cogroup(v.groupBy("r", "c")).applyInPandas(block_products(k, least), "query_id long, vec_id long, score double")
    pairs = pairs.withColumn("score", F.round("score", 4))
    if least is not None:
        pairs = pairs.filter(F.col("score") >= least)
    return top(pairs, "query_id", k, F.desc("score"), F.col("vec_id")).select("query_id", "rank", "vec_id", "score")


def minmax(df: DataFrame, col: str, by: str) -> DataFrame:
    """Adds <col>_norm: 0 to 1 within each `by`, 0 where all are equal."""
    own = Window.partitionBy(by)
    low, high = F.min(col).over(own), F.max(col).over(own)
    return df.withColumn(f"{col}_norm", F.when(high > low, (F.col(col) - low) / (high - low)).otherwise(0.0))


def rrf(lists: DataFrame, weights: dict[str, float], k: int = 60) -> DataFrame:
    """query_id, doc_id, score (8 dp), n_sources: weighted reciprocal ranks. lists: query_id, source, rank, doc_id."""
    weight = F.lit(0.0)
    for source, w in weights.items():
        weight = F.when(F.col("source") == source, w).otherwise(weight)
    return lists.groupBy("query_id", "doc_id").agg(F.round(F.sum(weight / (k + F.col("rank"))), 8).alias("score"), F.countDistinct("source").alias("n_sources"))


def hybrid_pool(left: DataFrame, right: DataFrame) -> DataFrame:
    """query_id, doc_id, sources, both scores (0 where absent). left, right: query_id, doc_id, score."""
    a = left.select("query_id", "doc_id", F.col("score").alias("left_score"))
    b = right.select("query_id", "doc_id", F.col("score").alias("right_score"))
    both = a.join(b, ["query_id", "doc_id"], "full_outer")
    sources = F.concat_ws("+", F.when(F.col("left_score").isNotNull(), "left"), F.when(F.col("right_score").isNotNull(), "right"))
    return both.select("query_id", "doc_id", sources.alias("sources"), F.coalesce("left_score", F.lit(0.0)).alias("left_score"), F.coalesce("right_score", F.lit(0.0)).alias("right_score"))


def ir_metrics(queries: DataFrame, results: DataFrame, truth: DataFrame) -> DataFrame:
    """Per query recall_1, 3, 5, 10, precision_1, 5 (over what was returned), mrr, ndcg_5, 6 dp; without truth all are 0.

    queries: query_id; results: query_id, rank, doc_id; truth: query_id, doc_id.
    """
    truth = truth.distinct()
    n_true = truth.groupBy("query_id").agg(F.count("*").alias("n_true"))
    marked = results.join(truth.withColumn("hit", F.lit(1)), ["query_id", "doc_id"], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    upto = lambda k, c: F.sum(F.when(F.col("rank") <= k, c).otherwise(0))
    aggs = [upto(k, F.col("hit")).alias(f"h{k}") for k in (1, 3, 5, 10)] + [upto(k, F.lit(1)).alias(f"n{k}") for k in (1, 5)]
    aggs += [F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first"), F.sum(F.when((F.col("rank") <= 5) & (F.col("hit") == 1), 1.0 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias("dcg")]
    each = queries.select("query_id").join(n_true, "query_id", "left").join(marked.groupBy("query_id").agg(*aggs), "query_id", "left").fillna(0, ["n_true", "h1", "h3", "h5", "h10", "n1", "n5", "dcg"])
    best = F.aggregate(F.sequence(F.lit(1), F.least(F.greatest(F.col("n_true"), F.lit(1)), F.lit(5)).cast("int")), F.lit(0.0), lambda a, i: a + 1.0 / F.log2(i + 1.0))
    some = F.col("n_true") > 0
    r6 = lambda c: F.round(c, 6)
    return each.select(
        "query_id",
        *[r6(F.when(some, F.col(f"h{k}") / F.col("n_true")).otherwise(0.0)).alias(f"recall_{k}") for k in (1, 3, 5, 10)],
        *[r6(T.share(F.col(f"h{k}"), F.col(f"n{k}"))).alias(f"precision_{k}") for k in (1, 5)],
        r6(F.when(some & F.col("first").isNotNull(), 1.0 / F.col("first")).otherwise(0.0)).alias("mrr"),
        r6(F.when(some, F.col("dcg") / best).otherwise(0.0)).alias("ndcg_5"),
    )


def worst_queries(metrics: DataFrame, n: int = 20) -> DataFrame:
    return metrics.orderBy("mrr", "query_id").limit(n).select("query_id", "mrr")


def gates(metrics: DataFrame, least: dict[str, float]) -> DataFrame:
    """gate, value (mean of the metric), passed."""
    means = metrics.agg(*[F.round(F.avg(m), 6).alias(m) for m in least])
    rows = F.explode(F.array(*[F.struct(F.lit(m).alias("gate"), F.col(m).alias("value"), F.lit(x).alias("least")) for m, x in least.items()]))
    return means.select(rows.alias("r")).select("r.gate", "r.value", (F.col("r.value") >= F.col("r.least")).alias("passed"))
