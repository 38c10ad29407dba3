"""Queries and answers in tables: routing, context packing, extractive answers, checks of answers against their context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweft import functions as T

#: Patterns of each query intent, in order of precedence.
INTENTS = {
    "table_lookup": r"(?:^|[^\p{L}\p{N}_])(?:table|row|column|cell|compare|comparing|statistics)(?:$|[^\p{L}\p{N}_])",
    "multi_hop": r"(?:^|[^\p{L}\p{N}_])(?:relate|relationship|between|connection|why|cause|impact)(?:$|[^\p{L}\p{N}_])",
    "definition": r"(?:^|[^\p{L}\p{N}_])(?:what is|define|definition|meaning)(?:$|[^\p{L}\p{N}_])",
    "summary": r"(?:^|[^\p{L}\p{N}_])(?:summary|summarize|overview|main points)(?:$|[^\p{L}\p{N}_])",
    "layout": r"(?:^|[^\p{L}\p{N}_])(?:top|bottom|left|right|page|corner)(?:$|[^\p{L}\p{N}_])",
}


def route(queries: DataFrame) -> DataFrame:
    """query_id, intent (first pattern that matches, else hybrid), n_intents, keywords (different words of six letters or more, five at most)."""
    text = F.lower(T.text_of("text"))
    hits = [F.when(text.rlike(p), F.lit(k)) for k, p in INTENTS.items()]
    words = F.slice(F.sort_array(F.array_distinct(F.regexp_extract_all(text, F.lit("[a-z]{6,}"), F.lit(0)))), 1, 5)
    return queries.select("query_id", F.coalesce(*hits, F.lit("hybrid")).alias("intent"), F.size(F.array_compact(F.array(*hits))).alias("n_intents"), F.array_join(words, " ").alias("keywords"))


def analyze(queries: DataFrame) -> DataFrame:
    """query_id, n_words, n_capitalised, n_numbers, complexity."""
    text = T.text_of("text")
    n = T.n_tokens(text)
    capital = F.regexp_count(text, F.lit(r"(?:^|\s)[A-Z][a-z]+"))
    numbers = F.regexp_count(text, F.lit(r"[0-9]{3,}"))
    return queries.select("query_id", n.alias("n_words"), capital.alias("n_capitalised"), numbers.alias("n_numbers"), F.when(n > 20, "high").when(n > 8, "medium").otherwise("low").alias("complexity"))


def pack_context(ranked: DataFrame, budget: int = 600, least: int = 50) -> DataFrame:
    """query_id, rank, doc_id, n_words, used: words of each ranked document (query_id, rank, doc_id, text) that the budget takes.

    Documents go in by rank; the first that doesn't fit is cut if more than `least` words are left, and nothing follows it.
    """
    own = Window.partitionBy("query_id").orderBy("rank")
    sized = ranked.select("query_id", "rank", "doc_id", T.n_tokens("text").alias("n_words"))
    before = F.coalesce(F.sum("n_words").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.lit(budget) - F.col("before")
    used = F.when(F.col("n_words") <= left, F.col("n_words")).when(left > least, left).otherwise(0)
    return sized.withColumn("before", before).select("query_id", "rank", "doc_id", "n_words", used.cast("long").alias("used")).filter("used > 0")


def extract(queries: DataFrame, ranked: DataFrame, n: int = 4) -> DataFrame:
    """query_id, place, doc_id, sentence, score: the best sentences by (5 * different + 0.5 * all query words) * 10 / rank."""
    asked = queries.select("query_id", F.array_distinct(T.tokens("text")).alias("q"))
    each = ranked.select("query_id", "rank", "doc_id", F.posexplode(T.sentences("text")).alias("pos", "sentence")).join(asked, "query_id")
    words = T.tokens("sentence")
    hits = F.filter(words, lambda w: F.array_contains("q", w))
    score = F.round((5.0 * F.size(F.array_distinct(hits)) + 0.5 * F.size(hits)) * 10.0 / F.col("rank"), 4)
    scored = each.withColumn("score", score).filter("score > 0")
    one = scored.withColumn("_r", F.row_number().over(Window.partitionBy("query_id", "sentence").orderBy(F.desc("score"), "rank", "doc_id", "pos"))).filter("_r = 1")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "rank", "doc_id", "pos"))
    return one.withColumn("place", place).filter(F.col("place") <= n).select("query_id", "place", "doc_id", "sentence", "score")


def verify(answers: DataFrame, context: DataFrame) -> DataFrame:
    """answer_id, n_unsupported, score: capitalised words and long numbers of the answer that its context lacks cost 0.15 each.

    answers, context: answer_id, text; the context of an answer is one row.
    """
    claims = F.array_distinct(F.regexp_extract_all(T.text_of("text"), F.lit(r"[A-Z][a-z]{3,}|[0-9]{3,}"), F.lit(0)))
    both = answers.select("answer_id", claims.alias("claims")).join(context.select("answer_id", F.col("text").alias("context")), "answer_id", "left")
    lacking = F.size(F.filter("claims", lambda c: ~F.coalesce(F.contains(F.col("context"), c), F.lit(False))))
    return both.select("answer_id", lacking.alias("n_unsupported"), F.round(F.greatest(F.lit(1.0) - lacking * 0.15, F.lit(0.0)), 2).alias("score"))


def truncate(col: Column | str, n_tokens: int) -> Column:
    """The text up to its last sentence end within 4 * n_tokens characters, or cut there if it has none."""
    cut = F.substring(T.text_of(col), 1, 4 * n_tokens)
    whole = F.regexp_extract(cut, r"^([\s\S]*[.!?])", 1)
    return F.when(F.length(T.text_of(col)) <= 4 * n_tokens, T.text_of(col)).when(whole != "", whole).otherwise(cut)


def pack_sentences(docs: DataFrame, most: int = 120, overlap: int = 1) -> DataFrame:
    """doc_id, chunk_no, n_words, text: sentences packed in order up to `most` words; each chunk begins with the last `overlap` sentences of the one before.

    The packing depends on what came before, so each document's sentences go through one fold, in column functions.
    """
    pieces = F.transform(T.sentences("text"), lambda s: F.struct(s.alias("s"), F.size(F.split(s, r"\s+")).alias("n")))
    empty = F.array().cast("array<struct<s:string,n:int>>")
    words = lambda a: F.aggregate(a, F.lit(0), lambda t, x: t + x["n"])

    def add(acc, x):
        full = (F.size(acc["now"]) > 0) & (words(acc["now"]) + x["n"] > most)
        tail = F.slice(acc["now"], F.greatest(F.size(acc["now"]) - overlap + 1, F.lit(1)), F.lit(overlap))
        return F.struct(F.when(full, F.array_append(acc["done"], acc["now"])).otherwise(acc["done"]).alias("done"), F.when(full, F.array_append(tail, x)).otherwise(F.array_append(acc["now"], x)).alias("now"))

    start = F.struct(F.array().cast("array<array<struct<s:string,n:int>>>").alias("done"), empty.alias("now"))
    packed = F.aggregate(pieces, start, add, lambda acc: F.when(F.size(acc["now"]) > 0, F.array_append(acc["done"], acc["now"])).otherwise(acc["done"]))
    return docs.select("doc_id", F.posexplode(packed).alias("chunk_no", "c")).select("doc_id", "chunk_no", words("c").alias("n_words"), F.array_join(F.transform("c", lambda x: x["s"]), " ").alias("text"))
