"""Citations of answers in all three ways, and the whole check of answers against their context."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docweft import functions as T

#: Shortest sentence that is looked up, how many of its words a chunk must have, shortest of such words; longest sentence without a citation; what a violation costs, least score of a valid answer.
SENTENCE, SHARED, WORD, UNCITED, COST, VALID = 30, 5, 3, 30, 0.15, 0.7
SPLIT = r"(?<!\w\.\w.)(?<![A-Z][a-z]\.)(?<=\.|\?)\s"


def build_citations(answers: DataFrame, context: DataFrame) -> DataFrame:
    """answer_id, place, citation_id, chunk_id, rank, snippet (200 characters): what an answer (answer_id, text) cites of its context (answer_id, rank, chunk_id, text).

    First `[chunk_...]` by id (cit_n, n the marker's place among such markers), then `[n]` by rank (cit_num_n), each chunk once. Only an answer without either is looked up sentence by sentence: a chunk is cited if it has
    more than SHARED of a sentence's different words of over WORD letters, most of all chunks (ties: the first by rank), as cit_fuzzy_n. Markers that name nothing are left out.
    """
    marks = lambda pattern: F.posexplode(F.regexp_extract_all(T.text_of("text"), F.lit(pattern), F.lit(1))).alias("at", "mark")
    rows = context.select("answer_id", "rank", "chunk_id", T.text_of("text").alias("chunk"))
    by_id = answers.select("answer_id", marks(r"\[(chunk_[^\]\s]+)\]")).join(rows, (F.col("mark") == rows["chunk_id"]) & (answers["answer_id"] == rows["answer_id"])).drop(rows["answer_id"])
    by_id = by_id.select("answer_id", F.lit(0).alias("way"), "at", F.concat(F.lit("cit_"), F.col("at") + 1).alias("citation_id"), "chunk_id", "rank", "chunk")
    numbered = answers.select("answer_id", marks(r"\[(\d{1,9})\]")).withColumn("rank", F.col("mark").cast("int")).join(rows, ["answer_id", "rank"])
    numbered = numbered.select("answer_id", F.lit(1).alias("way"), "at", F.concat(F.lit("cit_num_"), "rank").alias("citation_id"), "chunk_id", "rank", "chunk")
    first = F.row_number().over(Window.partitionBy("answer_id", "chunk_id").orderBy("way", "at"))
    marked = by_id.unionByName(numbered).withColumn("_r", first).filter("_r = 1").drop("_r")
    bare = answers.join(marked.select("answer_id").distinct(), "answer_id", "left_anti")
    sentences = bare.select("answer_id", F.posexplode(F.split(T.text_of("text"), SPLIT)).alias("at", "s")).withColumn("s", F.trim("s")).filter(F.length("s") >= SENTENCE)
    words = F.filter(F.array_distinct(F.split(F.lower("s"), r"\s+")), lambda w: F.length(w) > WORD)
    met = sentences.withColumn("words", words).join(rows, "answer_id").withColumn("n", F.size(F.filter("words", lambda w: F.contains(F.lower("chunk"), w))))
    best = F.row_number().over(Window.partitionBy("answer_id", "at").orderBy(F.desc("n"), "rank"))
    near = met.withColumn("_r", best).filter((F.col("_r") == 1) & (F.col("n") > SHARED)).withColumn("_r", F.row_number().over(Window.partitionBy("answer_id", "chunk_id").orderBy("at"))).filter("_r = 1")
    number = F.row_number().over(Window.partitionBy("answer_id").orderBy("at"))
    near = near.select("answer_id", F.lit(2).alias("way"), "at", F.concat(F.lit("cit_fuzzy_"), number).alias("citation_id"), "chunk_id", "rank", "chunk")
    place = F.row_number().over(Window.partitionBy("answer_id").orderBy("way", "at"))
    return marked.unionByName(near).select("answer_id", place.alias("place"), "citation_id", "chunk_id", "rank", F.substring("chunk", 1, 200).alias("snippet"))


def verify_answers(answers: DataFrame, context: DataFrame) -> DataFrame:
    """answer_id, n_unsupported, n_contradictions, n_uncited, score, valid of answers (answer_id, text) against their context (answer_id, rank, text).

    Unsupported: a capitalised word that the context lacks, letter case aside; contradiction: a number of three digits or more that it lacks; uncited: a sentence of over UNCITED characters without `[n]`; each occurrence
    counts. An empty answer has score 0. Valid: VALID or more, with nothing unsupported or contradictory.
    """
    whole = context.groupBy("answer_id").agg(F.lower(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", T.text_of("text").alias("t")))), lambda x: x["t"]), " ")).alias("context"))
    both = answers.select("answer_id", T.text_of("text").alias("text")).join(whole, "answer_id", "left").withColumn("context", F.coalesce("context", F.lit("")))
    found = lambda pattern: F.regexp_extract_all("text", F.lit(pattern), F.lit(1))
    lacking = lambda xs: F.size(F.filter(xs, lambda x: ~F.contains(F.col("context"), F.lower(x))))
    # No look-around: a word or number ends where the pattern can't go on, and a letter or digit before it is read with it and dropped.
    capitals = F.filter(found(r"([A-Za-z0-9_]+)"), lambda x: x.rlike("^[A-Z][a-z]+$"))
    numbers = F.filter(found(r"([A-Za-z0-9_]+)"), lambda x: x.rlike("^[0-9]{3,}$"))
    uncited = F.size(F.filter(T.sentences("text"), lambda x: (F.length(x) > UNCITED) & ~x.rlike(r"\[[0-9]+\]")))
    counted = both.select("answer_id", (F.col("text") == "").alias("empty"), lacking(capitals).alias("n_unsupported"), lacking(numbers).alias("n_contradictions"), uncited.alias("n_uncited"))
    score = F.when(F.col("empty"), 0.0).otherwise(F.round(F.greatest(F.lit(0.0), 1.0 - (F.col("n_unsupported") + F.col("n_contradictions") + F.col("n_uncited")) * COST), 2))
    return counted.withColumn("score", score).select("answer_id", "n_unsupported", "n_contradictions", "n_uncited", "score", ((F.col("score") >= VALID) & (F.col("n_unsupported") == 0) & (F.col("n_contradictions") == 0)).alias("valid"))
