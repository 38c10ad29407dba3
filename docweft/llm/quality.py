"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Each rule scores how bad a text is in one respect, from 0 to 1. Its cutoff, per stratum, is the strictest one for which
labelled good documents show, by an exact binomial test, that at most a share `risk` of good documents is rejected. The
risk is divided among the rules, the error of the tests (`error`) among strata and rules (Bonferroni); within a rule the
cutoffs are tested from lenient to strict (a fixed sequence, so no further correction). Then, with probability 1 - error,
no stratum loses more than that share of its good documents. Where there are too few labels for any cutoff to pass, the
rule rejects nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docweft.llm.common import WORD, cut, table

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\f\r"
#: Scores are cut into so many equal steps; a cutoff is a step.
STEPS = 400
RULES = ("symbols", "duplicate_lines", "repeated_words", "long_words", "short_words")


def _without(text: Column, characters: str) -> Column:
    return F.length(F.translate(text, characters, ""))


def signals(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_lines (lines with a word), n_dup_lines and n_repeat_words, all long.

    Null text: no words. Two three-word windows are alike if their 64-bit hashes are.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    docs = docs.withColumn("_words", F.regexp_extract_all(t, F.lit(WORD), F.lit(0)))
    docs = docs.withColumn("_lines", F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    docs = docs.withColumn("n_words", F.size("_words").cast("long"))
    # Hashes of words, then of each three in a row; the outer columns are read by place.
    docs = docs.withColumn("_h", F.transform("_words", lambda w: F.xxhash64(w)))
    docs = docs.withColumn(
        "_windows",
        F.when(F.col("n_words") < 3, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), (F.col("n_words") - 3).cast("int")), lambda i: F.xxhash64(F.get("_h", i), F.get("_h", i + 1), F.get("_h", i + 2)))),
    )
    docs = docs.withColumn("_sorted", F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    found = F.filter(
        F.transform("_sorted", lambda x, j: F.when((x["h"] == F.get("_sorted", j - 1)["h"]) | (x["h"] == F.get("_sorted", j + 1)["h"]), x["i"])),
        lambda i: i.isNotNull(),
    )
    covered = F.size(F.array_distinct(F.flatten(F.transform(found, lambda i: F.array(i, i + 1, i + 2)))))
    docs = docs.withColumn("n_repeat_words", F.when(F.col("_sorted").isNull(), F.lit(0)).otherwise(covered).cast("long"))
    docs = docs.withColumn("word_chars", _without(t, SPACES).cast("long")).withColumn("n_symbols", (F.length(t) - _without(t, SYMBOLS)).cast("long"))
    docs = docs.withColumn("n_lines", F.size("_lines").cast("long")).withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
    return docs.drop("_words", "_lines", "_h", "_windows", "_sorted")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)


def scores() -> dict[str, Column]:
    words, lines = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("n_lines"), F.lit(1))
    mean = F.col("word_chars") / words / 50.0
    return dict(zip(RULES, (F.col("n_symbols") / words, F.col("n_dup_lines") / lines, F.col("n_repeat_words") / words, mean, 1.0 - F.least(mean, F.lit(1.0))), strict=True))


def step(score: Column) -> Column:
    return F.floor(F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)) * STEPS).cast("int")


def most_rejected(n: Column, risk: Column, error: Column) -> Column:
    """The largest k with P(Binomial(n, risk) <= k) <= error, -1 if there is none.

    Terms are found one from the other in logarithms; k is below n * risk, since error is below one half.
    """
    odds = F.log(risk / (1.0 - risk))
    first = F.struct((n * F.log(1.0 - risk)).alias("log_term"), F.lit(0.0).alias("sum"), F.lit(-1).cast("long").alias("k"))

    def add(acc: Column, i: Column) -> Column:
        term = F.when(i == 0, acc["log_term"]).otherwise(acc["log_term"] + F.log((n - i + 1) / i) + odds)
        total = acc["sum"] + F.exp(term)
        return F.struct(term.alias("log_term"), total.alias("sum"), F.when(total <= error, i.cast("long")).otherwise(acc["k"]).alias("k"))

    return F.aggregate(F.sequence(F.lit(0), F.ceil(n * risk).cast("long")), first, add)["k"]


def cutoffs(labelled: DataFrame, stratum: str, risk: float, error: float) -> DataFrame:
    """labelled: the stratum and signals of good documents. Returns (stratum, rule, cutoff): steps from cutoff on are rejected.

    Only counts by stratum, rule and step are moved: STEPS + 1 rows for each stratum and rule at most.
    """
    long = labelled.select(F.col(stratum).alias("stratum"), F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), step(s).alias("step")) for r, s in scores().items()])).alias("x")).select("stratum", "x.*")
    counts = long.groupBy("stratum", "rule", "step").agg(F.count("*").alias("c"))
    own = Window.partitionBy("stratum", "rule")
    counts = counts.withColumn("rejected", F.sum("c").over(own.orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.sum("c").over(own))
    each = counts.groupBy("stratum", "rule").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("step", "rejected"))).alias("steps"))
    each = each.withColumn("tests", F.count("*").over(Window.partitionBy()))
    each = each.withColumn("k", most_rejected(F.col("n"), F.lit(risk / len(RULES)), F.lit(error) / F.col("tests")))
    # The first step that may be rejected lies right above the last one that must not be.
    last = F.array_max(F.transform(F.filter("steps", lambda x: x["rejected"] > F.col("k")), lambda x: x["step"]))
    return each.select("stratum", "rule", F.when(F.col("k") < 0, F.lit(STEPS + 1)).otherwise(F.coalesce(last + 1, F.lit(0))).alias("cutoff"))


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = 0.02, error: float = 0.05) -> DataFrame:
    """Signals, base_failed and kept of each document. docs: doc_id, text and the stratum; labels: doc_id, quality.

    Good documents are those with quality 1 (an id with both labels is not good) that pass the base rules. A null stratum
    is a stratum; strata without labels reject by the base rules alone. Repeated rows give repeated rows; empty tables
    give empty results; other columns are not looked at.
    """
    measured = cut(signals(docs.select("doc_id", F.col(stratum).alias("stratum"), "text")).drop("text").withColumn("base_failed", base_failed()))
    good = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("_q")).filter("_q = 1").drop("_q")
    found = cutoffs(measured.filter(~F.col("base_failed")).join(good, "doc_id"), "stratum", risk, error)
    wide = found.groupBy(F.col("stratum").alias("_stratum")).pivot("rule", list(RULES)).agg(F.first("cutoff"))
    wide = cut(wide.select("_stratum", *[F.col(r).alias(f"_{r}") for r in RULES]))
    bad = F.lit(False)
    for rule, score in scores().items():
        bad |= F.coalesce(step(score) >= F.col(f"_{rule}"), F.lit(False))
    judged = measured.join(wide, F.col("stratum").eqNullSafe(F.col("_stratum")), "left")
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~bad).alias("kept"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
