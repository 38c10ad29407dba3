"""Mixing sources to target weights by Pareto order sampling.

The whole part of target over size, of a source, is how often all its documents are taken for certain. For the rest, each
document has an inclusion probability of its own, in proportion to its size and 1 at most, such that the expected words are
those that are wanted; documents are ranked by random odds over inclusion odds, and the lowest ranks are taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docweft.llm.common import cut, fresh, n_words, table

#: The rank axis of a source is cut into so many bins; only one bin of each source is ranked row by row.
BINS = 4096


def random_share(seed: int, *keys: Column) -> Column:
    """A number in (0, 1) that depends on nothing but the seed and the keys: the first 12 hex digits of an MD5."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(k.cast("string"), F.lit("~")) for k in keys])
    return (F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 48))


def source_targets(sizes: DataFrame, weights: tuple[int, ...], max_copies: int, share: float) -> DataFrame:
    """sizes: (source, source_size). Adds weight and target.

    Sources in code-point order (null last) take the weights in turn. Targets divide `share` of all sizes by weight;
    no target is above max_copies times its source's size, and what that leaves over is divided again by weight among
    the others until none is above. The sources in order of cap over weight fill up one after the other, so running
    sums find the level at which the rest share alike. There is one row a source here, whatever the number of documents.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    fill = Window.orderBy("full_at", F.col("source").isNull(), F.col("source").cast("binary"))
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    sources = sizes.withColumn("weight", weight.cast("long")).withColumn("cap", F.col("source_size") * F.lit(max_copies))
    sources = sources.withColumn("full_at", F.col("cap") / F.col("weight"))
    sources = sources.withColumn("whole", F.sum("source_size").over(everything) * F.lit(share)).withColumn("all_weight", F.sum("weight").over(everything))
    left, left_weight = F.col("whole") - F.coalesce(F.sum("cap").over(before), F.lit(0)), F.col("all_weight") - F.coalesce(F.sum("weight").over(before), F.lit(0))
    sources = sources.withColumn("level", left / left_weight).withColumn("turn", F.row_number().over(fill))
    # The first source in this order that the level doesn't fill, and with it all later ones, share the level by weight.
    sources = sources.withColumn("open_level", F.min(F.when(F.col("level") < F.col("full_at"), F.struct("turn", "level"))).over(everything)["level"])
    target = F.when(F.col("open_level").isNull(), F.col("cap").cast("double")).otherwise(F.least(F.col("cap").cast("double"), F.col("open_level") * F.col("weight")))
    return sources.select("source", "source_size", "weight", target.alias("target"))


def inclusion_rates(units: DataFrame) -> DataFrame:
    """source, per_word: a document of size s has the inclusion probability min(1, s * per_word). units: source, size, wanted.

    The largest sizes are certain: with the words above a size taken off, what is left is shared by the sum of squares up
    to it; the largest size for which that gives no more than 1 tells the rate. Sums go over sizes, not documents.
    """
    own = Window.partitionBy("source").orderBy("size")
    by = units.groupBy("source", "size").agg(F.count("*").alias("n"), F.first("wanted").alias("wanted")).filter("size > 0")
    exact = lambda c: c.cast("decimal(38,0)")  # noqa: E731  sums don't depend on their order
    words = F.sum(exact(F.col("size") * F.col("n"))).over(own.rowsBetween(1, Window.unboundedFollowing))
    squares = F.sum(exact(F.col("size")) * exact(F.col("size") * F.col("n"))).over(own.rowsBetween(Window.unboundedPreceding, 0))
    left = F.col("wanted") - F.coalesce(words, F.lit(0)).cast("double")
    by = by.select("source", "size", left.alias("left"), squares.cast("double").alias("squares")).filter(F.col("left") * F.col("size") <= F.col("squares"))
    return by.groupBy(F.col("source").alias("_of")).agg(F.max_by(F.col("left") / F.col("squares"), "size").alias("per_word"))


def pareto_take(units: DataFrame, by: str, size: str, inclusion: str, wanted: str, draw: Column, keys: list[str]) -> DataFrame:
    """Adds taken (boolean): within each `by`, rows in Pareto order until their sizes come nearest to `wanted`.

    Rank: odds of the random draw over the odds of `inclusion`. The rank is mapped into bins of equal width; sums by
    bin (partial sums on the map side) show in which bin the wanted size is reached, and only that bin's rows are put in
    order, so that no task holds a source. Ties in rank go by `keys`. The row at which the size is reached is taken if
    that brings the sum nearer to `wanted`.
    """
    p = F.least(F.greatest(F.col(inclusion), F.lit(1e-12)), F.lit(1 - 1e-12))
    rank = (draw / (F.lit(1.0) - draw)) / (p / (F.lit(1.0) - p))
    units = units.withColumn("_rank", rank).withColumn("_bin", F.floor(F.col("_rank") / (F.col("_rank") + F.lit(1.0)) * F.lit(BINS)).cast("int"))
    bins = units.groupBy(by, "_bin").agg(F.sum(size).alias("_in_bin"), F.first(wanted).alias("_wanted"))
    run = Window.partitionBy(by).orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    bins = bins.withColumn("_until", F.sum("_in_bin").over(run)).withColumn("_before", F.col("_until") - F.col("_in_bin"))
    edge = bins.filter((F.col("_until") > F.col("_wanted")) & (F.col("_before") <= F.col("_wanted")))
    edge = edge.groupBy(F.col(by).alias("_by")).agg(F.min(F.struct("_bin", "_before")).alias("_edge"))
    units = units.join(edge, F.col(by).eqNullSafe(F.col("_by")), "left")  # one row a source
    at_edge = F.col("_bin") == F.col("_edge._bin")
    rest = units.filter(~F.coalesce(at_edge, F.lit(False))).withColumn("taken", (F.col("_edge").isNull() | (F.col("_bin") < F.col("_edge._bin"))) & (F.col(wanted) > 0))
    inside = Window.partitionBy(by).orderBy("_rank", *keys).rowsBetween(Window.unboundedPreceding, 0)
    ranked = units.filter(at_edge).withColumn("_sum", F.col("_edge._before") + F.sum(size).over(inside))
    short = F.col(wanted) - (F.col("_sum") - F.col(size))
    ranked = ranked.withColumn("taken", (short > 0) & ((F.col("_sum") <= F.col(wanted)) | (F.col("_sum") - F.col(wanted) < short))).drop("_sum")
    return rest.unionByName(ranked).drop("_rank", "_bin", "_by", "_edge")


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_copies: int = 3, share: float = 1.0, seed: int = 17) -> DataFrame:
    """How often each document goes into the mix. docs: doc_id, source, text; other columns are not looked at.

    Returns one row for each row of docs: doc_id, source, size (words), source_size, target, copies, taken (size * copies).
    Null text: size 0. A null source is a source. Documents of size 0 are taken as often as the certain copies say (once
    more if the whole source is) and add no words. Repeated rows count each; rows that agree in doc_id draw alike and are ordered by size. An empty table
    gives an empty result. Reruns agree, since draws depend on seed and doc_id alone.
    """
    sized = cut(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")))
    totals = cut(source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_copies, share))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    totals = totals.withColumn("certain", F.floor(rate + F.lit(1e-12)).cast("long"))
    totals = totals.withColumn("wanted", F.greatest(F.col("target") - F.col("certain") * F.col("source_size"), F.lit(0.0)))
    units = sized.join(totals.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    units = units.join(inclusion_rates(units), F.col("source").eqNullSafe(F.col("_of")), "left").drop("_of")  # one row a source
    units = units.withColumn("part", F.least(F.lit(1.0), F.col("size") * F.coalesce("per_word", F.lit(0.0))))
    drawn = pareto_take(units, "source", "size", "part", "wanted", random_share(seed, F.col("doc_id")), ["doc_id", "size"])
    copies = F.col("certain") + F.when(F.col("taken"), F.lit(1)).otherwise(F.lit(0))
    return drawn.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"))


def repeat(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs, each as often as mix() takes it. Rows that repeat an id are taken as often as the one taken most, rows without an id likewise as one id.

    Null texts have size 0 and are taken as mix() says of such. All columns stay, whatever their names; an empty table gives an empty result."""
    key, times = fresh(docs, "of_doc"), fresh(docs, "times")
    copies = mix(docs, **how).groupBy(F.col("doc_id").alias(key)).agg(F.max("copies").cast("int").alias(times)).filter(F.col(times) > 0)
    both = docs.join(copies, F.col("doc_id").eqNullSafe(F.col(key))).drop(key)
    return both.select(*[F.col(c) for c in docs.columns], F.explode(F.array_repeat(F.lit(0), F.col(times))).alias(key)).drop(key)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
