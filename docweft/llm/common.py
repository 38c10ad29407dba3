"""What the operators of this subpackage share: reading tables, cutting lineage, and words of a text."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a longest run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the one the session names, else (one machine, as in tests) a new one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = spark.conf.get("docweft.shared.dir", None)
        if not named:
            named = tempfile.mkdtemp(prefix="docweft-")
            spark.conf.set("docweft.shared.dir", named)
    return named


def cut(df: DataFrame, **how: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: later jobs start there, whichever executors are lost."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.options(**how).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def let_go(spark: SparkSession) -> None:
    """Drops what finished steps have left on the driver: their plans, and by way of Spark's cleaner their broadcasts and shuffles, which otherwise stay until the JVM happens to collect them."""
    gc.collect()
    spark.sparkContext._jvm.java.lang.System.gc()


def n_words(text: Column) -> Column:
    return F.when(text.isNull(), F.lit(0)).otherwise(F.regexp_count(text, F.lit(WORD))).cast("long")


def tasks(spark: SparkSession) -> int:
    """How many tasks a shuffle of this session has; the session's owner sets it to suit the data."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: A table of ids of up to so many rows (some 15 MB in memory) is sent to all tasks; a larger one is joined by shuffles.
SMALL = 300_000


def small(df: DataFrame, most: int = SMALL) -> DataFrame:
    """df, to be broadcast in joins if it has at most `most` rows. Only for tables that are cut and have few narrow columns."""
    return F.broadcast(df) if df.count() <= most else df


def most_odd(apart: Column, bits: int) -> Column:
    """How many bits of two odd sketches may differ if at most `apart` elements are in one of the sets only (4 standard errors allowed: it fails with a chance of 3e-5).

    Such elements fall on bits at random; a bit differs if it gets an odd number of them.
    """
    full = F.exp(apart * (-4.0 / bits))
    expected = (F.lit(1.0) - F.exp(apart * (-2.0 / bits))) * (bits / 2)
    variance = (F.lit(1.0) - full) * (bits / 4) - apart * full
    return expected + F.sqrt(F.greatest(variance, F.lit(0.0)) + 0.25) * 4.0 + 1.0
