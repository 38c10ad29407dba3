"""Tables in the folder that driver and executors share, where iterative operators cut their lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where it is unset and there is one machine only, as in tests, a new temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("docweft.shared.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="docweft-")
        spark.conf.set("docweft.shared.dir", named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: later jobs start there, whichever executors are lost."""
    path = f"{folder(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def none_in(df: DataFrame) -> bool:
    return not df.limit(1).count()
