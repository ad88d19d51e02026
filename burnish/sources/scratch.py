"""Tables that jobs write for themselves, to cut a plan in two or to fix the order of rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """A new folder that the driver and all executors share: below `spark.checkpoint.dir`, or, where a session leaves
    that setting out, below its warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/burnish-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Write to a new scratch folder and read again. What was computed before survives lost executors."""
    path = scratch_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
