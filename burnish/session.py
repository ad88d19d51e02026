"""Session options that the operators run best with."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import SparkSession

SETTINGS: Mapping[str, str] = {
    # HotSpot does not compile methods beyond 8000 bytes of bytecode. A cleaning stage over a wide table
    # exceeds that when it is fused into one method and then runs interpreted, at a fraction of its speed.
    # With this limit Spark generates such a stage in smaller pieces.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Spark's defaults, stated because the plans count on them: small partitions are merged, and a join
    # whose side turns out small is broadcast.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    """Set these options on a running session; they apply to the queries it plans from then on."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark
