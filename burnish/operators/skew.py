"""Equi-joins of a large table that stay balanced when a few keys hold a large part of its rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from burnish.functions.text import named

HOT = "__hot"
SLICES = "__slices"
SLICE = "__slice"
RIGHT_KEY = "__right_key"
RIGHT_SLICE = "__right_slice"


def fits_broadcast(df: DataFrame) -> bool:
    """Whether Spark will broadcast `df`: its size estimate is within the session's threshold.

    Reads the optimiser's statistics and runs no job. A table without usable statistics counts as
    large, and a threshold of -1 switches broadcasts off. Sessions that show no statistics (Spark
    Connect) always take the way for large tables.
    """
    frame, session = getattr(df, "_jdf", None), getattr(df.sparkSession, "_jsparkSession", None)
    if frame is None or session is None:
        return False
    size = int(str(frame.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size <= session.sessionState().conf().autoBroadcastJoinThreshold()


def hot_keys(df: DataFrame, key: str, share: float, min_rows: int) -> DataFrame:
    """Keys with more rows than one task should get, and the number of slices to cut each into.

    A slice is `share` of all rows, `min_rows` at the least. There are at most `1 / share` hot keys with
    `2 / share` slices in total, however large the table. Counting combines rows on the map side, so a
    hot key reaches the shuffle as one row per task.
    """
    counts = df.groupBy(named(key).alias(HOT)).agg(F.count("*").alias("rows"))
    total = counts.agg(F.sum("rows").alias("rows")).scalar()
    limit = F.greatest(total * F.lit(share), F.lit(float(min_rows)))
    return counts.where(F.col("rows") > limit).select(
        HOT, F.ceil(F.col("rows") / limit).cast("int").alias(SLICES)
    )


def join_without_hot_tasks(
    left: DataFrame,
    right: DataFrame,
    left_key: str,
    right_key: str,
    how: str,
    share: float = 1e-5,
    min_rows: int = 1_000_000,
    spread_by: Sequence[str] | None = None,
    keys_in: DataFrame | None = None,
) -> DataFrame:
    """`left` joined to `right` on one key, `how` being `inner`, `left` or `left_anti`.

    Result columns: those of `left`, then for `inner` and `left` those of `right` but its key.

    When Spark is going to broadcast `right`, no row of `left` moves and the join is written as is; the
    size decides the plan alone, never the result. If not, the rows of every hot key of `left` (null among them) are dealt out over its slices, and the
    rows of `right` with that key are copied to each. Only hot keys are copied, and their list can be
    broadcast because `hot_keys` bounds its length. The slice comes from the columns `spread_by` (default:
    all of `left`) and the input partition: rows that differ are dealt out even where all rows of a key
    lie in one partition, equal rows as far as they lie in several, and a lost task deals the same way
    when it runs again. Name the columns that tell rows apart if the query doesn't read the others.

    Finding the hot keys reads the key column of `left` once more, so `left` must give the same rows each time it is
    read. `keys_in` names another table to find them in: where `left` is itself the result of such joins, the table
    they began with, so that a chain of them doesn't read it over and over.
    """
    right = right.withColumnRenamed(right_key, RIGHT_KEY)
    same_key = named(left_key) == F.col(RIGHT_KEY)
    if fits_broadcast(right):
        return left.join(right, same_key, how).drop(RIGHT_KEY)

    hot = F.broadcast(hot_keys(left if keys_in is None else keys_in, left_key, share, min_rows))
    slices = F.coalesce(F.col(SLICES), F.lit(1))
    dealt = (
        left.join(hot, named(left_key).eqNullSafe(F.col(HOT)), "left")
        .withColumn(SLICE, F.pmod(F.xxhash64(*map(named, spread_by or left.columns)) + F.spark_partition_id(), slices).cast("int"))
        .drop(HOT, SLICES)
    )
    copied = (
        right.join(hot, F.col(RIGHT_KEY).eqNullSafe(F.col(HOT)), "left")
        .withColumn(RIGHT_SLICE, F.explode(F.sequence(F.lit(0), slices - 1)))
        .drop(HOT, SLICES)
    )
    same_slice: Column = F.col(SLICE) == F.col(RIGHT_SLICE)
    return dealt.join(copied, same_key & same_slice, how).drop(SLICE, RIGHT_KEY, RIGHT_SLICE)
