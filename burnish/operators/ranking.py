"""Ranks within groups of any size, without a task that holds a whole group."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from burnish.functions.text import named
from burnish.sources.scratch import stored

PART = "__part"
ROW = "__row"
FIRST = "__first"
SIZE = "__size"
BEFORE = "__before"
GROUP = "__group"


def ranked(
    df: DataFrame, by: Sequence[str], order: Sequence[str | Column], out: str = "rank", top: int | None = None
) -> DataFrame:
    """`df` with the rank, from 1, of each row among those of its group; with `top`, only ranks up to it.

    Rows are dealt out by ranges of (`by`, `order`) and sorted within, so a group lies in as many consecutive
    partitions as it needs. A rank is the position within the partition plus the sizes of the group's earlier
    partitions, a running sum over one row per group and partition. Null is a group of its own; rows that are equal in
    `order` get ranks in any order; `order` should tell rows apart where ranks must be the same in each run.

    The sorted rows are written to a scratch table, as bounds that Spark samples anew would number rows otherwise; this
    runs a job.
    """
    keys: list[Column] = [named(c) for c in by]
    sort = [*keys, *(named(c) if isinstance(c, str) else c for c in order)]
    position = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    dealt = df.repartitionByRange(*sort).sortWithinPartitions(*sort)
    rows = stored(dealt.select("*", F.spark_partition_id().alias(PART), position.alias(ROW)))

    sizes = rows.groupBy(*keys, PART).agg(F.count("*").alias(SIZE), F.min(ROW).alias(FIRST))
    earlier = Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    groups = [k.alias(f"{GROUP}{i}") for i, k in enumerate(keys)]
    offsets = sizes.select(
        *groups, F.col(PART).alias(GROUP), FIRST, F.coalesce(F.sum(SIZE).over(earlier), F.lit(0)).alias(BEFORE)
    )
    if top is not None:
        offsets = offsets.where(F.col(BEFORE) < top)
    same = reduce(
        Column.__and__,
        (k.eqNullSafe(F.col(f"{GROUP}{i}")) for i, k in enumerate(keys)),
        F.col(PART) == F.col(GROUP),
    )
    numbered = rows.join(offsets, same).select(
        *(named(c) for c in df.columns), (F.col(ROW) - F.col(FIRST) + F.col(BEFORE) + 1).alias(out)
    )
    return numbered if top is None else numbered.where(F.col(out) <= top)
