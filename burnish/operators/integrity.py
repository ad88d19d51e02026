"""Foreign keys between facts and dimensions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from burnish.functions.text import named
from burnish.operators.skew import join_without_hot_tasks

REFERENCE = "__reference"
COPIES = "__copies"
USED = "__used"


@dataclass(frozen=True)
class Reference:
    """A foreign key to check: column `fk` of the fact points to column `pk` of `dim`."""

    dim: DataFrame
    fk: str
    pk: str
    name: str


def orphans(fact: DataFrame, dim: DataFrame, fk: str, pk: str, **hot: Any) -> DataFrame:
    """Fact rows whose key is not in the dimension. A null key is an orphan.

    `hot`: `share`, `min_rows` and `spread_by` of `join_without_hot_tasks`.
    """
    return join_without_hot_tasks(fact, dim.select(named(pk)).distinct(), fk, pk, "left_anti", **hot)


def integrity_report(fact: DataFrame, references: Sequence[Reference]) -> DataFrame:
    """One row per reference: `check_name` and `violation_count`, the number of orphans, nulls included.

    One scan of the fact feeds all references: its foreign keys become rows of (reference, key) that are counted before
    they are shuffled, so a hot key (null, too) leaves every task as one row. The counts meet the keys of all dimensions
    in one anti join, which reuses their partitioning. Keys of different types have a column each and are compared as
    they are; foreign and primary key need types that Spark compares without a cast to text.
    """
    if not references:
        raise ValueError("name a reference to check")
    kinds = [_common_type(fact, r) for r in references]
    keys = {kind: f"__key{i}" for i, kind in enumerate(dict.fromkeys(kinds))}

    def columns(i: int, key: Column) -> list[Column]:
        return [F.lit(i), *(key.cast(k) if k == kinds[i] else F.lit(None).cast(k) for k in keys)]

    names = [REFERENCE, *keys.values()]
    pairs = [c for i, r in enumerate(references) for c in columns(i, named(r.fk))]
    used = fact.select(F.stack(F.lit(len(references)), *pairs).alias(*names))
    per_key = used.groupBy(*names).agg(F.count("*").alias("n"))
    known = reduce(
        DataFrame.unionByName,
        (
            r.dim.where(named(r.pk).isNotNull()).select(*(c.alias(n) for c, n in zip(columns(i, named(r.pk)), names)))
            for i, r in enumerate(references)
        ),
    ).distinct()
    # The null key of a fact finds no partner, as no dimension row has it. With several types a known key fills one
    # column, and the others agree by their null.
    right = known.select(*(F.col(n).alias(f"{n}_known") for n in names))
    same = F.col(REFERENCE) == F.col(f"{REFERENCE}_known")
    for n in names[1:]:
        equal = F.col(n) == F.col(f"{n}_known") if len(keys) == 1 else F.col(n).eqNullSafe(F.col(f"{n}_known"))
        same = same & equal
    missing = per_key.join(right, same, "left_anti")
    each = missing.agg(*(_sum_where(F.col(REFERENCE) == i, "n").alias(f"n{i}") for i in range(len(references))))
    rows = [c for i, r in enumerate(references) for c in (F.lit(r.name), F.col(f"n{i}"))]
    return each.select(F.stack(F.lit(len(references)), *rows).alias("check_name", "violation_count")).orderBy("check_name")


def _sum_where(condition: Column, n: str) -> Column:
    return F.coalesce(F.sum(F.when(condition, F.col(n))), F.lit(0))


def _common_type(fact: DataFrame, r: Reference) -> str:
    """The type that Spark compares both keys of a reference in; whole numbers of any size share one."""
    both = fact.select(named(r.fk).alias("k")).union(r.dim.select(named(r.pk).alias("k")))
    kind = both.schema[0].dataType
    return "bigint" if isinstance(kind, IntegralType) else kind.simpleString()


def mark_orphans(fact: DataFrame, references: Sequence[Reference], **hot: Any) -> DataFrame:
    """`fact` with a boolean column per reference, named as the reference: true where its key, or a null, is unknown.

    Each dimension's distinct keys are broadcast if they fit; else the hot keys of the fact are dealt out, see
    `join_without_hot_tasks`, which takes `hot`.
    """
    marked = fact
    for r in references:
        keys = r.dim.where(named(r.pk).isNotNull()).select(named(r.pk).alias("__pk")).distinct()
        keys = keys.withColumn("__known", F.lit(True))
        marked = join_without_hot_tasks(marked, keys, r.fk, "__pk", "left", **{"keys_in": fact, "spread_by": fact.columns} | hot)
        marked = marked.withColumn(r.name, F.col("__known").isNull()).drop("__known")
    return marked


def enrich(
    fact: DataFrame, dim: DataFrame, fk: str, pk: str | None = None, require_unique: bool = True, **hot: Any
) -> DataFrame:
    """Inner join of a fact to a dimension; orphans drop out, the dimension's key column, too.

    A key that occurs twice in the dimension would multiply fact rows. With `require_unique` the query fails if a fact
    refers to such a key; one that no fact uses does no harm. `duplicate_count(dim, [pk])` tells beforehand how many
    there are. `hot`: `share`, `min_rows` and `spread_by` of `join_without_hot_tasks`.
    """
    pk = pk or fk
    if not require_unique:
        return join_without_hot_tasks(fact, dim, fk, pk, "inner", **hot)
    # The check must see keys that a fact uses only. It reads a column that nothing but the fact's side has, as the
    # optimiser would else write it in terms of the dimension's key and move it below the join.
    used = fact.withColumn(USED, F.xxhash64(named(fk)) % 2 == 0)
    joined = join_without_hot_tasks(used, _one_row_a_key(dim, pk), fk, pk, "inner", **hot)
    key = F.concat(named(fk).cast("string"), F.when(F.col(USED), F.lit("")).otherwise(F.lit(" ")))
    return joined.where(_used_once(key, pk)).drop(COPIES, USED)


def _one_row_a_key(df: DataFrame, key: str) -> DataFrame:
    """One row per non-null key, and how many there were."""
    others = [c for c in df.columns if c != key]
    return df.where(named(key).isNotNull()).groupBy(named(key)).agg(
        *[F.any_value(named(c)).alias(c) for c in others], F.count("*").alias(COPIES)
    )


def _used_once(used: Column, key: str) -> Column:
    """Fails where a key stands for several rows."""
    message = F.concat(F.lit(f"{key} is not unique: "), used.cast("string"))
    return F.when(F.col(COPIES) == 1, True).otherwise(F.raise_error(message))


def assert_unique(df: DataFrame, key: str) -> DataFrame:
    """`df` without change; reading it fails when a non-null key occurs more than once.

    Columns that a query does not use are pruned as usual.
    """
    unique = _used_once(named(key), key)
    return _one_row_a_key(df, key).where(unique).select(*[named(c) for c in df.columns])
