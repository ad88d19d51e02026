"""Raw CSV files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from burnish.functions.text import named


def read_raw(
    spark: SparkSession, path: str, columns: Sequence[str] | None = None, corrupt: str | None = None
) -> DataFrame:
    """CSV with a header, every column a string, so that no value is lost to a guessed type.

    With `columns` nothing is read before the query runs; without, the names come from the header of a first file. A
    file whose header has other names or another order fails instead of filling the wrong columns. Records end at line
    ends, which keeps large files splittable.

    A record with too few cells is filled up with null, one with too many loses them. `corrupt` names a column that
    holds the text of such records, and null for sound ones; `malformed_count` counts them.
    """
    reader = spark.read.option("header", True).option("enforceSchema", False)
    if columns is None:
        columns = reader.option("inferSchema", False).csv(path).columns
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    if corrupt is not None:
        schema = schema.add(corrupt, T.StringType())
        reader = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", corrupt)
    return reader.schema(schema).csv(path)


def malformed_count(raw: DataFrame, corrupt: str) -> DataFrame:
    """One row: `row_count` and `malformed_count` of a table read with a `corrupt` column."""
    # All columns are read: Spark counts the cells of a record only as far as a query asks for them.
    cells = F.xxhash64(*[named(c) for c in raw.columns if c != corrupt])
    broken = F.when(named(corrupt).isNotNull(), cells)
    return raw.agg(F.count("*").alias("row_count"), F.count(broken).alias("malformed_count"))
