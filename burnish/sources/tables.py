"""Tables of the session's catalog."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def quoted(*names: str) -> str:
    return ".".join("`" + name.replace("`", "``") + "`" for name in names)


def as_text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def save_table(df: DataFrame, db: str, name: str, location: str | None = None) -> None:
    """Replace table `db`.`name` by `df`; the database is created when missing, at `location` if given.

    The rows go to a folder of their own below the database; when they are complete, the catalog entry is pointed to
    it in one step and the old folder is deleted. A job that fails or is killed before that leaves the old table as it
    was, and `df` may read the table that it replaces. Columns of other names or types need a new entry instead of a
    new place: the old one is dropped after the new one was tried out under another name.
    """
    spark = df.sparkSession
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {quoted(db)}" + (f" LOCATION {as_text(location)}" if location else ""))
    # The place of a database is a URI, in which blanks and such are written as codes; paths have them as they are.
    root = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(spark.catalog.getDatabase(db).locationUri)).toString()
    path = f"{root}/{re.sub(r'[^A-Za-z0-9_]', '_', name)}.{uuid.uuid4().hex}"
    df.write.parquet(path)
    _point(spark, db, name, df.schema, path)


def _point(spark: SparkSession, db: str, name: str, schema: StructType, path: str) -> None:
    table = quoted(db, name)
    old = ""
    known = spark.catalog.tableExists(table)
    if known:
        if spark.table(table).schema.simpleString() == schema.simpleString():
            old = _own_location(spark, table)
        else:
            trial = quoted(db, f"{name}_{uuid.uuid4().hex}")
            spark.catalog.createTable(trial, schema=schema, source="parquet")
            spark.sql(f"DROP TABLE {trial}")
            spark.sql(f"DROP TABLE {table}")
            known = False
    if not known:
        spark.catalog.createTable(table, schema=schema, source="parquet")
        old = _own_location(spark, table)
    spark.sql(f"ALTER TABLE {table} SET LOCATION {as_text(path)}")
    spark.catalog.refreshTable(table)
    if old:
        _delete(spark, old)


def _own_location(spark: SparkSession, table: str) -> str:
    """Where the files of a table lie, if it owns them: those of an external table are left alone."""
    rows = spark.sql(f"DESCRIBE TABLE EXTENDED {table}").where("col_name in ('Location', 'Type')").collect()
    facts = {r.col_name: r.data_type for r in rows}
    return facts["Location"] if facts["Type"] == "MANAGED" else ""


def _delete(spark: SparkSession, path: str) -> None:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def load_table(spark: SparkSession, db: str, name: str) -> DataFrame:
    return spark.table(quoted(db, name))
