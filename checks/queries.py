"""One Spark query per operator, report and job, over the dirty tables and the test tables themselves.

Every query takes `(spark, sf_dir)` and has SQL of the same name in `checks.oracle`.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from burnish import operators as op
from burnish import plans
from burnish.functions import exact_total
from burnish.operators.integrity import Reference
from burnish.rules import CATEGORY_TERMS, PAYMENT_RULES, STATUS_RULES, UNMAPPED_LABEL
from burnish.session import tune
from burnish.sources import current_reports, load_table, read_raw, save_table, stored, write_report
from checks.dirty import raw_customers, raw_materials, raw_orders, table
from checks.scratch import scratch_dir

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(build: Query) -> Query:
    QUERIES[build.__name__] = lambda spark, sf_dir: build(tune(spark), sf_dir)
    return build


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.clean_customers(raw_customers(spark, sf_dir), ["seq"], device_col="device_ids")


def materials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.clean_materials(raw_materials(spark, sf_dir))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.clean_orders(raw_orders(spark, sf_dir))


def dates_as_text(df: DataFrame) -> DataFrame:
    return df.withColumn("order_date_clean", F.col("order_date_clean").cast("string"))


def lists_as_text(df: DataFrame) -> DataFrame:
    return df.withColumn("device_list", F.array_join("device_list", ";"))


# Sources and sinks: write, read back


@query
def roundtrip_raw_csv(spark, sf_dir):
    raw, path = raw_orders(spark, sf_dir), scratch_dir(spark)
    keep_spaces = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    raw.write.options(header=True, **keep_spaces).csv(path)
    return read_raw(spark, path, raw.columns)


@query
def roundtrip_table(spark, sf_dir):
    db = f"roundtrip_{uuid.uuid4().hex}"
    save_table(orders(spark, sf_dir), db, "orders_fact", location=scratch_dir(spark))
    rows = stored(dates_as_text(load_table(spark, db, "orders_fact")))
    spark.sql(f"DROP DATABASE {db} CASCADE")
    return rows


@query
def report_roundtrip(spark, sf_dir):
    path = scratch_dir(spark)
    report = plans.revenue_by_category(orders(spark, sf_dir), materials(spark, sf_dir))
    write_report(report, path, [F.desc("total_revenue"), "category"])
    return spark.read.schema(report.schema).csv(path, header=True)


# Standardisation and flags


@query
def names(spark, sf_dir):
    raw = raw_customers(spark, sf_dir).select("customer_id", "seq", "first_name", "last_name")
    return op.standardize_names(raw, ["first_name", "last_name"])


@query
def missing_emails(spark, sf_dir):
    raw = raw_customers(spark, sf_dir).select("customer_id", "seq", "email")
    return op.flag_missing(raw, "email", "email_missing")


@query
def missing_prices(spark, sf_dir):
    raw = raw_materials(spark, sf_dir).select("product_id", "price")
    return op.flag_missing(raw, "price", "price_missing", blank_is_missing=True)


@query
def phones(spark, sf_dir):
    raw = raw_customers(spark, sf_dir).select("customer_id", "seq", "phone_number")
    return op.normalize_phone(raw, "phone_number").drop("phone_number")


@query
def devices(spark, sf_dir):
    raw = raw_customers(spark, sf_dir).select("customer_id", "seq", "device_ids")
    return lists_as_text(op.split_multivalue(raw, "device_ids")).drop("device_ids")


@query
def categories(spark, sf_dir):
    raw = raw_materials(spark, sf_dir).select("product_id", F.col("category").alias("category_raw"))
    mapped = op.canonicalize_terms(raw, "category_raw", CATEGORY_TERMS, out="category")
    return op.flag_unmapped(mapped, "category", "category_missing")


@query
def categories_from_table(spark, sf_dir):
    raw = raw_customers(spark, sf_dir).select("customer_id", "seq", "first_name")
    words = table(spark, sf_dir, "customer").select(F.lower("c_mktsegment").alias("word")).distinct()
    return op.canonicalize_terms_from(raw, "first_name", words, "word", out="segment")


@query
def ambiguous_prefixes(spark, sf_dir):
    return op.ambiguous_prefixes(table(spark, sf_dir, "part"), "p_name")


@query
def price_tokens(spark, sf_dir):
    return op.null_tokens(raw_materials(spark, sf_dir).select("product_id", "price"), "price")


@query
def amounts_materials(spark, sf_dir):
    raw = raw_materials(spark, sf_dir).select("product_id", "price")
    df = op.null_tokens(raw, "price", out="price_str")
    df = op.parse_amount(df, "price_str", "price_clean", text="price_str")
    return op.flag_invalid_amount(df, "price_clean", "price_invalid")


@query
def amounts_orders(spark, sf_dir):
    raw = raw_orders(spark, sf_dir).select("order_id", "order_amount")
    df = op.null_tokens(raw, "order_amount", out="order_amount_clean")
    df = op.parse_amount(df, "order_amount_clean")
    return op.flag_missing_amount(df, "order_amount_clean", "order_amount_missing")


@query
def payments(spark, sf_dir):
    raw = raw_orders(spark, sf_dir).select("order_id", "payment_method")
    return op.map_synonyms(raw, "payment_method", PAYMENT_RULES, letters=True, out="payment_method_clean")


@query
def statuses(spark, sf_dir):
    raw = raw_orders(spark, sf_dir).select("order_id", "status")
    return op.map_synonyms(raw, "status", STATUS_RULES, letters=False, out="status_clean")


@query
def date_flags(spark, sf_dir):
    return op.flag_sentinel(raw_orders(spark, sf_dir).select("order_id", "order_date"), "order_date")


@query
def dates(spark, sf_dir):
    flagged = op.flag_sentinel(raw_orders(spark, sf_dir).select("order_id", "order_date"), "order_date")
    return dates_as_text(op.parse_dates(flagged, "order_date", mark_unparsed=True))


@query
def labelled_categories(spark, sf_dir):
    return op.label_missing(materials(spark, sf_dir).select("product_id", "category"), "category", UNMAPPED_LABEL)


# Duplicates, joins, integrity


@query
def dedup_customers(spark, sf_dir):
    return op.dedup_keep_first(raw_customers(spark, sf_dir), ["customer_id"], [F.desc("seq")])


def _lineitem(spark, sf_dir):
    ship_date = F.col("l_shipdate").cast("date").cast("string").alias("ship_date")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", ship_date, "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
        "l_discount", "l_tax", "l_returnflag", "l_linestatus",
    )


@query
def dedup_lineitem(spark, sf_dir):
    return op.dedup_keep_first(_lineitem(spark, sf_dir), ["l_orderkey", "l_linenumber"], ["ship_date"])


@query
def dedup_lineitem_copies(spark, sf_dir):
    return op.dedup_keep_first(_lineitem(spark, sf_dir), ["l_orderkey", "l_linenumber"], ["ship_date"], "copies")


@query
def duplicate_counts(spark, sf_dir):
    raw = op.duplicate_count(raw_customers(spark, sf_dir), ["customer_id"])
    lines = op.duplicate_count(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])
    return raw.select(F.lit("customers").alias("table_name"), "*").unionByName(
        lines.select(F.lit("lineitem").alias("table_name"), "*")
    )


@query
def orphan_orders(spark, sf_dir):
    facts = raw_orders(spark, sf_dir).select("order_id", "customer_id", "product_id")
    return op.orphans(facts, raw_customers(spark, sf_dir), "customer_id", "customer_id")


@query
def integrity_report(spark, sf_dir):
    return plans.order_integrity(orders(spark, sf_dir), customers(spark, sf_dir), materials(spark, sf_dir))


@query
def integrity_lineitem(spark, sf_dir):
    return op.integrity_report(
        table(spark, sf_dir, "lineitem"),
        [
            Reference(table(spark, sf_dir, "orders"), "l_orderkey", "o_orderkey", "l_orderkey"),
            Reference(table(spark, sf_dir, "part"), "l_partkey", "p_partkey", "l_partkey"),
            Reference(table(spark, sf_dir, "supplier"), "l_suppkey", "s_suppkey", "l_suppkey"),
            Reference(table(spark, sf_dir, "region"), "l_suppkey", "r_regionkey", "l_suppkey in regions"),
        ],
    )


ENRICHED = ("order_id", "customer_id", "product_id", "order_amount_clean", "category", "price_clean")


@query
def enriched_orders(spark, sf_dir):
    return op.enrich(orders(spark, sf_dir), materials(spark, sf_dir), "product_id").select(*ENRICHED)


@query
def marked_orders(spark, sf_dir):
    """Orders with a mark for each unknown key, null keys among them."""
    facts = raw_orders(spark, sf_dir).select("order_id", "customer_id", "product_id")
    return op.mark_orphans(facts, plans.order_references(raw_customers(spark, sf_dir), raw_materials(spark, sf_dir)))


@query
def enriched_used_keys(spark, sf_dir):
    """Materials with a second row for the products that only odd orders use: even orders don't meet it."""
    facts = orders(spark, sf_dir).select("order_id", "product_id")
    even = F.col("order_id").cast("long") % 2 == 0
    known = materials(spark, sf_dir).select("product_id", "category")
    unused = known.join(facts.where(even).select("product_id"), "product_id", "left_anti")
    return op.enrich(facts.where(even), known.unionByName(unused), "product_id")


# Reports


@query
def small_amounts(spark, sf_dir):
    """Amounts of more decimals than cents have: none of them is cut before it is added."""
    tiny = (F.col("l_extendedprice") / 1e9).alias("amount")
    lines = table(spark, sf_dir, "lineitem").select("l_returnflag", tiny)
    return lines.groupBy("l_returnflag").agg(F.count("*").alias("line_count"), exact_total(F.col("amount")).alias("total"))


@query
def segments_as_written(spark, sf_dir):
    """Words of a vocabulary in upper case are found, and come back as they are written."""
    raw = table(spark, sf_dir, "customer").select("c_custkey", F.lower("c_mktsegment").alias("segment"))
    return op.canonicalize_terms(raw, "segment", ["AUTOMOBILE", "BUILDING", "Machinery"], min_prefix=4)


@query
def row_reconciliation(spark, sf_dir):
    return plans.row_reconciliation(
        [
            ("customer_master", raw_customers(spark, sf_dir), customers(spark, sf_dir)),
            ("material_master", raw_materials(spark, sf_dir), materials(spark, sf_dir)),
            ("orders_fact", raw_orders(spark, sf_dir), orders(spark, sf_dir)),
        ]
    )


@query
def customer_quality_summary(spark, sf_dir):
    return plans.customer_quality_summary(customers(spark, sf_dir))


@query
def material_quality_by_category(spark, sf_dir):
    return plans.material_quality_by_category(materials(spark, sf_dir))


@query
def material_clean_rate(spark, sf_dir):
    return plans.material_clean_rate(materials(spark, sf_dir))


@query
def date_quality(spark, sf_dir):
    return plans.date_quality(orders(spark, sf_dir))


@query
def payment_distribution(spark, sf_dir):
    return plans.payment_distribution(orders(spark, sf_dir))


@query
def status_distribution(spark, sf_dir):
    return plans.status_distribution(orders(spark, sf_dir))


@query
def missing_amount_rate(spark, sf_dir):
    rate = plans.missing_rate(orders(spark, sf_dir), "order_amount_missing", prefix="missing_amount")
    return rate.withColumnRenamed("total_rows", "total_orders")


@query
def revenue_by_category(spark, sf_dir):
    return plans.revenue_by_category(orders(spark, sf_dir), materials(spark, sf_dir))


@query
def revenue_by_category_success(spark, sf_dir):
    return plans.revenue_by_category(
        orders(spark, sf_dir), materials(spark, sf_dir), label=UNMAPPED_LABEL, statuses=["success"]
    )


@query
def payment_status_crosstab(spark, sf_dir):
    return plans.payment_status_crosstab(orders(spark, sf_dir))


@query
def orders_summary(spark, sf_dir):
    return plans.orders_summary(orders(spark, sf_dir))


@query
def reconciliation_summary(spark, sf_dir):
    return plans.reconciliation_summary(
        customers(spark, sf_dir), materials(spark, sf_dir), orders(spark, sf_dir)
    )


@query
def unmapped_counts(spark, sf_dir):
    return plans.unmapped_counts(orders(spark, sf_dir), ["payment_method_clean", "status_clean"])


@query
def unmapped_categories(spark, sf_dir):
    return plans.unmapped_counts(materials(spark, sf_dir), ["category"])


@query
def date_parse_success(spark, sf_dir):
    return plans.parse_success(orders(spark, sf_dir))


ORDER_PROFILE = ["payment_method", "status", "order_date", "order_amount", "customer_id", "product_id"]


@query
def profile_orders(spark, sf_dir):
    return op.profile_columns(raw_orders(spark, sf_dir), ORDER_PROFILE)


@query
def profile_lineitem(spark, sf_dir):
    cols = ["l_partkey", "l_suppkey", "l_returnflag", "l_linestatus", "l_linenumber"]
    return op.profile_columns(table(spark, sf_dir, "lineitem"), cols)


@query
def top_order_values(spark, sf_dir):
    return op.top_values(raw_orders(spark, sf_dir), ORDER_PROFILE, 5)


@query
def top_order_values_many(spark, sf_dir):
    """More values than one task should rank."""
    return op.top_values(raw_orders(spark, sf_dir), ORDER_PROFILE, 5000)


@query
def profile_values(spark, sf_dir):
    """Values of several types, counted as values: instants around the end of summer time, decimals, bytes, days."""
    instant = F.timestamp_seconds(F.lit(1793493000) + F.col("o_orderkey") % 180 * 60)
    day = F.when(F.col("o_orderkey") % 5 > 0, F.col("o_orderdate").cast("date"))
    columns = {
        "instant": instant,
        "price": F.round(F.col("o_totalprice") * 100).cast("decimal(12,0)") / F.lit(100).cast("decimal(3,0)"),
        "bytes": F.unhex(F.concat(F.lit("FE"), F.lpad(F.hex(F.col("o_custkey") % 300), 6, "0"))),
        "day": day,
    }
    values = table(spark, sf_dir, "orders").select(*(c.alias(name) for name, c in columns.items()))
    return op.profile_columns(values, list(columns))


@query
def profile_payment(spark, sf_dir):
    return op.profile_column(raw_orders(spark, sf_dir), "payment_method", 20)


# Jobs


@query
def job_customers(spark, sf_dir):
    return lists_as_text(customers(spark, sf_dir))


@query
def job_materials(spark, sf_dir):
    return materials(spark, sf_dir)


@query
def job_orders(spark, sf_dir):
    return dates_as_text(orders(spark, sf_dir))


def report_cells(spark: SparkSession, path: str, name: str, schema: T.StructType) -> DataFrame:
    """The cells of a report as it was written, rows numbered in the order of the file."""
    rows = spark.read.schema(schema).csv(f"{path}/{name}", header=True)
    rows = rows.withColumn("row_number", F.monotonically_increasing_id() + 1)
    cells = []
    for field in schema:
        is_text = isinstance(field.dataType, T.StringType)
        text = F.col(field.name) if is_text else F.lit(None).cast("string")
        number = F.lit(None).cast("double") if is_text else F.col(field.name).cast("double")
        cells.append(
            F.struct(F.lit(field.name).alias("column_name"), text.alias("text_value"), number.alias("number_value"))
        )
    cell = rows.select(F.lit(name).alias("report"), "row_number", F.explode(F.array(*cells)).alias("cell"))
    return cell.select("report", "row_number", "cell.*")


def loaded(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    """Raw CSV files loaded into the tables of a new database: its name, and the scratch folder around it."""
    path, db = scratch_dir(spark), f"quality_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {db} LOCATION '{path}/tables'")
    raw = {
        "customers": raw_customers(spark, sf_dir),
        "materials": raw_materials(spark, sf_dir),
        "orders": raw_orders(spark, sf_dir),
    }
    for name, df in raw.items():
        df.write.option("header", True).csv(f"{path}/raw/{name}")
    plans.load_customers(spark, f"{path}/raw/customers", db, ["seq"], "device_ids", raw["customers"].columns)
    plans.load_materials(spark, f"{path}/raw/materials", db, raw["materials"].columns)
    plans.load_orders(spark, f"{path}/raw/orders", db, raw["orders"].columns)
    return db, path


@query
def load_metrics(spark, sf_dir):
    """What the three load jobs counted while they wrote, orphans among it."""
    db, _ = loaded(spark, sf_dir)
    metrics = stored(load_table(spark, db, "load_metrics"))
    spark.sql(f"DROP DATABASE {db} CASCADE")
    return metrics


@query
def quality_reports(spark, sf_dir):
    """Raw CSV files to clean tables to a published set of report files, read back."""
    db, path = loaded(spark, sf_dir)
    plans.quality_reports(spark, db, f"{path}/reports")
    spark.sql(f"DROP DATABASE {db} CASCADE")
    written = current_reports(spark, f"{path}/reports")
    cells = [report_cells(spark, written.folder, name, written.read(spark, name).schema) for name in written.reports]
    return reduce(DataFrame.unionByName, cells)
