"""End-to-end jobs: raw files to clean tables to reports.

The `clean_*` functions only describe the work. The `load_*` functions read raw files and write one
table each, with a single pass over the raw data. Reports read the written tables, so an executor lost
in between costs its own tasks and never the cleaning.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from burnish.functions.text import named
from burnish.operators.amounts import flag_invalid_amount, flag_missing_amount, null_tokens, parse_amount
from burnish.operators.dates import flag_sentinel, parse_dates
from burnish.operators.dedup import dedup_keep_first
from burnish.operators.integrity import Reference, mark_orphans
from burnish.operators.standardize import flag_missing, normalize_phone, split_multivalue, standardize_names
from burnish.operators.vocabulary import canonicalize_terms, flag_unmapped, map_synonyms
from burnish.plans import reports
from burnish.rules import (
    CATEGORY_TERMS,
    DATE_FORMATS,
    DATE_SENTINELS,
    DIGIT_LETTERS,
    FLAG_MISSING,
    FLAG_SENTINEL,
    MISSING_TOKENS,
    PAYMENT_RULES,
    STATUS_RULES,
    Synonyms,
)
from burnish.sources import ReportSet, load_table, publish_reports, read_raw, save_table, stored, write_report
from burnish.sources.tables import quoted

CUSTOMERS = "customer_master"
MATERIALS = "material_master"
ORDERS = "orders_fact"
ORDERS_SUMMARY = "orders_summary"
METRICS = "load_metrics"
METRIC_SCHEMA = "table_name string, metric string, value long"


def clean_customers(
    raw: DataFrame,
    order_by: Sequence[str],
    device_col: str = "device_id(s)",
    copies: str = "source_rows",
    key: str = "customer_id",
    separator: str = ";",
    phone_digits: int = 10,
) -> DataFrame:
    """One standardised row per `key`; `copies` tells how many raw rows stand behind it.

    Duplicates go first: only raw columns are shuffled, and only the kept rows are cleaned.
    """
    df = dedup_keep_first(raw, [key], order_by, copies)
    df = standardize_names(df, ["first_name", "last_name"])
    df = flag_missing(df, "email", "email_missing")
    df = normalize_phone(df, "phone_number", keep=phone_digits)
    return split_multivalue(df, device_col, separator)


def clean_materials(
    raw: DataFrame,
    vocabulary: Sequence[str] = CATEGORY_TERMS,
    substitutions: Mapping[str, str] = DIGIT_LETTERS,
    min_prefix: int = 3,
    missing_tokens: Sequence[str] = MISSING_TOKENS,
    minimum_price: float = 0,
) -> DataFrame:
    """Canonical categories beside the raw ones, numeric prices, a flag for each defect."""
    df = raw.withColumn("category_raw", named("category"))
    df = canonicalize_terms(df, "category", vocabulary, substitutions, min_prefix)
    df = flag_unmapped(df, "category", "category_missing")
    df = null_tokens(df, "price", missing_tokens, out="price_str")
    df = parse_amount(df, "price_str", "price_clean", text="price_str")
    return flag_invalid_amount(df, "price_clean", "price_invalid", minimum_price)


def clean_orders(
    raw: DataFrame,
    payments: Sequence[Synonyms] = PAYMENT_RULES,
    statuses: Sequence[Synonyms] = STATUS_RULES,
    mark_unparsed: bool = False,
    sentinels: Sequence[str] = DATE_SENTINELS,
    date_formats: Sequence[str] = DATE_FORMATS,
    missing_tokens: Sequence[str] = MISSING_TOKENS,
) -> DataFrame:
    """Canonical payment and status, parsed dates and amounts, a flag for each defect."""
    df = map_synonyms(raw, "payment_method", payments, letters=True, out="payment_method_clean")
    df = map_synonyms(df, "status", statuses, letters=False, out="status_clean")
    df = flag_sentinel(df, "order_date", sentinels, out="order_date_flag")
    df = parse_dates(df, "order_date", date_formats, mark_unparsed=mark_unparsed)
    df = null_tokens(df, "order_amount", missing_tokens, out="order_amount_str")
    df = parse_amount(df, "order_amount_str", "order_amount_clean")
    return flag_missing_amount(df, "order_amount_clean", "order_amount_missing").drop("order_amount_str")


def _load(df: DataFrame, db: str, name: str, metrics: Mapping[str, Column], drop: Sequence[str] = ()) -> None:
    """Write a table and, beside it, what was counted while it was written.

    The counts ride on the tasks that write the files. Spark adds those of a task once, when it first succeeds: a retry
    after a failure, a second attempt or a lost executor changes nothing.
    """
    counted = Observation()
    columns = {f"m{i}": metric for i, metric in enumerate(metrics)}
    observed = df.observe(counted, *[metrics[metric].cast("long").alias(c) for c, metric in columns.items()])
    save_table(observed.drop(*drop), db, name)
    found = counted.get
    rows = [(name, metric, found.get(c) or 0) for c, metric in columns.items()]
    spark = df.sparkSession
    new = spark.createDataFrame(rows, METRIC_SCHEMA)
    if spark.catalog.tableExists(quoted(db, METRICS)):
        new = load_table(spark, db, METRICS).where(F.col("table_name") != name).unionByName(new)
    save_table(new.repartition(1), db, METRICS)


def load_customers(
    spark: SparkSession,
    path: str,
    db: str,
    order_by: Sequence[str],
    device_col: str = "device_id(s)",
    columns: Sequence[str] | None = None,
    **rules: Any,
) -> DataFrame:
    """Raw file to table. `rules`: those of `clean_customers`.

    `load_metrics` gets the raw rows, the clean rows, the duplicates between them and the missing emails.
    """
    clean = clean_customers(read_raw(spark, path, columns), order_by, device_col, **rules)
    copies = F.sum(named(rules.get("copies", "source_rows")))
    _load(clean, db, CUSTOMERS, {
        "raw_rows": copies,
        "clean_rows": F.count(F.lit(1)),
        "duplicates": copies - F.count(F.lit(1)),
        "missing:email": F.count_if("email_missing"),
    })
    return load_table(spark, db, CUSTOMERS)


def load_materials(
    spark: SparkSession, path: str, db: str, columns: Sequence[str] | None = None, **rules: Any
) -> DataFrame:
    """Raw file to table. `rules`: those of `clean_materials`.

    `load_metrics` gets the rows, unmapped categories and invalid prices.
    """
    _load(clean_materials(read_raw(spark, path, columns), **rules), db, MATERIALS, {
        "raw_rows": F.count(F.lit(1)),
        "clean_rows": F.count(F.lit(1)),
        "unmapped:category": F.count_if("category_missing"),
        "invalid:price": F.count_if("price_invalid"),
    })
    return load_table(spark, db, MATERIALS)


def load_orders(
    spark: SparkSession,
    path: str,
    db: str,
    columns: Sequence[str] | None = None,
    references: Sequence[Reference] | None = None,
    **rules: Any,
) -> DataFrame:
    """Raw file to table. `rules`: those of `clean_orders`.

    `load_metrics` gets the rows, unmapped payments and statuses, dates given, parsed and not parsed, missing amounts
    and, per reference, the orders whose key it doesn't have. `references` are the customers and materials of `db`
    unless given; masters that are not loaded yet are left out, and so are their counts. The marks themselves are not
    written: masters may change.
    """
    if references is None:
        masters = [CUSTOMERS, MATERIALS]
        known = [spark.catalog.tableExists(quoted(db, name)) for name in masters]
        pairs = zip(reports.order_references(*(load_table(spark, db, n) if k else None for n, k in zip(masters, known))), known)
        references = [r for r, k in pairs if k]
    clean = clean_orders(read_raw(spark, path, columns), **rules)
    names = [r.name for r in references]
    marked = mark_orphans(clean, references)
    flag, parsed = F.col("order_date_flag"), F.col("order_date_clean")
    _load(marked, db, ORDERS, {
        "raw_rows": F.count(F.lit(1)),
        "clean_rows": F.count(F.lit(1)),
        "unmapped:payment_method_clean": F.count_if(F.col("payment_method_clean").isNull()),
        "unmapped:status_clean": F.count_if(F.col("status_clean").isNull()),
        "dates": F.count("order_date"),
        "parsed_dates": F.count(parsed),
        "unparsed_dates": F.count_if((flag != FLAG_MISSING) & (flag != FLAG_SENTINEL) & parsed.isNull()),
        "missing:order_amount": F.count_if("order_amount_missing"),
        **{f"orphans:{name}": F.count_if(named(name)) for name in names},
    }, drop=names)
    return load_table(spark, db, ORDERS)


def quality_reports(spark: SparkSession, db: str, out_dir: str) -> ReportSet:
    """All reports over the tables of `db`, published below `out_dir` as one set.

    Each master is read twice, for its keys and for its summary; the orders three times, for their labels, their keys
    and their amounts. All reports are made of what these passes leave. Readers find the set by `current_reports`; a
    run that stops half-way leaves the set before it.

    The keys of both masters are checked first. If one repeats, the job fails and publishes nothing;
    `duplicate_keys`, beside the sets, tells how many.
    """
    customers = load_table(spark, db, CUSTOMERS)
    materials = load_table(spark, db, MATERIALS)
    orders = load_table(spark, db, ORDERS)
    customer_keys = stored(reports.master_keys(customers, "customer_id"))
    products = stored(reports.master_keys(materials, "product_id", keep=["category"]))
    repeats = reports.repeated_keys([(CUSTOMERS, customer_keys), (MATERIALS, products)])
    found = {r.table_name: r.duplicate_count for r in repeats.collect() if r.duplicate_count}  # one row a table
    if found:
        write_report(repeats, f"{out_dir}/duplicate_keys", ["table_name"])
        raise ValueError(f"master keys repeat, no report is published: {found}")
    save_table(reports.orders_summary(orders), db, ORDERS_SUMMARY)
    summary, rows = load_table(spark, db, ORDERS_SUMMARY), "row_count"
    per_customer = stored(reports.customers_summary(customers))
    per_material = stored(reports.materials_summary(materials))

    results = {
        "duplicate_keys": repeats,
        "customer_quality_summary": reports.customer_quality_summary(per_customer, weight=rows),
        "material_quality_by_category": reports.material_quality_by_category(per_material, weight=rows),
        "material_clean_rate": reports.material_clean_rate(per_material, weight=rows),
        "orders_date_quality": reports.date_quality(summary, rows),
        "orders_payment_distribution": reports.payment_distribution(summary, rows),
        "orders_status_distribution": reports.status_distribution(summary, rows),
        "orders_missing_amounts": reports.missing_rate(summary, "order_amount_missing", weight=rows),
        "referential_integrity": reports.order_integrity(orders, customer_keys, products),
        "revenue_by_category": reports.revenue_by_category(orders, products, require_unique=False),
        "payment_status_crosstab": reports.payment_status_crosstab(summary, rows),
        "reconciliation_summary": reports.reconciliation_summary(
            per_customer, per_material, summary, weight=rows, master_weight=rows
        ),
    }
    frequent = F.desc("order_count")
    order = {
        "duplicate_keys": ["table_name"],
        "material_quality_by_category": [F.desc("product_count"), "category"],
        "orders_date_quality": [frequent, "order_date_flag"],
        "orders_payment_distribution": [frequent, "payment_method_clean"],
        "orders_status_distribution": [frequent, "status_clean"],
        "referential_integrity": ["check_name"],
        "revenue_by_category": [F.desc("total_revenue"), "category"],
        "payment_status_crosstab": ["payment_method_clean", "status_clean"],
        "reconciliation_summary": ["table_name", "issue_type"],
    }
    return publish_reports(spark, out_dir, results, order)
