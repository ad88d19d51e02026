"""Quality, distribution, revenue and reconciliation reports over the clean tables.

Each report reads its table once, in one aggregation. The order reports also work on `orders_summary`,
a table of at most a few hundred rows that counts the orders by their labels: pass its count column as
`weight`, and a whole set of reports costs one scan of the orders.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from burnish.functions.measures import amount_parts, mean_of, merged_parts, percent, total_of
from burnish.functions.text import named
from burnish.operators.dedup import duplicate_count
from burnish.operators.integrity import Reference, enrich, integrity_report
from burnish.operators.standardize import label_missing
from burnish.rules import FLAG_MISSING, FLAG_OK, FLAG_SENTINEL, UNMAPPED_LABEL

ORDER_LABELS = ("order_date_flag", "payment_method_clean", "status_clean", "order_amount_missing")


def _rows(weight: str | None) -> Column:
    return F.coalesce(F.sum(named(weight)), F.lit(0)) if weight else F.count("*")


def _rows_if(condition: Column, weight: str | None) -> Column:
    if weight is None:
        return F.count_if(condition)
    return F.coalesce(F.sum(F.when(condition, named(weight))), F.lit(0))


# Row counts


def row_reconciliation(tables: Sequence[tuple[str, DataFrame, DataFrame]]) -> DataFrame:
    """Per `(name, raw, clean)`: `raw_count`, `clean_count` and `removed_count`."""
    counted = [
        raw.agg(F.count("*").alias("raw_count"))
        .select(F.lit(name).alias("table_name"), "raw_count", clean.agg(F.count("*")).scalar().alias("clean_count"))
        for name, raw, clean in tables
    ]
    both = reduce(DataFrame.unionByName, counted)
    return both.withColumn("removed_count", F.col("raw_count") - F.col("clean_count")).orderBy("table_name")


def duplicate_keys(tables: Sequence[tuple[str, DataFrame, str]]) -> DataFrame:
    """Per `(name, table, key)`: `row_count`, `key_count` and `duplicate_count`, null keys left aside."""
    each = [
        duplicate_count(df.select(named(key)).where(named(key).isNotNull()), [key]).select(F.lit(name).alias("table_name"), "*")
        for name, df, key in tables
    ]
    return reduce(DataFrame.unionByName, each).orderBy("table_name")


def missing_rate(df: DataFrame, flag: str, prefix: str = "missing", weight: str | None = None) -> DataFrame:
    """One row: `total_rows`, `<prefix>_count` and `<prefix>_pct` of a boolean flag."""
    missing = _rows_if(named(flag), weight)
    return df.agg(
        _rows(weight).alias("total_rows"),
        missing.alias(f"{prefix}_count"),
        percent(missing, _rows(weight)).alias(f"{prefix}_pct"),
    )


def unmapped_counts(df: DataFrame, cols: Sequence[str], weight: str | None = None) -> DataFrame:
    """Per column: `column_name` and `unmapped_count`, the rows where normalising found no value."""
    counts = df.agg(*[_rows_if(named(c).isNull(), weight).alias(c) for c in cols])
    return _as_rows(counts, cols, "column_name", "unmapped_count").orderBy("column_name")


def parse_success(
    df: DataFrame,
    raw: str = "order_date",
    clean: str = "order_date_clean",
    flag: str = "order_date_flag",
) -> DataFrame:
    """One row: rows, rows with raw text, parsed dates and their share, and `ok` rows that failed."""
    parsed = F.count(named(clean))
    return df.agg(
        F.count("*").alias("total_rows"),
        F.count(named(raw)).alias("raw_count"),
        parsed.alias("parsed_count"),
        percent(parsed, F.count("*")).alias("parsed_pct"),
        F.count_if((named(flag) != FLAG_MISSING) & (named(flag) != FLAG_SENTINEL) & named(clean).isNull())
        .alias("unparsed_count"),
    )


def _as_rows(one_row: DataFrame, cols: Sequence[str], name: str, value: str) -> DataFrame:
    """The columns of a one-row result as `(name, value)` rows, so that one scan feeds many rows."""
    pairs = [c for col in cols for c in (F.lit(col), named(col))]
    return one_row.select(F.stack(F.lit(len(cols)), *pairs).alias(name, value))


# Customers and materials


def customers_summary(customers: DataFrame, copies: str = "source_rows") -> DataFrame:
    """Customers per missing email and number of devices, as `row_count`, and the raw rows behind them.

    A table of a few dozen rows that the customer reports are made of.
    """
    return customers.groupBy("email_missing", "device_count").agg(
        F.count("*").alias("row_count"), F.sum(named(copies)).alias(copies)
    )


def customer_quality_summary(customers: DataFrame, weight: str | None = None) -> DataFrame:
    """Customers, missing emails, customers with several devices, devices per customer."""
    missing = _rows_if(F.col("email_missing"), weight)
    known = _rows_if(F.col("device_count").isNotNull(), weight)
    held = F.sum(F.col("device_count").cast("decimal(20,0)") * (named(weight) if weight else F.lit(1)).cast("decimal(18,0)"))
    return customers.agg(
        _rows(weight).alias("total_customers"),
        missing.alias("missing_email_count"),
        percent(missing, _rows(weight)).alias("missing_email_pct"),
        _rows_if(F.col("device_count") > 1, weight).alias("multi_device_customers"),
        F.round(F.try_divide(held, known.cast("decimal(20,0)")), 2).cast("double").alias("avg_devices_per_customer"),
    )


def materials_summary(materials: DataFrame) -> DataFrame:
    """Products per category and defect, as `row_count`, with the parts of their prices as `price_parts`.

    Parts of groups can be merged, so every material report is made of this table, which has a row per category and
    combination of defects.
    """
    return _prices(materials, "category", "category_missing", "price_invalid")


def _prices(materials: DataFrame, *by: str) -> DataFrame:
    parts = amount_parts(F.col("price_clean")).alias("price_parts")
    return materials.groupBy(*by).agg(F.count("*").alias("row_count"), parts)


def material_quality_by_category(
    materials: DataFrame, label: str = UNMAPPED_LABEL, weight: str | None = None
) -> DataFrame:
    """Per category: products, invalid prices, mean valid price and mean of all prices.

    `avg_price` includes parsed prices that are flagged invalid, such as negative filler values. With `weight`,
    `materials` is the `materials_summary`.
    """
    summary = materials if weight else _prices(materials, "category", "price_invalid")
    rows, parts = weight or "row_count", F.col("price_parts")
    valid = F.when(~F.col("price_invalid"), parts)
    return (
        label_missing(summary, "category", label)
        .groupBy("category")
        .agg(
            F.sum(rows).alias("product_count"),
            _rows_if(F.col("price_invalid"), rows).alias("invalid_price_count"),
            mean_of(merged_parts(valid)).alias("avg_valid_price"),
            mean_of(merged_parts(parts)).alias("avg_price"),
        )
        .orderBy(F.desc("product_count"), "category")
    )


def material_clean_rate(materials: DataFrame, weight: str | None = None) -> DataFrame:
    """Products, unmapped categories, invalid prices and the share of products with neither."""
    defects = _rows_if(F.col("category_missing") | F.col("price_invalid"), weight)
    return materials.agg(
        _rows(weight).alias("total_products"),
        _rows_if(F.col("category_missing"), weight).alias("category_unmapped_count"),
        _rows_if(F.col("price_invalid"), weight).alias("price_invalid_count"),
        percent(_rows(weight) - defects, _rows(weight)).alias("clean_record_pct"),
    )


def master_keys(df: DataFrame, key: str, copies: str = "copies", keep: Sequence[str] = ()) -> DataFrame:
    """One row per non-null key: how many rows have it, and any one value of the columns `keep`.

    What checks of keys and joins to them need of a master table; read once.
    """
    values = [F.any_value(named(c)).alias(c) for c in keep]
    return df.where(named(key).isNotNull()).groupBy(named(key)).agg(F.count("*").alias(copies), *values)


def repeated_keys(tables: Sequence[tuple[str, DataFrame]], copies: str = "copies") -> DataFrame:
    """Per `(name, master_keys)`: `row_count`, `key_count` and `duplicate_count`."""
    rows = F.coalesce(F.sum(named(copies)), F.lit(0))
    each = [
        keys.agg(rows.alias("row_count"), F.count("*").alias("key_count"), (rows - F.count("*")).alias("duplicate_count"))
        .select(F.lit(name).alias("table_name"), "*")
        for name, keys in tables
    ]
    return reduce(DataFrame.unionByName, each).orderBy("table_name")


# Orders


def orders_summary(orders: DataFrame, labels: Sequence[str] = ORDER_LABELS) -> DataFrame:
    """Orders per combination of their labels, as `row_count`: what the order reports are made of.

    Labels come from closed sets, so the result stays small however many orders there are.
    """
    return orders.groupBy(*map(named, labels)).agg(F.count("*").alias("row_count"))


def value_distribution(df: DataFrame, cols: Sequence[str], weight: str | None = None) -> DataFrame:
    """`order_count` per value, nulls as a group of their own, most frequent first."""
    return (
        df.groupBy(*map(named, cols))
        .agg(_rows(weight).alias("order_count"))
        .orderBy(F.desc("order_count"), *map(named, cols))
    )


def share_of_total(df: DataFrame, col: str, weight: str | None = None) -> DataFrame:
    """`order_count` per value and its percentage of all rows, most frequent first.

    The total is a scalar subquery over the counts and not a window, which would put every group into
    one task.
    """
    counts = df.groupBy(named(col)).agg(_rows(weight).alias("order_count"))
    total = counts.agg(F.sum("order_count").alias("total")).scalar()
    return counts.withColumn("pct_of_total", percent(F.col("order_count"), total)).orderBy(
        F.desc("order_count"), named(col)
    )


def date_quality(orders: DataFrame, weight: str | None = None) -> DataFrame:
    return share_of_total(orders, "order_date_flag", weight)


def payment_distribution(orders: DataFrame, weight: str | None = None) -> DataFrame:
    return value_distribution(orders, ["payment_method_clean"], weight)


def status_distribution(orders: DataFrame, weight: str | None = None) -> DataFrame:
    return value_distribution(orders, ["status_clean"], weight)


def payment_status_crosstab(orders: DataFrame, weight: str | None = None) -> DataFrame:
    """`order_count` per payment method and status, ordered by both."""
    both = ["payment_method_clean", "status_clean"]
    return value_distribution(orders, both, weight).orderBy(*both)


def revenue_by_category(
    orders: DataFrame,
    materials: DataFrame,
    key: str = "product_id",
    label: str | None = None,
    statuses: Sequence[str] | None = None,
    require_unique: bool = True,
) -> DataFrame:
    """Per material category: orders with an amount, revenue and mean order value, by revenue.

    All statuses count unless `statuses` names some; a null category stays null unless `label` is given.

    The orders are added up per product before the join. What is shuffled is one row per product and
    task, so a product with a third of all orders is no heavier than any other.
    """
    paid = orders.where(F.col("order_amount_clean").isNotNull())
    if statuses is not None:
        paid = paid.where(F.col("status_clean").isin(list(statuses)))
    products = materials.select(named(key), "category")
    measures = (F.count("order_id").alias("order_count"), amount_parts(F.col("order_amount_clean")).alias("parts"))

    per_product = paid.groupBy(named(key)).agg(*measures)
    per_category = (
        enrich(per_product, products, key, require_unique=require_unique)
        .groupBy("category")
        .agg(F.sum("order_count").alias("order_count"), merged_parts(F.col("parts")).alias("parts"))
    )
    named_categories = label_missing(per_category, "category", label) if label else per_category
    return named_categories.select(
        "category",
        "order_count",
        total_of(F.col("parts")).alias("total_revenue"),
        mean_of(F.col("parts")).alias("avg_order_value"),
    ).orderBy(F.desc("total_revenue"), "category")


# Reconciliation


def order_references(customers: DataFrame, materials: DataFrame) -> list[Reference]:
    return [
        Reference(customers, "customer_id", "customer_id", "orphaned_customer_refs"),
        Reference(materials, "product_id", "product_id", "orphaned_product_refs"),
    ]


def order_integrity(orders: DataFrame, customers: DataFrame, materials: DataFrame) -> DataFrame:
    """Orders that point to no customer and orders that point to no material."""
    return integrity_report(orders, order_references(customers, materials))


def reconciliation_summary(
    customers: DataFrame,
    materials: DataFrame,
    orders: DataFrame,
    copies: str = "source_rows",
    weight: str | None = None,
    master_weight: str | None = None,
) -> DataFrame:
    """`(table_name, issue_type, record_count)` for the issues of all three tables, one scan each.

    Removed duplicates follow from `copies`, the number of raw rows behind each customer. `orders` may be the
    `orders_summary` with `weight` as its count column, and the masters their summaries with `master_weight`.
    """
    per_table: Mapping[str, tuple[DataFrame, Mapping[str, Column]]] = {
        "customer_master": (
            customers,
            {
                "duplicate_ids_removed": F.coalesce(F.sum(named(copies)), F.lit(0)) - _rows(master_weight),
                "missing_email": _rows_if(F.col("email_missing"), master_weight),
            },
        ),
        "material_master": (
            materials,
            {
                "category_unmapped": _rows_if(F.col("category_missing"), master_weight),
                "invalid_price": _rows_if(F.col("price_invalid"), master_weight),
            },
        ),
        "orders_fact": (
            orders,
            {
                "sentinel_placeholder_date": _rows_if(F.col("order_date_flag") == FLAG_SENTINEL, weight),
                "missing_date": _rows_if(F.col("order_date_flag") == FLAG_MISSING, weight),
                "missing_order_amount": _rows_if(F.col("order_amount_missing"), weight),
            },
        ),
    }
    parts = []
    for table, (df, issues) in per_table.items():
        counts = df.agg(*[measure.alias(issue) for issue, measure in issues.items()])
        rows = _as_rows(counts, list(issues), "issue_type", "record_count")
        parts.append(rows.select(F.lit(table).alias("table_name"), "issue_type", "record_count"))
    return reduce(DataFrame.unionByName, parts).orderBy("table_name", "issue_type")


# What the load jobs counted while they wrote


def _pivoted(metrics: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """One row per table that has all of `names`: metric to column."""
    columns = [F.max(F.when(F.col("metric") == m, F.col("value"))).alias(c) for m, c in names.items()]
    return metrics.groupBy("table_name").agg(*columns).where(F.col(next(iter(names.values()))).isNotNull()).orderBy("table_name")


def loaded_rows(metrics: DataFrame) -> DataFrame:
    """`row_reconciliation` from `load_metrics`: no table is read again."""
    counts = _pivoted(metrics, {"raw_rows": "raw_count", "clean_rows": "clean_count"})
    return counts.withColumn("removed_count", F.col("raw_count") - F.col("clean_count"))


def loaded_unmapped(metrics: DataFrame) -> DataFrame:
    """`unmapped_counts` of all loaded tables: `table_name`, `column_name`, `unmapped_count`."""
    name = F.regexp_extract("metric", "^unmapped:(.*)$", 1)
    rows = metrics.where(F.col("metric").startswith("unmapped:"))
    return rows.select("table_name", name.alias("column_name"), F.col("value").alias("unmapped_count")).orderBy(
        "table_name", "column_name"
    )


def loaded_dates(metrics: DataFrame) -> DataFrame:
    """`parse_success` from `load_metrics`."""
    names = {"raw_rows": "total_rows", "dates": "raw_count", "parsed_dates": "parsed_count", "unparsed_dates": "unparsed_count"}
    found = _pivoted(metrics, names).where(F.col("raw_count").isNotNull())
    parsed = percent(F.col("parsed_count"), F.col("total_rows")).alias("parsed_pct")
    return found.select("total_rows", "raw_count", "parsed_count", parsed, "unparsed_count")


def loaded_orphans(metrics: DataFrame) -> DataFrame:
    """`order_integrity` as it was when the orders were loaded: `check_name`, `violation_count`."""
    name = F.regexp_extract("metric", "^orphans:(.*)$", 1)
    rows = metrics.where(F.col("metric").startswith("orphans:"))
    return rows.select(name.alias("check_name"), F.col("value").alias("violation_count")).orderBy("check_name")
