import datetime

import pytest
from pyspark.sql import functions as F

from burnish import operators as op
from burnish import plans
from checks.queries import customers, materials, orders
from checks.dirty import raw_customers, raw_orders
from tests.conftest import TESTDATA

SF = str(TESTDATA / "sf0.001")


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture(scope="module")
def order_table(spark):
    return orders(spark, SF)


def test_reports_from_the_summary_equal_reports_from_the_orders(spark, order_table):
    summary = plans.orders_summary(order_table)
    assert summary.count() <= 4 * 5 * 4 * 2
    for report in (
        plans.date_quality,
        plans.payment_distribution,
        plans.status_distribution,
        plans.payment_status_crosstab,
        lambda df, w=None: plans.missing_rate(df, "order_amount_missing", weight=w),
        lambda df, w=None: plans.unmapped_counts(df, ["payment_method_clean", "status_clean"], w),
        lambda df, w=None: plans.reconciliation_summary(customers(spark, SF), materials(spark, SF), df, weight=w),
    ):
        assert rows(report(order_table)) == rows(report(summary, "row_count"))


def test_reports_from_the_master_summaries(spark, order_table):
    people, things = customers(spark, SF), materials(spark, SF)
    per_person, per_thing = plans.customers_summary(people), plans.materials_summary(things)
    assert per_person.count() < 20 and per_thing.count() < 40
    for report, whole, summary in (
        (plans.customer_quality_summary, people, per_person),
        (plans.material_quality_by_category, things, per_thing),
        (plans.material_clean_rate, things, per_thing),
    ):
        assert rows(report(whole)) == rows(report(summary, weight="row_count"))
        assert rows(report(whole.limit(0))) == rows(report(summary.limit(0), weight="row_count"))
    assert rows(plans.reconciliation_summary(people, things, order_table)) == rows(
        plans.reconciliation_summary(per_person, per_thing, order_table, master_weight="row_count"))


def test_master_keys(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2), (None, 3), (None, 3)], "k string, v int")
    keys = plans.master_keys(df, "k", keep=["v"])
    assert sorted(rows(keys)) == [("a", 2, 1), ("b", 1, 2)]
    assert rows(plans.repeated_keys([("x", keys), ("none", keys.limit(0))])) == [("none", 0, 0, 0), ("x", 3, 2, 1)]
    assert rows(plans.duplicate_keys([("x", df, "k")])) == [("x", 3, 2, 1)]


def test_counts_add_up(order_table):
    total = order_table.count()
    assert sum(r[1] for r in rows(plans.payment_distribution(order_table))) == total
    assert sum(r[2] for r in rows(plans.payment_status_crosstab(order_table))) == total
    shares = rows(plans.date_quality(order_table))
    assert sum(r[1] for r in shares) == total
    assert abs(sum(r[2] for r in shares) - 100) < 0.02


def test_clean_and_removed_make_raw(spark):
    raw, clean = raw_customers(spark, SF), customers(spark, SF)
    ((_, raw_count, clean_count, removed),) = rows(plans.row_reconciliation([("c", raw, clean)]))
    assert raw_count == clean_count + removed
    assert removed == op.duplicate_count(raw, ["customer_id"]).first().duplicate_count
    assert removed == clean.agg(F.sum("source_rows") - F.count("*")).first()[0] > 0


def test_results_do_not_depend_on_the_partitioning(spark, order_table):
    for parts in (1, 5, 13):
        assert rows(plans.revenue_by_category(order_table.repartition(parts), materials(spark, SF))) == rows(
            plans.revenue_by_category(order_table, materials(spark, SF))
        )
        raw = raw_customers(spark, SF)
        again = plans.clean_customers(raw.repartition(parts), ["seq"], "device_ids")
        assert sorted(rows(again), key=repr) == sorted(rows(customers(spark, SF)), key=repr)


def test_cleaning_twice_changes_nothing(spark):
    raw = raw_customers(spark, SF).select("first_name", "phone_number")
    once = op.normalize_phone(op.standardize_names(raw, ["first_name"]), "phone_number")
    once = once.withColumn("phone_number", F.col("phone_clean"))
    twice = op.normalize_phone(op.standardize_names(once, ["first_name"]), "phone_number")
    assert sorted(rows(once.select("first_name", "phone_clean")), key=repr) == sorted(
        rows(twice.select("first_name", "phone_clean")), key=repr
    )
    mat = materials(spark, SF).select("product_id", "category")
    from burnish.rules import CATEGORY_TERMS

    assert sorted(rows(op.canonicalize_terms(mat, "category", CATEGORY_TERMS)), key=repr) == sorted(rows(mat), key=repr)


def test_empty_tables_give_zeros(spark, order_table):
    none, c, m = order_table.limit(0), customers(spark, SF).limit(0), materials(spark, SF).limit(0)
    assert rows(plans.customer_quality_summary(c)) == [(0, 0, None, 0, None)]
    assert rows(plans.material_clean_rate(m)) == [(0, 0, 0, None)]
    assert rows(plans.missing_rate(none, "order_amount_missing")) == [(0, 0, None)]
    assert rows(plans.parse_success(none)) == [(0, 0, 0, None, 0)]
    assert {r[2] for r in rows(plans.reconciliation_summary(c, m, none))} == {0}
    assert {r[2] for r in rows(plans.reconciliation_summary(c, m, plans.orders_summary(none), weight="row_count"))} == {0}
    for empty in (plans.date_quality(none), plans.payment_distribution(none), plans.revenue_by_category(none, m)):
        assert rows(empty) == []


@pytest.mark.parametrize("threshold", ["10MB", "-1"])
def test_revenue_options(spark, conf, threshold):
    conf("spark.sql.autoBroadcastJoinThreshold", threshold)
    sales = spark.createDataFrame(
        [("1", "p1", 10.0, "success"), ("2", "p1", -4.0, "failed"), ("3", "p2", 1.005, "success"), ("4", "p3", 7.0, None),
         ("5", "gone", 9.0, "success"), ("6", "p1", None, "success"), (None, "p1", 1.0, "success")],
        "order_id string, product_id string, order_amount_clean double, status_clean string",
    )
    goods = spark.createDataFrame([("p1", "toys"), ("p2", None), ("p3", None)], "product_id string, category string")
    assert rows(plans.revenue_by_category(sales, goods)) == [(None, 2, 8.01, 4.0), ("toys", 2, 7.0, 2.33)]
    assert rows(plans.revenue_by_category(sales, goods, label="(unmapped)", statuses=["success"])) == [
        ("toys", 1, 11.0, 5.5), ("(unmapped)", 1, 1.01, 1.01),
    ]


def test_mean_price_leaves_invalid_prices_out(spark):
    df = spark.createDataFrame(
        [("toys", -100.0, True), ("toys", 10.0, False), ("toys", None, True), (None, 3.0, False)],
        "category string, price_clean double, price_invalid boolean",
    )
    assert rows(plans.material_quality_by_category(df)) == [
        ("toys", 3, 2, 10.0, -45.0), ("(unmapped)", 1, 0, 3.0, 3.0),
    ]


def test_parse_success_counts_unparsed_either_way(spark):
    df = spark.createDataFrame(
        [("a", None, "ok"), ("b", None, "unparsed"), ("c", datetime.date(2024, 1, 1), "ok"), (None, None, "missing"),
         ("31-12-2023", None, "sentinel_placeholder")],
        "order_date string, order_date_clean date, order_date_flag string",
    )
    assert rows(plans.parse_success(df)) == [(5, 4, 1, 20.0, 2)]


def test_profile(spark):
    raw = raw_orders(spark, SF)
    ((name, n, nulls, distinct),) = rows(op.profile_columns(raw, ["status"]))
    assert (name, n) == ("status", 1500)
    assert nulls == raw.where("status IS NULL").count()
    assert distinct == raw.select("status").where("status IS NOT NULL").distinct().count()
    (first, *others) = rows(op.profile_column(raw, "order_date", 3))
    assert first[4] == "31-12-2023" and [r[-1] for r in (first, *others)] == [1, 2, 3]
    nothing = spark.createDataFrame([(None,), (None,)], "c string")
    assert rows(op.profile_column(nothing, "c", 3)) == [("c", 2, 2, 0, None, None, None)]


def test_profile_by_value(spark, conf):
    conf("spark.sql.session.timeZone", "Europe/Berlin")
    df = spark.sql("""SELECT timestamp_seconds(col1) AS t, CAST(col2 AS DECIMAL(10,2)) AS d, unhex(col3) AS b, map('k', col1) AS m,
        CAST(col4 AS DOUBLE) AS f, array(col2) AS l, struct(col1) AS s
        FROM VALUES (1698539400, 1.10, 'FF', 'NaN'), (1698543000, 1.10, 'FE', 'NaN'), (1698543000, 2.00, '61', '0'), (NULL, NULL, NULL, '-0')""")
    cols = ["t", "d", "b", "m", "f", "l", "s"]
    # 2:30 comes twice on that day, and neither FF nor FE is a text.
    assert rows(op.profile_columns(df, cols)) == [
        ("b", 4, 1, 3), ("d", 4, 1, 2), ("f", 4, 0, 2), ("l", 4, 0, 3), ("m", 4, 0, 3), ("s", 4, 0, 3), ("t", 4, 1, 2)]
    assert rows(op.top_values(df, ["t", "b"], 9)) == [
        ("b", "FE", 1, 1), ("b", "FF", 1, 2), ("b", "a", 1, 3),
        ("t", "2023-10-29 02:30:00", 2, 1), ("t", "2023-10-29 02:30:00", 1, 2)]


@pytest.mark.parametrize("parts", [1, 7])
def test_ranks(spark, conf, parts):
    conf("spark.sql.shuffle.partitions", str(parts))
    data = [(k % 3 if k % 10 else None, k * 7919 % 1000, k) for k in range(1000)]
    df = spark.createDataFrame(data, "g int, x int, `a.b` int").repartition(5)
    got = {r["a.b"]: r["place"] for r in op.ranked(df, ["g"], [F.desc("x"), "a.b"], "place").collect()}
    expected = {}
    for g in (0, 1, 2, None):
        for place, row in enumerate(sorted((r for r in data if r[0] == g), key=lambda r: (-r[1], r[2])), 1):
            expected[row[2]] = place
    assert got == expected
    best = op.ranked(df, ["g"], [F.desc("x"), "a.b"], "place", top=4)
    assert best.columns == ["g", "x", "a.b", "place"]
    assert {r["a.b"]: r["place"] for r in best.collect()} == {k: p for k, p in expected.items() if p <= 4}
    assert op.ranked(df.where("false"), ["g"], ["x"]).collect() == []
    everything = op.ranked(df, [], ["a.b"])
    assert [r["rank"] for r in everything.orderBy("`a.b`").collect()] == list(range(1, 1001))
