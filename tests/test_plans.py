"""What the physical plans must and must not contain."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from burnish import operators as op
from burnish import plans
from burnish.operators.skew import join_without_hot_tasks
from burnish.sources import load_table, save_table
from checks.dirty import raw_orders
from checks.queries import QUERIES, customers, materials, orders
from tests.conftest import TESTDATA

SF = str(TESTDATA / "sf0.001")
WRITING = {"load_metrics", "quality_reports", "report_roundtrip", "roundtrip_raw_csv", "roundtrip_table"}


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


def executed_scans(df, columns="[^]]*"):
    """Scans of the plans that were run: only those have a compiled step right above."""
    df.collect()
    return len(re.findall(r"\*\(\d+\) ColumnarToRow\n.*FileScan parquet \[" + columns + r"\]", planned(df)))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - WRITING))
def test_native_expressions_and_equi_joins_only(spark, name):
    plan = planned(QUERIES[name](spark, SF))
    for unwanted in ("EvalPython", "InPandas", "InArrow", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert unwanted not in plan


@pytest.mark.parametrize(
    "name, columns",
    [
        ("date_quality", "o_orderkey:bigint,o_orderdate:timestamp_ntz"),
        ("payment_distribution", "o_orderkey:bigint"),
        ("missing_amount_rate", "o_orderkey:bigint,o_totalprice:double"),
        ("integrity_lineitem", "l_orderkey:bigint,l_partkey:bigint,l_suppkey:bigint"),
    ],
)
def test_only_needed_columns_are_read(spark, name, columns):
    assert f"ReadSchema: struct<{columns}>" in planned(QUERIES[name](spark, SF))


def test_share_of_total_reads_the_table_once(spark):
    assert executed_scans(QUERIES["date_quality"](spark, SF)) == 1


def scanned(spark, monkeypatch, work):
    """How often the files of each saved table are scanned while `work` runs, by a listener in the JVM-side metrics of
    the plans that write: every plan that is executed is noted when it is written or collected."""
    from pyspark.sql import DataFrame, DataFrameWriter

    plans_run = []

    def noted(real, frame_of):
        def call(self, *a, **b):
            plans_run.append(frame_of(self)._jdf.queryExecution().optimizedPlan().toString())
            return real(self, *a, **b)

        return call

    monkeypatch.setattr(DataFrameWriter, "parquet", noted(DataFrameWriter.parquet, lambda w: w._df))
    monkeypatch.setattr(DataFrameWriter, "csv", noted(DataFrameWriter.csv, lambda w: w._df))
    for name in ("collect", "first"):
        monkeypatch.setattr(type(spark.range(1)), name, noted(getattr(type(spark.range(1)), name), lambda d: d))
    work()
    return Counter(table for plan in plans_run for table in re.findall(r"Relation spark_catalog\.\w+\.(\w+)\[", plan))


def test_reports_read_masters_twice_and_orders_three_times(spark, monkeypatch, tmp_path):
    db = f"scans_{abs(hash(tmp_path))}"
    save_table(customers(spark, SF), db, "customer_master")
    save_table(materials(spark, SF), db, "material_master")
    save_table(orders(spark, SF), db, "orders_fact")
    reads = scanned(spark, monkeypatch, lambda: plans.quality_reports(spark, db, str(tmp_path / "reports")))
    assert {t: reads[t] for t in ("customer_master", "material_master", "orders_fact")} == {
        "customer_master": 2, "material_master": 2, "orders_fact": 3}


def test_loads_count_without_another_scan(spark, monkeypatch, tmp_path):
    db = f"loads_{abs(hash(tmp_path))}"
    orders_csv = raw_orders(spark, SF)
    orders_csv.write.option("header", True).csv(str(tmp_path / "orders"))
    from pyspark.sql import DataFrameWriter

    written, real = [], DataFrameWriter.parquet

    def noted(self, path, *a, **b):
        written.append((path, self._df._jdf.queryExecution().executedPlan().toString()))
        return real(self, path, *a, **b)

    monkeypatch.setattr(DataFrameWriter, "parquet", noted)
    plans.load_orders(spark, str(tmp_path / "orders"), db, orders_csv.columns)
    reads = [len(re.findall("FileScan csv", plan)) for _, plan in written]
    assert sum(reads) == 1 and len(written) == 2  # the table, and its few counts
    assert "CollectMetrics" in written[0][1] and "Exchange" not in written[0][1]


@pytest.mark.parametrize("name", ["integrity_lineitem", "integrity_report"])
def test_integrity_reads_the_fact_once(spark, name):
    plan = planned(QUERIES[name](spark, SF))
    fact = r"FileScan parquet \[l_orderkey" if name == "integrity_lineitem" else r"FileScan parquet \[o_"
    assert len(re.findall(fact, plan)) == 1
    assert plan.count("LeftAnti") == 1


@pytest.mark.parametrize("top", [5, 5000])
def test_no_task_ranks_a_whole_column(spark, top):
    plan = planned(op.top_values(orders(spark, SF), ["order_id", "status"], top))
    # The one window adds up the sizes of partitions, which an aggregate per partition makes.
    windows = re.findall(r"Window \[[^]]*\], \[column_name#\d+\], \[([^]]*)\]", plan)
    assert len(windows) == 1 and windows[0].startswith("__part")
    assert "row_number" not in plan


def test_profile_reads_the_table_once(spark):
    assert executed_scans(op.profile_columns(orders(spark, SF), ["order_id", "status"])) == 1


def test_revenue_pushes_its_filter_to_the_scan(spark):
    db = "pushdown"
    save_table(orders(spark, SF), db, "orders_fact")
    save_table(materials(spark, SF), db, "material_master")
    plan = planned(plans.revenue_by_category(load_table(spark, db, "orders_fact"), load_table(spark, db, "material_master")))
    assert "ReadSchema: struct<order_id:string,product_id:string,order_amount_clean:double>" in plan
    assert re.search(r"PushedFilters: \[[^]]*IsNotNull\(order_amount_clean\)", plan)
    assert "BroadcastHashJoin" in plan


def test_large_dimension_is_joined_after_adding_up(spark, conf):
    conf("spark.sql.autoBroadcastJoinThreshold", "-1")
    plan = planned(plans.revenue_by_category(orders(spark, SF), materials(spark, SF)))
    join = plan.index("SortMergeJoin")
    assert "partial_count(order_id" in plan[join:]
    integrity = planned(QUERIES["integrity_lineitem"](spark, SF))
    assert "partial_count(1)" in integrity[integrity.index("SortMergeJoin"):]


def test_hot_keys_are_searched_once(spark, conf):
    conf("spark.sql.autoBroadcastJoinThreshold", "-1")
    fact = spark.read.parquet(f"{SF}/lineitem.parquet").select("l_partkey", "l_quantity")
    dim = spark.read.parquet(f"{SF}/part.parquet").select("p_partkey", "p_name")
    joined = join_without_hot_tasks(fact, dim, "l_partkey", "p_partkey", "inner", share=0.001, min_rows=1)
    assert executed_scans(joined, r"l_partkey#\d+L") == 1


def test_cleaning_moves_no_rows(spark):
    for df in (orders(spark, SF), materials(spark, SF)):
        assert "Exchange" not in planned(df)


def test_duplicates_are_cut_before_the_shuffle(spark):
    plan = planned(QUERIES["dedup_lineitem"](spark, SF))
    assert "WindowGroupLimit" in plan[plan.index("Exchange"):]
    copies = planned(QUERIES["dedup_lineitem_copies"](spark, SF))
    assert "partial_min" in copies[copies.index("Exchange"):]


def test_labels_are_counted_before_the_shuffle(spark):
    plan = planned(plans.orders_summary(orders(spark, SF)))
    assert "partial_count(1)" in plan[plan.index("Exchange"):]
    assert op.profile_columns(orders(spark, SF), ["status"]).select(F.sum("row_count")).first()[0] == 1500
