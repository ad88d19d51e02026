from functools import partial

import pytest

import __spark_entry__ as entry_points
from burnish.operators import skew
from checks import oracle, queries
from tests.compare import duckdb_bag, duckdb_over, duckdb_types, spark_bag, spark_types
from tests.conftest import TESTDATA

# The training-data operators have tests of their own.
QUERIES = queries.QUERIES
ORACLE = oracle.ORACLE


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert QUERIES.items() <= entry_points.queries().items()
    assert ORACLE.items() <= entry_points.oracle_sql().items()


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows_as_duckdb(spark, name, sf):
    sf_dir = str(TESTDATA / sf)
    con = duckdb_over(sf_dir)
    result = QUERIES[name](spark, sf_dir)
    assert spark_types(result) == duckdb_types(con, ORACLE[name])
    columns, rows = spark_bag(result)
    expected_columns, expected = duckdb_bag(con, ORACLE[name])
    assert columns == expected_columns
    assert sum(rows.values()) == sum(expected.values()) > 0
    assert rows == expected


def test_entry(spark):
    result = entry_points.entry(spark)
    assert result.columns == ["category", "order_count", "total_revenue", "avg_order_value"]
    assert result.count() == 9


# Queries that join: the same results when no side may be broadcast and every key counts as hot.
JOINS = [
    "categories_from_table", "enriched_orders", "integrity_lineitem", "integrity_report", "orphan_orders",
    "revenue_by_category", "revenue_by_category_success",
]


@pytest.mark.parametrize("name", JOINS)
def test_same_rows_without_broadcast(spark, conf, monkeypatch, name):
    conf("spark.sql.autoBroadcastJoinThreshold", "-1")
    every_key_hot = partial(skew.join_without_hot_tasks, share=0.001, min_rows=1)
    monkeypatch.setattr("burnish.operators.integrity.join_without_hot_tasks", every_key_hot)
    monkeypatch.setattr("burnish.operators.vocabulary.join_without_hot_tasks", every_key_hot)
    sf_dir = str(TESTDATA / "sf0.001")
    assert spark_bag(QUERIES[name](spark, sf_dir)) == duckdb_bag(duckdb_over(sf_dir), ORACLE[name])


SESSION_DEPENDENT = ["amounts_materials", "dates", "devices", "job_customers", "material_clean_rate", "revenue_by_category"]


@pytest.mark.parametrize("name", SESSION_DEPENDENT)
def test_same_rows_in_a_lenient_session_elsewhere(spark, conf, name):
    conf("spark.sql.ansi.enabled", "false")
    conf("spark.sql.session.timeZone", "America/Sao_Paulo")
    sf_dir = str(TESTDATA / "sf0.001")
    assert spark_bag(QUERIES[name](spark, sf_dir)) == duckdb_bag(duckdb_over(sf_dir), ORACLE[name])
