"""Raw tables with realistic defects, derived from the clean test tables.

The text runs unchanged in Spark and in DuckDB. `{customer}`, `{part}` and `{orders}` stand for the
source tables. Every row of them is used and orders refer to all products (the tables hold 2 products
for every 15 orders), so the raw tables grow with the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

RAW_CUSTOMERS = """
SELECT 'CUST-' || CAST(c_custkey AS STRING) AS customer_id, seq,
  CASE c_custkey % 4 WHEN 0 THEN UPPER(c_mktsegment) WHEN 1 THEN LOWER(c_mktsegment)
    WHEN 2 THEN '  ' || c_mktsegment || ' ' ELSE 'mc ' || LOWER(c_mktsegment) END AS first_name,
  CASE WHEN c_custkey % 7 = 0 THEN UPPER(c_name) ELSE LOWER(c_name) END AS last_name,
  CASE WHEN (c_custkey + seq) % 48 = 0 THEN NULL ELSE LOWER(c_name) || '@example.com' END AS email,
  CASE c_custkey % 6 WHEN 0 THEN '+1-555-' || LPAD(CAST(c_custkey AS STRING), 7, '0')
    WHEN 1 THEN '(555) 01' || LPAD(CAST(c_custkey AS STRING), 6, '0') || 'x' || CAST(c_custkey % 900 AS STRING)
    WHEN 2 THEN '555.' || LPAD(CAST(c_custkey AS STRING), 7, '0')
    WHEN 3 THEN '001-' || LPAD(CAST(c_custkey AS STRING), 10, '7')
    WHEN 4 THEN CAST(c_custkey AS STRING) ELSE NULL END AS phone_number,
  CASE c_custkey % 5 WHEN 0 THEN 'd1' WHEN 1 THEN 'd1;d2' WHEN 2 THEN 'd1;d2;d3' WHEN 3 THEN 'd9;'
    ELSE NULL END AS device_ids
FROM (SELECT *, 0 AS seq FROM {customer}
      UNION ALL SELECT *, 1 AS seq FROM {customer} WHERE c_custkey % 27 = 0) t
"""

RAW_MATERIALS = """
SELECT 'PROD-' || CAST(p_partkey AS STRING) AS product_id, p_name AS product_name,
  CASE p_partkey % 16 WHEN 0 THEN 'clothing' WHEN 1 THEN '3l3ctronics' WHEN 2 THEN 'HOME' WHEN 3 THEN 'hom'
    WHEN 4 THEN 'kitch3n' WHEN 5 THEN 'beauty_' WHEN 6 THEN ' toys-' WHEN 7 THEN 'SPORTS '
    WHEN 8 THEN 'automotiv3' WHEN 9 THEN 'clo' WHEN 10 THEN 'ki' WHEN 11 THEN 'gadgets' WHEN 12 THEN ''
    WHEN 13 THEN NULL WHEN 14 THEN '8eauty' ELSE 'electronics' END AS category,
  CASE p_partkey % 17 WHEN 0 THEN '1,200' WHEN 1 THEN '-100' WHEN 2 THEN 'NaN' WHEN 3 THEN '  '
    WHEN 4 THEN NULL WHEN 5 THEN 'N/A' WHEN 6 THEN 'abc' WHEN 7 THEN '0'
    WHEN 8 THEN ' ' || CAST(900 + p_partkey AS STRING) || '.5 '
    WHEN 9 THEN '12d' WHEN 10 THEN 'Infinity'
    ELSE CAST(900 + p_partkey AS STRING) || '.' || LPAD(CAST(p_partkey % 100 AS STRING), 2, '0') END AS price
FROM {part}
"""

RAW_ORDERS = """
SELECT CAST(o_orderkey AS STRING) AS order_id,
  CASE WHEN o_orderkey % 41 = 0 THEN 'CUST-GONE' WHEN o_orderkey % 43 = 0 THEN NULL
    ELSE 'CUST-' || CAST(o_custkey AS STRING) END AS customer_id,
  CASE WHEN o_orderkey % 53 = 0 THEN 'PROD-GONE'
    ELSE 'PROD-' || CAST(CAST(FLOOR(o_orderkey * 2 / 15.0) AS BIGINT) AS STRING) END AS product_id,
  CASE o_orderkey % 12 WHEN 0 THEN 'Card' WHEN 1 THEN 'crd' WHEN 2 THEN 'crad ' WHEN 3 THEN 'C.D.'
    WHEN 4 THEN 'wallet' WHEN 5 THEN 'e-WALL' WHEN 6 THEN 'UPI' WHEN 7 THEN ' upi' WHEN 8 THEN 'cash'
    WHEN 9 THEN 'CASH!' WHEN 10 THEN 'bitcoin' ELSE NULL END AS payment_method,
  CASE o_orderkey % 9 WHEN 0 THEN 'success' WHEN 1 THEN 'SUC ' WHEN 2 THEN 'Refunded' WHEN 3 THEN 'ref'
    WHEN 4 THEN 'FAILED' WHEN 5 THEN 'fail' WHEN 6 THEN 'pending' WHEN 7 THEN '' ELSE NULL END AS status,
  CASE o_orderkey % 10 WHEN 0 THEN NULL WHEN 1 THEN '31-12-2023'
    WHEN 2 THEN SUBSTR(d,1,4) || '/' || SUBSTR(d,9,2) || '/' || SUBSTR(d,6,2)
    WHEN 3 THEN SUBSTR(d,1,4) || '/' || SUBSTR(d,6,2) || '/' || SUBSTR(d,9,2) || ' 10:30'
    WHEN 4 THEN d || 'T23:59:59.999999' WHEN 5 THEN SUBSTR(d,1,4) || '-02-30' WHEN 6 THEN 'unknown'
    WHEN 7 THEN ' ' || d WHEN 8 THEN d || ' 10:11:12' ELSE d END AS order_date,
  CASE o_orderkey % 13 WHEN 0 THEN 'NaN' WHEN 1 THEN '1,200' WHEN 2 THEN NULL WHEN 3 THEN ''
    WHEN 4 THEN 'none' WHEN 5 THEN '-' || SUBSTR(a,1,LENGTH(a)-2) || '.' || SUBSTR(a,LENGTH(a)-1,2)
    ELSE SUBSTR(a,1,LENGTH(a)-2) || '.' || SUBSTR(a,LENGTH(a)-1,2) END AS order_amount
FROM (SELECT *, CAST(CAST(o_orderdate AS DATE) AS STRING) AS d,
             CAST(CAST(ROUND(o_totalprice * 100) AS BIGINT) AS STRING) AS a FROM {orders}) t
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _view(spark: SparkSession, sf_dir: str, text: str, *names: str) -> DataFrame:
    return spark.sql(text, **{name: table(spark, sf_dir, name) for name in names})


def raw_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, RAW_CUSTOMERS, "customer")


def raw_materials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, RAW_MATERIALS, "part")


def raw_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, RAW_ORDERS, "orders")


def in_duckdb(text: str) -> str:
    return text.format(customer="customer", part="part", orders="orders").strip()
