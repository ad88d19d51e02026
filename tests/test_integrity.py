import datetime

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from burnish import operators as op
from burnish.operators import Reference
from burnish.operators.skew import fits_broadcast, hot_keys, join_without_hot_tasks


def bag(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(params=["10MB", "-1"], ids=["broadcast", "shuffle"])
def join_mode(request, conf):
    conf("spark.sql.autoBroadcastJoinThreshold", request.param)


def test_null_key_is_an_orphan(spark, join_mode):
    fact = spark.createDataFrame([(1, "a"), (None, "b"), (3, "c")], "fk int, v string")
    dim = spark.createDataFrame([(1,), (1,), (2,), (None,)], "pk int")
    assert bag(op.orphans(fact, dim, "fk", "pk")) == [(3, "c"), (None, "b")]


def test_report_has_a_row_for_every_check(spark, join_mode):
    fact = spark.createDataFrame([("1", 7), (None, 8), ("1", None)], "c string, p int")
    customers = spark.createDataFrame([("1",)], "c string")
    products = spark.createDataFrame([(7,), (8,)], "p int")
    checks = [Reference(customers, "c", "c", "customers"), Reference(products, "p", "p", "products")]
    assert bag(op.integrity_report(fact, checks)) == [("customers", 1), ("products", 1)]
    assert bag(op.integrity_report(fact.limit(0), checks)) == [("customers", 0), ("products", 0)]
    nothing = [Reference(customers.limit(0), "c", "c", "customers")]
    assert bag(op.integrity_report(fact, nothing)) == [("customers", 3)]


def test_enrich_drops_orphans(spark, join_mode):
    fact = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c"), (9, "d")], "id int, v string")
    dim = spark.createDataFrame([(1, "x"), (2, "y"), (None, "z")], "key int, w string")
    found = op.enrich(fact, dim, "id", "key")
    assert found.columns == ["id", "v", "w"]
    assert bag(found) == [(1, "a", "x"), (1, "b", "x")]


def test_enrich_refuses_a_repeated_key(spark, join_mode):
    fact = spark.createDataFrame([(1, "a")], "id int, v string")
    dim = spark.createDataFrame([(1, "x"), (1, "y")], "id int, w string")
    with pytest.raises(PySparkException, match="id is not unique: 1"):
        op.enrich(fact, dim, "id").collect()
    assert bag(op.enrich(fact, dim, "id", require_unique=False)) == [(1, "a", "x"), (1, "a", "y")]


def test_only_used_keys_must_be_unique(spark, join_mode):
    fact = spark.createDataFrame([(1, "a"), (None, "b")], "id int, v string")
    dim = spark.createDataFrame([(1, "x"), (2, "y"), (2, "z"), (None, "n"), (None, "m")], "id int, w string")
    assert bag(op.enrich(fact, dim, "id")) == [(1, "a", "x")]
    with pytest.raises(PySparkException, match="id is not unique: 2"):
        op.enrich(fact.unionByName(spark.createDataFrame([(2, "c")], fact.schema)), dim, "id").collect()
    # Also when nothing of the dimension is asked for, and when its columns are filtered.
    with pytest.raises(PySparkException, match="id is not unique: 2"):
        op.enrich(spark.createDataFrame([(2, "c")], fact.schema), dim, "id").select("v").collect()


def test_references_of_several_types(spark, join_mode):
    fact = spark.createDataFrame(
        [(1, "1", 5, datetime.date(2023, 5, 1)), (2, None, None, datetime.date(2023, 5, 2)), (None, "x", 7, None)],
        "a int, b string, c bigint, d date")
    one = spark.createDataFrame([(1,), (5,), (None,), (1,)], "k bigint")
    words = spark.createDataFrame([("1",), (None,)], "k string")
    days = spark.createDataFrame([(datetime.date(2023, 5, 1),)], "k date")
    checks = [Reference(one, "a", "k", "whole"), Reference(words, "b", "k", "words"), Reference(one, "c", "k", "long"),
              Reference(days, "d", "k", "days"), Reference(words.limit(0), "b", "k", "nothing")]
    expected = [("days", 2), ("long", 2), ("nothing", 3), ("whole", 2), ("words", 2)]
    assert bag(op.integrity_report(fact, checks)) == expected
    for check in checks:
        assert bag(op.integrity_report(fact, [check])) == [e for e in expected if e[0] == check.name]
    marked = op.mark_orphans(fact, checks)
    assert marked.columns == [*fact.columns, *(c.name for c in checks)]
    assert sorted((c.name, marked.where(c.name).count()) for c in checks) == expected


def test_marks_of_hot_keys(spark, conf, skewed):
    conf("spark.sql.autoBroadcastJoinThreshold", "-1")
    dim = spark.createDataFrame([(0,), (0,), (2,), (None,)], "p int")
    marked = op.mark_orphans(skewed, [Reference(dim, "k", "p", "unknown")], share=0.01, min_rows=1)
    expected = skewed.where("k IS NULL OR k NOT IN (0, 2)").count()
    assert marked.count() == 9000 and marked.where("unknown").count() == expected
    assert bag(op.integrity_report(skewed, [Reference(dim, "k", "p", "unknown")])) == [("unknown", expected)]


@pytest.fixture
def skewed(spark):
    """A third of the rows have key 0, as many have none, and all rows of key 0 are equal."""
    n = F.col("id")
    key = F.when(n % 3 == 0, 0).when(n % 3 == 1, F.lit(None)).otherwise(n % 100)
    return spark.range(0, 9000, 1, 12).select(key.alias("k"), F.when(n % 3 > 0, n).alias("v"))


@pytest.mark.parametrize("how", ["inner", "left", "left_anti"])
@pytest.mark.parametrize("min_rows", [1, 50, 1_000_000])
def test_split_join_equals_plain_join(spark, conf, skewed, how, min_rows):
    conf("spark.sql.autoBroadcastJoinThreshold", "-1")
    dim = spark.createDataFrame([(i, f"w{i}") for i in range(0, 70)] + [(0, "again"), (None, "none")], "p int, w string")
    plain = skewed.join(dim, skewed.k == dim.p, how).drop("p")
    split = join_without_hot_tasks(skewed, dim, "k", "p", how, share=0.01, min_rows=min_rows)
    assert split.columns == plain.columns
    assert bag(split) == bag(plain)


def test_hot_keys_are_bounded(spark, skewed):
    hot = {r[0]: r[1] for r in hot_keys(skewed, "k", share=0.1, min_rows=1).collect()}
    assert hot == {0: 4, None: 4}
    assert hot_keys(skewed, "k", share=0.1, min_rows=5000).collect() == []


def test_no_task_of_the_split_join_gets_a_whole_hot_key(spark, conf, skewed):
    conf("spark.sql.autoBroadcastJoinThreshold", "-1")
    conf("spark.sql.adaptive.enabled", "false")
    conf("spark.sql.shuffle.partitions", "24")
    dim = spark.range(0, 100).select(F.col("id").cast("int").alias("p"), F.lit("w").alias("w"))
    split = join_without_hot_tasks(skewed, dim, "k", "p", "left", share=0.02, min_rows=1)
    per_task = split.groupBy(F.spark_partition_id().alias("task")).count()
    assert per_task.agg(F.max("count")).first()[0] < 1500 < 3000


def test_a_hot_key_in_one_partition_is_split_too(spark, conf):
    conf("spark.sql.autoBroadcastJoinThreshold", "-1")
    conf("spark.sql.adaptive.enabled", "false")
    conf("spark.sql.shuffle.partitions", "24")
    left = spark.range(20_000).select(F.lit(1).alias("k"), F.col("id").alias("v")).repartition(8, "k")
    split = join_without_hot_tasks(left, spark.range(5).withColumnRenamed("id", "p"), "k", "p", "inner", 0.01, 1, ["v"])
    per_task = split.groupBy(F.spark_partition_id().alias("task")).count()
    assert per_task.agg(F.sum("count"), F.max("count")).first()[0] == 20_000
    assert per_task.agg(F.max("count")).first()[0] < 5000


def test_size_check(spark, conf):
    small = spark.range(10)
    assert fits_broadcast(small)
    assert not fits_broadcast(spark.range(10**12))
    conf("spark.sql.autoBroadcastJoinThreshold", "-1")
    assert not fits_broadcast(small)
