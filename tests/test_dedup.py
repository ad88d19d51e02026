import pytest
from pyspark.sql import functions as F

from burnish import operators as op


def bag(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture
def visits(spark):
    rows = [("a", 2, "x"), ("a", 1, "z"), ("a", 1, "y"), (None, 5, "n"), (None, 4, None), ("b", None, "q"), ("b", 0, "r")]
    return spark.createDataFrame(rows, "id string, seq int, v string")


def test_keeps_the_first_row_with_ties_broken(visits):
    want = [("a", 1, "y"), ("b", None, "q"), (None, 4, None)]
    assert bag(op.dedup_keep_first(visits, ["id"], ["seq"])) == sorted(want, key=repr)
    for parts in (1, 4, 9):
        assert bag(op.dedup_keep_first(visits.repartition(parts), ["id"], ["seq"])) == sorted(want, key=repr)


def test_order_may_be_descending(visits):
    want = [("a", 2, "x"), ("b", 0, "r"), (None, 5, "n")]
    assert bag(op.dedup_keep_first(visits, ["id"], [F.desc_nulls_last("seq")])) == sorted(want, key=repr)


def test_copies_are_counted_in_the_same_pass(visits):
    want = [("a", 1, "y", 3), ("b", None, "q", 2), (None, 4, None, 2)]
    found = op.dedup_keep_first(visits, ["id"], ["seq"], copies="n")
    assert found.columns == ["id", "seq", "v", "n"]
    assert bag(found) == sorted(want, key=repr)


def test_copies_need_comparable_columns(spark, visits):
    with pytest.raises(ValueError):
        op.dedup_keep_first(visits, ["id"], [F.desc("seq")], copies="n")
    maps = visits.withColumn("m", F.create_map("v", "v"))
    with pytest.raises(ValueError):
        op.dedup_keep_first(maps, ["id"], ["seq"], copies="n")
    good = maps.where("v IS NOT NULL")
    assert op.dedup_keep_first(good, ["id"], ["seq"]).count() == 3


def test_duplicate_count(spark, visits):
    assert tuple(op.duplicate_count(visits, ["id"]).first()) == (7, 3, 4)
    assert tuple(op.duplicate_count(visits, ["id", "seq"]).first()) == (7, 6, 1)
    assert tuple(op.duplicate_count(visits.limit(0), ["id"]).first()) == (0, 0, 0)


def test_hot_key_leaves_each_task_as_one_row(spark, conf):
    conf("spark.sql.adaptive.enabled", "false")
    hot = spark.range(0, 30_000, 1, 6).select(
        F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id")).alias("k"), F.col("id").alias("v")
    )
    found = op.dedup_keep_first(hot, ["k"], ["v"])
    assert found.count() == 20_001
    plan = found._jdf.queryExecution().executedPlan().toString()
    before_shuffle = plan[plan.index("Exchange"):]
    assert "WindowGroupLimit" in before_shuffle
