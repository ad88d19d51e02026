import datetime
import random
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from burnish import operators as op
from burnish.functions import (
    amount_parts,
    exact_mean,
    exact_total,
    mean_of,
    merged_parts,
    percent,
    to_date_any,
    total_of,
)
from burnish.rules import DATE_FORMATS


def test_tokens(spark):
    values = [None, "", "  ", "NaN", " n/a ", "NULL", "None", "#N/A", "na", "nano", "0"]
    df = spark.createDataFrame([(v,) for v in values], "c string")
    assert [r.c for r in op.null_tokens(df, "c").collect()] == [None] * 9 + ["nano", "0"]


@pytest.mark.parametrize(
    "text, number",
    [
        ("1,200", 1200.0), (" 12.5 ", 12.5), ("abc", None), ("12d", None), ("Infinity", None), ("NaN", None),
        ("-100", -100.0), ("+7", 7.0), (".5", 0.5), ("5.", 5.0), ("1e3", 1000.0), ("1,2,3", 123.0), (",", None),
        ("", None), (None, None), ("1 200", None), ("--1", None), ("\t3", 3.0), ("1e999", float("inf")), ("١٢", None),
    ],
)
def test_amount(spark, text, number):
    df = spark.createDataFrame([(text,)], "c string")
    assert op.parse_amount(df, "c", "x").first().x == number


def test_amount_as_spark_casts(spark):
    df = spark.createDataFrame([("12d",), ("Infinity",), ("x",)], "c string")
    found = op.parse_amount(df, "c", "x", text="t", plain_only=False)
    assert [tuple(r) for r in found.collect()] == [
        ("12d", "12d", 12.0), ("Infinity", "Infinity", float("inf")), ("x", "x", None),
    ]


def test_amount_flags(spark):
    values = [None, float("nan"), -1.0, 0.0, 5.0]
    df = spark.createDataFrame([(v,) for v in values], "a double")
    assert [r.f for r in op.flag_invalid_amount(df, "a", "f").collect()] == [True, True, True, False, False]
    assert [r.f for r in op.flag_invalid_amount(df, "a", "f", minimum=5).collect()] == [True] * 4 + [False]
    assert [r.f for r in op.flag_missing_amount(df, "a", "f").collect()] == [True, True, False, False, False]


def parsed(spark, texts, **kwargs):
    df = spark.createDataFrame([(t,) for t in texts], "d string")
    flagged = op.flag_sentinel(df, "d", out="flag")
    return [tuple(r)[1:] for r in op.parse_dates(flagged, "d", out="day", flag="flag", **kwargs).collect()]


def test_dates(spark):
    day = datetime.date
    cases = {
        "2023/05/01 10:30": ("ok", day(2023, 5, 1)), "2023/05/01": ("ok", day(2023, 1, 5)),
        "2023/25/12": ("ok", day(2023, 12, 25)), "2023-02-30": ("ok", None), "31-12-2023": ("sentinel_placeholder", None),
        " 31-12-2023": ("ok", None), None: ("missing", None), "": ("ok", None), "unknown": ("ok", None),
        " 2023-05-01 ": ("ok", day(2023, 5, 1)), "2023-05-01T10:11:12": ("ok", day(2023, 5, 1)),
        "2023-05-01 10:11:12": ("ok", day(2023, 5, 1)), "2023-05-01T10:11:12.123456": ("ok", day(2023, 5, 1)),
        "2023-05-01T25:11:12": ("ok", None), "2024-02-29": ("ok", day(2024, 2, 29)), "2023/13/13": ("ok", None),
        "2023-05-01x": ("ok", None),
    }
    assert parsed(spark, cases) == list(cases.values())


def test_unparsed_gets_a_flag_of_its_own(spark):
    found = parsed(spark, ["2023-02-30", "2023-01-01", None], mark_unparsed=True)
    assert [flag for flag, _ in found] == ["unparsed", "ok", "missing"]


def test_other_formats_go_to_the_parser(spark):
    df = spark.createDataFrame([("1 Mar 2024",), ("01.03.2024",), ("2024",)], "d string")
    found = df.select(to_date_any(F.col("d"), ["d MMM yyyy", "dd.MM.yyyy"]).alias("x"))
    assert [r.x for r in found.collect()] == [datetime.date(2024, 3, 1)] * 2 + [None]


def test_dates_equal_the_pattern_parser(spark):
    """Every shape, with digits that also make impossible months, days and times."""
    rng = random.Random(7)
    shapes = ["dddd-dd-ddTdd:dd:dd.dddddd", "dddd-dd-dd", "dddd/dd/dd", "dddd/dd/dd dd:dd", "dddd-dd-ddTdd:dd:dd",
              "dddd-dd-dd dd:dd:dd", "dd-dd-dddd", "dddd-d-dd"]
    texts = ["".join(rng.choice("0011223469") if c == "d" else c for c in rng.choice(shapes)) for _ in range(20000)]
    df = spark.createDataFrame([(t,) for t in texts], "d string")
    by_parser = F.coalesce(*[F.try_to_date("d", fmt) for fmt in DATE_FORMATS])
    by_shape = to_date_any(F.col("d"), DATE_FORMATS)
    found = df.select("d", by_shape.cast("string").alias("x"), by_parser.cast("string").alias("y"))
    assert found.where(~F.col("x").eqNullSafe(F.col("y"))).collect() == []
    assert found.where("x IS NOT NULL").count() > 1000


def test_totals_do_not_depend_on_the_row_order(spark):
    rng = random.Random(3)
    values = [round(rng.uniform(-1e6, 1e6), 2) for _ in range(5000)] + [1e15, -1e15, None]
    results = set()
    for parts in (1, 3, 7):
        rng.shuffle(values)
        df = spark.createDataFrame([(v,) for v in values], "a double").repartition(parts)
        results.add(tuple(df.agg(exact_total(F.col("a")), exact_mean(F.col("a"))).first()))
    cents = sum(round(v * 100) for v in values if v is not None)
    assert results == {(cents / 100, round(cents / 100 / 5002, 2))}


def test_totals_are_exact_to_six_decimals(spark):
    rng = random.Random(11)
    texts = [f"{rng.choice(['', '-'])}{rng.randrange(10 ** rng.randint(1, 12))}.{rng.randrange(10 ** 6):06d}"
             for _ in range(4000)]
    texts = [t for t in texts if len(t) < 16] + ["0.005", "-0.005", "999999999.999999", "-1000000000.000001"]
    df = spark.createDataFrame([(i % 7, t) for i, t in enumerate(texts)], "g int, t string")
    parts = df.groupBy("g").agg(amount_parts(F.col("t").cast("double")).alias("p"))
    merged = merged_parts(F.col("p"))
    total, mean = parts.agg(total_of(merged), mean_of(merged)).first()
    exact = sum(map(Decimal, texts))
    assert total == float(exact.quantize(Decimal("0.01"), ROUND_HALF_UP))
    assert mean == float((exact / len(texts)).quantize(Decimal("0.01"), ROUND_HALF_UP))


def test_total_survives_an_overflow_of_the_units(spark):
    half = "named_struct('rows', 2L, 'high', 1164153218L, 'low', 1156841472L, 'millionths', 0L, 'rest', 0D) AS p"
    merged = merged_parts(F.col("p"))
    df = spark.sql(f"SELECT {half} UNION ALL SELECT {half}")
    assert tuple(df.agg(total_of(merged), mean_of(merged)).first()) == (1e19, 2.5e18)
    nan = spark.createDataFrame([(float("nan"),), (1.0,)], "a double").agg(exact_total(F.col("a"))).first()[0]
    assert nan != nan


def test_no_part_of_an_amount_is_cut(spark):
    tiny = spark.range(0, 100_000, 1, 7).select(F.lit(4e-6 / 10).alias("a"))
    assert tiny.agg(exact_total(F.col("a"))).first()[0] == 0.04
    mixed = spark.createDataFrame([(2e18,), (0.07,), (-2e18,), (0.01,)], "a double")
    assert mixed.agg(exact_total(F.col("a"))).first()[0] == 0.08


def test_cents_add_up_alike_in_any_order(spark):
    rng = random.Random(5)
    cents = [rng.randrange(10**rng.randint(1, 11)) for _ in range(3000)]
    df = spark.createDataFrame([(c / 100,) for c in cents], "a double")
    for n in (1, 7, 64):
        assert df.repartition(n).agg(exact_total(F.col("a"))).first()[0] == sum(cents) / 100


def test_totals_without_a_decimal(spark):
    df = spark.createDataFrame([(1e30,), (5.0,), (None,)], "a double")
    assert tuple(df.agg(exact_total(F.col("a")), exact_mean(F.col("a"))).first()) == (1e30, 5e29)
    empty = df.where("a < 0").agg(exact_total(F.col("a")), exact_mean(F.col("a")))
    assert tuple(empty.first()) == (None, None)


def test_percent(spark):
    found = spark.sql("SELECT 1 AS n, 3 AS m UNION ALL SELECT 0, 0 UNION ALL SELECT 1, 800").select(
        percent(F.col("n"), F.col("m")).alias("p")
    )
    assert [r.p for r in found.collect()] == [33.33, None, 0.13]
