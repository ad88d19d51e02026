from pathlib import Path

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from burnish.sources import (
    current_reports,
    load_table,
    malformed_count,
    publish_reports,
    read_raw,
    reports,
    save_table,
    write_report,
)


@pytest.fixture
def db(tmp_path):
    return f"db_{tmp_path.name.replace('-', '_')}_{abs(hash(tmp_path))}"


def write(path: Path, text: str) -> str:
    path.write_text(text)
    return str(path)


def test_everything_is_read_as_text(spark, tmp_path):
    path = write(tmp_path / "raw.csv", 'id,price\n01,"1,200"\n02,NaN\n03,\n04,""\n05, 7 \n')
    for columns in (None, ["id", "price"]):
        df = read_raw(spark, path, columns)
        assert [t for _, t in df.dtypes] == ["string", "string"]
        assert [tuple(r) for r in df.collect()] == [
            ("01", "1,200"), ("02", "NaN"), ("03", None), ("04", None), ("05", " 7 "),
        ]


def test_wrong_header_is_an_error(spark, tmp_path):
    path = write(tmp_path / "raw.csv", "price,id\n7,01\n")
    with pytest.raises(Exception, match="CSV header does not conform to the schema"):
        read_raw(spark, path, ["id", "price"]).collect()


def test_only_used_columns_are_parsed(spark, tmp_path):
    path = write(tmp_path / "raw.csv", "id,price\n01,7\n")
    plan = read_raw(spark, path, ["id", "price"]).select("price")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<price:string>" in plan


def test_table_is_replaced(spark, db):
    save_table(spark.range(5), db, "t")
    save_table(spark.range(3).withColumn("x", F.lit("a")), db, "t")
    assert [tuple(r) for r in load_table(spark, db, "t").orderBy("id").collect()] == [(0, "a"), (1, "a"), (2, "a")]
    assert spark.sql(f"DESCRIBE EXTENDED `{db}`.t").where("col_name = 'Provider'").first()[1] == "parquet"


def test_table_place(spark, db, tmp_path):
    save_table(spark.range(20), db, "t", location=str(tmp_path / "bob's tables"))
    assert len(list((tmp_path / "bob's tables").glob("t.*/*.parquet"))) > 0
    assert load_table(spark, db, "t").count() == 20


def test_a_table_is_replaced_whole_or_not_at_all(spark, db, tmp_path):
    save_table(spark.range(5), db, "t", location=str(tmp_path / "tables"))
    before = load_table(spark, db, "t")
    with pytest.raises(PySparkException):
        save_table(spark.range(3).select(F.raise_error(F.lit("no")).cast("long").alias("id")), db, "t")
    with pytest.raises(PySparkException):
        save_table(spark.range(3).select(F.raise_error(F.lit("no")).alias("other")), db, "t")
    assert before.count() == load_table(spark, db, "t").count() == 5
    # It may read what it replaces, and only the last files stay.
    save_table(load_table(spark, db, "t").where("id > 1"), db, "t")
    assert sorted(r[0] for r in load_table(spark, db, "t").collect()) == [2, 3, 4]
    place = spark.sql(f"DESCRIBE EXTENDED `{db}`.t").where("col_name = 'Location'").first()[1].removeprefix("file:")
    # Beside it lie the remains of the two jobs that failed.
    assert [p for p in (tmp_path / "tables").iterdir() if list(p.glob("*.parquet"))] == [Path(place)]
    spark.sql(f"DROP TABLE `{db}`.t")
    assert not Path(place).exists()
    save_table(spark.range(2), db, "t")
    assert load_table(spark, db, "t").count() == 2


def test_files_of_an_external_table_stay(spark, db, tmp_path):
    spark.range(4).write.parquet(str(tmp_path / "own"))
    spark.sql(f"CREATE DATABASE `{db}`")
    spark.sql(f"CREATE TABLE `{db}`.t (id BIGINT) USING parquet LOCATION '{tmp_path}/own'")
    save_table(spark.range(1), db, "t")
    assert load_table(spark, db, "t").count() == 1
    assert spark.read.parquet(str(tmp_path / "own")).count() == 4


def result_set(spark, n):
    return {name: spark.range(n).withColumn("name", F.lit(name)) for name in ("a", "b", "c")}


def test_reports_are_published_together(spark, tmp_path):
    out = str(tmp_path / "out")
    with pytest.raises(FileNotFoundError):
        current_reports(spark, out)
    publish_reports(spark, out, result_set(spark, 2), {"a": [F.desc("id")]})
    first = current_reports(spark, out)
    assert {name: [tuple(r) for r in first.read(spark, name).collect()] for name in first.reports} == {
        "a": [(1, "a"), (0, "a")], "b": [(0, "b"), (1, "b")], "c": [(0, "c"), (1, "c")]}
    for n in (3, 4):
        publish_reports(spark, out, result_set(spark, n))
    assert current_reports(spark, out).number == 3
    assert current_reports(spark, out).read(spark, "b").count() == 4
    assert len(list((tmp_path / "out" / "manifests").glob("*.json"))) == 2


@pytest.mark.parametrize("after", [0, 1, 2, 3])
def test_a_run_that_dies_between_reports_leaves_the_set_before(spark, tmp_path, monkeypatch, after):
    out = str(tmp_path / "out")
    publish_reports(spark, out, result_set(spark, 2))
    real, done = reports.write_report, []

    def dying(df, path, order_by=()):
        if len(done) == after:
            raise KeyboardInterrupt
        done.append(path)
        real(df, path, order_by)

    monkeypatch.setattr(reports, "write_report", dying)
    if after == 3:
        monkeypatch.setattr(reports, "_numbers", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt))
    with pytest.raises(KeyboardInterrupt):
        publish_reports(spark, out, result_set(spark, 5))
    monkeypatch.undo()
    found = current_reports(spark, out)
    assert [found.read(spark, name).count() for name in found.reports] == [2, 2, 2]
    # What the dead run left goes when two later sets are there.
    for _ in range(2):
        publish_reports(spark, out, result_set(spark, 1))
    assert len(list((tmp_path / "out" / "runs").iterdir())) == 2


def test_an_earlier_report_comes_back(spark, tmp_path):
    path = str(tmp_path / "report")
    write_report(spark.range(3), path)
    with pytest.raises(Exception):
        reports._replace(spark, str(tmp_path / "missing"), path)
    assert spark.read.csv(path, header=True).count() == 3


def test_report_is_one_file_in_order(spark, tmp_path):
    path = str(tmp_path / "report")
    counts = spark.range(100).groupBy((F.col("id") % 7).alias("k")).count().orderBy("k")
    write_report(counts.limit(3), path, ["k"])
    write_report(counts, path, ["k"])
    (part,) = (tmp_path / "report").glob("part-*.csv")
    assert part.read_text().splitlines() == ["k,count", "0,15", "1,15"] + [f"{k},14" for k in range(2, 7)]


def test_empty_report_has_a_header(spark, tmp_path):
    write_report(spark.range(0), str(tmp_path / "report"))
    (part,) = (tmp_path / "report").glob("part-*.csv")
    assert part.read_text() == "id\n"


@pytest.mark.parametrize("one_file", [True, False])
def test_report_of_many_rows(spark, tmp_path, one_file):
    path = str(tmp_path / "report")
    write_report(spark.range(0, 150_000, 1, 5), path, ["id"], one_file)
    assert len(list((tmp_path / "report").glob("part-*"))) == (1 if one_file else 5)
    assert spark.read.csv(path, header=True).selectExpr("count(*)", "sum(id)").first()[:] == (150_000, 150_000 * 149_999 / 2)


def test_a_report_that_fails_leaves_the_earlier_one(spark, tmp_path):
    path = str(tmp_path / "report")
    write_report(spark.range(3), path)
    with pytest.raises(PySparkException):
        write_report(spark.range(3).select(F.raise_error(F.lit("no"))), path)
    assert spark.read.csv(path, header=True).count() == 3


def test_header_in_another_order_fails(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,name\n1,x\n")
    (tmp_path / "b.csv").write_text("name,id\ny,2\n")
    with pytest.raises(Exception, match="(?i)header"):
        read_raw(spark, str(tmp_path)).collect()


def test_ragged_records_are_counted(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,name\n1,x\n2\n3,y,z\n4,\n")
    raw = read_raw(spark, str(tmp_path), corrupt="broken")
    assert [tuple(r) for r in raw.orderBy("id").collect()] == [
        ("1", "x", None), ("2", None, "2"), ("3", "y", "3,y,z"), ("4", None, None)]
    assert malformed_count(raw, "broken").first()[:] == (4, 2)
    assert malformed_count(read_raw(spark, str(tmp_path), ["id", "name"], "broken"), "broken").first()[:] == (4, 2)
