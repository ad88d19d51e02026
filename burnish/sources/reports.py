"""Results as CSV, single ones and whole sets that are published at once."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.types import StructType

RUNS = "runs"
MANIFESTS = "manifests"
MANIFEST = re.compile(r"(\d{12})\.json")


def write_report(df: DataFrame, path: str, order_by: Sequence[str | Column] = (), one_file: bool = True) -> None:
    """Write a result to directory `path` as CSV with a header, replacing what is there.

    `one_file` gathers the rows of an aggregated result in one part; the tasks before it stay as they are, and
    `order_by` sorts the rows within it. Without `one_file` every task writes its part, for results of any size. The
    files are written beside `path`; when they are complete, the earlier report steps aside, they take its place, and
    it is deleted. If they can't take it, the earlier report comes back.
    """
    parts = df.repartition(1) if one_file else df
    if order_by:
        parts = parts.sortWithinPartitions(*order_by)
    staged = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    parts.write.option("header", True).csv(staged)
    _replace(df.sparkSession, staged, path)


def _replace(spark: SparkSession, staged: str, path: str) -> None:
    store, target = _store(spark, path)
    source, aside = _path(spark, staged), _path(spark, f"{staged}.old")
    earlier = store.exists(target)
    if earlier and not store.rename(target, aside):
        raise OSError(f"the earlier report {path} could not step aside")
    try:
        if not store.rename(source, target):
            raise OSError(f"{staged} could not take the place of {path}")
    except Exception:
        if earlier:
            store.rename(aside, target)
        raise
    if earlier:
        store.delete(aside, True)


def _path(spark: SparkSession, path: str) -> Any:
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _store(spark: SparkSession, path: str) -> tuple[Any, Any]:
    """The file system of `path`, and `path` as it names it."""
    target = _path(spark, path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


@dataclass(frozen=True)
class ReportSet:
    """A published set: its number, the folder of its run and the columns of each report."""

    number: int
    folder: str
    reports: Mapping[str, Mapping[str, Any]]

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def read(self, spark: SparkSession, name: str) -> DataFrame:
        return spark.read.schema(StructType.fromJson(dict(self.reports[name]))).csv(self.path(name), header=True)


def publish_reports(
    spark: SparkSession,
    out_dir: str,
    results: Mapping[str, DataFrame],
    order_by: Mapping[str, Sequence[str | Column]] | None = None,
    keep: int = 2,
) -> ReportSet:
    """Write all `results` below `out_dir` and publish them together; `current_reports` finds the last set.

    The reports of a run lie in a folder of their own. When all are written, a manifest that names them appears under
    the next number: a file that is written beside and renamed, which is the one step that switches sets. A run that
    fails or is killed before leaves the earlier set as it was, complete; its folder goes with the next set that is
    published. The last `keep` sets stay, so readers of the earlier one can finish.
    """
    base = out_dir.rstrip("/")
    run = uuid.uuid4().hex
    for name, df in results.items():
        write_report(df, f"{base}/{RUNS}/{run}/{name}", (order_by or {}).get(name, ()))
    content = json.dumps({"run": run, "reports": {name: df.schema.jsonValue() for name, df in results.items()}})
    store, _ = _store(spark, base)
    staged = _path(spark, f"{base}/{RUNS}/{run}/manifest.json")
    out = store.create(staged, True)
    out.write(bytearray(content.encode()))
    out.close()
    folder = _path(spark, f"{base}/{MANIFESTS}")
    store.mkdirs(folder)
    number = max(_numbers(spark, base), default=0) + 1
    # Another job may publish at the same time: whoever comes second takes the next number.
    while True:
        target = _path(spark, f"{base}/{MANIFESTS}/{number:012d}.json")
        if not store.exists(target):
            if store.rename(staged, target):
                break
            if not store.exists(target):
                raise OSError(f"the manifest of run {run} could not be published")
        number += 1
    _forget(spark, base, max(1, keep))
    return ReportSet(number, f"{base}/{RUNS}/{run}", json.loads(content)["reports"])


def current_reports(spark: SparkSession, out_dir: str) -> ReportSet:
    """The set that was published last."""
    base = out_dir.rstrip("/")
    numbers = _numbers(spark, base)
    if not numbers:
        raise FileNotFoundError(f"no reports were published in {out_dir}")
    return _read(spark, base, max(numbers))


def _numbers(spark: SparkSession, base: str) -> list[int]:
    store, folder = _store(spark, f"{base}/{MANIFESTS}")
    if not store.exists(folder):
        return []
    names = (f.getPath().getName() for f in store.listStatus(folder))
    return [int(m[1]) for m in map(MANIFEST.fullmatch, names) if m]


def _read(spark: SparkSession, base: str, number: int) -> ReportSet:
    text = spark.read.text(f"{base}/{MANIFESTS}/{number:012d}.json", wholetext=True).first()[0]
    found = json.loads(text)
    return ReportSet(number, f"{base}/{RUNS}/{found['run']}", found["reports"])


def _forget(spark: SparkSession, base: str, keep: int) -> None:
    """Delete all but the last `keep` sets, and runs older than them that were never published.

    A run without a manifest may be one that is still being written, so only those go that began before the oldest set
    that stays was published.
    """
    numbers = sorted(_numbers(spark, base))
    kept = {_read(spark, base, n).folder.rsplit("/", 1)[1] for n in numbers[-keep:]}
    store, runs = _store(spark, f"{base}/{RUNS}")
    since = store.getFileStatus(_path(spark, f"{base}/{MANIFESTS}/{numbers[-keep:][0]:012d}.json")).getModificationTime()
    for status in store.listStatus(runs):
        if status.getPath().getName() not in kept and status.getModificationTime() < since:
            store.delete(status.getPath(), True)
    for n in numbers[:-keep]:
        store.delete(_path(spark, f"{base}/{MANIFESTS}/{n:012d}.json"), False)
