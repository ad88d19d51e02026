"""Shared storage, hashing of words and shingles, and connected components."""

from __future__ import annotations

import ctypes
import gc
import os
import time
from collections.abc import Callable, Iterator
from contextlib import suppress
from pathlib import Path
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from burnish.functions.text import named
from burnish.sources.scratch import scratch_dir, stored

# Text bytes that a task turns into arrays at once.
SLICE_BYTES = 1 << 20

_U = np.uint64
_BYTE = np.random.default_rng(7).integers(0, 2**64, 256, dtype=_U) | _U(1)
_BASE = 0x9E3779B97F4A7C15
_STEPS = np.random.default_rng(11).integers(0, 2**64, 64, dtype=_U) | _U(1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shared_dir(spark: SparkSession) -> str:
    """A new folder that the driver and all executors share, see `scratch_dir`."""
    return scratch_dir(spark)


def saved(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read again: cuts the lineage, survives lost executors."""
    return stored(df)


def let_go(spark: SparkSession) -> None:
    """Have the shuffle files of finished jobs removed now. Spark does so once the driver's garbage is collected, which
    may be never in a run of few and large jobs."""
    system = spark.sparkContext._jvm.System
    gc.collect()
    system.gc()
    time.sleep(1.2)  # a thread of py4j, which looks once a second, tells the JVM what Python has dropped
    system.gc()


def local_path(uri: str) -> str:
    """The path under which tasks see a folder of a shared file system; other stores can't be memory-mapped."""
    if uri.startswith("file:"):
        return "/" + uri.removeprefix("file:").lstrip("/")
    if "://" in uri:
        raise ValueError(f"{uri} can't be opened as files; put spark.checkpoint.dir on a shared mount")
    return uri


def workers_find_this(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver has it, if it isn't installed."""
    paths = [str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment.get("PYTHONPATH", "")]
    if paths[0] not in paths[1].split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, paths))


_HELD: dict[Any, Any] = {}


def held(key: Any, build: Callable[[], Any]) -> Any:
    """One model a Python worker, built when a task first asks for it. Another one takes its place.

    Workers serve many tasks; what one operator keeps would stay beside the next one's.
    """
    if key not in _HELD:
        release()
        _HELD[key] = build()
    return _HELD[key]


def release(but: Any = None) -> None:
    """Drop the model of an earlier task."""
    others = [k for k in _HELD if k != but]
    for k in others:
        del _HELD[k]
    if others:
        trim()


def trim() -> None:
    """Give memory that is free again back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def remainder(column: str, divisor: int) -> Column:
    """crc32 of the text of an id, modulo `divisor`."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(divisor))


def slices(
    batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES, model: Any = None
) -> Iterator[pa.RecordBatch]:
    """Cut batches by the bytes of `column`, so that a task's memory follows the limit or one longest text.

    Every task starts here: it drops the models of other ones, all but that `held` under the key `model`.
    """
    release(model)
    for batch in batches:
        if not batch.num_rows:
            continue
        text = batch.column(batch.schema.get_field_index(column)).cast(pa.large_string())
        size = np.diff(np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1])
        part = (np.cumsum(size) - size) // limit
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            yield batch.slice(a, b - a)
    # Workers stay; what the task needed on the way needn't.
    trim()


def map_rows(
    df: DataFrame, kept: list[str], mapped: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], added: str
) -> DataFrame:
    """`mapInArrow` over the columns `kept`, which become the first ones of the result, and those of the DDL `added`.

    Batches go by the numbers of their columns (`c0`, `c1`, ...), as mapInArrow knows no names with dots.
    """
    fields = StructType.fromDDL(added).fields
    rows = df.select(*(named(c).alias(f"c{i}") for i, c in enumerate(kept)))
    out = rows.mapInArrow(mapped, StructType([*rows.schema.fields, *fields]))
    return out.toDF(*kept, *(f.name for f in fields))


def texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """UTF-8 bytes; a null text is empty."""
    at = batch.schema.get_field_index(column)
    return [x or b"" for x in batch.column(at).cast(pa.large_binary()).to_pylist()]


def mix(x: np.ndarray) -> np.ndarray:
    """Scatter 64-bit values; uint64 in and out, one to one."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def words(docs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document number of every word: maximal runs without ASCII white space, A-Z in lower case."""
    buf = _LOWER[np.frombuffer(b" ".join([b"", *docs, b""]), np.uint8)]
    inside = ~_SPACE[buf]
    change = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    start, end = change[0::2], change[1::2]
    n = len(buf)
    powers = np.full(n + 1, _BASE, _U)
    powers[0] = 1
    np.multiply.accumulate(powers, out=powers)
    sums = np.zeros(n + 1, _U)
    np.cumsum(_BYTE[buf] * powers[:n], out=sums[1:])
    inverse = np.full(n + 1, pow(_BASE, -1, 1 << 64), _U)
    inverse[0] = 1
    np.multiply.accumulate(inverse, out=inverse)
    value = mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(_U) * _STEPS[63])
    bounds = np.cumsum([1, *(len(x) + 1 for x in docs)])
    return value, np.searchsorted(bounds, start, "right") - 1


def shingles(docs: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document number of each distinct shingle, ascending by document and hash.

    A text of fewer than `size` words has its whole word sequence as one shingle; without words it has none.
    """
    value, doc = words(docs)
    count = np.bincount(doc, minlength=len(docs)).astype(np.int64)
    n = max(0, len(value) - size + 1)
    full = np.zeros(n, _U)
    for k in range(size):
        full += value[k : n + k] * _STEPS[k]
    keep = doc[:n] == doc[size - 1 : n + size - 1]
    full, of = full[keep], doc[:n][keep]
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        first = np.cumsum(count) - count
        rest = np.zeros(len(short), _U)
        for k in range(size - 1):
            there = count[short] > k
            rest[there] += value[first[short[there]] + k] * _STEPS[k]
        rest += count[short].astype(_U) * _STEPS[62]
        full, of = np.concatenate([full, rest]), np.concatenate([of, short])
    full = mix(full)
    order = np.lexsort((full, of))
    full, of = full[order], of[order]
    new = np.ones(len(full), dtype=bool)
    new[1:] = (full[1:] != full[:-1]) | (of[1:] != of[:-1])
    return full[new], of[new]


def components(links: DataFrame) -> DataFrame:
    """`node`, `component` (smallest node reachable) of every node of `links` (`a`, `b`).

    Alternating large-star and small-star steps: each hangs neighbours on the smallest one, so a component of any
    size converges in a logarithmic number of rounds, with edges as the only state. Rounds hand over by tables.
    """
    edges = saved(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        small = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(small, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.unionByName(small.where("m < a").select("a", F.col("m").alias("b"))).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(low, "a")
        edges = saved(
            joined.select(F.col("b").alias("a"), F.col("m").alias("b"))
            .where("a <> b")
            .unionByName(low.select("a", F.col("m").alias("b")))
            .distinct()
        )
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
