"""Approximate nearest neighbours by inner product: inverted lists with an adaptive scan of dimensions.

Vectors get one more coordinate that gives all the same length, so the largest inner product is the smallest distance.
They are rotated at random and assigned to the nearest of some centres. Neighbouring lists share a task. Within each list
that a query probes, distances grow over blocks of columns; after each block a hypothesis test on the part that is known
drops the candidates that hardly can be among the nearest, by the limit that the lists before have set. What remains is
scored exactly, and a task hands on the best of all its lists.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from burnish.llm.common import saved

SAMPLE_ROWS = 20_000  # rows that the centres are fitted on; every row is indexed
LIST_ROWS = 400  # rows for each list at least
ROOTS = 4  # lists for the square root of the rows at most
CENTRE_ROWS = 4  # rows of the sample for each centre at least
RECALL = 0.97  # share of the nearest rows of the sample that must lie in the lists probed
TRIED = 256  # rows of the sample that this is measured with
GROUP_ROWS = 4096  # rows of neighbouring lists, or of a part of one list, that a task searches
GROUP_QUERIES = 1 << 16  # queries that meet them in one task
CHUNK = 1024  # queries that are compared with a list at once
COLUMNS = 16  # dimensions between two tests
EPSILON = 2.1  # candidates beyond 1 + EPSILON / sqrt(dimensions known) times the best distance are dropped
SPARSE = 0.2  # share of pairs left from which on they are compared one by one


def usable(df: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """`row` (a number of its own for each), `vec_id` (long), `v` (array<double>) of the vectors that take part."""
    v = F.transform(embedding, lambda x: x.cast("double"))
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(~bad & F.exists("v", lambda x: x != 0))
    return rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "v")


class Index:
    """Centres in the rotated space, in an order in which neighbours are close."""

    def __init__(self, sample: np.ndarray, longest: float, lists: int, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.longest = longest
        d = sample.shape[1] + 1
        self.rotation = np.linalg.qr(rng.standard_normal((d, d)))[0].astype(np.float32)
        rows = self.rotated(sample)
        lists = min(lists, len(np.unique(rows, axis=0)))
        centres = rows[rng.choice(len(rows), lists, replace=False)]
        for _ in range(12):
            near = self._near(rows, centres)
            sums = np.zeros_like(centres)
            np.add.at(sums, near, rows)
            count = np.bincount(near, minlength=lists)
            centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centres).astype(np.float32)
        # Along the direction in which the centres differ most.
        spread = np.linalg.svd(centres - centres.mean(axis=0), full_matrices=False)[2][0] if lists > 1 else centres[0]
        self.centres = centres[np.argsort(centres @ spread, kind="stable")]

    @staticmethod
    def _near(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
        half = (centres**2).sum(axis=1) / 2
        return np.concatenate([(half - rows[k : k + 8192] @ centres.T).argmin(axis=1) for k in range(0, len(rows), 8192)])

    def rotated(self, v: np.ndarray, query: bool = False) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.longest**2 - (v**2).sum(axis=1), 0)) if not query else np.zeros(len(v))
        return np.column_stack([v, rest]).astype(np.float32) @ self.rotation

    def assign(self, v: np.ndarray) -> np.ndarray:
        return self._near(self.rotated(v), self.centres)

    def probes(self, sample: np.ndarray, k: int) -> int:
        """How many lists hold the RECALL share of the true neighbours within the sample."""
        tried = sample[:TRIED]
        score = tried @ sample.T
        score[np.arange(len(tried)), np.arange(len(tried))] = -np.inf
        true = np.argsort(-score, axis=1, kind="stable")[:, : min(k, max(1, len(sample) - 1))]
        order = ((self.centres**2).sum(axis=1) / 2 - self.rotated(tried, query=True) @ self.centres.T).argsort(axis=1, kind="stable")
        place = np.argsort(order, axis=1)
        at = np.take_along_axis(place, self.assign(sample)[true], axis=1).ravel()
        return int(np.sort(at)[min(len(at) - 1, int(np.ceil(RECALL * len(at))) - 1)]) + 1

    def probe(self, q: np.ndarray, sizes: np.ndarray, probes: int, k: int) -> np.ndarray:
        """Whether each query (rows) probes each list: the `probes` nearest, or as many as hold k + 1 vectors."""
        r = self.rotated(q, query=True)
        order = ((self.centres**2).sum(axis=1) / 2 - r @ self.centres.T).argsort(axis=1, kind="stable")
        enough = np.maximum((sizes[order].cumsum(axis=1) <= k).sum(axis=1) + 1, probes)
        out = np.zeros(order.shape, dtype=bool)
        np.put_along_axis(out, order, np.arange(order.shape[1]) < enough[:, None], axis=1)
        return out


class Best:
    """The k best candidates of each of some queries, and the distance that others must beat."""

    def __init__(self, queries: int, k: int, far: np.ndarray):
        self.k, self.far = k, far  # a distance is `far` less twice the score
        self.of, self.row, self.id, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.limit = np.full(queries, np.inf)

    def add(self, of: np.ndarray, row: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        of, row = np.concatenate([self.of, of]), np.concatenate([self.row, row])
        ids, score = np.concatenate([self.id, ids]), np.concatenate([self.score, score])
        order = np.lexsort((ids, -score, of))
        of = of[order]
        place = np.arange(len(of)) - np.searchsorted(of, of)
        order, of, place = order[place < self.k], of[place < self.k], place[place < self.k]
        self.of, self.row, self.id, self.score = of, row[order], ids[order], score[order]
        last = place == self.k - 1
        self.limit[of[last]] = np.maximum(self.far[of[last]] - 2 * self.score[last], 0)


def scan(rows, turned, queries, q_turned, own: np.ndarray, limit: np.ndarray, scale: np.ndarray):
    """Pairs (query, row) that the adaptive scan leaves; `own` marks the pairs of a query and its own row."""
    dims = turned.shape[1]
    known = np.zeros(own.shape, np.float32)
    alive = ~own
    q = x = None
    for at in range(0, dims, COLUMNS):
        to = min(at + COLUMNS, dims)
        slack = (1 + EPSILON / np.sqrt(to)) ** 2 * to / dims if to < dims else 1 + 1e-4
        bound = (limit * slack + 1e-5 * scale).astype(np.float32)
        a, b = q_turned[:, at:to], turned[:, at:to]
        if q is None:
            known += (a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1) - 2 * (a @ b.T)
            alive &= known <= bound[:, None]
            if alive.mean() <= SPARSE:
                q, x = np.nonzero(alive)
                part = known[q, x]
        else:
            part = part + ((a[q] - b[x]) ** 2).sum(axis=1)
            keep = part <= bound[q]
            q, x, part = q[keep], x[keep], part[keep]
    return np.nonzero(alive) if q is None else (q, x)


def search(model: Index, rows: pa.Table, asked: pa.Table, sizes: np.ndarray, probes: int, k: int) -> pa.Table:
    """`query`, `query_id`, `vec_id`, `score`: the k best rows of one group for each query, list by list."""

    def vectors(table: pa.Table) -> np.ndarray:
        v = table.column("v").combine_chunks()
        return v.flatten().to_numpy().reshape(len(v), -1)

    if not len(rows) or not len(asked):
        return pa.table([pa.array([], t) for t in (pa.int64(),) * 3 + (pa.float64(),)], ["query", "query_id", "vec_id", "score"])
    rows = rows.sort_by([("list", "ascending"), ("row", "ascending")])
    lists, row, ids = (rows.column(c).to_numpy() for c in ("list", "row", "vec_id"))
    v = vectors(rows)
    turned = model.rotated(v)
    edges = [0, *(np.flatnonzero(np.diff(lists)) + 1).tolist(), len(lists)]
    out = []
    for lo in range(0, len(asked), CHUNK):
        part = asked.slice(lo, CHUNK)
        q, q_row, q_id = vectors(part), part.column("row").to_numpy(), part.column("vec_id").to_numpy()
        q_turned = model.rotated(q, query=True)
        far = (q_turned.astype(float) ** 2).sum(axis=1) + model.longest**2
        best = Best(len(q), k, far)
        wanted = model.probe(q, sizes, probes, k)
        spans = [(a, b, np.flatnonzero(wanted[:, lists[a]])) for a, b in zip(edges, edges[1:])]
        # The lists that most queries want come first and set the limits.
        for a, b, of in sorted(spans, key=lambda s: -len(s[2])):
            if not len(of):
                continue
            own = q_row[of][:, None] == row[a:b]
            i, x = scan(v[a:b], turned[a:b], q[of], q_turned[of], own, best.limit[of], far[of])
            score = np.einsum("ij,ij->i", q[of[i]], v[a + x])
            best.add(of[i], row[a + x], ids[a + x], score)
        out.append((q_row[best.of], q_id[best.of], best.id, best.score))
    columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 3 + [np.zeros(0)]
    return pa.table([pa.array(c) for c in columns], ["query", "query_id", "vec_id", "score"])


def nearest(df: DataFrame, k: int = 20, every: int = 20, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """`query_id`, `rank`, `vec_id`, `score`: the k nearest found of each row whose id is divisible by `every`.

    Nearness is the inner product of the original vectors in double precision; the nearest come first, ties go to the
    smaller id. Every row is a candidate of every other one, also rows of the same id or the same vector; only a query's
    own row is none of its candidates, and rows that repeat a query's id have a result each. Vectors that are null or
    zero or hold a null or non-finite component take no part, nor do null ids. Vectors of another length are indexed and
    searched apart, as they have no product. With fewer than k candidates all of them come back; an empty table gives no
    row; other columns are left aside.
    """
    rows = saved(usable(df, vec_id, embedding))
    lengths = [r.n for r in rows.groupBy(F.size("v").alias("n")).count().orderBy("n").collect()]
    if not lengths:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    # One index a length; a table has one length as a rule.
    parts = rows if len(lengths) == 1 else None
    return reduce(
        DataFrame.unionByName, (_nearest(parts or rows.where(F.size("v") == n), k, every) for n in lengths)
    )


def _nearest(rows: DataFrame, k: int, every: int) -> DataFrame:
    spark = rows.sparkSession
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    total, longest = rows.agg(F.count("*"), F.max(norm)).first()
    sample = rows.orderBy(F.xxhash64("vec_id", "v"), "row").limit(SAMPLE_ROWS).select("v").collect()
    sample = np.array([r.v for r in sample])
    lists = max(1, min(total // LIST_ROWS, int(ROOTS * total**0.5), len(sample) // CENTRE_ROWS))
    index = Index(sample, longest, lists)
    probes = index.probes(sample, k)
    shared = spark.sparkContext.broadcast(index)

    def vectors(batch: pa.RecordBatch) -> np.ndarray:
        v = batch.column(2)
        return v.flatten().to_numpy().reshape(len(v), -1)

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = pa.array(shared.value.assign(vectors(batch)), pa.int32())
                yield pa.record_batch([near, *batch.columns], ["list", "row", "vec_id", "v"])

    listed = saved(rows.mapInArrow(assigned, "list int, row long, vec_id long, v array<double>"))
    sizes = np.zeros(len(index.centres), np.int64)
    for r in listed.groupBy("list").count().collect():  # one row a list
        sizes[r.list] = r["count"]
    # Groups: neighbouring lists together, a list of more than GROUP_ROWS rows in parts.
    parts = np.maximum(1, -(-sizes // GROUP_ROWS))
    first, filled, group = np.zeros(len(sizes), np.int64), 0, 0
    for n, size in enumerate(sizes):
        if filled and (filled + size > GROUP_ROWS or parts[n] > 1):
            group, filled = group + 1, 0
        first[n] = group
        filled += size
        if parts[n] > 1:
            group, filled = group + parts[n], 0

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            of, wanted = np.nonzero(shared.value.probe(vectors(batch), sizes, probes, k))
            again = np.repeat(np.arange(len(of)), parts[wanted])
            part = np.arange(len(again)) - np.repeat(np.cumsum(parts[wanted]) - parts[wanted], parts[wanted])
            pairs = np.unique(np.column_stack([of[again], first[wanted][again] + part]), axis=0)
            more = batch.take(pa.array(pairs[:, 0]))
            yield pa.record_batch([pa.array(pairs[:, 1], pa.int64()), *more.columns], ["group", "row", "vec_id", "v"])

    chosen = rows.where(F.pmod("vec_id", F.lit(every)) == 0)
    queries = saved(chosen.mapInArrow(probed, "group long, row long, vec_id long, v array<double>"))
    asked = queries.groupBy("group").agg(F.ceil(F.count("*") / GROUP_QUERIES).cast("int").alias("blocks"))

    place = spark.createDataFrame(
        pa.table([pa.array(range(len(sizes)), pa.int32()), pa.array(first), pa.array(parts)], ["list", "first", "parts"])
    )
    left = listed.join(F.broadcast(place), "list").withColumn("group", F.col("first") + F.pmod(F.xxhash64("row"), "parts"))
    left = left.join(F.broadcast(asked), "group")
    left = left.select("group", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "list", "row", "vec_id", "v")
    right = queries.join(F.broadcast(asked), "group")
    right = right.withColumn("block", F.pmod(F.xxhash64("row"), "blocks").cast("int")).select("group", "block", "row", "vec_id", "v")

    def found(of: pa.Table, by: pa.Table) -> pa.Table:
        return search(shared.value, of, by, sizes, probes, k)

    keys = ("group", "block")
    schema = "query long, query_id long, vec_id long, score double"
    best = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(found, schema)
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
