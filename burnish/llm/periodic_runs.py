"""Stretches of words that repeat with a period, found by occurrences of dyadic blocks in their neighbourhood.

A run of period q that is at least four periods long holds a whole aligned block of 2^k words, q <= 2^k < 2q, whose next
or previous occurrence in the text lies exactly q words away. Each block is an interval of the suffix array; a wavelet
tree over the array gives the successor and predecessor of the block's own position within that interval. Occurrences
that are at most the block's length away give candidate periods; the ranks of the doubled lengths, kept for all levels,
tell how far each candidate extends on both sides.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burnish.llm.common import map_rows, slices, texts

SLICE_BYTES = 4 << 20


class SuffixRanks:
    """Suffix array of several texts, each with an alphabet of its own, and the ranks of all doubled lengths.

    `rank[k]` gives for each position the first row of the suffixes that share its 2^k words; a text that ends earlier
    shares them with none. `rows[k]` is how many there are. Levels end with half of the longest text.
    """

    def __init__(self, code: np.ndarray, text: np.ndarray, end: np.ndarray):
        n = len(code)
        longest = int((end - np.arange(n)).max(initial=0))
        key = text * (int(code.max(initial=0)) + 1) + code
        self.order = np.argsort(key, kind="stable")
        rank = np.empty(n, np.int64)
        rank[self.order], many = self._first_of_equal(key[self.order])
        rows = np.empty(n, np.int64)
        rows[self.order] = many
        self.rank, self.rows = [rank.astype(np.int32)], [rows.astype(np.int32)]
        size = 1
        while 2 * size <= longest:
            open_ = np.flatnonzero(rows > 1)
            later = open_ + size
            second = np.zeros(len(open_), np.int64)
            inside = later < end[open_]
            second[inside] = rank[later[inside]] + 1
            by = np.lexsort((second, rank[open_]))
            moved, both = open_[by], rank[open_[by]] * (n + 1) + second[by]
            # The suffixes of equal rank keep their rows of the array, in the new order among themselves.
            old = rank[moved]
            slot = old + np.arange(len(moved)) - np.searchsorted(old, old)
            self.order[slot] = moved
            first, many = self._first_of_equal(both)
            rank, rows = rank.copy(), rows.copy()
            rank[moved], rows[moved] = slot[first], many
            self.rank.append(rank.astype(np.int32))
            self.rows.append(rows.astype(np.int32))
            size *= 2

    @staticmethod
    def _first_of_equal(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For ascending values: the place of the first equal one, and how many are equal."""
        new = np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.zeros(0, np.int64)
        many = np.diff(np.append(new, len(values)))
        return np.repeat(new, many), np.repeat(many, many)

    def shared(self, a: np.ndarray, b: np.ndarray, back: bool) -> np.ndarray:
        """How many words agree from positions `a` and `b` (of one text) on, or in front of them if `back`."""
        n = len(self.order)
        total = np.zeros(len(a), np.int64)
        for k in reversed(range(len(self.rank))):
            rank, step = self.rank[k], 1 << k
            live = np.arange(len(a))
            while len(live):
                x, y = (a[live] - total[live] - step, b[live] - total[live] - step) if back else (a[live] + total[live], b[live] + total[live])
                same = (x >= 0) & (y < n)
                same[same] = rank[x[same]] == rank[y[same]]
                live = live[same]
                total[live] += step
                if k < len(self.rank) - 1:  # below the highest level a second step would have been one of the level above
                    break
        return total


class WaveletTree:
    """Values in a matrix of bits, highest first, for order queries over ranges of places."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(values.max(initial=0)).bit_length())
        self.zeros, self.before = [], []
        for level in reversed(range(self.bits)):
            one = (values >> level & 1).astype(bool)
            self.before.append(np.append(np.int32(0), np.cumsum(~one, dtype=np.int32)))
            self.zeros.append(int(self.before[-1][-1]))
            values = np.concatenate([values[~one], values[one]])

    def smaller(self, low: np.ndarray, high: np.ndarray, value: np.ndarray) -> np.ndarray:
        """How many of the places low..high-1 hold less than `value`."""
        low, high, count = low.copy(), high.copy(), np.zeros(len(low), np.int64)
        for level, (zeros, before) in enumerate(zip(self.zeros, self.before)):
            one = (value >> (self.bits - 1 - level) & 1).astype(bool)
            a, b = before[low].astype(np.int64), before[high].astype(np.int64)
            count += np.where(one, b - a, 0)
            low, high = np.where(one, zeros + low - a, a), np.where(one, zeros + high - b, b)
        return count

    def nth(self, low: np.ndarray, high: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The n-th smallest value (from 0) of the places low..high-1."""
        low, high, n, out = low.copy(), high.copy(), n.copy(), np.zeros(len(low), np.int64)
        for zeros, before in zip(self.zeros, self.before):
            a, b = before[low].astype(np.int64), before[high].astype(np.int64)
            one = n >= b - a
            n -= np.where(one, b - a, 0)
            out = 2 * out + one
            low, high = np.where(one, zeros + low - a, a), np.where(one, zeros + high - b, b)
        return out


def find_runs(code: np.ndarray, sizes: np.ndarray, least: int = 6, repeats: int = 4) -> np.ndarray:
    """All runs of the texts whose words are numbered in `code`, one text after the other, `sizes` words each.

    Columns: text, first word, length, smallest period; ascending by text, first word and period. A run is at least
    `least` words and `repeats` (4 or more) periods long and can't be made longer on either side.
    """
    if repeats < 4:
        raise ValueError("blocks are sure to meet runs of four periods or more only")
    n = len(code)
    stop = np.cumsum(sizes)
    text = np.repeat(np.arange(len(sizes)), sizes)
    start, end = (stop - sizes)[text], stop[text]
    if not n:
        return np.zeros((0, 4), np.int64)
    ranks = SuffixRanks(code, text, end)
    tree = WaveletTree((np.arange(n) - start)[ranks.order])
    left, period = [], []
    for k, (rank, rows) in enumerate(zip(ranks.rank, ranks.rows)):
        size = 1 << k
        block = np.flatnonzero((rows > 1) & ((np.arange(n) - start) % size == 0) & (np.arange(n) + size <= end))
        low, own = rank[block].astype(np.int64), block - start[block]
        high = low + rows[block]
        at = tree.smaller(low, high, own)
        for step in (1, -1):
            there = (at + step >= 0) & (at + step < high - low)
            other = tree.nth(low[there], high[there], at[there] + step)
            gap = np.abs(other - own[there])
            near = (gap <= size) & (2 * gap > size)
            left.append(block[there][near] - (gap[near] if step < 0 else 0))
            period.append(gap[near])
    left, period = np.concatenate(left), np.concatenate(period)
    first = left - ranks.shared(left, left + period, back=True)
    length = left - first + period + ranks.shared(left, left + period, back=False)
    long = length >= np.maximum(least, repeats * period)
    first, length, period = first[long], length[long], period[long]
    order = np.lexsort((period, length, first))
    first, length, period = first[order], length[order], period[order]
    # Blocks of one run find the same stretch; its smallest period comes first.
    new = np.append(True, (first[1:] != first[:-1]) | (length[1:] != length[:-1])) if len(first) else np.zeros(0, bool)
    first, length, period = first[new], length[new], period[new]
    order = np.lexsort((period, first))
    first, length, period = first[order], length[order], period[order]
    return np.column_stack([text[first], first - start[first], length, period])


RUNS_SCHEMA = "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def with_runs(docs: DataFrame, text: str = "text", least: int = 6, repeats: int = 4) -> DataFrame:
    """The columns of `docs` with `n_words`, `runs` (`start`, `length`, `period` in words, by start and period) and
    `collapsed`: the words that no run holds after its first period, joined by blanks.

    Words are runs of bytes without ASCII white space, compared as they are. A null or empty text has no words, no runs
    and an empty `collapsed`. Every row is taken for itself, so repeated rows repeat their results; an empty table stays
    empty. A column of `docs` with the name of a result gives way to it. Memory follows the longest text, some
    100 bytes a word and level.
    """
    kept = [c for c in docs.columns if c not in ("n_words", "runs", "collapsed")]
    column = f"c{kept.index(text)}"

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, column, SLICE_BYTES):
            words = [t.split() for t in texts(part, column)]
            sizes = np.array([len(w) for w in words], np.int64)
            code = pa.array(chain.from_iterable(words), pa.binary()).dictionary_encode().indices.to_numpy().astype(np.int64)
            runs = find_runs(code, sizes, least, repeats)
            bounds = np.searchsorted(runs[:, 0], np.arange(len(words) + 1))
            collapsed = []
            for k, own in enumerate(words):
                mine = runs[bounds[k] : bounds[k + 1]]
                if len(mine):
                    change = np.zeros(len(own) + 1, np.int64)
                    np.add.at(change, mine[:, 1] + mine[:, 3], 1)
                    np.add.at(change, mine[:, 1] + mine[:, 2], -1)
                    own = [own[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)]
                collapsed.append(b" ".join(own))
            fields = [pa.array(runs[:, c], pa.int64()) for c in (1, 2, 3)]
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.StructArray.from_arrays(fields, ["start", "length", "period"]))
            columns = [*part.columns, pa.array(sizes), lists, pa.array(collapsed, pa.binary()).cast(pa.string())]
            yield pa.record_batch(columns, [*part.schema.names, "n_words", "runs", "collapsed"])

    return map_rows(docs, kept, found, RUNS_SCHEMA)


def planted(docs: DataFrame) -> DataFrame:
    """`doc_id`, `text`, with the words of every tenth document (by crc32 of its id) made periodic from some word on.

    With h that crc32, g = floor(h / 10) and n words: from word a = g % n on, word i becomes word a + (i - a) % p,
    p = 1 + floor((n - a) / (3 + g % 8)).
    """
    words = F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = docs.select("doc_id", "text", h.alias("h")).withColumn("g", F.expr("h div 10"))
    chosen = F.when(F.col("h") % 10 == 0, words)
    rows = rows.withColumn("words", chosen).withColumn("n", F.size("words").cast("long"))
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    rows = rows.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    periodic = F.expr(
        "array_join(transform(words, (w, i) -> if(i < a, w, element_at(words, cast(1 + a + (i - a) % p as int)))), ' ')"
    )
    return rows.select("doc_id", F.when(F.col("n") > 0, periodic).otherwise(F.col("text")).alias("text"))


def runs_table(docs: DataFrame) -> DataFrame:
    """Digests of the runs and of the collapsed text of every document, after `planted`; see the query's contract."""
    rows = with_runs(planted(docs))
    # Runs come by start and period, so the first of equal exponents stays. Products of two positions fit 64 bits.
    best = F.expr(
        "reduce(runs, cast(null as struct<start:bigint,length:bigint,period:bigint>), (a, r) ->"
        " if(a is null or r.length * a.period > a.length * r.period, r, a))"
    )
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')")
    return rows.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *(F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")),
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
        "n_words",
    )


# DuckDB: all pairs of equal words at a distance of q, joined to stretches. crc32 is worked out bit by bit.
RUNS_SQL = r"""
WITH steps AS (
    SELECT list(list_reduce([n] || range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)
                ORDER BY n) AS t
    FROM (SELECT unnest(range(256)) AS n)),
hashed AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
           xor(list_reduce([4294967295] || list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
                           lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h
    FROM documents, steps),
placed AS (SELECT *, len(w) AS n, h // 10 AS g FROM hashed),
period AS (SELECT *, g % n AS a, 1 + (n - g % n) // (3 + g % 8) AS p FROM placed WHERE n > 0),
words AS (
    SELECT doc_id, n, i, CASE WHEN h % 10 = 0 AND i >= a THEN w[a + (i - a) % p + 1] ELSE w[i + 1] END AS word
    FROM (SELECT *, unnest(range(n)) AS i FROM period)),
same AS (
    SELECT x.doc_id, y.i - x.i AS q, x.i
    FROM words x JOIN words y ON y.doc_id = x.doc_id AND y.word = x.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
stretches AS (
    SELECT doc_id, q, min(i) AS start, count(*) + q AS length
    FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM same)
    GROUP BY doc_id, q, k HAVING count(*) + q >= greatest(6, 4 * q)),
runs AS (SELECT doc_id, start, length, min(q) AS period FROM stretches GROUP BY doc_id, start, length),
lines AS (
    SELECT doc_id, count(*) AS n_runs,
           sha256(string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period)) AS runs_sha256
    FROM runs GROUP BY doc_id),
best AS (
    SELECT * FROM runs
    QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length::DOUBLE / period DESC, start, period) = 1),
dropped AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
collapsed AS (
    SELECT doc_id, sha256(string_agg(word, ' ' ORDER BY i)) AS collapsed_sha256
    FROM words ANTI JOIN dropped USING (doc_id, i) GROUP BY doc_id)
SELECT p.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, b.start::BIGINT AS start, b.length::BIGINT AS length,
       b.period::BIGINT AS period, (1000 * b.length // b.period)::BIGINT AS exponent_milli,
       coalesce(runs_sha256, sha256('')) AS runs_sha256, coalesce(collapsed_sha256, sha256('')) AS collapsed_sha256,
       n::BIGINT AS n_words
FROM placed p LEFT JOIN lines USING (doc_id) LEFT JOIN best b USING (doc_id) LEFT JOIN collapsed USING (doc_id)
"""
