"""Phrases that occur together: n-grams counted by an FM-index per shard of text, summed and scored by Spark.

A shard is the texts of one language within some megabytes of a partition. Its words become numbers; two suffix orders,
of the shard and of the shard read backwards, carry Burrows-Wheeler transforms whose occurrence lists extend a phrase by
one word on either side. One pass over the table counts phrases of one length. A phrase can only be frequent if the
phrases one word shorter within it are, so each pass counts nothing but phrases whose parts the pass before kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from burnish.llm.common import mix, saved, slices
from burnish.operators.ranking import ranked
from burnish.operators.skew import join_without_hot_tasks

SHARD_BYTES = 8 << 20
# Bits of the filter of frequent phrases that goes to all tasks, at most, and bits a phrase. A full filter lets more
# phrases be counted; it never loses one.
FILTER_BITS = 1 << 27
BITS_A_PHRASE = 16
CHUNK = 1 << 19
PROBES = 3
NO_LANGUAGE = "und"

_U = np.uint64
_STEPS = np.random.default_rng(23).integers(0, 2**64, 64, dtype=_U) | _U(1)
# Ends of pieces become a byte that UTF-8 doesn't have, A-Z lower case, tabs blanks.
_END = b"\xff"
_TABLE = bytearray(range(256))
for _c in b".,;:!?\n\x0b\x0c\r":
    _TABLE[_c] = 0xFF
_TABLE[0x09] = 0x20
_TABLE[65:91] = _TABLE[97:123]
_TABLE = bytes(_TABLE)


def coded_words(texts: list[bytes | None]) -> tuple[np.ndarray, pa.Array]:
    """Numbers of all words of `texts` in a row, 0 at the end of each piece, and the distinct words by number - 1."""
    whole = _END.join([b"", *(x or b"" for x in texts), b""]).translate(_TABLE)
    coded = pa.array(whole.replace(_END, b" \xff ").split(), pa.binary()).dictionary_encode()
    number = np.arange(1, len(coded.dictionary) + 1, dtype=np.int64)
    ends = np.flatnonzero(pc.equal(coded.dictionary, pa.scalar(_END, pa.binary())).to_numpy(zero_copy_only=False))
    number[ends[0]] = 0
    number[ends[0] + 1 :] -= 1
    words = pa.concat_arrays([coded.dictionary[: ends[0]], coded.dictionary[ends[0] + 1 :]])
    return number[coded.indices.to_numpy()], words


def phrase_hash(parts: list[np.ndarray]) -> np.ndarray:
    """Hash of phrases from the hashes of their words, one array per place."""
    return mix(sum(h * _STEPS[k] for k, h in enumerate(parts)) + _U(len(parts)))


def word_hashes(words: pa.Array, lang: str) -> np.ndarray:
    """One hash per word, the language within it; at 0 that of the end of a piece."""
    seed = xxhash.xxh64_intdigest(lang)
    return np.array([0, *(xxhash.xxh64_intdigest(w, seed) for w in words.to_pylist())], _U)


class Filter:
    """Bits of frequent phrases: knows all of them, and some more."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.size = bits, len(bits) * 8

    @staticmethod
    def places(value: np.ndarray, size: int) -> list[np.ndarray]:
        return [mix(value + _STEPS[32 + k]) % _U(size) for k in range(PROBES)]

    def has(self, value: np.ndarray) -> np.ndarray:
        found = np.ones(len(value), dtype=bool)
        for at in self.places(value, self.size):
            found &= (self.bits[at >> _U(3)] >> (at & _U(7)).astype(np.uint8) & 1).astype(bool)
        return found


@dataclass
class Intervals:
    """Phrases of one depth: where their rows begin in both orders, how many there are, and where one occurs."""

    forward: np.ndarray
    backward: np.ndarray
    size: np.ndarray
    at: np.ndarray  # position of the first word of one occurrence
    depth: int

    def take(self, keep: np.ndarray) -> Intervals:
        return Intervals(self.forward[keep], self.backward[keep], self.size[keep], self.at[keep], self.depth)


class FMIndex:
    """Depth-limited FM-index of numbers, 0 being the end of a piece, for extension on both sides.

    `forward` orders positions by the `depth` words from them on, its transform is the word before; `backward` orders
    them by the words up to them, last one first, its transform is the word after. Equal contexts keep any order: rows
    of phrases up to `depth` words are whole intervals all the same.
    """

    def __init__(self, text: np.ndarray, depth: int):
        self.text, self.depth = text, depth
        self.alphabet = int(text.max(initial=0)) + 1
        self.forward = self._order(text)
        self.backward = len(text) - 1 - self._order(text[::-1])
        around = np.concatenate([[0], text, [0]])
        self.before, self.after = around[self.forward], around[self.backward + 2]
        # Occurrence lists of the transforms: rows by symbol, each list ascending.
        row = np.arange(len(text))
        self.before_rows = np.sort(self.before * len(text) + row)
        self.after_rows = np.sort(self.after * len(text) + row)

    def _order(self, text: np.ndarray) -> np.ndarray:
        """Positions by the words that follow, by doubling the compared length."""
        rank, known = text.astype(np.int64), 1
        while known < self.depth:
            more = min(known, self.depth - known)
            later = np.zeros(len(rank), np.int64)
            later[: len(rank) - more] = rank[more:] + 1
            rank = rank * (int(later.max(initial=0)) + 1) + later
            known += more
            if known < self.depth:
                rank = np.unique(rank, return_inverse=True)[1]
        return np.argsort(rank)

    def words(self) -> Intervals:
        """All phrases of one word."""
        count = np.bincount(self.text, minlength=self.alphabet)
        start = np.cumsum(count) - count
        there = np.flatnonzero(count[1:]) + 1
        return Intervals(start[there], start[there], count[there], self.forward[start[there]], 1)

    def extend(self, known: Intervals, right: bool) -> Intervals:
        """All phrases that `known` become by one more word on one side. The end of a piece is no word."""
        symbols, rows = (self.after, self.after_rows) if right else (self.before, self.before_rows)
        lead, other = (known.backward, known.forward) if right else (known.forward, known.backward)
        of = np.repeat(np.arange(len(known.size)), known.size)
        row = np.arange(len(of)) - np.repeat(np.cumsum(known.size) - known.size, known.size) + lead[of]
        pair, count = np.unique(of * self.alphabet + symbols[row], return_counts=True)
        of, symbol = pair // self.alphabet, pair % self.alphabet
        # The rows of the smaller symbols of an interval come before in the other order.
        smaller = np.cumsum(count) - count
        first = np.searchsorted(of, np.arange(len(known.size)))
        smaller = smaller - smaller[np.minimum(first, max(len(of) - 1, 0))][of] if len(of) else smaller
        # Backward search: the rows of a symbol in front of the interval, after those of all smaller symbols.
        moved = np.searchsorted(rows, symbol * len(self.text) + lead[of])
        order = self.backward if right else self.forward
        at = order[np.minimum(moved, len(order) - 1)] - (known.depth if right else 0)
        new = (moved, other[of] + smaller)
        out = Intervals(new[1] if right else new[0], new[0] if right else new[1], count, at, known.depth + 1)
        return out.take(symbol > 0)

    def neighbours(self, known: Intervals, right: bool) -> np.ndarray:
        """How many occurrences of each phrase have a word on that side."""
        inner = np.append(0, np.cumsum((self.after if right else self.before) > 0))
        start = known.backward if right else known.forward
        return inner[start + known.size] - inner[start]


def cut_to(text: np.ndarray, keep: np.ndarray) -> np.ndarray:
    """The kept positions, with one end of a piece where others were."""
    text = np.where(keep, text, 0)
    return text[(text > 0) | np.append(True, text[:-1] > 0)]


def shard_phrases(
    text: np.ndarray, hashes: np.ndarray, depth: int, known: Filter | None, sides: bool = False
) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Words (an array per place) and counts of the phrases of `depth` words in a shard; with `sides`, also how many
    occurrences have a neighbour on the left, and on the right.

    `known` has the frequent phrases of `depth - 1` words: positions outside phrases that could be frequent are cut
    away first, and extensions whose parts it lacks are dropped.
    """

    def parts(at: np.ndarray, n: int) -> list[np.ndarray]:
        return [hashes[text[at + k]] for k in range(n)]

    n = len(text)
    if known is not None and depth == 2:
        text = cut_to(text, known.has(phrase_hash([hashes]))[text])
    elif known is not None:
        short = depth - 1
        full = text > 0
        for k in range(1, short):
            full[: n - k] &= text[k:] > 0
        full[n - short + 1 :] = False
        starts = np.flatnonzero(full)
        here = np.zeros(n + 1, dtype=bool)
        here[starts[known.has(phrase_hash(parts(starts, short)))]] = True
        here = here[:-1] & here[1:]
        keep = here.copy()
        for k in range(1, depth):
            keep[k:] |= here[: n - k]
        text = cut_to(text, keep)
    empty = np.zeros(0, np.int64)
    if not text.any():
        return [empty] * depth, [empty] * (3 if sides else 1)
    # Numbers without gaps keep the occurrence lists small.
    present, text_small = np.unique(np.append(0, text), return_inverse=True)
    index = FMIndex(text_small[1:], depth)
    hashes, text = hashes[present], index.text
    found = index.words()
    for k in range(2, depth + 1):
        found = index.extend(found, right=k % 2 == 0)
    if known is not None and len(found.size):
        ok = known.has(phrase_hash(parts(found.at, depth - 1))) & known.has(phrase_hash(parts(found.at + 1, depth - 1)))
        found = found.take(ok)
    words = [present[text[found.at + k]] for k in range(depth)]
    return words, [found.size, *(index.neighbours(found, right) for right in (False, True) if sides)]


BATCH_ROWS = 1 << 17


def phrase_counts(
    docs: DataFrame, depth: int, known: Filter | None, shard_bytes: int = SHARD_BYTES, sides: bool = False
) -> DataFrame:
    """`lang`, `phrase`, `count` of the phrases of `depth` words, summed over all shards.

    For one word, the row of the empty phrase has the number of all words. With `sides`, `left` and `right` are the
    occurrences that have a word before and after them within their piece. `docs` has `lang` (null: `und`) and `text`
    (null: empty).
    """
    shared = docs.sparkSession.sparkContext.broadcast(known.bits if known else None)
    numbers = ["count", "left", "right"] if sides else ["count"]

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if shared.value is None else Filter(shared.value)
        held, size = {}, 0

        def closed():
            while held:
                lang, texts = held.popitem()
                text, words = coded_words(texts)
                del texts
                if depth == 1:
                    count = np.bincount(text, minlength=len(words) + 1)[1:]
                    column = pa.concat_arrays([pa.array([b""], pa.binary()), words])
                    values = [np.append(count.sum(), count)] + [np.zeros(len(count) + 1, np.int64)] * (len(numbers) - 1)
                else:
                    hashes = word_hashes(words, lang)
                    places, values = shard_phrases(text, hashes, depth, bits, sides)
                    del text, hashes
                    column = pc.binary_join_element_wise(*(words.take(pa.array(p - 1)) for p in places), b" ")
                for k in range(0, len(column), BATCH_ROWS):
                    part = column[k : k + BATCH_ROWS].cast(pa.string())
                    parts = [pa.array(v[k : k + BATCH_ROWS], pa.int64()) for v in values]
                    yield pa.record_batch([pa.repeat(lang, len(part)), part, *parts], ["lang", "phrase", *numbers])

        for part in slices(batches, limit=2 << 20):
            for lang, text in zip(part.column(0).to_pylist(), part.column(1).cast(pa.large_binary()).to_pylist()):
                if text:
                    held.setdefault(lang, []).append(text)
                    size += len(text)
            if size >= shard_bytes:
                yield from closed()
                size = 0
        yield from closed()

    schema = "lang string, phrase string, " + ", ".join(f"{c} long" for c in numbers)
    shards = docs.select(F.coalesce("lang", F.lit(NO_LANGUAGE)).alias("lang"), "text").mapInArrow(counted, schema)
    return shards.groupBy("lang", "phrase").agg(*(F.sum(c).alias(c) for c in numbers))


def frequent_filter(frequent: DataFrame, rows: int) -> Filter:
    """The filter of the phrases of `frequent` (`rows` of them); its size is bounded by `FILTER_BITS`."""
    size = min(FILTER_BITS, max(CHUNK, 1 << (rows * BITS_A_PHRASE).bit_length()))

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(size, dtype=bool)
        seeds = {}
        for batch in batches:
            value = []
            for lang, phrase in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                if lang not in seeds:
                    seeds[lang] = xxhash.xxh64_intdigest(lang)
                value.append([xxhash.xxh64_intdigest(w, seeds[lang]) for w in phrase.split(b" ")])
            if value:
                hashed = phrase_hash(list(np.array(value, _U).T))
                for at in Filter.places(hashed, size):
                    bits[at.astype(np.int64)] = True
        for k in range(0, size, CHUNK):
            if bits[k : k + CHUNK].any():
                packed = np.packbits(bits[k : k + CHUNK], bitorder="little")
                yield pa.record_batch([pa.array([k // CHUNK], pa.int32()), pa.array([packed.tobytes()])], ["chunk", "bits"])

    def merged(key: tuple[Any, ...], chunks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whole = np.zeros(CHUNK // 8, np.uint8)
        for chunk in chunks:
            for bits in chunk["bits"]:
                whole |= np.frombuffer(bits, np.uint8)
        yield pd.DataFrame({"chunk": [key[0]], "bits": [whole.tobytes()]})

    chunks = frequent.select("lang", "phrase").mapInArrow(marked, "chunk int, bits binary")
    out = np.zeros(size // 8, np.uint8)
    # At most FILTER_BITS / CHUNK rows.
    for row in chunks.groupBy("chunk").applyInPandas(merged, "chunk int, bits binary").collect():
        out[row.chunk * (CHUNK // 8) :][: CHUNK // 8] = np.frombuffer(row.bits, np.uint8)
    return Filter(out)


def frequent_phrases(
    docs: DataFrame, longest: int = 4, minimum: int = 30, sides: bool = False
) -> tuple[DataFrame, DataFrame]:
    """`lang`, `phrase`, `depth`, `count` (and `left`, `right`, of phrases of two words and more, with `sides`) of all
    phrases of 1 to `longest` words that occur `minimum` times in their language, and `lang`, `n`, the number of words
    of each language.

    Overlapping occurrences count. Texts without words and empty tables give no rows.
    """
    first = saved(phrase_counts(docs, 1, None, sides=sides).where((F.col("count") >= minimum) | (F.col("phrase") == "")))
    totals = first.where("phrase = ''").select("lang", F.col("count").alias("n"))
    level = first.where("phrase <> ''")
    out = level.withColumn("depth", F.lit(1))
    for depth in range(2, longest + 1):
        rows = level.count()
        if not rows:
            break
        counts = phrase_counts(docs, depth, frequent_filter(level, rows), sides=sides)
        level = saved(counts.where(F.col("count") >= minimum))
        out = out.unionByName(level.withColumn("depth", F.lit(depth)))
    return out, totals


def _exact(x: Column) -> Column:
    return x.cast("decimal(38,0)")


def collocations(
    docs: DataFrame, longest: int = 4, minimum: int = 30, top: int = 2000, absorb: tuple[int, int] = (80, 100)
) -> DataFrame:
    """The best phrases of 2 to `longest` words per language: `lang`, `rank`, `phrase`, `a`, `l`, `r`, `n`, `score`.

    Texts (null: empty) are put in lower case (A-Z), cut at `.,;:!?` and line ends and then at blanks and tabs; a phrase
    lies within a piece. `a` counts it (at least `minimum`), `l` and `r` count the parts of its worst cut, the one of
    the lowest score, the first of such: floor(2000000 a / (l + r)). A phrase is left out if a longer candidate that
    contains it has at least 80 of 100 of its occurrences. `n` counts all words of the language (null: `und`). Ranks go
    by score and count, then phrase. Repeated rows count each; other columns are left aside; an empty table has no rows.
    """
    found, totals = frequent_phrases(docs, longest, minimum)
    whole = F.struct("lang", "phrase")
    candidates = found.where("depth > 1").select("lang", "phrase", F.col("count").alias("a"), "depth")
    words = F.split("phrase", " ")

    # The counts of both parts of every cut; hot parts are dealt out by the helper.
    parts = found.where(F.col("depth") < longest).select(whole.alias("part"), F.col("count").alias("f"))
    cuts = candidates.select("*", F.explode(F.sequence(F.lit(1), F.col("depth") - 1)).alias("k"))
    cuts = cuts.withColumn("first", F.struct("lang", F.array_join(F.slice(words, F.lit(1), F.col("k")), " ").alias("phrase")))
    cuts = cuts.withColumn("rest", F.struct("lang", F.array_join(F.slice(words, F.col("k") + 1, F.col("depth") - F.col("k")), " ").alias("phrase")))
    cuts = saved(cuts)
    with_left = join_without_hot_tasks(cuts, parts.withColumnRenamed("f", "l"), "first", "part", "inner", min_rows=100_000)
    with_both = join_without_hot_tasks(saved(with_left.drop("first")), parts.withColumnRenamed("f", "r"), "rest", "part", "inner", min_rows=100_000)
    # `div` of decimals is exact; products of counts may pass 64 bits.
    both = with_both.withColumn("total", _exact(F.col("l")) + _exact(F.col("r"))).withColumn("scaled", _exact(F.col("a")) * F.lit(2_000_000).cast("decimal(7,0)"))
    worst = (
        both.withColumn("score", F.expr("scaled div total"))
        .groupBy("lang", "phrase", "a")
        .agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
        .select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    )

    inside = F.expr(
        "flatten(transform(sequence(2, depth - 1), n -> transform(sequence(1, depth - n + 1), i ->"
        " array_join(slice(split(phrase, ' '), i, n), ' '))))"
    )
    longer = candidates.where("depth > 2").select("lang", "a", F.explode(F.array_distinct(inside)).alias("phrase"))
    most = longer.groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    share, of = absorb
    absorbed = _exact(F.col("most")) * F.lit(of) >= _exact(F.col("a")) * F.lit(share)
    kept = worst.join(most, ["lang", "phrase"], "left").where(~F.coalesce(absorbed, F.lit(False))).drop("most")

    best = ranked(kept, ["lang"], [F.desc("score"), F.desc("a"), "phrase"], "rank", top)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


# DuckDB: the same phrases, all n-grams counted as they are.
COLLOCATIONS_SQL = r"""
WITH pieces AS (
    SELECT row_number() OVER () AS piece, lang, words FROM (
        SELECT coalesce(lang, 'und') AS lang,
               regexp_extract_all(unnest(regexp_split_to_array(
                   translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[.,;:!?\n\x0B\x0C\r]')), '[^ \t]+') AS words
        FROM documents WHERE text IS NOT NULL)
    WHERE len(words) > 0),
grams AS (
    SELECT lang, d AS depth, array_to_string(words[i:i + d - 1], ' ') AS phrase
    FROM (SELECT lang, words, d, unnest(range(1, len(words) - d + 2)) AS i
          FROM pieces, (SELECT unnest(range(1, 5)) AS d) WHERE len(words) >= d)),
f AS (SELECT lang, depth, phrase, count(*)::BIGINT AS f FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE depth = 1 GROUP BY lang),
cand AS (SELECT lang, depth, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE depth > 1 AND f >= 30),
cuts AS (
    SELECT c.lang, c.phrase, c.depth, c.a, c.k, l.f AS l, r.f AS r,
           (2000000::HUGEINT * c.a) // (l.f::HUGEINT + r.f) AS score
    FROM (SELECT *, unnest(range(1, depth)) AS k FROM cand) c
    JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:c.k], ' ')
    JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[c.k + 1:c.depth], ' ')),
worst AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_parts AS (
    SELECT lang, a, array_to_string(w[i:i + n - 1], ' ') AS phrase
    FROM (SELECT lang, a, w, depth, n, unnest(range(1, depth - n + 2)) AS i
          FROM (SELECT *, unnest(range(2, depth)) AS n FROM cand WHERE depth > 2))),
most AS (SELECT lang, phrase, max(a) AS most FROM inner_parts GROUP BY lang, phrase),
kept AS (
    SELECT w.* FROM worst w LEFT JOIN most m ON m.lang = w.lang AND m.phrase = w.phrase
    WHERE m.most IS NULL OR 100::HUGEINT * m.most < 80::HUGEINT * w.a),
best AS (
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, score
    FROM kept)
SELECT best.lang, rank::BIGINT AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM best JOIN totals ON totals.lang = best.lang WHERE rank <= 2000
"""
