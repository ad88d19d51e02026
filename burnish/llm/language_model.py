"""Language-model scoring: interpolated modified Kneser-Ney over word pairs or triples.

Spark counts the n-grams of the highest order; the distinct words in front of an n-gram are the count of what is left of
it. The model is kept as sorted hash arrays in files of the shared folder, which the scoring tasks map into memory.
"""

from __future__ import annotations

import math
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from burnish.llm.common import held, local_path, map_rows, mix, remainder, saved, shared_dir, slices, texts, words

U = np.uint64
START, END = U(1), U(2)  # words are known by 64 bits of a hash
TASK_TOKENS = 1_500_000  # tokens that a counting task sums up before it sends
BUCKET_BYTES = 8 << 20  # text for each bucket of pairs
ORDER = 2  # words of the longest n-gram unless asked otherwise; triples take several times the disk
MANY = 255  # counts from here on are kept apart
SPREAD = 16  # buckets over which the pairs of one first word are dealt out


def tokens(docs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The word two places before, the word before, the word and the document of every token: the words of each
    document, then its end. Starts stand in front of a document."""
    value, doc = words(docs)
    value = np.maximum(value, U(3))
    count = np.bincount(doc, minlength=len(docs)).astype(np.int64)
    after = np.cumsum(count)
    word = np.insert(value, after, END)
    first = np.cumsum(count + 1) - count - 1
    context = np.append(START, word[:-1])[: len(word)]
    context[first] = START
    earlier = np.append(START, context[:-1])[: len(word)]
    earlier[first] = START
    return earlier, context, word, np.repeat(np.arange(len(docs)), count + 1)


def bucket_of(context: np.ndarray, word: np.ndarray, buckets: int) -> np.ndarray:
    return ((mix(context) >> U(20)) + (mix(word) >> U(20)) % U(SPREAD)) % U(buckets)


def pair_key(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(context * U(0x9E3779B97F4A7C15) + word)


def summed(keys: list[np.ndarray], values: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Distinct rows of `keys` in ascending order, with their sums of each of `values`."""
    order = np.lexsort(keys[::-1])
    keys = [k[order] for k in keys]
    new = np.ones(len(order), dtype=bool)
    if len(order):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    start = np.flatnonzero(new)
    return [k[start] for k in keys], [np.add.reduceat(v[order], start) if len(start) else v[:0] for v in values]


def pack(keys: np.ndarray) -> bytes:
    return keys.astype("<u8").tobytes()


def unpack(blobs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), "<u8")


def pack_counts(counts: np.ndarray) -> bytes:
    """Counts of any size: a byte each, and those that a byte doesn't hold as 64-bit numbers after all bytes."""
    many = counts >= MANY
    return np.where(many, MANY, counts).astype(np.uint8).tobytes() + counts[many].astype("<u8").tobytes()


def unpack_counts(blobs: list[bytes], sizes: list[int]) -> np.ndarray:
    """The counts of several blobs in a row; `sizes` tells how many each one holds."""
    out = []
    for blob, n in zip(blobs, sizes):
        counts = np.frombuffer(blob, np.uint8, n).astype(U)
        counts[counts == MANY] = np.frombuffer(blob, "<u8", offset=n)
        out.append(counts)
    return np.concatenate([np.zeros(0, U), *out])


def write_arrays(folder: str, name: str, arrays: list[np.ndarray]) -> None:
    """One file: number and types of the arrays, then the arrays. It appears under its name whole."""
    os.makedirs(folder, exist_ok=True)
    own = f"{folder}/{name}.{TaskContext.get().taskAttemptId()}.tmp"
    with open(own, "wb") as out:
        head = [len(arrays)] + [x for a in arrays for x in (len(a), a.dtype.itemsize)]
        out.write(np.array(head + [0] * (32 - len(head)), "<i8").tobytes())
        for a in arrays:
            out.write(a.astype(f"<u{a.dtype.itemsize}").tobytes())
            out.write(b"\0" * (-a.nbytes % 8))
    os.replace(own, f"{folder}/{name}")


def map_arrays(path: str) -> list[np.ndarray]:
    """The arrays of `write_arrays`, mapped into memory."""
    raw = np.memmap(path, np.uint8, "r")
    head = raw[:256].view("<i8")
    out, at = [], 256
    for k in range(int(head[0])):
        n, size = int(head[1 + 2 * k]), int(head[2 + 2 * k])
        out.append(raw[at : at + n * size].view(f"<u{size}"))
        at += n * size + (-n * size % 8)
    return out


def cut_by(bucket: np.ndarray, arrays: list[np.ndarray]) -> tuple[list[int], list[list[np.ndarray]]]:
    """The buckets that occur, and the rows of each array by bucket."""
    order = np.argsort(bucket, kind="stable")
    bucket, arrays = bucket[order], [a[order] for a in arrays]
    edge = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist(), len(bucket)]
    spans = [(x, y) for x, y in zip(edge, edge[1:]) if y > x]
    return [int(bucket[x]) for x, _ in spans], [[a[x:y] for x, y in spans] for a in arrays]


def home_of(key: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(key) >> U(13)) % U(buckets)


def gram_blobs(docs: DataFrame, order: int, buckets: int) -> DataFrame:
    """The pairs or triples that a task has counted, by bucket: `context`, `word` (64 bits each) and `count`; for triples
    the context is a hash of two words, and `middle` the second one."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def send() -> pa.RecordBatch:
            keys, (n,) = summed([np.concatenate(k) for k in zip(*held)], [np.ones(size, U)])
            which, (first, *rest) = cut_by(bucket_of(keys[0], keys[-1], buckets), [*keys, n])
            rest, counts = rest[:-1], rest[-1]
            columns = [pa.array(which, pa.int64())]
            columns += [pa.array([pack(x) for x in k], pa.binary()) for k in (first, *rest)]
            columns.append(pa.array([pack_counts(x) for x in counts], pa.binary()))
            return pa.record_batch(columns, names)

        for part in slices(batches):
            earlier, context, word, _ = tokens(texts(part))
            held.append([context, word] if order == 2 else [pair_key(earlier, context), context, word])
            size += len(word)
            if size >= TASK_TOKENS:
                yield send()
                held, size = [], 0
        if size:
            yield send()

    names = ["bucket", "context", *(["middle"] if order == 3 else []), "word", "count"]
    schema = ", ".join(f"{c} {'long' if c == 'bucket' else 'binary'}" for c in names)
    return docs.select("text").mapInArrow(counted, schema)


FIGURES = ["total", "one", "two", "more", "ends", "seen"]
SUMS_SCHEMA = "level int, bucket long, context binary, key binary, " + ", ".join(f"{c} binary" for c in FIGURES)
SUMS_SCHEMA += ", n1 long, n2 long, n3 long, n4 long"


def sums_of(level: int, bucket: np.ndarray, context: np.ndarray | None, key: np.ndarray, figures: dict[str, np.ndarray]) -> pd.DataFrame:
    """Rows of SUMS_SCHEMA: figures of words, contexts or pairs, by the bucket that they go to."""
    names = [*figures]
    which, parts = cut_by(bucket, [key, *figures.values(), *([] if context is None else [context])])
    out = {"level": [level] * len(which), "bucket": which, "key": [pack(x) for x in parts[0]]}
    out["context"] = [None] * len(which) if context is None else [pack(x) for x in parts[-1]]
    for name in FIGURES:
        out[name] = [pack_counts(x) for x in parts[1 + names.index(name)]] if name in figures else [None] * len(which)
    return pd.DataFrame(out | {f"n{k}": [0] * len(which) for k in range(1, 5)})


def begun(n: np.ndarray) -> dict[str, np.ndarray]:
    """What n-grams of count n say of their context."""
    return {"total": n, "one": (n == 1).astype(U), "two": (n == 2).astype(U), "more": (n > 2).astype(U)}


def write_grams(folder: str, name: str, context: np.ndarray, word: np.ndarray, n: np.ndarray) -> None:
    """Keys of the n-grams that were counted once, keys and counts of the others."""
    key = pair_key(context, word)
    order = np.argsort(key)
    key, count = key[order], n[order]
    one = count == 1
    write_arrays(folder, name, [key[one], key[~one], count[~one]])


def columns_of(rows: pd.DataFrame, keys: list[str], figures: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Keys and figures of blobs; figures that a row leaves out are 0."""
    sizes = [len(x) // 8 for x in rows[keys[0]]]
    values = [
        np.concatenate([np.zeros(0, U), *(np.zeros(n, U) if x is None else unpack_counts([x], [n]) for x, n in zip(rows[f], sizes))])
        for f in figures
    ]
    return [unpack(rows[k].tolist()) for k in keys], values


def first_of(out: list[pd.DataFrame], n: np.ndarray) -> pd.DataFrame:
    """All rows; the first one has the numbers of the bucket's n-grams by their count."""
    rows = pd.concat(out, ignore_index=True)
    for k in range(1, 5):
        rows.loc[0, f"n{k}"] = int((n == k).sum())
    return rows


def count_triples(blobs: DataFrame, buckets: int, folder: str) -> DataFrame:
    """Write the triples of each bucket; hand on figures of their contexts (level 3), the pairs that end them, once for
    each distinct triple (level 2), and occurrences of single words (level 1)."""

    def merged(rows: pd.DataFrame) -> pd.DataFrame:
        keys, values = columns_of(rows, ["context", "middle", "word"], ["count"])
        (context, middle, word), (n,) = summed(keys, values)
        write_grams(folder, f"triples-{int(rows['bucket'].iloc[0])}", context, word, n)
        (own,), sums = summed([context], [*begun(n).values()])
        out = [sums_of(3, home_of(own, buckets), None, own, dict(zip(begun(n), sums)))]
        (a, b), (once,) = summed([middle, word], [np.ones(len(n), U)])
        out.append(sums_of(2, bucket_of(a, b, buckets), a, b, {"total": once}))
        (own,), (seen,) = summed([word], [n])
        out.append(sums_of(1, home_of(own, buckets), None, own, {"seen": seen}))
        return first_of(out, n)

    return blobs.groupBy("bucket").applyInPandas(merged, SUMS_SCHEMA)


def count_pairs(blobs: DataFrame, buckets: int, folder: str, raw: bool = True) -> DataFrame:
    """Write the pairs of each bucket; hand on what they say of single words, by the bucket of the word.

    For each word: its pairs' counts as a context (`total`), the pairs that it begins with count 1, 2 and more, those
    that it ends (`ends`) and, if the counts are `raw`, its occurrences (`seen`).
    """

    def merged(rows: pd.DataFrame) -> pd.DataFrame:
        keys, values = columns_of(rows, ["context", "word"], ["count"])
        (a, b), (n,) = summed(keys, values)
        write_grams(folder, f"pairs-{int(rows['bucket'].iloc[0])}", a, b, n)
        zero = np.zeros(len(n), U)
        begin = begun(n) | {"ends": zero, "seen": zero}
        end = dict.fromkeys(begun(n), zero) | {"ends": zero + U(1), "seen": n if raw else zero}
        (word,), sums = summed([np.concatenate([a, b])], [np.concatenate([begin[f], end[f]]) for f in FIGURES])
        return first_of([sums_of(1, home_of(word, buckets), None, word, dict(zip(FIGURES, sums)))], n)

    return blobs.groupBy("bucket").applyInPandas(merged, SUMS_SCHEMA)


def count_contexts(parts: DataFrame, folder: str) -> DataFrame:
    """Write the figures of the contexts of triples, by bucket."""
    names = FIGURES[:4]

    def merged(rows: pd.DataFrame) -> pd.DataFrame:
        (key,), sums = summed(*columns_of(rows, ["key"], names))
        write_arrays(folder, f"contexts-{int(rows['bucket'].iloc[0])}", [key, *sums])
        return pd.DataFrame({"contexts": [len(key)]})

    return parts.groupBy("bucket").applyInPandas(merged, "contexts long")


def count_words(parts: DataFrame, folder: str) -> DataFrame:
    """Write the figures of the words of each bucket. Hands on the sums over all words."""

    def merged(rows: pd.DataFrame) -> pd.DataFrame:
        (key,), sums = summed(*columns_of(rows, ["key"], FIGURES))
        write_arrays(folder, f"words-{int(rows['bucket'].iloc[0])}", [key, *sums])
        ends, seen = sums[4], sums[5]
        out = {"tokens": int(seen.sum()), "types": int((seen > 0).sum()), "pairs": int(ends.sum())}
        return pd.DataFrame([out | {f"m{k}": int((ends == k).sum()) for k in range(1, 5)} | {"m5": int((ends > 4).sum())}])

    schema = "tokens long, types long, pairs long, m1 long, m2 long, m3 long, m4 long, m5 long"
    return parts.groupBy("bucket").applyInPandas(merged, schema)


def discounts(n: list[int]) -> np.ndarray:
    """Discounts of counts 0, 1, 2 and more, from the numbers of entries that were counted 1 to 4 times."""
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.0
    out = [0.0]
    for k in (1, 2, 3):
        d = k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else 0.0
        out.append(min(max(d, 0.0), float(k)) or 0.5)
    return np.array(out)


@dataclass(frozen=True)
class Model:
    """Where a model lies, and the numbers that all tasks need."""

    folder: str
    buckets: int
    order: int = 2
    tokens: int = 0
    types: int = 0
    pairs: int = 0
    triple_counts: tuple[int, ...] = (0, 0, 0, 0)
    pair_counts: tuple[int, ...] = (0, 0, 0, 0)
    word_counts: tuple[int, ...] = (0, 0, 0, 0, 0)

    def scorer(self) -> Scorer:
        """One scorer a Python worker; it maps the files it needs."""
        return held(self, lambda: Scorer(self))


def _by_count(parts: DataFrame) -> tuple[int, ...]:
    return tuple(parts.agg(*[F.coalesce(F.sum(f"n{k}"), F.lit(0)) for k in range(1, 5)]).first())


def train(docs: DataFrame, order: int = ORDER) -> Model:
    """Count the n-grams of `docs` (`text`) up to `order`, 2 or 3, and write the model. A null text is empty, and its
    end is a token."""
    if order not in (2, 3):
        raise ValueError("the order is 2 or 3")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(8, size // BUCKET_BYTES)
    folder = local_path(shared_dir(docs.sparkSession))
    blobs, triples, extra = gram_blobs(docs, order, buckets), (0, 0, 0, 0), None
    if order == 3:
        extra = saved(count_triples(blobs, buckets, folder))
        triples = _by_count(extra)
        count_contexts(extra.where("level = 3"), folder).agg(F.sum("contexts")).collect()
        blobs = extra.where("level = 2").select("bucket", "context", F.col("key").alias("word"), F.col("total").alias("count"))
    parts = saved(count_pairs(blobs, buckets, folder, raw=order == 2))
    words = parts if extra is None else parts.unionByName(extra.where("level = 1"))
    totals = count_words(words, folder)
    t = totals.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in totals.columns]).first()
    return Model(folder, buckets, order, t[0], t[1], t[2], triples, _by_count(parts), tuple(t[3:]))


class Scorer:
    def __init__(self, model: Model):
        self.model, self.files = model, {}
        self.d3, self.d2 = discounts(list(model.triple_counts)), discounts(list(model.pair_counts))
        self.d1 = discounts(list(model.word_counts[:4]))
        m = model.word_counts
        rest = self.d1[1] * m[0] + self.d1[2] * m[1] + self.d1[3] * (m[2] + m[3] + m[4])
        self.floor = (rest / model.pairs if model.pairs else 1.0) / (model.types + 1)  # one more for unknown words

    def _file(self, name: str) -> list[np.ndarray] | None:
        if name not in self.files:
            path = f"{self.model.folder}/{name}"
            self.files[name] = map_arrays(path) if os.path.exists(path) else None
        return self.files[name]

    def _by_bucket(self, kind: str, bucket: np.ndarray, key: np.ndarray):
        order = np.lexsort((key, bucket))
        edge = np.flatnonzero(np.diff(bucket[order])) + 1
        for at in np.split(order, edge):
            if len(at) and (arrays := self._file(f"{kind}-{int(bucket[at[0]])}")) is not None:
                yield at, key[at], arrays

    def figures(self, kind: str, key: np.ndarray, rows: int) -> np.ndarray:
        """The first `rows` figures of distinct words or contexts; zeros for unknown ones."""
        out = np.zeros((rows, len(key)))
        for at, k, (keys, *values) in self._by_bucket(kind, home_of(key, self.model.buckets), key):
            place = np.minimum(np.searchsorted(keys, k), len(keys) - 1)
            hit = keys[place] == k
            for row, v in enumerate(values[:rows]):
                out[row, at[hit]] = v[place[hit]]
        return out

    def counts(self, kind: str, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        out, key = np.zeros(len(word)), pair_key(context, word)
        for at, k, (single, keys, count) in self._by_bucket(kind, bucket_of(context, word, self.model.buckets), key):
            if len(single):
                place = np.minimum(np.searchsorted(single, k), len(single) - 1)
                out[at[single[place] == k]] = 1
            if len(keys):
                place = np.minimum(np.searchsorted(keys, k), len(keys) - 1)
                hit = keys[place] == k
                out[at[hit]] = count[place[hit]]
        return out

    @staticmethod
    def interpolated(count: np.ndarray, figures: np.ndarray, d: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Discounted share of the n-gram in its context, and what the discounts leave times the lower order."""
        total, one, two, more = figures
        high = np.maximum(count - d[np.minimum(count, 3).astype(int)], 0)
        back = d[1] * one + d[2] * two + d[3] * more
        return np.where(total > 0, (high + back * low) / np.maximum(total, 1), low)

    def __call__(self, docs: list[bytes]) -> list[np.ndarray]:
        """Tokens, known tokens, base score and score of each document."""
        earlier, context, word, doc = tokens(docs)
        size, m = len(docs), self.model
        which = np.unique(np.concatenate([context, word]))
        words = self.figures("words", which, len(FIGURES))
        ends, seen = words[4], words[5]
        low = np.maximum(ends - self.d1[np.minimum(ends, 3).astype(int)], 0) / max(m.pairs, 1) + self.floor
        base = np.log10((seen + 0.5) / (m.tokens + 0.5 * (m.types + 1)))
        at, to = np.searchsorted(which, context), np.searchsorted(which, word)
        # Each distinct pair once.
        pair, of_pair = np.unique(at * len(which) + to, return_inverse=True)
        a, b = pair // max(len(which), 1), pair % max(len(which), 1)
        prob = self.interpolated(self.counts("pairs", which[a], which[b]), words[:4, a], self.d2, low[b])[of_pair]
        if m.order == 3:
            two = pair_key(earlier, context)
            own, of_own = np.unique(two, return_inverse=True)
            figures = self.figures("contexts", own, 4)[:, of_own]
            prob = self.interpolated(self.counts("triples", two, word), figures, self.d3, prob)
        return [
            np.bincount(doc, minlength=size),
            np.bincount(doc, seen[to] > 0, size).astype(np.int64),
            np.bincount(doc, base[to], size),
            np.bincount(doc, np.log10(prob), size),
        ]


def score_texts(docs: DataFrame, model: Model) -> DataFrame:
    """`docs` without `text`, with `n_tokens`, `n_known`, `base_score`, `score` and `perplexity` of the text."""
    columns = [c for c in docs.columns if c != "text"]
    names = ["n_tokens", "n_known", "base_score", "score", "perplexity"]

    at = len(columns)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        for part in slices(batches, f"c{at}", model=model):
            n, known, base, value = score(texts(part, f"c{at}"))
            numbers = [pa.array(n, pa.int64()), pa.array(known, pa.int64())]
            numbers += [pa.array(x, pa.float64()) for x in (base, value, 10 ** np.minimum(-value / n, 300))]
            yield pa.record_batch([*part.columns, *numbers], [*part.schema.names, *names])

    kinds = ("long", "long", "double", "double", "double")
    found = map_rows(docs, [*columns, "text"], scored, ", ".join(f"{n} {k}" for n, k in zip(names, kinds)))
    return found.drop("text")


def model_table(docs: DataFrame, held_out: Column | None = None, order: int = ORDER) -> DataFrame:
    """`doc_id`, `held_out`, `n_tokens`, `n_known`, `train_tokens`, `base_score`, `score`, `perplexity` of each row.

    The model learns from the rows that aren't held out. Null and empty texts have one token, their end. With nothing to
    learn from, every token has the same probability. Repeated rows are counted and scored each; an empty table gives no
    row; other columns are left aside.
    """
    out = remainder("doc_id", 5) == 1 if held_out is None else held_out
    rows = docs.select("doc_id", F.coalesce(out, F.lit(False)).alias("held_out"), "text")
    model = train(rows.where(~F.col("held_out")), order)
    scored = score_texts(rows, model).withColumn("train_tokens", F.lit(model.tokens).cast("long"))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")
