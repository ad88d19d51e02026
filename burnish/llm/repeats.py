"""Removal of repeated byte strings by suffix sorting.

A string is a repeat if it has `LENGTH` bytes and starts at two places at least. First, a filter that loses nothing:
every string has an anchor, the smallest gram hash in it, and equal strings have equal anchors. Strings whose anchor
occurs once are unique, and strings within a context (all strings of one anchor) that occurs as a whole elsewhere are
repeats. The contexts left over meet by their anchor, and a suffix array over each bucket's contexts decides: its
sampled triples are sorted, named and sorted again by their names, the remaining suffixes are merged in, and neighbours
are compared by their first bytes. An anchor with very many contexts is hot: its strings meet one by one, by their own
hashes, those whose hash occurs once left out. Statuses and results lie in sorted arrays of the shared folder, which tasks map into
memory, so texts are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burnish.llm.common import _BASE, _BYTE, local_path, mix, shared_dir, slices, texts
from burnish.llm.language_model import map_arrays, pack, summed, unpack, write_arrays

U = np.uint64
LENGTH = 200
GRAM = 64
KEY = U((1 << 64) - 1)  # bits of a hash that are kept
BUCKET_BYTES = 16 << 20  # text for each bucket
HOT_CONTEXTS = 4096  # an anchor with more different contexts (about 1 MB) is dealt out by string
SETTLED, PARTNER, OPEN, HOT = 1, 2, 3, 4  # HOT: an open context or a partner of a hot anchor


def suffix_order(s: np.ndarray) -> np.ndarray:
    """The suffixes of `s` (integers above 0) in ascending order.

    Difference cover modulo 3: suffixes at places 1 and 2 are named by their triples and ordered through the string of
    the names, the others by their first symbol and the suffix behind it, and both orders are merged.
    """
    n = len(s)
    if n < 4:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    t = np.concatenate([s, np.zeros(6, s.dtype)]).astype(np.int64)
    top = int(t.max()) + 1
    one, two = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sample = np.concatenate([one, two])
    if top < 1 << 20:
        key = (t[sample] * top + t[sample + 1]) * top + t[sample + 2]
        order = np.argsort(key, kind="stable")
        new = np.append(True, key[order][1:] != key[order][:-1])
    else:
        order = np.lexsort((t[sample + 2], t[sample + 1], t[sample]))
        three = [t[sample[order] + k] for k in range(3)]
        new = np.append(True, np.logical_or.reduce([x[1:] != x[:-1] for x in three]))
    name = np.empty(len(sample), np.int64)
    name[order] = np.cumsum(new)
    if not new.all():
        inner = suffix_order(name)
        name[inner] = np.arange(1, len(inner) + 1)
        order = inner
    rank = np.zeros(n + 8, np.int64)
    rank[sample] = name
    big = int(name.max()) + 2
    sampled = sample[order]
    sampled = sampled[sampled < n]
    zero = np.arange(0, n, 3)
    near = lambda i: t[i] * big + rank[i + 1]
    pair = lambda i: t[i] * top + t[i + 1]
    if top * top * big < 1 << 62:
        far = lambda i: pair(i) * big + rank[i + 2]
    else:  # The pairs get names, as the product of all three would pass 63 bits.
        pairs = np.unique(pair(np.arange(n)))
        far = lambda i: np.searchsorted(pairs, pair(i)) * big + rank[i + 2]
    zero = zero[np.argsort(near(zero), kind="stable")]
    first, second = sampled[sampled % 3 == 1], sampled[sampled % 3 == 2]
    place = np.arange(len(zero)) + np.searchsorted(near(first), near(zero)) + np.searchsorted(far(second), far(zero))
    out = np.empty(n, np.int64)
    rest = np.ones(n, dtype=bool)
    rest[place] = False
    out[place], out[rest] = zero, sampled
    return out


class Contexts:
    """The contexts of a batch of texts: a maximal run of strings of one text that have the same anchor."""

    def __init__(self, docs: list[bytes]):
        size = np.array([len(x) for x in docs], np.int64)
        self.base = np.cumsum(size) - size
        self.raw = np.frombuffer(b"".join(docs), np.uint8)
        n = len(self.raw)
        self.lo = self.doc = self.count = np.zeros(0, np.int64)
        self.anchor = self.whole = np.zeros(0, U)
        if n < LENGTH:
            return
        powers = np.full(n + 1, _BASE, U)
        powers[0] = 1
        np.multiply.accumulate(powers, out=powers)
        sums = np.zeros(n + 1, U)
        np.cumsum(_BYTE[self.raw] * powers[:n], out=sums[1:])
        back = np.full(n + 1, pow(_BASE, -1, 1 << 64), U)
        back[0] = 1
        np.multiply.accumulate(back, out=back)
        gram = mix((sums[GRAM:] - sums[:-GRAM]) * back[: n - GRAM + 1])
        # The smallest of each window, the last of equals: hash above, place (counted down) below.
        low = U((1 << 32) - 1)
        best = (gram & ~low) | (low - np.arange(len(gram)).astype(U))
        window, width = LENGTH - GRAM + 1, 1
        while width * 2 <= window:
            best = np.minimum(best[:-width], best[width:])
            width *= 2
        if width < window:
            best = np.minimum(best[: len(best) - (window - width)], best[window - width :])
        at = (low - (best & low)).astype(np.int64)
        start = np.concatenate([np.arange(b, b + s - LENGTH + 1) for b, s in zip(self.base, size) if s >= LENGTH] or [[]])
        start = start.astype(np.int64)
        if not len(start):
            return
        at = at[start]
        doc = np.searchsorted(self.base + size, start, "right")
        edge = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])))
        self.sums, self.back = sums, back
        self.lo, self.doc = start[edge], doc[edge]
        self.count = np.diff(np.append(edge, len(start)))
        end = self.lo + self.count - 1 + LENGTH
        self.anchor = np.maximum(gram[at[edge]] & KEY, U(1))
        value = (sums[end] - sums[self.lo]) * back[self.lo] + self.count.astype(U) * U(0xD6E8FEB86659FD93)
        self.whole = mix(value + self.anchor) & KEY

    def text(self, k: int) -> bytes:
        return self.raw[self.lo[k] : self.lo[k] + self.count[k] - 1 + LENGTH].tobytes()

    def strings(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The strings of these contexts: the place of each within the batch, its context (an index of `some`), its hash."""
        count = self.count[some]
        of = np.repeat(np.arange(len(some)), count)
        at = self.lo[some][of] + np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
        if not len(at):
            return at, of, np.zeros(0, U)
        return at, of, mix((self.sums[at + LENGTH] - self.sums[at]) * self.back[at])


def _bucket(anchor: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(anchor) >> U(17)) % U(buckets)


def _spans(keys: np.ndarray) -> list[tuple[int, int]]:
    edge = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
    return [(a, b) for a, b in zip(edge, edge[1:]) if b > a]


class Lookup:
    """Arrays of a folder by name, mapped once."""

    def __init__(self, folder: str):
        self.folder, self.files = folder, {}

    def __call__(self, name: str) -> list[np.ndarray] | None:
        if name not in self.files:
            try:
                self.files[name] = map_arrays(f"{self.folder}/{name}")
            except FileNotFoundError:
                self.files[name] = None
        return self.files[name]

    def status(self, anchor: np.ndarray, whole: np.ndarray, buckets: int) -> np.ndarray:
        out = np.zeros(len(whole), np.int8)
        bucket = _bucket(anchor, buckets)
        order = np.lexsort((whole, bucket))
        for a, b in _spans(bucket[order]):
            at = order[a:b]
            for value, keys in enumerate(self(f"status-{int(bucket[at[0]])}") or [], 1):
                if len(keys):
                    place = np.minimum(np.searchsorted(keys, whole[at]), len(keys) - 1)
                    out[at[keys[place] == whole[at]]] = value
        return out

    def among(self, name: str, keys: np.ndarray, buckets: int) -> np.ndarray:
        """Which of `keys` are in the files `name`-bucket."""
        out = np.zeros(len(keys), dtype=bool)
        bucket = _bucket(keys, buckets)
        order = np.lexsort((keys, bucket))
        for a, b in _spans(bucket[order]):
            at = order[a:b]
            found = self(f"{name}-{int(bucket[at[0]])}")
            if found is not None and len(found[0]):
                place = np.minimum(np.searchsorted(found[0], keys[at]), len(found[0]) - 1)
                out[at] = found[0][place] == keys[at]
        return out


def settle(docs: DataFrame, buckets: int, folder: str) -> int:
    """Write the status of every context whose anchor occurs more than once, by bucket of the anchor. Returns the number
    of hot anchors.

    A task sends a context once, with the mark of a second occurrence, however often it has it.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, limit=4 << 20):
            found = Contexts(texts(part))
            keys = [_bucket(found.anchor, buckets), found.anchor, found.whole]
            (bucket, anchor, whole), (n,) = summed(keys, [np.ones(len(found.whole), np.int64)])
            spans = _spans(bucket)
            columns = [
                pa.array([int(bucket[a]) for a, _ in spans], pa.int64()),
                pa.array([pack(anchor[a:b]) for a, b in spans], pa.binary()),
                pa.array([pack(whole[a:b]) for a, b in spans], pa.binary()),
                pa.array([np.minimum(n[a:b], 2).astype(np.uint8).tobytes() for a, b in spans], pa.binary()),
            ]
            yield pa.record_batch(columns, ["bucket", "anchor", "whole", "times"])

    limit = HOT_CONTEXTS

    def judged(rows: pd.DataFrame) -> pd.DataFrame:
        times = np.frombuffer(b"".join(rows["times"]), np.uint8).astype(np.int64)
        keys = [unpack(rows["anchor"].tolist()), unpack(rows["whole"].tolist())]
        (anchor, whole), (n,) = summed(keys, [times])
        kinds, hot = np.zeros(len(n), np.int8), 0
        for a, b in _spans(anchor):
            if b - a > limit:
                kinds[a:b], hot = HOT, hot + 1
            elif b - a > 1:
                kinds[a:b] = np.where(n[a:b] > 1, PARTNER, OPEN)
            elif n[a] > 1:
                kinds[a] = SETTLED
        bucket = int(rows["bucket"].iloc[0])
        write_arrays(folder, f"status-{bucket}", [np.sort(whole[kinds == k]) for k in (SETTLED, PARTNER, OPEN, HOT)])
        return pd.DataFrame({"hot": [hot]})

    blobs = docs.select("text").mapInArrow(counted, "bucket long, anchor binary, whole binary, times binary")
    return blobs.groupBy("bucket").applyInPandas(judged, "hot long").agg(F.sum("hot")).first()[0] or 0


def decide_hot(docs: DataFrame, buckets: int, folder: str) -> None:
    """Write the hashes of the strings of hot anchors that are repeats, by bucket of the hash.

    Equal strings have equal hashes, so a string whose hash occurs once is unique. The others are compared byte by byte
    by a suffix array, in buckets by their hash: a slice of a task sends a string once or, if it has it more often, twice.
    """

    def distinct(found: Contexts, look: Lookup) -> tuple[np.ndarray, np.ndarray]:
        some = np.flatnonzero(look.status(found.anchor, found.whole, buckets) == HOT)
        at, _, key = found.strings(some)
        order = np.argsort(key, kind="stable")
        at, key = at[order], key[order]
        first = np.append(True, key[1:] != key[:-1]) if len(key) else np.zeros(0, bool)
        second = np.append(False, first[:-1]) & ~first if len(key) else first
        return at[first | second], key[first | second]

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = Lookup(folder)
        for part in slices(batches, limit=4 << 20):
            _, key = distinct(Contexts(texts(part)), look)
            (bucket, key), (n,) = summed([_bucket(key, buckets), key], [np.ones(len(key), np.int64)])
            spans = _spans(bucket)
            columns = [
                pa.array([int(bucket[a]) for a, _ in spans], pa.int64()),
                pa.array([key[a:b].astype("<u8").tobytes() for a, b in spans], pa.binary()),
                pa.array([n[a:b].astype(np.uint8).tobytes() for a, b in spans], pa.binary()),
            ]
            yield pa.record_batch(columns, ["bucket", "key", "times"])

    def several(rows: pd.DataFrame) -> pd.DataFrame:
        key = np.frombuffer(b"".join(rows["key"]), "<u8")
        (key,), (n,) = summed([key], [np.frombuffer(b"".join(rows["times"]), np.uint8).astype(np.int64)])
        write_arrays(folder, f"several-{int(rows['bucket'].iloc[0])}", [key[n > 1]])
        return pd.DataFrame({"n": [int((n > 1).sum())]})

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = Lookup(folder)
        for part in slices(batches, limit=4 << 20):
            found = Contexts(texts(part))
            at, key = distinct(found, look)
            keep = look.among("several", key, buckets)
            at, key = at[keep], key[keep]
            bucket = _bucket(key, buckets)
            order = np.lexsort((key, bucket))
            at, key, bucket = at[order], key[order], bucket[order]
            spans = _spans(bucket)
            view = np.lib.stride_tricks.sliding_window_view(found.raw, LENGTH) if len(at) else None
            columns = [
                pa.array([int(bucket[a]) for a, _ in spans], pa.int64()),
                pa.array([key[a:b].astype("<u8").tobytes() for a, b in spans], pa.binary()),
                pa.array([view[at[a:b]].tobytes() for a, b in spans], pa.binary()),
            ]
            yield pa.record_batch(columns, ["bucket", "key", "strings"])

    def decided(rows: pd.DataFrame) -> pd.DataFrame:
        key = np.frombuffer(b"".join(rows["key"]), "<u8")
        text = np.frombuffer(b"".join(rows["strings"]), np.uint8)
        order = np.argsort(key, kind="stable")
        key, text = key[order], text.reshape(-1, LENGTH)[order]
        keys = []
        # In parts of about BUCKET_BYTES; the strings of a hash stay together.
        edge = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        cut = edge[np.unique(edge * LENGTH // BUCKET_BYTES, return_index=True)[1]]
        for a, b in zip(cut, [*cut[1:], len(key)]):
            again = repeated_windows(text[a:b].ravel(), np.arange(b - a) * LENGTH)
            keys.append(np.unique(key[a:b][again]))
        bucket = int(rows["bucket"].iloc[0])
        write_arrays(folder, f"twice-{bucket}", [np.concatenate(keys)])
        return pd.DataFrame({"bucket": [bucket]})

    rows = docs.select("text")
    counts = rows.mapInArrow(counted, "bucket long, key binary, times binary")
    counts.groupBy("bucket").applyInPandas(several, "n long").write.format("noop").mode("overwrite").save()
    strings = rows.mapInArrow(sent, "bucket long, key binary, strings binary")
    strings.groupBy("bucket").applyInPandas(decided, "bucket long").write.format("noop").mode("overwrite").save()


def repeated_windows(text: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Which of the strings of `text` at `start` are there twice, by a suffix array and comparison of neighbours."""
    order = suffix_order(text.astype(np.int64) + 1)
    wanted = np.full(len(text), -1, np.int64)
    wanted[start] = np.arange(len(start))
    order = wanted[order]
    order = order[order >= 0]
    view = np.lib.stride_tricks.sliding_window_view(text, LENGTH)
    same = np.zeros(len(order), dtype=bool)
    for lo in range(0, len(order) - 1, 1 << 16):
        a, b = order[lo : lo + (1 << 16)], order[lo + 1 : lo + 1 + (1 << 16)]
        same[lo : lo + len(b)] = (view[start[a[: len(b)]]] == view[start[b]]).all(axis=1)
    out = np.zeros(len(start), dtype=bool)
    out[order[same]] = True
    out[order[1:][same[:-1]]] = True
    return out


def decide_open(docs: DataFrame, buckets: int, folder: str) -> None:
    """Decide the strings of open contexts and write the bytes they cover, by row."""

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = Lookup(folder)
        for part in slices(batches, limit=4 << 20):
            found = Contexts(texts(part))
            status = look.status(found.anchor, found.whole, buckets)
            partner = np.flatnonzero(status == PARTNER)
            partner = partner[np.unique(found.whole[partner], return_index=True)[1]]
            some = np.concatenate([np.flatnonzero(status == OPEN), partner])
            row = part.column(1).to_numpy()[found.doc[some]] if len(some) else np.zeros(0, np.int64)
            columns = [
                pa.array(_bucket(found.anchor[some], buckets).astype(np.int64), pa.int64()),
                pa.array(row, pa.int64()),
                pa.array((found.lo - found.base[found.doc])[some] if len(some) else [], pa.int64()),
                pa.array(status[some] == OPEN, pa.bool_()),
                pa.array([found.text(k) for k in some.tolist()], pa.binary()),
            ]
            yield pa.record_batch(columns, ["bucket", "row", "at", "open", "context"])

    def decided(rows: pd.DataFrame) -> pd.DataFrame:
        keep = rows["open"] | ~rows.duplicated("context")
        rows = rows[keep.to_numpy()]
        parts = rows["context"].tolist()
        size = np.array([len(x) for x in parts], np.int64)
        base = np.cumsum(size) - size
        count = size - LENGTH + 1
        of = np.repeat(np.arange(len(parts)), count)
        inside = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
        hit = repeated_windows(np.frombuffer(b"".join(parts), np.uint8), base[of] + inside)
        hit &= rows["open"].to_numpy()[of]
        of, inside = of[hit], inside[hit]
        edge = np.append(True, (of[1:] != of[:-1]) | (inside[1:] != inside[:-1] + 1)) if len(of) else np.zeros(0, bool)
        lo = np.flatnonzero(edge)
        last = np.append(lo[1:], len(of)) - 1 if len(lo) else lo
        at = rows["at"].to_numpy()[of[lo]]
        out = {"row": rows["row"].to_numpy()[of[lo]], "start": at + inside[lo], "end": at + inside[last] + LENGTH}
        return pd.DataFrame(out).astype(np.int64)

    def written(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["row", "start"])
        home = int(rows["home"].iloc[0])
        key = rows["row"].to_numpy().view(np.uint64)
        order = np.argsort(key, kind="stable")
        arrays = [key[order], *[rows[c].to_numpy()[order].astype(np.uint64) for c in ("start", "end")]]
        write_arrays(folder, f"runs-{home}", arrays)
        return pd.DataFrame({"home": [home]})

    sources = docs.select("text", F.xxhash64("doc_id", "text").alias("row"))
    open_ones = sources.mapInArrow(sent, "bucket long, row long, at long, open boolean, context binary")
    runs = open_ones.groupBy("bucket").applyInPandas(decided, "row long, start long, end long")
    runs = runs.withColumn("home", F.pmod("row", F.lit(buckets)))
    runs.groupBy("home").applyInPandas(written, "home long").write.format("noop").mode("overwrite").save()


def covered(docs: list[bytes], rows: np.ndarray, look: Lookup, buckets: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each text: starts and ends of its removed runs."""
    found = Contexts(docs)
    status = look.status(found.anchor, found.whole, buckets)
    sure = (status == SETTLED) | (status == PARTNER)
    start = (found.lo - found.base[found.doc])[sure] if len(sure) else np.zeros(0, np.int64)
    end, doc = (start + found.count[sure] - 1 + LENGTH, found.doc[sure]) if len(sure) else (start, start)
    if len(hot := np.flatnonzero(status == HOT)):
        at, of, key = found.strings(hot)
        twice = look.among("twice", key, buckets)
        of = found.doc[hot][of[twice]]
        at = at[twice] - found.base[of]
        start, end, doc = np.append(start, at), np.append(end, at + LENGTH), np.append(doc, of)
        order = np.argsort(doc, kind="stable")
        start, end, doc = start[order], end[order], doc[order]
    bounds = np.searchsorted(doc, np.arange(len(docs) + 1))
    for k, row in enumerate(rows.tolist()):
        a, b = start[bounds[k] : bounds[k + 1]], end[bounds[k] : bounds[k + 1]]
        if (runs := look(f"runs-{row % buckets}")) is not None:
            key = U(row & ((1 << 64) - 1))
            lo, hi = np.searchsorted(runs[0], key, "left"), np.searchsorted(runs[0], key, "right")
            a, b = np.append(a, runs[1][lo:hi].astype(np.int64)), np.append(b, runs[2][lo:hi].astype(np.int64))
        order = np.argsort(a, kind="stable")
        a, b = a[order], np.maximum.accumulate(b[order]) if len(b) else b
        new = np.append(True, a[1:] > b[:-1]) if len(a) else np.zeros(0, bool)
        last = np.append(np.flatnonzero(new)[1:], len(a)) - 1 if len(a) else np.zeros(0, int)
        yield k, a[new], b[last]


def remove_repeats(docs: DataFrame) -> DataFrame:
    """`doc_id`, `kept` (bytes), `n_bytes`, `n_removed`, `n_spans` of every row: each byte that a string of LENGTH bytes
    covers which also starts elsewhere, in any row, is removed from all of its places.

    Null and empty texts and texts of fewer than LENGTH bytes keep all they have. Rows with the same id and text are
    repeats of each other. An empty table gives no row; other columns are left aside.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(8, size // BUCKET_BYTES)
    folder = local_path(shared_dir(docs.sparkSession))
    if settle(docs, buckets, folder):
        decide_hot(docs, buckets, folder)
    decide_open(docs, buckets, folder)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = Lookup(folder)
        for part in slices(batches, limit=4 << 20):
            raw = texts(part)
            out, removed, spans = [], [], []
            for k, a, b in covered(raw, part.column(2).to_numpy(), look, buckets):
                text, at, pieces = raw[k], 0, []
                for x, y in zip(a.tolist(), b.tolist()):
                    pieces.append(text[at:x])
                    at = y
                out.append(b"".join([*pieces, text[at:]]))
                removed.append(int((b - a).sum()))
                spans.append(len(a))
            columns = [
                part.column(0).cast(pa.int64()),
                pa.array(out, pa.binary()),
                pa.array([len(x) for x in raw], pa.int64()),
                pa.array(removed, pa.int64()),
                pa.array(spans, pa.int64()),
            ]
            yield pa.record_batch(columns, ["doc_id", "kept", "n_bytes", "n_removed", "n_spans"])

    rows = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row"))
    return rows.mapInArrow(kept, "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long")


def repeat_table(docs: DataFrame) -> DataFrame:
    """`doc_id`, `n_bytes`, `n_removed`, `n_spans`, `kept_sha256` of every row."""
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
