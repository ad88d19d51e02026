"""SentencePiece encoding and decoding by suffix-array matching.

The units of a batch (a word with its blanks) are concatenated once each, some at a time. Their suffixes, sorted to the length of the
longest piece, give the places of every piece by binary search. These edges, sorted by position, are relaxed: of the
edges that join two neighbouring symbols the one with the best score is taken, the leftmost of equals, until none is
left. That is the order of merges of a BPE model, so the ids are those of the model's own library.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burnish.llm.common import held, map_rows, slices

BLANK = "▁"
KNOWN_BYTES = 16 << 20  # units and their ids that a worker keeps for its tasks; then it starts over
SLICE_BYTES = 1 << 18  # text bytes that a task encodes and decodes at once
LEARNED_UNITS = 1 << 16  # code points of units whose suffixes are sorted at once, or one longer unit
DECODED_IDS = 1 << 16  # ids that are decoded at once
LONG_UNIT = 48  # code points; longer units are relaxed with a heap
UNIT = re.compile(f"{BLANK}*[^{BLANK}\n]+|\n|{BLANK}+")
NONE = np.iinfo(np.int32).max


class Pieces:
    """The pieces of a model file, read through the sentencepiece library."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        self.text = [model.id_to_piece(i) for i in range(model.vocab_size())]
        plain = [not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i)) for i in range(len(self.text))]
        self.bytes = {int(x[1:-1], 16): i for i, x in enumerate(self.text) if model.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.skipped = {i for i in range(len(self.text)) if model.is_control(i)}
        ids = [i for i in range(len(self.text)) if plain[i]]
        # Units end before a line feed and before a blank that follows something else.
        if any("\n" in self.text[i] or BLANK in self.text[i].lstrip(BLANK) for i in ids):
            raise ValueError("a piece of the model crosses the units of this encoder")
        # Ranks instead of scores: 0 is the best, equal scores have equal ranks.
        score = np.array([model.get_score(i) for i in ids])
        rank = np.unique(-score, return_inverse=True)[1]
        order = np.argsort(np.array([self.text[i] for i in ids]))
        self.ids, self.rank = np.array(ids, np.int32)[order], rank.astype(np.int32)[order]
        self.sorted = np.array([self.text[i] for i in self.ids])
        self.length = np.char.str_len(self.sorted).astype(np.int64)
        self.longest = int(self.length.max())
        # The end of a piece's range of suffixes is where the piece followed by the last code point would go.
        self.after = np.char.add(self.sorted, "\U0010ffff")
        # What each id stands for, as bytes of UTF-8 one after the other.
        as_bytes = [b"" if i in self.skipped else x.replace(BLANK, " ").encode("utf-8", "replace") for i, x in enumerate(self.text)]
        for i, b in self.byte_of.items():
            as_bytes[i] = bytes([b])
        self.flat = np.frombuffer(b"".join(as_bytes), np.uint8)
        self.first = np.cumsum([0, *map(len, as_bytes)])
        self.is_skipped = np.zeros(len(self.text), dtype=bool)
        self.is_skipped[list(self.skipped)] = True


def edges(pieces: Pieces, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and piece (place in `pieces.sorted`) of every occurrence in `text` (code points), by position.

    `text` ends with as many zeros as the longest piece has code points, and units are separated by zeros.
    """
    wide = pieces.longest
    n = len(text) - wide
    suffixes = np.lib.stride_tricks.as_strided(text, (n, wide), (4, 4))
    rows = np.ascontiguousarray(suffixes).view(f"<U{wide}").ravel()
    order = np.argsort(rows, kind="stable")
    array = rows[order]
    low = np.searchsorted(array, pieces.sorted, "left")
    high = np.searchsorted(array, pieces.after, "right")
    if len(pieces.sorted[0]) and wide:
        full = pieces.length == wide
        high[full] = np.searchsorted(array, pieces.sorted[full], "right")
    count = high - low
    stop = np.cumsum(count)
    at = np.repeat(low - (stop - count), count) + np.arange(stop[-1] if len(stop) else 0)
    start, piece = order[at], np.repeat(np.arange(len(count)), count)
    by_place = np.argsort(start, kind="stable")
    return start[by_place], piece[by_place]


def joined_spans(flat: np.ndarray, first: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The spans flat[first[k]:first[k + 1]] for all k in `which`, one after the other."""
    count = first[which + 1] - first[which]
    stop = np.cumsum(count)
    return flat[np.repeat(first[which] - (stop - count), count) + np.arange(stop[-1] if len(stop) else 0)]


class UnitEncoder:
    def __init__(self, path: str):
        self.pieces = Pieces(path)
        self._forget()

    def _forget(self) -> None:
        self.place: dict[str, int] = {}
        self.ids, self.first, self.bytes = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)], 0

    def units(self, text: str) -> list[str]:
        return UNIT.findall(BLANK + text.replace(" ", BLANK)) if text else []

    def learn(self, new: list[str]) -> None:
        """Ids of units that aren't known yet, some units at a time, so that memory follows that limit or one unit."""
        if not new:
            return
        size = np.array([len(x) + 1 for x in new], np.int64)
        part = (np.cumsum(size) - size) // LEARNED_UNITS
        bounds = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(new)]
        for a, b in zip(bounds, bounds[1:]):
            self._learn(new[a:b])

    def _learn(self, new: list[str]) -> None:
        """Ids of some units, all from one suffix array."""
        p = self.pieces
        joined = "\0".join(new) + "\0" * (p.longest + 1)
        text = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        n = len(text) - p.longest
        start, piece = edges(p, text)
        # For each start and length: the piece that covers it.
        cover = np.full((n, p.longest + 1), -1, np.int32)
        cover[start, p.length[piece]] = piece
        cover[text[:n] == 0] = -1
        size = np.array([len(x) for x in new], np.int64)
        first = np.cumsum(size + 1) - size - 1
        follow = np.arange(1, n + 1)  # where the symbol that starts here ends
        starts = np.ones(n, dtype=bool)  # whether a symbol starts here
        starts[first + size] = False
        if (size <= LONG_UNIT).any():
            self._relax(cover, follow, starts, first[size <= LONG_UNIT], size[size <= LONG_UNIT])
        for f, s in zip(first[size > LONG_UNIT].tolist(), size[size > LONG_UNIT].tolist()):
            self._relax_long(cover, follow, starts, f, s)
        at = np.flatnonzero(starts)
        held = cover[at, np.minimum(follow[at] - at, p.longest)]
        count = np.ones(len(at), np.int64)
        # No piece: a single code point, as bytes.
        none = np.flatnonzero(held < 0)
        spelled = [joined[k].encode("utf-8", "replace") for k in at[none].tolist()]
        count[none] = [*map(len, spelled)]
        out = np.repeat(p.ids[held], count)
        out[np.repeat(held < 0, count)] = [p.bytes[b] for b in b"".join(spelled)]
        stop = np.append(0, np.cumsum(count))[np.searchsorted(at, first + size)]
        self.place.update(zip(new, range(len(self.place), len(self.place) + len(new))))
        self.ids.append(out)
        self.first.append(self.first[-1][-1] + stop)
        self.bytes += 2 * sum(map(len, new)) + 150 * len(new) + 4 * len(out)

    def _pair(self, cover, a, c):
        """Rank of the piece from a to c, or NONE."""
        wide = c - a
        piece = cover[a, np.minimum(wide, self.pieces.longest)]
        return np.where((wide <= self.pieces.longest) & (piece >= 0), self.pieces.rank[piece], NONE)

    def _relax(self, cover, follow, starts, first, size) -> None:
        """One join in every unit at a time: the best edge over two symbols, leftmost of equals."""
        unit = np.repeat(np.arange(len(first)), size)
        stop = np.cumsum(size)
        at = np.repeat(first - (stop - size), size) + np.arange(stop[-1])
        end = first + size
        while len(at):
            nxt = follow[at]
            inner = nxt < end[unit]
            rank = np.full(len(at), NONE, np.int32)
            rank[inner] = self._pair(cover, at[inner], follow[nxt[inner]])
            start = np.flatnonzero(np.append(True, unit[1:] != unit[:-1]))
            best = np.minimum.reduceat(rank, start)
            counts = np.diff(np.append(start, len(at)))
            is_best = (rank == np.repeat(best, counts)) & (rank < NONE)
            hit = np.flatnonzero(is_best)
            hit = hit[np.unique(unit[hit], return_index=True)[1]]
            starts[nxt[hit]] = False
            follow[at[hit]] = follow[nxt[hit]]
            keep = np.repeat(best < NONE, counts)
            keep[hit + 1] = False
            at, unit = at[keep], unit[keep]

    def _relax_long(self, cover, follow, starts, first, size) -> None:
        """The same for one long unit, with the edges in a heap."""
        end, before = first + size, {}
        for k in range(first + 1, end):
            before[k] = k - 1
        rank, wide = self.pieces.rank, self.pieces.longest

        def push(a):
            b = int(follow[a])
            if b < end and (c := int(follow[b])) - a <= wide and (piece := cover[a, c - a]) >= 0:
                heappush(heap, (int(rank[piece]), a, b, c))

        heap: list[tuple[int, int, int, int]] = []
        for k in range(first, end):
            push(k)
        heapify(heap)
        gone = set()
        while heap:
            _, a, b, c = heappop(heap)
            if a in gone or b in gone or follow[a] != b or follow[b] != c:
                continue
            follow[a] = c
            starts[b] = False
            gone.add(b)
            before[c] = a
            push(a)
            if a > first:
                push(before[a])

    def __call__(self, batch: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where those of each text begin; the last entry is their number."""
        if self.bytes > KNOWN_BYTES:
            self._forget()
        split = [self.units(x) for x in batch]
        self.learn([*set(chain.from_iterable(split)).difference(self.place)])
        flat, first = np.concatenate(self.ids), np.concatenate(self.first)
        self.ids, self.first = [flat], [first]
        many = np.array([*map(len, split)], np.int64)
        place = np.fromiter(map(self.place.__getitem__, chain.from_iterable(split)), np.int64, int(many.sum()))
        return joined_spans(flat, first, place), np.append(0, np.cumsum(first[place + 1] - first[place]))[np.append(0, np.cumsum(many))]

    def decode_all(self, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        """The texts of ids as `__call__` returns them."""
        p = self.pieces
        raw = joined_spans(p.flat, p.first, ids).tobytes()
        edge = np.append(0, np.cumsum(p.first[ids + 1] - p.first[ids]))[bounds].tolist()
        odd = np.add.reduceat(np.append(p.is_skipped[ids], False), bounds[:-1]) * (np.diff(bounds) > 0) if len(bounds) > 1 else []
        out = []
        for k, by_hand in enumerate(odd):
            # Bytes that are no UTF-8, or that a control piece parts, are read run by run.
            try:
                text = None if by_hand else raw[edge[k] : edge[k + 1]].decode().replace(BLANK, " ")
            except UnicodeDecodeError:
                text = None
            if text is None:
                out.append(self.decode(ids[bounds[k] : bounds[k + 1]].tolist()))
            else:
                out.append(text[1:] if text.startswith(" ") else text)
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids: bytes that follow each other are read as UTF-8, the blank put in front is taken away."""
        p, out, raw = self.pieces, [], bytearray()
        for i in ids:
            if i in p.byte_of:
                raw.append(p.byte_of[i])
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw = bytearray()
            if i not in p.skipped:
                out.append(p.text[i])
        if raw:
            out.append(raw.decode("utf-8", "replace"))
        text = "".join(out).replace(BLANK, " ")
        return text[1:] if text.startswith(" ") else text


def encoder(path: str) -> UnitEncoder:
    """One encoder a Python worker."""
    return held(("pieces", path), lambda: UnitEncoder(path))


def encode_pieces(
    docs: DataFrame, path: str, text: str = "text", out: str = "piece_ids", decoded: str | None = None
) -> DataFrame:
    """`docs` with the ids of `text` in a new column `out` (array<int>), which takes the place of one of that name; with
    `decoded`, the text of these ids in a column of that name, by the same task.

    A null or empty text has no ids. All rows and other columns stay as they are, repeated and equal ones included; an
    empty table stays empty.
    """
    added = [out, *([decoded] if decoded else [])]
    columns = [c for c in docs.columns if c not in added]
    at = columns.index(text)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for part in slices(batches, f"c{at}", SLICE_BYTES, ("pieces", path)):
            ids, bounds = encode([x or "" for x in part.column(at).to_pylist()])
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids))
            back = [pa.array(encode.decode_all(ids, bounds), pa.string())] if decoded else []
            yield pa.record_batch([*part.columns, lists, *back], [*part.schema.names, "ids", "back"][: len(columns) + len(added)])

    kinds = "ids array<int>, back string" if decoded else "ids array<int>"
    return map_rows(docs, columns, encoded, kinds).toDF(*columns, *added)


def decode_pieces(df: DataFrame, path: str, ids: str = "piece_ids", out: str = "decoded") -> DataFrame:
    """`df` with the text of `ids` in a new column `out`; null ids have null text."""

    @F.pandas_udf("string")
    def decoded(column: pd.Series) -> pd.Series:
        decode, out, part = encoder(path).decode_all, [], []

        def close():
            bounds = np.cumsum([0, *map(len, part)])
            out.extend(decode(np.concatenate([np.zeros(0, np.int32), *part]), bounds))
            part.clear()

        # Batches have a number of rows, not of ids; arrays are made for some ids at a time.
        held = 0
        for x in column:
            part.append(np.asarray([] if x is None else x, np.int32))
            held += len(part[-1])
            if held >= DECODED_IDS:
                close()
                held = 0
        close()
        return pd.Series(out, index=column.index, dtype=object).where(column.notna(), None)

    return df.withColumn(out, decoded(F.col(ids)))


def piece_table(docs: DataFrame, path: str) -> DataFrame:
    """`doc_id`, `n_pieces`, `ids_crc32` (of the ids as little-endian 32-bit integers), `decoded_crc32` (of the decoded
    text in UTF-8), `round_trip` (the decoded text is the text, null taken as empty) of every document.

    Repeated rows have a row each; an empty table gives none; other columns are left aside.
    """

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for part in slices(batches, limit=SLICE_BYTES, model=("pieces", path)):
            text = [x or "" for x in part.column(1).to_pylist()]
            ids, bounds = encode(text)
            back = encode.decode_all(ids, bounds)
            raw, edge = memoryview(ids.astype("<i4").tobytes()), (4 * bounds).tolist()
            columns = [
                part.column(0).cast(pa.int64()),
                pa.array(np.diff(bounds), pa.int64()),
                pa.array([zlib.crc32(raw[a:b]) for a, b in zip(edge, edge[1:])], pa.int64()),
                pa.array([zlib.crc32(x.encode()) for x in back], pa.int64()),
                pa.array([a == b for a, b in zip(text, back)], pa.bool_()),
            ]
            yield pa.record_batch(columns, ["doc_id", "n_pieces", "ids_crc32", "decoded_crc32", "round_trip"])

    schema = "doc_id long, n_pieces long, ids_crc32 long, decoded_crc32 long, round_trip boolean"
    return docs.select("doc_id", "text").mapInArrow(digests, schema)
