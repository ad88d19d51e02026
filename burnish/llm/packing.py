"""Documents packed into sequences of a fixed number of tokens, by rounds of distributed best fit.

Each round sorts the gaps of all open sequences by range and sweeps documents and gaps from long to short: a length takes
the shortest gaps that hold it (its successors), as many documents a gap as fit. The sweep needs the number of documents
and gaps of each length, which no table makes longer than the capacity; documents and gaps then meet by rank, so that no
two want the same place and no length lands in one task. What a round leaves of its longest lengths opens new sequences,
gaps are updated, and the next round takes what is left.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burnish.llm.common import held, saved, slices
from burnish.llm.token_files import KnownWords, closed_texts
from burnish.operators.ranking import ranked

# Texts whose words can't be told apart by single blanks and line feeds, or that may hold a special token.
WHOLE = (
    r"\A[ \n]|[ \n]\z|[ \n][ \n]|<\||"
    r"[\x09\x0b-\x0d\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)


def plain_letters(word: str) -> str | None:
    """Letters with or without a blank in front are one pre-token."""
    return word if word.removeprefix(" ").isalpha() else None


class ByteEncoder:
    """Ids of whole texts by a byte-level tokenizer that splits texts in front of single blanks and around line feeds.

    The words between them are encoded once a worker and looked up; texts with other white space, or with what may be a
    special token, are encoded as they are.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        feed = self.tokenizer.encode("\n", add_special_tokens=False).ids
        # The empty word stands for a line feed.
        self.known = KnownWords(self.tokenizer, plain_letters, feed)

    def __call__(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, each text closed by `end_id`, and the number of ids of each text."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        whole = pc.or_(pc.match_substring_regex(texts, WHOLE), pc.equal(texts, ""))
        as_whole = np.flatnonzero(whole.to_numpy(zero_copy_only=False))
        plain = pc.if_else(whole, "", texts)
        split = pc.split_pattern(pc.replace_substring(pc.replace_substring(plain, "\n", "\n\n"), " ", "\n "), "\n")
        sizes = pc.list_value_length(split).to_numpy().astype(np.int64)
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        self.known.learn(words)
        place = self.known.places(words)[coded.indices.to_numpy()]
        flat, first = self.known.arrays()
        # Whole texts take the place of their one empty word, after all known words.
        others = self.tokenizer.encode_batch_fast([texts[i].as_py() for i in as_whole.tolist()], add_special_tokens=False)
        place[np.cumsum(sizes)[as_whole] - 1] = len(first) - 1 + np.arange(len(as_whole))
        more = [np.array(x.ids, np.uint32) for x in others]
        flat = np.concatenate([flat, *more])
        first = np.append(first, first[-1] + np.cumsum([len(x) for x in more], dtype=np.int64))
        return closed_texts(flat, first, place, sizes, end_id)


PIECES_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """`doc_id`, `piece`, `start`, `length`, `ids_crc32` of every document's tokens, cut only beyond `capacity`.

    All pieces but the first of a cut document are full. A null text is empty and holds only the end id.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = held(("bytes", path), lambda: ByteEncoder(path))
        for part in slices(batches, limit=8 << 20, model=("bytes", path)):
            ids, count = encoder(part.column(1), end_id)
            many = -(-count // capacity)
            of = np.repeat(np.arange(len(count)), many)
            piece = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
            lead = count - (many - 1) * capacity  # the first piece
            start = np.where(piece == 0, 0, lead[of] + (piece - 1) * capacity)
            length = np.where(piece == 0, lead[of], capacity)
            begin = (np.cumsum(count) - count)[of] + start
            raw = memoryview(ids.astype("<u4").tobytes())
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begin.tolist(), (begin + length).tolist())]
            columns = [part.column(0).cast(pa.int64()).take(pa.array(of)), pa.array(piece, pa.int32())]
            columns += [pa.array(x, pa.int64()) for x in (start, length, np.array(crc, np.int64))]
            yield pa.record_batch(columns, ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(cut, PIECES_SCHEMA)


def thresholds(capacity: int) -> list[int]:
    """Lengths above which a round's leftovers open new sequences: those of which one, two, three, up to seven fit, then
    all."""
    return [*(capacity // k for k in (2, 3, 4, 8) if capacity // k), 0]


def sweep(items: dict[int, int], gaps: dict[int, int], taken: dict[int, int]) -> list[tuple[int, ...]]:
    """Which ranks of which length go to which ranks of which gap: rows of (length, item from, item to, a gap's items,
    gap, gap from, gap to).

    Lengths go from long to short, each to the shortest gaps that hold it: gaps are stacked as the sweep passes them, so
    the shortest one that fits lies on top. Takes numbers of items and gaps by length; `taken` items are placed already.
    """
    out, stack = [], []
    for size in sorted(items.keys() | gaps.keys(), reverse=True):
        if gaps.get(size):
            stack.append([size, gaps[size], 0])
        left, item = items.get(size, 0), taken.get(size, 0)
        while left and stack:
            gap, free, rank = stack[-1]
            a_gap = gap // size
            used = min(free, -(-left // a_gap))
            placed = min(left, used * a_gap)
            out.append((size, item, item + placed, a_gap, gap, rank, rank + used))
            left, item = left - placed, item + placed
            stack[-1] = [gap, free - used, rank + used]
            if free == used:
                stack.pop()
    return out


def openings(items: dict[int, int], taken: dict[int, int], capacity: int, first: int) -> tuple[list[tuple[int, ...]], int]:
    """New sequences for all `items`, from long to short, each filled until the next one doesn't fit: rows of (length,
    item from, item to, items a sequence, sequence, offset), and the next free sequence number from `first` on.
    """
    out, filled, current, following = [], capacity, first, first
    for size in sorted(items, reverse=True):
        left, item = items[size], taken[size]
        while left:
            fit = (capacity - filled) // size
            if fit:  # go on with the open sequence
                n = min(left, fit)
                out.append((size, item, item + n, n, current, filled))
                filled += n * size
            else:
                fit = capacity // size
                whole = max(1, left // fit)
                n = min(left, whole * fit)
                out.append((size, item, item + n, fit, following, 0))
                following += whole
                current, filled = following - 1, (n - (whole - 1) * fit) * size
            left, item = left - n, item + n
    return out, following


SWEEP_COLUMNS = ["length", "item_from", "item_to", "a_gap", "gap", "gap_from", "gap_to"]
OPENING_COLUMNS = ["length", "item_from", "item_to", "fit", "first", "begin"]


def counts_by(df: DataFrame, column: str) -> dict[int, int]:
    """Rows per value of `column`, which holds whole numbers up to the capacity."""
    return {r[0]: r[1] for r in df.groupBy(column).count().collect()}


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """`pieces` (with `length`, 1 to `capacity`) with `sequence_id` and `offset`: sequences filled without gaps from 0.

    Rows are kept as they are, repeated ones too, each with a place of its own. The order within a length is that of
    `doc_id` and `piece`. The driver sees the number of pieces and gaps of each length, at most `capacity` rows each.
    An empty table packs into nothing.
    """
    spark = pieces.sparkSession
    full = pieces.where(F.col("length") == capacity)
    rest = saved(ranked(pieces.where(F.col("length") < capacity), ["length"], ["doc_id", "piece"], "item"))
    rest = rest.withColumn("item", F.col("item") - 1)
    done = [c for c in rest.columns if c != "item"]

    counts = counts_by(rest, "length")
    taken = dict.fromkeys(counts, 0)
    placed, gaps, sequences = [], None, 0
    steps = thresholds(capacity)

    def table(rows: list[tuple[int, ...]], columns: list[str]) -> DataFrame:
        return F.broadcast(spark.createDataFrame(pa.table([pa.array(c, pa.int64()) for c in zip(*rows)], columns)))

    while left := {s: n - taken[s] for s, n in counts.items() if n > taken[s]}:
        while len(steps) > 1 and steps[0] >= max(left):
            steps.pop(0)
        least = steps.pop(0) if len(steps) > 1 else 0
        waiting = rest.join(table(sorted(taken.items()), ["length", "placed"]), "length")
        waiting = waiting.where(F.col("item") >= F.col("placed")).drop("placed")
        plan, new_gaps = [], []
        if gaps is not None:
            gaps = gaps.where(F.col("gap") >= min(left))
            plan = sweep(left, counts_by(gaps, "gap"), taken)
        if plan:
            by_gap = ranked(gaps, ["gap"], ["sequence_id"], "place").withColumn("place", F.col("place") - 1)
            moves = table(plan, SWEEP_COLUMNS)
            at, places = F.col("item") - F.col("item_from"), F.col("place") - F.col("gap_from")
            found = waiting.join(moves, "length").where("item >= item_from and item < item_to").select(
                *done,
                F.col("gap"),
                (F.col("gap_from") + F.expr("(item - item_from) div a_gap")).alias("place"),
                (F.lit(capacity) - F.col("gap") + at % F.col("a_gap") * F.col("length")).alias("offset"),
            )
            # One gap rank may lie in one row of the plan only, so both sides of these joins meet once.
            placed.append(saved(found.join(by_gap, ["gap", "place"]).select(*done, "sequence_id", "offset")))
            used = F.least(F.col("a_gap"), F.col("item_to") - F.col("item_from") - places * F.col("a_gap"))
            hit = moves.withColumnRenamed("gap", "of_gap")
            here = (F.col("gap") == F.col("of_gap")) & (F.col("place") >= F.col("gap_from")) & (F.col("place") < F.col("gap_to"))
            rest_of_gap = F.col("gap") - F.coalesce(used * F.col("length"), F.lit(0))
            new_gaps.append(by_gap.join(hit, here, "left").select("sequence_id", rest_of_gap.alias("gap")).where("gap > 0"))
            for size, _, to, *_ in plan:
                taken[size] = to
        elif gaps is not None:
            new_gaps.append(gaps)
        # What is left of the long lengths opens sequences. The last step does so when no gap takes anything more.
        if least or not plan:
            opening, sequences = openings(
                {s: n - taken[s] for s, n in counts.items() if s > least and n > taken[s]}, taken, capacity, sequences
            )
            if opening:
                at = F.col("item") - F.col("item_from")
                rows = waiting.join(table(opening, OPENING_COLUMNS), "length").where("item >= item_from and item < item_to")
                rows = rows.withColumn("sequence_id", F.col("first") + F.expr("(item - item_from) div fit"))
                rows = rows.withColumn("offset", F.col("begin") + at % F.col("fit") * F.col("length"))
                placed.append(saved(rows.select(*done, "sequence_id", "offset")))
                ends = placed[-1].groupBy("sequence_id").agg(F.sum("length").alias("filled"))
                ends = ends.select("sequence_id", (F.lit(capacity) - F.col("filled")).alias("gap"))
                new_gaps.append(ends.where("gap > 0"))
                for size, _, to, *_ in opening:
                    taken[size] = to
        if new_gaps:
            gaps = saved(reduce(DataFrame.unionByName, new_gaps))

    # Full pieces have sequences of their own, numbered downwards from -1 by partition and row of the written table.
    whole = full.select(*done, (-F.monotonically_increasing_id() - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    for part in placed:
        whole = whole.unionByName(part)
    return whole


def packing_table(docs: DataFrame, path: str, capacity: int = 2048) -> DataFrame:
    """`doc_id`, `piece`, `start`, `length`, `ids_crc32`, `sequence_id`, `offset` of every piece of `docs`.

    A null text is empty: one piece of the end id. Only `doc_id` and `text` are read. An empty table gives no rows.
    """
    return pack(saved(pieces(docs, path, capacity)), capacity)
