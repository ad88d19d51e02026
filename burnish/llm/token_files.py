"""Token ids in binary files: ids ranked by frequency, byte-aligned variable-length coding, control bytes apart."""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from burnish.llm.common import held, saved, shared_dir, slices

MAGIC = b"TOKSVB01"
FILE_TOKENS = 4 << 20  # a file closes after the document that reaches this
KNOWN_BYTES = 96 << 20  # words and ids that a worker keeps for its tasks; then it starts over

# For each control byte: the lengths of its four ids, and their sum.
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1
TOTALS = LENGTHS.sum(axis=1)


def encode(ids: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes (two bits for the length of each id) and data bytes (1 to 4 a value, low byte first)."""
    ids = np.asarray(ids, np.uint32)
    code = (ids > 0xFF).astype(np.uint8) + (ids > 0xFFFF) + (ids > 0xFFFFFF)
    fours = np.zeros((len(ids) + 3) // 4 * 4, np.uint8)
    fours[: len(ids)] = code
    control = (fours.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8)
    rows = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    return control.tobytes(), rows[np.arange(4) <= code[:, None]].tobytes()


def decode(control: bytes, data: bytes, count: int) -> np.ndarray:
    """The ids of `encode`; the lengths come from a table of the 256 control bytes."""
    length = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:count]
    start = np.cumsum(length) - length
    raw = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(3, np.uint8)]).astype(np.uint32)
    out = np.zeros(count, np.uint32)
    for k in range(4):
        more = length > k
        out[more] |= raw[start[more] + k] << np.uint32(8 * k)
    return out


def blanks_part_words(path: str) -> bool:
    """Whether the tokenizer of a file drops blanks and line feeds and looks at the words between them one by one.

    That holds if text is only normalised, put in lower case and cut into matches of one pattern, none of which holds
    white space, before bytes are encoded. Other files may be right, too, but are not known to be.
    """
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)

    def parts(entry: dict | None, name: str) -> list[dict]:
        return [] if entry is None else entry[name] if entry["type"] == "Sequence" else [entry]

    for step in parts(spec["normalizer"], "normalizers"):
        blanks = step["type"] == "Replace" and step["pattern"] == {"Regex": "\\s+"} and step["content"] == " "
        if not (blanks or step["type"] in ("NFC", "Lowercase")):
            return False
    steps = parts(spec["pre_tokenizer"], "pretokenizers")
    if [x["type"] for x in steps] != ["Split", "ByteLevel"] or steps[1]["add_prefix_space"] or steps[1]["use_regex"]:
        return False
    split = steps[0]
    if not (split["invert"] and split["behavior"] == "Removed" and "Regex" in split["pattern"]):
        return False
    tried = regex.compile(split["pattern"]["Regex"])
    others = "aÉ漢1.,'s\u0301😀\0"
    return not any(regex.search(r"\s", m) for x in others for b in " \n" for m in tried.findall(f"{x}{b}{x} {b}\n{x}"))


MARKS = ".,;:!?"
# Letters that have one lower-case form and no combining marks.
LETTERS = "A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u012F\u0132-\u024F"
# Such letters, and marks behind them or none.
PLAIN = f"^(?P<letters>[{LETTERS}]+)(?P<marks>[{MARKS}]*)$"


def plain_lower(word: str) -> str | None:
    return word.lower() if re.fullmatch(f"[{LETTERS}]+", word) else None


def as_list(column: pa.Array) -> list[str]:
    """The texts of a column without nulls; `to_pylist` makes a scalar of each."""
    return column.to_numpy(zero_copy_only=False).tolist()


class KnownWords:
    """Ids of the words that a worker has met, encoded once each, in arrays; bounded by KNOWN_BYTES.

    For tokenizers that part letters from the marks behind them: a word that ends in marks is put together from its
    parts, so that the same word with and without marks is encoded once.
    """

    def __init__(self, tokenizer, plain: Callable[[str], str | None], empty: Sequence[int] = ()):
        """`plain` gives the form in which the tokenizer's model gets a word that it gets whole, else null."""
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer, self.model, self.plain = tokenizer, tokenizer.model, plain
        self.empty = np.array(empty, np.uint32)
        # The characters that stand for the bytes 0 to 255 in a byte-level vocabulary: those printable as they are, in
        # order, and from U+0100 on one for each other byte.
        alphabet = set(ByteLevel.alphabet())
        self.stands = {b: 256 + k for k, b in enumerate(b for b in range(256) if chr(b) not in alphabet)}
        self.forget()

    def forget(self) -> None:
        """Keeps the empty word alone, at place 0."""
        self.place, self.bytes = {"": 0}, 0
        self.ids, self.first = [self.empty], [np.array([0, len(self.empty)], np.int64)]

    def arrays(self) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and where those of each place begin."""
        flat, first = np.concatenate(self.ids), np.concatenate(self.first)
        self.ids, self.first = [flat], [first]
        return flat, first

    def _encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words in a row, and where those of each word end. A plain word goes straight to the model, any
        other through the whole tokenizer."""
        out, end, tokenize, plain = array("I"), [], self.model.tokenize, self.plain
        for word in words:
            form = plain(word)
            if form is None:
                out.extend(self.tokenizer.encode(word, add_special_tokens=False).ids)
            else:
                out.extend([t.id for t in tokenize(form.encode().decode("latin-1").translate(self.stands))])
            end.append(len(out))
        return np.array(out, np.uint32), np.array(end, np.int64)

    def _spelled(self, forms: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for words of letters alone, as the model gets them. It has ASCII letters as they are."""
        out, end, tokenize, stands = array("I"), [], self.model.tokenize, self.stands
        for form in forms:
            spelled = form if form.isascii() else form.encode().decode("latin-1").translate(stands)
            out.extend([t.id for t in tokenize(spelled)])
            end.append(len(out))
        return np.array(out, np.uint32), np.array(end, np.int64)

    def _add(self, words: list[str], ids: np.ndarray, end: np.ndarray) -> None:
        self.ids.append(ids)
        self.first.append(self.first[-1][-1] + end)
        self.place.update(zip(words, range(len(self.place), len(self.place) + len(words))))
        self.bytes += 2 * sum(map(len, words)) + 100 * len(words) + 4 * len(ids)

    def learn(self, words: list[str], forms: Sequence[str] = ()) -> None:
        """`forms` are distinct words of letters alone, in the form in which the model gets them."""
        if self.bytes > KNOWN_BYTES:
            self.forget()
        known = self.place
        spelled = [w for w in forms if w not in known]
        if spelled:
            self._add(spelled, *self._spelled(spelled))
        new = [w for w in words if w not in known]
        alone, marked = {}, []
        for w in new:
            core = w.rstrip(MARKS)
            tail = w[len(core) :]
            if (core != w) and core[-1:].lower().isalpha():
                marked.append((w, core, tail))
                alone[core] = alone[tail] = None
            else:
                alone[w] = None
        alone = [w for w in alone if w not in known]
        if alone:
            self._add(alone, *self._encoded(alone))
        if marked:
            flat, first = self.arrays()
            parts = np.array([known[x] for _, *pair in marked for x in pair], np.int64)
            ids, end = joined_spans(flat, first, parts)
            self._add([w for w, *_ in marked], ids, end[1::2])

    def places(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))


def joined_spans(flat: np.ndarray, first: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spans flat[first[k]:first[k + 1]] for all k in `place`, one after the other, and where each ends."""
    count = first[place + 1] - first[place]
    stop = np.cumsum(count)
    return flat[np.repeat(first[place] - (stop - count), count) + np.arange(stop[-1] if len(stop) else 0)], stop


def closed_texts(flat: np.ndarray, first: np.ndarray, place: np.ndarray, sizes: np.ndarray, end_id: int):
    """The ids of the words at `place`, `sizes` words a text, each text closed by `end_id`, and the ids of each text."""
    place = np.insert(place, np.cumsum(sizes), len(first) - 1)
    ids, stop = joined_spans(np.append(flat, np.uint32(end_id)), np.append(first, first[-1] + 1), place)
    return ids, np.diff(np.append(0, stop)[np.cumsum(sizes + 1)], prepend=0)


class WordEncoder:
    """The ids of whole texts, by the tokenizers library.

    With `by_word`, for tokenizers that look at the words between blanks and line feeds one by one, each distinct word
    is encoded once a worker and looked up; without it, each text is encoded itself. Left open, the file decides.
    """

    def __init__(self, path: str, by_word: bool | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.by_word = blanks_part_words(path) if by_word is None else by_word
        self.known = KnownWords(self.tokenizer, plain_lower)

    def __call__(self, batch: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, each document closed by `end_id`, and the number of ids of each document."""
        batch = pc.fill_null(batch.cast(pa.large_string()), "")
        if not self.by_word:
            found = self.tokenizer.encode_batch_fast(batch.to_pylist(), add_special_tokens=False)
            each = [np.array([*x.ids, end_id], np.uint32) for x in found]
            return np.concatenate([np.zeros(0, np.uint32), *each]), np.array([len(x) for x in each], np.int64)
        split = pc.split_pattern(pc.replace_substring(batch, "\n", " "), " ")
        sizes = pc.list_value_length(split).to_numpy().astype(np.int64)
        coded = split.flatten().dictionary_encode()
        # The tokenizer reads capitals as small letters and parts letters from the marks behind them.
        parts = pc.extract_regex(coded.dictionary, PLAIN)
        plain = parts.is_valid()
        letters = pc.utf8_lower(pc.struct_field(parts, "letters").filter(plain)).dictionary_encode()
        marks = pc.struct_field(parts, "marks").filter(plain).dictionary_encode()
        forms, tails, others = map(as_list, (letters.dictionary, marks.dictionary, coded.dictionary.filter(pc.invert(plain))))
        known = self.known
        known.learn(others + tails, forms)
        # The places of each word's two parts; the empty word, at place 0, has no ids.
        plain = plain.to_numpy(zero_copy_only=False)
        place = np.zeros((len(plain), 2), np.int64)
        place[plain, 0] = known.places(forms)[letters.indices.to_numpy()]
        place[plain, 1] = known.places(tails)[marks.indices.to_numpy()]
        place[~plain, 0] = known.places(others)
        ids, stop = joined_spans(*known.arrays(), place.ravel())
        return closed_texts(ids, np.append(0, stop[1::2]), coded.indices.to_numpy(), sizes, end_id)


def id_type(path: str) -> str:
    """The smallest little-endian type that holds every id of a tokenizer."""
    from tokenizers import Tokenizer

    return "<u2" if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 else "<u4"


def tokenized(docs: DataFrame, path: str, end_id: int = 2, by_word: bool | None = None) -> DataFrame:
    """`doc_id`, `tokens` (ids of type `id_type`, closed by `end_id`) of every document."""
    kind = id_type(path)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = ("words", path, by_word)
        encoder = held(key, lambda: WordEncoder(path, by_word))
        for part in slices(batches, limit=4 << 20, model=key):
            ids, count = encoder(part.column(1), end_id)
            offsets = pa.array(np.append(0, np.cumsum(count)) * np.dtype(kind).itemsize, pa.int32())
            blobs = pa.BinaryArray.from_buffers(
                pa.binary(), len(count), [None, offsets.buffers()[1], pa.py_buffer(ids.astype(kind).tobytes())]
            )
            yield pa.record_batch([part.column(0).cast(pa.int64()), blobs], ["doc_id", "tokens"])

    return docs.select("doc_id", "text").mapInArrow(encoded, "doc_id long, tokens binary")


def ranks(tokens: DataFrame, kind: str) -> DataFrame:
    """`id`, `rank`: 0 for the most frequent id, ties by id. Each task sends one row per id that it met."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            one = np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), kind))
            if len(one) > len(total):
                one, total = total, one
            total[: len(one)] += one
        seen = np.flatnonzero(total)
        yield pa.record_batch([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], ["id", "n"])

    sums = tokens.select("tokens").mapInArrow(counted, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    # One row per id of the vocabulary, whatever the number of documents.
    return sums.select("id", (F.row_number().over(Window.orderBy(F.desc("n"), "id")) - 1).alias("rank"))


def write_file(store: fs.FileSystem, path: str, first: int, doc_ids: list, counts: np.ndarray, ids: np.ndarray) -> None:
    """Header, ids of the documents, their token counts, control bytes, data bytes. Appears under its name whole."""
    control, data = encode(ids)
    head = np.array([len(doc_ids), len(ids), len(control), first], "<i8").tobytes()
    present = np.array([x is not None for x in doc_ids], np.uint8).tobytes()
    keys = np.array([x or 0 for x in doc_ids], "<i8").tobytes()
    own = f"{path}.{TaskContext.get().taskAttemptId()}.tmp" if TaskContext.get() else f"{path}.tmp"
    with store.open_output_stream(own) as out:
        for piece in (MAGIC, head, present, keys, counts.astype("<i8").tobytes(), control, data):
            out.write(piece)
    store.move(own, path)


def read_file(content: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """Document ids, token counts and ranks of `write_file`."""
    if content[:8] != MAGIC:
        raise ValueError("not a token file")
    docs, n, controls, _ = np.frombuffer(content, "<i8", 4, 8).tolist()
    at = 40
    present = np.frombuffer(content, np.uint8, docs, at)
    keys = np.frombuffer(content, "<i8", docs, at + docs).tolist()
    counts = np.frombuffer(content, "<i8", docs, at + 9 * docs)
    at += 17 * docs
    ids = decode(content[at : at + controls], content[at + controls :], n)
    return [k if p else None for k, p in zip(keys, present)], counts, ids


def write_tokens(tokens: DataFrame, kind: str, ranking: DataFrame, uri: str) -> DataFrame:
    """Write `tokens` to files in ascending order of doc_id (null first; equal ids by their tokens).

    Returns the manifest: `part`, `file`, `path`, `n_tokens`. `ranking` holds one row per vocabulary id and goes to the
    tasks whole; its size doesn't depend on the documents.
    """
    spark = tokens.sparkSession
    order = [int(r.id) for r in ranking.orderBy("rank").collect()]
    to_rank = np.zeros(max(order, default=0) + 1, np.uint32)
    to_rank[order] = np.arange(len(order), dtype=np.uint32)
    shared = spark.sparkContext.broadcast(to_rank)

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)
        store.create_dir(folder, recursive=True)
        part, file = TaskContext.get().partitionId(), 0
        doc_ids, counts, ids, size = [], [], [], 0
        out = []

        def close():
            nonlocal file, doc_ids, counts, ids, size
            name = f"part-{part:06d}-{file:06d}.tok"
            write_file(store, f"{folder}/{name}", part, doc_ids, np.array(counts, np.int64), np.concatenate(ids))
            out.append((part, file, name, size))
            file, doc_ids, counts, ids, size = file + 1, [], [], [], 0

        for batch in batches:
            for doc_id, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                raw = np.frombuffer(blob, kind)
                doc_ids.append(doc_id)
                counts.append(len(raw))
                ids.append(shared.value[raw])
                size += len(raw)
                if size >= FILE_TOKENS:
                    close()
        if doc_ids:
            close()
        columns = list(zip(*out)) if out else [[], [], [], []]
        kinds = (pa.int32(), pa.int32(), pa.string(), pa.int64())
        yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], ["part", "file", "path", "n_tokens"])

    ranged = tokens.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "tokens")
    return saved(ranged.mapInArrow(written, "part int, file int, path string, n_tokens long"))


def read_tokens(manifest: DataFrame, ranking: DataFrame, uri: str) -> DataFrame:
    """`doc_id`, `start`, `n_tokens`, `ids_crc32` from the files named in `manifest`.

    `start` adds the tokens of all earlier files; the running sum is over one row per file.
    """
    spark = manifest.sparkSession
    order = np.array([int(r.id) for r in ranking.orderBy("rank").collect()], "<u4")
    shared = spark.sparkContext.broadcast(order)

    def digests(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                doc_ids, counts, found = read_file(bytes(content))
                raw = shared.value[found].tobytes() if len(found) else b""
                stop = np.cumsum(counts)
                crc = [zlib.crc32(raw[4 * (b - n) : 4 * b]) for b, n in zip(stop.tolist(), counts.tolist())]
                yield pd.DataFrame(
                    {
                        "path": path.rsplit("/", 1)[1],
                        "doc_id": pd.array(doc_ids, "Int64"),
                        "before": stop - counts,
                        "n_tokens": counts,
                        "ids_crc32": np.array(crc, np.int64),
                    }
                )

    if manifest.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tok").load(uri).select("path", "content")
    rows = files.mapInPandas(digests, "path string, doc_id long, before long, n_tokens long, ids_crc32 long")
    earlier = Window.orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = manifest.select("path", F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0)).alias("offset"))
    return rows.join(offsets, "path").select("doc_id", (F.col("offset") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def token_table(docs: DataFrame, path: str, end_id: int = 2, by_word: bool | None = None) -> DataFrame:
    """Encode `docs`, write the token files, read them back.

    A null text is empty and holds only the end id. An empty table writes no file and returns no row. Repeated ids
    keep all their rows. Only `doc_id` and `text` are read; other columns are left aside. The token ids are kept once
    in a table between counting and writing, so texts are encoded once.
    """
    kind = id_type(path)
    tokens = saved(tokenized(docs, path, end_id, by_word))
    ranking = saved(ranks(tokens, kind))
    uri = shared_dir(docs.sparkSession)
    return read_tokens(write_tokens(tokens, kind, ranking, uri), ranking, uri)
