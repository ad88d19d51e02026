"""Language identification by cross-parsing.

One suffix automaton per language holds every substring of a labelled sample. A text is parsed against each of them:
a phrase is the longest match with the automaton, then the next one begins. The language whose automaton needs the
fewest phrases for the length of the text is the prediction.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from burnish.llm.common import held, map_rows, remainder, slices

SAMPLE_CHARS = 60_000  # labelled characters that are learned from for each language
SAMPLE_ROWS = 120  # labelled texts of a language that reach the driver at the most
USUAL_CHARS = 4_000  # texts up to this length come first into the sample
SEGMENT = 256  # phrases end at multiples of this many bytes
LANES = 1 << 18  # segments that one step of the parse moves on together
UNDECIDED = "und"
NO_LETTERS = re.compile(r"[\W\d_]+")
BLANK = 0x20


def sample_texts(docs: DataFrame, chars: int = SAMPLE_CHARS, rows: int = SAMPLE_ROWS) -> dict[str, str]:
    """For each language: distinct labelled texts in the order of a hash of their ids, until `chars` are reached.

    This bounded sample fits the classifier; a task hands on at most `rows` texts of a language. Of a text that is
    longer than the whole sample may be, four times `chars` reach the driver, and of all texts of a language together
    not much more.
    """
    limit = 4 * chars
    labelled = docs.where("lang is not null and text is not null").select(
        "lang", (F.length("text") > USUAL_CHARS).alias("long"), F.xxhash64("doc_id").alias("h"), F.left("text", F.lit(limit)).alias("text")
    )
    order = Window.partitionBy("lang").orderBy("long", "h", "text")
    first = labelled.withColumn("at", F.row_number().over(order)).where(F.col("at") <= rows)
    before = F.coalesce(F.sum(F.length("text")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = first.withColumn("before", before).where(F.col("before") < limit)
    out: dict[str, str] = {}
    seen = set()
    for r in sorted(first.collect(), key=lambda r: (r.lang, r.at)):
        if len(out.setdefault(r.lang, "")) < chars and (r.lang, r.text) not in seen:
            seen.add((r.lang, r.text))
            out[r.lang] = (out[r.lang] + " " + " ".join(NO_LETTERS.sub(" ", r.text.lower()).split()))[:chars]
    return {k: v for k, v in out.items() if v.strip()}


def suffix_automaton(text: list[int], symbols: int) -> np.ndarray:
    """Transitions (state x symbol) of the smallest automaton of all substrings; 0 is the root, -1 is no way on."""
    follow: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        state, at = len(follow), last
        follow.append({})
        link.append(0)
        length.append(length[last] + 1)
        while at != -1 and c not in follow[at]:
            follow[at][c] = state
            at = link[at]
        if at != -1:
            to = follow[at][c]
            if length[at] + 1 == length[to]:
                link[state] = to
            else:
                copy = len(follow)
                follow.append(dict(follow[to]))
                link.append(link[to])
                length.append(length[at] + 1)
                while at != -1 and follow[at].get(c) == to:
                    follow[at][c] = copy
                    at = link[at]
                link[to] = link[state] = copy
        last = state
    table = np.full((len(follow), symbols), -1, np.int32)
    for state, ways in enumerate(follow):
        for c, to in ways.items():
            table[state, c] = to
    return table


class CrossParser:
    """Automata of all languages over the UTF-8 bytes of lower-case letters, and the number of phrases of texts.

    Bytes make letters of any script symbols of one small alphabet. Each automaton knows the bytes of its own sample; a
    byte that it lacks is a phrase of its own.
    """

    def __init__(self, samples: dict[str, str]):
        self.languages = sorted(samples)
        # Anything but letters reads as a blank, upper case as lower case.
        self.lower = np.full(0x110000, BLANK, np.uint32)
        for c in range(0x110000):
            if chr(c).isalpha():
                low = chr(c).lower()
                self.lower[c] = ord(low) if len(low) == 1 else c
        # A phrase costs the bits of a place in the sample.
        self.bits = np.log2([max(2, len(samples[x])) for x in self.languages])
        self.symbols, self.tables = [], []
        for lang in self.languages:
            text = np.frombuffer(samples[lang].encode("utf-8", "replace"), np.uint8)
            seen = np.unique(text)
            symbol = np.full(256, len(seen), np.uint8)
            symbol[seen] = np.arange(len(seen))
            table = suffix_automaton(symbol[text].tolist(), len(seen) + 1)
            # One more state that no byte leads on from: after a byte that the sample lacks.
            table = np.vstack([table, np.full(len(seen) + 1, -1, np.int32)])
            self.symbols.append(symbol)
            self.tables.append(table)

    def letters(self, codes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes of the letters of all texts in a row, runs of anything else as one blank, and bytes by text."""
        text, doc = self.lower[codes], np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        keep = np.ones(len(text), dtype=bool)
        keep[1:] = (text[1:] != BLANK) | (text[:-1] != BLANK) | (doc[1:] != doc[:-1])
        text, doc = text[keep], doc[keep]
        width = 1 + (text >= 0x80) + (text >= 0x800) + (text >= 0x10000)
        raw = text.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
        return np.frombuffer(raw, np.uint8), np.bincount(doc, width, len(sizes)).astype(np.int64)

    def phrases(self, codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Phrases (text x language); `codes` holds the code points of all texts in a row.

        A phrase is the longest match from its first byte on; it ends at multiples of SEGMENT bytes, too, so that a long
        text is parsed in many places at once. That adds at most one phrase a segment to every language alike.
        """
        text, sizes = self.letters(codes, sizes)
        out = np.zeros((len(sizes), len(self.languages)), np.int64)
        parts = (sizes + SEGMENT - 1) // SEGMENT
        doc = np.repeat(np.arange(len(sizes)), parts)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)
        start = (np.cumsum(sizes) - sizes)[doc] + nth * SEGMENT
        length = np.minimum(sizes[doc] - nth * SEGMENT, SEGMENT)
        order = np.argsort(-length, kind="stable")
        doc, start, length = doc[order], start[order], length[order]
        for lo in range(0, len(doc), LANES):
            d, s, n = doc[lo : lo + LANES], start[lo : lo + LANES], length[lo : lo + LANES]
            live = np.searchsorted(-n, -np.arange(SEGMENT), "left")  # lanes longer than the step
            for k, (symbol, table) in enumerate(zip(self.symbols, self.tables)):
                flat, width = table.ravel(), table.shape[1]
                root = np.where(table[0] < 0, len(table) - 1, table[0])
                own = symbol[text]
                state = np.zeros(len(d), np.int32)
                count = np.ones(len(d), np.int32)
                for step in range(int(n[0]) if len(n) else 0):
                    m = live[step]
                    c = own[s[:m] + step]
                    to = flat[state[:m] * width + c]
                    lost = np.flatnonzero(to < 0)
                    if len(lost):
                        if step:
                            count[lost] += 1
                        to[lost] = root[c[lost]]
                    state[:m] = to
                np.add.at(out[:, k], d, count)
        return out


def identify_language(
    docs: DataFrame, samples: dict[str, str], text: str = "text", lang: str = "lang_pred", score: str = "score"
) -> DataFrame:
    """`docs` with the predicted language of `text` and a score from 0 to 1 in new columns, which take the place of
    columns of these names.

    The score is the share of bits that the best language needs less than the second best; 1 with one language alone.
    Only letters and the places between their runs count. Texts that are null or have no letter, and all texts if
    nothing was learned, get `und` and 0. Ties go to the alphabetically first language. Texts are parsed whole; rows and all other columns stay as they are.
    """
    columns = [c for c in docs.columns if c not in (lang, score)]
    at = columns.index(text)
    key = ("languages", hash(tuple(sorted(samples.items()))))

    def identified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held(key, lambda: CrossParser(samples)) if samples else None
        for part in slices(batches, f"c{at}", model=key):
            column = pc.fill_null(part.column(at).cast(pa.large_string()), "")
            letters = pc.match_substring_regex(column, r"\p{L}").to_numpy(zero_copy_only=False)
            name = np.full(part.num_rows, UNDECIDED, dtype=object)
            value = np.zeros(part.num_rows)
            if model and letters.any():
                sizes = pc.utf8_length(column).to_numpy().astype(np.int64)
                codes = np.frombuffer("".join(column.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32)
                cost = model.phrases(codes, sizes) * model.bits
                best = cost.argmin(axis=1)
                ranked = np.sort(cost, axis=1)
                name[letters] = np.array(model.languages, dtype=object)[best[letters]]
                if len(model.languages) == 1:
                    value[letters] = 1.0
                else:
                    value[letters] = ((ranked[:, 1] - ranked[:, 0]) / np.maximum(ranked[:, 1], 1e-9))[letters]
            found = [pa.array(name, pa.string()), pa.array(value, pa.float64())]
            yield pa.record_batch([*part.columns, *found], [*part.schema.names, "lang", "score"])

    known = map_rows(docs, columns, identified, "lang string, score double")
    return known.toDF(*columns, lang, score)


def language_table(docs: DataFrame) -> DataFrame:
    """`doc_id`, `held_out`, `lang_pred`, `score` of every document; learned from those that aren't held out."""
    held_out = remainder("doc_id", 4) == 2
    samples = sample_texts(docs.where(~F.coalesce(held_out, F.lit(False))))
    rows = docs.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "text")
    return identify_language(rows, samples).drop("text")
