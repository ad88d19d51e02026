"""Runs, packing and collocations against brute force, SQL and the tokenizer's library."""

import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

from burnish.llm import collocations as phrases
from burnish.llm import packing, queries
from burnish.llm.periodic_runs import WaveletTree, find_runs, runs_table, with_runs
from burnish.llm.queries import tokenizer_file
from tests.conftest import TESTDATA
from tests.llm.test_models_and_text import nasty_texts

SCHEMA = "doc_id long, text string, lang string"


def sql_rows(sql, rows=None, sf=None):
    con = duckdb.connect()
    if sf:
        con.sql(f"CREATE VIEW documents AS SELECT * FROM '{TESTDATA}/{sf}/documents.parquet'")
    else:
        con.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR)")
        if rows:
            con.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    result = con.sql(sql)
    return result.columns, Counter(result.fetchall())


def spark_rows(df, columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


# Runs


def plain_runs(w, least=6, repeats=4):
    found = {}
    for q in range(1, len(w) // repeats + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, repeats * q):
                found.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted(((i, n, q) for (i, n), q in found.items()), key=lambda r: (r[0], r[2]))


def periodic_words(rng):
    k, w = rng.randint(1, 4), []
    for _ in range(rng.randint(0, 6)):
        w += [rng.randint(0, k) for _ in range(rng.randint(1, 9))] * rng.randint(1, 7)
        w += [rng.randint(0, k) for _ in range(rng.randint(0, 5))]
    return w


def test_runs_against_brute_force():
    rng = random.Random(5)
    for _ in range(300):
        docs = [periodic_words(rng) for _ in range(rng.randint(0, 5))]
        got = find_runs(np.array([x for d in docs for x in d], np.int64), np.array([len(d) for d in docs], np.int64))
        assert [tuple(r) for r in got.tolist()] == [(k, *r) for k, d in enumerate(docs) for r in plain_runs(d)]


def test_runs_of_other_lengths():
    w = [1, 2] * 9 + [3] * 5 + [4, 5, 6] * 5
    for least, repeats in ((4, 4), (6, 5), (16, 4)):
        got = find_runs(np.array(w), np.array([len(w)]), least, repeats)
        assert [tuple(r[1:]) for r in got.tolist()] == plain_runs(w, least, repeats)
    with pytest.raises(ValueError):
        find_runs(np.array(w), np.array([len(w)]), 6, 3)


def test_wavelet_tree():
    rng = np.random.default_rng(3)
    values = rng.integers(0, 50, 200)
    tree = WaveletTree(values)
    low = rng.integers(0, 200, 500)
    high = low + rng.integers(1, 60, 500).clip(max=200 - low)
    for a, b, v in zip(low, high, rng.integers(0, 50, 500)):
        part = np.sort(values[a:b])
        assert tree.smaller(np.array([a]), np.array([b]), np.array([v]))[0] == (part < v).sum()
        for n in (0, len(part) - 1):
            assert tree.nth(np.array([a]), np.array([b]), np.array([n]))[0] == part[n]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_run_query_against_sql(spark, sf):
    columns, expected = sql_rows(queries.ORACLE["op11_periodic_runs"], sf=sf)
    got = queries.QUERIES["op11_periodic_runs"](spark, f"{TESTDATA}/{sf}")
    assert sorted(got.columns) == sorted(columns)
    assert spark_rows(got, columns) == expected


def test_runs_of_odd_rows(spark):
    rng = random.Random(2)
    rows = [(k, " ".join(f"w{x}" for x in periodic_words(rng)), None) for k in range(60)]
    rows += [(100, None, None), (101, "", "de"), (102, " \t\n\x0b ", None), (103, "a a a\tA\x0ba " * 9, None), (104, "É É　É " * 30, "fr")]
    rows += [(105, "x " * 30_000 + "y z " * 9_000, None)]
    columns, expected = sql_rows(queries.ORACLE["op11_periodic_runs"], rows)
    docs = spark.createDataFrame(rows, SCHEMA)
    assert spark_rows(runs_table(docs), columns) == expected
    # Repeated rows repeat their results, other columns stay, clashing ones give way.
    twice = docs.unionByName(docs).selectExpr("*", "1 AS runs", "2 AS `a.b`")
    out = with_runs(twice)
    assert out.columns == ["doc_id", "text", "lang", "a.b", "n_words", "runs", "collapsed"]
    assert out.count() == 2 * len(rows) and out.where("doc_id = 105").first().n_words == 48_000
    assert spark_rows(runs_table(twice), columns) == Counter({k: 2 * n for k, n in expected.items()})
    assert runs_table(docs.where("false")).count() == 0


# Packing


def plain_pieces(rows, capacity, end_id=0):
    tokenizer, out = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json")), []
    for doc_id, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [end_id]
        lead = len(ids) % capacity or capacity
        starts = [0, *range(lead, len(ids), capacity)]
        for piece, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)])):
            out.append((doc_id, piece, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    return Counter(out)


def best_fit(lengths, capacity):
    """Sequences that best fit in descending order needs."""
    gaps, opened = Counter(), 0
    for n in sorted(lengths, reverse=True):
        gap = min((g for g in gaps if g >= n), default=None)
        if gap is None:
            gap, opened = capacity, opened + 1
        else:
            gaps[gap] -= 1
            gaps += Counter()
        if gap > n:
            gaps[gap - n] += 1
    return opened


def sequences(rows, capacity):
    """Checks that pieces lie side by side from 0, and counts the sequences."""
    held = {}
    for r in rows:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(held)


@pytest.mark.parametrize("capacity", [2048, 40])
def test_packed_documents(spark, capacity):
    texts = [*nasty_texts(300), "", None, "a b\n\nc", "one two\nthree's  four", " x", "x ", "<|endoftext|> a", "word " * 5000]
    rows = [(k % 250, t, None) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS length", "2 AS sequence_id")
    out = packing.packing_table(docs, tokenizer_file("byte_bpe_50k.json"), capacity).collect()
    got = Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out)
    assert got == plain_pieces([r[:2] for r in rows], capacity)
    assert sequences(out, capacity) <= 1.01 * best_fit([r.length for r in out], capacity) + 1


def lengths_of(kind, rng):
    return {
        "mixed": [rng.randint(1, 2047) for _ in range(3000)],
        "one length": [700] * 2000,
        "short": [rng.randint(1, 40) for _ in range(5000)],
        "long": [rng.randint(1000, 2048) for _ in range(900)],
        "third": [rng.choice([683, 683, 682, 1400, 30]) for _ in range(2000)],
    }[kind]


@pytest.mark.parametrize("kind", ["mixed", "one length", "short", "long", "third"])
def test_few_sequences(spark, kind):
    lengths = lengths_of(kind, random.Random(4))
    df = spark.createDataFrame([(k, 0, n) for k, n in enumerate(lengths)], "doc_id long, piece int, length long")
    rows = packing.pack(df).collect()
    assert Counter((r.doc_id, r.length) for r in rows) == Counter(enumerate(lengths))
    assert sequences(rows, 2048) <= 1.01 * best_fit(lengths, 2048) + 1


def test_nothing_to_pack(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert packing.packing_table(empty, tokenizer_file("byte_bpe_50k.json")).collect() == []


def test_packing_query(spark):
    out = queries.QUERIES["op12_packing"](spark, f"{TESTDATA}/sf0.001").collect()
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{TESTDATA}/sf0.001/documents.parquet'").fetchall()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == plain_pieces(rows, 2048)
    assert sequences(out, 2048) <= 1.01 * best_fit([r.length for r in out], 2048) + 1


# Collocations


def plain_counts(words, depth):
    pieces, piece = [], []
    for w in [*words, 0]:
        if w:
            piece.append(w)
        else:
            pieces.append(piece)
            piece = []
    count, left, right = Counter(), Counter(), Counter()
    for p in pieces:
        for i in range(len(p) - depth + 1):
            gram = tuple(p[i : i + depth])
            count[gram] += 1
            left[gram] += i > 0
            right[gram] += i + depth < len(p)
    return {g: (n, left[g], right[g]) for g, n in count.items()}


@pytest.mark.parametrize("depth", [2, 3, 4])
def test_index_counts_phrases(depth):
    rng = np.random.default_rng(depth)
    for n, kinds in ((0, 3), (1, 2), (400, 3), (400, 12)):
        text = np.concatenate([[0], rng.integers(0, kinds, n), [0]]).astype(np.int64)
        parts, numbers = phrases.shard_phrases(text, rng.integers(0, 2**63, kinds).astype(np.uint64), depth, None, sides=True)
        got = {tuple(int(x) for x in g): tuple(int(x) for x in v) for *g, v in zip(*parts, list(zip(*numbers)))}
        assert got == plain_counts(text.tolist(), depth)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_collocation_query_against_sql(spark, sf):
    columns, expected = sql_rows(queries.ORACLE["op13_collocations"], sf=sf)
    got = queries.QUERIES["op13_collocations"](spark, f"{TESTDATA}/{sf}")
    assert sorted(got.columns) == sorted(columns)
    assert spark_rows(got, columns) == expected


def collocation_texts():
    rng = random.Random(8)
    vocabulary = ["New", "york", "city", "É", "of", "the", "a b", "x-y", "\x00"]
    rows = []
    for k in range(400):
        words = []
        for _ in range(rng.randint(0, 30)):
            words += rng.choice([["new", "York"], ["the", "city", "of", "new", "york"], [rng.choice(vocabulary)]])
            words.append(rng.choice(["", "", "", "\t", ".", ";x", "\n", "\x0b"]))
        rows.append((k, " ".join(words), rng.choice(["en", None, "und", "de"])))
    return rows + [(1, None, "en"), (1, "", None), (2, " . ; \t", "fr"), (3, "the the the the " * 100, "en"), (3, "q " * 20_000, "la")]


@pytest.mark.parametrize("bits,shard", [(1 << 27, 8 << 20), (phrases.CHUNK, 300)])
def test_collocations_of_odd_rows(spark, monkeypatch, bits, shard):
    monkeypatch.setattr(phrases, "FILTER_BITS", bits)
    monkeypatch.setattr(phrases.phrase_counts, "__defaults__", (shard, False))
    rows = collocation_texts()
    columns, expected = sql_rows(queries.ORACLE["op13_collocations"], rows)
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS phrase", "2 AS count")
    assert sum(expected.values()) > 20
    assert spark_rows(phrases.collocations(docs), columns) == expected


def test_a_full_filter_loses_nothing(spark, monkeypatch):
    rows = collocation_texts()
    docs = spark.createDataFrame(rows, SCHEMA)
    expected = spark_rows(phrases.collocations(docs), ["lang", "phrase", "a"])
    monkeypatch.setattr(phrases.Filter, "has", lambda self, value: np.ones(len(value), dtype=bool))
    assert spark_rows(phrases.collocations(docs), ["lang", "phrase", "a"]) == expected


def test_no_collocations(spark):
    assert phrases.collocations(spark.createDataFrame([], SCHEMA)).collect() == []
    assert phrases.collocations(spark.createDataFrame([(1, "a b", None)], SCHEMA)).collect() == []
