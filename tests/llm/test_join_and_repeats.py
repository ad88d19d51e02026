"""Operators on groups of documents against brute force: Jaccard join, repeated strings, decontamination."""

import hashlib
import random
import time
import tracemalloc
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from burnish.llm import jaccard_join, queries, repeats
from burnish.llm.common import components, shingles, texts
from burnish.llm.decontaminate import contaminated, contamination_table, decontaminated
from burnish.llm.jaccard_join import jaccard_components, one_of_each
from tests.conftest import TESTDATA

SCHEMA = "doc_id long, text string"


def documents(sf):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{TESTDATA}/{sf}/documents.parquet'").fetchall()
    return [(k, t) for k, t in rows]


def sorted_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def plain_components(rows, size, num, den):
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append(frozenset(zip(*[w[k:] for k in range(size)])) if len(w) >= size else frozenset([tuple(w)] if w else []))
    parent = list(range(len(rows)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    holders = defaultdict(list)
    for k, s in enumerate(sets):
        for t in s:
            holders[t].append(k)
    for k, s in enumerate(sets):
        for j, common in Counter(j for t in s for j in holders[t] if j < k).items():
            if den * common >= num * (len(s) + len(sets[j]) - common):
                parent[find(k)] = find(j)
    lowest = {}
    for k, (doc_id, _) in enumerate(rows):
        lowest[find(k)] = min(lowest.get(find(k), doc_id), doc_id)
    return sorted(((d, len(s), lowest[find(k)]) for k, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def near_copies(seed=3):
    rng, rows = random.Random(seed), []
    for _ in range(70):
        n = rng.choice([3, 4, 5, 8, 10, 12, 15, 20, 30, 60, 200, 500])
        base = [rng.choice("abcdefghij") + rng.choice("xyzuvw") + rng.choice("12345") for _ in range(n)]
        for _ in range(rng.choice([1, 3, 12])):
            text = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, n // 50, n // 25])):
                text[rng.randrange(n)] = rng.choice(["zz", "qq", "a"])
            if rng.random() < 0.3:
                text = text[: int(len(text) * 0.93) + 1]
            rows.append((len(rows), " ".join(text)))
    n = len(rows)
    return rows + [(n, None), (n + 1, ""), (n + 2, " \n"), (n + 3, "a"), (n + 4, "A"), (n + 5, "a b"), (n + 6, "b a")]


@pytest.mark.parametrize("size, num, den", [(4, 85, 100), (2, 50, 100)])
def test_jaccard_components(spark, size, num, den):
    rows = near_copies()
    found = jaccard_components(spark.createDataFrame(rows, SCHEMA), size, num, den)
    assert sorted_rows(found.select("doc_id", "n_shingles", "component_id")) == plain_components(rows, size, num, den)


def test_jaccard_query(spark):
    found = queries.QUERIES["op3_jaccard_join"](spark, f"{TESTDATA}/sf0.001")
    assert sorted_rows(found) == plain_components(documents("sf0.001"), 4, 85, 100)


@pytest.mark.parametrize("paired", [1, 3])
def test_sets_that_meet_in_number(spark, monkeypatch, paired):
    monkeypatch.setattr(jaccard_join, "PAIRED", paired)
    rows = near_copies(5)
    found = jaccard_components(spark.createDataFrame(rows, SCHEMA), 4, 85, 100)
    assert sorted_rows(found.select("doc_id", "n_shingles", "component_id")) == plain_components(rows, 4, 85, 100)


def chain_of_passages():
    """Pairs of like documents, too far apart for a link; a fourth of each is in the documents of the next pair, too."""
    rng, rows = random.Random(8), []
    words = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    passages = [words(75) for _ in range(41)]
    for k in range(40):
        own = words(150)
        other = [rng.choice("xyz") if j % 14 == 7 else w for j, w in enumerate(own)]
        rows += [(2 * k + j, " ".join(x + passages[k] + passages[k + 1])) for j, x in enumerate((own, other))]
    return rows


def test_chance_companies_make_no_groups(spark, monkeypatch):
    groups, blocks = [], jaccard_join.links_in_blocks

    def watched(apart, sets, plan):
        edges = apart.select(F.col("fp").alias("a"), F.col("low").alias("b"))
        groups.extend(r["count"] for r in components(edges).groupBy("component").count().collect())
        return blocks(apart, sets, plan)

    monkeypatch.setattr(jaccard_join, "links_in_blocks", watched)
    rows = chain_of_passages()
    found = jaccard_components(spark.createDataFrame(rows, SCHEMA), 4, 85, 100)
    assert sorted_rows(found.select("doc_id", "n_shingles", "component_id")) == plain_components(rows, 4, 85, 100)
    assert len(groups) > 30 and max(groups) == 2


def test_large_batches_take_little_memory():
    rng = random.Random(4)
    rows = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(50_000)) if k % 2 else f"a b c d e {k}" for k in range(12)]
    part = pa.record_batch([pa.array(range(12), pa.int64()), pa.array(rows)], ["doc_id", "text"])
    most, found = [], []
    for shingled in (lambda: jaccard_join._shingles_in_steps(part, 5), lambda: shingles(texts(part), 5)):
        tracemalloc.start()
        found.append(shingled())
        most.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert all((a == b).all() for a, b in zip(*found))
    assert most[0] < most[1] / 1.5


def test_shuffles_of_finished_steps_go(spark, monkeypatch):
    known = spark.sparkContext._jsc.sc().env().mapOutputTracker().shuffleStatuses()
    shuffles = lambda: set(known.keySet().mkString(",").split(",")) - {""}
    before, left, blocks = shuffles(), [], jaccard_join.links_in_blocks

    def watched(*args):
        end = time.time() + 20
        while shuffles() - before and time.time() < end:
            time.sleep(0.2)
        left.append(shuffles() - before)
        return blocks(*args)

    monkeypatch.setattr(jaccard_join, "links_in_blocks", watched)
    jaccard_components(spark.createDataFrame(near_copies(), SCHEMA))
    assert left == [set()]


def test_one_of_each_keeps_rows_apart(spark):
    same = "a b c d e f"
    rows = [(1, same), (1, same), (1, "x y z one two"), (2, None), (2, None), (None, same), (3, same)]
    df = spark.createDataFrame([(*r, "q") for r in rows], SCHEMA + ", fp string")
    assert sorted_rows(one_of_each(df)) == sorted(
        [(1, same, "q"), (1, "x y z one two", "q"), (2, None, "q"), (2, None, "q"), (None, same, "q")], key=str
    )
    assert one_of_each(df.where("false")).count() == 0


def test_components_of_a_chain(spark):
    links = [(k, k + 1) for k in range(1, 60)] + [(100, 101), (102, 101), (200, 200)]
    found = dict(sorted_rows(components(spark.createDataFrame(links, "a long, b long"))))
    assert found == {**{k: 1 for k in range(1, 61)}, 100: 100, 101: 100, 102: 100}


def plain_repeats(rows):
    raw = [(t or "").encode() for _, t in rows]
    often = Counter(b[i : i + 200] for b in raw for i in range(len(b) - 199))
    out = []
    for (doc_id, _), b in zip(rows, raw):
        change = np.zeros(len(b) + 1, int)
        for i in range(len(b) - 199):
            if often[b[i : i + 200]] > 1:
                change[i] += 1
                change[i + 200] -= 1
        gone = np.cumsum(change)[: len(b)] > 0
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        spans = int((np.diff(np.append(0, gone.astype(int))) == 1).sum())
        out.append((doc_id, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_suffix_order():
    rng = np.random.default_rng(1)
    for _ in range(200):
        s = rng.integers(1, 3, int(rng.integers(1, 60)))
        assert repeats.suffix_order(s).tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())


def test_suffix_order_of_millions_of_names():
    s = np.random.default_rng(2).permutation(5_000_000) + 1
    assert (repeats.suffix_order(s) == np.argsort(s)).all()


def test_strings_of_hot_anchors_meet_one_by_one(spark, monkeypatch):
    rng = random.Random(6)
    passage = "".join(rng.choice("abcdefgh é") for _ in range(260))
    around = lambda: "".join(rng.choice("abcd") for _ in range(150))
    rows = [(k, around() + passage + around()) for k in range(60)]
    rows += [(100, rows[0][1][100:]), (101, rows[1][1]), (102, None), (103, "ab" * 400)]
    monkeypatch.setattr(repeats, "HOT_CONTEXTS", 8)
    split, dealt = [], repeats.decide_hot
    monkeypatch.setattr(repeats, "decide_hot", lambda *a: split.append(dealt(*a)))
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted_rows(repeats.repeat_table(df)) == plain_repeats(rows)
    assert len(split) == 1


def test_repeats(spark):
    rng = random.Random(4)

    def words(n):
        return "".join(rng.choice("abcdefgh é") for _ in range(n))

    shared, rows = [words(rng.randint(150, 900)) for _ in range(12)], []
    for k in range(120):
        text = words(rng.randint(0, 300))
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(shared)
            a = rng.randint(0, len(p) // 2)
            text += p[a : a + rng.randint(100, 900)] + words(rng.randint(0, 60))
        rows.append((k, text))
    rows += [(200, None), (201, ""), (202, "a" * 700), (203, "ab" * 400), (204, "a" * 199), (205, "a" * 200)]
    rows += [(5, rows[5][1]), (None, rows[6][1]), (207, words(300) + "z" * 400)]
    df = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA + ", row long")
    assert sorted_rows(repeats.repeat_table(df)) == plain_repeats(rows)
    assert repeats.repeat_table(df.where("false")).count() == 0


def test_repeats_query(spark):
    found = queries.QUERIES["op5_repeats"](spark, f"{TESTDATA}/sf0.001")
    assert sorted_rows(found) == plain_repeats(documents("sf0.001"))


def test_contamination_query(spark):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{TESTDATA}/sf0.001/{name}.parquet'")
    found = queries.QUERIES["op2_decontamination"](spark, f"{TESTDATA}/sf0.001")
    expected = sorted(con.sql(queries.ORACLE["op2_decontamination"]).fetchall(), key=str)
    assert sorted_rows(found) == expected
    assert any(r[3] for r in expected)


def test_contamination_edges(spark):
    item = " ".join(f"w{k}" for k in range(40))
    rows = [(1, None), (1, "pre " + item.upper() + " post"), (2, ""), (3, "!!!"), (None, item), (4, "One two"), (4, "one")]
    docs = spark.createDataFrame([(*r, 7) for r in rows], SCHEMA + ", item_id long")
    items = spark.createDataFrame([(7, item), (8, None), (9, "!"), (10, "one two"), (None, item)], "item_id long, text string")
    assert sorted_rows(contamination_table(docs, items)) == sorted(
        [(1, 0, "", False), (1, 1, "7", True), (2, 0, "", False), (3, 0, "", False), (None, 1, "7", True)]
        + [(4, 1, "10", True), (4, 0, "", False)],
        key=str,
    )
    clean = [(1, None, 7), (2, "", 7), (3, "!!!", 7), (4, "one", 7)]
    assert sorted_rows(decontaminated(docs, items)) == clean
    assert contaminated(docs.where("false"), items).count() == 0
    assert contamination_table(docs, items.where("false")).where("contaminated").count() == 0
