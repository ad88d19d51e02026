"""Columns whose names clash or hold dots, and very long texts."""

import time

import corpus_pipeline
from burnish.llm.jaccard_join import one_of_each
from burnish.llm.personal_data import personal_data_table, redacted
from tests.conftest import TESTDATA
from tests.llm.test_models_and_text import plain_spans

NAMES = ["_id", "_hash", "_added", "_worded", "_language", "_decoded", "a.b", "lang_pred", "score", "row", "words"]
SF = f"{TESTDATA}/sf0.001"


def documents(spark):
    rows = [(k, f"the word of number {k} is to be found by mail to a{k}@example.org or so", "en", "x", 1) for k in range(20)]
    rows += [rows[3], (None, None, None, "x", 1), (50, "", "de", "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return docs.selectExpr("*", *(f"concat('{n}', doc_id) AS `{n}`" for n in NAMES))


def test_stages_leave_columns_of_any_name_alone(spark):
    docs = documents(spark)
    before = {r.doc_id: r for r in docs.collect()}
    for _, stage in corpus_pipeline.STAGES:
        rows = stage(spark, docs, SF).collect()
        assert len(rows) >= 20
        for r in rows:
            assert all(r[n] == before[r.doc_id][n] for n in NAMES)


def test_rows_that_differ_elsewhere(spark):
    one = "a b c d e f g h"
    df = spark.createDataFrame([(1, one, "z"), (1, one, "y"), (2, one, "x"), (1, "", "w"), (1, "", "w")], "doc_id long, text string, _worded string")
    for _ in range(3):
        found = sorted((r.text, r._worded) for r in one_of_each(df.repartition(3)).collect())
        assert found == [("", "w"), ("", "w"), (one, "y")]


def test_redaction_keeps_names(spark):
    out = redacted(documents(spark))
    assert out.columns == documents(spark).columns
    assert out.where("doc_id = 3").first().text == "the word of number 3 is to be found by mail to [EMAIL] or so"


def test_texts_of_very_many_candidates(spark):
    text = " ".join(f"n{k}x" if k % 5 else f"item {k} at" for k in range(100_000)) + " mail a@b.org end +49 170 1234567"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    start = time.perf_counter()
    found = personal_data_table(df).first()
    assert time.perf_counter() - start < 90
    assert tuple(found)[1:6] == plain_spans(text)
