"""The pipeline's stages, each on its own input, against plain versions."""

import re

import pytest

import corpus_pipeline
from burnish.llm.common import saved
from tests.conftest import TESTDATA
from tests.llm.test_join_and_repeats import plain_components
from tests.llm.test_models_and_text import plain_spans

SF = f"{TESTDATA}/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    out.append(docs)
    for _, stage in corpus_pipeline.STAGES:
        out.append(saved(stage(spark, out[-1], SF)))
    return out


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_all_but_the_last_return_the_columns_of_documents(steps):
    assert [df.columns for df in steps[:-1]] == [steps[0].columns] * 5
    assert steps[-1].columns[: len(steps[0].columns)] == steps[0].columns


def test_language_id_keeps_texts_with_letters(steps):
    assert ids(steps[1]) == sorted(r.doc_id for r in steps[0].collect() if r.text and re.search(r"[^\W\d_]", r.text))


def test_one_document_of_each_group_stays(steps):
    rows = [(r.doc_id, r.text) for r in steps[1].collect()]
    assert ids(steps[2]) == sorted(d for d, n, c in plain_components(rows, 5, 80, 100) if d == c or not n)


def test_documents_with_benchmark_items_go(spark, steps):
    def shingles(text):
        w = re.findall(r"[^\W_]+", text.lower())
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    items = [shingles(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = []
    for r in steps[2].collect():
        own = shingles(r.text or "")
        if not any(i and 5 * len(i & own) >= 4 * len(i) for i in items):
            clean.append(r.doc_id)
    assert ids(steps[3]) == sorted(clean)
    assert len(clean) < steps[2].count()


def test_personal_data_is_gone_and_documents_stay(steps):
    before = {r.doc_id: r.text for r in steps[3].collect()}
    after = {r.doc_id: r for r in steps[4].collect()}
    assert before.keys() == after.keys()
    for k, text in before.items():
        if any(plain_spans(text)[:4]):
            assert not any(plain_spans(after[k].text)[:4])
        else:
            assert after[k].text == text
        assert after[k].n_chars == len(after[k].text)


def test_pieces_decode_to_the_text(steps):
    rows = steps[5].collect()
    assert len(rows) == steps[4].count()
    assert all(r.round_trip and r.n_pieces == len(r.piece_ids) for r in rows)


def test_run(spark, steps):
    assert ids(corpus_pipeline.run(spark, SF)) == ids(steps[5])


def test_empty_table(spark, steps):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, steps[0].where("false"), SF).count() == 0
