import random

import pytest

from burnish import operators as op
from burnish.rules import CATEGORY_TERMS, DIGIT_LETTERS, PAYMENT_RULES, STATUS_RULES, Synonyms


def mapped(spark, values, **kwargs):
    df = spark.createDataFrame([(v,) for v in values], "c string")
    kwargs.setdefault("vocabulary", CATEGORY_TERMS)
    return [r[1] for r in op.canonicalize_terms(df, "c", out="t", **kwargs).collect()]


def test_categories(spark):
    cases = {
        "3l3ctronics": "electronics", "hom": "home", "HOME ": "home", "ki": None, "8eauty": None, "": None,
        None: None, "clothing_": "clothing", " -toys- ": "toys", "5p0rts": "sports", "homes": None, "e-lec": "electronics",
        "ele": "electronics", "\tkit\n": "kitchen", "b3Aut": "beauty", "家home": "home", "4ut0": "automotive",
    }
    assert mapped(spark, cases) == list(cases.values())


def test_last_listed_term_wins(spark):
    with pytest.warns(UserWarning, match="car.*cargo.*carpet"):
        found = mapped(spark, ["car", "cargo", "carp"], vocabulary=["cargo", "carpet", "car"])
    assert found == ["car", "cargo", "carpet"]
    with pytest.warns(UserWarning, match="shared prefixes"):
        assert mapped(spark, ["car"], vocabulary=["car", "cargo"]) == ["cargo"]
    assert op.colliding_terms(["cargo", "carpet"]) == {"car": ["cargo", "carpet"]}
    assert op.colliding_terms(CATEGORY_TERMS) == {}


def test_short_terms_match_only_whole(spark):
    assert mapped(spark, ["t", "tv"], vocabulary=["tv"]) == [None, "tv"]
    assert mapped(spark, ["to"], min_prefix=2) == ["toys"]
    assert mapped(spark, ["a"], vocabulary=[]) == [None]


@pytest.mark.parametrize("threshold", ["10MB", "-1"])
def test_table_and_list_agree_with_brute_force(spark, conf, threshold):
    conf("spark.sql.autoBroadcastJoinThreshold", threshold)
    rng = random.Random(1)
    terms = sorted({"".join(rng.choices("abe", k=rng.randint(1, 7))) for _ in range(60)})
    rng.shuffle(terms)
    texts = ["".join(rng.choices("aAbe3_- ", k=rng.randint(0, 6))) for _ in range(400)] + [None, "ab"] * 50

    def expected(text):
        if text is None:
            return None
        letters = "".join(DIGIT_LETTERS.get(c, c) for c in text.lower())
        key = "".join(c for c in letters if c.isascii() and c.isalpha())
        fits = [t for t in terms if t == key or (len(key) >= 3 and t.startswith(key))]
        return fits[-1] if fits else None

    df = spark.createDataFrame(list(enumerate(texts)), "id int, c string")
    words = spark.createDataFrame(list(enumerate(terms)), "pos int, term string")
    with pytest.warns(UserWarning):
        by_list = op.canonicalize_terms(df, "c", terms, out="t")
    by_table = op.canonicalize_terms_from(df, "c", words, "term", position="pos", out="t")
    want = {(i, text, expected(text)) for i, text in enumerate(texts)}
    assert {tuple(r) for r in by_list.collect()} == want
    assert {tuple(r) for r in by_table.collect()} == want
    assert by_table.count() == len(texts)


def test_ambiguous_prefixes(spark):
    words = spark.createDataFrame([("cargo",), ("carpet",), ("toys",), ("toys",), (None,)], "w string")
    assert [tuple(r) for r in op.ambiguous_prefixes(words, "w").collect()] == [("car", 2)]


def test_payments(spark):
    cases = {
        "C.D.": "card", "e-WALL": "wallet", "CASH!": "cash", "bitcoin": None, " upi ": "upi", "crad": "card",
        "cardx": None, "Wallet card": "wallet", "": None, None: None,
    }
    df = spark.createDataFrame([(v,) for v in cases], "p string")
    found = op.map_synonyms(df, "p", PAYMENT_RULES, letters=True, out="c")
    assert [r.c for r in found.collect()] == list(cases.values())


def test_statuses_keep_punctuation(spark):
    cases = {"SUC ": "success", "fail!": None, "Refunded": "refunded", "failed": "failed", "re f": None, None: None}
    df = spark.createDataFrame([(v,) for v in cases], "s string")
    found = op.map_synonyms(df, "s", STATUS_RULES, letters=False, out="c")
    assert [r.c for r in found.collect()] == list(cases.values())


def test_first_rule_wins(spark):
    rules = [Synonyms("a", contains=("x",)), Synonyms("b", equals=("xy",))]
    df = spark.createDataFrame([("xy",)], "s string")
    assert op.map_synonyms(df, "s", rules, letters=True, out="c").first().c == "a"
    assert op.map_synonyms(df, "s", rules[::-1], letters=True, out="c").first().c == "b"
    for nothing in ([], [Synonyms("a")]):
        assert op.map_synonyms(df, "s", nothing, letters=True, out="c").first().c is None


def test_substitutions_are_single_characters(spark):
    with pytest.raises(ValueError):
        mapped(spark, ["x"], substitutions={"ph": "f"})


def test_flag_unmapped(spark):
    df = spark.createDataFrame([(None,), ("a",)], "c string")
    assert [r.m for r in op.flag_unmapped(df, "c", "m").collect()] == [True, False]
