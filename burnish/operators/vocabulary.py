"""Map free text to closed vocabularies."""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burnish.functions.terms import closest_term, first_synonym, letters_only, plain_key, term_key, term_prefixes
from burnish.functions.text import named
from burnish.operators.skew import join_without_hot_tasks
from burnish.rules import DIGIT_LETTERS, Synonyms

KEY = "__term_key"


def canonicalize_terms(
    df: DataFrame,
    col: str,
    vocabulary: Sequence[str],
    substitutions: Mapping[str, str] = DIGIT_LETTERS,
    min_prefix: int = 3,
    out: str | None = None,
) -> DataFrame:
    """Replace `col` by the vocabulary word it spells or abbreviates, null when there is none.

    Text and words are compared in the form of `term_key`, so `Hand Tools` is a word like any other; the
    result has the word as it was given. A word without a letter is refused.

    The cleaned key gets a projection of its own, so it is computed once per row and not once per word.
    For vocabularies too long for an expression use `canonicalize_terms_from`. Prefixes that several
    words share are reported as a warning.
    """
    collisions = colliding_terms(vocabulary, min_prefix, substitutions)
    if collisions:
        warnings.warn(f"the last listed term wins for shared prefixes: {collisions}", stacklevel=2)
    return (
        df.withColumn(KEY, term_key(named(col), substitutions))
        .withColumn(out or col, closest_term(F.col(KEY), vocabulary, min_prefix, substitutions))
        .drop(KEY)
    )


def canonicalize_terms_from(
    df: DataFrame,
    col: str,
    vocabulary: DataFrame,
    term: str,
    position: str | None = None,
    substitutions: Mapping[str, str] = DIGIT_LETTERS,
    min_prefix: int = 3,
    out: str | None = None,
    **hot: Any,
) -> DataFrame:
    """`canonicalize_terms` with the words in a table of any length.

    Every word is expanded to its prefixes, which turns the prefix match into an equi-join. A prefix
    shared by several words goes to the one with the highest `position` (default: the word itself). `hot`:
    `share`, `min_rows` and `spread_by` of `join_without_hot_tasks`.
    """
    owner = "__owner"
    prefixes = _expanded(vocabulary, term, position, min_prefix, substitutions).groupBy(KEY).agg(
        F.max_by("term", F.struct("position", "term")).alias(owner)
    )
    keyed = df.withColumn(KEY, term_key(named(col), substitutions))
    matched = join_without_hot_tasks(keyed, prefixes, KEY, KEY, "left", **hot)
    return matched.withColumn(out or col, F.col(owner)).drop(KEY, owner)


def ambiguous_prefixes(
    vocabulary: DataFrame, term: str, min_prefix: int = 3, substitutions: Mapping[str, str] = DIGIT_LETTERS
) -> DataFrame:
    """Prefixes that more than one word claims, with the number of words: check before mapping."""
    return (
        _expanded(vocabulary, term, None, min_prefix, substitutions)
        .groupBy(F.col(KEY).alias("prefix"))
        .agg(F.count_distinct("term").alias("term_count"))
        .where("term_count > 1")
    )


def _expanded(
    vocabulary: DataFrame, term: str, position: str | None, min_prefix: int, substitutions: Mapping[str, str]
) -> DataFrame:
    """Prefixes of the key of each word; a word without a letter fails, since no text could ever match it."""
    key = term_key(named(term), substitutions)
    message = F.concat(F.lit("a vocabulary word has no letter: "), named(term))
    words = vocabulary.where(named(term).isNotNull()).select(
        named(term).alias("term"),
        named(position or term).alias("position"),
        F.when(key == "", F.raise_error(message).cast("string")).otherwise(key).alias("whole"),
    )
    length = F.length("whole")
    lengths = F.sequence(F.least(F.lit(min_prefix), length), length)
    return words.select("term", "position", "whole", F.explode(lengths).alias("n")).select(
        F.left("whole", F.col("n")).alias(KEY), "term", "position"
    )


def colliding_terms(
    vocabulary: Sequence[str], min_prefix: int = 3, substitutions: Mapping[str, str] = DIGIT_LETTERS
) -> dict[str, list[str]]:
    """The same check for a vocabulary given as a list: shared prefix to the words that claim it."""
    owners: dict[str, list[str]] = {}
    for term in vocabulary:
        for prefix in term_prefixes(plain_key(term, substitutions), min_prefix):
            owners.setdefault(prefix, []).append(term)
    return {prefix: terms for prefix, terms in owners.items() if len(terms) > 1}


def flag_unmapped(df: DataFrame, col: str, out: str) -> DataFrame:
    """Boolean `out`: no canonical value was found."""
    return df.withColumn(out, named(col).isNull())


def map_synonyms(
    df: DataFrame, col: str, rules: Sequence[Synonyms], letters: bool, out: str
) -> DataFrame:
    """Target of the first rule that the text fits, null when none does.

    `letters` compares letters only; otherwise the text is trimmed and lower-cased, punctuation kept.
    """
    key = letters_only(named(col)) if letters else F.lower(F.trim(named(col)))
    return df.withColumn(KEY, key).withColumn(out, first_synonym(F.col(KEY), rules)).drop(KEY)
