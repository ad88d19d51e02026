"""Free text to a closed set of words."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from burnish.rules import DIGIT_LETTERS, Synonyms


def letters_only(text: Column) -> Column:
    """Lower case with everything but a-z removed."""
    return F.regexp_replace(F.lower(text), "[^a-z]", "")


def term_key(text: Column, substitutions: Mapping[str, str]) -> Column:
    """Comparable form of a term: lower case, digits read as letters, nothing but letters.

    Dropping all non-letters at the end also drops the spaces, `_` and `-` around a term.
    """
    if any(len(x) != 1 for pair in substitutions.items() for x in pair):
        raise ValueError("a substitution replaces one character by one other")
    read_as_letters = F.translate(F.lower(text), "".join(substitutions), "".join(substitutions.values()))
    return F.regexp_replace(read_as_letters, "[^a-z]", "")


def plain_key(term: str, substitutions: Mapping[str, str]) -> str:
    """`term_key` of a vocabulary word; a word without a letter is refused."""
    key = "".join(c for c in term.lower().translate(str.maketrans(dict(substitutions))) if "a" <= c <= "z")
    if not key:
        raise ValueError(f"a vocabulary word has no letter: {term!r}")
    return key


def term_prefixes(key: str, min_prefix: int) -> list[str]:
    """Every key that means the word of `key`: its prefixes from `min_prefix` letters on, and itself."""
    return [key[:n] for n in range(min_prefix, len(key))] + [key]


def closest_term(
    key: Column, vocabulary: Sequence[str], min_prefix: int, substitutions: Mapping[str, str] = DIGIT_LETTERS
) -> Column:
    """The vocabulary word that `key` equals or abbreviates, else null.

    When several words share a prefix the last listed one wins. All prefixes go into one literal map,
    which keeps the generated code short.
    """
    owners = {p: term for term in vocabulary for p in term_prefixes(plain_key(term, substitutions), min_prefix)}
    if not owners:
        return F.lit(None).cast("string")
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in owners.items() for x in pair]), key)


def first_synonym(key: Column, rules: Sequence[Synonyms]) -> Column:
    """Target of the first rule that `key` fits, else null."""
    found = F.lit(None).cast("string")
    for rule in reversed(rules):
        tests = [key.contains(fragment) for fragment in rule.contains]
        if rule.equals:
            tests.append(key.isin(list(rule.equals)))
        if tests:
            found = F.when(reduce(or_, tests), F.lit(rule.target)).otherwise(found)
    return found
