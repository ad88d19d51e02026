"""Cleaning rules: what counts as missing, which spellings mean the same, which formats are dates.

Everything here is plain data. Each operator takes its rules as an argument and falls back on
these defaults, so another data set needs other rules and no other code.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass


@dataclass(frozen=True)
class Synonyms:
    """One rule of `map_synonyms`: the spellings that stand for `target`.

    `equals` lists whole spellings, `contains` lists fragments that are enough on their own.
    """

    target: str
    equals: tuple[str, ...] = ()
    contains: tuple[str, ...] = ()


# The spellings, tokens, formats and words below decide the results and are stated as
# the data needs them.

MISSING_TOKENS: Sequence[str] = ("nan", "null", "na", "n/a", "none", "#n/a")

CATEGORY_TERMS: Sequence[str] = (
    "clothing", "automotive", "electronics", "toys", "home", "sports", "beauty", "kitchen",
)

DIGIT_LETTERS: Mapping[str, str] = {"3": "e", "0": "o", "1": "i", "4": "a", "5": "s"}

PAYMENT_RULES: Sequence[Synonyms] = (
    Synonyms("card", equals=("card", "crd", "crad", "cd")),
    Synonyms("wallet", contains=("wall",)),
    Synonyms("upi", equals=("upi",)),
    Synonyms("cash", equals=("cash",)),
)

STATUS_RULES: Sequence[Synonyms] = (
    Synonyms("success", equals=("success", "suc")),
    Synonyms("refunded", equals=("refunded", "ref")),
    Synonyms("failed", equals=("failed", "fail")),
)

DATE_SENTINELS: Sequence[str] = ("31-12-2023",)

# First match wins. The two seconds-only formats keep timestamps that carry no fraction.
DATE_FORMATS: Sequence[str] = (
    "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
    "yyyy-MM-dd",
    "yyyy/dd/MM",
    "yyyy/MM/dd HH:mm",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd HH:mm:ss",
)

FLAG_MISSING = "missing"
FLAG_SENTINEL = "sentinel_placeholder"
FLAG_OK = "ok"
FLAG_UNPARSED = "unparsed"

UNMAPPED_LABEL = "(unmapped)"
