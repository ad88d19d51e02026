"""Column expressions: `Column` in, `Column` out, native Spark only (no Python UDF)."""

from burnish.functions.amounts import bare_number, is_plain_number, null_if_token, to_number
from burnish.functions.dates import sentinel_label, to_date_any
from burnish.functions.measures import (
    amount_parts,
    exact_mean,
    exact_total,
    mean_of,
    merged_parts,
    percent,
    total_of,
)
from burnish.functions.terms import closest_term, first_synonym, letters_only, term_key, term_prefixes
from burnish.functions.text import list_items, named, phone_digits, phone_number, proper_case

__all__ = [
    "amount_parts", "bare_number", "closest_term", "exact_mean", "exact_total", "first_synonym",
    "is_plain_number", "letters_only", "list_items", "mean_of", "merged_parts", "named",
    "null_if_token", "percent", "phone_digits", "phone_number", "proper_case", "sentinel_label",
    "term_key", "term_prefixes", "to_date_any", "to_number", "total_of",
]
