"""Operators: `DataFrame` in, `DataFrame` out, rules and column names as arguments. Only `ranked`, and what uses it, runs a job."""

from burnish.operators.amounts import flag_invalid_amount, flag_missing_amount, null_tokens, parse_amount
from burnish.operators.dates import flag_sentinel, parse_dates
from burnish.operators.dedup import dedup_keep_first, duplicate_count
from burnish.operators.integrity import Reference, assert_unique, enrich, integrity_report, mark_orphans, orphans
from burnish.operators.profile import profile_column, profile_columns, top_values, value_counts
from burnish.operators.ranking import ranked
from burnish.operators.skew import fits_broadcast, hot_keys, join_without_hot_tasks
from burnish.operators.standardize import (
    flag_missing,
    label_missing,
    normalize_phone,
    split_multivalue,
    standardize_names,
)
from burnish.operators.vocabulary import (
    ambiguous_prefixes,
    canonicalize_terms,
    canonicalize_terms_from,
    colliding_terms,
    flag_unmapped,
    map_synonyms,
)

__all__ = [
    "Reference", "ambiguous_prefixes", "assert_unique", "canonicalize_terms", "canonicalize_terms_from",
    "colliding_terms", "dedup_keep_first", "duplicate_count", "enrich", "fits_broadcast",
    "flag_invalid_amount", "flag_missing", "flag_missing_amount", "flag_sentinel", "flag_unmapped",
    "hot_keys", "integrity_report", "join_without_hot_tasks", "label_missing", "map_synonyms", "mark_orphans",
    "normalize_phone", "null_tokens", "orphans", "parse_amount", "parse_dates", "profile_column",
    "profile_columns", "ranked", "split_multivalue", "standardize_names", "top_values", "value_counts",
]
