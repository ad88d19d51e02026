"""Documents made ready for training, in stages that hand over by tables.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of `docs`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from burnish.functions.text import named
from burnish.llm.common import saved, workers_find_this
from burnish.llm.decontaminate import decontaminated
from burnish.llm.jaccard_join import one_of_each
from burnish.llm.language_id import UNDECIDED, identify_language, sample_texts
from burnish.llm.personal_data import redacted
from burnish.llm.piece_encoding import encode_pieces
from burnish.llm.queries import tokenizer_file

#: Columns that stages add and drop again.
LANGUAGE, LANGUAGE_SCORE, DECODED = "__language", "__language_score", "__decoded"

#: The stages hold models that SQL doesn't have; tests compare them with plain versions.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of no language (null or without a letter) go."""
    known = identify_language(docs, sample_texts(docs), lang=LANGUAGE, score=LANGUAGE_SCORE)
    return known.where(F.col(LANGUAGE) != UNDECIDED).select(*map(named, docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, linked by a similarity of 0.8 or more over shingles of five words."""
    return one_of_each(docs, size=5, num=80, den=100)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go: at least 0.8 of its shingles of five words."""
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts gives way to the name of its kind; all documents stay."""
    return redacted(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of `docs` with the piece ids of each text, their number, and whether they decode to the text."""
    path = tokenizer_file("piece_bpe_32k.model")
    encoded = encode_pieces(docs, path, decoded=DECODED)
    return encoded.select(
        *[named(c) for c in encoded.columns if c != DECODED],
        F.size("piece_ids").cast("long").alias("n_pieces"),
        (F.col(DECODED) == F.coalesce("text", F.lit(""))).alias("round_trip"),
    )


STAGES = [
    ("language ID", language_id),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("PII", personal_data),
    ("SentencePiece encoding and decoding", pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written as Parquet and read again as the next one's input."""
    workers_find_this(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
