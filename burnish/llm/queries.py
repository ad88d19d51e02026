"""One query per operator over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from burnish.llm.collocations import COLLOCATIONS_SQL, collocations
from burnish.llm.common import workers_find_this
from burnish.llm.decontaminate import CONTAMINATION_SQL, contamination_table
from burnish.llm.jaccard_join import jaccard_components
from burnish.llm.language_id import language_table
from burnish.llm.language_model import model_table
from burnish.llm.nearest import nearest
from burnish.llm.packing import packing_table
from burnish.llm.periodic_runs import RUNS_SQL, runs_table
from burnish.llm.personal_data import personal_data_table
from burnish.llm.piece_encoding import piece_table
from burnish.llm.repeats import repeat_table
from burnish.llm.token_files import token_table
from burnish.llm.url_rules import judge_urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(build):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        workers_find_this(spark)
        return build(spark, sf_dir)

    QUERIES[build.__name__] = run
    return build


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data_table(_table(spark, sf_dir, "documents"))


@query
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination_table(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


ORACLE["op2_decontamination"] = CONTAMINATION_SQL


@query
def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_table(spark, sf_dir, "documents"), size=4, num=85, den=100).drop("row_hash", "component")


@query
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_table(_table(spark, sf_dir, "documents"))


@query
def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_table(_table(spark, sf_dir, "documents"))


@query
def op6_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_table(_table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


@query
def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_table(_table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


@query
def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(_table(spark, sf_dir, "embeddings"))


@query
def op9_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model_table(_table(spark, sf_dir, "documents"))


@query
def op10_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(_table(spark, sf_dir, "pages"))


@query
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs_table(_table(spark, sf_dir, "documents"))


ORACLE["op11_periodic_runs"] = RUNS_SQL


@query
def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing_table(_table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


@query
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(_table(spark, sf_dir, "documents"))


ORACLE["op13_collocations"] = COLLOCATIONS_SQL
