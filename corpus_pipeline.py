"""A corpus pipeline of five stages over ``documents``.

Quality rules reject documents by adaptive thresholds; language identification
rejects documents of no determinable language; SimHash near-dedup keeps one
document of each group; mixing puts the rest in the order of the target mix;
SentencePiece encoding segments each text and proves that decoding is lossless.
Every stage but the last returns the columns of ``documents``.  Readers of several
files do not keep the order of rows, so the last stage gives each row the position
in the mix as a column; it is a function of the rows, the same in both stages but
for rows of equal source and id.

Defined results: a document of null or empty text, or of any with too few words, is
rejected by the rules; a null language or source is a group of its own there and part
of the pooled stream in the mix; of repeated rows, and of equal texts under several
ids, one stays (the least id; nulls last); texts of any length pass whole; an empty
table gives an empty result; extra columns pass all stages but the last under their
names, whatever those are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from massflow.llm import language, mixing, pieces, quality_rules, simhash
from massflow.session import fresh_path, remove, temporary


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.keep_known(docs)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.dedup(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_order(docs, mixing.WEIGHTS, mixing.OTHER)


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    coded = pieces.round_trip(docs, keep=("source",))
    made = mixing.mix(coded, mixing.WEIGHTS, mixing.OTHER, like=docs)
    return made.select(*coded.columns, F.col(f"{made.columns[-1]}.position").alias("mix_position"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_stage),
    ("language_id", language_stage),
    ("simhash_dedup", dedup_stage),
    ("source_mixing", mixing_stage),
    ("sentencepiece", pieces_stage),
]

#: The language stage is a trained model, which SQL cannot express.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage.  A stage's own tables go when it has been written,
    and its result when the next one has."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, f"stage-{name}")
        with temporary():
            stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(path)
        if last is not None:
            remove(spark, last)
        docs, last = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
