"""A corpus pipeline: toxicity, quality, near-duplicates, secrets, packing.

Each stage works on everything that its predecessor kept.  All but the last return the columns of
``documents``; the last returns the packed pieces.  Null and empty texts pass the stages as the
operators define for them; an empty table passes through.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataspark.llm import packing, quality_crf, secrets, simhash, toxicity
from strataspark.llm.common import table
from strataspark.llm.queries import GOOD_FROM, TOXIC_FROM, vocabulary
from strataspark.session import durable_folder


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator does not reject."""
    lexicon = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, lexicon, to="_toxicity")
    return scored.where(F.col("_toxicity.score") < TOXIC_FROM).select(*docs.columns)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    model = quality_crf.learn(docs, table(spark, sf_dir, "labels"))
    scored = quality_crf.score(docs, model, to="_quality")
    return scored.where(F.col("_quality.score") >= GOOD_FROM).select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id."""
    return simhash.one_of_each(docs)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their live-looking credentials; copied examples stay."""
    owned = docs.withColumn("_repository", F.concat_ws("/", "source", "lang"))
    cleaned = secrets.redact(owned, "doc_id", "_repository", "source")
    return cleaned.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces with their sequences and offsets."""
    return packing.best_fit(docs, vocabulary("word_bpe_49k.json")).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("quality", keep_good),
    ("near_duplicates", one_of_each),
    ("secrets", hide_secrets),
    ("packing", pack),
]

#: SQL expresses none of the learned stages; tests hold them against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each result is written to the shared folder and read again."""
    folder = f"{durable_folder(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
