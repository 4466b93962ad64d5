"""The corpus pipeline: known language, one of each group of near duplicates, no benchmark
passages, personal data redacted, sources mixed to target weights.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet in the shared
checkpoint folder and read again as the next one's docs; all but the last return the columns of
`documents`. A stage judges its own input: the language models are learned from the stage's input
(labelled rows outside the held-out fifth), duplicates are judged among what the stage before kept.

Defined results: see the operators; null, empty and very long texts, repeated rows, empty tables and
further columns pass through every stage as the operators define.
"""
from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import contamination, exchange, language, mixing, near, pii
from quarry.session import SCALE_CONF, ship_package

BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def stage(fn: Callable[[SparkSession, DataFrame, str], DataFrame]):
    """A stage run on its own finds the package on the executors, and Arrow batches of whole texts bounded
    by bytes."""
    @wraps(fn)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set(BATCH, SCALE_CONF[BATCH])
        ship_package(spark)
        return fn(spark, docs, sf_dir)
    return run


@stage
def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no learned language explains go."""
    return language.accept(docs, language.train(docs))


@stage
def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that with the smallest id."""
    return near.deduplicate(docs)


@stage
def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go."""
    return contamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@stage
def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Selected spans are replaced in the text; n_chars is the new length."""
    clean = pii.redact(docs, pii.train(docs))
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


@stage
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All sources at the same weight: each row as often as its Poisson number says, with `copy`."""
    return mixing.mix(docs)


STAGES = [
    ("language", known_language),
    ("near_duplicates", without_near_duplicates),
    ("decontamination", without_benchmark),
    ("personal_data", without_personal_data),
    ("mixing", mixed),
]

ORACLE_SQL = None     # SQL can't express the first and the fourth stage


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        docs = exchange.table(step(spark, docs, sf_dir), f"stage-{name}")
    return docs
