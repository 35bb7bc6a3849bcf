"""The training-data pipeline: five stages over ``documents``, each one operator, whose decisions take effect.

Of every stage: null and empty texts, very long texts, repeated rows and columns of any name are treated as its operator
says; columns that no stage reads come through as they were; an empty table gives an empty table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm import decontaminate, mixing, pii, quality, simhash
from rasterloom.llm.common import remove_folder, small_batches, table, use_checkpoints


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; those that tie with its threshold stay. A null text is judged as an empty one, and repeated rows alike. Without labels every score is 0.5 and all go."""
    small_batches(spark)
    return quality.accepted(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of the smallest id stays, once if it is repeated; of a group without ids one stays. Null, empty and blank texts are one group."""
    small_batches(spark)
    return simhash.one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages go; null and empty texts hold none, and an empty benchmark lets all stay."""
    small_batches(spark)
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to the names of its kinds; n_chars follows the text. All rows stay; a null text stays null, as its n_chars."""
    small_batches(spark)
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document with the number of its words that the mix takes; those of which it takes none go, null and empty texts among them. A null source is a source of its own."""
    return mixing.mix(docs, carry=True).where("taken > 0")


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("mixing", mixing_stage),
]

#: Trained scores, components and apportionment are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; what each returns is written to the shared folder and read again, and goes when the next stage's is there."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{use_checkpoints(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    last = None
    for i, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            remove_folder(spark, last)
        last = path
    return docs
