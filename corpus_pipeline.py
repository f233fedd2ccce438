"""A corpus in five stages: quality rules, near-duplicates, benchmark decontamination, secrets, mixing.

Each stage works on all rows that the one before it kept. What is written between stages lies in the shared
folder that the cluster names in ``spark.checkpoint.dir``.

Cases: a null or empty text fails the quality rules; a null id is an id like others, and each text of a repeated id is kept or
dropped by itself; equal texts under one id are one row after the near-duplicate stage; an empty table gives an empty mixture; other columns of the input are
carried as far as the last stage.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marginalia.llm import decontaminate, mixing, near, quality, secrets
from marginalia.llm.queries import table
from marginalia.llm.shipping import ship
from marginalia.session import checkpoint_root


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    ship(spark)
    return quality.kept(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    ship(spark)
    return near.deduplicated(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked, with parts linked across lines."""
    return secrets.masked(docs, lines=False)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: a row for each use of a document."""
    return mixing.mix(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_stage),
    ("near_duplicates", near_stage),
    ("benchmark_decontamination", benchmark_stage),
    ("secret_scans", secret_stage),
    ("mixing", mixing_stage),
]

#: the learned index and the sampled signatures are no SQL; tests hold the stages against plain versions
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; every stage's rows are written as Parquet and read again."""
    folder = os.path.join(checkpoint_root(spark), f"corpus-{uuid.uuid4()}")
    rows = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{i}-{name}"
        stage(spark, rows, sf_dir).write.parquet(path)
        rows = spark.read.parquet(path)
    return rows
