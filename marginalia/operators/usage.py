"""Token usage of transcripts, counted once: rows and message marks published by one commit.

The mark of a session is its last message that was counted. A batch's usage rows and the marks that it moves are one commit
(``sources.commits``) with the batch's number: a run that dies after the rows and before the mark has published neither, and
a batch that is played again under its number is recognised and writes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.operators import spend
from marginalia.sources.commits import Commits

USAGE = "session_id long, skill string, tokens_in long, tokens_out long, cache_read long, cache_create long, model string, last_position long, estimate double"
MARKS = "session_id long, uuid string, position long"


def marks(spark: SparkSession, root: str) -> DataFrame:
    """``session_id, uuid, position``: the latest mark of every session."""
    stored = Commits(spark, root).read("marks", MARKS)
    return stored.groupBy("session_id").agg(F.max_by(F.struct("uuid", "position"), "commit").alias("m")).select("session_id", "m.uuid", "m.position")


def new_usage(messages: DataFrame, before: DataFrame) -> dict[str, DataFrame]:
    """Usage rows of the messages behind the marks ``before``, and the marks that they move."""
    fresh = spend.after_watermark(messages, before.select("session_id", "uuid"))
    moved = fresh.groupBy("session_id").agg(F.max_by("uuid", "position").alias("uuid"), F.max("position").alias("position"))
    return {"rows": spend.transcript_usage(fresh), "marks": moved}


def commit_usage(messages: DataFrame, root: str, number: int) -> bool:
    """Count a batch of messages under ``number``; False if it was counted before."""
    spark = messages.sparkSession
    commits = Commits(spark, root)
    if number in commits.numbers():
        return False
    found = new_usage(messages, marks(spark, root))
    return commits.commit(number, {name: df.select(*[f.name for f in spark.createDataFrame([], schema).schema]) for (name, df), schema in zip(found.items(), (USAGE, MARKS))})


def usage_batches(root: str) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` step; the stream's batch id is the commit's number."""

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        commits = Commits(spark, root)
        if batch_id in commits.numbers():
            return
        # the stream gives out a message once, so its batches need no mark; they move it for later runs
        kept = {"rows": spend.transcript_usage(batch), "marks": batch.groupBy("session_id").agg(F.max_by("uuid", "position").alias("uuid"), F.max("position").alias("position"))}
        commits.commit(batch_id, kept)

    return step


def usage(spark: SparkSession, root: str) -> DataFrame:
    """All published usage rows, with the ``commit`` that each came by."""
    return Commits(spark, root).read("rows", USAGE)
