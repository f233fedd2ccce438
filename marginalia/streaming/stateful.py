"""Keyed streams whose state ends: what was seen, and what a decision has counted.

A key's state is the time of its first row and goes with an event-time timer ``keep`` after it, so the state holds the keys of
``keep`` and the watermark's delay, however long the stream runs. Earlier runs' keys come in as initial state.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from datetime import timedelta

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from marginalia.functions import identity
from marginalia.operators import learn
from marginalia.shipping import ship
from marginalia.sources.commits import Commits

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
COUNTS = "part string, name string, accept long, reject long"


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB, which timers need; the session's own setting comes back after."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


class FirstOnly(StatefulProcessor):
    """Gives out the first row (by ``_ms``, then ``_order``) of a key and remembers the key for ``keep_ms``."""

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.first = handle.getValueState("first", "ms long")

    def _remember(self, ms: int) -> None:
        self.first.update((ms,))
        self.handle.registerTimer(ms + self.keep_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        # one row at a time: a hot key holds no list
        best = min(rows, key=lambda r: (r["_ms"], () if r["_order"] is None else (r["_order"],)))
        if not self.first.exists():
            self._remember(best["_ms"])
            yield best

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.first.clear()
        return iter(())

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self._remember(initialState["_ms"])

    def close(self) -> None:
        pass


def first_of_keys(rows: DataFrame, key: str, order: str, keep: timedelta, late: str, known: DataFrame | None = None) -> DataFrame:
    """The first row of every value of ``key`` in a stream with an event time ``ts``; of rows of one batch the earliest, then the least ``order``.

    ``known``: a static table ``(key, ts)`` of keys seen by earlier runs.
    """
    ship(rows.sparkSession)
    # timers count in milliseconds
    staged = rows.withWatermark("ts", late).withColumn("_ms", F.coalesce(F.unix_millis("ts"), F.lit(0))).withColumn("_order", F.col(order))
    start = None
    if known is not None:
        start = known.groupBy(key).agg(F.unix_millis(F.min("ts")).alias("_ms")).groupBy(key)
    first = staged.groupBy(key).transformWithState(FirstOnly(keep // timedelta(milliseconds=1)), staged.schema, "Append", "EventTime", start)
    return first.drop("_ms", "_order")


def unseen(candidates: DataFrame, order: str, keep: timedelta, late: str = "1 day", known: DataFrame | None = None) -> DataFrame:
    """The first candidate of every identity within ``keep``; ``known``: ``(ident, ts)`` of a stored seen cache."""
    key = identity.seen_identity(F.col("id_type"), F.col("source_id"), F.col("url"))
    return first_of_keys(candidates.withColumn("ident", key), "ident", order, keep, late, known)


def learned_once(decisions: DataFrame, keep: timedelta, root: str, late: str = "1 day", agent: str = "web"):
    """A writer that counts every decision of a stream once: ids are keyed state, counts of a batch are one commit of its number.

    Rows that decide nothing, and columns that are not counted, do not get to the state: a row that waits does not hide its decision.
    """
    decided = learn.decided_rows(decisions, agent).select(F.col("id").cast("string").alias("text_id"), "id", "status", "discovered_by", "source_id", "engine", "ts")
    once = first_of_keys(decided, "text_id", "id", keep, late)

    def count(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        commits = Commits(spark, root)
        if number in commits.numbers():
            return
        fresh = learn.new_decisions(batch, batch.select("id").limit(0), agent).persist()
        try:
            parts = [learn.counts_by(fresh, key).select(F.lit(key).alias("part"), F.col(key).alias("name"), "accept", "reject") for key in ("source_id", "engine")]
            commits.commit(number, {"counts": parts[0].unionByName(parts[1])})
        finally:
            fresh.unpersist()

    return once.writeStream.foreachBatch(count)


def counted(spark: SparkSession, root: str) -> DataFrame:
    """``part, name, accept, reject`` over all committed batches."""
    return Commits(spark, root).read("counts", COUNTS).groupBy("part", "name").agg(F.sum("accept").alias("accept"), F.sum("reject").alias("reject"))
