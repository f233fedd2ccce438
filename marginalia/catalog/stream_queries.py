"""The streaming jobs run to completion over the given tables.

Each job reads its table as a stream, keeps state and offsets below the shared
checkpoint folder, writes a table there and returns that table.
"""

from __future__ import annotations

import uuid
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.catalog.base import query
from marginalia.operators import spend
from marginalia.plans import derived as dv
from marginalia.session import checkpoint_root
from marginalia.streaming import jobs, stateful


def place(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_root(spark)}/streams/{name}-{uuid.uuid4().hex}"


def stream_of(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """A table, one file or a folder of files, as a stream.

    The last letter is a pattern of one letter: the path of a stream must be a folder unless it is a pattern.
    """
    schema = spark.read.parquet(f"{folder}/{table}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{folder}/{table}.parque[t]")


def run_complete(df: DataFrame, target: str) -> DataFrame:
    """Whole result after every batch; the few aggregate rows replace the last."""
    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/out")

    q = df.writeStream.outputMode("complete").option("checkpointLocation", f"{target}/state").trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
    return df.sparkSession.read.parquet(f"{target}/out")


def run_append(df: DataFrame, target: str) -> DataFrame:
    q = (
        df.writeStream.outputMode("append").format("parquet").option("path", f"{target}/out").option("checkpointLocation", f"{target}/state")
        .trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{target}/out")


@query(
    "stream_daily_spend",
    f"WITH {dv.CALLS_SQL} SELECT date, action, round(sum(cost_usd), 6) AS cost, count(*) AS calls FROM ledger GROUP BY ALL",
)
def stream_daily_spend(spark: SparkSession, folder: str) -> DataFrame:
    events = stream_of(spark, folder, "events")
    rows = events.select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("action"), F.round(F.col("value") / 1000, 6).alias("cost_usd"))
    return run_complete(jobs.daily_spend(rows), place(spark, "daily")).withColumn("cost", F.round("cost", 6))


@query(
    "stream_rolling_spend",
    f"""WITH {dv.CALLS_SQL}, d AS (SELECT date, sum(cost_usd) AS c FROM ledger GROUP BY date),
e AS (SELECT DISTINCT date + cast(i AS int) AS date FROM d, (SELECT unnest(range(8)) AS i))
SELECT e.date, round(sum(d.c), 6) AS cost FROM e JOIN d ON d.date BETWEEN e.date - 7 AND e.date GROUP BY e.date""",
)
def stream_rolling_spend(spark: SparkSession, folder: str) -> DataFrame:
    rows = stream_of(spark, folder, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.round(F.col("value") / 1000, 6).alias("cost_usd"))
    return run_complete(jobs.rolling_spend(rows), place(spark, "rolling")).withColumn("cost", F.round("cost", 6))


@query("stream_unseen", "SELECT DISTINCT 'u' || user_id || event_type AS ident FROM events")
def stream_unseen(spark: SparkSession, folder: str) -> DataFrame:
    rows = stream_of(spark, folder, "events").select(
        F.col("ts").cast("timestamp").alias("ts"), F.lit("url").alias("id_type"), F.lit("feed").alias("source_id"), F.concat(F.lit("u"), "user_id", "event_type").alias("url")
    )
    return run_append(jobs.unseen_candidates(rows).select("ident"), place(spark, "unseen"))


@query(
    "stream_skill_tokens",
    f"""WITH {dv.TRANSCRIPT_SQL} SELECT date '2024-01-01' + cast(session_id % 3 AS int) AS date, session_id, skill, cast(sum(input_tokens) AS bigint) AS tokens_in, cast(sum(output_tokens) AS bigint) AS tokens_out,
 cast(sum(cache_read) AS bigint) AS cache_read, cast(sum(cache_create) AS bigint) AS cache_create FROM messages WHERE role = 'assistant' AND input_tokens IS NOT NULL GROUP BY ALL""",
)
def stream_skill_tokens(spark: SparkSession, folder: str) -> DataFrame:
    n = F.length("text").cast("bigint")
    c, t = F.col("conv_id"), F.col("turn")
    rows = stream_of(spark, folder, "conversations").select(
        F.timestamp_seconds(F.lit(1704067200) + (c % 3) * 86400 + t).alias("ts"), c.alias("session_id"), "role",
        F.when(t % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("skill"), c % 4)).alias("skill"),
        F.when(n % 10 == 0, F.lit(None).cast("bigint")).otherwise(F.floor(n / 4)).alias("input_tokens"),
        F.floor(n / 8).alias("output_tokens"), (n % 5).alias("cache_read_tokens"), (n % 3).alias("cache_create_tokens"),
    )
    # a total for every session: their state does not stay in the executors' heap
    with stateful.keyed_state(spark):
        return run_complete(jobs.skill_tokens(rows), place(spark, "tokens"))


@query(
    "stream_learning",
    """WITH d AS (SELECT CASE WHEN user_id % 7 = 0 THEN '' ELSE 's' || user_id END AS source_id, event_type IN ('purchase', 'signup') AS accepted FROM events WHERE user_id % 10 <> 0 AND event_type IN ('purchase', 'signup', 'error')),
c AS (SELECT source_id, count(CASE WHEN accepted THEN 1 END) AS accept, count(CASE WHEN NOT accepted THEN 1 END) AS reject FROM d WHERE source_id <> '' GROUP BY source_id)
SELECT source_id, accept, reject, round(2 * (accept + 1.0::DOUBLE) / (accept + reject + 2.0::DOUBLE) - 1, 6) AS rep FROM c""",
)
def stream_learning(spark: SparkSession, folder: str) -> DataFrame:
    """Every decision is counted once, also when a batch is replayed."""
    target = place(spark, "learning")
    rows = dv.decisions_of(stream_of(spark, folder, "events"))
    q = (
        rows.writeStream.option("checkpointLocation", f"{target}/state").trigger(availableNow=True)
        .foreachBatch(jobs.learn_batches(f"{target}/out")).start()
    )
    q.awaitTermination()
    return jobs.learned_counts(spark, f"{target}/out", "source_id").select("source_id", "accept", "reject", "rep")


@query(
    "stream_and_batch_spend",
    f"WITH {dv.CALLS_SQL} SELECT date, round(sum(cost_usd), 6) AS streamed, round(sum(cost_usd), 6) AS batched FROM ledger GROUP BY date",
)
def stream_and_batch_spend(spark: SparkSession, folder: str) -> DataFrame:
    """Day totals of the stream next to those of the batch report."""
    streamed = stream_daily_spend(spark, folder).groupBy("date").agg(F.round(F.sum("cost"), 6).alias("streamed"))
    batch = spend.ledger_rows(dv.cost_calls(spark, folder)).groupBy("date").agg(F.round(F.sum("cost_usd"), 6).alias("batched"))
    return streamed.join(batch, "date", "full")


# ---- streams whose state ends ----------------------------------------------------


def event_candidates(spark: SparkSession, folder: str) -> DataFrame:
    return stream_of(spark, folder, "events").select(
        F.col("ts").cast("timestamp").alias("ts"), F.lit("url").alias("id_type"), F.lit("feed").alias("source_id"), F.concat(F.lit("u"), "user_id", "event_type").alias("url"), "event_id"
    )


@query(
    "stream_first_seen",
    """SELECT 'u' || user_id || event_type AS ident, arg_min(event_id, (epoch_ms(ts), event_id)) AS event_id FROM events WHERE user_id % 5 <> 0 GROUP BY ALL""",
)
def stream_first_seen(spark: SparkSession, folder: str) -> DataFrame:
    """Which candidate of each identity was kept; those of a stored seen cache are not new."""
    target = place(spark, "first")
    cache = spark.read.parquet(f"{folder}/events.parquet").where("user_id % 5 = 0").select(
        F.concat(F.lit("u"), "user_id", "event_type").alias("ident"), F.col("ts").cast("timestamp").alias("ts")
    )
    with stateful.keyed_state(spark):
        return run_append(stateful.unseen(event_candidates(spark, folder), "event_id", timedelta(days=3650), known=cache).select("ident", "event_id"), target)


@query(
    "stream_closed_days",
    f"""WITH {dv.CALLS_SQL} SELECT date, action, round(sum(cost_usd), 6) AS cost, count(*) AS calls FROM ledger
WHERE date + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY GROUP BY ALL""",
)
def stream_closed_days(spark: SparkSession, folder: str) -> DataFrame:
    """Days that no row can still reach; each is given out once and its state is dropped."""
    rows = stream_of(spark, folder, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("action"), F.round(F.col("value") / 1000, 6).alias("cost_usd"))
    return run_append(jobs.daily_spend(rows), place(spark, "closed")).withColumn("cost", F.round("cost", 6))


@query(
    "stream_learned_once",
    """WITH d AS (SELECT CASE WHEN user_id % 7 = 0 THEN '' ELSE 's' || user_id END AS source_id, ['rss', 'arxiv', 'web'][1 + user_id % 3] AS engine, event_type IN ('purchase', 'signup') AS accepted FROM events WHERE user_id % 10 <> 0 AND event_type IN ('purchase', 'signup', 'error'))
SELECT 'source_id' AS part, source_id AS name, count(CASE WHEN accepted THEN 1 END) AS accept, count(CASE WHEN NOT accepted THEN 1 END) AS reject FROM d WHERE source_id <> '' GROUP BY source_id
UNION ALL SELECT 'engine', engine, count(CASE WHEN accepted THEN 1 END), count(CASE WHEN NOT accepted THEN 1 END) FROM d GROUP BY engine""",
)
def stream_learned_once(spark: SparkSession, folder: str) -> DataFrame:
    target = place(spark, "once")
    events = stream_of(spark, folder, "events")
    rows = dv.decisions_of(events.withColumn("ts", F.col("ts").cast("timestamp")), ["ts"])
    with stateful.keyed_state(spark):
        q = stateful.learned_once(rows, timedelta(days=3650), f"{target}/out").option("checkpointLocation", f"{target}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return stateful.counted(spark, f"{target}/out")
