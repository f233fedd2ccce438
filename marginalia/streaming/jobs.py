"""Incremental jobs as Structured Streaming queries.

Every job takes a streaming DataFrame and leaves starting it to the caller, who
names the checkpoint folder on shared storage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions import identity
from marginalia.functions.scoring import reputation
from marginalia.operators import learn, spend
from marginalia.sources.readers import COST_SCHEMA


def cost_stream(spark: SparkSession, path: str) -> DataFrame:
    """Cost rows as they are appended; malformed lines are dropped."""
    return spark.readStream.schema(COST_SCHEMA).option("mode", "DROPMALFORMED").json(path)


def daily_spend(rows: DataFrame, late: str = "1 day") -> DataFrame:
    """Calendar-day totals per action; late rows count until the watermark."""
    return (
        rows.withWatermark("ts", late)
        .groupBy(F.window("ts", "1 day").alias("w"), "action")
        .agg(F.sum("cost_usd").alias("cost"), F.count(F.lit(1)).alias("calls"))
        .select(F.to_date("w.start").alias("date"), "action", "cost", "calls")
    )


def rolling_spend(rows: DataFrame, late: str = "1 day") -> DataFrame:
    """Eight-day totals that move by a day, as the rolling report counts them."""
    return (
        rows.withWatermark("ts", late)
        .groupBy(F.window("ts", f"{spend.ROLLING_DAYS + 1} days", "1 day").alias("w"))
        .agg(F.sum("cost_usd").alias("cost"))
        .select(F.date_sub(F.to_date("w.end"), 1).alias("date"), "cost")
    )


def unseen_candidates(candidates: DataFrame, ttl: str | None = None) -> DataFrame:
    """First candidate of every identity; with ``ttl`` the state forgets.

    Without a time to live the state grows with the number of identities, which
    is what an unbounded seen cache means.
    """
    key = identity.seen_identity(F.col("id_type"), F.col("source_id"), F.col("url"))
    keyed = candidates.withColumn("ident", key)
    if ttl:
        return keyed.withWatermark("ts", ttl).dropDuplicatesWithinWatermark(["ident"])
    return keyed.dropDuplicates(["ident"])


def skill_tokens(messages: DataFrame, late: str = "1 hour") -> DataFrame:
    """Token totals per session and skill of new assistant messages.

    The stream's own offsets replace the saved message mark: a message is read
    once, whatever happened to the one before it.
    """
    kept = messages.where((F.col("role") == "assistant") & F.col("input_tokens").isNotNull())
    skill = F.coalesce(F.nullif(F.col("skill"), F.lit("")), F.lit("interactive"))
    return (
        kept.withWatermark("ts", late)
        .groupBy(F.window("ts", "1 day").alias("w"), "session_id", skill.alias("skill"))
        .agg(
            F.sum("input_tokens").alias("tokens_in"), F.sum("output_tokens").alias("tokens_out"),
            F.sum("cache_read_tokens").alias("cache_read"), F.sum("cache_create_tokens").alias("cache_create"),
        )
        .select(F.to_date("w.start").alias("date"), "session_id", "skill", "tokens_in", "tokens_out", "cache_read", "cache_create")
    )


def learn_batches(folder: str, agent: str = "web") -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` step that counts every decision once.

    Counts of a batch go to a folder named by the batch id and are overwritten
    when a batch is replayed, so a restart never counts twice. Ids seen in
    earlier batches are dropped by an anti join.
    """
    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        root = f"{folder}/decisions"
        earlier = spark.createDataFrame([], "id string, batch bigint")
        if _has_data(spark, root):
            earlier = spark.read.schema("id string, batch bigint").parquet(root)
        fresh = learn.new_decisions(
            batch.withColumn("id", F.col("id").cast("string")).dropDuplicates(["id"]), earlier.where(F.col("batch") < batch_id), agent
        ).persist()
        try:
            for key in ("source_id", "engine"):
                learn.counts_by(fresh, key).write.mode("overwrite").parquet(f"{folder}/{key}/batch={batch_id}")
            fresh.select("id").write.mode("overwrite").parquet(f"{root}/batch={batch_id}")
        finally:
            fresh.unpersist()

    return step


def _has_data(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def learned_counts(spark: SparkSession, folder: str, key: str) -> DataFrame:
    """Reputations from the counts of all batches."""
    counts = spark.read.parquet(f"{folder}/{key}")
    total = counts.groupBy(key).agg(F.sum("accept").alias("accept"), F.sum("reject").alias("reject"))
    return total.withColumn("rep", reputation(F.col("accept"), F.col("reject")))


def fresh_cache_entries(entries: DataFrame, now, ttl_hours: float) -> DataFrame:
    """Cache rows ``(key, stored_at, value)`` that are not older than the limit."""
    age = F.unix_timestamp(now) - F.unix_timestamp("stored_at")
    return entries.where(age <= ttl_hours * 3600)


def vectors_to_compute(chunks: DataFrame, stored: DataFrame, model: str) -> DataFrame:
    """Chunk texts whose vector is not stored yet, one row per text hash."""
    have = stored.where(F.col("model") == model).select("body_hash")
    return chunks.select("body_hash", "contextualized_text").dropDuplicates(["body_hash"]).join(have, "body_hash", "left_anti")
