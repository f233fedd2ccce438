"""Cost ledger: spend per day, source, provider and action, budgets, tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marginalia.functions.basics import blank_to_null
from marginalia.functions.scoring import estimated_cost

ROLLING_DAYS = 7


def ledger_rows(calls: DataFrame) -> DataFrame:
    """Ledger rows of model calls: paid cost at 6 decimals, estimate at 8."""
    return calls.select(
        "ts",
        F.to_date("ts").alias("date"),
        "vault",
        "action",
        "provider",
        "model",
        "source",
        F.coalesce("input_tokens", F.lit(0)).cast("bigint").alias("input_tokens"),
        F.coalesce("output_tokens", F.lit(0)).cast("bigint").alias("output_tokens"),
        F.round(F.coalesce("cost_usd", F.lit(0.0)), 6).alias("cost_usd"),
        estimated_cost(
            F.coalesce(blank_to_null(F.col("model")), F.col("provider")), F.col("input_tokens"), F.col("output_tokens")
        ).alias("estimated_cost_usd"),
    )


def of_vault(ledger: DataFrame, vault: str) -> DataFrame:
    """Rows of one vault; untagged rows belong to every vault."""
    return ledger.where(F.col("vault").isNull() | (F.col("vault") == vault))


def spent_on(ledger: DataFrame, day: Column, vault: str, provider: str | None = None) -> DataFrame:
    kept = of_vault(ledger, vault).where(F.col("date") == day)
    if provider:
        kept = kept.where(F.col("provider") == provider)
    return kept.agg(F.round(F.coalesce(F.sum("cost_usd"), F.lit(0.0)), 6).alias("spent"))


def budget_check(ledger: DataFrame, day: Column, vault: str, cap: float) -> DataFrame:
    return spent_on(ledger, day, vault).select(
        "spent",
        F.round(F.greatest(F.lit(0.0), F.lit(cap) - F.col("spent")), 6).alias("remaining"),
        (F.col("spent") >= cap).alias("over_cap"),
    )


def _sums() -> list[Column]:
    return [
        F.sum("input_tokens").alias("tokens_in"),
        F.sum("output_tokens").alias("tokens_out"),
        F.round(F.sum("cost_usd"), 6).alias("cost"),
        F.round(F.sum("estimated_cost_usd"), 8).alias("estimate"),
    ]


def by_source(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy(F.coalesce("source", F.lit("unknown")).alias("source")).agg(*_sums())


def by_provider(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("provider").agg(F.round(F.sum("cost_usd"), 6).alias("cost"))


def by_action(ledger: DataFrame) -> DataFrame:
    """Calls and sums per action with the names of its (few) sources."""
    names = F.array_join(F.sort_array(F.collect_set(F.coalesce("source", F.lit("unknown")))), ", ")
    return ledger.groupBy("action").agg(F.count(F.lit(1)).alias("calls"), *_sums(), names.alias("sources"))


def by_all_three(ledger: DataFrame) -> DataFrame:
    """Source, provider and action totals in one pass."""
    keys = [F.col("source"), F.col("provider"), F.col("action")]
    grouped = (
        ledger.withColumn("source", F.coalesce("source", F.lit("unknown")))
        .groupingSets([[k] for k in keys], *keys)
        .agg(F.count(F.lit(1)).alias("calls"), *_sums(), F.grouping_id().alias("gid"))
    )
    return grouped.select(
        F.when(F.col("gid") == 3, F.lit("source")).when(F.col("gid") == 5, F.lit("provider")).otherwise(F.lit("action")).alias("by"),
        F.coalesce("source", "provider", "action").alias("key"),
        "calls", "tokens_in", "tokens_out", "cost", "estimate",
    )


def rolling_spend(ledger: DataFrame, day: Column) -> DataFrame:
    """Spend from seven days before ``day`` on; both ends count."""
    return ledger.where(F.col("date") >= F.date_sub(day, ROLLING_DAYS)).agg(
        F.round(F.sum("cost_usd"), 6).alias("rolling"), F.round(F.sum("estimated_cost_usd"), 8).alias("rolling_estimate")
    )


def daily_rolling(ledger: DataFrame) -> DataFrame:
    """Day totals with the rolling total that ends on each day.

    The window runs over one row per day, which the grouping has already made
    small, not over the ledger.
    """
    days = ledger.groupBy("vault", "date").agg(F.sum("cost_usd").alias("day_cost"))
    span = (
        Window.partitionBy("vault").orderBy(F.datediff("date", F.lit("1970-01-01").cast("date"))).rangeBetween(-ROLLING_DAYS, 0)
    )
    return days.select(
        "vault", "date", F.round("day_cost", 6).alias("cost"), F.round(F.sum("day_cost").over(span), 6).alias("rolling")
    )


def over_cap_days(ledger: DataFrame, cap: float) -> DataFrame:
    return (
        ledger.groupBy("date").agg(F.round(F.sum("cost_usd"), 6).alias("spent")).where(F.col("spent") >= cap)
    )


def transcript_usage(messages: DataFrame) -> DataFrame:
    """Token totals per session and skill over assistant messages with usage.

    The model of a bucket is that of its first message.
    """
    kept = messages.where((F.col("role") == "assistant") & F.col("input_tokens").isNotNull())
    skill = F.coalesce(blank_to_null(F.col("skill")), F.lit("interactive"))
    grouped = kept.groupBy("session_id", skill.alias("skill")).agg(
        F.sum("input_tokens").alias("tokens_in"),
        F.sum("output_tokens").alias("tokens_out"),
        F.sum("cache_read_tokens").alias("cache_read"),
        F.sum("cache_create_tokens").alias("cache_create"),
        F.min_by("model", "position").alias("model"),
        F.max("position").alias("last_position"),
    )
    return grouped.withColumn("estimate", estimated_cost(F.col("model"), F.col("tokens_in"), F.col("tokens_out")))


def after_watermark(messages: DataFrame, marks: DataFrame) -> DataFrame:
    """Messages behind the saved message of their session.

    A session without a mark is read whole; one whose marked message is gone
    yields nothing.
    """
    placed = (
        marks.join(messages.select("session_id", "uuid", "position"), ["session_id", "uuid"], "left")
        .groupBy("session_id")
        .agg(F.min("position").alias("mark"))
        .withColumn("marked", F.lit(True))
    )
    joined = messages.join(placed, "session_id", "left")
    return joined.where(F.col("marked").isNull() | (F.col("position") > F.col("mark"))).drop("mark", "marked")
