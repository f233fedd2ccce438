"""Cost ledger and token usage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.catalog.base import query
from marginalia.functions.scoring import estimated_cost
from marginalia.operators import spend
from marginalia.plans.derived import CALLS_SQL, REPORT_DAY, TRANSCRIPT_SQL, cost_calls, report_day, transcript

CTE = f"WITH {CALLS_SQL}"
SUMS = """cast(sum(input_tokens) AS bigint) AS tokens_in, cast(sum(output_tokens) AS bigint) AS tokens_out,
round(sum(cost_usd), 6) AS cost, round(sum(estimated_cost_usd), 8) AS estimate"""
TODAY = f"date = date '{REPORT_DAY}' AND (vault IS NULL OR vault = 'v1')"


def ledger(spark: SparkSession, folder: str) -> DataFrame:
    return spend.ledger_rows(cost_calls(spark, folder))


def today(spark: SparkSession, folder: str) -> DataFrame:
    return spend.of_vault(ledger(spark, folder), "v1").where(F.col("date") == report_day())


@query(
    "cost_estimates",
    CTE + " SELECT event_id, cost_usd, estimated_cost_usd FROM ledger",
)
def cost_estimates(spark: SparkSession, folder: str) -> DataFrame:
    calls = cost_calls(spark, folder)
    return calls.select(
        "event_id",
        F.round("cost_usd", 6).alias("cost_usd"),
        estimated_cost(F.col("model"), F.col("input_tokens"), F.col("output_tokens")).alias("estimated_cost_usd"),
    )


@query("spent_today", CTE + f" SELECT round(coalesce(sum(cost_usd), 0), 6) AS spent FROM ledger WHERE {TODAY} AND provider = 'gemini'")
def spent_today(spark: SparkSession, folder: str) -> DataFrame:
    return spend.spent_on(ledger(spark, folder), report_day(), "v1", "gemini")


@query(
    "budget_check",
    CTE + f""", s AS (SELECT round(coalesce(sum(cost_usd), 0), 6) AS spent FROM ledger WHERE {TODAY})
SELECT spent, round(greatest(0, 2.0 - spent), 6) AS remaining, spent >= 2.0 AS over_cap FROM s""",
)
def budget_check(spark: SparkSession, folder: str) -> DataFrame:
    return spend.budget_check(ledger(spark, folder), report_day(), "v1", 2.0)


@query("spend_by_source", CTE + f" SELECT source, {SUMS} FROM ledger WHERE {TODAY} GROUP BY source")
def spend_by_source(spark: SparkSession, folder: str) -> DataFrame:
    return spend.by_source(today(spark, folder))


@query("spend_by_provider", CTE + f" SELECT provider, round(sum(cost_usd), 6) AS cost FROM ledger WHERE {TODAY} GROUP BY provider")
def spend_by_provider(spark: SparkSession, folder: str) -> DataFrame:
    return spend.by_provider(today(spark, folder))


@query(
    "spend_by_action",
    CTE + f""" SELECT action, count(*) AS calls, {SUMS}, array_to_string(list_sort(list(DISTINCT source)), ', ') AS sources
FROM ledger WHERE {TODAY} GROUP BY action""",
)
def spend_by_action(spark: SparkSession, folder: str) -> DataFrame:
    return spend.by_action(today(spark, folder))


@query(
    "spend_grouping_sets",
    CTE + f"""
SELECT 'source' AS "by", source AS key, count(*) AS calls, {SUMS} FROM ledger GROUP BY source
UNION ALL SELECT 'provider', provider, count(*), {SUMS} FROM ledger GROUP BY provider
UNION ALL SELECT 'action', action, count(*), {SUMS} FROM ledger GROUP BY action""",
)
def spend_grouping_sets(spark: SparkSession, folder: str) -> DataFrame:
    return spend.by_all_three(ledger(spark, folder))


@query(
    "rolling_spend",
    CTE + f" SELECT round(sum(cost_usd), 6) AS rolling, round(sum(estimated_cost_usd), 8) AS rolling_estimate FROM ledger WHERE date >= date '{REPORT_DAY}' - 7",
)
def rolling_spend(spark: SparkSession, folder: str) -> DataFrame:
    return spend.rolling_spend(ledger(spark, folder), report_day())


@query(
    "daily_rolling_spend",
    CTE + """, d AS (SELECT vault, date, sum(cost_usd) AS day_cost FROM ledger GROUP BY ALL)
SELECT a.vault, a.date, round(any_value(a.day_cost), 6) AS cost, round(sum(b.day_cost), 6) AS rolling
FROM d a JOIN d b ON a.vault IS NOT DISTINCT FROM b.vault AND b.date BETWEEN a.date - 7 AND a.date GROUP BY a.vault, a.date""",
)
def daily_rolling_spend(spark: SparkSession, folder: str) -> DataFrame:
    return spend.daily_rolling(ledger(spark, folder))


@query(
    "over_cap_days",
    CTE + " SELECT date, round(sum(cost_usd), 6) AS spent FROM ledger GROUP BY date HAVING round(sum(cost_usd), 6) >= 16.5",
)
def over_cap_days(spark: SparkSession, folder: str) -> DataFrame:
    return spend.over_cap_days(ledger(spark, folder), 16.5)


USAGE = """cast(sum(input_tokens) AS bigint) AS tokens_in, cast(sum(output_tokens) AS bigint) AS tokens_out,
cast(sum(cache_read) AS bigint) AS cache_read, cast(sum(cache_create) AS bigint) AS cache_create, arg_min(model, position) AS model,
max(position) AS last_position"""
RATE = """round(CASE WHEN contains(model, 'haiku') THEN (tokens_in * 800 + tokens_out * 4000) / 10.0::DOUBLE
 WHEN contains(model, 'sonnet') THEN (tokens_in * 3000 + tokens_out * 15000) / 10.0::DOUBLE
 WHEN contains(model, 'opus') THEN (tokens_in * 15000 + tokens_out * 75000) / 10.0::DOUBLE
 WHEN contains(model, 'flash') THEN (tokens_in * 75 + tokens_out * 300) / 10.0::DOUBLE
 WHEN contains(model, 'gemini') THEN (tokens_in * 1250 + tokens_out * 5000) / 10.0::DOUBLE ELSE 0.0::DOUBLE END) / 1e8::DOUBLE"""


@query(
    "tokens_per_skill",
    f"""WITH {TRANSCRIPT_SQL}, g AS (SELECT session_id, skill, {USAGE} FROM messages
 WHERE role = 'assistant' AND input_tokens IS NOT NULL GROUP BY ALL)
SELECT *, {RATE} AS estimate FROM g""",
)
def tokens_per_skill(spark: SparkSession, folder: str) -> DataFrame:
    return spend.transcript_usage(transcript(spark, folder))


@query(
    "tokens_after_watermark",
    f"""WITH {TRANSCRIPT_SQL},
marks AS (SELECT session_id, CASE WHEN session_id % 6 = 0 THEN 'gone' ELSE session_id || '-1' END AS uuid FROM messages WHERE session_id % 3 = 0 GROUP BY session_id),
placed AS (SELECT k.session_id, min(m.position) AS mark FROM marks k LEFT JOIN messages m ON m.session_id = k.session_id AND m.uuid = k.uuid GROUP BY k.session_id),
left_over AS (SELECT m.* FROM messages m LEFT JOIN placed p ON p.session_id = m.session_id
  WHERE p.session_id IS NULL OR m.position > p.mark),
g AS (SELECT session_id, skill, {USAGE} FROM left_over WHERE role = 'assistant' AND input_tokens IS NOT NULL GROUP BY ALL)
SELECT *, {RATE} AS estimate FROM g""",
)
def tokens_after_watermark(spark: SparkSession, folder: str) -> DataFrame:
    messages = transcript(spark, folder)
    sid = F.col("session_id")
    marks = (
        messages.where(sid % 3 == 0)
        .select(
            "session_id",
            F.when(sid % 6 == 0, F.lit("gone")).otherwise(F.concat_ws("-", sid, F.lit(1))).alias("uuid"),
        )
        .distinct()
    )
    return spend.transcript_usage(spend.after_watermark(messages, marks))
