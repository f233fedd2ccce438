"""Reputations, reject words and calibration from decided rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.catalog import fragments as fr
from marginalia.catalog.base import query
from marginalia.functions import scoring
from marginalia.operators import learn
from marginalia.plans.derived import DECISIONS_SQL, decision_rows
from marginalia.session import read_table

CTE = f"WITH {DECISIONS_SQL}"
PART_ROWS = 100_000


def new_decisions(spark: SparkSession, folder: str) -> DataFrame:
    rows = decision_rows(spark, folder)
    processed = rows.where("id % 4 = 0").select("id")
    return learn.new_decisions(rows, processed)


def prior(spark: SparkSession, folder: str, key: str) -> DataFrame:
    """Stored counts: what the already processed decisions amount to."""
    rows = decision_rows(spark, folder).where("id % 4 = 0 AND discovered_by = 'web' AND status IN ('ingested', 'pending', 'rejected')")
    counted = learn.counts_by(rows.withColumn("accepted", F.col("status").isin(*learn.ACCEPTED)), key)
    return counted.withColumn("rep", scoring.reputation(F.col("accept"), F.col("reject")))


REP = "round(2 * (accept + 1.0::DOUBLE) / (accept + reject + 2.0::DOUBLE) - 1, 6)"
PRIOR_SQL = """
stored AS (
  SELECT CASE WHEN user_id % 7 = 0 THEN '' ELSE 's' || user_id END AS source_id, ['rss', 'arxiv', 'web'][1 + user_id % 3] AS engine,
         event_type IN ('purchase', 'signup') AS accepted FROM events
  WHERE event_id % 4 = 0 AND user_id % 10 <> 0 AND event_type IN ('purchase', 'signup', 'error')),
both_runs AS (SELECT source_id, engine, accepted FROM stored UNION ALL SELECT source_id, engine, accepted FROM decided)"""


@query(
    "new_decisions",
    f"{CTE} SELECT accepted, count(*) AS decisions, count(relevance_score) AS scored FROM decided GROUP BY accepted",
)
def new_decision_counts(spark: SparkSession, folder: str) -> DataFrame:
    rows = new_decisions(spark, folder)
    return rows.groupBy("accepted").agg(F.count(F.lit(1)).alias("decisions"), F.count("relevance_score").alias("scored"))


def _reputation_sql(key: str) -> str:
    return f"""{CTE}, {PRIOR_SQL}, c AS (SELECT {key}, count(CASE WHEN accepted THEN 1 END) AS accept, count(CASE WHEN NOT accepted THEN 1 END) AS reject
 FROM both_runs WHERE {key} <> '' GROUP BY {key}) SELECT {key}, accept, reject, {REP} AS rep FROM c"""


@query("source_reputations", _reputation_sql("source_id"))
def source_reputations(spark: SparkSession, folder: str) -> DataFrame:
    return learn.updated_reputations(prior(spark, folder, "source_id"), new_decisions(spark, folder), "source_id")


@query("engine_reputations", _reputation_sql("engine"))
def engine_reputations(spark: SparkSession, folder: str) -> DataFrame:
    return learn.updated_reputations(prior(spark, folder, "engine"), new_decisions(spark, folder), "engine")


@query(
    "reputation_changes",
    f"""{CTE}, {PRIOR_SQL},
b AS (SELECT source_id, count(CASE WHEN accepted THEN 1 END) AS accept, count(CASE WHEN NOT accepted THEN 1 END) AS reject FROM stored WHERE source_id <> '' AND substr(source_id, 2) NOT LIKE '%1' GROUP BY ALL),
br AS (SELECT source_id, {REP} AS prev FROM b),
a AS (SELECT source_id, count(CASE WHEN accepted THEN 1 END) AS accept, count(CASE WHEN NOT accepted THEN 1 END) AS reject FROM both_runs WHERE source_id <> '' GROUP BY ALL),
ar AS (SELECT *, {REP} AS rep FROM a)
SELECT source_id, accept, reject, rep, CASE WHEN prev IS NULL THEN 'new' WHEN rep > prev THEN 'up' WHEN rep < prev THEN 'down' ELSE 'same' END AS arrow FROM ar LEFT JOIN br USING (source_id)""",
)
def reputation_changes(spark: SparkSession, folder: str) -> DataFrame:
    before = prior(spark, folder, "source_id")
    after = learn.updated_reputations(before, new_decisions(spark, folder), "source_id")
    return learn.reputation_changes(before.where(~F.endswith("source_id", F.lit("1"))), after, "source_id")


@query(
    "label_reputations",
    f"""WITH c AS (SELECT d.source, count(CASE WHEN l.quality = 1 THEN 1 END) AS accept, count(CASE WHEN l.quality <> 1 THEN 1 END) AS reject
FROM documents d JOIN labels l USING (doc_id) GROUP BY d.source) SELECT source, accept, reject, {REP} AS rep FROM c""",
)
def label_reputations(spark: SparkSession, folder: str) -> DataFrame:
    """Reputation of document sources from their quality labels."""
    docs = read_table(spark, folder, "documents").select("doc_id", "source")
    joined = docs.join(read_table(spark, folder, "labels"), "doc_id").withColumn("accepted", F.col("quality") == 1)
    counted = learn.counts_by(joined, "source")
    return counted.withColumn("rep", scoring.reputation(F.col("accept"), F.col("reject")))


PROTECTED_SQL = "prot AS (SELECT DISTINCT unnest([t for t in regexp_extract_all(lower(p_name || ' ' || p_type || CASE WHEN p_partkey % 100 = 0 THEN ' bucket7 marketing' ELSE '' END), '[a-z0-9]+') if length(t) >= 4]) AS keyword FROM part)"


def protected(spark: SparkSession, folder: str) -> DataFrame:
    extra = F.when(F.col("p_partkey") % 100 == 0, F.lit(" bucket7 marketing")).otherwise(F.lit(""))
    texts = read_table(spark, folder, "part").select(F.concat("p_name", F.lit(" "), "p_type", extra).alias("text"))
    return learn.protected_terms(texts)


@query("protected_terms", f"WITH {PROTECTED_SQL} SELECT keyword FROM prot")
def protected_terms(spark: SparkSession, folder: str) -> DataFrame:
    return protected(spark, folder)


KEYWORD_SQL = f"""
kw AS (SELECT id, unnest({fr.reason_keywords('rejection_reason')}) AS keyword FROM decided WHERE NOT accepted AND rejection_reason <> ''),
kc AS (SELECT keyword, count(*) AS reasons FROM kw WHERE keyword NOT IN (SELECT keyword FROM prot) GROUP BY keyword)"""


@query("reject_keyword_counts", f"{CTE}, {PROTECTED_SQL}, {KEYWORD_SQL} SELECT keyword, reasons FROM kc")
def reject_keyword_counts(spark: SparkSession, folder: str) -> DataFrame:
    return learn.keyword_counts(new_decisions(spark, folder), protected(spark, folder))


@query(
    "active_reject_keywords",
    f"""{CTE}, {PROTECTED_SQL}, {KEYWORD_SQL}, old AS (SELECT 'noise' AS keyword, 3 AS reasons UNION ALL SELECT 'hype', 2),
m AS (SELECT keyword, cast(sum(reasons) AS bigint) AS reasons FROM (SELECT * FROM kc UNION ALL SELECT * FROM old) GROUP BY keyword)
SELECT keyword, reasons FROM m WHERE reasons >= 2 ORDER BY reasons DESC, keyword LIMIT 50""",
)
def active_reject_keywords(spark: SparkSession, folder: str) -> DataFrame:
    old = spark.createDataFrame([("noise", 3), ("hype", 2)], "keyword string, reasons bigint")
    counts = learn.keyword_counts(new_decisions(spark, folder), protected(spark, folder))
    return learn.active_keywords(learn.merged_keyword_counts(old, counts))


@query(
    "calibration",
    f"""{CTE}, s AS (SELECT accepted, relevance_score AS x, row_number() OVER (ORDER BY id) AS n FROM decided WHERE relevance_score IS NOT NULL),
w AS (SELECT *, coalesce(sum(CASE WHEN n = 1 THEN NULL ELSE ln((n - 1) / n::DOUBLE) END) OVER (PARTITION BY accepted ORDER BY n ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS la FROM s)
SELECT round(sum(CASE WHEN accepted THEN x / n * exp(la) END), 6) AS accepted_mean, round(sum(CASE WHEN NOT accepted THEN x / n * exp(la) END), 6) AS rejected_mean, count(*) AS n FROM w""",
)
def calibration(spark: SparkSession, folder: str) -> DataFrame:
    return learn.calibration(new_decisions(spark, folder), F.floor(F.col("id") / PART_ROWS))


@query("true_score_means", f"{CTE} SELECT accepted, round(avg(relevance_score), 6) AS mean, count(relevance_score) AS n FROM decided GROUP BY accepted")
def true_score_means(spark: SparkSession, folder: str) -> DataFrame:
    return learn.true_means(new_decisions(spark, folder))
