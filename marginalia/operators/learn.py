"""Learning from accept/reject decisions: reputations, reject words, calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marginalia.functions import scoring
from marginalia.functions.basics import blank_to_null, present, strip
from marginalia.functions.tokens import alnum_words, reason_keywords

# Status classes and list sizes.
ACCEPTED = ["ingested", "pending"]
REJECTED = ["rejected"]
KEYWORD_CAP = 50
MIN_REASONS = 2
# End of the fixed values.


def decided_rows(ledger: DataFrame, agent: str = "web") -> DataFrame:
    """Accepted and rejected rows of an agent."""
    return ledger.where((F.col("discovered_by") == agent) & F.col("status").isin(*ACCEPTED, *REJECTED))


def new_decisions(ledger: DataFrame, processed: DataFrame, agent: str = "web") -> DataFrame:
    """Decided rows of an agent that were not counted before."""
    return decided_rows(ledger, agent).join(processed.select("id"), "id", "left_anti").withColumn("accepted", F.col("status").isin(*ACCEPTED))


def counts_by(decisions: DataFrame, key: str) -> DataFrame:
    named = decisions.withColumn(key, strip(F.coalesce(key, F.lit("")))).where(F.col(key) != "")
    return named.groupBy(key).agg(
        F.count_if("accepted").alias("accept"), F.count_if(~F.col("accepted")).alias("reject")
    )


def updated_reputations(prior: DataFrame, decisions: DataFrame, key: str, strength: float = 1.0) -> DataFrame:
    """``(key, accept, reject, rep)``: stored counts plus the new ones."""
    new = counts_by(decisions, key)
    total = (
        prior.select(key, "accept", "reject")
        .unionByName(new)
        .groupBy(key)
        .agg(F.sum("accept").alias("accept"), F.sum("reject").alias("reject"))
    )
    return total.withColumn("rep", scoring.reputation(F.col("accept"), F.col("reject"), strength))


def protected_terms(texts: DataFrame) -> DataFrame:
    """Words of the purpose and concept pages; they never become reject words."""
    words = F.filter(alnum_words("text"), lambda w: F.length(w) >= 4)
    return texts.select(F.explode_outer(F.array_distinct(words)).alias("keyword")).where(present("keyword")).distinct()


def keyword_counts(decisions: DataFrame, protected: DataFrame) -> DataFrame:
    """In how many rejection reasons each unprotected word occurs."""
    reasons = decisions.where(~F.col("accepted") & blank_to_null(F.col("rejection_reason")).isNotNull())
    words = reasons.select(F.explode_outer(reason_keywords("rejection_reason")).alias("keyword")).where(present("keyword"))
    counted = words.groupBy("keyword").agg(F.count(F.lit(1)).alias("reasons"))
    return counted.join(protected, "keyword", "left_anti")


def merged_keyword_counts(prior: DataFrame, new: DataFrame) -> DataFrame:
    return prior.select("keyword", "reasons").unionByName(new.select("keyword", "reasons")).groupBy("keyword").agg(
        F.sum("reasons").alias("reasons")
    )


def active_keywords(counts: DataFrame, min_reasons: int = MIN_REASONS, cap: int = KEYWORD_CAP) -> DataFrame:
    return counts.where(F.col("reasons") >= min_reasons).orderBy(F.col("reasons").desc(), "keyword").limit(cap)


def calibration(decisions: DataFrame, part: Column) -> DataFrame:
    """Running means of accepted and rejected scores in id order, from nothing; rounded to six decimals."""
    before = decisions.sparkSession.createDataFrame([(0.0, 0.0, 0)], "accepted_mean double, rejected_mean double, n long")
    means = running_means(decisions, part, before)
    return means.select(F.round("accepted_mean", 6).alias("accepted_mean"), F.round("rejected_mean", 6).alias("rejected_mean"), "n")


def running_means(decisions: DataFrame, part: Column, before: DataFrame) -> DataFrame:
    """``accepted_mean, rejected_mean, n``: the means of ``before`` (one row of these columns) moved on in id order.

    Both means share one counter, so a score seen as the n-th decision moves its
    mean by (score - mean) / n. Each step is an affine map of the mean, and such
    maps compose: every ``part`` of the id range is reduced on its own by
    log-products, then the few parts are combined in order, and last comes the stored mean that they are
    applied to. No task ever holds more than one part.

    ``part`` is a column that grows with the id and bounds the rows per value.
    """
    stored = before.agg(
        F.coalesce(F.max("accepted_mean"), F.lit(0.0)).alias("accepted_before"), F.coalesce(F.max("rejected_mean"), F.lit(0.0)).alias("rejected_before"), F.coalesce(F.max("n"), F.lit(0)).alias("n_before")
    )
    scored = decisions.where(F.col("relevance_score").isNotNull()).select(
        "id", "accepted", F.col("relevance_score").alias("x"), part.alias("part")
    )
    sizes = scored.groupBy("part").agg(F.count(F.lit(1)).alias("size"))
    upto = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # one row of stored means
    offsets = sizes.select("part", F.coalesce(F.sum("size").over(upto), F.lit(0)).alias("sizes")).crossJoin(F.broadcast(stored)).select("part", (F.col("sizes") + F.col("n_before")).alias("before"))
    inside = Window.partitionBy("part").orderBy("id")
    numbered = scored.join(offsets, "part").withColumn("n", F.row_number().over(inside) + F.col("before"))
    # step n: mean * (n - 1) / n + x / n; the first step of all sets the mean outright
    shrink = F.when(F.col("n") == 1, F.lit(0.0)).otherwise(F.log((F.col("n") - 1) / F.col("n")))
    later = (
        Window.partitionBy("part", "accepted").orderBy(F.col("n").desc()).rowsBetween(Window.unboundedPreceding, -1)
    )
    weighted = numbered.withColumn("log_shrink", shrink).withColumn(
        "log_after", F.coalesce(F.sum("log_shrink").over(later), F.lit(0.0))
    )
    folded = weighted.groupBy("part", "accepted").agg(
        F.sum("log_shrink").alias("log_scale"),
        F.max(F.col("n") == 1).alias("resets"),
        F.sum(F.exp("log_after") * F.col("x") / F.col("n")).alias("shift"),
        F.count(F.lit(1)).alias("size"),
    )
    parts_after = Window.partitionBy("accepted").orderBy(F.col("part").desc()).rowsBetween(Window.unboundedPreceding, -1)
    placed = folded.withColumn("tail", F.coalesce(F.sum("log_scale").over(parts_after), F.lit(0.0)))
    means = placed.groupBy("accepted").agg(
        F.sum(F.exp("tail") * F.col("shift")).alias("shift"), F.when(F.max("resets"), F.lit(0.0)).otherwise(F.exp(F.sum("log_scale"))).alias("scale"), F.sum("size").alias("size")
    )
    moved = means.agg(
        *[F.max(F.when(F.col("accepted") == kind, F.col(c))).alias(f"{name}_{c}") for kind, name in ((True, "accepted"), (False, "rejected")) for c in ("shift", "scale")], F.coalesce(F.sum("size"), F.lit(0)).alias("size")
    )
    return moved.crossJoin(F.broadcast(stored)).select(
        *[(F.coalesce(f"{k}_scale", F.lit(1.0)) * F.col(f"{k}_before") + F.coalesce(f"{k}_shift", F.lit(0.0))).alias(f"{k}_mean") for k in ("accepted", "rejected")], (F.col("n_before") + F.col("size")).alias("n")
    )


def true_means(decisions: DataFrame) -> DataFrame:
    """Plain means of the two classes."""
    return decisions.groupBy("accepted").agg(F.round(F.avg("relevance_score"), 6).alias("mean"), F.count("relevance_score").alias("n"))


def reputation_changes(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Rows of a briefing: reputation with an arrow for its direction."""
    old = before.select(key, F.col("rep").alias("prev"))
    arrow = (
        F.when(F.col("prev").isNull(), F.lit("new"))
        .when(F.col("rep") > F.col("prev"), F.lit("up"))
        .when(F.col("rep") < F.col("prev"), F.lit("down"))
        .otherwise(F.lit("same"))
    )
    return after.join(old, key, "left").select(key, "accept", "reject", "rep", arrow.alias("arrow"))
