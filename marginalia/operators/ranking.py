"""Candidate ranking: keyword overlap, registry relevance, recency, learned prior."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions import scoring
from marginalia.functions.tokens import overlap_coefficient, ranking_terms
from marginalia.operators.decide import category_weight


def engine_dimension(registry: DataFrame) -> DataFrame:
    """``(engine, engine_relevance, engine_category)`` of paper services.

    The relevance is the service's best entry, the category that of its first
    entry; crossref, which has none, takes over from a sister service.
    """
    papers = registry.where((F.col("section") == "paper-publisher") & (F.col("engine") != ""))
    own = papers.groupBy("engine").agg(
        F.max(F.least(F.col("relevance") / 5.0, F.lit(1.0))).alias("engine_relevance"),
        F.min_by("category", "ord").alias("engine_category"),
    )
    stand_in = own.agg(
        F.max(F.when(F.col("engine") == "crossref", F.lit(1))).alias("has"),
        F.coalesce(
            F.max(F.when(F.col("engine") == "semantic_scholar", F.col("engine_relevance"))),
            F.max(F.when(F.col("engine") == "openalex", F.col("engine_relevance"))),
            F.lit(0.8),
        ).alias("engine_relevance"),
    ).where(F.col("has").isNull())
    return own.unionByName(
        stand_in.select(F.lit("crossref").alias("engine"), "engine_relevance", F.lit("paper_api").alias("engine_category"))
    )


def source_dimension(registry: DataFrame) -> DataFrame:
    """First registry entry of every source id."""
    return registry.groupBy("source_id").agg(
        F.min_by(F.least(F.col("relevance") / 5.0, F.lit(1.0)), "ord").alias("source_relevance"),
        F.min_by("category", "ord").alias("source_category"),
    )


def base_scores(
    candidates: DataFrame, query: str, registry: DataFrame, today: Column, weights: dict[str, float] | None = None
) -> DataFrame:
    """Adds ``base_score``: 0.60 keywords, 0.25 weighted relevance, 0.15 recency."""
    words = ranking_terms(F.lit(query))
    joined = candidates.join(source_dimension(registry), "source_id", "left").join(
        engine_dimension(registry), "engine", "left"
    )
    keyword = overlap_coefficient(words, ranking_terms(F.concat_ws(" ", "title", "snippet")))
    relevance = F.coalesce("source_relevance", "engine_relevance", F.lit(0.0))
    category = F.coalesce("source_category", "engine_category", F.lit(""))
    score = scoring.composite_score(
        keyword, relevance * category_weight(category, weights), scoring.recency(F.col("published"), today)
    )
    return joined.select(*[F.col(c) for c in candidates.columns], score.alias("base_score"))


def with_learned_prior(scored: DataFrame, sources: DataFrame, engines: DataFrame, keywords: DataFrame) -> DataFrame:
    """Adds ``score``: base plus reputation, minus the reject penalty.

    A known source's reputation wins; an engine's counts only when positive.
    Reject keywords are few by construction (a capped list), so they are folded
    into one row and tested inside each candidate's own words.
    """
    words = keywords.agg(F.collect_set("keyword").alias("reject_words"))
    joined = (
        scored.join(sources.select("source_id", F.col("rep").alias("source_rep")), "source_id", "left")
        .join(engines.select("engine", F.col("rep").alias("engine_rep")), "engine", "left")
        .crossJoin(F.broadcast(words))
    )
    rep = F.coalesce("source_rep", F.greatest(F.lit(0.0), F.col("engine_rep")), F.lit(0.0))
    own = F.split(F.lower(F.concat_ws(" ", "title", "snippet")), "[^a-z0-9]+")
    penalty = F.when(
        F.coalesce(F.col("source_rep") <= -0.5, F.lit(False)) | F.arrays_overlap(own, "reject_words"), F.lit(1.0)
    ).otherwise(F.lit(0.0))
    return joined.select(
        *[F.col(c) for c in scored.columns if c not in ("rep", "penalty", "score")],
        rep.alias("rep"),
        penalty.alias("penalty"),
        scoring.learned_score(F.col("base_score"), rep, penalty).alias("score"),
    )


def in_rank_order(scored: DataFrame) -> DataFrame:
    return scored.orderBy(F.round("score", 9).desc(), "source_id")
