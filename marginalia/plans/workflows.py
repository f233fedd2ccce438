"""Whole workflows composed of the operators."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions.tokens import matching_terms
from marginalia.operators import decide, gaps, harvest, ranking, retrieval


@dataclass(frozen=True)
class CrawlConfig:
    """Settings of a crawl run."""

    lanes: list[str] = field(default_factory=lambda: list(decide.LANES))
    quotas: dict[str, int] = field(default_factory=lambda: dict(decide.QUOTAS))
    total: int = decide.TOTAL_CAP
    category_weights: dict[str, float] | None = None


def build_and_query_index(docs: DataFrame, folder: str, query: str, k: int = 20) -> DataFrame:
    """Write the index of ``docs(chunk_id, text)`` and answer one query from it."""
    retrieval.write_index(docs, folder)
    return retrieval.bm25_indexed(docs.sparkSession, folder, query, k)


def index_and_retrieve(chunks: DataFrame, folder: str, query: str, embeddings: DataFrame | None, query_vector: DataFrame | None, model: str) -> DataFrame:
    """Write chunks with their index and answer one query from them, with rerank."""
    retrieval.write_chunks(chunks, folder)
    return retrieval.retrieve_indexed(chunks.sparkSession, folder, query, embeddings, query_vector, model)


def crawl_plan(gap_notes: DataFrame, direction_notes: DataFrame, registry: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(targets, routes)`` of gap and direction pages.

    Gaps and directions are matched one to one, unmatched ones stand alone, all
    are put in lanes and routed to registry sources.
    """
    g, d = gaps.gap_pages(gap_notes), gaps.direction_pages(direction_notes)
    left = decide.match_units(g.select("id", matching_terms(F.concat_ws(" ", "title", "missing")).alias("terms"), "concepts"))
    right = decide.match_units(d.select("id", matching_terms("targets_gap").alias("terms"), "concepts"))
    matches = decide.greedy_matches(left, right, decide.match_scores(left, right))
    found = decide.targets(
        g.select("id", "title", "missing", "priority", "fillable_by"),
        d.select(
            "id", F.col("expected_evidence").alias("evidence"), "priority", "engines",
            F.transform("seed_queries", lambda q: q["query"]).alias("seeds"),
        ),
        matches,
    )
    subject = g.select(F.col("id").alias("gap_id"), "title", "concepts")
    none = F.expr("cast(array() as array<string>)")
    wanted = found.withColumn("gap_id", F.get("origin_ids", F.lit(0))).join(subject, "gap_id", "left").select(
        "target_id", "fillable_by",
        decide.target_keywords(F.coalesce("concepts", none), F.coalesce("title", F.lit("")), F.col("queries")).alias("keywords"),
    )
    return decide.in_lane_order(found), decide.routed_sources(wanted, registry)


def staged_candidates(
    candidates: DataFrame,
    seen: DataFrame,
    ledger: DataFrame,
    registry: DataFrame,
    purpose: str,
    today: Column,
    config: CrawlConfig,
    learned: tuple[DataFrame, DataFrame, DataFrame] | None = None,
) -> DataFrame:
    """Candidates chosen for approval.

    Seen ones drop out, the rest are scored against the purpose, adjusted by
    what was learned, reduced to one per item, checked against the ledger and
    picked by lane quotas with spillover.
    """
    fresh = harvest.drop_seen(candidates, seen, "cand_id").drop("ident", "score")
    scored = ranking.base_scores(fresh, purpose, registry, today, config.category_weights)
    if learned is None:
        scored = scored.withColumn("score", F.col("base_score"))
    else:
        scored = ranking.with_learned_prior(scored, *learned)
    left = harvest.drop_ledgered(decide.best_per_item(scored), ledger)
    return decide.select_candidates(left, config.lanes, config.quotas, config.total)


def as_proposals(chosen: DataFrame, agent: str = "web") -> DataFrame:
    """Chosen candidates in the form the approval queue takes."""
    texts = harvest.rationale_columns(chosen)
    return texts.select(
        F.col("ident"), "url", "title", "rationale", F.col("score").alias("relevance_score"), F.lit(agent).alias("discovered_by"),
        F.col("origin_ids").alias("objective_ids"), "published", "source_id", "engine",
    )


