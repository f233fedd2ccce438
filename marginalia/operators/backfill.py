"""Cited papers that are not in the ledger yet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marginalia.functions import frontmatter as fm
from marginalia.functions import identity, prose
from marginalia.functions.basics import all_matches, blank_to_null, first_match, present, strip

GAP_SCORE = 1.0
WIKI_SCORE = 0.5
RATIONALE_PAGES = 3
RATIONALE_CHARS = 200


def cited_pages(pages: DataFrame) -> DataFrame:
    """Edges ``(id, id_type, path)``: which page cites which paper.

    Edge form instead of a page set per paper: a paper cited by every page stays
    as many small rows.
    """
    papers = F.transform(
        F.concat(all_matches("text", identity.ARXIV_LINK_PATTERN, 1), all_matches("text", identity.ARXIV_TEXT_PATTERN, 1)),
        lambda x: F.struct(F.concat(F.lit("arxiv:"), x).alias("id"), F.lit("arxiv").alias("id_type")),
    )
    dois = F.transform(
        all_matches("text", identity.DOI_LINK_PATTERN, 1),
        lambda x: F.struct(
            F.concat(F.lit("doi:"), F.lower(F.regexp_replace(x, identity.DOI_TAIL, ""))).alias("id"), F.lit("doi").alias("id_type")
        ),
    )
    return pages.select("path", F.explode_outer(F.array_distinct(F.concat(papers, dois))).alias("c")).where(present("c")).select("c.id", "c.id_type", "path")


def gap_references(gaps: DataFrame) -> DataFrame:
    """Edges ``(page, gap_id)`` of open gaps' "Shows up in" sections."""
    text, crlf = F.col("text"), fm.BLOCK_CRLF
    status = F.lower(F.coalesce(fm.scalar(text, "status", crlf), F.lit("open")))
    stem = F.regexp_replace(F.substring_index("path", "/", -1), r"\.md$", "")
    named = F.coalesce(fm.scalar(text, "id", crlf), F.upper(first_match(stem, r"(?i)^(GAP-\d+)")), stem)
    links = all_matches(prose.section(text, "Shows up in"), r"\[\[(wiki/[^\]|#]+)", 1)
    return (
        gaps.where(status == "open")
        .select(named.alias("gap_id"), F.explode_outer(F.array_distinct(links)).alias("page")).where(present("page"))
        .select(F.regexp_replace(strip("page"), "/+$", "").alias("page"), "gap_id")
        .distinct()
    )


def ledger_status(ledger: DataFrame, files: DataFrame) -> DataFrame:
    """``(id, status, on_disk)`` by comparison form of the id."""
    there = files.select(F.col("path").alias("filename")).distinct().withColumn("there", F.lit(True))
    rows = ledger.select(identity.ledger_identity(F.col("id")).alias("id"), "status", "filename")
    joined = rows.where("id <> ''").join(there, "filename", "left")
    return joined.groupBy("id").agg(
        F.max_by(F.struct("status", F.coalesce("there", F.lit(False)).alias("on_disk")), F.col("filename")).alias("s")
    ).select("id", "s.status", "s.on_disk")


def classify(cited: DataFrame, status: DataFrame) -> DataFrame:
    """``(id, id_type, pages, route, prior_status)`` of every cited paper."""
    papers = cited.groupBy("id", "id_type").agg(F.count(F.lit(1)).alias("pages"))
    both = papers.join(status, "id", "left")
    route = (
        F.when((F.col("status") == "ingested") & F.col("on_disk"), "truly_ingested")
        .when(F.col("status").isin("pending", "waiting_approval"), "already_queued")
        .when(F.col("status").isin("rejected", "deleted"), "decided")
        .otherwise("backfill")
    )
    return both.select(
        "id", "id_type", "pages", route.alias("route"),
        F.coalesce(blank_to_null(F.col("status")), F.lit("not-in-index")).alias("prior_status"),
    )


def backfill_set(cited: DataFrame, status: DataFrame, references: DataFrame) -> DataFrame:
    """Papers to stage, those that gaps ask for first, with score and rationale.

    The rationale names the first three citing pages; they are picked by rank
    before any list is built, and only gap ids that refer to a citing page are
    listed.
    """
    wanted = classify(cited, status).where(F.col("route") == "backfill").drop("route")
    edges = cited.join(wanted.select("id"), "id", "left_semi").select("id", F.regexp_replace("path", r"\.md$", "").alias("page"))
    order = Window.partitionBy("id").orderBy("page")
    first = (
        edges.withColumn("n", F.row_number().over(order))
        .where(F.col("n") <= RATIONALE_PAGES)
        .groupBy("id")
        .agg(F.sort_array(F.collect_list("page")).alias("first_pages"))
    )
    # the text is cut at 200 characters, so no more than 200 gap ids can show in it
    asked = edges.join(references, "page").select("id", "gap_id").distinct()
    shown = asked.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("gap_id"))).where(F.col("n") <= RATIONALE_CHARS)
    named_gaps = shown.groupBy("id").agg(F.sort_array(F.collect_list("gap_id")).alias("gap_refs"))
    gaps = asked.groupBy("id").agg(F.count(F.lit(1)).alias("gaps")).join(named_gaps, "id")
    found = wanted.join(first, "id").join(gaps, "id", "left")
    has_gap = F.col("gaps").isNotNull()
    named = F.array_join(F.transform("first_pages", lambda p: F.concat(F.lit("[["), p, F.lit("]]"))), ", ")
    served = F.when(has_gap, F.concat(F.lit(" ("), F.array_join("gap_refs", ", "), F.lit(")"))).otherwise(F.lit(""))
    text = F.concat(
        F.lit("Cited in "), named, served, F.lit(" but not truly ingested (index status: "), F.col("prior_status"),
        F.lit("). Known-gap backfill."),
    )
    bare = F.regexp_replace("id", "^(arxiv|doi):", "")
    return found.select(
        "id",
        "id_type",
        "pages",
        F.coalesce("gaps", F.lit(0)).cast("bigint").alias("gaps"),
        F.when(has_gap, "gap").otherwise("wiki").alias("signal"),
        "prior_status",
        F.when(has_gap, F.lit(GAP_SCORE)).otherwise(F.lit(WIKI_SCORE)).alias("score"),
        F.regexp_replace(F.substring(text, 1, RATIONALE_CHARS), r"\s+$", "").alias("rationale"),
        F.when(F.col("id_type") == "arxiv", F.concat(F.lit("https://arxiv.org/abs/"), bare))
        .otherwise(F.concat(F.lit("https://doi.org/"), bare)).alias("url"),
        F.when(F.col("id_type") == "arxiv", F.concat(F.lit("arXiv "), bare)).otherwise(F.concat(F.lit("DOI "), bare)).alias("title"),
    )


def in_signal_order(found: DataFrame) -> DataFrame:
    return found.orderBy(F.when(F.col("signal") == "gap", F.lit(0)).otherwise(F.lit(1)), "id")


def as_proposals(found: DataFrame, agent: str, limit: int | None = None) -> DataFrame:
    """Proposals for the queue, the first ``limit`` in signal order if given."""
    ordered = in_signal_order(found)
    chosen = ordered.limit(limit) if limit is not None else ordered
    return chosen.select(
        F.col("id").alias("ident"), "url", "title", "rationale", F.col("score").alias("relevance_score"),
        F.lit(agent).alias("discovered_by"), F.expr("cast(array() as array<string>)").alias("objective_ids"),
        F.lit(None).cast("string").alias("published"), F.col("id").alias("source_id"),
        F.when(F.col("id_type") == "arxiv", "arxiv").otherwise("backfill").alias("engine"),
    )


