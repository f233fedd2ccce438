"""Counts over page metadata and the declarative listing views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions import frontmatter as fm
from marginalia.functions import identity, prose
from marginalia.functions.basics import blank_to_null, present, strip
from marginalia.operators.graph import skippable, with_names

# Report sizes and section order.
TOP_TAGS = 25
RECENT_PAGES = 15
INDEX_SECTIONS = {"source": "Sources", "synthesis": "Synthesis", "concept": "Concepts", "entity": "Entities"}
# End of the fixed values.


def page_metadata(pages: DataFrame) -> DataFrame:
    """Type, status, tags and edit day of every content page."""
    named = with_names(pages).where(~skippable())
    text = F.col("text")

    def field(key: str) -> Column:
        value = strip(F.regexp_extract(fm.block(text, fm.BLOCK), rf"(?m)^{key}[ \t]*:[ \t]*([^\n]*)$", 1))
        return blank_to_null(fm.unquote_all(value))

    def day(key: str) -> Column:
        return F.try_to_date(F.substring(field(key), 1, 10), "yyyy-MM-dd")

    inline = prose.inline_tags(fm.body(text, fm.BLOCK))
    return named.select(
        "path",
        F.coalesce(field("type"), F.lit("untyped")).alias("type"),
        F.coalesce(field("status"), F.lit("unset")).alias("status"),
        F.transform(F.concat(fm.list_field(text, "tags"), inline), lambda t: F.regexp_replace(t, "^#+", "")).alias("tags"),
        F.coalesce(day("updated"), day("created"), day("date")).alias("edited"),
    )


def counts_by(meta: DataFrame, key: str) -> DataFrame:
    return meta.groupBy(key).agg(F.count(F.lit(1)).alias("pages"))


def tag_counts(meta: DataFrame, k: int = TOP_TAGS) -> DataFrame:
    """The ``k`` most used tags; repeats on a page count."""
    tags = meta.select(F.explode_outer("tags").alias("tag")).where(present("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("uses"))
    return tags.orderBy(F.col("uses").desc(), "tag").limit(k)


def recently_edited(meta: DataFrame, k: int = RECENT_PAGES) -> DataFrame:
    return meta.where("edited is not null").orderBy(F.col("edited").desc(), "path").limit(k).select("path", "edited")


def all_counts(meta: DataFrame) -> DataFrame:
    """Type and status counts in one pass over the pages."""
    sets = meta.groupingSets([[F.col("type")], [F.col("status")], []], F.col("type"), F.col("status")).agg(
        F.count(F.lit(1)).alias("pages"), F.grouping_id().alias("gid")
    )
    return sets.select(
        F.when(F.col("gid") == 1, F.lit("type")).when(F.col("gid") == 2, F.lit("status")).otherwise(F.lit("total")).alias("by"),
        F.coalesce("type", "status", F.lit("")).alias("key"),
        "pages",
    )


def ingest_days(ledger: DataFrame) -> DataFrame:
    """One ingest day per page; the row with the greatest id wins."""
    page = F.regexp_replace(strip("source_page"), "^/+", "")
    rows = ledger.select(
        page.alias("path"), "id", F.substring(F.coalesce("ingested_at", "first_seen"), 1, 10).alias("ledger_day")
    ).where("path <> ''")
    return rows.groupBy("path").agg(F.max_by("ledger_day", "id").alias("ledger_day"))


def wiki_index(pages: DataFrame, ledger: DataFrame) -> DataFrame:
    """Catalogue rows: section, title, type, ingest day and link of each page."""
    named = with_names(pages).where("area = 'wiki'").where(
        ~F.startswith("name", F.lit("_"))
        & ~F.startswith("name", F.lit("."))
        & ~F.col("path").isin("wiki/index.md", "wiki/hot.md", "wiki/log.md")
    )
    own = named.select(
        "path",
        "stem",
        F.coalesce(fm.scalar("text", "type"), F.lit("untyped")).alias("type"),
        F.coalesce(fm.scalar("text", "title"), prose.first_heading("text"), prose.stem_title(F.col("stem"))).alias("title"),
        F.substring(F.coalesce(fm.scalar("text", "created"), fm.scalar("text", "date"), F.lit("")), 1, 10).alias("own_day"),
    )
    section = F.lit("Other")
    rank = F.lit(len(INDEX_SECTIONS))
    for i, (kind, label) in enumerate(INDEX_SECTIONS.items()):
        section = F.when(F.col("type") == kind, F.lit(label)).otherwise(section)
        rank = F.when(F.col("type") == kind, F.lit(i)).otherwise(rank)
    folder = F.regexp_extract("path", r"^[^/]+/(.+)/[^/]+$", 1)
    return own.join(ingest_days(ledger), "path", "left").select(
        section.alias("section"),
        rank.alias("section_rank"),
        "title",
        "type",
        F.coalesce(blank_to_null(F.col("ledger_day")), blank_to_null(F.col("own_day")), F.lit("-")).alias("day"),
        F.concat(F.lit("[["), F.concat_ws("/", blank_to_null(folder), "stem"), F.lit("]]")).alias("link"),
    )


def in_index_order(index: DataFrame) -> DataFrame:
    """Sections in order; sources by day, newest first, the rest by title."""
    by_day = F.when(F.col("section") == "Sources", F.regexp_replace("day", "^-$", "0000-00-00"))
    return index.orderBy("section_rank", by_day.desc_nulls_last(), F.lower("title"), "link")


def raw_file_metadata(files: DataFrame) -> DataFrame:
    """Identity, title, kind and hash of raw files ``(path, text)``."""
    parent = F.substring_index(F.regexp_extract("path", r"^(.*)/[^/]*$", 1), "/", -1)
    name = F.substring_index("path", "/", -1)
    stem = F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
    flat = r"(?s)\A---\n(.*?)\n---\n"
    url = F.coalesce(fm.scalar("text", "source_url", flat), fm.scalar("text", "url", flat), F.lit(""))
    explicit = F.coalesce(fm.scalar("text", "id", flat), fm.scalar("text", "source_id", flat))
    ident = identity.source_identity(
        url,
        F.concat_ws("\n", "path", url, "text"),
        explicit=explicit,
        arxiv_field=F.coalesce(fm.scalar("text", "arxiv_id", flat), fm.scalar("text", "arxiv", flat)),
        doi_field=fm.scalar("text", "doi", flat),
        content_hash=identity.short_file_hash(F.encode("text", "UTF-8")),
    )
    return files.select(
        "path",
        ident.alias("ident"),
        F.coalesce(fm.scalar("text", "title", flat), prose.first_heading("text"), stem).alias("title"),
        F.coalesce(
            fm.scalar("text", "source_type", flat),
            blank_to_null(F.regexp_replace(parent, "s+$", "")),
            F.regexp_extract("path", r"\.([^.]*)$", 1),
        ).alias("source_type"),
        identity.short_file_hash(F.encode("text", "UTF-8")).alias("content_hash"),
    ).select("path", "ident.*", "title", "source_type", "content_hash")


# ---- declarative listing views ------------------------------------------------


def tagged(meta: DataFrame, tag: str, status: str | None = None) -> DataFrame:
    kept = meta.where(F.array_contains("tags", tag))
    return kept.where(F.col("status") == status) if status else kept


def days_since(day: Column, today: Column) -> Column:
    return F.datediff(today, day).cast("bigint")


def overdue(due: Column, done: Column, today: Column) -> Column:
    return F.coalesce((due < today) & ~done, F.lit(False))


def status_icon(status: Column, icons: dict[str, str], other: str) -> Column:
    out = F.lit(other)
    for name, icon in icons.items():
        out = F.when(status == name, F.lit(icon)).otherwise(out)
    return out


def facts_as_of(facts: DataFrame, valid_on: Column, known_on: Column) -> DataFrame:
    """Bi-temporal facts that held on one day as known on another."""
    return facts.where(
        (F.col("valid_from") <= valid_on)
        & (F.col("valid_until").isNull() | (F.col("valid_until") > valid_on))
        & (F.col("learned") <= known_on)
    )
