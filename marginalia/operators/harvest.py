"""Harvested records: payload parsing, candidates, dedup against seen and ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions import identity, prose
from marginalia.functions.basics import blank_to_null, present, strip

CANDIDATE_COLUMNS = ["title", "url", "source_id", "id_type", "published", "snippet", "engine"]
SNIPPET_CHARS = 500

# Payload fields of the public search services and the lookup
# that maps registry entries to services.
OPENALEX = """struct<results:array<struct<title:string,doi:string,id:string,publication_year:int,
 publication_date:string,abstract_inverted_index:map<string,array<int>>>>>"""
CROSSREF = """struct<message:struct<items:array<struct<title:array<string>,DOI:string,URL:string,abstract:string,
 issued:struct<`date-parts`:array<array<int>>>>>>>"""
SEMANTIC_SCHOLAR = """struct<data:array<struct<title:string,abstract:string,url:string,year:int,
 externalIds:struct<DOI:string>>>>"""
HACKERNEWS = "struct<hits:array<struct<title:string,url:string,objectID:string,created_at:string,story_text:string>>>"
REDDIT = "struct<data:struct<children:array<struct<data:struct<title:string,url:string,selftext:string,created_utc:double>>>>>"
LOBSTERS_STORY = "struct<title:string,url:string,short_id_url:string,description:string,created_at:string>"
RELEASES = "array<struct<name:string,tag_name:string,html_url:string,published_at:string,body:string>>"
PAPER_ENGINES = ["arxiv", "openalex", "semantic_scholar", "crossref"]
LOBSTERS_LIMIT = 25
# End of the fixed values.


def iso_day(c: Column) -> Column:
    """Day part of a date text, else its first ten characters."""
    raw = F.coalesce(c, F.lit(""))
    return F.substring(raw, 1, 10)


def candidate(title, url, source_id, id_type, published, snippet, engine) -> list[Column]:
    """The seven candidate columns, blanks for what is missing."""
    values = [title, url, source_id, id_type, published, snippet, engine]
    return [F.coalesce(v, F.lit("")).alias(n) for v, n in zip(values, CANDIDATE_COLUMNS)]


def paper_candidates(results: DataFrame, engine: str) -> DataFrame:
    """Paper results ``(title, url, abstract, published, doi)`` as candidates."""
    kept = results.withColumn("ident", identity.paper_identity(F.col("url"), F.col("doi")))
    return kept.select(
        *candidate(
            F.col("title"), F.col("url"), F.col("ident.source_id"), F.col("ident.id_type"),
            iso_day(F.col("published")), F.substring("abstract", 1, SNIPPET_CHARS), F.lit(engine),
        )
    )


def forum_candidates(results: DataFrame, engine: str) -> DataFrame:
    """Forum results ``(title, url, snippet, published)``; the address is the id."""
    return results.select(
        *candidate(
            F.col("title"), F.col("url"), F.col("url"), F.lit("url"),
            iso_day(F.col("published")), F.substring("snippet", 1, SNIPPET_CHARS), F.lit(engine),
        )
    )


def citation_candidates(citations: DataFrame) -> DataFrame:
    """Cited addresses ``(url, snippet)`` of an answer as candidates."""
    url = F.col("url")
    arxiv, doi = identity.arxiv_of_url(url), identity.doi_of_url(url)
    kind = F.when(arxiv.isNotNull(), "arxiv").when(doi.isNotNull(), "doi").otherwise("url")
    sid = F.coalesce(F.concat(F.lit("arxiv:"), arxiv), doi, F.lit("perplexity"))
    return citations.select(
        *candidate(identity.short_title_of_url(url), url, sid, kind, F.lit(""), F.col("snippet"), F.lit("perplexity"))
    )


def abstract_of_positions(index: Column) -> Column:
    """Text of a ``word -> positions`` map."""
    placed = F.flatten(
        F.transform(
            F.map_entries(index),
            lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("at"), e["key"].alias("word"))),
        )
    )
    return F.array_join(F.transform(F.sort_array(placed), lambda x: x["word"]), " ")


def _items(payloads: DataFrame, schema: str, path: str) -> DataFrame:
    """One row per item; a payload that is no valid JSON yields none."""
    read = payloads.select(F.from_json("payload", schema.replace("\n", "")).alias("p"))
    return read.select(F.explode_outer(F.col(f"p.{path}") if path else F.col("p")).alias("r")).where(present("r"))


def openalex_results(payloads: DataFrame) -> DataFrame:
    doi = F.regexp_replace("r.doi", "^https?://doi.org/", "")
    return _items(payloads, OPENALEX, "results").select(
        F.col("r.title").alias("title"),
        F.coalesce(blank_to_null(F.col("r.doi")), F.col("r.id")).alias("url"),
        abstract_of_positions(F.col("r.abstract_inverted_index")).alias("abstract"),
        F.coalesce(F.col("r.publication_date"), F.col("r.publication_year").cast("string")).alias("published"),
        doi.alias("doi"),
    )


def crossref_results(payloads: DataFrame) -> DataFrame:
    doi = F.col("r.DOI")
    year = F.get(F.get(F.col("r.issued.`date-parts`"), F.lit(0)), F.lit(0))
    return _items(payloads, CROSSREF, "message.items").select(
        F.coalesce(F.get("r.title", F.lit(0)), F.lit("")).alias("title"),
        F.coalesce(F.concat(F.lit("https://doi.org/"), blank_to_null(doi)), F.col("r.URL")).alias("url"),
        F.col("r.abstract").alias("abstract"),
        year.cast("string").alias("published"),
        doi.alias("doi"),
    )


def semantic_scholar_results(payloads: DataFrame) -> DataFrame:
    return _items(payloads, SEMANTIC_SCHOLAR, "data").select(
        F.col("r.title").alias("title"), F.col("r.url").alias("url"), F.col("r.abstract").alias("abstract"),
        F.col("r.year").cast("string").alias("published"), F.col("r.externalIds.DOI").alias("doi"),
    )


def hackernews_results(payloads: DataFrame) -> DataFrame:
    item = F.concat(F.lit("https://news.ycombinator.com/item?id="), F.col("r.objectID"))
    return _items(payloads, HACKERNEWS, "hits").select(
        F.col("r.title").alias("title"),
        F.coalesce(blank_to_null(F.col("r.url")), item).alias("url"),
        F.col("r.story_text").alias("snippet"),
        F.col("r.created_at").alias("published"),
    )


def reddit_results(payloads: DataFrame) -> DataFrame:
    return _items(payloads, REDDIT, "data.children").select(
        F.col("r.data.title").alias("title"), F.col("r.data.url").alias("url"), F.col("r.data.selftext").alias("snippet"),
        F.date_format(F.timestamp_seconds("r.data.created_utc"), "yyyy-MM-dd").alias("published"),
    )


def lobsters_results(payloads: DataFrame) -> DataFrame:
    """Stories of a bare list or of ``{"stories": [...]}``, the first 25 of each."""
    bare = F.from_json("payload", f"array<{LOBSTERS_STORY}>")
    wrapped = F.from_json("payload", f"struct<stories:array<{LOBSTERS_STORY}>>")["stories"]
    stories = F.when(F.rlike("payload", F.lit(r"^\s*\[")), bare).otherwise(wrapped)
    return payloads.select(F.explode_outer(F.slice(stories, 1, LOBSTERS_LIMIT)).alias("r")).where(present("r")).select(
        F.col("r.title").alias("title"),
        F.coalesce(blank_to_null(F.col("r.url")), F.col("r.short_id_url")).alias("url"),
        F.col("r.description").alias("snippet"),
        F.col("r.created_at").alias("published"),
    )


def release_candidates(payloads: DataFrame) -> DataFrame:
    """Releases ``(repo_url, source_id, payload)`` of code repositories."""
    read = payloads.select(
        "source_id", identity.repo_of_url(F.col("repo_url")).alias("repo"), F.explode_outer(F.from_json("payload", RELEASES)).alias("r")
    ).where(present("r"))
    title = F.concat(F.col("repo"), F.lit(" "), F.coalesce(blank_to_null(F.col("r.name")), F.col("r.tag_name")))
    return read.select(
        *candidate(
            title, F.col("r.html_url"), F.col("source_id"), F.lit("url"),
            iso_day(F.col("r.published_at")), F.substring("r.body", 1, SNIPPET_CHARS), F.lit("github"),
        )
    )


def feed_candidates(entries: DataFrame, since: str | None = None, limit: int | None = None) -> DataFrame:
    """Feed entries ``(source_id, title, link, published, updated, summary)``.

    Undated entries always pass ``since``; ``limit`` keeps the newest of a feed.
    """
    day = iso_day(F.coalesce(blank_to_null(F.col("published")), F.col("updated")))
    kept = entries.withColumn("day", day)
    if since:
        kept = kept.where((F.col("day") == "") | (F.col("day") >= since))
    if limit:
        from pyspark.sql.window import Window

        order = Window.partitionBy("source_id").orderBy(F.col("day").desc(), "link")
        kept = kept.withColumn("n", F.row_number().over(order)).where(F.col("n") <= limit)
    return kept.select(
        *candidate(
            F.col("title"), F.col("link"), F.col("source_id"), F.lit("url"), F.col("day"),
            F.substring("summary", 1, SNIPPET_CHARS), F.lit("rss"),
        )
    )


def injected_candidates(records: DataFrame) -> DataFrame:
    """Hand-fed records ``(title, url, source_id, id_type, engine, lane, ...)`` with defaults."""
    sid = F.coalesce(F.col("source_id"), F.lit(""))
    kind = (
        F.when(F.startswith(sid, F.lit("arxiv:")), "arxiv").when(F.startswith(sid, F.lit("doi:")), "doi").otherwise("url")
    )
    usable = records.where((F.coalesce("url", F.lit("")) != "") & (F.coalesce("title", F.lit("")) != ""))
    return usable.select(
        *candidate(
            F.col("title"), F.col("url"), F.coalesce(blank_to_null(sid), F.col("url")),
            F.coalesce(blank_to_null(F.col("id_type")), kind), F.col("published"), F.col("snippet"),
            F.coalesce(blank_to_null(F.col("engine")), F.lit("websearch")),
        ),
        F.coalesce(blank_to_null(F.col("lane")), F.lit("news")).alias("lane"),
    )


def drop_seen(candidates: DataFrame, seen: DataFrame, order: str) -> DataFrame:
    """Candidates not in ``seen(ident)``, the first of each id; no id, no dedup.

    Only the key and the order are grouped (map-side), and the row that carries
    the smallest order is kept, so a hot id costs one partial row per task.
    """
    key = identity.seen_identity(F.col("id_type"), F.col("source_id"), F.col("url"))
    keyed = candidates.withColumn("ident", key)
    named = keyed.where("ident <> ''").join(seen, "ident", "left_anti")
    return first_of_each(named, "ident", order).unionByName(keyed.where("ident = ''"))


def first_of_each(rows: DataFrame, key: str, *order: str | Column) -> DataFrame:
    """Row with the smallest ``order`` of every ``key``, by a map-side aggregate."""
    sort = F.struct(*[F.col(o).alias(f"o{i}") if isinstance(o, str) else o.alias(f"o{i}") for i, o in enumerate(order)])
    best = rows.groupBy(F.col(key).alias("_key")).agg(
        F.min_by(F.struct(*[F.col(c) for c in rows.columns]), sort).alias("best")
    )
    return best.select("best.*")


def seen_after(seen: DataFrame, staged: DataFrame) -> DataFrame:
    """Earlier ids and those of the staged candidates; nothing else is kept."""
    return seen.select("ident").unionByName(staged.select("ident").where("ident <> ''")).distinct()


def drop_ledgered(candidates: DataFrame, ledger: DataFrame) -> DataFrame:
    """Candidates whose id or address is already decided in the ledger.

    The either-or is two anti joins, so neither becomes a nested loop.
    """
    decided = ledger.where(F.col("status").isin("ingested", "pending", "rejected"))
    ids = decided.select(F.coalesce(blank_to_null(F.col("id")), F.col("source_id")).alias("ident")).where("ident <> ''").distinct()
    urls = decided.select(F.regexp_replace("url", "/+$", "").alias("bare_url")).where("bare_url <> ''").distinct()
    keyed = candidates.withColumn("ident", identity.item_identity(F.col("source_id"), F.col("url"))).withColumn(
        "bare_url", F.regexp_replace(F.coalesce("url", F.lit("")), "/+$", "")
    )
    return keyed.join(ids, "ident", "left_anti").join(urls, "bare_url", "left_anti").drop("bare_url")


def distinct_calls(calls: DataFrame) -> DataFrame:
    """Search calls run once per target, service, query and category."""
    return calls.dropDuplicates(["target_id", "engine", "query", "category"])


def paper_engine(entry_id: Column, category: Column, engines: dict[str, str]) -> Column:
    """Service of a registry entry: by id, by prefix, by category."""
    by_id = F.lit(None).cast("string")
    for key, value in engines.items():
        by_id = F.when(entry_id == key, F.lit(value)).otherwise(by_id)
    return (
        F.when(by_id.isNotNull(), by_id)
        .when(F.startswith(entry_id, F.lit("arxiv_")), F.lit("arxiv"))
        .when(entry_id == "papers_with_code", F.lit(""))
        .when(category == "preprint_repository", F.lit("arxiv"))
        .when(category == "paper_api", F.lit("semantic_scholar"))
        .otherwise(F.lit(""))
    )


def page_candidates(pages: DataFrame) -> DataFrame:
    """Crawled pages ``(page_id, url, html)`` as candidates with a clean text."""
    title = F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1)
    return pages.select(
        "page_id",
        *candidate(
            prose.plain_text(title), F.col("url"), identity.host_of_url(F.col("url")), F.lit("url"),
            F.lit(""), page_text(F.col("html")), F.lit("rss"),
        ),
    )


def page_text(html: Column) -> Column:
    """Readable text of a page: scripts, styles, comments and tags removed."""
    bare = F.regexp_replace(html, r"(?is)<(script|style|nav)\b.*?</\1>|<!--.*?-->", " ")
    return strip(F.regexp_replace(F.regexp_replace(bare, r"<[^>]+>", " "), r"\s+", " "))


def rationale_columns(candidates: DataFrame) -> DataFrame:
    """Rationale, summary and relevance texts of candidates."""
    return candidates.withColumns(
        {
            "rationale": prose.content_rationale(F.col("snippet"), F.col("lane"), F.col("origin_ids")),
            "summary": prose.content_summary(F.col("snippet")),
            "relevance": prose.relevance_paragraph(
                F.col("lane"), F.col("origin_ids"), F.col("expected_evidence"), F.col("score"), F.col("engine"), F.col("source_id")
            ),
        }
    )


def title_or_stem(stored: Column, page_title: Column, file_title: Column) -> Column:
    """Best title: a real stored one, else that of the page, else of the file."""
    def usable(t: Column) -> Column:
        return F.when(~identity.looks_like_stem(t), strip(t))

    return F.coalesce(usable(stored), usable(page_title), usable(file_title), strip(F.coalesce(stored, F.lit(""))))


