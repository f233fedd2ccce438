"""Identities, URL forms, harvest payloads and candidate texts over ``pages``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.catalog import fragments as fr
from marginalia.catalog.base import query
from marginalia.functions import identity, nested, prose
from marginalia.functions.basics import bind, present
from marginalia.operators import harvest
from marginalia.plans.derived import CANDIDATES_SQL, HOST_SQL, PAGE_TEXT_SQL, page_candidates
from marginalia.session import read_table, written


def pages(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "pages")


@query(
    "url_forms",
    rf"""SELECT page_id, {fr.canonical_url('url')} AS canonical, regexp_matches(url, '^https?://[^/?#]+') AS valid, {HOST_SQL} AS host,
 array_to_string([x for x in [{HOST_SQL}, array_to_string(list_slice(ps, greatest(len(ps) - 1, 1), len(ps)), '/')] if x <> ''], '/') AS short_title,
 coalesce(nullif(left(regexp_replace(regexp_replace(lower(coalesce(nullif(ps[len(ps)], ''), {HOST_SQL})), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 80), ''), 'article') AS slug
FROM (SELECT *, [p for p in string_split(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/') if p <> ''] AS ps FROM pages)""",
)
def url_forms(spark: SparkSession, folder: str) -> DataFrame:
    url = F.col("url")
    return pages(spark, folder).select(
        "page_id", identity.canonical_url(url).alias("canonical"), identity.valid_url(url).alias("valid"),
        identity.host_of_url(url).alias("host"), identity.short_title_of_url(url).alias("short_title"),
        prose.article_slug(url).alias("slug"),
    )


@query(
    "url_duplicates",
    f"""SELECT canonical, count(*) AS pages, min(page_id) AS first_page FROM (SELECT page_id, {fr.canonical_url('url')} AS canonical FROM pages)
GROUP BY canonical HAVING count(*) > 1""",
)
def url_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    named = pages(spark, folder).select("page_id", identity.canonical_url(F.col("url")).alias("canonical"))
    return named.groupBy("canonical").agg(F.count(F.lit(1)).alias("pages"), F.min("page_id").alias("first_page")).where("pages > 1")


_HAY = "html || CASE page_id % 5 WHEN 1 THEN ' arXiv:2401.' || lpad(cast(page_id AS varchar), 5, '0') || 'v2 ' WHEN 2 THEN ' 10.1000/AB.' || page_id || ' ' WHEN 3 THEN ' youtu.be/abcdefghij' || (page_id % 10) || ' ' ELSE '' END"


@query(
    "stable_ids",
    rf"""WITH h AS (SELECT page_id, url, {_HAY} AS hay FROM pages),
x AS (SELECT *, nullif(regexp_extract(hay, '(?i)(?:arxiv[:/ ]?)?\b(\d{{4}}\.\d{{4,5}})(?:v\d+)?\b', 1), '') AS a,
  nullif(regexp_extract(hay, '\b(10\.\d{{4,9}}/[-._;()/:A-Za-z0-9]+)\b', 1), '') AS d,
  nullif(regexp_extract(hay, '(?:youtube\.com/watch\?v=|youtu\.be/)([A-Za-z0-9_-]{{11}})', 1), '') AS y FROM h)
SELECT page_id, CASE WHEN a IS NOT NULL THEN 'arxiv:' || a WHEN d IS NOT NULL THEN 'doi:' || lower(d) WHEN y IS NOT NULL THEN 'youtube:' || y
  ELSE 'url:' || {fr.canonical_url('url')} END AS id,
 CASE WHEN a IS NOT NULL THEN 'arxiv' WHEN d IS NOT NULL THEN 'doi' WHEN y IS NOT NULL THEN 'youtube' ELSE 'url' END AS id_type, url FROM x""",
)
def stable_ids(spark: SparkSession, folder: str) -> DataFrame:
    i = F.col("page_id")
    extra = (
        F.when(i % 5 == 1, F.concat(F.lit(" arXiv:2401."), F.lpad(i.cast("string"), 5, "0"), F.lit("v2 ")))
        .when(i % 5 == 2, F.concat(F.lit(" 10.1000/AB."), i, F.lit(" ")))
        .when(i % 5 == 3, F.concat(F.lit(" youtu.be/abcdefghij"), i % 10, F.lit(" ")))
        .otherwise(F.lit(""))
    )
    ident = identity.source_identity(F.col("url"), F.concat("html", extra))
    return pages(spark, folder).select("page_id", ident.alias("s")).select("page_id", "s.*")


@query(
    "proposed_ids",
    rf"""WITH r AS (SELECT page_id, url, CASE page_id % 4 WHEN 0 THEN 'arxiv:2401.0' || page_id WHEN 1 THEN url WHEN 2 THEN 'plain-' || page_id ELSE 'url:' || url END AS raw FROM pages)
SELECT page_id, CASE page_id % 4 WHEN 0 THEN raw WHEN 1 THEN 'url:' || {fr.canonical_url('url')} WHEN 2 THEN 'id:' || raw ELSE raw END AS id,
 CASE page_id % 4 WHEN 0 THEN 'arxiv' WHEN 1 THEN 'url' WHEN 2 THEN 'explicit' ELSE 'url' END AS id_type,
 CASE page_id % 4 WHEN 0 THEN '' WHEN 2 THEN '' ELSE url END AS url FROM r""",
)
def proposed_ids(spark: SparkSession, folder: str) -> DataFrame:
    i = F.col("page_id")
    raw = (
        F.when(i % 4 == 0, F.concat(F.lit("arxiv:2401.0"), i)).when(i % 4 == 1, F.col("url"))
        .when(i % 4 == 2, F.concat(F.lit("plain-"), i)).otherwise(F.concat(F.lit("url:"), "url"))
    )
    return pages(spark, folder).select("page_id", identity.proposed_identity(raw).alias("s")).select("page_id", "s.*")


@query(
    "item_identities",
    rf"""WITH {CANDIDATES_SQL}
SELECT cand_id, ident, CASE WHEN id_type IN ('arxiv', 'doi') AND source_id <> '' THEN source_id ELSE coalesce(nullif(url, ''), source_id) END AS seen_id FROM idents""",
)
def item_identities(spark: SparkSession, folder: str) -> DataFrame:
    found = page_candidates(spark, folder)
    return found.select(
        "cand_id", identity.item_identity(F.col("source_id"), F.col("url")).alias("ident"),
        identity.seen_identity(F.col("id_type"), F.col("source_id"), F.col("url")).alias("seen_id"),
    )


@query(
    "page_texts",
    rf"""SELECT page_id, {PAGE_TEXT_SQL} AS text, cast(length({PAGE_TEXT_SQL}) AS bigint) AS chars FROM pages""",
)
def page_texts(spark: SparkSession, folder: str) -> DataFrame:
    text = harvest.page_text(F.col("html"))
    return pages(spark, folder).select("page_id", text.alias("text")).select("page_id", "text", F.length("text").cast("bigint").alias("chars"))


@query(
    "candidate_texts",
    rf"""WITH {CANDIDATES_SQL},
w AS (SELECT cand_id, snippet, string_split(snippet, ' ') AS ws, left(snippet, 220) AS head, lane, origin, score, engine, source_id FROM cands),
x AS (SELECT *, array_to_string(ws[1:200], ' ') AS head200 FROM w)
SELECT cand_id,
 CASE WHEN length(snippet) > 220 THEN CASE WHEN regexp_matches(head, '[.!?](\s|$)') THEN trim(regexp_extract(head, '(?s)^(.*?[.!?])(?:\s|$)', 1)) ELSE rtrim(head) || '...' END
      WHEN snippet = '' THEN 'lane=' || lane || '; serves ' || origin ELSE snippet END AS rationale,
 CASE WHEN snippet = '' OR len(ws) < 5 THEN 'No abstract/snippet retrieved -- fetch the URL to summarize.'
      WHEN len(ws) > 200 THEN CASE WHEN regexp_matches(head200, '[.!?](\s|$)') THEN trim(regexp_extract(head200, '(?s)^(.*?[.!?])(?:\s|$)', 1)) ELSE regexp_replace(head200, '[,;:]+$', '') || '...' END
      ELSE snippet END AS summary,
 'Selected for the ' || lane || ' lane to serve ' || origin || '. The web agent sought: evidence ' || (cand_id % 9)
   || '. Ranked by semantic relevance to the vault PURPOSE (score ' || printf('%.3f', score) || '); retrieved via ' || engine || ' from ' || source_id || '.' AS relevance
FROM x""",
)
def candidate_texts(spark: SparkSession, folder: str) -> DataFrame:
    return harvest.rationale_columns(page_candidates(spark, folder)).select("cand_id", "rationale", "summary", "relevance")


@query(
    "html_links",
    rf"""WITH l AS (SELECT page_id, unnest({fr.HREFS}) AS href FROM pages)
SELECT regexp_replace(href, '^.*/', '') AS target, count(*) AS uses, count(DISTINCT page_id) AS pages FROM l GROUP BY ALL""",
)
def html_links(spark: SparkSession, folder: str) -> DataFrame:
    """Link targets with their uses; a page's repeats are folded in its row first."""
    from marginalia.functions.tokens import term_counts

    hrefs = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    targets = F.transform(hrefs, prose.link_target)
    counted = pages(spark, folder).select(F.explode_outer(term_counts(targets)).alias("c")).where(present("c"))
    return counted.groupBy(F.col("c.term").alias("target")).agg(F.sum("c.tf").alias("uses"), F.count(F.lit(1)).alias("pages"))


def _payload(spark: SparkSession, folder: str, payload) -> DataFrame:
    read = harvest.page_candidates(pages(spark, folder))
    return read.select("page_id", payload.alias("payload"))


@query(
    "crossref_candidates",
    rf"""WITH {CANDIDATES_SQL}
SELECT title, 'https://doi.org/10.1/' || cand_id AS url, '10.1/' || cand_id AS source_id, 'doi' AS id_type, cast(2000 + cand_id % 20 AS varchar) AS published,
 left(snippet, 500) AS snippet, 'crossref' AS engine FROM cands""",
)
def crossref_candidates(spark: SparkSession, folder: str) -> DataFrame:
    i = F.col("page_id")
    item = F.struct(
        F.array("title").alias("title"), F.concat(F.lit("10.1/"), i).alias("DOI"), F.col("url").alias("URL"),
        F.col("snippet").alias("abstract"), F.struct(F.array(F.array((2000 + i % 20).cast("int"))).alias("date-parts")).alias("issued"),
    )
    payload = F.to_json(F.struct(F.struct(F.array(item).alias("items")).alias("message")))
    return harvest.paper_candidates(harvest.crossref_results(_payload(spark, folder, payload)), "crossref")


@query(
    "openalex_candidates",
    rf"""WITH {CANDIDATES_SQL}
SELECT title, CASE WHEN cand_id % 2 = 0 THEN 'https://doi.org/10.2/' || cand_id ELSE 'https://openalex.org/W' || cand_id END AS url,
 CASE WHEN cand_id % 2 = 0 THEN '10.2/' || cand_id ELSE 'https://openalex.org/W' || cand_id END AS source_id,
 CASE WHEN cand_id % 2 = 0 THEN 'doi' ELSE 'url' END AS id_type, published,
 left(array_to_string(string_split(snippet, ' '), ' '), 500) AS snippet, 'openalex' AS engine FROM cands""",
)
def openalex_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Abstracts arrive as word positions and are put back in order."""
    i = F.col("page_id")
    placed = F.sort_array(F.transform(F.split("snippet", " "), lambda w, at: F.struct(w.alias("word"), at.alias("at"))))

    def grouped(p: Column) -> Column:
        """Positions per word: runs of equal words in the sorted pairs."""
        starts = F.filter(F.sequence(F.lit(1), F.size(p)), lambda k: (k == 1) | (F.get(p, k - 1)["word"] != F.get(p, k - 2)["word"]))

        def runs(s: Column) -> Column:
            def run(start: Column, k: Column) -> Column:
                positions = F.slice(p, start, F.coalesce(F.get(s, k + 1), F.size(p) + 1) - start)
                return F.struct(F.get(p, start - 1)["word"].alias("key"), F.transform(positions, lambda x: x["at"]).alias("value"))

            return F.map_from_entries(F.transform(s, run))

        return bind(starts, runs)

    index = bind(placed, grouped)
    item = F.struct(
        F.col("title"), F.when(i % 2 == 0, F.concat(F.lit("https://doi.org/10.2/"), i)).alias("doi"),
        F.concat(F.lit("https://openalex.org/W"), i).alias("id"),
        F.format_string("2023-%02d-%02d", i % 12 + 1, i % 28 + 1).alias("publication_date"), index.alias("abstract_inverted_index"),
    )
    payload = F.to_json(F.struct(F.array(item).alias("results")))
    return harvest.paper_candidates(harvest.openalex_results(_payload(spark, folder, payload)), "openalex")


@query(
    "forum_candidates",
    rf"""WITH {CANDIDATES_SQL}
SELECT title, CASE WHEN cand_id % 3 = 0 THEN 'https://news.ycombinator.com/item?id=' || cand_id ELSE url END AS url,
 CASE WHEN cand_id % 3 = 0 THEN 'https://news.ycombinator.com/item?id=' || cand_id ELSE url END AS source_id,
 'url' AS id_type, published, left(snippet, 500) AS snippet, 'hackernews' AS engine FROM cands
UNION ALL
SELECT title, url, url, 'url', '2023-11-14', left(snippet, 500), 'reddit' FROM cands
UNION ALL
SELECT title, url, url, 'url', published, left(snippet, 500), 'lobsters' FROM cands""",
)
def forum_candidates(spark: SparkSession, folder: str) -> DataFrame:
    i = F.col("page_id")
    day = F.format_string("2023-%02d-%02d", i % 12 + 1, i % 28 + 1)
    hit = F.struct(
        F.col("title"), F.when(i % 3 == 0, F.lit("")).otherwise(F.col("url")).alias("url"), i.cast("string").alias("objectID"),
        F.concat(day, F.lit("T10:00:00Z")).alias("created_at"), F.col("snippet").alias("story_text"),
    )
    hn = F.to_json(F.struct(F.array(hit).alias("hits")))
    post = F.struct(F.struct("title", "url", F.col("snippet").alias("selftext"), F.lit(1700000000.0).alias("created_utc")).alias("data"))
    reddit = F.to_json(F.struct(F.struct(F.array(post).alias("children")).alias("data")))
    story = F.struct("title", "url", F.col("snippet").alias("description"), day.alias("created_at"))
    stories = F.to_json(F.array(story))
    wrapped = F.when(i % 2 == 0, stories).otherwise(F.concat(F.lit('{"stories":'), stories, F.lit("}")))
    return (
        harvest.forum_candidates(harvest.hackernews_results(_payload(spark, folder, hn)), "hackernews")
        .unionByName(harvest.forum_candidates(harvest.reddit_results(_payload(spark, folder, reddit)), "reddit"))
        .unionByName(harvest.forum_candidates(harvest.lobsters_results(_payload(spark, folder, wrapped)), "lobsters"))
    )


@query(
    "scholar_candidates",
    rf"""WITH {CANDIDATES_SQL}
SELECT title, CASE WHEN cand_id % 4 = 0 THEN 'https://arxiv.org/abs/2401.' || lpad(cast(cand_id AS varchar), 5, '0') ELSE url END AS url,
 CASE WHEN cand_id % 4 = 0 THEN 'arxiv:2401.' || lpad(cast(cand_id AS varchar), 5, '0') WHEN cand_id % 4 = 1 THEN '10.3/' || cand_id ELSE url END AS source_id,
 CASE WHEN cand_id % 4 = 0 THEN 'arxiv' WHEN cand_id % 4 = 1 THEN 'doi' ELSE 'url' END AS id_type,
 cast(2000 + cand_id % 20 AS varchar) AS published, left(snippet, 500) AS snippet, 'semantic_scholar' AS engine FROM cands""",
)
def scholar_candidates(spark: SparkSession, folder: str) -> DataFrame:
    i = F.col("page_id")
    item = F.struct(
        F.col("title"), F.col("snippet").alias("abstract"),
        F.when(i % 4 == 0, F.concat(F.lit("https://arxiv.org/abs/2401."), F.lpad(i.cast("string"), 5, "0"))).otherwise(F.col("url")).alias("url"),
        (2000 + i % 20).cast("int").alias("year"), F.struct(F.when(i % 4 == 1, F.concat(F.lit("10.3/"), i)).alias("DOI")).alias("externalIds"),
    )
    payload = F.to_json(F.struct(F.array(item).alias("data")))
    return harvest.paper_candidates(harvest.semantic_scholar_results(_payload(spark, folder, payload)), "semantic_scholar")


@query(
    "release_candidates",
    rf"""WITH {CANDIDATES_SQL}
SELECT 'own' || cand_id || '/repo' || ' ' || CASE WHEN cand_id % 2 = 0 THEN title ELSE 'v' || cand_id END AS title, url, 'feed' || (cand_id % 7) AS source_id, 'url' AS id_type,
 published, left(snippet, 500) AS snippet, 'github' AS engine FROM (SELECT * REPLACE (coalesce(nullif(title, ''), 'v' || cand_id) AS title) FROM cands)""",
)
def release_candidates(spark: SparkSession, folder: str) -> DataFrame:
    i = F.col("page_id")
    read = harvest.page_candidates(pages(spark, folder))
    release = F.struct(
        F.when(i % 2 == 0, F.col("title")).otherwise(F.lit("")).alias("name"), F.concat(F.lit("v"), i).alias("tag_name"),
        F.col("url").alias("html_url"), F.format_string("2023-%02d-%02dT00:00:00Z", i % 12 + 1, i % 28 + 1).alias("published_at"),
        F.col("snippet").alias("body"),
    )
    repo = F.concat(F.lit("https://github.com/own"), i, F.lit("/repo.git"))
    payloads = read.select(repo.alias("repo_url"), F.concat(F.lit("feed"), i % 7).alias("source_id"), F.to_json(F.array(release)).alias("payload"))
    return harvest.release_candidates(payloads)


@query(
    "citation_candidates",
    rf"""WITH {CANDIDATES_SQL}, u AS (SELECT cand_id, snippet, CASE cand_id % 3 WHEN 0 THEN 'https://arxiv.org/abs/2401.' || lpad(cast(cand_id AS varchar), 5, '0') WHEN 1 THEN 'https://doi.org/10.5/' || cand_id || '?x=1' ELSE regexp_replace(url, '[?#].*$', '') END AS url FROM cands)
SELECT CASE cand_id % 3 WHEN 0 THEN 'arxiv.org/abs/2401.' || lpad(cast(cand_id AS varchar), 5, '0') WHEN 1 THEN 'doi.org/10.5/' || cand_id
  ELSE {HOST_SQL} || '/' || array_to_string(list_slice(ps, greatest(len(ps) - 1, 1), len(ps)), '/') END AS title, url,
 CASE cand_id % 3 WHEN 0 THEN 'arxiv:2401.' || lpad(cast(cand_id AS varchar), 5, '0') WHEN 1 THEN '10.5/' || cand_id ELSE 'perplexity' END AS source_id,
 CASE cand_id % 3 WHEN 0 THEN 'arxiv' WHEN 1 THEN 'doi' ELSE 'url' END AS id_type, '' AS published, snippet, 'perplexity' AS engine
FROM (SELECT *, [p for p in string_split(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/') if p <> ''] AS ps FROM u)""",
)
def citation_candidates(spark: SparkSession, folder: str) -> DataFrame:
    i = F.col("page_id")
    url = (
        F.when(i % 3 == 0, F.concat(F.lit("https://arxiv.org/abs/2401."), F.lpad(i.cast("string"), 5, "0")))
        .when(i % 3 == 1, F.concat(F.lit("https://doi.org/10.5/"), i, F.lit("?x=1")))
        .otherwise(F.regexp_replace("url", "[?#].*$", ""))
    )
    return harvest.citation_candidates(harvest.page_candidates(pages(spark, folder)).select(url.alias("url"), "snippet"))


@query(
    "feed_since",
    rf"""WITH {CANDIDATES_SQL}, d AS (SELECT *, CASE WHEN cand_id % 6 = 0 THEN '' ELSE published END AS day FROM cands),
r AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY day DESC, url) AS rn FROM d WHERE day = '' OR day >= '2023-06-01')
SELECT title, url, source_id, 'url' AS id_type, day AS published, left(snippet, 500) AS snippet, 'rss' AS engine FROM r WHERE rn <= 3""",
)
def feed_since(spark: SparkSession, folder: str) -> DataFrame:
    i = F.col("cand_id")
    entries = page_candidates(spark, folder).select(
        "source_id", "title", F.col("url").alias("link"), F.lit("").alias("published"),
        F.when(i % 6 == 0, F.lit(None).cast("string")).otherwise(F.col("published")).alias("updated"), F.col("snippet").alias("summary"),
    )
    return harvest.feed_candidates(entries, "2023-06-01", 3)


@query(
    "injected_candidates",
    rf"""WITH {CANDIDATES_SQL}
SELECT title, url, CASE WHEN cand_id % 10 = 0 THEN source_id WHEN cand_id % 3 = 0 THEN url ELSE source_id END AS source_id,
 CASE WHEN cand_id % 10 = 0 THEN 'arxiv' ELSE 'url' END AS id_type, published, snippet,
 CASE WHEN cand_id % 2 = 0 THEN 'websearch' ELSE engine END AS engine, CASE WHEN cand_id % 4 = 1 THEN 'news' ELSE lane END AS lane
FROM cands WHERE title <> '' AND cand_id % 11 <> 0""",
)
def injected_candidates(spark: SparkSession, folder: str) -> DataFrame:
    i = F.col("cand_id")
    records = page_candidates(spark, folder).select(
        "title", F.when(i % 11 == 0, F.lit("")).otherwise(F.col("url")).alias("url"),
        F.when((i % 3 == 0) & (i % 10 != 0), F.lit("")).otherwise(F.col("source_id")).alias("source_id"),
        F.lit("").alias("id_type"), "published", "snippet",
        F.when(i % 2 == 0, F.lit(None).cast("string")).otherwise(F.col("engine")).alias("engine"),
        F.when(i % 4 == 1, F.lit("")).otherwise(F.col("lane")).alias("lane"),
    )
    return harvest.injected_candidates(records)


@query(
    "unseen_candidates",
    rf"""WITH {CANDIDATES_SQL}, k AS (SELECT *, CASE WHEN id_type = 'arxiv' THEN source_id ELSE url END AS sid FROM cands),
f AS (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY cand_id) AS rn FROM k WHERE sid NOT IN (SELECT sid FROM k WHERE cand_id % 7 = 0))
SELECT cand_id, sid AS ident FROM f WHERE rn = 1""",
)
def unseen_candidates(spark: SparkSession, folder: str) -> DataFrame:
    found = page_candidates(spark, folder)
    seen = found.where("cand_id % 7 = 0").select(
        identity.seen_identity(F.col("id_type"), F.col("source_id"), F.col("url")).alias("ident")
    )
    return harvest.drop_seen(found, seen.distinct(), "cand_id").select("cand_id", "ident")


@query(
    "distinct_calls",
    """SELECT count(*) AS calls FROM (SELECT DISTINCT l_orderkey, l_returnflag, l_linestatus, l_suppkey % 4 FROM lineitem)""",
)
def distinct_calls(spark: SparkSession, folder: str) -> DataFrame:
    calls = read_table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("target_id"), F.col("l_returnflag").alias("engine"), F.col("l_linestatus").alias("query"),
        (F.col("l_suppkey") % 4).alias("category"),
    )
    return harvest.distinct_calls(calls).agg(F.count(F.lit(1)).alias("calls"))


# ---- nested headers ---------------------------------------------------------------


def nested_pages(spark: SparkSession, folder: str) -> DataFrame:
    """``documents`` as pages with a nested header."""
    i = F.col("doc_id")
    text = F.concat(
        F.lit("---\nID: "), i, F.lit("\ncreated: "), F.format_string("2023-%02d-%02d", i % 12 + 1, i % 28 + 1), F.lit("\nsolved: "), F.when(i % 3 == 0, "yes").otherwise("no"),
        F.lit("\nscore: "), i, F.lit(".5\nmeta:\n  lang: "), "lang", F.lit("  # of the text\n  counts:\n    chars: "), "n_chars", F.lit("\n    empty:\nsources:\n- name: "), "source",
        F.lit("\n  tags: [a, 'it''s', "), i % 7, F.lit("]\n- name: \"second\"\n"), F.when(i % 10 == 0, F.lit("broken: a: b\n")).otherwise(F.lit("")), F.lit("---\nbody\n"),
    )
    return read_table(spark, folder, "documents").select("doc_id", text.alias("text"))


@query(
    "nested_fields",
    """SELECT doc_id, CASE WHEN ok THEN doc_id END AS id, CASE WHEN ok THEN cast(printf('2023-%02d-%02d', doc_id % 12 + 1, doc_id % 28 + 1) AS date) END AS created, CASE WHEN ok THEN doc_id % 3 = 0 END AS solved,
  CASE WHEN ok THEN doc_id + 0.5::DOUBLE END AS score, CASE WHEN ok THEN lang END AS lang, CASE WHEN ok THEN n_chars END AS chars, CASE WHEN ok THEN source END AS first_source, CASE WHEN ok THEN 'second' END AS second_source,
  CASE WHEN ok THEN 'a|it''s|' || doc_id % 7 END AS tags FROM (SELECT *, doc_id % 10 <> 0 AS ok FROM documents)""",
)
def nested_fields(spark: SparkSession, folder: str) -> DataFrame:
    """Typed fields of nested headers; a header that is malformed in one line has none."""
    # written, so that a header is read once and not for each field
    read = written(nested_pages(spark, folder).select("doc_id", nested.header("text").alias("h")))
    fields = {"id": ("$.ID", "bigint"), "created": ("$.created", "date"), "solved": ("$.solved", "boolean"), "score": ("$.score", "double"), "lang": ("$.meta.lang", "string"), "chars": ("$.meta.counts.chars", "bigint"), "first_source": ("$.sources[0].name", "string"), "second_source": ("$.sources[1].name", "string")}
    tags = F.array_join(nested.field("h", "$.sources[0].tags", "array<string>"), "|").alias("tags")
    return read.select("doc_id", *[nested.field("h", path, kind).alias(name) for name, (path, kind) in fields.items()], tags)


@query(
    "serialised_headers",
    """SELECT doc_id, '---' || chr(10) || CASE WHEN doc_id % 10 = 0 THEN '' ELSE 'ID: ' || doc_id || chr(10) || 'created: "' || printf('2023-%02d-%02d', doc_id % 12 + 1, doc_id % 28 + 1) || '"' || chr(10)
  || 'meta: {"counts":{"chars":' || n_chars || ',"empty":null},"lang":"' || lang || '"}' || chr(10) || 'score: ' || doc_id || '.5' || chr(10) || 'solved: ' || CASE WHEN doc_id % 3 = 0 THEN 'true' ELSE 'false' END || chr(10)
  || 'sources: [{"name":"' || source || '","tags":["a","it''s",' || doc_id % 7 || ']},{"name":"second"}]' || chr(10) END || '---' || chr(10) AS header FROM documents""",
)
def serialised_headers(spark: SparkSession, folder: str) -> DataFrame:
    """Canonical headers, written, read and written again."""
    once = written(nested_pages(spark, folder).select("doc_id", nested.serialised(nested.header("text")).alias("header")))
    return once.select("doc_id", nested.serialised(nested.header("header")).alias("header"))
