"""Audit, link graph, metadata counts and index of the derived vault."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.catalog.base import query
from marginalia.functions import frontmatter as fm
from marginalia.functions import prose
from marginalia.functions.basics import long_size
from marginalia.operators import graph, stats
from marginalia.plans.derived import REPORT_DAY, VAULT_SQL, report_day, vault_pages
from marginalia.session import read_table

LINKS_SQL = r"""
links AS (
  SELECT doc_id, path, area, stem, l AS raw, trim(regexp_extract(trim(l), '([^/]*)$', 1)) AS target
  FROM (SELECT doc_id, path, area, stem, unnest(regexp_extract_all(text, '\[\[([^\]|#]+)', 1)) AS l FROM vault))"""

REQUIRED_SQL = "CASE v.type " + " ".join(
    f"WHEN '{k}' THEN [{', '.join(repr(x) for x in keys)}]" for k, keys in graph.REQUIRED_KEYS.items()
) + f" ELSE [{', '.join(repr(x) for x in graph.OTHER_KEYS)}] END"

ISSUES_SQL = rf"""
meta AS (
  SELECT doc_id, area, path, text, ['concept','entity','source','synthesis','direction','decision','memo'][1 + doc_id % 7] AS type,
    list_concat(['type', 'created', 'updated', 'tags'],
       list_concat(CASE WHEN doc_id % 4 = 0 THEN [] ELSE ['status'] END,
       list_concat(CASE WHEN doc_id % 6 = 0 THEN [] ELSE ['written_by'] END,
                   CASE WHEN doc_id % 5 = 1 THEN ['sources'] ELSE [] END))) AS keys,
    CASE WHEN doc_id % 6 = 0 THEN NULL ELSE ['wiki','research','USER','someone'][1 + doc_id % 4] END AS written_by,
    CASE WHEN doc_id % 3 = 0 THEN cast(printf('2023-%02d-%02d', doc_id % 12 + 1, doc_id % 28 + 1) AS date) END AS quoted_day
  FROM vault),
lacking AS (
  SELECT area, path, list_sort([k for k in {REQUIRED_SQL} if not list_contains(v.keys, k)]) AS ks FROM meta v),
norms AS (
  SELECT path, area, trim(regexp_replace(regexp_replace(lower(regexp_replace(stem, '\d{{4}}-\d{{2}}-\d{{2}}', '', 'g')), '[^a-z0-9 ]', ' ', 'g'), '\s+', ' ', 'g')) AS norm
  FROM vault),
dups AS (
  SELECT path, area, norm, count(*) OVER (PARTITION BY norm) AS files,
         CASE WHEN min(area) OVER (PARTITION BY norm) = max(area) OVER (PARTITION BY norm)
              THEN min(area) OVER (PARTITION BY norm) ELSE 'cross-area' END AS tag
  FROM norms WHERE norm <> ''),
issues AS (
  SELECT area, 'missing_frontmatter' AS "check", path, array_to_string(ks, ', ') AS detail FROM lacking WHERE len(ks) > 0
  UNION ALL SELECT area, 'missing_written_by', path, 'missing written_by' FROM meta WHERE written_by IS NULL
  UNION ALL SELECT area, 'missing_written_by', path, 'invalid written_by: ' || written_by FROM meta
            WHERE written_by IS NOT NULL AND written_by NOT IN ('USER', 'research', 'wiki', 'web', 'backend')
  UNION ALL SELECT area, 'stale', path, '' FROM meta WHERE quoted_day < date '{REPORT_DAY}' - 90
  UNION ALL SELECT area, 'empty', path, '' FROM meta
            WHERE length(regexp_replace(substr(text, strpos(substr(text, 4), '---') + 6), '^\s+|\s+$', '', 'g')) < 50
  UNION ALL SELECT area, 'unfilled_template', path, '' FROM meta WHERE regexp_matches(text, '(?s)<%.*?%>')
  UNION ALL SELECT area, 'dead_links', path, target FROM links WHERE target NOT IN (SELECT stem FROM vault)
  UNION ALL SELECT area, 'orphaned', path, '' FROM vault
            WHERE stem NOT IN (SELECT target FROM links)
              AND (area = 'wiki' OR NOT regexp_matches(text, '\[\[[^\]|#]+'))
  UNION ALL SELECT tag, 'duplicate', path, norm FROM dups WHERE files > 1)"""

AUDIT_CTE = f"WITH {VAULT_SQL}, {LINKS_SQL}, {ISSUES_SQL}"


@query("vault_audit", AUDIT_CTE + ' SELECT area, "check", path, detail FROM issues')
def vault_audit(spark: SparkSession, folder: str) -> DataFrame:
    return graph.audit(vault_pages(spark, folder), report_day())


_COUNT_COLUMNS = ", ".join(
    f"count(DISTINCT CASE WHEN \"check\" = '{c}' THEN detail END) AS {c}" if c == "duplicate"
    else f"count(CASE WHEN \"check\" = '{c}' THEN 1 END) AS {c}"
    for c in graph.CHECKS
)


@query(
    "audit_counts_by_area",
    AUDIT_CTE + f", c AS (SELECT area, {_COUNT_COLUMNS} FROM issues GROUP BY area) SELECT *, {' + '.join(graph.CHECKS)} AS total FROM c",
)
def audit_counts_by_area(spark: SparkSession, folder: str) -> DataFrame:
    return graph.issue_counts(graph.audit(vault_pages(spark, folder), report_day()))


@query(
    "health_score",
    AUDIT_CTE
    + """, c AS (SELECT count(CASE WHEN "check" <> 'duplicate' THEN 1 END) + count(DISTINCT CASE WHEN "check" = 'duplicate' THEN detail END) AS issues FROM issues)
SELECT issues, greatest(0, 100 - 2 * issues) AS score FROM c""",
)
def health_score(spark: SparkSession, folder: str) -> DataFrame:
    return graph.health_score(graph.audit(vault_pages(spark, folder), report_day()))


@query("dead_links", f"WITH {VAULT_SQL}, {LINKS_SQL} SELECT path, target, count(*) AS uses FROM links WHERE target NOT IN (SELECT stem FROM vault) GROUP BY ALL")
def dead_links(spark: SparkSession, folder: str) -> DataFrame:
    pages = graph.with_names(vault_pages(spark, folder))
    dead = graph.dead_links(graph.page_links(pages), pages)
    return dead.groupBy("path", "target").agg(F.count(F.lit(1)).alias("uses"))


@query(
    "missing_pages",
    rf"""WITH {VAULT_SQL}, {LINKS_SQL}
SELECT raw AS term, count(DISTINCT doc_id) AS pages FROM links WHERE raw NOT IN (SELECT stem FROM vault) GROUP BY raw HAVING count(DISTINCT doc_id) >= 2""",
)
def missing_pages(spark: SparkSession, folder: str) -> DataFrame:
    return graph.missing_pages(graph.with_names(vault_pages(spark, folder)))


@query(
    "missing_page_sources",
    rf"""WITH {VAULT_SQL}, {LINKS_SQL},
m AS (SELECT raw, count(DISTINCT doc_id) AS pages FROM links WHERE raw NOT IN (SELECT stem FROM vault) GROUP BY raw HAVING count(DISTINCT doc_id) >= 2)
SELECT raw AS term, path, pages FROM (SELECT DISTINCT doc_id, raw, path FROM links) JOIN m USING (raw)""",
)
def missing_page_sources(spark: SparkSession, folder: str) -> DataFrame:
    return graph.missing_page_sources(graph.with_names(vault_pages(spark, folder)))


@query("duplicate_pages", AUDIT_CTE + " SELECT path, area, norm, files, tag FROM dups WHERE files > 1")
def duplicate_pages(spark: SparkSession, folder: str) -> DataFrame:
    return graph.duplicate_stems(graph.with_names(vault_pages(spark, folder)))


@query(
    "page_orphans",
    f"WITH {VAULT_SQL}, {LINKS_SQL} "
    r"SELECT path, area, stem FROM vault WHERE stem NOT IN (SELECT target FROM links) AND (area = 'wiki' OR NOT regexp_matches(text, '\[\[[^\]|#]+'))",
)
def page_orphans(spark: SparkSession, folder: str) -> DataFrame:
    pages = graph.with_names(vault_pages(spark, folder))
    return graph.orphans(pages, graph.page_links(pages))


@query(
    "empty_sections",
    rf"""WITH {VAULT_SQL},
lines AS (SELECT doc_id, path, area, i, ls[i] AS line, len(ls) AS n FROM (
   SELECT doc_id, path, area, ls, unnest(range(1, len(ls) + 1)) AS i FROM (
     SELECT doc_id, path, area, string_split(substr(text, strpos(substr(text, 4), '---') + 6), chr(10)) AS ls FROM vault))),
heads AS (SELECT *, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM lines WHERE regexp_matches(line, '^#{{1,6}}\s+')),
body AS (SELECT doc_id, i FROM lines WHERE regexp_matches(line, '\S') AND NOT regexp_matches(line, '^#{{1,6}}\s+'))
SELECT h.path, regexp_extract(h.line, '^#{{1,6}}\s+(.*)$', 1) AS heading FROM heads h
WHERE NOT EXISTS (SELECT 1 FROM body b WHERE b.doc_id = h.doc_id AND b.i > h.i AND b.i < coalesce(h.nxt, h.n + 1))""",
)
def empty_sections(spark: SparkSession, folder: str) -> DataFrame:
    return graph.empty_sections(graph.with_names(vault_pages(spark, folder)))


@query(
    "lint_counts",
    rf"""WITH {VAULT_SQL}, {LINKS_SQL}, wl AS (SELECT * FROM links WHERE area = 'wiki')
SELECT 'empty_sections' AS "check", count(*) AS findings FROM vault WHERE area = 'wiki' AND contains(text, '## Notes')
UNION ALL SELECT 'missing_pages', count(*) FROM (SELECT raw FROM wl WHERE raw NOT IN (SELECT stem FROM vault WHERE area = 'wiki') GROUP BY raw HAVING count(DISTINCT doc_id) >= 2)
UNION ALL SELECT 'stray_root', 0""",
)
def lint_counts(spark: SparkSession, folder: str) -> DataFrame:
    return graph.lint_counts(vault_pages(spark, folder))


META_SQL = rf"""
fmv AS (SELECT doc_id, path, text, regexp_extract(text, '(?s)^---\n(.*?)\n---\n', 1) AS block,
               regexp_replace(text, '(?s)^---\n.*?\n---\n', '') AS body FROM vault),
m AS (SELECT doc_id, path,
  coalesce(nullif(regexp_extract(block, '(?m)^type: (.*)$', 1), ''), 'untyped') AS type,
  coalesce(nullif(regexp_extract(block, '(?m)^status: (.*)$', 1), ''), 'unset') AS status,
  cast(regexp_replace(regexp_extract(block, '(?m)^updated: (.*)$', 1), '"', '', 'g') AS date) AS edited,
  list_concat(
    CASE WHEN regexp_matches(block, '(?m)^tags: \[') THEN string_split(regexp_extract(block, '(?m)^tags: \[(.*)\]$', 1), ', ')
         ELSE regexp_extract_all(block, '(?m)^  - (.*)$', 1) END,
    regexp_extract_all(body, '(?:^|\s)#([A-Za-z][\w/-]*)', 1)) AS tags
  FROM fmv)"""


@query("pages_by_type", f"WITH {VAULT_SQL}, {META_SQL} SELECT type, count(*) AS pages FROM m GROUP BY type")
def pages_by_type(spark: SparkSession, folder: str) -> DataFrame:
    return stats.counts_by(stats.page_metadata(vault_pages(spark, folder)), "type")


@query("pages_by_status", f"WITH {VAULT_SQL}, {META_SQL} SELECT status, count(*) AS pages FROM m GROUP BY status")
def pages_by_status(spark: SparkSession, folder: str) -> DataFrame:
    return stats.counts_by(stats.page_metadata(vault_pages(spark, folder)), "status")


@query(
    "page_counts_one_pass",
    f"""WITH {VAULT_SQL}, {META_SQL}
SELECT 'type' AS "by", type AS key, count(*) AS pages FROM m GROUP BY type
UNION ALL SELECT 'status', status, count(*) FROM m GROUP BY status
UNION ALL SELECT 'total', '', count(*) FROM m""",
)
def page_counts_one_pass(spark: SparkSession, folder: str) -> DataFrame:
    return stats.all_counts(stats.page_metadata(vault_pages(spark, folder)))


@query(
    "top_tags",
    f"WITH {VAULT_SQL}, {META_SQL}, t AS (SELECT unnest(tags) AS tag FROM m) SELECT tag, count(*) AS uses FROM t GROUP BY tag ORDER BY uses DESC, tag LIMIT 25",
)
def top_tags(spark: SparkSession, folder: str) -> DataFrame:
    return stats.tag_counts(stats.page_metadata(vault_pages(spark, folder)))


@query("recently_edited", f"WITH {VAULT_SQL}, {META_SQL} SELECT path, edited FROM m ORDER BY edited DESC, path LIMIT 15")
def recently_edited(spark: SparkSession, folder: str) -> DataFrame:
    return stats.recently_edited(stats.page_metadata(vault_pages(spark, folder)))


@query(
    "tagged_pages",
    f"WITH {VAULT_SQL}, {META_SQL} SELECT path, status, edited FROM m WHERE list_contains(tags, 'en') AND status = 'active'",
)
def tagged_pages(spark: SparkSession, folder: str) -> DataFrame:
    meta = stats.page_metadata(vault_pages(spark, folder))
    return stats.tagged(meta, "en", "active").select("path", "status", "edited")


LEDGER_PAGES_SQL = """
led AS (SELECT path, max_by(substr(coalesce(ingested_at, first_seen), 1, 10), id) AS day FROM (
  SELECT path, doc_id AS id, CASE WHEN doc_id % 4 = 0 THEN '2024-01-0' || (1 + doc_id % 9) || 'T00:00:00' END AS ingested_at,
         '2023-11-1' || (doc_id % 10) AS first_seen FROM vault WHERE doc_id % 2 = 0) GROUP BY path)"""


@query(
    "wiki_index",
    rf"""WITH {VAULT_SQL}, {META_SQL}, {LEDGER_PAGES_SQL}
SELECT CASE m.type WHEN 'source' THEN 'Sources' WHEN 'synthesis' THEN 'Synthesis' WHEN 'concept' THEN 'Concepts' WHEN 'entity' THEN 'Entities' ELSE 'Other' END AS section,
       v.stem_title AS title, m.type,
       coalesce(led.day, regexp_extract(v.text, '(?m)^created: (.*)$', 1)) AS day, '[[concepts/' || v.stem || ']]' AS link
FROM (SELECT *, array_to_string([upper(left(w, 1)) || lower(substr(w, 2)) for w in string_split(replace(stem, '-', ' '), ' ')], ' ') AS stem_title FROM vault WHERE area = 'wiki') v
JOIN m USING (doc_id) LEFT JOIN led ON led.path = v.path""",
)
def wiki_index(spark: SparkSession, folder: str) -> DataFrame:
    pages = vault_pages(spark, folder)
    i = F.col("doc_id")
    ledger = pages.where(i % 2 == 0).select(
        F.col("path").alias("source_page"),
        i.alias("id"),
        F.when(i % 4 == 0, F.concat(F.lit("2024-01-0"), 1 + i % 9, F.lit("T00:00:00"))).alias("ingested_at"),
        F.concat(F.lit("2023-11-1"), i % 10).alias("first_seen"),
    )
    return stats.wiki_index(pages, ledger).drop("section_rank")


@query(
    "frontmatter_fields",
    f"""WITH {VAULT_SQL}
SELECT doc_id, ['concept','entity','source','synthesis','direction','decision','memo'][1 + doc_id % 7] AS type,
  coalesce(CASE WHEN doc_id % 4 = 0 THEN NULL ELSE ['draft','active','archived'][1 + doc_id % 3] END, '-') AS status,
  printf('2023-%02d-%02d', doc_id % 12 + 1, doc_id % 28 + 1) AS updated, lang || ',' || source AS tags,
  cast(4 + (doc_id % 4 <> 0)::int + (doc_id % 6 <> 0)::int + (doc_id % 5 = 1)::int AS bigint) AS n_keys
FROM vault JOIN documents d USING (doc_id)""",
)
def frontmatter_fields(spark: SparkSession, folder: str) -> DataFrame:
    """Fields of each page by the map reader, the list reader and the key reader."""
    fields = vault_pages(spark, folder).select(
        "doc_id", fm.scalars("text").alias("f"), fm.list_field("text", "tags").alias("tags"), fm.keys("text").alias("keys")
    )
    return fields.select(
        "doc_id",
        F.col("f")["type"].alias("type"),
        F.coalesce(F.try_element_at("f", F.lit("status")), F.lit("-")).alias("status"),
        F.col("f")["updated"].alias("updated"),
        F.array_join("tags", ",").alias("tags"),
        long_size(F.col("keys")).alias("n_keys"),
    )


@query(
    "provenance_backfill",
    rf"""WITH {VAULT_SQL},
w AS (SELECT doc_id, path, area,
  CASE WHEN doc_id % 6 = 0 THEN NULL ELSE ['wiki','research','USER','someone'][1 + doc_id % 4] END AS had,
  CASE WHEN area = 'research' THEN 'USER' ELSE 'wiki' END AS want, text FROM vault)
SELECT area, count(*) AS examined, count(CASE WHEN had IS NULL THEN 1 END) AS added,
  count(CASE WHEN had IS NOT NULL AND had <> want THEN 1 END) AS corrected,
  count(CASE WHEN had = want THEN 1 END) AS kept,
  min(md5(CASE WHEN had IS NULL THEN replace(regexp_replace(text, '(?s)^(---\n.*?)\n---\n', '\1' || chr(10) || 'written_by: ' || want || chr(10) || '---' || chr(10)), '', '')
       ELSE regexp_replace(text, '(?m)^written_by: .*$', 'written_by: ' || want) END)) AS digest
FROM w GROUP BY area""",
)
def provenance_backfill(spark: SparkSession, folder: str) -> DataFrame:
    """Set ``written_by`` from the page's place and count what had to change."""
    want = prose.written_by_for(F.col("path"))
    pages = vault_pages(spark, folder).select(
        "path", F.substring_index("path", "/", 1).alias("area"), want.alias("want"),
        fm.scalar("text", "written_by").alias("had"), fm.rewrite("text", {"written_by": want, "generated_by": None}).alias("new_text"),
    )
    return pages.groupBy("area").agg(
        F.count(F.lit(1)).alias("examined"),
        F.count_if(F.col("had").isNull()).alias("added"),
        F.count_if(F.col("had").isNotNull() & (F.col("had") != F.col("want"))).alias("corrected"),
        F.count_if(F.col("had") == F.col("want")).alias("kept"),
        F.min(F.md5("new_text")).alias("digest"),
    )


@query(
    "open_questions",
    rf"""WITH {VAULT_SQL}
SELECT doc_id, cast(CASE WHEN doc_id % 3 = 1 THEN (SELECT count(*) FROM (SELECT unnest(string_split('- ' || replace(d.text, chr(10), chr(10) || '- '), chr(10))) AS l) WHERE regexp_matches(l, '^\s*[-*+]')) ELSE 0 END AS bigint) AS questions
FROM vault v JOIN documents d USING (doc_id)""",
)
def open_questions(spark: SparkSession, folder: str) -> DataFrame:
    part = prose.section_starting("text", "open questions")
    return vault_pages(spark, folder).select(
        "doc_id", F.when(part == "", F.lit(0)).otherwise(prose.bullet_count(part)).cast("bigint").alias("questions")
    )


@query(
    "heading_lines",
    r"""WITH l AS (SELECT doc_id, unnest(string_split('# ' || replace(text, '. ', chr(10) || '## '), chr(10))) AS line FROM documents)
SELECT doc_id, count(*) AS headings FROM l WHERE regexp_matches(line, '^#{1,6}\s+') GROUP BY doc_id""",
)
def heading_lines(spark: SparkSession, folder: str) -> DataFrame:
    marked = F.concat(F.lit("# "), F.replace("text", F.lit(". "), F.lit("\n## ")))
    texts = read_table(spark, folder, "documents").select(F.col("doc_id").alias("id"), marked.alias("text"))
    return graph.heading_lines(texts).groupBy(F.col("id").alias("doc_id")).agg(F.count(F.lit(1)).alias("headings"))
