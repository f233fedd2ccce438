"""Whole workflows and the context blocks of prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.catalog import decide_queries as dq
from marginalia.catalog import fragments as fr
from marginalia.catalog import text_queries as tq
from marginalia.catalog.base import query
from marginalia.catalog.objective_queries import CTE as NODES_CTE
from marginalia.catalog.objective_queries import nodes
from marginalia.catalog.stream_queries import place
from marginalia.functions import identity
from marginalia.operators import calls, context
from marginalia.operators import sources_ledger as led
from marginalia.plans import derived as dv
from marginalia.plans import workflows
from marginalia.session import read_table


@query("bm25_written_index", tq._bm25_top(tq.QUESTION, 20))
def bm25_written_index(spark: SparkSession, folder: str) -> DataFrame:
    """The same ranking from a written index: only the query's terms are read."""
    return workflows.build_and_query_index(tq.chunk_docs(spark, folder), place(spark, "index"), tq.QUESTION)


@query("retrieve_indexed", tq.RETRIEVE_SQL)
def retrieve_indexed(spark: SparkSession, folder: str) -> DataFrame:
    """``retrieve_pages`` from a written index: the query reads postings of its terms and the hits' chunks."""
    chunks, stored, asked = tq.retrieval_tables(spark, folder)
    found = workflows.index_and_retrieve(chunks, place(spark, "chunks"), tq.QUESTION, stored, asked, "m")
    return found.select("page_address", "chunk_id", "bm25_score", F.round("rerank_score", 6).alias("rerank_score"))


STAGED_SQL = f"""{dq.CAND}, {dv.REGISTRY_SQL}, {dq.ENGINE_SQL}, {dq.SCORED_SQL}, {dq.LEDGER_SQL},
k AS (SELECT *, CASE WHEN id_type = 'arxiv' THEN source_id ELSE url END AS sid FROM base),
un AS (SELECT *, CASE WHEN source_id LIKE 'arxiv:%' THEN source_id ELSE coalesce(nullif(regexp_replace(url, '/+$', ''), ''), source_id) END AS ident
  FROM (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY cand_id) AS rs FROM k WHERE sid NOT IN (SELECT sid FROM k WHERE cand_id % 7 = 0)) WHERE rs = 1),
best AS (SELECT * REPLACE (base_score AS score) FROM (SELECT *, row_number() OVER (PARTITION BY ident ORDER BY round(base_score, 9) DESC, cand_id) AS rn FROM un) WHERE rn = 1), {dq.FRESH_SQL}"""


def staged(spark: SparkSession, folder: str) -> DataFrame:
    found = dq.ranked_pages(spark, folder)
    seen = found.where("cand_id % 7 = 0").select(
        identity.seen_identity(F.col("id_type"), F.col("source_id"), F.col("url")).alias("ident")
    )
    return workflows.staged_candidates(
        found, seen.distinct(), dq.ledger_of_pages(spark, folder), dv.registry(spark, folder), dq.TOPIC, dv.report_day(),
        workflows.CrawlConfig(category_weights=dq.WEIGHTS),
    )


@query("staged_candidates", f"{STAGED_SQL}, " + dq._select_sql("fresh", [("gap", 3), ("research", 1), ("news", 1)], 5).lstrip())
def staged_candidates(spark: SparkSession, folder: str) -> DataFrame:
    return staged(spark, folder).select("cand_id", "lane", F.col("slot").cast("bigint").alias("slot"), "spilled")


@query(
    "staged_queue",
    f"{STAGED_SQL}, s AS ({dq._select_sql('fresh', [('gap', 3), ('research', 1), ('news', 1)], 5).lstrip().replace('r AS (', 'WITH r AS (', 1)}) "
    "SELECT CASE WHEN c.source_id LIKE 'arxiv:%' THEN c.source_id ELSE 'url:' || c.url END AS id, 'waiting_approval' AS status, printf('GAP-%02d', s.cand_id % 9) AS objective_ids "
    "FROM s JOIN (SELECT cand_id, source_id, "
    + fr.canonical_url("regexp_replace(url, '/+$', '')")
    + " AS url FROM cands) c USING (cand_id)",
)
def staged_queue(spark: SparkSession, folder: str) -> DataFrame:
    """The chosen candidates as new rows of an empty ledger."""
    empty = led.migrate(spark.createDataFrame([], "id string, status string"))
    proposals = led.normalised_proposals(workflows.as_proposals(staged(spark, folder)))
    after = led.enqueue(empty, proposals, F.lit("2024-01-20"))
    return after.select("id", "status", F.array_join("objective_ids", ",").alias("objective_ids"))


@query(
    "crawl_plan",
    """WITH g AS (SELECT item_id, printf('GAP-%02d', item_id) AS id FROM benchmark WHERE item_id % 4 <> 1), d AS (SELECT item_id, printf('DIR-%04d', item_id) AS id FROM benchmark WHERE item_id % 3 <> 2)
SELECT id AS target_id, 'gap' AS lane FROM g UNION ALL SELECT id, 'research' FROM d""",
)
def crawl_plan(spark: SparkSession, folder: str) -> DataFrame:
    """These directions name their gap by number only, so none is merged."""
    found, _ = workflows.crawl_plan(dv.gap_notes(spark, folder), dv.direction_notes(spark, folder), dv.registry(spark, folder))
    return found.select("target_id", "lane")


@query(
    "wiki_context",
    r"""WITH p AS (SELECT 'wiki/sources/' || source || '-' || doc_id AS page, left(trim(regexp_replace(text, '^\s+|\s+$', '', 'g')), 150) AS s FROM documents),
g AS (SELECT item_id, printf('GAP-%02d', item_id) AS id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS missing, ['wiki/sources/src' || (item_id % 20) || '-' || item_id, 'wiki/sources/src1-1', 'wiki/none'] AS ls FROM benchmark),
l AS (SELECT id, unnest(ls) AS link, unnest([0, 1, 2]) AS pos FROM g),
k AS (SELECT id, array_to_string(list('Known (' || link || '): ' || regexp_replace(replace(s, chr(10), ' '), '^\s+|\s+$', '', 'g') ORDER BY pos), ' | ') AS parts FROM l JOIN p ON p.page = l.link GROUP BY id)
SELECT g.id, left('Missing: ' || left(missing, 200) || ' | ' || coalesce(parts, ''), 400) AS context FROM g LEFT JOIN k USING (id)""",
)
def wiki_context(spark: SparkSession, folder: str) -> DataFrame:
    i = F.col("item_id")
    shown = F.concat(F.lit("[[wiki/sources/src"), i % 20, F.lit("-"), i, F.lit("|x]], [[wiki/sources/src1-1]], [[wiki/none]], [[wiki/late]]"))
    found = read_table(spark, folder, "benchmark").select(
        F.format_string("GAP-%02d", i).alias("id"), F.col("text").alias("missing"), shown.alias("shows_up_in")
    )
    key = F.col("doc_id")
    pages = read_table(spark, folder, "documents").select(
        F.concat(F.lit("wiki/sources/"), "source", F.lit("-"), key, F.when(key % 2 == 0, F.lit(".md")).otherwise(F.lit(""))).alias("path"),
        F.concat(F.lit("---\na: b\n---\n"), "text").alias("text"),
    )
    return context.wiki_context(found, pages)


@query(
    "prompt_questions",
    rf"""{NODES_CTE} SELECT id, id || ': ' || regexp_extract(regexp_replace(body, '^\s+', ''), '^([^\n]*)', 1) || ' [priority: ' || priority || ']' || CASE WHEN len(concepts) > 0 THEN ' [concepts: ' || array_to_string(concepts, ', ') || ']' ELSE '' END AS line FROM nodes WHERE type = 'research_question' AND solved <> 'yes'
UNION ALL SELECT id, id || ': ' || regexp_extract(regexp_replace(body, '^\s+', ''), '^([^\n]*)', 1) || ' [priority: ' || priority || '] [serves: ' || array_to_string(served, ', ') || ']' FROM nodes WHERE type = 'direction' AND status = 'open'""",
)
def prompt_questions(spark: SparkSession, folder: str) -> DataFrame:
    found = nodes(spark, folder)
    asked = context.question_lines(found.where((F.col("type") == "research_question") & (F.col("solved") != "yes")))
    return asked.unionByName(context.direction_lines(found.where((F.col("type") == "direction") & (F.col("status") == "open"))))


@query(
    "filled_prompts",
    "SELECT item_id, md5('Q: ' || text || chr(10) || 'N: ' || item_id) AS digest FROM benchmark",
)
def filled_prompts(spark: SparkSession, folder: str) -> DataFrame:
    text = context.filled_prompt("Q: {question}\nN: {number}", {"question": F.col("text"), "number": F.col("item_id").cast("string")})
    return read_table(spark, folder, "benchmark").select("item_id", F.md5(text).alias("digest"))


@query("cacheable_bodies", "SELECT length(text) >= 16384 AS cacheable, count(*) AS pages FROM documents GROUP BY 1")
def cacheable_bodies(spark: SparkSession, folder: str) -> DataFrame:
    rows = read_table(spark, folder, "documents").select(context.cacheable(F.col("text")).alias("cacheable"))
    return rows.groupBy("cacheable").agg(F.count(F.lit(1)).alias("pages"))


@query(
    "due_topics",
    """SELECT o_orderkey FROM orders WHERE o_orderkey % 7 <> 0 AND (o_orderpriority = '1-URGENT' OR isodow(o_orderdate) = 1)""",
)
def due_topics(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("o_orderkey")
    topics = read_table(spark, folder, "orders").select(
        "o_orderkey", F.when(k % 7 == 0, F.lit("")).otherwise(F.concat(F.lit("t"), k)).alias("name"),
        F.when(F.col("o_orderpriority") == "1-URGENT", F.lit(" Daily ")).when(F.col("o_orderpriority") == "5-LOW", F.lit("")).otherwise("weekly").alias("frequency"),
        "o_orderdate",
    )
    return context.due_topics(topics, F.col("o_orderdate")).select("o_orderkey")


# ---- calls of a plan ---------------------------------------------------------------


def call_targets(spark: SparkSession, folder: str) -> DataFrame:
    """``documents`` as targets; some have queries for one engine, some have none at all."""
    i = F.col("doc_id")
    words = F.split("text", r"\s+")
    queries = F.when(i % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.get(words, F.lit(0)), F.get(words, F.lit(0)), F.concat(F.lit("q"), i % 9)))
    own = F.when(i % 4 == 0, F.create_map(F.lit("arxiv"), F.array(F.concat(F.lit("a"), i)), F.lit("forum"), F.array(F.lit("f1"), F.lit("f2"), F.lit("f3")))).otherwise(F.create_map().cast("map<string,array<string>>"))
    return read_table(spark, folder, "documents").select(
        i.alias("doc_id"), F.format_string("T-%06d", i).alias("target_id"), F.when(i % 3 == 0, "research").otherwise("gap").alias("lane"), queries.alias("queries"), own.alias("queries_by_engine"),
        F.when(i % 2 == 0, F.array(F.lit("web"), F.lit("forum"))).otherwise(F.array(F.lit("arxiv"))).alias("fillable_by"),
    )


def call_routes(spark: SparkSession, folder: str) -> DataFrame:
    """Up to three sources for two of three targets."""
    i = F.col("doc_id")
    ids = F.filter(F.array(*[F.when(i % 6 != 3, F.concat(F.lit("p"), (i * k) % 190 + 1)) for k in (1, 1, 7)]), lambda x: x.isNotNull())
    return call_targets(spark, folder).select("target_id", F.posexplode_outer(ids).alias("position", "source_id")).where("source_id is not null")


def call_registry(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("p_partkey")
    return read_table(spark, folder, "part").select(
        F.concat(F.lit("p"), k).alias("source_id"), dv._pick(k % 3, dv.SECTIONS).alias("section"), F.when(k % 12 == 0, "conference").otherwise("x").alias("category"), dv._pick(k % 4, ["arxiv", "openalex", "", "arxiv"]).alias("engine"),
        F.when(k % 7 == 0, "").otherwise(F.concat(F.lit("feed"), k % 50)).alias("feed"), F.concat(F.lit("repo"), k % 20).alias("url"), F.when(k % 8 == 0, "cs.AR").alias("subject"),
    )


CALLS_OF_PLAN_SQL = r"""
t AS (SELECT doc_id AS i, printf('T-%06d', doc_id) AS target_id, CASE WHEN doc_id % 3 = 0 THEN 'research' ELSE 'gap' END AS lane,
  CASE WHEN doc_id % 5 = 0 THEN [] ELSE [regexp_split_to_array(text, '\s+')[1], regexp_split_to_array(text, '\s+')[1], 'q' || doc_id % 9] END AS qs FROM documents),
flat AS (SELECT *, CASE WHEN len(qs) > 0 THEN qs ELSE [target_id] END AS fq, CASE WHEN i % 4 = 0 THEN ['a' || i] WHEN len(qs) > 0 THEN qs ELSE [target_id] END AS aq FROM t),
r AS (SELECT target_id, unnest(['p' || (i % 190 + 1), 'p' || (i % 190 + 1), 'p' || (i * 7 % 190 + 1)]) AS source_id, unnest([0, 1, 2]) AS position FROM t WHERE i % 6 <> 3),
reg AS (SELECT 'p' || p_partkey AS source_id, p_partkey % 3 AS s, p_partkey % 12 = 0 AS conf, ['arxiv', 'openalex', '', 'arxiv'][1 + p_partkey % 4] AS engine, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE 'feed' || p_partkey % 50 END AS feed,
  'repo' || p_partkey % 20 AS url, CASE WHEN p_partkey % 8 = 0 THEN 'cs.AR' ELSE '' END AS subject FROM part),
j AS (SELECT * FROM r JOIN reg USING (source_id) JOIN flat USING (target_id)),
raw AS (
  SELECT target_id, 0 AS g, position, 0 AS n, 'github' AS engine, url AS query, '' AS category FROM j WHERE s = 2
  UNION ALL SELECT target_id, 0, position, 0, 'rss', feed, '' FROM j WHERE feed IS NOT NULL AND (s = 1 OR (s = 0 AND (conf OR engine = '')))
  UNION ALL SELECT target_id, 0, position, unnest(range(len(q))) AS n, engine, unnest(q), CASE WHEN engine = 'arxiv' THEN subject ELSE '' END FROM (SELECT *, CASE WHEN engine = 'arxiv' THEN aq ELSE fq END AS q FROM j WHERE s = 0 AND NOT conf AND engine <> '')
  UNION ALL SELECT target_id, 1, 0, unnest(range(2)), 'hackernews', unnest(CASE WHEN i % 4 = 0 THEN ['f1', 'f2'] WHEN len(qs) > 0 THEN qs[1:2] ELSE [target_id, NULL] END), '' FROM flat WHERE i % 2 = 0
  UNION ALL SELECT target_id, 2, 0, unnest(range(len(aq))), 'arxiv', unnest(aq), '' FROM flat WHERE lane = 'research' AND i % 6 = 3),
once AS (SELECT target_id, engine, query, category, min((g, position, n)) AS place FROM raw WHERE query IS NOT NULL GROUP BY ALL),
calls AS (SELECT target_id, row_number() OVER (PARTITION BY target_id ORDER BY place) AS nth, engine, query, category FROM once)"""


@query("planned_calls", f"WITH {CALLS_OF_PLAN_SQL} SELECT * FROM calls")
def planned_calls(spark: SparkSession, folder: str) -> DataFrame:
    return calls.planned_calls(call_targets(spark, folder), call_routes(spark, folder), call_registry(spark, folder))


@query(
    "budgeted_calls",
    f"""WITH {CALLS_OF_PLAN_SQL}, s AS (SELECT *, sum(CASE WHEN engine = 'arxiv' THEN 3 ELSE 1 END) OVER (PARTITION BY engine ORDER BY target_id, nth) AS spent FROM calls)
SELECT target_id, nth, engine, query, category, cast(spent AS bigint) AS spent FROM s WHERE engine NOT IN ('arxiv', 'rss', 'github') OR spent <= CASE engine WHEN 'arxiv' THEN 500 WHEN 'rss' THEN 40 ELSE 0 END""",
)
def budgeted_calls(spark: SparkSession, folder: str) -> DataFrame:
    planned = planned_calls(spark, folder).withColumn("place", F.format_string("%s-%06d", "target_id", "nth"))
    budgets = spark.createDataFrame([("arxiv", 500), ("rss", 40), ("github", 0)], "engine string, budget long")
    return calls.within_budget(planned, "place", budgets, F.when(F.col("engine") == "arxiv", 3).otherwise(1)).drop("place")


@query(
    "news_target",
    f"""WITH {dv.REGISTRY_SQL}, n AS (SELECT source_id, round(relevance * CASE category WHEN 'vendor_blogs' THEN 0.5 ELSE 1.0 END, 6) AS w FROM registry
  WHERE section = 'blog-newsfeed' AND category IN ('vendor_blogs', 'benchmarking', 'hardware_analysis', 'specialist_research') ORDER BY w DESC, source_id LIMIT 5)
SELECT 'news' AS target_id, 'news' AS lane, 'medium' AS priority, 'news' AS origins, string_agg(source_id, ',' ORDER BY w DESC, source_id) AS routed FROM n""",
)
def news_target(spark: SparkSession, folder: str) -> DataFrame:
    found = calls.news_target(dv.registry(spark, folder), {"vendor_blogs": 0.5})
    return found.select("target_id", "lane", "priority", F.array_join("origin_ids", ",").alias("origins"), F.array_join("routed", ",").alias("routed"))
