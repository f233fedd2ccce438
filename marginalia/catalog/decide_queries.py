"""Dedup, ranking, lanes, spillover, routing and matching."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.catalog import fragments as fr
from marginalia.catalog.base import query
from marginalia.functions import identity, scoring
from marginalia.functions.tokens import matching_terms, overlap_terms
from marginalia.operators import decide, harvest, ranking
from marginalia.plans.derived import CANDIDATES_SQL, REGISTRY_SQL, REPORT_DAY, page_candidates, registry, report_day
from marginalia.session import read_table

CAND = f"WITH {CANDIDATES_SQL}"
BEST_SQL = "best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ident ORDER BY round(score, 9) DESC, cand_id) AS rn FROM idents) WHERE rn = 1)"
LEDGER_SQL = f"""
led AS (SELECT CASE WHEN page_id % 6 = 0 THEN {fr.strip("regexp_replace(url, '/+$', '')")} ELSE 'other' || page_id END AS id,
  CASE WHEN page_id % 6 = 1 THEN url ELSE '' END AS url,
  ['pending', 'ingested', 'rejected', 'waiting_approval', 'deleted'][1 + page_id % 5] AS status FROM pages)"""
FRESH_SQL = """
fresh AS (SELECT * FROM best WHERE ident NOT IN (SELECT id FROM led WHERE status IN ('ingested', 'pending', 'rejected'))
  AND regexp_replace(url, '/+$', '') NOT IN (SELECT regexp_replace(url, '/+$', '') FROM led WHERE status IN ('ingested', 'pending', 'rejected') AND url <> ''))"""


def ledger_of_pages(spark: SparkSession, folder: str) -> DataFrame:
    i = F.col("page_id")
    return read_table(spark, folder, "pages").select(
        F.when(i % 6 == 0, F.regexp_replace("url", "/+$", "")).otherwise(F.concat(F.lit("other"), i)).alias("id"),
        F.when(i % 6 == 1, F.col("url")).otherwise(F.lit("")).alias("url"),
        F.lit("").alias("source_id"),
        F.element_at(F.array(*[F.lit(s) for s in ("pending", "ingested", "rejected", "waiting_approval", "deleted")]), (i % 5 + 1).cast("int")).alias("status"),
    )


def fresh_candidates(spark: SparkSession, folder: str) -> DataFrame:
    best = decide.best_per_item(page_candidates(spark, folder))
    return harvest.drop_ledgered(best, ledger_of_pages(spark, folder))


@query("best_per_item", f"{CAND}, {BEST_SQL} SELECT cand_id, ident, lane, score FROM best")
def best_per_item(spark: SparkSession, folder: str) -> DataFrame:
    return decide.best_per_item(page_candidates(spark, folder)).select("cand_id", "ident", "lane", "score")


@query("ledger_dedup_two_keys", f"{CAND}, {BEST_SQL}, {LEDGER_SQL}, {FRESH_SQL} SELECT cand_id, ident FROM fresh")
def ledger_dedup_two_keys(spark: SparkSession, folder: str) -> DataFrame:
    return fresh_candidates(spark, folder).select("cand_id", "ident")


def _select_sql(source: str, lanes: list[tuple[str, int]], cap: int) -> str:
    total = sum(q for _, q in lanes)
    rank = " ".join(f"WHEN '{lane}' THEN {i}" for i, (lane, _) in enumerate(lanes))
    quota = " ".join(f"WHEN '{lane}' THEN {q}" for lane, q in lanes)
    names = ", ".join(f"'{lane}'" for lane, _ in lanes)
    return f"""
r AS (SELECT *, row_number() OVER (PARTITION BY lane ORDER BY round(score, 9) DESC, cand_id) AS lane_pos,
        CASE lane {rank} END AS lr, CASE lane {quota} END AS q FROM {source} WHERE lane IN ({names})),
p1 AS (SELECT *, false AS spilled FROM r WHERE lane_pos <= q),
p2 AS (SELECT *, true AS spilled FROM (SELECT *, row_number() OVER (ORDER BY lr, lane_pos) AS n FROM r WHERE lane_pos > q)
       WHERE n <= {total} - (SELECT count(*) FROM p1)),
u AS (SELECT cand_id, lane, lane_pos, spilled, lr FROM p1 UNION ALL SELECT cand_id, lane, lane_pos, spilled, lr FROM p2)
SELECT cand_id, lane, slot, spilled FROM (SELECT *, row_number() OVER (ORDER BY spilled, lr, lane_pos) AS slot FROM u) WHERE slot <= {cap}"""


@query("select_candidates", f"{CAND}, {BEST_SQL}, {LEDGER_SQL}, {FRESH_SQL}, " + _select_sql("fresh", [("gap", 3), ("research", 1), ("news", 1)], 5))
def select_candidates(spark: SparkSession, folder: str) -> DataFrame:
    chosen = decide.select_candidates(fresh_candidates(spark, folder))
    return chosen.select("cand_id", "lane", F.col("slot").cast("bigint").alias("slot"), "spilled")


ORDER_LANES = """o AS (SELECT o_orderkey AS cand_id, CASE WHEN o_totalprice > 499000 THEN 'large' ELSE o_orderpriority END AS lane, round(o_totalprice / 1000, 3) AS score FROM orders)"""
ORDER_QUOTAS = [("1-URGENT", 4), ("large", 900), ("3-MEDIUM", 5), ("4-NOT SPECIFIED", 2)]


@query("lane_spillover", f"WITH {ORDER_LANES}, " + _select_sql("o", ORDER_QUOTAS, 800))
def lane_spillover(spark: SparkSession, folder: str) -> DataFrame:
    """A lane that is small by nature hands its slots on; two lanes are not in the order."""
    lane = F.when(F.col("o_totalprice") > 499000, "large").otherwise(F.col("o_orderpriority"))
    rows = read_table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("cand_id"), lane.alias("lane"), F.round(F.col("o_totalprice") / 1000, 3).alias("score")
    )
    chosen = decide.select_candidates(rows, [lane for lane, _ in ORDER_QUOTAS], dict(ORDER_QUOTAS), 800)
    return chosen.select("cand_id", "lane", F.col("slot").cast("bigint").alias("slot"), "spilled")


@query(
    "recency_scores",
    f"""SELECT o_orderkey, round(CASE WHEN o_orderkey % 10 = 0 THEN 0 ELSE pow(2.0, -greatest(0, date '1999-06-01' - cast(o_orderdate AS date)) / 60.0) END, 6) AS recency FROM orders""",
)
def recency_scores(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("o_orderkey")
    published = F.when(k % 10 == 0, F.lit("soon")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm"))
    return read_table(spark, folder, "orders").select(
        "o_orderkey", F.round(scoring.recency(published, F.lit("1999-06-01").cast("date")), 6).alias("recency")
    )


TOPIC = "thand attention tionly blees eauou mentle chenver queler"
WEIGHTS = {"vendor_blogs": 0.5, "hardware_analysis": 1.5, "_default": 0.9}
ENGINE_SQL = """
eng AS (SELECT engine, max(least(relevance / 5.0::DOUBLE, 1.0)) AS er, arg_min(category, ord) AS ec FROM registry WHERE section = 'paper-publisher' AND engine <> '' GROUP BY engine),
eng2 AS (SELECT * FROM eng UNION ALL SELECT 'crossref', coalesce((SELECT er FROM eng WHERE engine = 'semantic_scholar'), (SELECT er FROM eng WHERE engine = 'openalex'), 0.8), 'paper_api'
         WHERE NOT EXISTS (SELECT 1 FROM eng WHERE engine = 'crossref')),
src AS (SELECT source_id, arg_min(least(relevance / 5.0::DOUBLE, 1.0), ord) AS sr, arg_min(category, ord) AS sc FROM registry GROUP BY source_id)"""


@query("engine_relevance", f"WITH {REGISTRY_SQL}, {ENGINE_SQL} SELECT engine, round(er, 6) AS engine_relevance, ec AS engine_category FROM eng2")
def engine_relevance(spark: SparkSession, folder: str) -> DataFrame:
    return ranking.engine_dimension(registry(spark, folder)).withColumn("engine_relevance", F.round("engine_relevance", 6))


def ranked_pages(spark: SparkSession, folder: str) -> DataFrame:
    i = F.col("cand_id")
    return page_candidates(spark, folder).withColumn(
        "source_id", F.when(i % 3 == 0, F.concat(F.lit("p"), i)).otherwise(F.col("source_id"))
    )


SCORED_SQL = f"""
rc AS (SELECT * REPLACE (CASE WHEN cand_id % 3 = 0 THEN 'p' || cand_id ELSE source_id END AS source_id) FROM cands),
tk AS (SELECT cand_id, list_distinct({fr.ranking_terms("title || ' ' || snippet")}) AS dt, list_distinct({fr.ranking_terms(f"'{TOPIC}'")}) AS qt FROM rc),
kw AS (SELECT cand_id, CASE WHEN least(len(dt), len(qt)) = 0 THEN 0 ELSE len(list_intersect(dt, qt)) / least(len(dt), len(qt))::DOUBLE END AS kw FROM tk),
base AS (SELECT rc.*, 0.60::DOUBLE * kw + 0.25::DOUBLE * coalesce(sr, er, 0)
     * CASE coalesce(sc, ec, '') WHEN 'vendor_blogs' THEN 0.5::DOUBLE WHEN 'hardware_analysis' THEN 1.5::DOUBLE ELSE 0.9::DOUBLE END
     + 0.15::DOUBLE * pow(2.0, -greatest(0, date '{REPORT_DAY}' - cast(published AS date)) / 60.0) AS base_score
   FROM rc JOIN kw USING (cand_id) LEFT JOIN src USING (source_id) LEFT JOIN eng2 USING (engine))"""


@query("candidate_scores", f"{CAND}, {REGISTRY_SQL}, {ENGINE_SQL}, {SCORED_SQL} SELECT cand_id, source_id, round(base_score, 6) AS base_score FROM base")
def candidate_scores(spark: SparkSession, folder: str) -> DataFrame:
    scored = ranking.base_scores(ranked_pages(spark, folder), TOPIC, registry(spark, folder), report_day(), WEIGHTS)
    return scored.select("cand_id", "source_id", F.round("base_score", 6).alias("base_score"))


@query(
    "learned_scores",
    f"""{CAND}, {REGISTRY_SQL}, {ENGINE_SQL}, {SCORED_SQL},
sr AS (SELECT source_id, round(2 * (count(CASE WHEN cand_id % 2 = 0 THEN 1 END) + 1.0::DOUBLE) / (count(*) + 2.0::DOUBLE) - 1, 6) AS rep FROM rc WHERE cand_id % 4 <> 3 GROUP BY source_id),
er AS (SELECT engine, round(2 * (count(CASE WHEN cand_id % 8 < 3 THEN 1 END) + 1.0::DOUBLE) / (count(*) + 2.0::DOUBLE) - 1, 6) AS rep FROM rc GROUP BY engine),
f AS (SELECT b.cand_id, b.base_score, coalesce(sr.rep, greatest(0, er.rep), 0) AS rep,
   CASE WHEN coalesce(sr.rep <= -0.5, false) OR len(list_intersect(string_split_regex(lower(b.title || ' ' || b.snippet), '[^a-z0-9]+'), ['thenti', 'onnd'])) > 0 THEN 1.0 ELSE 0.0 END AS penalty
   FROM base b LEFT JOIN sr USING (source_id) LEFT JOIN er ON er.engine = b.engine)
SELECT cand_id, round(rep, 6) AS rep, cast(penalty AS double) AS penalty, round(base_score + 0.15::DOUBLE * rep - 0.2::DOUBLE * penalty, 6) AS score FROM f""",
)
def learned_scores(spark: SparkSession, folder: str) -> DataFrame:
    rows = ranked_pages(spark, folder)
    i = F.col("cand_id")

    def reputations(key: str, kept, accepted) -> DataFrame:
        counted = rows.where(kept).groupBy(key).agg(F.count_if(accepted).alias("a"), F.count(F.lit(1)).alias("n"))
        return counted.select(key, scoring.reputation(F.col("a"), F.col("n") - F.col("a")).alias("rep"))

    words = spark.createDataFrame([("thenti",), ("onnd",)], "keyword string")
    scored = ranking.base_scores(rows, TOPIC, registry(spark, folder), report_day(), WEIGHTS)
    learned = ranking.with_learned_prior(
        scored, reputations("source_id", i % 4 != 3, i % 2 == 0), reputations("engine", F.lit(True), i % 8 < 3), words
    )
    return learned.select("cand_id", F.round("rep", 6).alias("rep"), "penalty", F.round("score", 6).alias("score"))


@query(
    "news_sources",
    f"""WITH {REGISTRY_SQL} SELECT source_id, round(relevance * CASE category WHEN 'vendor_blogs' THEN 0.5::DOUBLE WHEN 'hardware_analysis' THEN 1.5::DOUBLE ELSE 0.9::DOUBLE END, 6) AS weighted
FROM registry WHERE section = 'blog-newsfeed' AND category IN ('vendor_blogs', 'benchmarking', 'hardware_analysis', 'specialist_research') ORDER BY weighted DESC, source_id LIMIT 5""",
)
def news_sources(spark: SparkSession, folder: str) -> DataFrame:
    return decide.news_sources(registry(spark, folder), WEIGHTS)


TAGS = [["web"], ["arxiv", "web"], ["github", "web", "arxiv"], ["forum"]]


@query(
    "routed_sources",
    f"""WITH {REGISTRY_SQL},
rep AS (SELECT source_id, (ord % 4) / 10.0::DOUBLE AS rep FROM registry WHERE ord % 3 = 0),
reg AS (SELECT r.*, round(r.relevance + coalesce(rep.rep, 0), 6) AS base FROM registry r LEFT JOIN rep USING (source_id)),
tgt AS (SELECT 't' || p_partkey AS target_id, CASE p_partkey % 4 WHEN 0 THEN ['web'] WHEN 1 THEN ['arxiv', 'web'] WHEN 2 THEN ['github', 'web', 'arxiv'] ELSE ['forum'] END AS tags,
   [w for w in string_split(lower(p_name || ' ' || p_type), ' ') if length(w) > 3] AS kws FROM part),
tags AS (SELECT target_id, kws, unnest(tags) AS tag, unnest(range(len(tags))) AS tag_pos FROM tgt),
kset AS (SELECT DISTINCT kws FROM tags WHERE tag = 'web'),
webv AS (SELECT kws, source_id, round(base + 0.5 * len([k for k in kws if contains(lower(focus || ' ' || name), k)]), 6) AS value FROM kset, reg WHERE section = 'blog-newsfeed'),
webr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY kws ORDER BY value DESC, source_id) AS rn FROM webv) WHERE rn <= 5),
pap AS (SELECT source_id, base AS value FROM reg WHERE section = 'paper-publisher' AND category IN ('preprint_repository', 'paper_api', 'research_aggregator') ORDER BY base DESC, source_id LIMIT 5),
git AS (SELECT source_id, base AS value FROM reg WHERE section = 'github-repos' ORDER BY base DESC, source_id LIMIT 5),
allr AS (SELECT target_id, tag_pos, source_id, value FROM tags JOIN webr USING (kws) WHERE tag = 'web'
  UNION ALL SELECT target_id, tag_pos, source_id, value FROM tags, pap WHERE tag = 'arxiv'
  UNION ALL SELECT target_id, tag_pos, source_id, value FROM tags, git WHERE tag = 'github'),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY target_id, source_id ORDER BY tag_pos, value DESC) AS rn FROM allr) WHERE rn = 1)
SELECT target_id, position, source_id FROM (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY tag_pos, value DESC, source_id) AS position FROM f) WHERE position <= 5""",
)
def routed_sources(spark: SparkSession, folder: str) -> DataFrame:
    reg = registry(spark, folder)
    k = F.col("p_partkey")
    tags = F.when(k % 4 == 0, F.array(F.lit("web")))
    for j, names in enumerate(TAGS[1:], start=1):
        tags = tags.when(k % 4 == j, F.array(*[F.lit(n) for n in names]))
    words = F.filter(F.split(F.lower(F.concat_ws(" ", "p_name", "p_type")), " "), lambda w: F.length(w) > 3)
    wanted = read_table(spark, folder, "part").select(
        F.concat(F.lit("t"), k).alias("target_id"), tags.alias("fillable_by"), words.alias("keywords")
    )
    reps = reg.where("ord % 3 = 0").select("source_id", (F.col("ord") % 4 / 10.0).alias("rep"))
    return decide.routed_sources(wanted, reg, reps)


def _pairs_sql(rows: str, terms: str, threshold: str) -> str:
    return f"""
sets AS (SELECT min(id) AS sid, count(*) AS members, ts FROM (SELECT id, list_sort({terms}) AS ts FROM ({rows})) GROUP BY ts),
tok AS (SELECT sid, len(ts) AS n, unnest(ts) AS t FROM sets),
met AS (SELECT a.sid AS l, b.sid AS r, count(*) AS shared, any_value(a.n) AS ln, any_value(b.n) AS rn FROM tok a JOIN tok b ON a.t = b.t AND a.sid < b.sid GROUP BY ALL),
pairs AS (SELECT l, r, shared / (ln + rn - shared)::DOUBLE AS j FROM met WHERE shared / (ln + rn - shared)::DOUBLE >= {threshold})"""


@query(
    "near_duplicates",
    f"""WITH {_pairs_sql('SELECT doc_id AS id, text FROM documents', fr.overlap_terms('text'), '0.6')}
SELECT l AS left_id, r AS right_id, a.members AS left_members, b.members AS right_members, round(j, 6) AS jaccard
FROM pairs JOIN sets a ON a.sid = l JOIN sets b ON b.sid = r""",
)
def near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    rows = read_table(spark, folder, "documents").select(F.col("doc_id").alias("id"), overlap_terms("text").alias("terms"))
    return decide.jaccard_pairs(rows, rows, 0.6, same_side=True).withColumn("jaccard", F.round("jaccard", 6))


@query(
    "set_copies",
    f"""WITH t AS (SELECT doc_id AS id, list_sort({fr.overlap_terms('text')}) AS ts FROM documents)
SELECT id, min(id) OVER (PARTITION BY ts) AS set_id FROM t""",
)
def set_copies(spark: SparkSession, folder: str) -> DataFrame:
    rows = read_table(spark, folder, "documents").select(F.col("doc_id").alias("id"), overlap_terms("text").alias("terms"))
    return decide.set_members(rows)


def matching_sides(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Even documents as gaps, odd ones as directions; language and source as concepts."""
    i = F.col("doc_id")
    both = read_table(spark, folder, "documents").select(
        F.format_string("%08d", i).alias("id"), matching_terms("text").alias("terms"), F.array("lang", "source").alias("concepts"),
        (i % 2).alias("role"),
    )
    return tuple(
        decide.match_units(both.where(F.col("role") == role).select("id", "terms", "concepts")) for role in (0, 1)
    )


MATCH_SQL = f"""
side AS (SELECT printf('%08d', doc_id) AS id, doc_id % 2 AS role, {fr.matching_terms('text')} AS ts, [lang, source] AS cs FROM documents),
tok AS (SELECT id, role, len(ts) AS n, cs, unnest(ts) AS t FROM side),
met AS (SELECT g.id AS gap_id, d.id AS direction_id, count(*) AS shared, any_value(g.n) AS gn, any_value(d.n) AS dn, any_value(g.cs) AS gc, any_value(d.cs) AS dc
  FROM tok g JOIN tok d ON g.t = d.t WHERE g.role = 0 AND d.role = 1 GROUP BY g.id, d.id),
sc AS (SELECT gap_id, direction_id, round(shared / (gn + dn - shared)::DOUBLE + least(len(list_intersect(gc, dc)) * 0.05, 0.10), 9) AS score FROM met),
passed AS MATERIALIZED (SELECT * FROM sc WHERE score >= 0.18)"""


@query(
    "match_scores",
    f"""WITH {MATCH_SQL},
unit AS (SELECT id, min(id) OVER (PARTITION BY role, list_sort(ts), list_sort(cs)) AS unit FROM side)
SELECT gap_id AS gap_unit, direction_id AS direction_unit, round(score, 6) AS score FROM passed
WHERE gap_id IN (SELECT unit FROM unit) AND direction_id IN (SELECT unit FROM unit)""",
)
def match_scores(spark: SparkSession, folder: str) -> DataFrame:
    gaps, directions = matching_sides(spark, folder)
    return decide.match_scores(gaps, directions).withColumn("score", F.round("score", 6))


WALK_SQL = f"""{MATCH_SQL},
ranked AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY score DESC, gap_id, direction_id) AS i FROM passed),
walk AS (
  SELECT 0 AS i, cast([] AS varchar[]) AS gs, cast([] AS varchar[]) AS ds, cast(NULL AS varchar) AS gap_id, cast(NULL AS varchar) AS direction_id, cast(NULL AS double) AS score
  UNION ALL
  SELECT r.i, CASE WHEN ok THEN list_append(gs, r.gap_id) ELSE gs END, CASE WHEN ok THEN list_append(ds, r.direction_id) ELSE ds END,
     CASE WHEN ok THEN r.gap_id END, CASE WHEN ok THEN r.direction_id END, CASE WHEN ok THEN r.score END
  FROM (SELECT r.*, w.gs, w.ds, NOT list_contains(w.gs, r.gap_id) AND NOT list_contains(w.ds, r.direction_id) AS ok
        FROM walk w JOIN ranked r ON r.i = w.i + 1) r)"""


@query("greedy_matches", f"WITH RECURSIVE {WALK_SQL} SELECT gap_id, direction_id, round(score, 6) AS score FROM walk WHERE gap_id IS NOT NULL")
def greedy_matches(spark: SparkSession, folder: str) -> DataFrame:
    gaps, directions = matching_sides(spark, folder)
    found = decide.greedy_matches(gaps, directions, decide.match_scores(gaps, directions))
    return found.withColumn("score", F.round("score", 6))


@query(
    "engine_queries",
    rf"""WITH t AS (SELECT item_id, regexp_extract(text, '^([^.]*)', 1) AS title, text AS missing, 'evidence ' || item_id AS ev FROM benchmark),
w AS (SELECT *, {fr.query_terms("title || ' ' || missing || ' ' || ev")} AS ws FROM t),
r AS (SELECT *, list_concat([ws[i] || ' ' || ws[i + 1] for i in range(1, len(ws))], ws) AS c FROM w),
d AS (SELECT *, [c[i] for i in range(1, len(c) + 1) if list_position(c, c[i]) = i][1:8] AS top FROM r),
e AS (SELECT *, [x for x in top if not contains(x, ' ')] AS single, [x for x in top if contains(x, ' ')] AS pairs FROM d),
m AS (SELECT item_id, title, single, coalesce(nullif(array_to_string(list_concat(pairs[1:2], single)[1:4], ' '), ''), title) AS arxiv, array_to_string(single[1:3], ' ') AS support FROM e)
SELECT item_id, arxiv, left(CASE WHEN support = '' THEN title ELSE title || ' ' || support END, 120) AS scholar,
  left(CASE WHEN starts_with(lower(title), 'what') THEN title ELSE 'what is ' || lower(title) END, 120) AS web,
  coalesce(nullif(array_to_string(single[1:4], ' '), ''), left(title, 80)) AS forum FROM m""",
)
def engine_queries(spark: SparkSession, folder: str) -> DataFrame:
    title = F.regexp_extract("text", r"^([^.]*)", 1)
    made = decide.engine_queries(
        title, F.col("text"), F.concat(F.lit("evidence "), "item_id"), F.lit(""), F.expr("cast(array() as array<string>)")
    )
    rows = read_table(spark, folder, "benchmark").select("item_id", decide.capped_queries(made, 1).alias("q"))
    return rows.select(
        "item_id", F.col("q")["arxiv"][0].alias("arxiv"), F.col("q")["semantic_scholar"][0].alias("scholar"),
        F.col("q")["web"][0].alias("web"), F.col("q")["forum"][0].alias("forum"),
    )


@query(
    "paid_targets",
    """SELECT o_orderkey AS target_id FROM orders ORDER BY CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END,
 CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '5-LOW' THEN 2 ELSE 1 END, o_orderkey LIMIT 7""",
)
def paid_targets(spark: SparkSession, folder: str) -> DataFrame:
    lane = F.when(F.col("o_orderstatus") == "F", "gap").when(F.col("o_orderstatus") == "O", "research").otherwise("news")
    priority = F.when(F.col("o_orderpriority") == "1-URGENT", "high").when(F.col("o_orderpriority") == "5-LOW", "low").otherwise("medium")
    rows = read_table(spark, folder, "orders").select(F.col("o_orderkey").alias("target_id"), lane.alias("lane"), priority.alias("priority"))
    return decide.paid_targets(rows, 7).select("target_id")


@query(
    "repository_names",
    r"""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'own/git' || p_partkey WHEN 1 THEN 'own/r' || p_partkey ELSE 'a/b' || p_partkey END AS repo FROM part""",
)
def repository_names(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("p_partkey")
    url = (
        F.when(k % 3 == 0, F.concat(F.lit("https://github.com/own/git"), k, F.lit(".git")))
        .when(k % 3 == 1, F.concat(F.lit("git@github.com:own/r"), k, F.lit(".git/releases"))).otherwise(F.concat(F.lit("a/b"), k))
    )
    return read_table(spark, folder, "part").select("p_partkey", identity.repo_of_url(url).alias("repo"))
