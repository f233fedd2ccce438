"""Review reports, backfill, citation checks, gap notes and synthesis texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.catalog.base import query
from marginalia.operators import backfill, evidence, gaps, review
from marginalia.operators.ordering import numbered
from marginalia.plans import derived as dv
from marginalia.session import read_table

REPORTS = f"WITH {dv.REPORTS_SQL}"


@query("review_candidates", f"{REPORTS} SELECT report_id, id, action, reason FROM acts")
def review_candidates(spark: SparkSession, folder: str) -> DataFrame:
    return review.candidates(dv.review_reports(spark, folder))


@query("review_decisions", f"{REPORTS} SELECT report_id, action, count(*) AS decisions FROM acts WHERE action <> 'deferred' GROUP BY ALL")
def review_decisions(spark: SparkSession, folder: str) -> DataFrame:
    found = review.decisions(dv.review_reports(spark, folder))
    return found.groupBy("report_id", "action").agg(F.count(F.lit(1)).alias("decisions"))


def report_ledger(found: DataFrame) -> DataFrame:
    """Ledger rows of the report ids: some have no address, some no row."""
    n = F.regexp_extract("id", r"-(\d+)$", 1).cast("bigint")
    url = F.when(n % 5 == 0, F.lit("")).when(n % 5 == 1, F.lit("ftp://x/1")).otherwise(F.concat(F.lit("https://x/"), "id"))
    return found.where(n % 7 != 3).select("id", url.alias("url"))


OUTCOME_SQL = """
outs AS (SELECT report_id, id, action, reason, CASE WHEN action = 'conflict' THEN 'conflict' WHEN action = 'reject' THEN 'rejected'
  WHEN action = 'deferred' THEN CASE WHEN i % 3 = 0 THEN 'deferred' ELSE 'backlogged' END
  WHEN i % 7 <> 3 AND i % 5 NOT IN (0, 1) THEN 'approved' ELSE 'blocked' END AS outcome FROM acts)"""


def outcomes(spark: SparkSession, folder: str) -> DataFrame:
    found = review.candidates(dv.review_reports(spark, folder))
    n = F.regexp_extract("id", r"-(\d+)$", 1).cast("bigint")
    return review.routed(found, report_ledger(found), found.where(n % 3 == 0).select("id"))


@query("review_outcomes", f"{REPORTS}, {OUTCOME_SQL} SELECT report_id, id, action, reason, outcome FROM outs")
def review_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    return outcomes(spark, folder)


@query("review_summary", f"{REPORTS}, {OUTCOME_SQL} SELECT outcome, count(*) AS ids FROM outs GROUP BY outcome")
def review_summary(spark: SparkSession, folder: str) -> DataFrame:
    return outcomes(spark, folder).groupBy("outcome").agg(F.count(F.lit(1)).alias("ids"))


_DECOY = "UNION ALL SELECT 'c' || conv_id || 't' || turn AS report_id, 'c' || conv_id || 't' || turn || '-decoy' AS first_id, '' AS search_date FROM conversations"


@query("backlog_entries", f"{REPORTS} SELECT report_id, id AS first_id, '2024-01-20' AS search_date FROM acts {_DECOY}")
def backlog_entries(spark: SparkSession, folder: str) -> DataFrame:
    """Dated blocks as a backlog; without a trace heading the decoy is a block."""
    text = F.regexp_replace("text", r"(?m)^(\s*-\s+\*\*url\*\*:\s*.+)$", "$1\n- **search-date**: 2024-01-20")
    reports = dv.review_reports(spark, folder).withColumn("text", text)
    return review.backlog_entries(reports).select("report_id", F.get("ids", F.lit(0)).alias("first_id"), "search_date")


@query("kept_backlog", f"{REPORTS}, {OUTCOME_SQL} SELECT report_id, id FROM outs WHERE outcome NOT IN ('approved', 'rejected') {_DECOY.replace(', ' + chr(39) + chr(39) + ' AS search_date', '').replace('first_id', 'id')}")
def kept_backlog(spark: SparkSession, folder: str) -> DataFrame:
    return review.kept_backlog(dv.review_reports(spark, folder), outcomes(spark, folder)).select("report_id", "id")


@query("backlog_ids", f"{REPORTS} SELECT id FROM acts UNION SELECT 'c' || conv_id || 't' || turn || '-decoy' FROM conversations")
def backlog_ids(spark: SparkSession, folder: str) -> DataFrame:
    return review.backlog_ids(dv.review_reports(spark, folder))


@query(
    "backlog_blocks",
    f"""{REPORTS} SELECT report_id, cast(i + 1 AS bigint) AS block_no, 1 AS dated FROM acts""",
)
def backlog_blocks(spark: SparkSession, folder: str) -> DataFrame:
    blocks = review.backlog_blocks(dv.review_reports(spark, folder), F.lit("2024-01-20"))
    dated = F.regexp_count("block", F.lit(r"\*\*search-date\*\*: 2024-01-20"))
    return blocks.select("report_id", F.col("block_no").cast("bigint").alias("block_no"), dated.alias("dated"))


# ---- backfill -----------------------------------------------------------------

BACKFILL = f"""WITH {dv.CITED_SQL},
papers AS (SELECT id, id_type, count(DISTINCT page) AS pages FROM cite GROUP BY ALL),
st AS (SELECT 'arxiv:2401.' || lpad(cast(p_partkey AS varchar), 5, '0') AS id, ['ingested', 'pending', 'waiting_approval', 'rejected', 'deleted', 'ingested'][1 + p_partkey % 6] AS status, p_partkey % 6 = 0 AS on_disk FROM part WHERE p_partkey % 4 <> 3
  UNION ALL SELECT 'doi:10.1000/abc' || p_partkey, 'pending', false FROM part WHERE p_partkey % 10 = 9),
cls AS (SELECT p.*, coalesce(status, 'not-in-index') AS prior_status, CASE WHEN status = 'ingested' AND on_disk THEN 'truly_ingested' WHEN status IN ('pending', 'waiting_approval') THEN 'already_queued'
   WHEN status IN ('rejected', 'deleted') THEN 'decided' ELSE 'backfill' END AS route FROM papers p LEFT JOIN st USING (id))"""


def paper_ledger(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    k = F.col("p_partkey")
    parts = read_table(spark, folder, "part")
    statuses = F.array(*[F.lit(s) for s in ("ingested", "pending", "waiting_approval", "rejected", "deleted", "ingested")])
    papers = parts.where(k % 4 != 3).select(
        F.concat(F.lit(" arXiv:2401."), F.lpad(k.cast("string"), 5, "0"), F.lit("v3")).alias("id"),
        F.element_at(statuses, (k % 6 + 1).cast("int")).alias("status"), F.concat(F.lit("raw/papers/"), k, F.lit(".pdf")).alias("filename"),
    )
    dois = parts.where(k % 10 == 9).select(
        F.concat(F.lit("DOI:10.1000/ABC"), k).alias("id"), F.lit("pending").alias("status"), F.lit("").alias("filename")
    )
    files = parts.where(k % 6 == 0).select(F.concat(F.lit("raw/papers/"), k, F.lit(".pdf")).alias("path"))
    return papers.unionByName(dois), files


def backfill_parts(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    ledger, files = paper_ledger(spark, folder)
    return backfill.cited_pages(dv.cited_texts(spark, folder)), backfill.ledger_status(ledger, files)


@query("cited_papers", f"WITH {dv.CITED_SQL} SELECT id, id_type, count(DISTINCT page) AS pages FROM cite GROUP BY ALL")
def cited_papers(spark: SparkSession, folder: str) -> DataFrame:
    cited = backfill.cited_pages(dv.cited_texts(spark, folder))
    return cited.groupBy("id", "id_type").agg(F.count(F.lit(1)).alias("pages"))


@query("backfill_routes", f"{BACKFILL} SELECT id, id_type, pages, route, prior_status FROM cls")
def backfill_routes(spark: SparkSession, folder: str) -> DataFrame:
    return backfill.classify(*backfill_parts(spark, folder))


GAP_REF_SQL = """
gp AS (SELECT printf('GAP-%02d', item_id) AS gap_id, 'wiki/sources/src' || (item_id % 20) || '-' || item_id AS page FROM benchmark WHERE item_id % 4 <> 1
  UNION SELECT printf('GAP-%02d', item_id), 'wiki/sources/src1-1' FROM benchmark WHERE item_id % 4 <> 1)"""


@query("gap_references", f"WITH {GAP_REF_SQL} SELECT page, gap_id FROM gp")
def gap_references(spark: SparkSession, folder: str) -> DataFrame:
    return backfill.gap_references(dv.gap_notes(spark, folder))


@query(
    "backfill_set",
    rf"""{BACKFILL}, {GAP_REF_SQL},
w AS (SELECT * FROM cls WHERE route = 'backfill'),
e AS (SELECT DISTINCT id, page FROM cite WHERE id IN (SELECT id FROM w)),
f AS (SELECT id, array_to_string(list(page ORDER BY page)[1:3], ']], [[') AS first_pages FROM e GROUP BY id),
g AS (SELECT id, count(*) AS gaps, array_to_string(list(gap_id ORDER BY gap_id), ', ') AS refs FROM (SELECT DISTINCT e.id, gp.gap_id FROM e JOIN gp USING (page)) GROUP BY id)
SELECT id, id_type, pages, coalesce(gaps, 0) AS gaps, CASE WHEN gaps IS NULL THEN 'wiki' ELSE 'gap' END AS signal, prior_status,
  CASE WHEN gaps IS NULL THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS score,
  rtrim(left('Cited in [[' || first_pages || ']]' || CASE WHEN gaps IS NULL THEN '' ELSE ' (' || refs || ')' END || ' but not truly ingested (index status: ' || prior_status || '). Known-gap backfill.', 200)) AS rationale,
  CASE id_type WHEN 'arxiv' THEN 'https://arxiv.org/abs/' || substr(id, 7) ELSE 'https://doi.org/' || substr(id, 5) END AS url,
  CASE id_type WHEN 'arxiv' THEN 'arXiv ' || substr(id, 7) ELSE 'DOI ' || substr(id, 5) END AS title
FROM w JOIN f USING (id) LEFT JOIN g USING (id)""",
)
def backfill_set(spark: SparkSession, folder: str) -> DataFrame:
    cited, status = backfill_parts(spark, folder)
    return backfill.backfill_set(cited, status, backfill.gap_references(dv.gap_notes(spark, folder)))


@query(
    "backfill_run",
    rf"""{BACKFILL}, {GAP_REF_SQL}, w AS (SELECT id, id_type, id IN (SELECT id FROM cite JOIN gp USING (page)) AS g FROM cls WHERE route = 'backfill')
SELECT id AS ident, CASE WHEN g THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS relevance_score, CASE id_type WHEN 'arxiv' THEN 'arxiv' ELSE 'backfill' END AS engine FROM w ORDER BY g DESC, id LIMIT 12""",
)
def backfill_run(spark: SparkSession, folder: str) -> DataFrame:
    return backfill.as_proposals(backfill_set(spark, folder), "backfill", 12).select("ident", "relevance_score", "engine")


# ---- citation checks ----------------------------------------------------------


def claims(spark: SparkSession, folder: str) -> DataFrame:
    """Every document is the source of one benchmark claim; lines are paragraphs."""
    items = read_table(spark, folder, "benchmark")
    size = F.broadcast(items.agg(F.count(F.lit(1)).alias("n")))
    docs = read_table(spark, folder, "documents").crossJoin(size).select(
        "doc_id", (F.col("doc_id") % F.col("n")).alias("item_id"), F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("source")
    )
    claim = items.select("item_id", F.col("text").alias("claim"))
    return docs.join(claim, "item_id").select(F.col("doc_id").alias("claim_id"), "claim", "source")


@query(
    "claim_verdicts",
    r"""WITH n AS (SELECT count(*) AS n FROM benchmark),
c AS (SELECT d.doc_id AS claim_id, b.text AS claim, regexp_replace(d.text, '^\s+|\s+$', '', 'g') AS src FROM documents d, n JOIN benchmark b ON b.item_id = d.doc_id % n.n),
t AS (SELECT *, list_distinct(regexp_extract_all(lower(claim), '[a-z0-9]+')) AS ct FROM c),
p AS (SELECT claim_id, claim, ct, src, [x for x in [regexp_replace(y, '^\s+|\s+$', '', 'g') for y in string_split(src, chr(10))] if x <> ''] AS ps FROM t),
pe AS (SELECT claim_id, ct, unnest(ps) AS para, unnest(range(len(ps))) AS i FROM p),
ps2 AS (SELECT claim_id, para, ct, len(list_intersect(ct, list_distinct(regexp_extract_all(lower(para), '[a-z0-9]+')))) AS ov, i FROM pe),
bp AS (SELECT claim_id, para, ct, ov FROM (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY ov DESC, i DESC) AS rn FROM ps2) WHERE rn = 1),
sx AS (SELECT *, [s for s in [regexp_replace(y, '^\s+|\s+$', '', 'g') for y in string_split(regexp_replace(para, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))] if s <> ''] AS ss FROM bp),
se AS (SELECT claim_id, unnest(ss) AS s, unnest(range(len(ss))) AS i, ct FROM sx),
bs AS (SELECT claim_id, i FROM (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY len(list_intersect(ct, list_distinct(regexp_extract_all(lower(s), '[a-z0-9]+')))) DESC, i DESC) AS rn FROM se) WHERE rn = 1),
ex AS (SELECT p.claim_id, p.claim, p.ct, left(CASE WHEN sx.ov IS NULL OR sx.ov = 0 THEN replace(p.src, chr(10), chr(10) || chr(10)) WHEN len(sx.ss) <= 6 THEN sx.para
   ELSE array_to_string(list_slice(sx.ss, greatest(bs.i - 3, 0) + 1, greatest(bs.i - 3, 0) + 6), ' ') END, 2000) AS excerpt
  FROM p LEFT JOIN sx USING (claim_id) LEFT JOIN bs USING (claim_id)),
v AS (SELECT *, len(list_intersect(ct, list_distinct(regexp_extract_all(lower(excerpt), '[a-z0-9]+')))) / greatest(len(ct), 1)::DOUBLE AS share FROM ex)
SELECT claim_id, CASE WHEN share >= 0.6 THEN 'supported' ELSE 'unclear' END AS verdict, 'unreachable' AS route, 'low' AS confidence, md5(excerpt) AS digest, round(share, 6) AS share FROM v""",
)
def claim_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    found = evidence.check_claims(claims(spark, folder))
    return found.select("claim_id", "verdict", "route", "confidence", F.md5("excerpt").alias("digest"), "share")


@query(
    "judged_claims",
    """WITH r AS (SELECT event_id AS claim_id, ['supported', 'unsupported', 'unclear', 'unclear'][1 + event_id % 4] AS verdict FROM events)
SELECT verdict, CASE verdict WHEN 'supported' THEN 'keep' ELSE 'gap' END AS route, CASE verdict WHEN 'unclear' THEN 'medium' ELSE 'high' END AS confidence, count(*) AS claims FROM r GROUP BY ALL""",
)
def judged_claims(spark: SparkSession, folder: str) -> DataFrame:
    """Verdicts of replies in JSON, in prose and in neither form."""
    i = F.col("event_id")
    reply = (
        F.when(i % 4 == 0, F.concat(F.lit('```json\n{"verdict": "Supported", "reason": "'), "event_type", F.lit('"}\n```')))
        .when(i % 4 == 1, F.concat(F.lit("This is UNSUPPORTED, not supported: "), "event_type"))
        .when(i % 4 == 2, F.concat(F.lit('{"verdict": "maybe"} unclear '), "event_type")).otherwise(F.lit("no idea"))
    )
    judged = read_table(spark, folder, "events").select(evidence.parsed_verdict(reply).alias("verdict"))
    yes = F.lit(True)
    return (
        judged.select("verdict", evidence.route_of(F.col("verdict"), yes).alias("route"), evidence.confidence_of(F.col("verdict"), yes).alias("confidence"))
        .groupBy("verdict", "route", "confidence")
        .agg(F.count(F.lit(1)).alias("claims"))
    )


# ---- gap and direction notes --------------------------------------------------


@query(
    "gap_notes",
    r"""SELECT printf('GAP-%02d', item_id) AS id, 'Title ' || item_id AS title, regexp_replace(text, '^\s+|\s+$', '', 'g') AS missing, 'arxiv,web' AS fillable_by, 'c' || (item_id % 5) || ',d' AS concepts,
 ['high', 'low', 'medium'][1 + item_id % 3] AS priority FROM benchmark WHERE item_id % 4 <> 1""",
)
def gap_notes(spark: SparkSession, folder: str) -> DataFrame:
    found = gaps.gap_pages(dv.gap_notes(spark, folder))
    return found.select(
        "id", "title", "missing", F.array_join("fillable_by", ",").alias("fillable_by"), F.array_join("concepts", ",").alias("concepts"), "priority"
    )


@query(
    "gap_queries",
    r"""WITH g AS (SELECT item_id, 'Title ' || item_id AS title, regexp_replace(text, '^\s+|\s+$', '', 'g') AS missing FROM benchmark WHERE item_id % 4 <> 1)
SELECT printf('GAP-%02d', item_id) AS id, title || '|' || trim(regexp_replace(regexp_extract(missing, '^([^;.]*)', 1), '\s+', ' ', 'g')) AS queries FROM g""",
)
def gap_queries(spark: SparkSession, folder: str) -> DataFrame:
    from marginalia.functions.prose import gap_queries as made

    found = gaps.gap_pages(dv.gap_notes(spark, folder))
    return found.select("id", F.array_join(made(F.col("title"), F.col("missing")), "|").alias("queries"))


@query(
    "direction_notes",
    r"""SELECT printf('DIR-%04d', item_id) AS id, 'Q-0001,Q-0002' AS serves, 'c' || (item_id % 5) AS concepts, 'gap ' || item_id AS targets_gap, ['high', 'low', 'medium'][1 + item_id % 3] AS priority,
 'arxiv:one two|web:plain ' || item_id || '|-:just words' AS seeds, regexp_replace(text, '^\s+|\s+$', '', 'g') AS expected_evidence, 'done' AS solves_when, 'arxiv,web' AS engines
FROM benchmark WHERE item_id % 3 <> 2""",
)
def direction_notes(spark: SparkSession, folder: str) -> DataFrame:
    found = gaps.direction_pages(dv.direction_notes(spark, folder))
    seeds = F.array_join(F.transform("seed_queries", lambda q: F.concat(F.coalesce(q["engine"], F.lit("-")), F.lit(":"), q["query"])), "|")
    return found.select(
        "id", F.array_join("serves_question", ",").alias("serves"), F.array_join("concepts", ",").alias("concepts"), "targets_gap", "priority",
        seeds.alias("seeds"), "expected_evidence", "solves_when", F.array_join("engines", ",").alias("engines"),
    )


@query(
    "lane_targets",
    r"""WITH g AS (SELECT item_id, printf('GAP-%02d', item_id) AS id, ['high', 'low', 'medium'][1 + item_id % 3] AS priority FROM benchmark WHERE item_id % 4 <> 1),
d AS (SELECT item_id, printf('DIR-%04d', item_id) AS id, ['high', 'low', 'medium'][1 + item_id % 3] AS priority FROM benchmark WHERE item_id % 3 <> 2),
m AS (SELECT g.item_id AS gi, d.item_id AS di FROM g JOIN d ON d.item_id = g.item_id + 4 WHERE g.item_id % 8 = 0),
t AS (SELECT g.id || coalesce('+' || d.id, '') AS target_id, 'gap' AS lane, CASE WHEN d.id IS NULL OR list_position(['high', 'medium', 'low'], g.priority) <= list_position(['high', 'medium', 'low'], d.priority) THEN g.priority ELSE d.priority END AS priority, cast(CASE WHEN d.id IS NULL THEN 2 ELSE 3 END AS bigint) AS queries
  FROM g LEFT JOIN m ON m.gi = g.item_id LEFT JOIN d ON d.item_id = m.di
  UNION ALL SELECT id, 'research', priority, 3 FROM d WHERE item_id NOT IN (SELECT di FROM m))
SELECT target_id, lane, priority, queries FROM t""",
)
def lane_targets(spark: SparkSession, folder: str) -> DataFrame:
    from marginalia.operators import decide

    g = gaps.gap_pages(dv.gap_notes(spark, folder)).select("id", "title", "missing", "priority", "fillable_by")
    d = gaps.direction_pages(dv.direction_notes(spark, folder)).select(
        "id", F.col("expected_evidence").alias("evidence"), "priority", "engines", F.transform("seed_queries", lambda q: q["query"]).alias("seeds")
    )
    n = F.regexp_extract("gap_id", r"(\d+)$", 1).cast("bigint")
    pairs = g.select(F.col("id").alias("gap_id")).where(n % 8 == 0).withColumn("direction_id", F.format_string("DIR-%04d", n + 4))
    matches = pairs.join(d.select(F.col("id").alias("direction_id")), "direction_id", "left_semi")
    found = decide.in_lane_order(decide.targets(g, d, matches))
    return found.select("target_id", "lane", "priority", F.size("queries").cast("bigint").alias("queries"))


@query(
    "analysis_gaps",
    rf"""WITH {dv.ANALYSES_SQL}
SELECT analysis_id, 'GAP-' || (i + 1) AS id, 'About ' || (i + 1) AS title, '[[wiki/a]] here|plain' AS shows_up_in, regexp_replace(s || chr(10) || '  more', '^\s+', '') AS missing, 'arxiv,web' AS fillable_by,
 CASE WHEN i % 2 = 0 THEN 'kv-cache' ELSE 'kv-cache,moe-routing' END AS concepts, CASE WHEN i % 3 = 0 THEN 'high' ELSE 'medium' END AS priority, CASE WHEN i % 3 = 0 THEN 'it matters' ELSE '' END AS why FROM asent""",
)
def analysis_gaps(spark: SparkSession, folder: str) -> DataFrame:
    found = gaps.analysis_gaps(dv.gap_analyses(spark, folder))
    return found.select(
        "analysis_id", "id", "title", F.array_join("shows_up_in", "|").alias("shows_up_in"), "missing", F.array_join("fillable_by", ",").alias("fillable_by"),
        F.array_join("concepts", ",").alias("concepts"), "priority", "why",
    )


@query(
    "analysis_sections",
    """SELECT item_id AS analysis_id, 'cover ' || item_id AS coverage_map, 'old' AS stale, 'self' AS self_contained, '- one' || chr(10) || '- two' AS open_questions, true AS valid FROM benchmark""",
)
def analysis_sections(spark: SparkSession, folder: str) -> DataFrame:
    texts = dv.gap_analyses(spark, folder)
    valid = texts.select("analysis_id", gaps.valid_analysis(F.col("text")).alias("valid"))
    return gaps.analysis_sections(texts).join(valid, "analysis_id")


@query(
    "gap_files",
    rf"""WITH {dv.ANALYSES_SQL}, f AS (SELECT analysis_id, i, 'wiki/gap/GAP-' || (i + 1) || '-about-' || (i + 1) || '.md' AS path FROM asent)
SELECT path, analysis_id, CASE WHEN i % 2 = 0 THEN '2020-01-01' ELSE '2024-01-20' END AS created FROM f""",
)
def gap_files(spark: SparkSession, folder: str) -> DataFrame:
    """Pages of analysed gaps; every second one existed and keeps its day."""
    from marginalia.functions import frontmatter as fm

    found = gaps.analysis_gaps(dv.gap_analyses(spark, folder))
    n = F.regexp_extract("path", r"GAP-(\d+)", 1).cast("bigint")
    paths = found.select(F.concat(F.lit("wiki/gap/"), "id", F.lit("-about-"), F.regexp_extract("id", r"(\d+)$", 1), F.lit(".md")).alias("path")).distinct()
    existing = paths.where((n - 1) % 2 == 0).withColumn("text", F.lit("---\ncreated: 2020-01-01\n---\n"))
    made = gaps.gap_files(found, existing, dv.report_day())
    return made.select("path", "analysis_id", fm.scalar("text", "created").alias("created"))


@query(
    "synthesis_directions",
    """WITH s AS (SELECT item_id AS text_id, unnest(ss) AS s, unnest(range(len(ss))) AS i FROM (SELECT item_id, string_split(replace(text, chr(10), ' '), '. ') AS ss FROM benchmark))
SELECT text_id, 'D' || i AS title, 'Q-000' || (i % 9) AS serves_question, trim(s) AS targets_gap, 'high' AS priority FROM s""",
)
def synthesis_directions(spark: SparkSession, folder: str) -> DataFrame:
    return gaps.synthesis_directions(dv.synthesis_texts(spark, folder)).select("text_id", "title", "serves_question", "targets_gap", "priority")


@query(
    "synthesis_proposals",
    """WITH s AS (SELECT item_id AS text_id, unnest(ss) AS s, unnest(range(len(ss))) AS i FROM (SELECT item_id, string_split(replace(text, chr(10), ' '), '. ') AS ss FROM benchmark))
SELECT text_id, 'p' || i AS proposal, trim(regexp_replace(s, '[|:]', '', 'g')) AS why FROM s WHERE i % 2 = 0""",
)
def synthesis_proposals(spark: SparkSession, folder: str) -> DataFrame:
    found = gaps.synthesis_proposals(dv.synthesis_texts(spark, folder))
    return found.select("text_id", F.col("fields")["proposal"].alias("proposal"), F.col("fields")["why"].alias("why"))


@query(
    "reformulated_queries",
    """SELECT event_id AS reply_id, 't' || (event_id % 10) AS target_id, 'q ' || event_type || '|r' AS arxiv, 'why ' || event_id AS rationale FROM events WHERE event_id % 4 IN (0, 1)""",
)
def reformulated_queries(spark: SparkSession, folder: str) -> DataFrame:
    """Fenced and bare replies; a wrong shape or broken JSON is dropped whole."""
    i = F.col("event_id")
    good = F.concat(
        F.lit('{"t'), i % 10, F.lit('": {"queries_by_engine": {"arxiv": ["q '), "event_type", F.lit('", "r"]}, "rationale": "why '), i, F.lit('"}}')
    )
    reply = (
        F.when(i % 4 == 0, F.concat(F.lit("Here:\n```json\n"), good, F.lit("\n```"))).when(i % 4 == 1, F.concat(F.lit("ok "), good))
        .when(i % 4 == 2, F.lit('{"t1": {"queries_by_engine": {"arxiv": "text"}}}')).otherwise(F.lit("nothing {here"))
    )
    found = gaps.reformulated_queries(read_table(spark, folder, "events").select(i.alias("reply_id"), reply.alias("reply")))
    return found.select("reply_id", "target_id", F.array_join(F.col("queries")["arxiv"], "|").alias("arxiv"), "rationale")


# ---- wiki state ---------------------------------------------------------------

STATE_SQL = rf"""
ent AS (SELECT doc_id, path, CASE WHEN doc_id % 3 = 1 THEN (SELECT count(*) FROM (SELECT unnest(string_split(oq, chr(10))) AS l) WHERE regexp_matches(l, '^\s*[-*+]')) ELSE 0 END AS oq_count,
   '### [[' || path || ']]' || CASE WHEN doc_id % 3 = 1 THEN chr(10) || chr(10) || '#### Open Questions' || chr(10) || oq ELSE '' END
   || chr(10) || chr(10) || regexp_replace(left(body, 3000), '^\s+|\s+$', '', 'g') AS entry
  FROM (SELECT v.doc_id, v.path, regexp_replace('- ' || replace(d.text, chr(10), chr(10) || '- '), '^\s+|\s+$', '', 'g') AS oq,
         regexp_replace(substr(v.text, strpos(substr(v.text, 4), chr(10) || '---') + 7), '^\s+', '') AS body FROM vault v JOIN documents d USING (doc_id)))"""


@query(
    "wiki_state",
    rf"""WITH {dv.VAULT_SQL}, {STATE_SQL}, r AS (SELECT path, oq_count, length(entry) AS chars, sum(length(entry)) OVER (ORDER BY oq_count DESC, path, doc_id ROWS UNBOUNDED PRECEDING) AS running FROM (SELECT * REPLACE (path || '#' || doc_id AS path) FROM (SELECT doc_id, path, oq_count, replace(entry, '### [[' || path || ']]', '### [[' || path || '#' || doc_id || ']]') AS entry FROM ent)))
SELECT path, oq_count, chars, cast(running AS bigint) AS running FROM r WHERE running <= 80000""",
)
def wiki_state(spark: SparkSession, folder: str) -> DataFrame:
    pages = dv.vault_pages(spark, folder).withColumn("path", F.concat("path", F.lit("#"), "doc_id"))
    return gaps.state_pages(gaps.page_entries(pages)).select("path", "oq_count", "chars", "running")


@query("question_totals", rf"WITH {dv.VAULT_SQL}, {STATE_SQL} SELECT cast(sum(oq_count) AS bigint) AS open_questions, count(*) AS pages FROM ent")
def question_totals(spark: SparkSession, folder: str) -> DataFrame:
    return gaps.question_totals(gaps.page_entries(dv.vault_pages(spark, folder)))


@query(
    "concept_lines",
    rf"""WITH {dv.VAULT_SQL}, l AS (SELECT doc_id, stem, [x for x in [regexp_replace(y, '^\s+|\s+$', '', 'g') for y in string_split(substr(text, strpos(substr(text, 5), '---') + 7), chr(10))] if x <> '' and not starts_with(x, '#')] AS ls FROM vault)
SELECT doc_id, '- ' || stem || ': ' || coalesce(ls[1], stem) AS line FROM l""",
)
def concept_lines(spark: SparkSession, folder: str) -> DataFrame:
    pages = dv.vault_pages(spark, folder).withColumn("key", F.col("doc_id"))
    tagged = pages.select(F.concat("path", F.lit("")).alias("path"), "text", "doc_id")
    lines = gaps.concept_lines(tagged.select(F.concat(F.col("doc_id").cast("string"), F.lit("/"), "path").alias("path"), "text"))
    return lines.select(F.substring_index("path", "/", 1).cast("bigint").alias("doc_id"), "line")


@query(
    "numbered_rows",
    "SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS n FROM orders",
)
def numbered_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Positions inside three groups that each hold a third of all rows."""
    rows = read_table(spark, folder, "orders").select("o_orderkey", "o_orderstatus")
    return numbered(rows, "o_orderstatus", "o_orderkey").select("o_orderkey", "n")
