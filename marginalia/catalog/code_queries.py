"""Code-base manifest, commit decisions, access rules, release scan and views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.catalog import decide_queries, learn_queries, objective_queries, vault_queries
from marginalia.catalog.base import query
from marginalia.functions import prose
from marginalia.operators import codebase, graph, learn, reports, spend, stats
from marginalia.operators import decide, gaps, harvest, objectives
from marginalia.plans import derived as dv
from marginalia.session import read_table, written

FOLDERS = ["src", "lib", "tests", "node_modules", "docs", "app", ".git", "build"]
SUFFIXES = [".py", ".PY", ".js", ".md", ".rs", ".bin", ".tsx", ".h", ""]


def _pick(index: Column, values: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def _sql(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


FILES_SQL = f"""
files AS (SELECT {_sql(FOLDERS)}[1 + o_orderkey % 8] || '/' || CASE WHEN o_orderkey % 10 = 0 THEN 'vendor/' ELSE 'm' || (o_orderkey % 3) || '/' END || 'f' || o_orderkey AS stem, {_sql(SUFFIXES)}[1 + o_orderkey % 9] AS suffix,
  {_sql(FOLDERS)}[1 + o_orderkey % 8] AS top, o_orderkey AS k FROM orders),
kept AS (SELECT *, CASE lower(suffix) WHEN '.py' THEN 'Python' WHEN '.js' THEN 'JavaScript' WHEN '.md' THEN 'Markdown' WHEN '.rs' THEN 'Rust' WHEN '.tsx' THEN 'TypeScript' WHEN '.h' THEN 'C' END AS language
  FROM files WHERE top NOT IN ('node_modules', '.git', 'build') AND k % 10 <> 0)"""


def files(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("o_orderkey")
    middle = F.when(k % 10 == 0, F.lit("vendor/")).otherwise(F.concat(F.lit("m"), k % 3, F.lit("/")))
    path = F.concat(_pick(k % 8, FOLDERS), F.lit("/"), middle, F.lit("f"), k, _pick(k % 9, SUFFIXES))
    return read_table(spark, folder, "orders").select(path.alias("path"))


@query(
    "language_shares",
    f"""WITH {FILES_SQL}, c AS (SELECT language, count(*) AS files FROM kept WHERE language IS NOT NULL GROUP BY language)
SELECT language, files, round(100 * files / (SELECT sum(files) FROM c)::DOUBLE, 1) AS pct FROM c""",
)
def language_shares(spark: SparkSession, folder: str) -> DataFrame:
    return codebase.language_shares(files(spark, folder))


@query("document_languages", "WITH c AS (SELECT lang, count(*) AS docs FROM documents GROUP BY lang) SELECT lang, docs, round(100 * docs / (SELECT sum(docs) FROM c)::DOUBLE, 1) AS pct FROM c")
def document_languages(spark: SparkSession, folder: str) -> DataFrame:
    counts = read_table(spark, folder, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("docs"))
    total = F.broadcast(counts.agg(F.sum("docs").alias("total")))
    return counts.crossJoin(total).select("lang", "docs", F.round(100 * F.col("docs") / F.col("total"), 1).alias("pct"))


@query(
    "module_proposals",
    f"""WITH {FILES_SQL} SELECT top AS name, count(*) AS source_files, CASE WHEN top IN ('tests', 'docs') THEN 'support' ELSE 'core' END AS role_hint FROM kept
WHERE language IS NOT NULL AND language <> 'Markdown' GROUP BY top ORDER BY role_hint, source_files DESC, name LIMIT 4""",
)
def module_proposals(spark: SparkSession, folder: str) -> DataFrame:
    return codebase.modules(files(spark, folder), 4)


@query(
    "manifests",
    """SELECT 'r' || p_partkey || '/' || ['package.json', 'pyproject.toml', 'go.mod'][1 + p_partkey % 3] AS path, ['node', 'python', 'go'][1 + p_partkey % 3] AS kind,
 CASE p_partkey % 3 WHEN 2 THEN '' ELSE p_name END AS name, CASE p_partkey % 3 WHEN 2 THEN '' ELSE 'dep' || p_size || ',other' END AS dependencies, CASE p_partkey % 3 WHEN 0 THEN 'build,test' WHEN 1 THEN 'cli' ELSE '' END AS entry_points
FROM part WHERE p_partkey % 4 <> 3""",
)
def manifests(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("p_partkey")
    node = F.concat(
        F.lit('{"name": "'), "p_name", F.lit('", "dependencies": {"other": "1", "dep'), "p_size", F.lit('": "2"}, "scripts": {"test": "t", "build": "b"}}')
    )
    python = F.concat(
        F.lit('[project]\nname = "'), "p_name", F.lit('"\ndependencies = ["dep'), "p_size", F.lit('>=1", "other"]\n[project.scripts]\ncli = "pkg.mod:main"\n')
    )
    name = F.when(k % 4 == 3, "notes.txt").otherwise(_pick(k % 3, ["package.json", "pyproject.toml", "go.mod"]))
    found = read_table(spark, folder, "part").select(
        F.concat(F.lit("r"), k, F.lit("/"), name).alias("path"), F.when(k % 3 == 0, node).when(k % 3 == 1, python).otherwise("module x").alias("text")
    )
    made = codebase.manifests(found)
    return made.select(
        "path", "kind", "name",
        F.array_join(F.sort_array("dependencies"), ",").alias("dependencies"), F.array_join("entry_points", ",").alias("entry_points"),
    )


SUBJECTS = ["Merge decision branch", "Decided on layout", "Switching to new reader", "small change", "Use it instead of the old", "chose ADR 7", "Standardise names"]


@query(
    "commit_decisions",
    f"""WITH l AS (SELECT o_orderkey AS k, {_sql(SUBJECTS)}[1 + o_orderkey % 7] AS s, strftime(o_orderdate, '%Y-%m-%d') AS date, o_orderpriority AS p FROM orders WHERE o_orderkey % 11 <> 0)
SELECT 'h' || k AS sha, date, s || ' ' || p AS subject, ['', 'decided', 'switching to', '', 'instead of', 'chose', 'standardise'][1 + k % 7] AS signal FROM l WHERE k % 7 NOT IN (0, 3)""",
)
def commit_decisions(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("o_orderkey")
    line = F.concat_ws(
        "\u001f", F.concat(F.lit("h"), k), F.date_format("o_orderdate", "yyyy-MM-dd"), F.concat_ws(" ", _pick(k % 7, SUBJECTS), "o_orderpriority")
    )
    broken = F.concat(F.lit("h"), k, F.lit("\u001fno subject decision"))
    return codebase.commit_decisions(read_table(spark, folder, "orders").select(F.when(k % 11 == 0, broken).otherwise(line).alias("line")))


TOOLS = ["Write", "Edit", "Read"]
ROLES = ["wiki", "research", "web", "user"]
PATHS = [
    "wiki/a.md", "raw/papers/x.pdf", "meta/nightly_report/n.md", "objective/direction/DIR-1.md", "objective/research_question/Q-1.md",
    "meta/ingest_index.json", "/research/x.md", "",
]


@query(
    "access_decisions",
    f"""WITH e AS (SELECT event_id, {_sql(TOOLS)}[1 + event_id % 3] AS tool, {_sql(ROLES)}[1 + user_id % 4] AS role, ltrim({_sql(PATHS)}[1 + event_id % 8], '/') AS rel, CASE WHEN event_id % 5 = 0 THEN 'question-solve' ELSE 'x' END AS skill FROM events)
SELECT event_id, CASE WHEN tool = 'Read' OR role = 'user' OR rel = '' THEN 'no opinion'
 WHEN role = 'wiki' AND (starts_with(rel, 'wiki/') OR starts_with(rel, 'raw/papers/') OR starts_with(rel, 'meta/ingest_index')) THEN 'allow'
 WHEN role = 'research' AND (starts_with(rel, 'objective/direction/') OR starts_with(rel, 'research/') OR starts_with(rel, 'meta/nightly_report/')) THEN 'allow'
 WHEN role = 'research' AND starts_with(rel, 'objective/research_question/') AND skill = 'question-solve' THEN 'allow'
 WHEN role = 'web' AND starts_with(rel, 'meta/nightly_report/') THEN 'allow' ELSE 'deny' END AS decision FROM e""",
)
def access_decisions(spark: SparkSession, folder: str) -> DataFrame:
    i = F.col("event_id")
    events = read_table(spark, folder, "events").select(
        "event_id", _pick(i % 3, TOOLS).alias("tool"), _pick(F.col("user_id") % 4, ROLES).alias("role"), _pick(i % 8, PATHS).alias("path"),
        F.when(i % 5 == 0, "question-solve").otherwise("x").alias("skill"),
    )
    return codebase.access_decisions(events)


HARD = {"mail": r"[A-Za-z0-9._-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+", "address": r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b", "key": r"\b(?:AKIA|sk-|ghp_)[A-Za-z0-9]{8,}"}
WARN = {"long_number": r"\b[0-9]{12,19}\b", "license": r"(?i)copyright|license"}
SCAN_SQL = "scan AS (" + " UNION ALL ".join(
    f"SELECT doc_id, '{sev}' AS severity, '{name}' AS rule, cast(len(regexp_extract_all(text, '{p}')) AS bigint) AS hits FROM documents"
    for sev, rules in (("hard", HARD), ("warn", WARN)) for name, p in rules.items()
) + ")"


@query("release_findings", f"WITH {SCAN_SQL} SELECT * FROM scan WHERE hits > 0")
def release_findings(spark: SparkSession, folder: str) -> DataFrame:
    return codebase.scan_findings(read_table(spark, folder, "documents").select("doc_id", "text"), HARD, WARN)


@query("release_gate", f"WITH {SCAN_SQL} SELECT severity, rule, count(*) AS texts, cast(sum(hits) AS bigint) AS hits FROM scan WHERE hits > 0 GROUP BY ALL")
def release_gate(spark: SparkSession, folder: str) -> DataFrame:
    return codebase.gate(release_findings(spark, folder))


@query(
    "path_rules",
    r"""WITH p AS (SELECT o_orderkey, ['wiki/a.md', '/etc/x', 'a/../b', '', 'a/b' || chr(10)][1 + o_orderkey % 5] AS path, o_orderkey % 5 AS m FROM orders) SELECT o_orderkey, m = 0 AS safe, CASE WHEN m = 0 THEN 'wiki' ELSE 'wiki' END AS writer FROM p""",
)
def path_rules(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("o_orderkey")
    path = _pick(k % 5, ["wiki/a.md", "/etc/x", "a/../b", "", "a/b\n"])
    return read_table(spark, folder, "orders").select("o_orderkey", codebase.safe_path(path).alias("safe"), prose.written_by_for(path).alias("writer"))


@query("stray_root_pages", "SELECT 'note' || o_orderkey || '.md' AS path FROM orders WHERE o_orderkey % 4 = 0")
def stray_root_pages(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("o_orderkey")
    path = (
        F.when(k % 4 == 0, F.concat(F.lit("note"), k, F.lit(".md"))).when(k % 4 == 1, "index.md")
        .when(k % 4 == 2, F.concat(F.lit("_t"), k, F.lit(".md"))).otherwise(F.concat(F.lit("wiki/"), k, F.lit(".md")))
    )
    return graph.stray_root_pages(read_table(spark, folder, "orders").select(path.alias("path")))


# ---- declarative views --------------------------------------------------------

ICONS = {"O": "open", "F": "done", "P": "part"}


@query(
    "project_view",
    """SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'done' WHEN 'P' THEN 'part' ELSE '?' END AS icon, date '2001-08-01' - cast(o_orderdate AS date) AS days_since
FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus <> 'F'""",
)
def project_view(spark: SparkSession, folder: str) -> DataFrame:
    rows = read_table(spark, folder, "orders").where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH") & (F.col("o_orderstatus") != "F"))
    return rows.select(
        "o_orderkey", stats.status_icon(F.col("o_orderstatus"), ICONS, "?").alias("icon"),
        stats.days_since(F.to_date("o_orderdate"), F.lit("2001-08-01").cast("date")).alias("days_since"),
    )


@query(
    "task_view",
    """SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE cast(o_orderdate AS date) END < date '1998-06-01' AND o_orderstatus <> 'F', false) AS overdue FROM orders WHERE o_orderstatus NOT IN ('P') ORDER BY o_orderkey""",
)
def task_view(spark: SparkSession, folder: str) -> DataFrame:
    due = F.when(F.col("o_orderkey") % 9 == 0, F.lit(None).cast("date")).otherwise(F.to_date("o_orderdate"))
    late = stats.overdue(due, F.col("o_orderstatus") == "F", F.lit("1998-06-01").cast("date"))
    return read_table(spark, folder, "orders").where(~F.col("o_orderstatus").isin("P")).select("o_orderkey", late.alias("overdue")).orderBy("o_orderkey")


@query("status_groups", "SELECT o_orderstatus AS status, count(*) AS items FROM orders GROUP BY 1")
def status_groups(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("items")).orderBy("status")


@query("calendar_view", "SELECT cast(ts AS date) AS day, count(*) AS notes FROM events GROUP BY 1")
def calendar_view(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("notes"))


@query("recent_daily", "SELECT o_orderkey, cast(o_orderdate AS date) AS day FROM orders ORDER BY day DESC, o_orderkey LIMIT 7")
def recent_daily(spark: SparkSession, folder: str) -> DataFrame:
    rows = read_table(spark, folder, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    return rows.orderBy(F.col("day").desc(), "o_orderkey").limit(7)


@query(
    "facts_as_of",
    """SELECT event_id, event_type AS fact FROM events WHERE cast(ts AS date) <= date '2024-01-15' AND (event_id % 5 = 0 OR cast(ts AS date) + 10 > date '2024-01-15') AND cast(ts AS date) + cast(event_id % 4 AS int) <= date '2024-01-16'""",
)
def facts_as_of(spark: SparkSession, folder: str) -> DataFrame:
    """Facts that held on one day, as known a day later."""
    i, day = F.col("event_id"), F.to_date("ts")
    facts = read_table(spark, folder, "events").select(
        "event_id", F.col("event_type").alias("fact"), day.alias("valid_from"),
        F.when(i % 5 == 0, F.lit(None).cast("date")).otherwise(F.date_add(day, 10)).alias("valid_until"),
        F.date_add(day, (i % 4).cast("int")).alias("learned"),
    )
    return stats.facts_as_of(facts, F.lit("2024-01-15").cast("date"), F.lit("2024-01-16").cast("date")).select("event_id", "fact")


# ---- reports ------------------------------------------------------------------


@query(
    "health_report",
    vault_queries.AUDIT_CTE
    + """, l AS (SELECT "check", '[' || area || '] ' || path || CASE WHEN detail <> '' THEN ' - ' || detail ELSE '' END AS item FROM issues),
r AS (SELECT *, row_number() OVER (PARTITION BY "check" ORDER BY item) AS n, count(*) OVER (PARTITION BY "check") AS total FROM l)
SELECT '- ' || item AS line FROM r WHERE n <= 20 UNION ALL SELECT DISTINCT '## ' || "check" || ' (' || total || ')' FROM r UNION ALL SELECT DISTINCT '- _...and ' || (total - 20) || ' more_' FROM r WHERE total > 20""",
)
def health_report(spark: SparkSession, folder: str) -> DataFrame:
    issues = graph.audit(dv.vault_pages(spark, folder), dv.report_day())
    return reports.health_report(issues).select("line")


@query(
    "cost_report",
    f"""WITH {dv.CALLS_SQL}, t AS (SELECT * FROM ledger WHERE date = date '{dv.REPORT_DAY}')
SELECT '| ' || source || ' | ' || sum(input_tokens) || ' | ' || sum(output_tokens) || ' | ' || printf('%.4f', round(sum(cost_usd), 6)) || ' | ' || printf('%.4f', round(sum(estimated_cost_usd), 8)) || ' |' AS line FROM t GROUP BY source
UNION ALL SELECT '- ' || provider || ': $' || printf('%.4f', round(sum(cost_usd), 6)) FROM t GROUP BY provider
UNION ALL SELECT '| ' || action || ' | ' || array_to_string(list_sort(list(DISTINCT source)), ', ') || ' | ' || count(*) || ' | ' || sum(input_tokens) || ' | ' || sum(output_tokens) || ' | ' || printf('%.4f', round(sum(cost_usd), 6)) || ' | ' || printf('%.4f', round(sum(estimated_cost_usd), 8)) || ' |' FROM t GROUP BY action""",
)
def cost_report(spark: SparkSession, folder: str) -> DataFrame:
    return reports.cost_report(spend.ledger_rows(dv.cost_calls(spark, folder)), dv.report_day()).select("line")


@query(
    "learning_briefing",
    f"""WITH {dv.DECISIONS_SQL}, {learn_queries.PRIOR_SQL}, {learn_queries.PROTECTED_SQL}, {learn_queries.KEYWORD_SQL},
b AS (SELECT engine, count(CASE WHEN accepted THEN 1 END) AS accept, count(CASE WHEN NOT accepted THEN 1 END) AS reject FROM stored GROUP BY ALL), br AS (SELECT engine, {learn_queries.REP} AS prev FROM b),
a AS (SELECT engine, count(CASE WHEN accepted THEN 1 END) AS accept, count(CASE WHEN NOT accepted THEN 1 END) AS reject FROM both_runs GROUP BY ALL), ar AS (SELECT *, {learn_queries.REP} AS rep FROM a),
k AS (SELECT '- ' || keyword AS line FROM kc WHERE reasons >= 2 ORDER BY reasons DESC, keyword LIMIT 20)
SELECT '- ' || engine || ': ' || CASE WHEN rep >= 0 THEN '+' ELSE '' END || printf('%.3f', rep) || ' (' || CASE WHEN rep > prev THEN 'up' ELSE 'down' END || ')' AS line FROM ar JOIN br USING (engine) WHERE rep <> prev UNION ALL SELECT line FROM k""",
)
def learning_briefing(spark: SparkSession, folder: str) -> DataFrame:
    before = learn_queries.prior(spark, folder, "engine")
    fresh = learn_queries.new_decisions(spark, folder)
    changes = learn.reputation_changes(before, learn.updated_reputations(before, fresh, "engine"), "engine")
    words = learn.active_keywords(learn.keyword_counts(fresh, learn_queries.protected(spark, folder)))
    return reports.briefing_lines(changes, words, "engine").select("line")


@query(
    "node_lines",
    f"{objective_queries.CTE} SELECT id, '| ' || id || ' | ' || type || ' | ' || {objective_queries.STATE_SQL} || ' | ' || priority || ' | ' || created || ' | ' || path || ' |' AS line FROM nodes",
)
def node_lines(spark: SparkSession, folder: str) -> DataFrame:
    return reports.node_lines(objectives.node_table(objective_queries.nodes(spark, folder))).select("id", "line")


@query(
    "report_headers",
    r"""SELECT item_id, 'research/' || CASE item_id % 3 WHEN 0 THEN 'Q-' || printf('%04d', item_id) WHEN 1 THEN 'kv-cache-' || item_id ELSE 'deep/2024-01-20-topic-' || item_id END || '.md' AS path,
 '---' || chr(10) || 'type: direction' || chr(10) || 'id: DIR-' || item_id || chr(10) || 'title: T' || item_id || chr(10) || 'serves_question: Q-1' || chr(10) || 'priority: ' || ['high', 'medium'][1 + item_id % 2] || chr(10) || 'status: open' || chr(10)
 || CASE WHEN item_id % 2 = 0 THEN 'related: []' ELSE 'related:' || chr(10) || '  - "[[wiki/concepts/a]]"' || chr(10) || '  - "[[wiki/concepts/b]]"' END || chr(10) || 'created: 2024-01-20' || chr(10) || 'updated: 2024-01-20' || chr(10) || 'written_by: research' || chr(10) || '---' || chr(10) AS header,
 'x' || item_id AS answerable FROM benchmark""",
)
def report_headers(spark: SparkSession, folder: str) -> DataFrame:
    i = F.col("item_id")
    none, day = F.lit(""), dv.report_day()
    path = gaps.output_path(
        F.when(i % 3 == 0, F.format_string("Q-%04d", i)).otherwise(none), F.when(i % 3 == 1, F.concat(F.lit("KV cache "), i)).otherwise(none),
        F.when(i % 3 == 2, F.concat(F.lit("Topic: "), i)).otherwise(none), day,
    )
    slugs = F.when(i % 2 == 0, F.expr("cast(array() as array<string>)")).otherwise(F.array(F.lit("a"), F.lit("b")))
    header = gaps.direction_header(
        F.concat(F.lit("DIR-"), i), F.concat(F.lit("T"), i), F.lit("Q-1"), F.when(i % 2 == 0, "High first").otherwise("none"), slugs, day
    )
    answers = F.array_join(gaps.answerable(F.array(F.lit("None"), F.lit(" "), F.concat(F.lit(" x"), i))), "|")
    return read_table(spark, folder, "benchmark").select("item_id", path.alias("path"), header.alias("header"), answers.alias("answerable"))


@query(
    "match_trace",
    f"""WITH RECURSIVE {decide_queries.WALK_SQL},
unit AS (SELECT id, min(id) OVER (PARTITION BY role, list_sort(ts), list_sort(cs)) AS unit FROM side),
pairs AS (SELECT g.unit AS gu, d.unit AS du, count(*) AS n FROM walk JOIN unit g ON g.id = gap_id JOIN unit d ON d.id = direction_id GROUP BY ALL)
SELECT gap_id AS gap_unit, direction_id AS direction_unit, round(score, 6) AS score, coalesce(n, 0) AS merged,
    CASE WHEN n > 0 THEN 'MERGED' WHEN gap_id IN (SELECT gu FROM pairs) THEN 'gap-consumed' ELSE 'direction-consumed' END AS decision
FROM passed LEFT JOIN pairs ON gu = gap_id AND du = direction_id
WHERE gap_id IN (SELECT unit FROM unit) AND direction_id IN (SELECT unit FROM unit)""",
)
def match_trace(spark: SparkSession, folder: str) -> DataFrame:
    """What became of every scored unit pair, and how many of its rows were merged."""
    left, right = decide_queries.matching_sides(spark, folder)
    scores = written(decide.match_scores(left, right))
    found = decide.greedy_matches(left, right, scores, is_written=True)
    return reports.trace_lines(scores.withColumn("score", F.round("score", 6)), found, left, right)


@query(
    "new_vectors",
    """WITH c AS (SELECT DISTINCT sha256(text) AS h FROM documents) SELECT count(*) AS texts FROM c WHERE h NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 3 = 0)""",
)
def new_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Texts without a stored vector, one per content hash."""
    from marginalia.streaming.jobs import vectors_to_compute

    rows = read_table(spark, folder, "documents").select("doc_id", F.sha2("text", 256).alias("body_hash"), F.col("text").alias("contextualized_text"))
    stored = rows.where("doc_id % 3 = 0").select(F.lit("m").alias("model"), "body_hash").distinct()
    return vectors_to_compute(rows, stored, "m").agg(F.count(F.lit(1)).alias("texts"))


@query("fresh_cache", "SELECT event_id FROM events WHERE ts >= timestamp '2024-01-30 12:00:00' - interval 36 hour")
def fresh_cache(spark: SparkSession, folder: str) -> DataFrame:
    from marginalia.streaming.jobs import fresh_cache_entries

    entries = read_table(spark, folder, "events").select("event_id", F.col("ts").alias("stored_at"))
    return fresh_cache_entries(entries, F.lit("2024-01-30 12:00:00").cast("timestamp"), 36).select("event_id")


@query(
    "paper_engines",
    f"WITH {dv.REGISTRY_SQL} SELECT engine, count(*) AS entries FROM registry GROUP BY engine",
)
def paper_engines(spark: SparkSession, folder: str) -> DataFrame:
    return dv.registry(spark, folder).groupBy("engine").agg(F.count(F.lit(1)).alias("entries"))


@query(
    "staged_seen_cache",
    rf"""WITH {dv.CANDIDATES_SQL}, k AS (SELECT cand_id, CASE WHEN id_type = 'arxiv' THEN source_id ELSE url END AS sid FROM cands)
SELECT DISTINCT sid AS ident FROM k WHERE cand_id % 7 = 0 OR cand_id % 5 = 0""",
)
def staged_seen_cache(spark: SparkSession, folder: str) -> DataFrame:
    from marginalia.functions.identity import seen_identity

    found = dv.page_candidates(spark, folder).withColumn("ident", seen_identity(F.col("id_type"), F.col("source_id"), F.col("url")))
    return harvest.seen_after(found.where("cand_id % 7 = 0"), found.where("cand_id % 5 = 0"))
