"""Knowledge-base entities derived by Spark from the given tables.

Each function has the matching SQL text next to it, so that a check can rebuild
the same input in its own engine and then compute its result independently.
Every derivation is one narrow pass over its table and grows with it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.session import read_table

#: day the fixed-date reports are made for
REPORT_DAY = "2024-01-20"


def report_day() -> Column:
    return F.lit(REPORT_DAY).cast("date")


def _pick(index: Column, values: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def _sql_list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v + "'" for v in values) + "]"


AREAS = ["wiki", "wiki", "wiki", "objective", "research"]
FOLDERS = {"wiki": "concepts", "objective": "direction", "research": "notes"}
TYPES = ["concept", "entity", "source", "synthesis", "direction", "decision", "memo"]
STATUSES = ["draft", "active", "archived"]
WRITERS = ["wiki", "research", "USER", "someone"]


def vault_pages(spark: SparkSession, folder: str) -> DataFrame:
    """``documents`` as Markdown pages ``(doc_id, path, text)``.

    Words of nine letters or more become links, path-qualified on every second
    page; the first such word names the page, so stems collide and links hit.
    """
    docs = read_table(spark, folder, "documents").select("doc_id", "text", "lang", "source")
    i = F.col("doc_id")
    area = _pick(i % 5, AREAS)
    sub = F.when(area == "wiki", "concepts").when(area == "objective", "direction").otherwise("notes")
    stem = F.coalesce(
        F.nullif(F.regexp_extract("text", r"\p{L}{9,}", 0), F.lit("")), F.concat(F.lit("page-"), i.cast("string"))
    )
    linked = F.when(i % 2 == 0, F.regexp_replace("text", r"(\p{L}{9,})", "[[$1]]")).otherwise(
        F.regexp_replace("text", r"(\p{L}{9,})", "[[concepts/$1|$1]]")
    )
    day = F.format_string("2023-%02d-%02d", i % 12 + 1, i % 28 + 1)
    tags = F.when(i % 2 == 0, F.concat(F.lit("tags: ["), "lang", F.lit(", "), "source", F.lit("]\n"))).otherwise(
        F.concat(F.lit("tags:\n  - "), "lang", F.lit("\n  - "), "source", F.lit("\n"))
    )
    head = F.concat(
        F.lit("---\n"),
        F.lit("type: "), _pick(i % 7, TYPES), F.lit("\n"),
        F.when(i % 4 == 0, F.lit("")).otherwise(F.concat(F.lit("status: "), _pick(i % 3, STATUSES), F.lit("\n"))),
        F.lit("created: "), day, F.lit("\n"),
        F.when(i % 3 == 0, F.concat(F.lit('updated: "'), day, F.lit('"\n'))).otherwise(
            F.concat(F.lit("updated: "), day, F.lit("\n"))
        ),
        F.when(i % 6 == 0, F.lit("")).otherwise(F.concat(F.lit("written_by: "), _pick(i % 4, WRITERS), F.lit("\n"))),
        F.when(i % 5 == 1, F.lit("sources: [a]\n")).otherwise(F.lit("")),
        tags,
        F.lit("---\n"),
    )
    questions = F.when(
        i % 3 == 1, F.concat(F.lit("\n\n## Open questions\n- "), F.regexp_replace("text", "\n", "\n- "), F.lit("\n## Notes\n"))
    ).otherwise(F.lit(""))
    return docs.select(
        "doc_id",
        F.concat(area, F.lit("/"), sub, F.lit("/"), stem, F.lit(".md")).alias("path"),
        F.concat(head, linked, questions).alias("text"),
    )


VAULT_SQL = rf"""
vault AS (
  SELECT doc_id,
         area || '/' || CASE area WHEN 'wiki' THEN 'concepts' WHEN 'objective' THEN 'direction' ELSE 'notes' END
           || '/' || stem || '.md' AS path, area, stem,
         '---' || chr(10) || 'type: ' || {_sql_list(TYPES)}[1 + doc_id % 7] || chr(10)
         || CASE WHEN doc_id % 4 = 0 THEN '' ELSE 'status: ' || {_sql_list(STATUSES)}[1 + doc_id % 3] || chr(10) END
         || 'created: ' || day || chr(10)
         || CASE WHEN doc_id % 3 = 0 THEN 'updated: "' || day || '"' ELSE 'updated: ' || day END || chr(10)
         || CASE WHEN doc_id % 6 = 0 THEN '' ELSE 'written_by: ' || {_sql_list(WRITERS)}[1 + doc_id % 4] || chr(10) END
         || CASE WHEN doc_id % 5 = 1 THEN 'sources: [a]' || chr(10) ELSE '' END
         || CASE WHEN doc_id % 2 = 0 THEN 'tags: [' || lang || ', ' || source || ']' || chr(10)
                 ELSE 'tags:' || chr(10) || '  - ' || lang || chr(10) || '  - ' || source || chr(10) END
         || '---' || chr(10)
         || linked
         || CASE WHEN doc_id % 3 = 1 THEN chr(10) || chr(10) || '## Open questions' || chr(10) || '- '
                 || replace(body, chr(10), chr(10) || '- ') || chr(10) || '## Notes' || chr(10) ELSE '' END AS text
  FROM (SELECT doc_id, lang, source, text AS body,
               {_sql_list(AREAS)}[1 + doc_id % 5] AS area,
               coalesce(nullif(regexp_extract(text, '\p{{L}}{{9,}}'), ''), 'page-' || doc_id) AS stem,
               CASE WHEN doc_id % 2 = 0 THEN regexp_replace(text, '(\p{{L}}{{9,}})', '[[\1]]', 'g')
                    ELSE regexp_replace(text, '(\p{{L}}{{9,}})', '[[concepts/\1|\1]]', 'g') END AS linked,
               printf('2023-%02d-%02d', doc_id % 12 + 1, doc_id % 28 + 1) AS day
        FROM documents))"""


MODELS = ["haiku-small", "sonnet-large", "opus-1", "gemini-flash", "gemini-pro", "ollama/llama", "other"]


def cost_calls(spark: SparkSession, folder: str) -> DataFrame:
    """``events`` as model calls."""
    u, v = F.col("user_id"), F.col("value")
    return read_table(spark, folder, "events").select(
        "event_id",
        "ts",
        F.when(u % 5 == 0, F.lit(None).cast("string")).otherwise(F.concat(F.lit("v"), u % 2)).alias("vault"),
        F.col("event_type").alias("action"),
        _pick(u % 3, ["metered", "gemini", "local"]).alias("provider"),
        _pick(u % 7, MODELS).alias("model"),
        F.when(u % 11 == 0, F.lit(None).cast("string")).otherwise(_pick(u % 2, ["credit-pool", "pay-as-you-go"])).alias("source"),
        F.floor(v * 100).cast("bigint").alias("input_tokens"),
        F.floor(v * 10).cast("bigint").alias("output_tokens"),
        (v / 1000).alias("cost_usd"),
    )


CALLS_SQL = f"""
calls AS (
  SELECT event_id, ts, cast(ts AS date) AS date,
         CASE WHEN user_id % 5 = 0 THEN NULL ELSE 'v' || (user_id % 2) END AS vault,
         event_type AS action,
         ['metered', 'gemini', 'local'][1 + user_id % 3] AS provider,
         {_sql_list(MODELS)}[1 + user_id % 7] AS model,
         coalesce(CASE WHEN user_id % 11 = 0 THEN NULL ELSE ['credit-pool', 'pay-as-you-go'][1 + user_id % 2] END, 'unknown') AS source,
         cast(floor(value * 100) AS bigint) AS input_tokens,
         cast(floor(value * 10) AS bigint) AS output_tokens,
         round(value / 1000, 6) AS cost_usd
  FROM events),
ledger AS (
  SELECT *, round(CASE
      WHEN contains(model, 'haiku') THEN (input_tokens * 800 + output_tokens * 4000) / 10.0::DOUBLE
      WHEN contains(model, 'sonnet') THEN (input_tokens * 3000 + output_tokens * 15000) / 10.0::DOUBLE
      WHEN contains(model, 'opus') THEN (input_tokens * 15000 + output_tokens * 75000) / 10.0::DOUBLE
      WHEN contains(model, 'flash') THEN (input_tokens * 75 + output_tokens * 300) / 10.0::DOUBLE
      WHEN contains(model, 'gemini') THEN (input_tokens * 1250 + output_tokens * 5000) / 10.0::DOUBLE
      ELSE 0.0::DOUBLE END) / 1e8::DOUBLE AS estimated_cost_usd
  FROM calls)"""


def transcript(spark: SparkSession, folder: str) -> DataFrame:
    """``conversations`` as transcript messages with token usage."""
    n = F.length("text").cast("bigint")
    c, t = F.col("conv_id"), F.col("turn")
    return read_table(spark, folder, "conversations").select(
        c.alias("session_id"),
        F.concat_ws("-", c, t).alias("uuid"),
        t.alias("position"),
        "role",
        F.when(t % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("skill"), c % 4)).alias("skill"),
        _pick((c + t) % 7, MODELS).alias("model"),
        F.when(n % 10 == 0, F.lit(None).cast("bigint")).otherwise(F.floor(n / 4)).alias("input_tokens"),
        F.floor(n / 8).alias("output_tokens"),
        (n % 5).alias("cache_read_tokens"),
        (n % 3).alias("cache_create_tokens"),
    )


TRANSCRIPT_SQL = f"""
messages AS (
  SELECT conv_id AS session_id, conv_id || '-' || turn AS uuid, turn AS position, role,
         CASE WHEN turn % 3 = 0 THEN 'interactive' ELSE 'skill' || (conv_id % 4) END AS skill,
         {_sql_list(MODELS)}[1 + (conv_id + turn) % 7] AS model,
         CASE WHEN length(text) % 10 = 0 THEN NULL ELSE length(text) // 4 END AS input_tokens,
         length(text) // 8 AS output_tokens, length(text) % 5 AS cache_read, length(text) % 3 AS cache_create
  FROM conversations)"""


ENGINES = ["rss", "arxiv", "hackernews", "openalex"]
CANDIDATE_LANES = ["gap", "research", "news", "other"]


def page_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """``pages`` as scored crawl candidates."""
    from marginalia.operators.harvest import page_candidates as from_pages

    i = F.col("page_id")
    pages = read_table(spark, folder, "pages")
    scored = pages.select(i.alias("key"), (F.length("html") % 1000 / 1000).alias("score"))
    read = from_pages(pages).join(scored, i == F.col("key")).drop("key")
    return read.withColumn(
        "source_id", F.when(i % 10 == 0, F.concat(F.lit("arxiv:2401.0"), F.lpad((i % 40).cast("string"), 4, "0"))).otherwise(F.col("source_id"))
    ).withColumns(
        {
            "cand_id": i,
            "engine": _pick(i % 4, ENGINES),
            "lane": _pick(i % 4, CANDIDATE_LANES),
            "published": F.format_string("2023-%02d-%02d", i % 12 + 1, i % 28 + 1),
            "id_type": F.when(i % 10 == 0, "arxiv").otherwise("url"),
            "origin_ids": F.array(F.format_string("GAP-%02d", i % 9)),
            "expected_evidence": F.concat(F.lit("evidence "), i % 9, F.lit(".")),
        }
    )


HOST_SQL = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1))"
PAGE_TEXT_SQL = r"""trim(regexp_replace(regexp_replace(regexp_replace(html,
 '(?is)<script\b.*?</script>|<style\b.*?</style>|<nav\b.*?</nav>|<!--.*?-->', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))"""
CANDIDATES_SQL = rf"""
cands AS (
  SELECT page_id AS cand_id, url, html,
    trim(regexp_replace(regexp_replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '<[^>]+>', '', 'g'), '\s+', ' ', 'g')) AS title,
    {PAGE_TEXT_SQL} AS snippet,
    CASE WHEN page_id % 10 = 0 THEN 'arxiv:2401.0' || lpad(cast(page_id % 40 AS varchar), 4, '0') ELSE {HOST_SQL} END AS source_id,
    CASE WHEN page_id % 10 = 0 THEN 'arxiv' ELSE 'url' END AS id_type,
    (length(html) % 1000) / 1000::DOUBLE AS score,
    ['rss', 'arxiv', 'hackernews', 'openalex'][1 + page_id % 4] AS engine,
    ['gap', 'research', 'news', 'other'][1 + page_id % 4] AS lane,
    printf('2023-%02d-%02d', page_id % 12 + 1, page_id % 28 + 1) AS published,
    printf('GAP-%02d', page_id % 9) AS origin
  FROM pages),
idents AS (SELECT *, CASE WHEN source_id LIKE 'arxiv:%' THEN source_id ELSE coalesce(nullif(regexp_replace(url, '/+$', ''), ''), source_id) END AS ident FROM cands)"""


SECTIONS = ["paper-publisher", "blog-newsfeed", "github-repos"]
CATEGORIES = ["preprint_repository", "paper_api", "vendor_blogs", "benchmarking", "hardware_analysis", "misc"]


def registry(spark: SparkSession, folder: str) -> DataFrame:
    """``part`` as the source registry."""
    from marginalia.operators.harvest import paper_engine

    k = F.col("p_partkey")
    category = _pick(F.col("p_size") % 6, CATEGORIES)
    entry = F.when(k % 50 == 0, F.lit("papers_with_code")).when(k % 5 == 0, F.concat(F.lit("arxiv_"), k)).otherwise(F.concat(F.lit("p"), k))
    return read_table(spark, folder, "part").select(
        _pick(k % 3, SECTIONS).alias("section"),
        F.when(k % 50 == 0, F.concat(F.lit("p"), k)).otherwise(entry).alias("source_id"),
        F.col("p_name").alias("name"),
        F.concat_ws(" ", "p_type", "p_brand").alias("focus"),
        category.alias("category"),
        (F.col("p_size") % 5 + 1).cast("bigint").alias("relevance"),
        paper_engine(entry, category, {"p3": "openalex", "p6": "semantic_scholar"}).alias("engine"),
        k.alias("ord"),
    )


REGISTRY_SQL = """
registry AS (
  SELECT *, CASE WHEN entry = 'p3' THEN 'openalex' WHEN entry = 'p6' THEN 'semantic_scholar'
       WHEN starts_with(entry, 'arxiv_') THEN 'arxiv' WHEN entry = 'papers_with_code' THEN ''
       WHEN category = 'preprint_repository' THEN 'arxiv' WHEN category = 'paper_api' THEN 'semantic_scholar' ELSE '' END AS engine
  FROM (SELECT ['paper-publisher', 'blog-newsfeed', 'github-repos'][1 + p_partkey % 3] AS section,
         CASE WHEN p_partkey % 50 = 0 THEN 'p' || p_partkey WHEN p_partkey % 5 = 0 THEN 'arxiv_' || p_partkey ELSE 'p' || p_partkey END AS source_id,
         CASE WHEN p_partkey % 50 = 0 THEN 'papers_with_code' WHEN p_partkey % 5 = 0 THEN 'arxiv_' || p_partkey ELSE 'p' || p_partkey END AS entry,
         p_name AS name, p_type || ' ' || p_brand AS focus,
         ['preprint_repository', 'paper_api', 'vendor_blogs', 'benchmarking', 'hardware_analysis', 'misc'][1 + p_size % 6] AS category,
         cast(p_size % 5 + 1 AS bigint) AS relevance, p_partkey AS ord FROM part))"""


DECISION_STATUS = {"purchase": "ingested", "signup": "pending", "error": "rejected", "click": "waiting_approval", "view": "deleted"}


def decision_rows(spark: SparkSession, folder: str) -> DataFrame:
    """``events`` as decided ledger rows."""
    return decisions_of(read_table(spark, folder, "events"))


def decisions_of(events: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Decided ledger rows of a batch or stream of events, with some of its columns."""
    u, i = F.col("user_id"), F.col("event_id")
    status = F.lit(None).cast("string")
    for event, name in DECISION_STATUS.items():
        status = F.when(F.col("event_type") == event, F.lit(name)).otherwise(status)
    reason = F.concat_ws(
        " ", F.lit("too much"), _pick(i % 3, ["vendor noise", "marketing", "stale duplicate"]),
        F.concat(F.lit("bucket"), F.get_json_object("props", "$.k")),
    )
    return events.select(
        i.alias("id"),
        status.alias("status"),
        F.when(u % 10 == 0, "research").otherwise("web").alias("discovered_by"),
        F.when(u % 7 == 0, F.lit("")).otherwise(F.concat(F.lit("s"), u)).alias("source_id"),
        _pick(u % 3, ["rss", "arxiv", "web"]).alias("engine"),
        F.when(i % 13 == 0, F.lit(None).cast("double")).otherwise(F.col("value") / 1000).alias("relevance_score"),
        F.when(F.col("event_type") == "error", reason).otherwise(F.lit("")).alias("rejection_reason"), *(keep or []),
    )


DECISIONS_SQL = """
decided AS (
  SELECT *, status IN ('ingested', 'pending') AS accepted FROM (
    SELECT event_id AS id,
      CASE event_type WHEN 'purchase' THEN 'ingested' WHEN 'signup' THEN 'pending' WHEN 'error' THEN 'rejected'
           WHEN 'click' THEN 'waiting_approval' ELSE 'deleted' END AS status,
      CASE WHEN user_id % 7 = 0 THEN '' ELSE 's' || user_id END AS source_id,
      ['rss', 'arxiv', 'web'][1 + user_id % 3] AS engine,
      CASE WHEN event_id % 13 = 0 THEN NULL ELSE value / 1000 END AS relevance_score,
      CASE WHEN event_type = 'error' THEN 'too much ' || ['vendor noise', 'marketing', 'stale duplicate'][1 + event_id % 3]
           || ' bucket' || json_extract_string(props, '$.k') ELSE '' END AS rejection_reason
    FROM events WHERE user_id % 10 <> 0 AND event_id % 4 <> 0)
  WHERE status IN ('ingested', 'pending', 'rejected'))"""


NODE_TYPES = ["research_question", "direction", "research_question_proposal", "decision", "agent_todo"]
NODE_PREFIXES = ["Q", "DIR", "QP", "D", "TODO"]
PRIORITIES = ["high", "medium", "low", "urgent"]
SCOPES = ["all", "wiki", "research", "web", "Q-0005", "else"]


def objective_pages(spark: SparkSession, folder: str) -> DataFrame:
    """``documents`` as pages of objective nodes ``(doc_id, path, text)``."""
    i = F.col("doc_id")
    kind = _pick(i % 5, NODE_TYPES)
    ident = F.format_string("%s-%04d", _pick(i % 5, NODE_PREFIXES), i)
    status = (
        F.when(i % 5 == 1, _pick(i % 3, ["open", "superseded", "open"]))
        .when(i % 5 == 2, _pick(i % 4, ["pending", "pending", "approved", "pending"]))
        .when(i % 5 == 3, _pick(i % 3, ["active", "retired", ""])).otherwise(F.lit("open"))
    )
    served = F.concat(
        F.format_string("Q-%04d", i - 1), F.when(i % 2 == 0, F.format_string(", Q-%04d", i - 6)).otherwise(F.lit(""))
    )
    lines = F.concat(
        F.lit("---\ntype: "), kind, F.lit("\nid: "), ident,
        F.lit("\ncreated: "), F.format_string("2023-%02d-%02d", i % 12 + 1, i % 28 + 1),
        F.lit("\nstatus: "), status, F.lit("\npriority: "), _pick(i % 4, PRIORITIES),
        F.lit("\nsolved: "), F.when(i % 3 == 0, "yes").otherwise("no"),
        F.lit("\nscope: "), _pick(i % 6, SCOPES), F.lit("\nserves_question: "), served,
        F.when(i % 7 == 0, F.lit("\nrelated:")).otherwise(
            F.concat(F.lit("\nrelated: [[wiki/concepts/"), "lang", F.lit("]], [[concepts/"), "source", F.lit("|x]]"))
        ),
        F.lit("\nfrom_gap: Q-0010 and Q-0011"),
        F.when(i % 2 == 0, F.lit("\ngenerated_by: wiki")).otherwise(F.lit("")), F.lit("\n---\n"),
    )
    path = F.concat(F.lit("objective/"), kind, F.lit("/"), ident, F.lit("-x.md"))
    body = F.concat("text", F.lit(" See "), F.format_string("Q-%04d", i % 50), F.lit(" and [[Q-0005]]."))
    return read_table(spark, folder, "documents").select("doc_id", path.alias("path"), F.concat(lines, body).alias("text"))


NODES_SQL = """
nodes AS (
  SELECT doc_id, k, ['research_question', 'direction', 'research_question_proposal', 'decision', 'agent_todo'][1 + k] AS type,
    ['Q', 'DIR', 'QP', 'D', 'TODO'][1 + k] || '-' || printf('%04d', doc_id) AS id,
    'objective/' || ['research_question', 'direction', 'research_question_proposal', 'decision', 'agent_todo'][1 + k] || '/' || ['Q', 'DIR', 'QP', 'D', 'TODO'][1 + k] || '-' || printf('%04d', doc_id) || '-x.md' AS path,
    printf('2023-%02d-%02d', doc_id % 12 + 1, doc_id % 28 + 1) AS created,
    CASE k WHEN 1 THEN ['open', 'superseded', 'open'][1 + doc_id % 3] WHEN 2 THEN ['pending', 'pending', 'approved', 'pending'][1 + doc_id % 4]
           WHEN 3 THEN ['active', 'retired', ''][1 + doc_id % 3] ELSE 'open' END AS status,
    ['high', 'medium', 'low', 'urgent'][1 + doc_id % 4] AS priority, CASE WHEN doc_id % 3 = 0 THEN 'yes' ELSE 'no' END AS solved,
    ['all', 'wiki', 'research', 'web', 'Q-0005', 'else'][1 + doc_id % 6] AS scope,
    list_concat([printf('Q-%04d', doc_id - 1)], CASE WHEN doc_id % 2 = 0 THEN [printf('Q-%04d', doc_id - 6)] ELSE [] END) AS served,
    CASE WHEN doc_id % 7 = 0 THEN [] ELSE [lang, source] END AS concepts,
    text || ' See ' || printf('Q-%04d', doc_id % 50) || ' and [[Q-0005]].' AS body
  FROM (SELECT *, doc_id % 5 AS k FROM documents))"""


def review_reports(spark: SparkSession, folder: str) -> DataFrame:
    """``conversations`` turns as checkbox reports, one block per sentence."""
    sentences = F.split("text", r"\. ")
    base = F.concat(F.lit("c"), F.col("conv_id"), F.lit("t"), F.col("turn"))

    def block(s: Column, i: Column) -> Column:
        ident = F.concat(base, F.lit("-"), i)
        n = F.length(s)
        return F.concat(
            F.lit("### "), i + 1, F.lit(". entry\n- **url**: http://x.example/"), ident,
            F.lit("\n- ["), F.when(n % 4 < 2, "x").otherwise(" "), F.lit("] approve · `"), ident,
            F.lit("`\n- ["), F.when((n % 4 == 1) | (n % 4 == 2), "X").otherwise(" "), F.lit("] reject · `"), ident,
            F.lit("`\n    - reason: "), F.regexp_extract(s, r"^(\S*)", 1), F.lit("\n"),
        )

    body = F.array_join(F.transform(sentences, block), "\n")
    decoy = F.concat(F.lit("\n## Decision trace\n### 99. decoy\n- [x] approve · `"), base, F.lit("-decoy`\n"))
    head = F.concat(F.lit("# Report\n- [x] approve · `"), base, F.lit("-0`\n\n"))
    return read_table(spark, folder, "conversations").select(base.alias("report_id"), F.concat(head, body, decoy).alias("text"))


REPORTS_SQL = r"""
sent AS (SELECT 'c' || conv_id || 't' || turn AS report_id, unnest(ss) AS s, unnest(range(len(ss))) AS i FROM (SELECT *, string_split(text, '. ') AS ss FROM conversations)),
marks AS (SELECT report_id, report_id || '-' || i AS id, length(s) % 4 IN (0, 1) OR i = 0 AS a, i > 0 AND length(s) % 4 IN (1, 2) AS r, s, i, length(s) % 4 AS m FROM sent),
acts AS (SELECT report_id, id, CASE WHEN i = 0 THEN 'approve' WHEN m = 1 THEN 'conflict' WHEN m = 0 THEN 'approve' WHEN m = 2 THEN 'reject' ELSE 'deferred' END AS action,
   CASE WHEN i > 0 AND m IN (1, 2) THEN regexp_extract(s, '^(\S*)', 1) ELSE '' END AS reason, i, s FROM marks)"""


def cited_texts(spark: SparkSession, folder: str) -> DataFrame:
    """``documents`` with paper citations appended, as wiki pages."""
    i = F.col("doc_id")
    cites = F.concat(
        F.lit("\n\nSee arXiv: 2401."), F.lpad((i % 60).cast("string"), 5, "0"), F.lit("v2 and https://arxiv.org/abs/2305."),
        F.lpad((i % 7).cast("string"), 5, "0"), F.lit(" plus https://doi.org/10.1000/AbC"), i % 30, F.lit(").\n"),
    )
    path = F.concat(F.lit("wiki/sources/"), "source", F.lit("-"), i, F.lit(".md"))
    return read_table(spark, folder, "documents").select("doc_id", path.alias("path"), F.concat("text", cites).alias("text"))


CITED_SQL = """
cite AS (
  SELECT 'wiki/sources/' || source || '-' || doc_id AS page, 'arxiv:2401.' || lpad(cast(doc_id % 60 AS varchar), 5, '0') AS id, 'arxiv' AS id_type FROM documents
  UNION ALL SELECT 'wiki/sources/' || source || '-' || doc_id, 'arxiv:2305.' || lpad(cast(doc_id % 7 AS varchar), 5, '0'), 'arxiv' FROM documents
  UNION ALL SELECT 'wiki/sources/' || source || '-' || doc_id, 'doi:10.1000/abc' || (doc_id % 30), 'doi' FROM documents)"""


def gap_notes(spark: SparkSession, folder: str) -> DataFrame:
    """``benchmark`` items as gap pages ``(item_id, path, text)``."""
    i = F.col("item_id")
    ident = F.format_string("GAP-%02d", i)
    text = F.concat(
        F.lit("---\r\nid: "), F.when(i % 3 == 0, F.lit("")).otherwise(ident), F.lit("\r\ntitle: \"Title "), i,
        F.lit("\"\r\nstatus: "), _pick(i % 4, ["open", "filled", "", "Open"]),
        F.lit("\r\npriority: "), _pick(i % 3, ["High - now", "low", "whatever"]),
        F.lit("\r\nfillable_by: [arxiv, \"web\", ArXiv]\r\nconcepts:\r\n  - \"[[wiki/concepts/c"), i % 5, F.lit("|x]]\"\r\n  - \"[[concepts/d]]\"\r\n---\r\n\n## Missing\n"),
        "text", F.lit("\n\n## Shows up in\n- [[wiki/sources/src"), i % 20, F.lit("-"), i, F.lit("#a]]\n- [[wiki/sources/src1-1|b]]\n\n## Other\nx\n"),
    )
    return read_table(spark, folder, "benchmark").select(
        "item_id", F.concat(F.lit("wiki/gap/"), ident, F.lit("-slug.md")).alias("path"), text.alias("text")
    )


def direction_notes(spark: SparkSession, folder: str) -> DataFrame:
    """``benchmark`` items as direction pages ``(item_id, path, text)``."""
    i = F.col("item_id")
    ident = F.format_string("DIR-%04d", i)
    text = F.concat(
        F.lit("---\nid: "), ident, F.lit("\nstatus: "), _pick(i % 3, ["open", "Open", "done"]),
        F.lit("\nserves_question: Q-0001, Q-0002\nrelated: [[wiki/concepts/c"), i % 5,
        F.lit("]]\ntargets_gap: \"gap "), i, F.lit("\"\npriority: "), _pick(i % 3, ["high", "LOW x", ""]),
        F.lit("\n---\n\n## seed_queries\n- arxiv: [[wiki/x/One|one]] **two** [3]\n- Web: plain "), i, F.lit("\n- just words\n-\n- [4]\n\n## expected_evidence\n"),
        "text", F.lit("\n\n## solves_when\ndone\n"),
    )
    return read_table(spark, folder, "benchmark").select(
        "item_id", F.concat(F.lit("objective/direction/"), ident, F.lit(".md")).alias("path"), text.alias("text")
    )


def gap_analyses(spark: SparkSession, folder: str) -> DataFrame:
    """``benchmark`` items as gap analyses, one block per sentence."""
    sentences = F.split(F.replace("text", F.lit("\n"), F.lit(" ")), r"\. ")

    def block(s: Column, i: Column) -> Column:
        return F.concat(
            F.lit("### GAP-"), i + 1, F.lit(": About "), i + 1, F.lit("\n- shows_up_in: [[wiki/a]] here ; plain\n- missing: "), s,
            F.lit("\n  more\n- fillable_by: arxiv (papers), Web\n- "),
            F.when(i % 2 == 0, F.lit("concepts: [[wiki/concepts/kv-cache]]")).otherwise(F.lit("topic: kv-cache and moe-routing")),
            F.lit("\n- priority: "), F.when(i % 3 == 0, F.lit("High - it matters")).otherwise(F.lit("soon")), F.lit("\n"),
        )

    text = F.concat(
        F.lit("intro\n## Knowledge Gaps\n"), F.array_join(F.transform(sentences, block), "\n"),
        F.lit("\n## Coverage Map\ncover "), F.col("item_id"), F.lit("\n\n## Stale / Unverified\nold\n## Open-Question Harvest\n- one\n- two\n## Self-contained\nself\n\nREADY\n"),
    )
    return read_table(spark, folder, "benchmark").select(F.col("item_id").alias("analysis_id"), text.alias("text"))


ANALYSES_SQL = """
asent AS (SELECT item_id AS analysis_id, unnest(ss) AS s, unnest(range(len(ss))) AS i FROM (SELECT item_id, string_split(replace(text, chr(10), ' '), '. ') AS ss FROM benchmark))"""


def synthesis_texts(spark: SparkSession, folder: str) -> DataFrame:
    """``benchmark`` items as synthesis replies with directions and proposals."""
    one_line = F.replace("text", F.lit("\n"), F.lit(" "))
    sentences = F.split(one_line, r"\. ")

    def direction(s: Column, i: Column) -> Column:
        return F.concat(
            F.lit("### DIRECTION: D"), i, F.lit("\n- Serves question: Q-000"), i % 9, F.lit("\n- targets_gap: "), s,
            F.lit("\n- priority: low\n- priority: high\n- ignored: x\n"),
        )

    def proposal(s: Column, i: Column) -> Column:
        return F.when(i % 2 == 0, F.concat(F.lit("- proposal: p"), i, F.lit(" | why: "), F.regexp_replace(s, "[|:]", ""))).otherwise(F.lit("- other"))

    text = F.concat(
        F.lit("## Directions\n"), F.array_join(F.transform(sentences, direction), "\n"),
        F.lit("\n## Proposed New Research Questions\n"), F.array_join(F.transform(sentences, proposal), "\n"), F.lit("\n## End\n- proposal: late\n"),
    )
    return read_table(spark, folder, "benchmark").select(F.col("item_id").alias("text_id"), text.alias("text"))
