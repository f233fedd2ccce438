"""State that outlives a run: what was learned, counted tokens, allocated numbers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.catalog import fragments as fr
from marginalia.catalog.base import query
from marginalia.catalog.learn_queries import PROTECTED_SQL, REP, protected
from marginalia.catalog.spend_queries import RATE, USAGE
from marginalia.functions import frontmatter as fm
from marginalia.operators import allocation, learned_state, usage
from marginalia.operators import objectives as obj
from marginalia.plans import derived as dv
from marginalia.plans.derived import DECISIONS_SQL, TRANSCRIPT_SQL, decision_rows, objective_pages, transcript
from marginalia.session import checkpoint_root, read_table


def place(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_root(spark)}/state/{name}-{uuid.uuid4().hex}"


def old_document(spark: SparkSession, folder: str) -> DataFrame:
    """A stored document of the first form: counts of sources, and reject words without their counts."""
    sources = read_table(spark, folder, "nation").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.concat(F.lit("s"), "n_nationkey"), F.struct(F.col("n_nationkey").alias("accept"), F.col("n_regionkey").alias("reject"), F.lit(0.5).alias("rep")))))).alias("sources")
    )
    words = read_table(spark, folder, "region").agg(F.array_sort(F.collect_list(F.lower("r_name"))).alias("keywords"))
    both = sources.crossJoin(words).select("sources", F.struct("keywords").alias("reject_patterns"))
    return both.select(F.to_json(F.struct("sources", "reject_patterns")).alias("text"))


OLD_SQL = """
old_sources AS (SELECT 's' || n_nationkey AS name, cast(n_nationkey AS bigint) AS accept, cast(n_regionkey AS bigint) AS reject, 0.5::DOUBLE AS rep FROM nation),
old_words AS (SELECT lower(r_name) AS keyword, 2 AS reasons FROM region)"""


@query(
    "migrated_state",
    f"""WITH {OLD_SQL} SELECT 'source' AS part, name, accept, reject, rep FROM old_sources
UNION ALL SELECT 'word', keyword, reasons, NULL, NULL FROM old_words UNION ALL SELECT 'mean', 'accepted', 0, NULL, 0 UNION ALL SELECT 'mean', 'rejected', 0, NULL, 0""",
)
def migrated_state(spark: SparkSession, folder: str) -> DataFrame:
    """A document of the first form, read, stored as a version and read again."""
    root = place(spark, "migrated")
    learned_state.publish(learned_state.of_document(old_document(spark, folder)), root, None)
    return told(learned_state.load(spark, root))


def told(state: learned_state.Learned) -> DataFrame:
    """A state as rows ``part, name, accept, reject, rep``; a word's count stands in ``accept``, a mean in ``rep``."""
    none = F.lit(None)
    rows = [df.select(F.lit(part).alias("part"), "name", "accept", "reject", "rep") for part, df in (("source", state.sources), ("engine", state.engines))]
    rows.append(state.words.select(F.lit("word").alias("part"), F.col("keyword").alias("name"), F.col("reasons").alias("accept"), none.cast("long").alias("reject"), none.cast("double").alias("rep")))
    for kind in ("accepted", "rejected"):
        rows.append(state.calibration.select(F.lit("mean").alias("part"), F.lit(kind).alias("name"), F.col("n").alias("accept"), none.cast("long").alias("reject"), F.round(f"{kind}_mean", 6).alias("rep")))
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    return out


@query(
    "learn_pass",
    f"""WITH RECURSIVE {DECISIONS_SQL}, {PROTECTED_SQL}, {OLD_SQL},
kw AS (SELECT unnest({fr.reason_keywords('rejection_reason')}) AS keyword FROM decided WHERE NOT accepted AND rejection_reason <> ''),
words AS (SELECT keyword, cast(sum(reasons) AS bigint) AS reasons FROM (SELECT keyword, 1 AS reasons FROM kw WHERE keyword NOT IN (SELECT keyword FROM prot) UNION ALL SELECT * FROM old_words) GROUP BY keyword),
c AS (SELECT source_id AS name, count(CASE WHEN accepted THEN 1 END) AS accept, count(CASE WHEN NOT accepted THEN 1 END) AS reject FROM decided WHERE source_id <> '' GROUP BY ALL),
s AS (SELECT name, coalesce(c.accept, 0) + coalesce(o.accept, 0) AS accept, coalesce(c.reject, 0) + coalesce(o.reject, 0) AS reject, c.name IS NULL AS still, o.rep AS stored FROM c FULL JOIN old_sources o USING (name)),
e AS (SELECT engine AS name, count(CASE WHEN accepted THEN 1 END) AS accept, count(CASE WHEN NOT accepted THEN 1 END) AS reject FROM decided WHERE engine <> '' GROUP BY ALL),
steps AS (SELECT row_number() OVER (ORDER BY id % 2, id) AS n, accepted, relevance_score AS x FROM decided WHERE relevance_score IS NOT NULL),
walk(n, a, r) AS (SELECT 0::BIGINT, 0::DOUBLE, 0::DOUBLE UNION ALL
  SELECT s.n, CASE WHEN s.accepted THEN w.a + (s.x - w.a) / s.n ELSE w.a END, CASE WHEN s.accepted THEN w.r ELSE w.r + (s.x - w.r) / s.n END FROM walk w JOIN steps s ON s.n = w.n + 1),
last AS (SELECT * FROM walk ORDER BY n DESC LIMIT 1)
SELECT 'source' AS part, name, accept, reject, CASE WHEN still THEN stored ELSE {REP} END AS rep FROM s
UNION ALL SELECT 'engine', name, accept, reject, {REP} FROM e UNION ALL SELECT 'word', keyword, reasons, NULL, NULL FROM words
UNION ALL SELECT 'mean', 'accepted', n, NULL, round(a, 6) FROM last UNION ALL SELECT 'mean', 'rejected', n, NULL, round(r, 6) FROM last""",
)
def learn_pass(spark: SparkSession, folder: str) -> DataFrame:
    """An old document migrated, a pass over the even ids, and a second over all rows, each stored and read again."""
    root = place(spark, "learned")
    state, rows = learned_state.of_document(old_document(spark, folder)), decision_rows(spark, folder).where("id % 4 <> 0")
    version = None
    for batch in (rows.where("id % 2 = 0"), rows):
        moved = learned_state.learn_pass(state, batch, protected(spark, folder), "2024-05-01", words=True)
        version = learned_state.publish(moved.after, root, version)
        state = learned_state.load(spark, root)
    return told(state)


@query(
    "tokens_watermark",
    f"""WITH {TRANSCRIPT_SQL},
g AS (SELECT CASE WHEN position < 2 THEN 1 ELSE 2 END AS "commit", session_id, skill, {USAGE} FROM messages WHERE role = 'assistant' AND input_tokens IS NOT NULL GROUP BY ALL)
SELECT *, {RATE} AS estimate FROM g""",
)
def tokens_watermark(spark: SparkSession, folder: str) -> DataFrame:
    """The first messages of each session, then all of them, then the same run once more: each message counts once."""
    root = place(spark, "tokens")
    messages = transcript(spark, folder)
    for number, batch in ((1, messages.where("position < 2")), (2, messages), (2, messages)):
        usage.commit_usage(batch, root, number)
    return usage.usage(spark, root)


# ---- numbers and the pages under them --------------------------------------------

#: the pages of ``objective_pages`` as text
PAGES_SQL = f"""{dv.NODES_SQL},
raw AS (SELECT doc_id, k, type, id, path, status, solved, concepts, priority, body,
  '---' || chr(10) || 'type: ' || type || chr(10) || 'id: ' || id || chr(10) || 'created: ' || created AS h1, chr(10) || 'status: ' || status AS h2, chr(10) || 'priority: ' || priority AS h3, chr(10) || 'solved: ' || solved AS h4,
  chr(10) || 'scope: ' || scope || chr(10) || 'serves_question: ' || array_to_string(served, ', ') || chr(10) || CASE WHEN doc_id % 7 = 0 THEN 'related:' ELSE 'related: [[wiki/concepts/' || concepts[1] || ']], [[concepts/' || concepts[2] || '|x]]' END
   || chr(10) || 'from_gap: Q-0010 and Q-0011' || CASE WHEN doc_id % 2 = 0 THEN chr(10) || 'generated_by: wiki' ELSE '' END AS h5 FROM nodes)"""
TODAY = "2024-05-01"


def stored_counters(spark: SparkSession, folder: str) -> DataFrame:
    """Counters of an index page: questions are numbered on after all documents, tasks from 7."""
    text = F.concat(F.lit("---\ntype: index\nnext_id:\n  research_question: "), F.count(F.lit(1)) + 1, F.lit("\n  agent_todo: 7\n---\n"))
    page = read_table(spark, folder, "documents").agg(text.alias("text"))
    return page.select(F.explode(fm.next_id_counters("text")).alias("type", "next"))


def requests(spark: SparkSession, folder: str) -> DataFrame:
    """A task for every question without a concept, a question for every approved proposal."""
    known = obj.scan_nodes(objective_pages(spark, folder))
    tasks = known.where("type = 'research_question' AND size(concepts) = 0").select(F.lit("agent_todo").alias("type"), "id")
    return tasks.unionByName(known.where("type = 'research_question_proposal' AND lower(status) = 'approved'").select(F.lit("research_question").alias("type"), "id"))


def numbers(spark: SparkSession, folder: str, name: str) -> allocation.Allocator:
    """Numbers for a part of the requests, for all, and for all once more."""
    allocator = allocation.Allocator(spark, place(spark, name))
    allocator.seed(stored_counters(spark, folder))
    asked = requests(spark, folder)
    for part in (asked.where("id < 'QP'"), asked, asked):
        allocator.take(part, "id")
    return allocator


NUMBERS_SQL = """
asked AS (SELECT 'agent_todo' AS type, id FROM nodes WHERE k = 0 AND len(concepts) = 0 UNION ALL SELECT 'research_question', id FROM nodes WHERE k = 2 AND status = 'approved'),
start AS (SELECT 'agent_todo' AS type, 7 AS next UNION ALL SELECT 'research_question', count(*) + 1 FROM documents),
given AS (SELECT type, a.id AS key, CASE type WHEN 'agent_todo' THEN 'TODO-' ELSE 'Q-' END || printf('%04d', cast(next - 1 + row_number() OVER (PARTITION BY type ORDER BY a.id) AS int)) AS id FROM asked a JOIN start USING (type))"""


@query("advanced_counters", f"WITH {dv.NODES_SQL}, {NUMBERS_SQL} SELECT type, cast(next + (SELECT count(*) FROM asked a WHERE a.type = s.type) AS bigint) AS next FROM start s")
def advanced_counters(spark: SparkSession, folder: str) -> DataFrame:
    return numbers(spark, folder, "counters").counters()


@query("numbered_requests", f"WITH {dv.NODES_SQL}, {NUMBERS_SQL} SELECT type, key, id FROM given")
def numbered_requests(spark: SparkSession, folder: str) -> DataFrame:
    """Every request keeps the number of its first run, and no number is left out."""
    return numbers(spark, folder, "requests").allocated()


@query(
    "todo_pages",
    f"""WITH {dv.NODES_SQL}, {NUMBERS_SQL} SELECT 'objective/agent_todo/' || id || '-link-question-' || lower(key) || '.md' AS path,
'---' || chr(10) || 'type: agent_todo' || chr(10) || 'id: ' || id || chr(10) || 'created: {TODAY}' || chr(10) || 'updated: {TODAY}' || chr(10) || 'written_by: research' || chr(10) || 'status: open' || chr(10) || '---' || chr(10) || chr(10) || 'Give [[' || key || ']] a concept.' || chr(10) AS text
FROM given WHERE type = 'agent_todo'""",
)
def todo_pages(spark: SparkSession, folder: str) -> DataFrame:
    given = numbers(spark, folder, "todo").allocated().where("type = 'agent_todo'")
    tasks = given.select("id", F.concat(F.lit("Link question "), "key").alias("title"), F.concat(F.lit("\n\nGive [["), "key", F.lit("]] a concept.\n")).alias("body"))
    return allocation.todo_pages(tasks, TODAY).drop("id")


@query(
    "approved_proposals",
    f"""WITH {PAGES_SQL}, {NUMBERS_SQL}
SELECT path, md5(h1 || h3 || h4 || h5 || chr(10) || 'status: approved' || chr(10) || '---' || chr(10) || body) AS digest FROM raw WHERE k = 2
UNION ALL SELECT 'objective/research_question/' || g.id || '-' || lower(g.key) || '.md', md5('---' || chr(10) || 'type: research_question' || chr(10) || 'id: ' || g.id || chr(10) || 'created: {TODAY}' || chr(10) || 'updated: {TODAY}' || chr(10) || 'solved: no' || chr(10)
  || 'related: [' || CASE WHEN doc_id % 7 = 0 THEN '' ELSE '"[[wiki/concepts/' || concepts[1] || ']]", "[[wiki/concepts/' || concepts[2] || ']]"' END || ']' || chr(10) || 'priority: ' || CASE WHEN priority = 'urgent' THEN 'medium' ELSE priority END || chr(10) || 'answer_ref: ' || chr(10) || '---' || chr(10) || body)
FROM given g JOIN raw r ON r.id = g.key WHERE g.type = 'research_question'""",
)
def approved_proposals(spark: SparkSession, folder: str) -> DataFrame:
    """Every proposal's page marked approved, and the pages of the questions that the approved ones become."""
    known = obj.scan_nodes(objective_pages(spark, folder)).select("id", "path", "type").join(objective_pages(spark, folder).select("path", "text"), "path").where("type = 'research_question_proposal'")
    marked = known.select("path", F.md5(allocation.approved(F.col("text"))).alias("digest"))
    given = numbers(spark, folder, "approved").allocated().where("type = 'research_question'").withColumnRenamed("id", "new_id")
    made = given.join(known, given["key"] == known["id"]).select(F.col("new_id").alias("id"), F.col("key").alias("title"), "text")
    return marked.unionByName(allocation.question_pages(made, TODAY).select("path", F.md5("text").alias("digest")))


@query(
    "solved_questions",
    f"""WITH {PAGES_SQL} SELECT path, md5(h1 || h2 || h3 || h5 || chr(10) || 'solved: "yes"' || chr(10) || 'answer_ref: research/' || id || '.md' || chr(10) || '---' || chr(10) || body) AS digest FROM raw WHERE k = 0""",
)
def solved_questions(spark: SparkSession, folder: str) -> DataFrame:
    pages = objective_pages(spark, folder).where(F.col("path").startswith("objective/research_question/"))
    ident = F.regexp_extract("path", r"(Q-\d+)-x\.md$", 1)
    return pages.select("path", F.md5(allocation.solved(F.col("text"), F.concat(F.lit("research/"), ident, F.lit(".md")), TODAY)).alias("digest"))
