"""Objective graph: frontier, decisions, links and reconcile checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.catalog import fragments as fr
from marginalia.catalog.base import query
from marginalia.functions import frontmatter as fm
from marginalia.functions import prose
from marginalia.operators import objectives as obj
from marginalia.plans.derived import NODES_SQL, objective_pages
from marginalia.session import read_table

CTE = f"WITH {NODES_SQL}"
PRIORITY_SQL = "CASE priority WHEN 'high' THEN 0 WHEN 'low' THEN 2 ELSE 1 END"
STATE_SQL = "CASE WHEN type = 'research_question' THEN solved ELSE status END"


def nodes(spark: SparkSession, folder: str) -> DataFrame:
    return obj.scan_nodes(objective_pages(spark, folder))


@query(
    "node_scan",
    f"{CTE} SELECT id, type, path, created, status, priority, solved, scope, array_to_string(concepts, ',') AS concepts, md5(body) AS body_digest FROM nodes",
)
def node_scan(spark: SparkSession, folder: str) -> DataFrame:
    return nodes(spark, folder).select(
        "id", "type", "path", "created", "status", "priority", "solved", "scope", F.array_join("concepts", ",").alias("concepts"),
        F.md5("body").alias("body_digest"),
    )


@query(
    "node_counts",
    f"{CTE} SELECT t.type, count(n.id) AS nodes FROM (SELECT unnest(['purpose', 'research_question', 'decision', 'research_question_proposal', 'direction', 'agent_todo']) AS type) t LEFT JOIN nodes n USING (type) GROUP BY t.type",
)
def node_counts(spark: SparkSession, folder: str) -> DataFrame:
    return obj.node_counts(nodes(spark, folder))


@query("question_split", f"{CTE} SELECT count(CASE WHEN solved <> 'yes' THEN 1 END) AS open, count(CASE WHEN solved = 'yes' THEN 1 END) AS solved FROM nodes WHERE type = 'research_question'")
def question_split(spark: SparkSession, folder: str) -> DataFrame:
    return obj.question_split(nodes(spark, folder))


@query("node_table", f"{CTE} SELECT id, type, {STATE_SQL} AS state, priority, created, path FROM nodes")
def node_table(spark: SparkSession, folder: str) -> DataFrame:
    return obj.node_table(nodes(spark, folder))


@query(
    "open_frontier",
    f"""{CTE} SELECT id, type, {PRIORITY_SQL} AS priority_rank, CASE WHEN type = 'research_question' THEN 0 ELSE 1 END AS type_rank, created FROM nodes
WHERE (type = 'research_question' AND solved <> 'yes') OR (type = 'direction' AND status = 'open')""",
)
def open_frontier(spark: SparkSession, folder: str) -> DataFrame:
    return obj.frontier(nodes(spark, folder))


@query(
    "active_decisions",
    f"{CTE} SELECT id, scope, CASE scope WHEN 'all' THEN 0 WHEN 'wiki' THEN 1 WHEN 'research' THEN 2 WHEN 'web' THEN 3 ELSE 99 END AS scope_rank FROM nodes WHERE type = 'decision' AND status IN ('active', '')",
)
def active_decisions(spark: SparkSession, folder: str) -> DataFrame:
    return obj.active_decisions(nodes(spark, folder))


@query(
    "allocated_ids",
    f"""{CTE}, top AS (SELECT type, max(cast(regexp_extract(id, '(\\d+)$', 1) AS bigint)) AS top FROM nodes GROUP BY type)
SELECT n.type, n.path, printf('%s-%04d', CASE n.type WHEN 'research_question' THEN 'Q' WHEN 'direction' THEN 'DIR' WHEN 'research_question_proposal' THEN 'QP' WHEN 'decision' THEN 'D' ELSE 'TODO' END,
  top + row_number() OVER (PARTITION BY n.type ORDER BY n.path)) AS id
FROM nodes n JOIN top USING (type)""",
)
def allocated_ids(spark: SparkSession, folder: str) -> DataFrame:
    """A new id for every node, numbered on after the highest of its type."""
    known = nodes(spark, folder)
    return obj.allocate_ids(known.select("type", "path"), known, "path")


@query(
    "node_link_edges",
    f"""{CTE}, e AS (
 SELECT id, type, CASE type
   WHEN 'research_question' THEN [struct_pack(kind := 'concept', target := 'wiki/concepts/' || c) for c in concepts]
   WHEN 'direction' THEN list_concat(CASE WHEN len(served) = 1 AND doc_id > 0 THEN [struct_pack(kind := 'serves', target := served[1])] ELSE [] END, [struct_pack(kind := 'concept', target := 'wiki/concepts/' || c) for c in concepts])
   WHEN 'research_question_proposal' THEN list_concat([struct_pack(kind := 'relates to', target := q) for q in rel], [struct_pack(kind := 'concept', target := 'wiki/concepts/' || c) for c in concepts])
   WHEN 'decision' THEN [struct_pack(kind := 'governs', target := CASE WHEN scope = 'Q-0005' THEN scope ELSE 'purpose' END)]
   ELSE [] END AS es
 FROM (SELECT *, [a[i] for i in range(1, len(a) + 1) if list_position(a, a[i]) = i] AS rel FROM (SELECT *, regexp_extract_all('Q-0010 and Q-0011' || chr(10) || body, 'Q-\\d{{4}}') AS a FROM nodes)))
SELECT id, cast(pos AS bigint) AS pos, e.kind AS kind, e.target AS target FROM (SELECT id, unnest(es) AS e, unnest(range(len(es))) AS pos FROM e)""",
)
def node_link_edges(spark: SparkSession, folder: str) -> DataFrame:
    return obj.link_edges(nodes(spark, folder)).withColumn("pos", F.col("pos").cast("bigint"))


@query(
    "node_links_sections",
    f"""{CTE}, r AS (SELECT id, type, CASE WHEN scope = 'Q-0005' THEN scope ELSE 'purpose' END AS target FROM nodes WHERE type = 'decision')
SELECT r.id, '<!-- links:auto -->' || chr(10) || '- governs: [[' || coalesce(regexp_replace(n.path, '\\.md$', ''), r.target) || ']]' || chr(10) || '<!-- /links:auto -->' AS links FROM r LEFT JOIN nodes n ON n.id = r.target
UNION ALL SELECT id, '<!-- links:auto -->' || chr(10) || '<!-- /links:auto -->' FROM nodes WHERE type = 'agent_todo'
UNION ALL SELECT id, '<!-- links:auto -->' || chr(10) || CASE WHEN len(concepts) > 0 THEN array_to_string(['- concept: [[wiki/concepts/' || c || ']]' for c in concepts], chr(10)) || chr(10) ELSE '' END || '<!-- /links:auto -->' FROM nodes WHERE type = 'research_question'""",
)
def node_links_sections(spark: SparkSession, folder: str) -> DataFrame:
    found = nodes(spark, folder)
    return obj.links_sections(found).join(
        found.where(F.col("type").isin("decision", "agent_todo", "research_question")).select("id"), "id", "left_semi"
    )


@query(
    "linkified_nodes",
    f"""{CTE} SELECT n.id AS key, md5(CASE WHEN q.id IS NOT NULL THEN replace(replace(replace(n.body, '[[Q-0005]]', '@@'), printf('Q-%04d', n.doc_id % 50), '[[' || regexp_replace(q.path, '\\.md$', '') || ']]'), '@@', '[[Q-0005]]') ELSE n.body END) AS digest
FROM nodes n LEFT JOIN nodes q ON q.id = printf('Q-%04d', n.doc_id % 50)""",
)
def linkified_nodes(spark: SparkSession, folder: str) -> DataFrame:
    found = nodes(spark, folder)
    texts = found.select(F.col("id").alias("key"), F.col("body").alias("text"))
    return obj.linkified(texts, obj.id_paths(found)).select("key", F.md5("text").alias("digest"))


@query(
    "relinked_nodes",
    f"""{CTE} SELECT id, CASE WHEN type IN ('research_question', 'decision') THEN 'USER' WHEN doc_id % 2 = 0 THEN 'wiki' ELSE 'research' END AS written_by,
 md5('<!-- links:auto -->' || chr(10) || '<!-- /links:auto -->' || chr(10) || body) AS digest, doc_id % 2 = 0 AS had_generated_by FROM nodes""",
)
def relinked_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """Provenance and links block of every node page."""
    writer = obj.written_by(F.col("type"), F.col("written_by"), F.col("generated_by"))
    found = nodes(spark, folder)
    empty = F.lit(f"{obj.LINKS_START}\n{obj.LINKS_END}")
    return found.select(
        "id", writer.alias("written_by"), F.md5(obj.with_links_block(F.col("body"), empty)).alias("digest"),
        (F.col("generated_by") != "").alias("had_generated_by"),
    )


@query(
    "relinked_headers",
    f"""{CTE}, raw AS (SELECT doc_id, ['Q', 'DIR', 'QP', 'D', 'TODO'][1 + doc_id % 5] || '-' || printf('%04d', doc_id) AS id FROM documents)
SELECT id, true AS has_writer, false AS has_generated FROM raw""",
)
def relinked_headers(spark: SparkSession, folder: str) -> DataFrame:
    pages = objective_pages(spark, folder)
    new = fm.rewrite("text", {"written_by": F.lit("wiki"), "generated_by": None})
    return pages.select(fm.scalar(new, "id").alias("id"), (fm.scalar(new, "written_by") == "wiki").alias("has_writer"), F.contains(fm.block(new), F.lit("generated_by")).alias("has_generated"))


STALE_SQL = """
q AS (SELECT id, solved = 'yes' AS is_solved FROM nodes WHERE type = 'research_question'),
sv AS (SELECT id, unnest(served) AS s, unnest(range(len(served))) AS pos FROM nodes WHERE type = 'direction' AND status <> 'superseded'),
st AS (SELECT sv.*, q.is_solved, row_number() OVER (PARTITION BY sv.id ORDER BY pos) AS rn FROM sv LEFT JOIN q ON q.id = sv.s WHERE q.id IS NULL OR q.is_solved),
stale AS (SELECT CASE WHEN is_solved THEN 'stale-solved' ELSE 'stale-orphan' END AS kind, id, s AS other, NULL::DOUBLE AS overlap FROM st WHERE rn = 1)"""


@query("stale_directions", f"{CTE}, {STALE_SQL} SELECT * FROM stale")
def stale_directions(spark: SparkSession, folder: str) -> DataFrame:
    return obj.stale_directions(nodes(spark, folder))


@query("unlinked_questions", f"{CTE} SELECT 'no-linked-concept' AS kind, id, NULL::VARCHAR AS other, NULL::DOUBLE AS overlap FROM nodes WHERE type = 'research_question' AND len(concepts) = 0")
def unlinked_questions(spark: SparkSession, folder: str) -> DataFrame:
    return obj.unlinked_questions(nodes(spark, folder))


# every second document is taken as a proposal and as a question, so copies meet
PAIRS_SQL = f"""
props AS (SELECT doc_id, printf('QP-%08d', doc_id) AS id, list_sort({fr.overlap_terms('text')}) AS ts FROM documents WHERE doc_id % 2 = 0),
ques AS (SELECT doc_id, printf('Q-%08d', doc_id) AS id, list_sort({fr.overlap_terms('text')}) AS ts FROM documents WHERE doc_id % 2 = 1),
psets AS (SELECT min(id) AS sid, ts FROM props GROUP BY ts), qsets AS (SELECT min(id) AS sid, ts FROM ques GROUP BY ts),
pt AS (SELECT sid, len(ts) AS n, unnest(ts) AS t FROM psets), qt AS (SELECT sid, len(ts) AS n, unnest(ts) AS t FROM qsets),
pp AS (SELECT a.sid AS l, b.sid AS r, count(*) / (any_value(a.n) + any_value(b.n) - count(*))::DOUBLE AS j FROM pt a JOIN pt b ON a.t = b.t AND a.sid < b.sid GROUP BY ALL),
pq AS (SELECT a.sid AS l, b.sid AS r, count(*) / (any_value(a.n) + any_value(b.n) - count(*))::DOUBLE AS j FROM pt a JOIN qt b ON a.t = b.t GROUP BY ALL
  UNION ALL SELECT a.sid, b.sid, 1.0 FROM psets a JOIN qsets b ON len(a.ts) = 0 AND len(b.ts) = 0)"""


def pair_nodes(spark: SparkSession, folder: str) -> DataFrame:
    i = F.col("doc_id")
    proposal = i % 2 == 0
    return read_table(spark, folder, "documents").select(
        F.when(proposal, F.format_string("QP-%08d", i)).otherwise(F.format_string("Q-%08d", i)).alias("id"),
        F.when(proposal, "research_question_proposal").otherwise("research_question").alias("type"),
        F.lit("pending").alias("status"), F.lit("no").alias("solved"), F.col("text").alias("body"),
    )


@query(
    "duplicate_proposals",
    f"""WITH {PAIRS_SQL} SELECT 'duplicate-proposals' AS kind, l AS id, r AS other, round(j, 3) AS overlap FROM pp WHERE j >= 0.6
UNION ALL SELECT 'duplicate-proposals', min_id, id, 1.0 FROM (SELECT id, min(id) OVER (PARTITION BY ts) AS min_id FROM props) WHERE id <> min_id""",
)
def duplicate_proposals(spark: SparkSession, folder: str) -> DataFrame:
    return obj.duplicate_proposals(pair_nodes(spark, folder))


@query(
    "redundant_proposals",
    f"""WITH {PAIRS_SQL}, first AS (SELECT l, min(r) AS other FROM pq WHERE j >= 0.6 GROUP BY l)
SELECT 'redundant-proposal' AS kind, p.id, f.other, round(pq.j, 3) AS overlap FROM (SELECT id, min(id) OVER (PARTITION BY ts) AS sid FROM props) p JOIN first f ON f.l = p.sid JOIN pq ON pq.l = f.l AND pq.r = f.other""",
)
def redundant_proposals(spark: SparkSession, folder: str) -> DataFrame:
    return obj.redundant_proposals(pair_nodes(spark, folder))


@query(
    "resolution_actions",
    f"""{CTE}, {STALE_SQL} SELECT 'superseded' AS action, id, NULL::VARCHAR AS other FROM stale
UNION SELECT 'todo', id, NULL FROM nodes WHERE type = 'research_question' AND len(concepts) = 0""",
)
def resolution_actions(spark: SparkSession, folder: str) -> DataFrame:
    """Actions for directions and questions."""
    found = nodes(spark, folder)
    return obj.apply_resolutions(obj.stale_directions(found).unionByName(obj.unlinked_questions(found)))


@query(
    "proposal_actions",
    f"""WITH {PAIRS_SQL}, first AS (SELECT l, min(r) AS other FROM pq WHERE j >= 0.6 GROUP BY l)
SELECT 'todo' AS action, l AS id, r AS other FROM pp WHERE j >= 0.6
UNION SELECT 'todo', min_id, id FROM (SELECT id, min(id) OVER (PARTITION BY ts) AS min_id FROM props) WHERE id <> min_id
UNION SELECT 'rejected', p.id, NULL FROM (SELECT id, min(id) OVER (PARTITION BY ts) AS sid FROM props) p JOIN first f ON f.l = p.sid""",
)
def proposal_actions(spark: SparkSession, folder: str) -> DataFrame:
    """Duplicate proposals become tasks and stay; redundant ones are rejected."""
    found = pair_nodes(spark, folder)
    return obj.apply_resolutions(obj.duplicate_proposals(found).unionByName(obj.redundant_proposals(found)))


@query(
    "questions_from_proposals",
    f"""{CTE} SELECT id, priority, array_to_string(['[[wiki/concepts/' || c || ']]' for c in concepts], ', ') AS related, 'no' AS solved FROM nodes WHERE type = 'research_question_proposal' AND status = 'approved'""",
)
def questions_from_proposals(spark: SparkSession, folder: str) -> DataFrame:
    return obj.proposal_questions(nodes(spark, folder))


@query(
    "next_id_counters",
    """SELECT o_orderkey, o_custkey + 1 AS research_question, o_custkey % 7 AS direction FROM orders""",
)
def next_id_counters(spark: SparkSession, folder: str) -> DataFrame:
    text = F.concat(
        F.lit("---\ntype: index\nnext_id:\n  research_question: "), F.col("o_custkey") + 1, F.lit("\n  direction: "), F.col("o_custkey") % 7,
        F.lit("\nai-first: true\n---\nbody\n"),
    )
    read = read_table(spark, folder, "orders").select("o_orderkey", fm.next_id_counters(text).alias("c"))
    return read.select("o_orderkey", F.col("c")["research_question"].alias("research_question"), F.col("c")["direction"].alias("direction"))


@query(
    "link_lists",
    r"""SELECT o_orderkey, 'a ' || o_custkey || '|b' AS inline_items, 'x' || o_custkey || '|y' AS quoted_items, 'kv-' || o_custkey || '|moe' AS slugs, 'Q-0001|D-0002' AS ids FROM orders""",
)
def link_lists(spark: SparkSession, folder: str) -> DataFrame:
    c = F.col("o_custkey")
    return read_table(spark, folder, "orders").select(
        "o_orderkey",
        F.array_join(prose.inline_list(F.concat(F.lit("[a "), c, F.lit(", b, ]"))), "|").alias("inline_items"),
        F.array_join(prose.quoted_list(F.concat(F.lit("['x"), c, F.lit("', \"y\"]"))), "|").alias("quoted_items"),
        F.array_join(
            prose.concept_slugs(F.concat(F.lit("[[wiki/concepts/kv-"), c, F.lit("|K]] [[concepts/moe#a]] [[concepts/moe]]"))), "|"
        ).alias("slugs"),
        F.array_join(prose.ids_in_text(F.lit("Q-0001, D-0002 and Q-0001 TBD-0003"), prose.NODE_ID_PATTERN), "|").alias("ids"),
    )
