"""Source ledger transitions, with ``orders`` as the stored rows and files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.catalog.base import query
from marginalia.functions.basics import present
from marginalia.operators import sources_ledger as led
from marginalia.session import read_table

NOW = "2024-02-01T00:00:00"
STATUSES = ["pending", "ingested", "deleted", "waiting_approval", "rejected"]


def stored(spark: SparkSession, folder: str) -> DataFrame:
    """Two of three orders as ledger rows in an older form without the newer columns."""
    k = F.col("o_orderkey")
    rows = read_table(spark, folder, "orders").where(k % 3 != 0).select(
        F.concat(F.lit("id:o"), k).alias("id"),
        F.lit("explicit").alias("id_type"),
        F.element_at(F.array(*[F.lit(s) for s in STATUSES]), (k % 5 + 1).cast("int")).alias("status"),
        F.when(k % 4 == 0, F.concat(F.lit("note_"), k)).otherwise(F.concat(F.lit("Order number "), k)).alias("title"),
        F.when((k % 5).isin(3, 4), F.lit("")).otherwise(F.concat(F.lit("raw/notes/"), k, F.lit(".md"))).alias("filename"),
        F.when(k % 2 == 0, F.concat(F.lit("https://x.example/"), k)).otherwise(F.lit("")).alias("url"),
        F.lit("note").alias("source_type"),
        F.concat(F.lit("h"), F.floor("o_totalprice")).alias("content_hash"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("first_seen"),
        F.when(k % 5 == 1, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("ingested_at"),
        F.when(k % 5 == 3, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("proposed_at"),
    )
    return led.migrate(rows)


def files(spark: SparkSession, folder: str) -> DataFrame:
    """Three of four orders as raw files; every eighth is stored twice."""
    k = F.col("o_orderkey")
    base = read_table(spark, folder, "orders").where(k % 4 != 1)
    copies = F.when(k % 8 == 0, F.array(F.lit("notes"), F.lit("papers"))).otherwise(F.array(F.lit("notes")))
    return base.select(k.alias("k"), "o_totalprice", F.explode_outer(copies).alias("place")).where(present("place")).select(
        F.concat(F.lit("id:o"), "k").alias("id"),
        F.lit("explicit").alias("id_type"),
        F.concat(F.lit("File "), "k", F.lit(" "), "place").alias("title"),
        F.concat(F.lit("raw/"), "place", F.lit("/"), F.when(F.col("k") % 7 == 0, F.lit("moved-")).otherwise(F.lit("")), "k", F.lit(".md")).alias("path"),
        F.concat(F.lit("https://f.example/"), "k").alias("url"),
        F.regexp_replace("place", "s$", "").alias("source_type"),
        F.concat(F.lit("h"), F.floor(F.col("o_totalprice") + F.when(F.col("k") % 6 == 0, 1).otherwise(0))).alias("content_hash"),
    )


STORED_SQL = """
stored AS (
  SELECT o_orderkey AS k, 'id:o' || o_orderkey AS id, 'explicit' AS id_type,
    ['pending', 'ingested', 'deleted', 'waiting_approval', 'rejected'][1 + o_orderkey % 5] AS status,
    CASE WHEN o_orderkey % 4 = 0 THEN 'note_' || o_orderkey ELSE 'Order number ' || o_orderkey END AS title,
    CASE WHEN o_orderkey % 5 IN (3, 4) THEN '' ELSE 'raw/notes/' || o_orderkey || '.md' END AS filename,
    CASE WHEN o_orderkey % 2 = 0 THEN 'https://x.example/' || o_orderkey ELSE '' END AS url,
    'note' AS source_type, 'h' || cast(floor(o_totalprice) AS bigint) AS content_hash,
    strftime(o_orderdate, '%Y-%m-%d') AS first_seen,
    CASE WHEN o_orderkey % 5 = 1 THEN strftime(o_orderdate, '%Y-%m-%d') END AS ingested_at,
    CASE WHEN o_orderkey % 5 = 3 THEN strftime(o_orderdate, '%Y-%m-%d') END AS proposed_at
  FROM orders WHERE o_orderkey % 3 <> 0)"""
FILES_SQL = """
files AS (
  SELECT o_orderkey AS k, 'id:o' || o_orderkey AS id, 'File ' || o_orderkey || ' ' || place AS title,
    'raw/' || place || '/' || CASE WHEN o_orderkey % 7 = 0 THEN 'moved-' ELSE '' END || o_orderkey || '.md' AS path,
    'https://f.example/' || o_orderkey AS url, regexp_replace(place, 's$', '') AS source_type,
    'h' || cast(floor(o_totalprice + CASE WHEN o_orderkey % 6 = 0 THEN 1 ELSE 0 END) AS bigint) AS content_hash
  FROM (SELECT *, unnest(CASE WHEN o_orderkey % 8 = 0 THEN ['notes', 'papers'] ELSE ['notes'] END) AS place FROM orders WHERE o_orderkey % 4 <> 1)),
last_file AS (SELECT DISTINCT ON (k) * FROM files ORDER BY k, path DESC),
first_file AS (SELECT DISTINCT ON (k) * FROM files ORDER BY k, path)"""
CTE = f"WITH {STORED_SQL}, {FILES_SQL}"
SCAN_SQL = f"""
scanned AS (
  SELECT coalesce(s.id, l.id) AS id,
   CASE WHEN s.k IS NULL THEN 'pending' WHEN l.k IS NOT NULL AND s.status = 'deleted' THEN 'pending'
        WHEN l.k IS NULL AND s.status NOT IN ('deleted', 'waiting_approval', 'rejected') THEN 'deleted' ELSE s.status END AS status,
   CASE WHEN s.k IS NULL THEN f.title ELSE s.title END AS title, coalesce(l.path, s.filename) AS filename,
   coalesce(nullif(s.url, ''), l.url, '') AS url, CASE WHEN s.k IS NULL THEN f.source_type ELSE s.source_type END AS source_type,
   coalesce(l.content_hash, s.content_hash) AS content_hash, CASE WHEN s.k IS NULL THEN '{NOW}' ELSE s.first_seen END AS first_seen,
   CASE WHEN s.k IS NULL THEN 'added' WHEN l.k IS NOT NULL AND s.status = 'deleted' THEN 'returned'
        WHEN l.k IS NULL AND s.status NOT IN ('deleted', 'waiting_approval', 'rejected') THEN 'deleted'
        WHEN l.k IS NOT NULL AND s.filename <> l.path THEN 'renamed' ELSE 'kept' END AS change
  FROM stored s FULL JOIN last_file l USING (k) LEFT JOIN first_file f USING (k))"""


@query("ledger_scan", f"{CTE}, {SCAN_SQL} SELECT * FROM scanned")
def ledger_scan(spark: SparkSession, folder: str) -> DataFrame:
    scanned = led.scan_reconcile(stored(spark, folder), files(spark, folder), F.lit(NOW))
    return scanned.select("id", "status", "title", "filename", "url", "source_type", "content_hash", "first_seen", "change")


@query(
    "ledger_scan_summary",
    f"{CTE}, {SCAN_SQL} SELECT count(CASE WHEN change = 'added' THEN 1 END) AS added, count(CASE WHEN change = 'deleted' THEN 1 END) AS deleted, count(*) AS total FROM scanned",
)
def ledger_scan_summary(spark: SparkSession, folder: str) -> DataFrame:
    return led.scan_summary(led.scan_reconcile(stored(spark, folder), files(spark, folder), F.lit(NOW)))


@query(
    "pending_files",
    f"""{CTE} SELECT f.id, f.path FROM first_file f LEFT JOIN stored s USING (k)
WHERE s.k IS NULL OR s.status <> 'ingested' OR s.content_hash <> f.content_hash""",
)
def pending_files(spark: SparkSession, folder: str) -> DataFrame:
    return led.pending_files(stored(spark, folder), files(spark, folder))


def proposals(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("o_orderkey")
    raw = read_table(spark, folder, "orders").where(k % 2 == 0).select(
        F.concat(F.lit("id:o"), k).alias("ident"),
        F.when(k % 4 == 0, F.concat(F.lit(" https://p.example/"), k, F.lit(" "))).otherwise(F.lit("")).alias("url"),
        F.when(k % 6 == 0, F.lit("")).otherwise(F.concat(F.lit("Proposed "), k)).alias("title"),
        F.concat(F.lit("because "), "o_orderpriority").alias("rationale"),
        F.when(k % 10 == 0, F.lit(None).cast("double")).otherwise(F.round(F.col("o_totalprice") / 1000, 3)).alias("relevance_score"),
        F.lit("web").alias("discovered_by"),
        F.array(F.format_string("GAP-%02d", k % 9), F.lit("Q-0001")).alias("objective_ids"),
        F.when(k % 3 == 0, F.lit("2024-01-02")).alias("published"),
        F.lit("feed").alias("source_id"),
        F.lit("").alias("engine"),
    )
    return led.normalised_proposals(raw)


@query(
    "ledger_enqueue",
    f"""{CTE}, p AS (
  SELECT o_orderkey AS k, 'id:o' || o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN 'https://p.example/' || o_orderkey ELSE '' END AS url,
   CASE WHEN o_orderkey % 6 = 0 THEN '' ELSE 'Proposed ' || o_orderkey END AS title, 'because ' || o_orderpriority AS rationale,
   CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE round(o_totalprice / 1000, 3) END AS score,
   printf('GAP-%02d', o_orderkey % 9) || ',Q-0001' AS oids, CASE WHEN o_orderkey % 3 = 0 THEN '2024-01-02' END AS published
  FROM orders WHERE o_orderkey % 2 = 0),
j AS (SELECT s.k IS NOT NULL AS known, s.k IS NOT NULL AND (p.k IS NULL OR s.status = 'rejected') AS frozen,
        s.id AS s_id, p.id AS p_id, s.status AS s_status, s.title AS s_title, p.title AS p_title, s.url AS s_url, p.url AS p_url,
        p.rationale, p.score, p.oids, p.published, s.proposed_at FROM stored s FULL JOIN p USING (k))
SELECT coalesce(s_id, p_id) AS id, CASE WHEN known THEN s_status ELSE 'waiting_approval' END AS status,
  CASE WHEN frozen THEN s_title ELSE coalesce(nullif(p_title, ''), s_title, '') END AS title,
  CASE WHEN frozen THEN s_url ELSE coalesce(nullif(s_url, ''), nullif(p_url, ''), '') END AS url,
  CASE WHEN frozen THEN '' ELSE rationale END AS rationale, CASE WHEN frozen THEN NULL ELSE score END AS relevance_score,
  CASE WHEN frozen THEN '' ELSE oids END AS objective_ids, CASE WHEN frozen THEN NULL ELSE published END AS published,
  CASE WHEN known THEN proposed_at ELSE '{NOW}' END AS proposed_at
FROM j""",
)
def ledger_enqueue(spark: SparkSession, folder: str) -> DataFrame:
    after = led.enqueue(stored(spark, folder), proposals(spark, folder), F.lit(NOW))
    return after.select(
        "id", "status", "title", "url", "rationale", "relevance_score", F.array_join("objective_ids", ",").alias("objective_ids"),
        "published", "proposed_at",
    )


@query(
    "ledger_decide",
    f"""{CTE}, d AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 = 0 THEN 'reject' ELSE 'approve' END AS action, 'dull ' || o_orderkey AS reason FROM orders WHERE o_orderkey % 7 IN (0, 1, 2))
SELECT s.id, CASE WHEN action = 'reject' THEN 'rejected' WHEN action = 'approve' AND status = 'waiting_approval' THEN 'pending' ELSE status END AS status,
  CASE WHEN action = 'reject' THEN '{NOW}' END AS rejected_at, CASE WHEN action = 'reject' THEN reason ELSE '' END AS rejection_reason
FROM stored s LEFT JOIN d USING (k)""",
)
def ledger_decide(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("o_orderkey")
    acts = read_table(spark, folder, "orders").where((k % 7).isin(0, 1, 2)).select(
        F.concat(F.lit("id:o"), k).alias("id"), F.when(k % 7 == 0, "reject").otherwise("approve").alias("action"),
        F.concat(F.lit("dull "), k).alias("reason"),
    )
    return led.decide(stored(spark, folder), acts, F.lit(NOW)).select("id", "status", "rejected_at", "rejection_reason")


@query(
    "ledger_mark",
    f"""{CTE} SELECT id, CASE WHEN k % 9 = 0 THEN 'ingested' ELSE status END AS status, CASE WHEN k % 9 = 0 THEN '{NOW}' ELSE ingested_at END AS ingested_at,
 CASE WHEN k % 9 = 0 AND k % 2 = 0 THEN 'wiki/sources/' || k || '.md' ELSE '' END AS source_page FROM
 (SELECT * FROM stored UNION ALL BY NAME SELECT * FROM stored WHERE false)""",
)
def ledger_mark(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("o_orderkey")
    marks = read_table(spark, folder, "orders").where(k % 9 == 0).select(
        F.concat(F.lit("id:o"), k).alias("id"),
        F.when(k % 2 == 0, F.concat(F.lit("wiki/sources/"), k, F.lit(".md"))).otherwise(F.lit("")).alias("page"),
    )
    after = led.mark_ingested(stored(spark, folder), marks, F.lit(NOW))
    return after.select("id", "status", "ingested_at", "source_page")


@query("ledger_queue", f"{CTE} SELECT id, proposed_at FROM stored WHERE status = 'waiting_approval'")
def ledger_queue(spark: SparkSession, folder: str) -> DataFrame:
    return led.queue(stored(spark, folder)).select("id", "proposed_at")


@query("ledger_status_counts", f"{CTE} SELECT status, count(*) AS rows FROM stored GROUP BY status")
def ledger_status_counts(spark: SparkSession, folder: str) -> DataFrame:
    return led.status_counts(stored(spark, folder))


@query(
    "ledger_mirror",
    f"""{CTE} SELECT CASE status WHEN 'pending' THEN 0 WHEN 'waiting_approval' THEN 1 WHEN 'ingested' THEN 2 WHEN 'rejected' THEN 3 ELSE 4 END AS rank, id,
 status || ' | ' || id || ' | ' || left(title, 80) || ' | ' || source_type || ' | ' || url || ' | ' AS line FROM stored""",
)
def ledger_mirror(spark: SparkSession, folder: str) -> DataFrame:
    return led.mirror(stored(spark, folder))


@query(
    "ledger_titles",
    f"""{CTE} SELECT id, CASE WHEN k % 4 <> 0 THEN title WHEN k % 8 = 0 THEN 'Page of ' || k WHEN k % 12 = 0 THEN 'File of ' || k ELSE title END AS best_title FROM stored""",
)
def ledger_titles(spark: SparkSession, folder: str) -> DataFrame:
    from marginalia.operators.harvest import title_or_stem

    k = F.regexp_extract("id", r"(\d+)$", 1).cast("bigint")
    page = F.when(k % 8 == 0, F.concat(F.lit("Page of "), k)).otherwise(F.concat(F.lit("p_"), k))
    file = F.when(k % 12 == 0, F.concat(F.lit("File of "), k)).otherwise(F.lit(""))
    return stored(spark, folder).select("id", title_or_stem(F.col("title"), page, file).alias("best_title"))


@query(
    "ledger_relevance_links",
    f"""{CTE}, o AS (SELECT id, k, unnest([printf('GAP-%02d', k % 9), printf('q-%04d', k % 50), ' free ']) AS oid, unnest([0, 1, 2]) AS pos FROM stored),
n AS (SELECT DISTINCT printf('GAP-%02d', c_custkey % 5) AS node_id, printf('wiki/gap/GAP-%02d-x', c_custkey % 5) AS path FROM customer
      UNION SELECT DISTINCT printf('Q-%04d', c_custkey % 20), printf('objective/research_question/Q-%04d-y', c_custkey % 20) FROM customer)
SELECT id, cast(pos AS bigint) AS pos, CASE WHEN n.path IS NOT NULL THEN '[[' || n.path || ']]' WHEN pos = 0 THEN '[[wiki/gap/index]] (' || oid || ')' ELSE '[[' || trim(oid) || ']]' END AS link
FROM o LEFT JOIN n ON n.node_id = upper(trim(oid))""",
)
def ledger_relevance_links(spark: SparkSession, folder: str) -> DataFrame:
    k = F.regexp_extract("id", r"(\d+)$", 1).cast("bigint")
    rows = stored(spark, folder).withColumn(
        "objective_ids", F.array(F.format_string("GAP-%02d", k % 9), F.format_string("q-%04d", k % 50), F.lit(" free "))
    )
    c = F.col("c_custkey")
    customers = read_table(spark, folder, "customer")
    nodes = customers.select(
        F.format_string("GAP-%02d", c % 5).alias("node_id"), F.format_string("wiki/gap/GAP-%02d-x", c % 5).alias("path")
    ).unionByName(
        customers.select(
            F.format_string("Q-%04d", c % 20).alias("node_id"),
            F.format_string("objective/research_question/Q-%04d-y", c % 20).alias("path"),
        )
    )
    return led.relevance_links(rows, nodes)


@query(
    "raw_file_scan",
    r"""WITH f AS (SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN 'raw/assets/a' WHEN 1 THEN 'raw/papers/p' ELSE 'raw/notes/n' END || o_orderkey || ['.md', '.PDF', '.exe', '.txt', ''][1 + o_orderkey % 5] AS path FROM orders)
SELECT path FROM f WHERE k % 4 <> 0 AND k % 5 NOT IN (2, 4)""",
)
def raw_file_scan(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("o_orderkey")
    place = F.when(k % 4 == 0, "raw/assets/a").when(k % 4 == 1, "raw/papers/p").otherwise("raw/notes/n")
    suffix = F.element_at(F.array(*[F.lit(s) for s in (".md", ".PDF", ".exe", ".txt", "")]), (k % 5 + 1).cast("int"))
    return read_table(spark, folder, "orders").select(F.concat(place, k, suffix).alias("path")).where(led.scannable(F.col("path")))


@query(
    "raw_file_metadata",
    r"""SELECT 'raw/notes/' || doc_id || '.md' AS path, CASE WHEN doc_id % 3 = 0 THEN 'doi:10.1/x' || doc_id WHEN doc_id % 3 = 1 THEN 'id:n' || doc_id ELSE h END AS id,
  CASE WHEN doc_id % 3 = 0 THEN 'doi' WHEN doc_id % 3 = 1 THEN 'explicit' ELSE 'hash' END AS id_type, '' AS url,
  CASE WHEN doc_id % 2 = 0 THEN 'Title ' || doc_id ELSE cast(doc_id AS varchar) END AS title, 'note' AS source_type, h AS content_hash
FROM (SELECT *, 'sha256:' || left(sha256(raw), 16) AS h FROM (SELECT doc_id, '---' || chr(10) || CASE doc_id % 3 WHEN 0 THEN 'doi: 10.1/X' || doc_id || chr(10) WHEN 1 THEN 'id: n' || doc_id || chr(10) ELSE 'x: y' || chr(10) END
  || CASE WHEN doc_id % 2 = 0 THEN 'title: "Title ' || doc_id || '"' || chr(10) ELSE '' END || '---' || chr(10) || text AS raw FROM documents))""",
)
def raw_file_metadata(spark: SparkSession, folder: str) -> DataFrame:
    from marginalia.operators.stats import raw_file_metadata as metadata

    i = F.col("doc_id")
    head = (
        F.when(i % 3 == 0, F.concat(F.lit("doi: 10.1/X"), i, F.lit("\n"))).when(i % 3 == 1, F.concat(F.lit("id: n"), i, F.lit("\n")))
        .otherwise(F.lit("x: y\n"))
    )
    title = F.when(i % 2 == 0, F.concat(F.lit('title: "Title '), i, F.lit('"\n'))).otherwise(F.lit(""))
    found = read_table(spark, folder, "documents").select(
        F.concat(F.lit("raw/notes/"), i, F.lit(".md")).alias("path"), F.concat(F.lit("---\n"), head, title, F.lit("---\n"), "text").alias("text")
    )
    return metadata(found)
