"""Source ledger: one row per source id and its status transitions.

Every transition is a keyed join of the stored rows with a change set; the
result is the whole new ledger, ready to replace the old table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions import identity
from marginalia.functions.basics import blank_to_null, present, strip
from marginalia.functions.scoring import STATUS_RANK, rank_of

# Ledger columns with their defaults and the status sets.
LEDGER_DEFAULTS = {
    "id": ("string", ""), "id_type": ("string", ""), "status": ("string", "pending"), "title": ("string", ""),
    "filename": ("string", ""), "url": ("string", ""), "source_type": ("string", ""), "content_hash": ("string", ""),
    "first_seen": ("string", None), "ingested_at": ("string", None), "source_page": ("string", ""),
    "relevance_score": ("double", None), "rationale": ("string", ""), "discovered_by": ("string", ""),
    "objective_ids": ("array<string>", []), "proposed_at": ("string", None), "rejected_at": ("string", None),
    "rejection_reason": ("string", ""), "published": ("string", None), "source_id": ("string", ""), "engine": ("string", ""),
}
NO_FILE_STATUSES = ["deleted", "waiting_approval", "rejected"]
SCAN_SUFFIXES = [
    ".md", ".markdown", ".txt", ".pdf", ".docx", ".csv", ".epub", ".mp3", ".m4a", ".wav", ".ogg", ".webm", ".mp4",
    ".png", ".jpg", ".jpeg", ".gif", ".webp",
]
# End of the fixed values.


def default_of(name: str) -> Column:
    kind, value = LEDGER_DEFAULTS[name]
    if kind.startswith("array"):
        return F.expr(f"cast(array() as {kind})")
    return F.lit(value).cast(kind)


def migrate(rows: DataFrame) -> DataFrame:
    """Adds absent columns and fills nulls with defaults; stored values stay."""
    out = [
        F.coalesce(F.col(name).cast(kind), default_of(name)).alias(name) if name in rows.columns else default_of(name).alias(name)
        for name, (kind, _) in LEDGER_DEFAULTS.items()
    ]
    return rows.select(*out)


def scan_reconcile(ledger: DataFrame, files: DataFrame, now: Column) -> DataFrame:
    """Ledger after a scan of ``files(id, id_type, title, path, url, source_type, content_hash)``.

    New ids are registered, known ones take the file's place and hash, returned
    ones wait again, and rows whose file is gone are marked unless they never
    had one. ``change`` tells what happened.
    """
    latest = files.groupBy(F.col("id").alias("f_id")).agg(
        F.max_by(F.struct(*[c for c in files.columns if c != "id"]), F.col("path")).alias("f"),
        F.min_by(F.struct("title", "url", "source_type"), F.col("path")).alias("first"),
    )
    old = ledger.select(F.struct(*ledger.columns).alias("o"), F.col("id").alias("o_id"))
    both = old.join(latest, F.col("o_id") == F.col("f_id"), "full")
    known, present = F.col("o_id").isNotNull(), F.col("f_id").isNotNull()
    vanished = known & ~present & ~F.col("o.status").isin(*NO_FILE_STATUSES)
    status = (
        F.when(~known, F.lit("pending"))
        .when(present & (F.col("o.status") == "deleted"), F.lit("pending"))
        .when(vanished, F.lit("deleted"))
        .otherwise(F.col("o.status"))
    )
    change = (
        F.when(~known, F.lit("added"))
        .when(present & (F.col("o.status") == "deleted"), F.lit("returned"))
        .when(vanished, F.lit("deleted"))
        .when(present & (F.col("o.filename") != F.col("f.path")), F.lit("renamed"))
        .otherwise(F.lit("kept"))
    )
    special = {
        "id": F.coalesce("o_id", "f_id"),
        "status": status,
        "id_type": F.coalesce("o.id_type", "f.id_type"),
        "title": F.when(known, F.col("o.title")).otherwise(F.col("first.title")),
        "filename": F.coalesce("f.path", "o.filename"),
        "content_hash": F.coalesce("f.content_hash", "o.content_hash"),
        "url": F.coalesce(blank_to_null(F.col("o.url")), F.col("f.url"), F.lit("")),
        "source_type": F.when(known, F.col("o.source_type")).otherwise(F.col("first.source_type")),
        "first_seen": F.when(known, F.col("o.first_seen")).otherwise(now),
    }
    columns = [
        special.get(c, F.when(known, F.col(f"o.{c}")).otherwise(default_of(c))).alias(c) for c in ledger.columns
    ]
    return both.select(*columns, change.alias("change"))


def scan_summary(scanned: DataFrame) -> DataFrame:
    return scanned.agg(
        F.count_if(F.col("change") == "added").alias("added"),
        F.count_if(F.col("change") == "deleted").alias("deleted"),
        F.count(F.lit(1)).alias("total"),
    )


def pending_files(ledger: DataFrame, files: DataFrame) -> DataFrame:
    """Files that are new, not ingested or changed; first path of every id."""
    first = files.groupBy("id").agg(F.min_by(F.struct("path", "content_hash"), F.col("path")).alias("f"))
    known = ledger.select("id", "status", F.col("content_hash").alias("stored_hash"))
    joined = first.join(known, "id", "left")
    done = (F.col("status") == "ingested") & F.col("stored_hash").eqNullSafe(F.col("f.content_hash"))
    return joined.where(~F.coalesce(done, F.lit(False))).select("id", F.col("f.path").alias("path"))


def enqueue(ledger: DataFrame, proposals: DataFrame, now: Column) -> DataFrame:
    """Ledger after ``proposals`` (one row per proposed id, already normalised).

    A rejected row never changes; any other known row takes new metadata but
    keeps its status; unknown ids wait for approval.
    """
    new = proposals.select(F.struct(*proposals.columns).alias("p"), F.col("id").alias("p_id"))
    old = ledger.select(F.struct(*ledger.columns).alias("o"), F.col("id").alias("o_id"))
    both = old.join(new, F.col("o_id") == F.col("p_id"), "full")
    known = F.col("o_id").isNotNull()
    frozen = known & (F.col("p_id").isNull() | (F.col("o.status") == "rejected"))

    def given(name: str) -> Column:
        return blank_to_null(F.col(f"p.{name}")) if name in proposals.columns else F.lit(None).cast("string")

    fresh = {
        "id": F.col("p_id"), "id_type": F.col("p.id_type"), "status": F.lit("waiting_approval"),
        "source_type": F.col("p.id_type"), "first_seen": now, "proposed_at": now,
    }
    updated = {
        "title": F.coalesce(given("title"), F.col("o.title"), F.lit("")),
        "rationale": F.coalesce(given("rationale"), F.col("o.rationale"), F.lit("")),
        "relevance_score": F.coalesce(F.col("p.relevance_score"), F.col("o.relevance_score")),
        "discovered_by": F.coalesce(given("discovered_by"), F.col("o.discovered_by"), F.lit("")),
        "objective_ids": F.array_union(
            F.coalesce("o.objective_ids", default_of("objective_ids")), F.coalesce("p.objective_ids", default_of("objective_ids"))
        ),
        "url": F.coalesce(blank_to_null(F.col("o.url")), given("url"), F.lit("")),
        "published": F.coalesce(F.col("p.published"), F.col("o.published")),
        "source_id": F.coalesce(given("source_id"), F.col("o.source_id"), F.lit("")),
        "engine": F.coalesce(given("engine"), F.col("o.engine"), F.lit("")),
    }

    def value(c: str) -> Column:
        if c in updated:
            return F.when(frozen, F.col(f"o.{c}")).otherwise(updated[c])
        return F.when(known, F.col(f"o.{c}")).otherwise(fresh.get(c, default_of(c)))

    return both.select(*[value(c).alias(c) for c in ledger.columns])


def normalised_proposals(raw: DataFrame) -> DataFrame:
    """``raw(ident, url, ...)`` keyed by stable id; later rows win on the same id."""
    keyed = raw.withColumn("n", identity.proposed_identity(F.col("ident")))
    rest = [c for c in raw.columns if c not in ("ident", "url")]
    return keyed.select(
        F.col("n.id").alias("id"),
        F.col("n.id_type").alias("id_type"),
        F.coalesce(blank_to_null(strip(F.col("url"))), F.col("n.url")).alias("url"),
        *rest,
    )


def decide(ledger: DataFrame, decisions: DataFrame, now: Column) -> DataFrame:
    """Ledger after ``decisions(id, action, reason)``.

    Approval moves waiting rows to pending and touches nothing else; rejection
    is final from any status.
    """
    acts = decisions.select(F.col("id").alias("d_id"), "action", "reason")
    both = ledger.join(acts, ledger["id"] == acts["d_id"], "left")
    rejected = F.coalesce(F.col("action") == "reject", F.lit(False))
    approved = F.coalesce(F.col("action") == "approve", F.lit(False)) & (F.col("status") == "waiting_approval")
    special = {
        "status": F.when(rejected, F.lit("rejected")).when(approved, F.lit("pending")).otherwise(F.col("status")),
        "rejected_at": F.when(rejected, now).otherwise(F.col("rejected_at")),
        "rejection_reason": F.when(rejected, F.coalesce("reason", F.lit(""))).otherwise(F.col("rejection_reason")),
    }
    return both.select(*[special.get(c, F.col(c)).alias(c) for c in ledger.columns])


def mark_ingested(ledger: DataFrame, marks: DataFrame, now: Column) -> DataFrame:
    """Ledger after ``marks(id, page)``: ingested, stamped, linked to its page."""
    done = marks.select(F.col("id").alias("m_id"), F.col("page"))
    both = ledger.join(done, ledger["id"] == done["m_id"], "left")
    hit = F.col("m_id").isNotNull()
    special = {
        "status": F.when(hit, F.lit("ingested")).otherwise(F.col("status")),
        "ingested_at": F.when(hit, now).otherwise(F.col("ingested_at")),
        "source_page": F.when(hit, F.coalesce(blank_to_null(F.col("page")), F.col("source_page"))).otherwise(F.col("source_page")),
    }
    return both.select(*[special.get(c, F.col(c)).alias(c) for c in ledger.columns])


def queue(ledger: DataFrame) -> DataFrame:
    waiting = ledger.where(F.col("status") == "waiting_approval")
    return waiting.orderBy(F.coalesce("proposed_at", F.lit("")), "id")


def status_counts(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("status").agg(F.count(F.lit(1)).alias("rows"))


def mirror(ledger: DataFrame) -> DataFrame:
    """Readable ledger lines by status rank and id."""
    cut = F.regexp_replace("rationale", r"\s+", " ")
    line = F.concat_ws(
        " | ", "status", "id", F.substring("title", 1, 80), "source_type", "url", F.substring(cut, 1, 120)
    )
    return ledger.select(rank_of(F.col("status"), STATUS_RANK, 9).alias("rank"), "id", line.alias("line")).orderBy("rank", "id")


def relevance_links(ledger: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(id, pos, link)`` of every objective id of a row.

    ``nodes(node_id, path)`` resolves ids to pages; gaps and objective ids
    without a page fall back to plain links.
    """
    ids = ledger.select("id", F.posexplode_outer("objective_ids").alias("pos", "oid")).where(present("pos"))
    trimmed = ids.withColumn("oid", strip("oid")).where("oid <> ''").withColumn("key", F.upper("oid"))
    known = nodes.groupBy(F.upper("node_id").alias("key")).agg(F.min("path").alias("path"))
    is_gap = F.rlike("oid", F.lit(r"(?i)^GAP-\d+$"))
    is_node = F.rlike("oid", F.lit(r"(?i)^(DIR|QP|Q|D)-\d+$"))
    link = (
        F.when((is_gap | is_node) & F.col("path").isNotNull(), F.concat(F.lit("[["), F.col("path"), F.lit("]]")))
        .when(is_gap, F.concat(F.lit("[[wiki/gap/index]] ("), F.col("key"), F.lit(")")))
        .otherwise(F.concat(F.lit("[["), F.col("oid"), F.lit("]]")))
    )
    return trimmed.join(known, "key", "left").select("id", F.col("pos").cast("bigint").alias("pos"), link.alias("link"))


def scannable(path: Column) -> Column:
    """Raw files worth a ledger row: known suffix, outside the assets folder."""
    suffix = F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))
    return suffix.isin(*SCAN_SUFFIXES) & ~F.startswith(path, F.lit("raw/assets/"))
