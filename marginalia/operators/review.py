"""Checkbox reports: candidate blocks, decisions and the deferred backlog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions import frontmatter as fm
from marginalia.functions import identity
from marginalia.functions.basics import all_matches, bind, first_match, lines_of, present, strip

# Line formats of a report.
BOX = r"(?i)^\s*-\s+\[([x ])\]\s+(approve|reject)\s+[·.]\s+`([^`]+)`"
TICKED = r"(?i)^\s*-\s+\[x\]\s+(?:approve|reject)\s+[·.]\s+`[^`]+`"
UNTICKED = r"^\s*-\s+\[ \]"
REASON = r"(?i)^\s*-\s+reason:\s*(.*)"
URL_BULLET = r"(?im)^(\s*-\s+\*\*url\*\*:\s*.+)$"
SEARCH_DATE = r"(?m)^\s*-\s+\*\*search-date\*\*:\s*(.+)$"
TRACE = r"(?im)^##\s+decision\s+trace(?s:.*)\z"
# End of the fixed values.


def blocks(reports: DataFrame, trace_ends: bool = True) -> DataFrame:
    """``(report_id, block_no, block)``: each ``### `` block of ``reports(report_id, text)``.

    Text before the first heading forms one more block that counts last.
    """
    text = F.col("text")
    if trace_ends:
        text = F.regexp_replace(text, TRACE, "")
    pieces = F.split(F.concat(F.lit("\n"), text), r"\n(?=###\s)")
    numbered = reports.select("report_id", F.posexplode_outer(pieces).alias("pos", "block")).where(present("pos"))
    is_block = F.rlike("block", F.lit(r"^###\s"))
    return numbered.select(
        "report_id", F.when(is_block, F.col("pos")).otherwise(F.lit(1 << 30)).alias("block_no"), "block"
    )


def _reason_below(lines: Column, i: Column) -> Column:
    """Reason line below a ticked reject, unless a box or heading comes first."""
    rest = F.slice(lines, i + 2, F.greatest(F.size(lines) - i - 1, F.lit(0)))
    marks = F.filter(
        rest,
        lambda x: F.rlike(x, F.lit(REASON)) | F.rlike(x, F.lit(TICKED)) | F.rlike(x, F.lit(UNTICKED)) | F.startswith(x, F.lit("#")),
    )
    return strip(F.coalesce(F.regexp_extract(F.get(marks, F.lit(0)), REASON, 1), F.lit("")))


def boxes(found: DataFrame) -> DataFrame:
    """One row per checkbox line: ``(report_id, block_no, line_no, id, action, ticked, reason)``."""
    def of(lines: Column) -> Column:
        return F.filter(
            F.transform(
                lines,
                lambda x, i: F.when(
                    F.rlike(x, F.lit(BOX)),
                    F.struct(
                        i.alias("line_no"),
                        strip(F.regexp_extract(x, BOX, 3)).alias("id"),
                        F.lower(F.regexp_extract(x, BOX, 2)).alias("action"),
                        (F.lower(F.regexp_extract(x, BOX, 1)) == "x").alias("ticked"),
                        _reason_below(lines, i).alias("reason"),
                    ),
                ),
            ),
            lambda b: b.isNotNull(),
        )

    return found.select("report_id", "block_no", F.explode_outer(bind(lines_of("block"), of)).alias("b")).where(present("b")).select(
        "report_id", "block_no", "b.*"
    )


def candidates(reports: DataFrame) -> DataFrame:
    """``(report_id, id, action, reason)`` with one action per id; a later block wins."""
    marks = boxes(blocks(reports))
    rejects = F.col("ticked") & (F.col("action") == "reject")
    per_block = marks.groupBy("report_id", "id", "block_no").agg(
        F.max(F.col("ticked") & (F.col("action") == "approve")).alias("approved"),
        F.max(rejects).alias("rejected"),
        F.max_by(F.when(rejects, F.col("reason")), F.when(rejects, F.col("line_no"))).alias("reason"),
    )
    action = (
        F.when(F.col("approved") & F.col("rejected"), "conflict")
        .when(F.col("approved"), "approve")
        .when(F.col("rejected"), "reject")
        .otherwise("deferred")
    )
    return per_block.groupBy("report_id", "id").agg(
        F.max_by(F.struct(action.alias("action"), F.coalesce("reason", F.lit("")).alias("reason")), F.col("block_no")).alias("last")
    ).select("report_id", "id", "last.action", "last.reason")


def decisions(reports: DataFrame) -> DataFrame:
    return candidates(reports).where(F.col("action") != "deferred")


def routed(found: DataFrame, ledger: DataFrame, backlog: DataFrame) -> DataFrame:
    """Adds ``outcome``: approved, rejected, conflict, blocked, deferred or backlogged.

    An approval needs a ledger row with a working address. A deferred id enters
    the backlog once.
    """
    rows = ledger.select(F.col("id").alias("l_id"), "url")
    waiting = backlog.select(F.col("id").alias("b_id")).distinct()
    both = found.join(rows, found["id"] == rows["l_id"], "left").join(waiting, found["id"] == waiting["b_id"], "left")
    outcome = (
        F.when(F.col("action") == "conflict", "conflict")
        .when(F.col("action") == "reject", "rejected")
        .when((F.col("action") == "deferred") & F.col("b_id").isNull(), "backlogged")
        .when(F.col("action") == "deferred", "deferred")
        .when(identity.valid_url(F.col("url")), "approved")
        .otherwise("blocked")
    )
    return both.select(*found.columns, outcome.alias("outcome"))


def backlog_blocks(reports: DataFrame, day: Column) -> DataFrame:
    """Blocks to append for backlogged ids, the search day below the address."""
    found = blocks(reports).where(F.rlike("block", F.lit(r"^###\s")))
    dated = F.regexp_replace(
        F.col("block"), F.lit(URL_BULLET), F.concat(F.lit("$1\n- **search-date**: "), day)
    )
    return found.select("report_id", "block_no", dated.alias("block"))


def backlog_entries(backlogs: DataFrame) -> DataFrame:
    """``(report_id, block_no, ids, search_date, block)`` of backlog texts."""
    found = blocks(backlogs, trace_ends=False).where(F.rlike("block", F.lit(r"^###\s")))
    ids = F.array_distinct(F.transform(all_matches("block", "(?m)" + BOX, 3), strip))
    return found.select(
        "report_id", "block_no", ids.alias("ids"),
        strip(F.coalesce(first_match("block", SEARCH_DATE), F.lit(""))).alias("search_date"), "block",
    ).where(F.size("ids") > 0)


def kept_backlog(backlogs: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Backlog blocks that stay: all but those approved or rejected."""
    entries = backlog_entries(backlogs).withColumn("id", F.get("ids", F.lit(0)))
    done = outcomes.where(F.col("outcome").isin("approved", "rejected")).select("report_id", "id")
    return entries.join(done, ["report_id", "id"], "left_anti")


def backlog_ids(backlogs: DataFrame) -> DataFrame:
    return backlogs.select(F.explode_outer(all_matches("text", "`([^`]+)`", 1)).alias("id")).where(present("id")).distinct()


def report_day(text: Column, stem: Column, today: Column) -> Column:
    """Day of a report: its header, its name, else today."""
    return F.coalesce(
        fm.scalar(text, "date"), first_match(stem, r"(\d{4}-\d{2}-\d{2})"), F.date_format(today, "yyyy-MM-dd")
    )


def candidate_block(n: Column, title: Column, url: Column, ident: Column, lane: Column, score: Column) -> Column:
    """Markdown block of one candidate with its two open boxes."""
    return F.concat(
        F.lit("### "), n.cast("string"), F.lit(". "), title,
        F.lit("\n- **url**: "), url,
        F.lit("\n- **lane**: "), lane, F.lit(" ("), F.format_string("%.3f", score), F.lit(")"),
        F.lit("\n- [ ] approve · `"), ident, F.lit("`\n- [ ] reject · `"), ident, F.lit("`\n    - reason:\n"),
    )


