"""Readable reports as ordered lines.

Lines are rows ``(part, pos, line)``: parts come in order, positions inside a
part too. Nothing is gathered into one string; a writer sorts and streams them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marginalia.operators import spend
from marginalia.operators.graph import CHECKS
from marginalia.session import written

ITEMS_PER_CHECK = 20
#: merged unit pairs up to so many are broadcast
BROADCAST_UNITS = 1_000_000


def _lines(df: DataFrame, part: int, pos: Column, line: Column) -> DataFrame:
    return df.select(F.lit(part).alias("part"), pos.cast("bigint").alias("pos"), line.alias("line"))


def _in_order(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts).orderBy("part", "pos", "line")


def _money(c: Column) -> Column:
    return F.format_string("%.4f", c)


def health_report(issues: DataFrame, pages: int | None = None) -> DataFrame:
    """Counts per check, then the first twenty findings of each with the rest's number."""
    text = F.concat(F.lit("["), "area", F.lit("] "), "path", F.when(F.col("detail") != "", F.concat(F.lit(" - "), "detail")).otherwise(F.lit("")))
    listed = issues.select("check", text.alias("item"))
    order = Window.partitionBy("check").orderBy("item")
    first = listed.withColumn("n", F.row_number().over(order)).where(F.col("n") <= ITEMS_PER_CHECK)
    counts = listed.groupBy("check").agg(F.count(F.lit(1)).alias("total"))
    rank = F.lit(len(CHECKS))
    for i, name in enumerate(CHECKS):
        rank = F.when(F.col("check") == name, F.lit(i)).otherwise(rank)
    place = rank * 100
    heads = _lines(counts, 1, place, F.concat(F.lit("## "), "check", F.lit(" ("), "total", F.lit(")")))
    items = _lines(first, 1, place + F.col("n"), F.concat(F.lit("- "), "item"))
    more = _lines(
        counts.where(F.col("total") > ITEMS_PER_CHECK), 1, place + ITEMS_PER_CHECK + 1,
        F.concat(F.lit("- _...and "), F.col("total") - ITEMS_PER_CHECK, F.lit(" more_")),
    )
    return _in_order([heads, items, more])


def cost_report(ledger: DataFrame, day: Column) -> DataFrame:
    """Today's totals by source, provider and action; costliest first."""
    today = ledger.where(F.col("date") == day)
    worth = Window.partitionBy(F.lit(0)).orderBy(F.desc("worth"), "key")

    def table(part: int, df: DataFrame, key: str, worth_of: Column, line: Column) -> DataFrame:
        ranked = df.withColumn("key", F.col(key)).withColumn("worth", F.round(worth_of, 8)).withColumn("n", F.row_number().over(worth))
        return _lines(ranked, part, F.col("n"), line)

    both = F.col("cost") + F.col("estimate")
    sources = table(
        1, spend.by_source(today), "source", both,
        F.concat(F.lit("| "), F.concat_ws(" | ", "source", "tokens_in", "tokens_out", _money(F.col("cost")), _money(F.col("estimate"))), F.lit(" |")),
    )
    providers = table(
        2, spend.by_provider(today), "provider", F.col("cost"), F.concat(F.lit("- "), "provider", F.lit(": $"), _money(F.col("cost")))
    )
    actions = table(
        3, spend.by_action(today), "action", both,
        F.concat(
            F.lit("| "),
            F.concat_ws(" | ", "action", "sources", "calls", "tokens_in", "tokens_out", _money(F.col("cost")), _money(F.col("estimate"))),
            F.lit(" |"),
        ),
    )
    return _in_order([sources, providers, actions])


def index_lines(index: DataFrame) -> DataFrame:
    """Catalogue table rows; ordering keys stay columns so a writer can sort."""
    title = F.replace("title", F.lit("|"), F.lit("\\|"))
    line = F.concat(F.lit("| "), F.concat_ws(" | ", title, "type", "day", "link"), F.lit(" |"))
    return index.select("section_rank", "section", "title", "day", line.alias("line"))


def node_lines(table: DataFrame) -> DataFrame:
    line = F.concat(F.lit("| "), F.concat_ws(" | ", "id", "type", "state", "priority", "created", "path"), F.lit(" |"))
    return table.select("type", "id", line.alias("line"))


def briefing_lines(changes: DataFrame, keywords: DataFrame, key: str, first: int = 20) -> DataFrame:
    """Changed reputations with arrows and the first reject words."""
    moved = changes.where(F.col("arrow") != "same")
    reps = moved.select(
        F.lit(1).alias("part"), F.lit(0).cast("bigint").alias("pos"),
        F.concat(F.lit("- "), key, F.lit(": "), F.format_string("%+.3f", "rep"), F.lit(" ("), "arrow", F.lit(")")).alias("line"),
    )
    words = keywords.orderBy(F.col("reasons").desc(), "keyword").limit(first)
    return reps.unionByName(_lines(words, 2, -F.col("reasons"), F.concat(F.lit("- "), "keyword"))).orderBy("part", "pos", "line")


def trace_lines(pairs: DataFrame, matches: DataFrame, gap_rows: DataFrame, direction_rows: DataFrame) -> DataFrame:
    """Decision of every scored pair of units: merged, or which side was taken by others.

    ``merged`` counts the rows of the two units that were matched, copies included; ``gap_rows`` and
    ``direction_rows`` are ``(unit, id)``.
    """
    gap_of = gap_rows.select(F.col("unit").alias("gap_unit"), F.col("id").alias("gap_id"))
    direction_of = direction_rows.select(F.col("unit").alias("direction_unit"), F.col("id").alias("direction_id"))
    merged = matches.join(gap_of, "gap_id").join(direction_of, "direction_id").groupBy("gap_unit", "direction_unit").agg(F.count(F.lit(1)).alias("merged"))
    # at most as many rows as there are units on a side; the pairs, of which there may be many more, are not shuffled for them
    merged = written(merged)
    gaps = merged.select("gap_unit", F.lit(True).alias("gap_taken")).distinct()
    few = merged.count() <= BROADCAST_UNITS
    merged, gaps = (F.broadcast(rows) if few else rows for rows in (merged, gaps))
    both = pairs.join(merged, ["gap_unit", "direction_unit"], "left").join(gaps, "gap_unit", "left")
    decision = F.when(F.col("merged") > 0, "MERGED").when(F.col("gap_taken"), "gap-consumed").otherwise("direction-consumed")
    return both.select("gap_unit", "direction_unit", "score", F.coalesce("merged", F.lit(0)).alias("merged"), decision.alias("decision"))
