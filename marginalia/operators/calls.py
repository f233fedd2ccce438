"""Calls that a crawl plan makes, each once per target, cut to what every engine may spend.

A call is ``(engine, query, category)``: a feed or repository by its address, a paper engine by each of the target's queries for it, the
forum by two queries. A target's repeated calls count once, at their first place. Budgets cut the plan's order of calls
engine by engine: running sums are taken in two steps (slices of the order, then their totals), so one engine may have
most of the calls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marginalia.functions.basics import blank_to_null, present
from marginalia.operators import decide
from marginalia.operators.ordering import slice_offsets, sliced

# Categories that are read as feeds, the forum's name and its queries per target.
FEED_CATEGORIES = ["research_aggregator", "conference"]
FORUM, FORUM_QUERIES = "hackernews", 2
# End of the fixed values.


def news_target(registry: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """The plan's news target with its sources: one row in the columns of a target, and ``routed``."""
    # five sources at most
    best = decide.news_sources(registry, weights).agg(F.collect_list(F.struct((-F.col("weighted")).alias("neg"), "source_id")).alias("found"))
    empty = F.array().cast("array<string>")
    return best.select(
        F.lit("news").alias("target_id"), F.lit("news").alias("lane"), F.array(F.lit("news")).alias("origin_ids"), F.lit("medium").alias("priority"), empty.alias("queries"),
        F.lit(decide.NEWS_EVIDENCE).alias("expected_evidence"), F.array(F.lit("web")).alias("fillable_by"), F.transform(F.array_sort("found"), lambda x: x["source_id"]).alias("routed"),
    )


def _asked(engine: Column) -> Column:
    """Queries for an engine: its own, else the flat ones, else the first query or the target's name."""
    own = F.coalesce(F.try_element_at("queries_by_engine", engine), F.array().cast("array<string>"))
    flat = F.when(F.size("queries") > 0, F.col("queries")).otherwise(F.array("target_id"))
    return F.when(F.size(own) > 0, own).otherwise(flat)


def planned_calls(targets: DataFrame, routes: DataFrame, registry: DataFrame) -> DataFrame:
    """``target_id, nth, engine, query, category``: the calls of every target in order, each once.

    ``targets``: target_id, lane, queries, queries_by_engine, fillable_by. ``routes``: target_id, position, source_id.
    ``registry``: source_id, section, category, engine, feed, url, subject (of the paper engine; null or empty for none).
    """
    entry = registry.select("source_id", "section", F.coalesce("category", F.lit("")).alias("category"), blank_to_null("engine").alias("engine"), blank_to_null("feed").alias("feed"), "url", F.coalesce("subject", F.lit("")).alias("subject"))
    known = routes.join(entry, "source_id").join(targets, "target_id")
    call = lambda engine, query, subject: F.struct(engine.alias("engine"), query.alias("query"), subject.alias("category"))
    none, no_calls = F.lit(""), F.array().cast("array<struct<engine:string,query:string,category:string>>")
    feed = F.when(F.col("feed").isNotNull(), F.array(call(F.lit("rss"), F.col("feed"), none))).otherwise(no_calls)
    subject = F.when(F.col("engine") == "arxiv", F.col("subject")).otherwise(none)
    papers = F.transform(_asked(F.col("engine")), lambda q: call(F.col("engine"), q, subject))
    made = (
        F.when(F.col("section") == "github-repos", F.array(call(F.lit("github"), F.col("url"), none)))
        .when((F.col("section") == "blog-newsfeed") | F.col("category").isin(*FEED_CATEGORIES), feed)
        .when(F.col("section") == "paper-publisher", F.when(F.col("engine").isNotNull(), papers).otherwise(feed)).otherwise(no_calls)
    )
    routed = known.select("target_id", F.lit(0).alias("group"), F.col("position").cast("int").alias("position"), made.alias("calls"))
    own = F.coalesce(F.try_element_at("queries_by_engine", F.lit("forum")), F.array().cast("array<string>"))
    first = F.array(F.coalesce(F.get("queries", F.lit(0)), F.col("target_id")))
    flat = F.when(F.size("queries") > 0, F.slice("queries", 1, FORUM_QUERIES)).otherwise(first)
    forum = F.when(F.size(own) > 0, F.slice(own, 1, FORUM_QUERIES)).otherwise(flat)
    asked = targets.where(F.array_contains("fillable_by", "forum")).select("target_id", F.lit(1).alias("group"), F.lit(0).alias("position"), F.transform(forum, lambda q: call(F.lit(FORUM), q, none)).alias("calls"))
    alone = targets.where("lane = 'research'").join(routes.select("target_id").distinct(), "target_id", "left_anti")
    seeds = alone.select("target_id", F.lit(2).alias("group"), F.lit(0).alias("position"), F.transform(_asked(F.lit("arxiv")), lambda q: call(F.lit("arxiv"), q, none)).alias("calls"))
    every = routed.unionByName(asked).unionByName(seeds).select("target_id", "group", "position", F.posexplode_outer("calls").alias("n", "c")).where(present("n"))
    once = every.groupBy("target_id", "c.engine", "c.query", "c.category").agg(F.min(F.struct("group", "position", "n")).alias("place"))
    nth = F.row_number().over(Window.partitionBy("target_id").orderBy("place")).cast("long")
    return once.select("target_id", nth.alias("nth"), "engine", "query", "category")


def within_budget(calls: DataFrame, order: str, budgets: DataFrame, cost: Column) -> DataFrame:
    """Calls that their engine's budget covers, with ``spent`` up to each, in the order of the column ``order``.

    The cut is a prefix: the first call that an engine cannot pay ends its calls. ``budgets``: engine, budget; engines without one are not
    limited. ``cost`` is a whole number of 0 or more.
    """
    rows = sliced(calls.withColumn("_cost", F.coalesce(cost, F.lit(0)).cast("long")), "engine", order)
    inside = Window.partitionBy("engine", "slice").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    # one row for each slice of an engine
    placed = rows.join(slice_offsets(rows, "engine", F.col("_cost")), ["engine", "slice"]).withColumn("spent", F.col("before") + F.sum("_cost").over(inside))
    limited = placed.join(budgets.select("engine", "budget"), "engine", "left")
    return limited.where(F.col("budget").isNull() | (F.col("spent") <= F.col("budget"))).select(*calls.columns, "spent")
