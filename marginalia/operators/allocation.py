"""Gap-free numbers from stored counters, and the pages that are written under them.

Counters hold the next number of each kind (1 where a kind has none). A block of requests takes consecutive numbers by key, in
two steps of running sums, so one kind may have most of the requests. New numbers and advanced counters are one commit
(``sources.commits``): a request that has a number keeps it, and a run that dies or meets another run's commit has taken none.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions import prose
from marginalia.functions.basics import lines_of
from marginalia.operators.objectives import format_id
from marginalia.operators.ordering import numbered
from marginalia.sources.commits import Commits

ALLOCATED = "type string, key string, id string"
COUNTERS = "type string, next long"
#: a header at the very beginning of a page
HEADER = r"(?s)\A---\n(.*?)\n---(?:\n|\z)"


def allocate(requests: DataFrame, counters: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """``requests(type, key, ...)`` with their ``id``, and the counters behind them: ``type, next``."""
    known = counters.groupBy("type").agg(F.max("next").alias("next"))
    first = F.coalesce("next", F.lit(1))
    # a row for each kind
    placed = numbered(requests, "type", key).join(F.broadcast(known), "type", "left").withColumn("number", F.col("n") - 1 + first)
    given = placed.select(*requests.columns, format_id(F.col("type"), F.col("number")).alias("id"))
    used = requests.groupBy("type").agg(F.count(F.lit(1)).alias("used"))
    advanced = known.join(used, "type", "full").select("type", (first + F.coalesce("used", F.lit(0))).alias("next"))
    return given, advanced


@dataclass(frozen=True)
class Allocator:
    """Stored counters and the numbers given out, below ``root``."""

    spark: SparkSession
    root: str

    @property
    def commits(self) -> Commits:
        return Commits(self.spark, self.root)

    def counters(self) -> DataFrame:
        latest = self.commits.latest()
        return self.commits.read("counters", COUNTERS, [] if latest is None else [latest]).drop("commit")

    def allocated(self) -> DataFrame:
        """``type, key, id`` of all requests so far."""
        return self.commits.read("allocated", ALLOCATED).drop("commit")

    def seed(self, counters: DataFrame) -> bool:
        """Take over counters kept elsewhere; False if there are stored ones."""
        return self.commits.commit(0, {"counters": counters.select("type", F.col("next").cast("long")), "allocated": self.spark.createDataFrame([], ALLOCATED)})

    def take(self, requests: DataFrame, key: str) -> DataFrame:
        """Numbers for the requests that have none; returns ``type, key, id`` of these."""
        latest = self.commits.latest()
        asked = requests.select("type", F.col(key).cast("string").alias("key")).distinct()
        fresh = asked.join(self.allocated().select("type", "key"), ["type", "key"], "left_anti")
        given, advanced = allocate(fresh, self.counters(), "key")
        number = 0 if latest is None else latest + 1
        self.commits.publish(number, self.commits.write(number, {"allocated": given.select("type", "key", "id"), "counters": advanced.select("type", F.col("next").cast("long"))}))
        return self.commits.read("allocated", ALLOCATED, [number]).drop("commit")


# ---- pages under new numbers, and pages that change with them -------------------


def todo_pages(tasks: DataFrame, today: str) -> DataFrame:
    """``path, text`` of task pages; ``tasks``: id, title, body."""
    header = F.concat(F.lit("---\ntype: agent_todo\nid: "), "id", F.lit(f"\ncreated: {today}\nupdated: {today}\nwritten_by: research\nstatus: open\n---\n\n"))
    path = F.concat(F.lit("objective/agent_todo/"), "id", F.lit("-"), prose.slug("title", 35), F.lit(".md"))
    return tasks.select("id", path.alias("path"), F.concat(header, F.regexp_replace("body", r"\A\n+", "")).alias("text"))


def _header(text: Column) -> Column:
    return F.regexp_extract(text, HEADER, 1)


def _rest(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, HEADER, ""), r"\A\n+", "")


def _set(text: Column, dropped: list[str], added: list[Column], updated: str | None = None) -> Column:
    """A page whose header loses the lines of some fields and gets others at its end; a page without header stays."""
    kept = F.filter(lines_of(_header(text)), lambda line: ~F.rlike(line, F.lit(rf"^\s*(?:{'|'.join(dropped)}):")))
    if updated:
        kept = F.transform(kept, lambda line: F.when(F.rlike(line, F.lit(r"^\s*updated:")), F.lit(f"updated: {updated}")).otherwise(line))
    lines = F.concat(kept, F.array(*added))
    return F.when(F.rlike(text, F.lit(HEADER)), F.concat(F.lit("---\n"), F.array_join(lines, "\n"), F.lit("\n---\n"), _rest(text))).otherwise(text)


def approved(text: Column) -> Column:
    """A proposal's page with status approved."""
    return _set(text, ["status"], [F.lit("status: approved")])


def solved(text: Column, answer: Column, today: str) -> Column:
    """A question's page with its answer."""
    return _set(text, ["solved", "answer_ref"], [F.lit('solved: "yes"'), F.concat(F.lit("answer_ref: "), answer)], today)


def question_pages(proposals: DataFrame, today: str) -> DataFrame:
    """``path, text`` of the questions that approved proposals become; ``proposals``: id (of the question), title, text."""
    fields = _header(F.col("text"))
    given = F.lower(F.regexp_extract(fields, r"(?m)^[ \t]*priority:[ \t]*[\"']?([^\"'\n]*?)[\"']?[ \t]*$", 1))
    priority = F.when(given.isin("high", "medium", "low"), given).otherwise("medium")
    slugs = prose.concept_slugs(fields)
    related = F.concat(F.lit("["), F.array_join(F.transform(slugs, lambda s: F.concat(F.lit('"[[wiki/concepts/'), s, F.lit(']]"'))), ", "), F.lit("]"))
    header = F.concat(
        F.lit("---\ntype: research_question\nid: "), "id", F.lit(f"\ncreated: {today}\nupdated: {today}\nsolved: no\nrelated: "), related, F.lit("\npriority: "), priority, F.lit("\nanswer_ref: \n---\n"),
    )
    path = F.concat(F.lit("objective/research_question/"), "id", F.lit("-"), prose.slug("title", 35), F.lit(".md"))
    return proposals.select("id", path.alias("path"), F.concat(header, _rest(F.col("text"))).alias("text"))
