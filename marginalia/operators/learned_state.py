"""What an agent has learned, as a versioned table that a pass of decisions moves on.

The state is five tables: counts of sources and of engines, counts of reject words, the calibration and the ids that were
counted. A version is one commit (``sources.commits``), so no reader meets counts without the ids behind them.

A pass takes the decisions whose ids are not among the counted ones, merges their counts with the stored ones by full
outer joins, and folds their scores into the stored means: a stored mean is the value that the pass's affine maps
start from. Two passes in a row thus give what one pass over both gives. Means are stored unrounded.

States of older forms are migrated when they are read: missing parts are empty, and a state that has only the list of its reject
words gets the least count that keeps each of them active.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions import scoring
from marginalia.operators import learn
from marginalia.session import cut_lineage
from marginalia.sources.commits import Commits

COUNTS = "name string, accept long, reject long, rep double"
WORDS = "keyword string, reasons long"
MEANS = "accepted_mean double, rejected_mean double, n long, updated string"
IDS = "id string"
PARTS = {"sources": COUNTS, "engines": COUNTS, "words": WORDS, "calibration": MEANS, "processed": IDS}
#: the stored document of older versions
DOCUMENT = (
    "updated string, sources map<string, struct<accept: long, reject: long, rep: double>>, engines map<string, struct<accept: long, reject: long, rep: double>>, "
    "reject_patterns struct<keyword_counts: map<string, long>, keywords: array<string>>, "
    "calibration struct<accepted_score_mean: double, rejected_score_mean: double, n: long>, processed_ids array<string>"
)


@dataclass(frozen=True)
class Learned:
    """The five tables of a state, in the columns of ``PARTS``."""

    sources: DataFrame
    engines: DataFrame
    words: DataFrame
    calibration: DataFrame
    processed: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in PARTS}

    def keywords(self, least: int = learn.MIN_REASONS, cap: int = learn.KEYWORD_CAP) -> DataFrame:
        """Active reject words."""
        return learn.active_keywords(self.words, least, cap)


def empty(spark: SparkSession) -> Learned:
    made = {name: spark.createDataFrame([], schema) for name, schema in PARTS.items()}
    made["calibration"] = spark.createDataFrame([(0.0, 0.0, 0, "")], MEANS)
    return Learned(**made)


def of_document(document: DataFrame, least: int = learn.MIN_REASONS, strength: float = 1.0) -> Learned:
    """State of a stored document: ``document`` has one row with its JSON in ``text``; text that is no JSON object is a fresh state."""
    read = document.select(F.from_json("text", DOCUMENT, {"mode": "PERMISSIVE"}).alias("d")).select("d.*")

    def counts(column: str) -> DataFrame:
        rows = read.select(F.explode(column).alias("name", "c"))
        accept, reject = (F.coalesce(f"c.{k}", F.lit(0)).cast("long") for k in ("accept", "reject"))
        return rows.select("name", accept.alias("accept"), reject.alias("reject"), F.coalesce("c.rep", scoring.reputation(accept, reject, strength)).alias("rep"))

    seeded = F.map_from_entries(F.transform(F.array_distinct(F.coalesce("reject_patterns.keywords", F.array().cast("array<string>"))), lambda w: F.struct(w, F.lit(least).cast("long"))))
    words = read.select(F.explode(F.coalesce("reject_patterns.keyword_counts", seeded)).alias("keyword", "reasons"))
    none = F.lit(0.0)
    means = read.agg(
        F.coalesce(F.max("calibration.accepted_score_mean"), none).alias("accepted_mean"), F.coalesce(F.max("calibration.rejected_score_mean"), none).alias("rejected_mean"),
        F.coalesce(F.max("calibration.n"), F.lit(0)).alias("n"), F.coalesce(F.max("updated"), F.lit("")).alias("updated"),
    )
    return Learned(counts("sources"), counts("engines"), words, means, read.select(F.explode("processed_ids").alias("id")))


def load(spark: SparkSession, root: str) -> Learned:
    """The latest version; a fresh state if there is none."""
    commits = Commits(spark, root)
    latest = commits.latest()
    if latest is None:
        return empty(spark)
    return Learned(**{name: commits.read(name, schema, [latest]).drop("commit") for name, schema in PARTS.items()})


def publish(state: Learned, root: str, after: int | None) -> int:
    """Store a state as the version after ``after``; raises ``Conflict`` if another pass got there first."""
    spark = state.sources.sparkSession
    number = 0 if after is None else after + 1
    commits = Commits(spark, root)
    commits.publish(number, commits.write(number, state.tables()))
    return number


def merged_counts(stored: DataFrame, new: DataFrame, strength: float = 1.0) -> DataFrame:
    """``COUNTS`` of both; a name that has nothing new keeps its stored reputation."""
    old = stored.select("name", F.col("accept").alias("a0"), F.col("reject").alias("r0"), F.col("rep").alias("rep0"))
    both = old.join(new, "name", "full")
    accept, reject = (F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)) for a, b in (("a0", "accept"), ("r0", "reject")))
    rep = F.when(F.col("accept").isNull(), F.col("rep0")).otherwise(scoring.reputation(accept, reject, strength))
    return both.select("name", accept.cast("long").alias("accept"), reject.cast("long").alias("reject"), rep.alias("rep"))


def merged_words(stored: DataFrame, new: DataFrame) -> DataFrame:
    both = stored.join(new.select("keyword", F.col("reasons").alias("more")), "keyword", "full")
    return both.select("keyword", (F.coalesce("reasons", F.lit(0)) + F.coalesce("more", F.lit(0))).cast("long").alias("reasons"))


@dataclass(frozen=True)
class Pass:
    """A pass: the new state, the decisions it counted, and the state before it."""

    before: Learned
    after: Learned
    decisions: DataFrame

    def changes(self, part: str = "sources") -> DataFrame:
        """Names whose counts moved: ``name, accept, reject, rep, arrow``."""
        moved = self.decisions.select(F.trim({"sources": "source_id", "engines": "engine"}[part]).alias("name")).distinct()
        old, new = (getattr(s, part).withColumnRenamed("name", "key") for s in (self.before, self.after))
        return learn.reputation_changes(old, new, "key").withColumnRenamed("key", "name").join(moved, "name", "left_semi")

    def promoted(self) -> DataFrame:
        """Reject words that became active."""
        return self.after.keywords().join(self.before.keywords().select("keyword"), "keyword", "left_anti")


def learn_pass(state: Learned, ledger: DataFrame, protected: DataFrame, today: str, agent: str = "web", words: bool = False, strength: float = 1.0, part_rows: int = 100_000) -> Pass:
    """Move ``state`` on by the decided rows of ``ledger`` that it has not counted.

    ``ledger``: id (whole numbers; their order is that of the fold), status, discovered_by, source_id, engine, relevance_score, rejection_reason. Reject words
    are counted only if ``words`` is set. A repeated id counts once; a row without an id is no ledger row.
    """
    rows = ledger.where("id is not null").withColumn("text_id", F.col("id").cast("string"))
    fresh = rows.join(state.processed.select(F.col("id").alias("text_id")), "text_id", "left_anti").dropDuplicates(["id"])
    decisions = cut_lineage(learn.new_decisions(fresh, fresh.select("id").limit(0), agent))
    counts = {key: learn.counts_by(decisions, key).withColumnRenamed(key, "name") for key in ("source_id", "engine")}
    said = learn.keyword_counts(decisions, protected) if words else state.words.limit(0)
    means = learn.running_means(decisions, F.floor(F.col("id") / part_rows), state.calibration)
    after = Learned(
        merged_counts(state.sources, counts["source_id"], strength), merged_counts(state.engines, counts["engine"], strength), merged_words(state.words, said),
        means.withColumn("updated", F.lit(today)), state.processed.unionByName(decisions.select(F.col("text_id").alias("id"))),
    )
    return Pass(state, after, decisions)
