"""What a target already has in the wiki, and the blocks a prompt is filled with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions.basics import all_matches, blank_to_null, lines_of, present, strip
from marginalia.functions.prose import CACHE_FLOOR_CHARS

# Sizes and link form of the context.
MISSING_CHARS = 200
SAMPLE_CHARS = 150
CONTEXT_CHARS = 400
CONTEXT_PAGES = 3
LINK_WITH_ALIAS = r"\[\[([^\]|#]+?)(?:\|[^\]]+)?\]\]"
# End of the fixed values.


def resolved_links(links: DataFrame, pages: DataFrame) -> DataFrame:
    """``links(id, pos, link)`` with the page each one names, ``.md`` tried first."""
    stem = F.regexp_replace(strip("link"), r"\.md$", "")
    wanted = links.withColumn("stem", stem).withColumn("with_suffix", F.concat(stem, F.lit(".md")))
    first = pages.select(F.col("path").alias("with_suffix"), F.col("text").alias("first_text"))
    second = pages.select(F.col("path").alias("stem"), F.col("text").alias("second_text"))
    found = wanted.join(first, "with_suffix", "left").join(second, "stem", "left")
    return found.select("id", "pos", "link", F.coalesce("first_text", "second_text").alias("text")).where(present("text"))


def wiki_context(gaps: DataFrame, pages: DataFrame) -> DataFrame:
    """``(id, context)`` of ``gaps(id, missing, shows_up_in)``: missing text and page samples.

    A gap contributes its first three links only, so at most three samples come
    back to it.
    """
    named = F.slice(all_matches("shows_up_in", LINK_WITH_ALIAS, 1), 1, CONTEXT_PAGES)
    links = gaps.select("id", F.posexplode_outer(named).alias("pos", "link")).where(present("pos"))
    body = strip(F.regexp_replace("text", r"(?s)\A---.*?---\n", ""))
    sample = strip(F.replace(F.substring(body, 1, SAMPLE_CHARS), F.lit("\n"), F.lit(" ")))
    known = resolved_links(links, pages).select("id", "pos", F.concat(F.lit("Known ("), "link", F.lit("): "), sample).alias("part"), sample.alias("sample"))
    samples = known.where("sample <> ''").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("pos", "part"))).alias("parts"))
    missing = blank_to_null(strip("missing"))
    text = F.concat_ws(
        " | ",
        F.concat(F.lit("Missing: "), F.substring(missing, 1, MISSING_CHARS)),
        F.array_join(F.transform("parts", lambda p: p["part"]), " | "),
    )
    return gaps.join(samples, "id", "left").select("id", F.substring(text, 1, CONTEXT_CHARS).alias("context"))


def first_line(body: Column) -> Column:
    return F.coalesce(F.get(F.filter(lines_of(strip(body)), lambda x: strip(x) != ""), F.lit(0)), F.lit(""))


def question_lines(nodes: DataFrame) -> DataFrame:
    """One prompt line per question with its priority and concepts."""
    concepts = F.when(F.size("concepts") > 0, F.concat(F.lit(" [concepts: "), F.array_join("concepts", ", "), F.lit("]"))).otherwise(F.lit(""))
    line = F.concat("id", F.lit(": "), first_line(F.col("body")), F.lit(" [priority: "), "priority", F.lit("]"), concepts)
    return nodes.select("id", line.alias("line"))


def direction_lines(nodes: DataFrame) -> DataFrame:
    served = F.when(F.col("serves_question") != "", F.concat(F.lit(" [serves: "), "serves_question", F.lit("]"))).otherwise(F.lit(""))
    line = F.concat("id", F.lit(": "), first_line(F.col("body")), F.lit(" [priority: "), "priority", F.lit("]"), served)
    return nodes.select("id", line.alias("line"))


def baseline_lines(hits: DataFrame) -> DataFrame:
    """One block per context hit of ``hits(path, score, excerpt)``."""
    block = F.concat(F.lit("### [["), "path", F.lit("]] (score="), "score", F.lit(")\n\n"), strip("excerpt"))
    return hits.select("path", "score", block.alias("block"))


def filled_prompt(template: str, values: dict[str, Column]) -> Column:
    """``{name}`` places of a template filled from columns."""
    out: Column = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return out


def cacheable(body: Column) -> Column:
    """Whether a page body clears the smallest size a prompt cache keeps."""
    return F.length(body) >= CACHE_FLOOR_CHARS


def due_topics(topics: DataFrame, today: Column) -> DataFrame:
    """Daily topics always, all others on Mondays; unnamed ones never."""
    often = F.lower(strip(F.coalesce(blank_to_null(F.col("frequency")), F.lit("weekly"))))
    return topics.where((F.coalesce("name", F.lit("")) != "") & ((often == "daily") | (F.dayofweek(today) == 2)))
