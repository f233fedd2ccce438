"""Link graph checks and the vault audit.

Links and pages stay in edge form: one row per occurrence. Hot targets (a page
every other page links to) only ever enter left-semi/anti joins and map-side
counts, never a collected list.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions import frontmatter as fm
from marginalia.functions import prose
from marginalia.functions.basics import bind, lines_of, present, strip
from marginalia.session import cut_lineage

# Required keys, areas and allowed values of the audit.
WIKI_KEYS = ["type", "created", "updated", "sources"]
REQUIRED_KEYS = {
    "concept": WIKI_KEYS,
    "entity": WIKI_KEYS,
    "source": WIKI_KEYS,
    "synthesis": WIKI_KEYS,
    "purpose": ["type", "created", "updated", "status"],
    "research_question": ["type", "id", "created", "updated", "solved", "priority"],
    "direction": ["type", "id", "created", "updated", "status", "serves_question", "priority"],
    "research_question_proposal": ["type", "id", "created", "updated", "status"],
    "decision": ["type", "id", "created", "updated", "status", "scope"],
    "agent_todo": ["type", "id", "created", "updated", "status"],
    "research_report": ["type", "id", "created", "updated", "status"],
    "research-report": ["type", "created", "updated", "status"],
    "query-result": ["type", "created", "updated"],
}
OTHER_KEYS = ["type", "created", "updated"]
SKIP_STEMS = ["index", "log", "hot", "overview"]
ISOLATED_AREAS = ["objective", "research"]
WRITERS = ["USER", "research", "wiki", "web", "backend"]
CHECKS = [
    "code_fence_wrapped", "missing_frontmatter", "missing_written_by", "unfilled_template",
    "duplicate", "orphaned", "dead_links", "stale", "empty",
]
ROOT_PAGES = ["CLAUDE.md", "README.md", "index.md", "log.md", "hot.md"]
STALE_DAYS = 90
EMPTY_BELOW_CHARS = 50
# End of the fixed values.


def with_names(pages: DataFrame) -> DataFrame:
    """Adds area, file name and stem to ``pages(path, text)``."""
    name = F.substring_index("path", "/", -1)
    return pages.select(
        "*",
        F.substring_index("path", "/", 1).alias("area"),
        name.alias("name"),
        F.regexp_replace(name, r"(?<=.)\.[^.]*$", "").alias("stem"),
    )


def skippable() -> Column:
    return F.startswith(F.col("name"), F.lit("_")) | F.col("stem").isin(*SKIP_STEMS)


def page_links(pages: DataFrame) -> DataFrame:
    """``(path, area, stem, target)``, one row per link occurrence."""
    return pages.select("path", "area", "stem", "name", F.explode_outer(prose.wiki_links("text")).alias("target")).where(present("target"))


def link_targets(links: DataFrame) -> DataFrame:
    return links.select("target").distinct()


def dead_links(links: DataFrame, pages: DataFrame) -> DataFrame:
    """Links whose target names no page; every occurrence is kept."""
    stems = pages.select(F.col("stem").alias("target")).distinct()
    return links.join(stems, "target", "left_anti")


def orphans(pages: DataFrame, links: DataFrame) -> DataFrame:
    """Pages nothing links to; in some areas only if they link nowhere either."""
    seen = link_targets(links).withColumnRenamed("target", "stem")
    unseen = pages.where(~skippable()).join(seen, "stem", "left_anti")
    linked_out = F.size("links" if "links" in pages.columns else prose.wiki_links("text")) > 0
    return unseen.where(~F.col("area").isin(*ISOLATED_AREAS) | ~linked_out).select("path", "area", "stem")


def duplicate_stems(pages: DataFrame) -> DataFrame:
    """Pages that share a normalised stem, with the group's size and area tag.

    The group is described by map-side aggregates and joined back, so a stem
    shared by very many pages is neither collected nor sorted in one task.
    """
    named = pages.where(~skippable()).select("path", "area", prose.normal_stem("stem").alias("norm")).where("norm <> ''")
    groups = (
        named.groupBy("norm")
        .agg(F.count(F.lit(1)).alias("files"), F.min("area").alias("low"), F.max("area").alias("high"))
        .where("files > 1")
        .select("norm", "files", F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(F.lit("cross-area")).alias("tag"))
    )
    return named.join(groups, "norm")


def missing_pages(pages: DataFrame, mentions: int = 2) -> DataFrame:
    """Link texts on several pages that name no page; links are not shortened.

    Repeats inside a page are dropped in the row, so counting rows counts pages.
    """
    named = pages.select(F.col("stem").alias("term")).distinct()
    linked = pages.where(~F.startswith("name", F.lit("_"))).select(
        F.explode_outer(F.array_distinct(prose.raw_links("text"))).alias("term")
    ).where(present("term"))
    counted = linked.groupBy("term").agg(F.count(F.lit(1)).alias("pages")).where(F.col("pages") >= mentions)
    return counted.join(named, "term", "left_anti")


def missing_page_sources(pages: DataFrame, mentions: int = 2) -> DataFrame:
    """The citing pages of :func:`missing_pages` in edge form."""
    linked = pages.where(~F.startswith("name", F.lit("_"))).select(
        "path", F.explode_outer(F.array_distinct(prose.raw_links("text"))).alias("term")
    ).where(present("term"))
    return linked.join(missing_pages(pages, mentions), "term")


def stray_root_pages(pages: DataFrame) -> DataFrame:
    at_root = ~F.contains("path", F.lit("/")) & F.endswith("path", F.lit(".md"))
    return pages.where(at_root & ~F.col("path").isin(*ROOT_PAGES) & ~F.startswith("path", F.lit("_"))).select("path")


def empty_sections(pages: DataFrame) -> DataFrame:
    """Headings with nothing but blank lines before the next heading or the end.

    Sections are cut out of the row's own text: a page's sections never leave
    its row.
    """
    text = F.regexp_replace("text", r"(?s)\A---.*?---", "")
    pieces = F.split(F.concat(F.lit("\n"), text), r"\n(?=#{1,6}[ \t])")
    pattern = r"(?s)\A#{1,6}\s+([^\n]*)(.*)\z"
    cut = F.transform(
        F.filter(pieces, lambda p: F.rlike(p, F.lit(pattern))),
        lambda p: F.struct(
            strip(F.regexp_extract(p, pattern, 1)).alias("heading"), strip(F.regexp_extract(p, pattern, 2)).alias("body")
        ),
    )
    return (
        pages.where(~F.startswith("name", F.lit("_")))
        .select("path", F.explode_outer(F.filter(cut, lambda s: s["body"] == "")).alias("s")).where(present("s"))
        .select("path", F.col("s.heading").alias("heading"))
    )


def _required(page_type: Column) -> Column:
    out = F.array(*[F.lit(k) for k in OTHER_KEYS])
    for name, keys in REQUIRED_KEYS.items():
        out = F.when(page_type == name, F.array(*[F.lit(k) for k in keys])).otherwise(out)
    return out


def own_findings(text: Column, today: Column) -> Column:
    """``array<struct<check, detail>>`` of the checks that need one page only."""
    head = r"(?s)\A---(.*?)---"
    facts = F.struct(
        F.rlike(text, F.lit(r"\A\s*```[^\n]*\n\s*---\s*\n")).alias("fenced"),
        F.rlike(text, F.lit(r"(?s)<%.*?%>")).alias("unfilled"),
        fm.keys(text).alias("keys"),
        fm.scalar(text, "type", head).alias("type"),
        fm.scalar(text, "written_by", head).alias("written_by"),
        F.regexp_extract(text, r"(?sm)\A---.*?^updated[ \t]*:[ \t]*([\"'][^\n]*)$.*?---", 1).alias("updated"),
        F.length(strip(F.regexp_replace(text, r"(?s)\A---.*?---", ""))).alias("body_chars"),
    )

    def found(check: str, when: Column, detail: Column | None = None) -> Column:
        return F.when(when, F.struct(F.lit(check).alias("check"), (detail if detail is not None else F.lit("")).alias("detail")))

    def judged(f: Column) -> Column:
        absent = F.sort_array(F.array_except(_required(f["type"]), f["keys"]))
        quoted_day = F.try_to_date(F.substring(fm.unquote_all(strip(f["updated"])), 1, 10), "yyyy-MM-dd")
        writer = f["written_by"]
        return F.array_compact(
            F.array(
                found("code_fence_wrapped", f["fenced"]),
                found("unfilled_template", f["unfilled"]),
                found("empty", f["body_chars"] < EMPTY_BELOW_CHARS),
                found("missing_frontmatter", ~f["fenced"] & (F.size(absent) > 0), F.array_join(absent, ", ")),
                found("missing_written_by", writer.isNull(), F.lit("missing written_by")),
                found(
                    "missing_written_by", writer.isNotNull() & ~writer.isin(*WRITERS), F.concat(F.lit("invalid written_by: "), writer)
                ),
                found("stale", F.coalesce(quoted_day < F.date_sub(today, STALE_DAYS), F.lit(False))),
            )
        )

    return bind(facts, judged)


def audit(pages: DataFrame, today: Column) -> DataFrame:
    """Every issue of ``pages(path, text)`` as ``(area, check, path, detail)``.

    The texts are read once: what the checks need of a page (its links and its
    own findings) is written out and every check works on that.
    """
    named = with_names(pages)
    facts = cut_lineage(
        named.select(
            "path", "area", "name", "stem", prose.wiki_links("text").alias("links"), own_findings(F.col("text"), today).alias("found")
        )
    )
    links = facts.select("path", "area", "stem", "name", F.explode_outer("links").alias("target")).where(present("target"))
    dead = dead_links(links, facts).select(
        F.when(skippable(), F.lit("unknown")).otherwise(F.col("area")).alias("area"),
        F.lit("dead_links").alias("check"),
        "path",
        F.col("target").alias("detail"),
    )
    lone = orphans(facts, links).select("area", F.lit("orphaned").alias("check"), "path", F.lit("").alias("detail"))
    double = duplicate_stems(facts).select(
        F.col("tag").alias("area"), F.lit("duplicate").alias("check"), "path", F.col("norm").alias("detail")
    )
    own = facts.where(~skippable()).select("area", "path", F.explode_outer("found").alias("r")).where(present("r"))
    own = own.select("area", "r.check", "path", "r.detail")
    return reduce(DataFrame.unionByName, [own, dead, lone, double])


def issue_counts(issues: DataFrame) -> DataFrame:
    """One row per area, one column per check and the total.

    A duplicate group counts as one issue however many pages it has.
    """
    unit = F.when(F.col("check") == "duplicate", F.col("detail")).otherwise(F.lit(None))
    counts = [
        (
            F.count_distinct(unit) if check == "duplicate" else F.count_if(F.col("check") == check)
        ).cast("bigint").alias(check)
        for check in CHECKS
    ]
    total = reduce(lambda a, b: a + b, [F.col(c) for c in CHECKS])
    return issues.groupBy("area").agg(*counts).withColumn("total", total)


def health_score(issues: DataFrame) -> DataFrame:
    singles = F.count_if(F.col("check") != "duplicate")
    groups = F.count_distinct(F.when(F.col("check") == "duplicate", F.col("detail")))
    total = (singles + groups).cast("bigint")
    return issues.agg(total.alias("issues")).select(
        "issues", F.greatest(F.lit(0), 100 - 2 * F.col("issues")).cast("bigint").alias("score")
    )


def lint_counts(pages: DataFrame) -> DataFrame:
    """Number of findings of the three extra lint checks."""
    named = with_names(pages)
    parts = [
        ("empty_sections", empty_sections(named.where("area = 'wiki'"))),
        ("missing_pages", missing_pages(named.where("area = 'wiki'"))),
        ("stray_root", stray_root_pages(named)),
    ]
    return reduce(
        DataFrame.unionByName,
        [df.agg(F.count(F.lit(1)).alias("findings")).select(F.lit(n).alias("check"), "findings") for n, df in parts],
    )


def heading_lines(texts: DataFrame) -> DataFrame:
    """``(id, line_no, heading)`` of every heading line of ``texts(id, text)``."""
    return texts.select("id", F.posexplode_outer(lines_of("text")).alias("line_no", "line")).where(present("line_no")).where(
        F.rlike("line", F.lit(r"^#{1,6}\s+"))
    )
