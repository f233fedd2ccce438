"""Gap and direction pages, gap analyses and the texts made from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions import frontmatter as fm
from marginalia.functions import prose
from marginalia.functions.basics import all_matches, bind, blank_to_null, first_match, lines_of, nonblank, present, strip

# Tags, fields and prompt-side formats.
ENGINE_TAGS = r"(?i)\b(arxiv|web|github|forum|x)\b"
SEED_TAG = r"(?i)^(arxiv|web|github|forum|x):\s*(.+)$"
PRIORITY = r"(?i)^(high|medium|low)\b"
BARE_SLUG = r"[a-z0-9]+(?:-[a-z0-9]+)+"
DIRECTION_FIELDS = [
    "serves_question", "related", "targets_gap", "reasoning_pattern", "expected_evidence", "seed_queries", "solves_when",
    "priority",
]
STATE_CHARS = 80_000
PAGE_CHARS = 3000
OMITTED = "... (additional pages omitted - total char cap reached)"
# End of the fixed values.


def priority_of(c: Column) -> Column:
    return F.coalesce(F.lower(first_match(strip(c), PRIORITY)), F.lit("medium"))


def engine_tags(c: Column) -> Column:
    return F.array_distinct(F.transform(all_matches(F.coalesce(c, F.lit("")), ENGINE_TAGS, 1), lambda t: F.lower(t)))


def _stem(path: Column) -> Column:
    return F.regexp_replace(F.substring_index(path, "/", -1), r"\.md$", "")


def gap_pages(pages: DataFrame) -> DataFrame:
    """Open gaps of ``pages(path, text)`` below a gap folder."""
    text, crlf = F.col("text"), fm.BLOCK_CRLF
    stem = _stem(F.col("path"))
    raw = pages.where(F.rlike(stem, F.lit("^GAP-"))).select(
        F.coalesce(fm.scalar(text, "id", crlf), F.upper(first_match(stem, r"(?i)^(GAP-\d+)")), stem).alias("id"),
        F.lower(F.coalesce(fm.scalar(text, "status", crlf), F.lit("open"))).alias("status"),
        F.coalesce(fm.scalar(text, "title", crlf), F.lit("")).alias("title"),
        F.array_join(fm.list_field(text, "shows_up_in", crlf), ", ").alias("shows_up_in"),
        prose.section(text, "Missing").alias("missing"),
        engine_tags(F.array_join(fm.list_field(text, "fillable_by", crlf), " ")).alias("fillable_by"),
        prose.concept_slugs(F.array_join(fm.list_field(text, "concepts", crlf), " ")).alias("concepts"),
        priority_of(F.coalesce(fm.scalar(text, "priority", crlf), F.lit(""))).alias("priority"),
    )
    return raw.where(F.col("status") == "open").drop("status")


def seed_queries(body: Column) -> Column:
    """``array<struct<engine, query>>`` of the seed list; blank queries drop out."""
    items = F.transform(
        F.filter(F.transform(lines_of(prose.section(body, "seed_queries")), strip), lambda x: F.startswith(x, F.lit("- "))),
        lambda x: strip(F.substring(x, 3, 1 << 30)),
    )
    read = F.transform(
        items,
        lambda x: F.struct(
            F.lower(first_match(x, SEED_TAG, 1)).alias("engine"),
            prose.clean_query_text(F.coalesce(first_match(x, SEED_TAG, 2), x)).alias("query"),
        ),
    )
    return F.filter(read, lambda q: q["query"] != "")


def direction_pages(pages: DataFrame) -> DataFrame:
    """Open directions of ``pages(path, text)``."""
    text, crlf = F.col("text"), fm.BLOCK_CRLF
    stem = _stem(F.col("path"))
    body = fm.body(text, crlf)
    raw = pages.where(F.rlike(stem, F.lit("^DIR-"))).select(
        F.coalesce(fm.scalar(text, "id", crlf), stem).alias("id"),
        F.lower(F.coalesce(fm.scalar(text, "status", crlf), F.lit(""))).alias("status"),
        nonblank(F.transform(F.split(F.coalesce(fm.scalar(text, "serves_question", crlf), F.lit("")), ","), strip)).alias("serves_question"),
        prose.concept_slugs(F.coalesce(fm.scalar(text, "related", crlf), F.array_join(fm.list_field(text, "related", crlf), " "))).alias("concepts"),
        F.coalesce(fm.scalar(text, "targets_gap", crlf), F.lit("")).alias("targets_gap"),
        priority_of(F.coalesce(fm.scalar(text, "priority", crlf), F.lit(""))).alias("priority"),
        seed_queries(body).alias("seed_queries"),
        prose.section(body, "expected_evidence").alias("expected_evidence"),
        prose.section(body, "solves_when").alias("solves_when"),
    )
    return raw.where(F.col("status") == "open").drop("status").withColumn(
        "engines", F.array_compact(F.array_distinct(F.transform("seed_queries", lambda q: q["engine"])))
    )


def analysis_gaps(analyses: DataFrame) -> DataFrame:
    """One row per ``### GAP-n: title`` block of ``analyses(analysis_id, text)``."""
    part = F.regexp_extract("text", r"(?ms)^##\s+Knowledge Gaps\s*?$(.*?)(?=^##\s|\z)", 1)
    pieces = F.filter(
        F.split(F.concat(F.lit("\n"), part), r"\n(?=###\s+GAP-)"), lambda b: F.rlike(b, F.lit(r"^###\s+GAP-\d+:\s*\S"))
    )
    found = analyses.select("analysis_id", F.explode_outer(pieces).alias("block")).where(present("block"))

    def field(name: str) -> Column:
        return strip(F.regexp_extract("block", rf"(?ms)^-\s+{name}:\s*(.+?)(?=\n-\s+\w|\z)", 1))

    concepts_raw = F.coalesce(blank_to_null(field("concepts")), field("topic"))
    linked = prose.concept_slugs(concepts_raw)
    bare = F.array_distinct(all_matches(F.lower(concepts_raw), BARE_SLUG, 0))
    ranked = field("priority")
    return found.select(
        "analysis_id",
        F.regexp_extract("block", r"^###\s+(GAP-\d+):", 1).alias("id"),
        strip(F.regexp_extract("block", r"^###\s+GAP-\d+:\s*([^\n]+)", 1)).alias("title"),
        nonblank(F.transform(F.split(field("shows_up_in"), ";"), strip)).alias("shows_up_in"),
        field("missing").alias("missing"),
        engine_tags(field("fillable_by")).alias("fillable_by"),
        F.when(F.size(linked) > 0, linked).otherwise(bare).alias("concepts"),
        priority_of(ranked).alias("priority"),
        F.when(F.rlike(ranked, F.lit(PRIORITY)), F.regexp_replace(strip(F.regexp_replace(ranked, PRIORITY, "")), r"^[-\s]+", ""))
        .otherwise(F.lit("")).alias("why"),
    )


def analysis_sections(analyses: DataFrame) -> DataFrame:
    """The named sections of an analysis; a closing READY mark is dropped."""
    def part(heading: str, ready: bool = True) -> Column:
        text = strip(F.regexp_extract("text", rf"(?ms)^##\s+{heading}[^\n]*\n(.*?)(?=^##\s+|\z)", 1))
        return strip(F.regexp_replace(text, r"\n*\bREADY\s*$", "")) if ready else text

    return analyses.select(
        "analysis_id", part("Coverage Map").alias("coverage_map"), part("Stale / Unverified").alias("stale"),
        part("Self-contained").alias("self_contained"), part("Open-Question Harvest", False).alias("open_questions"),
    )


def valid_analysis(text: Column) -> Column:
    """The gaps section is there and the last line is READY."""
    last = strip(F.regexp_extract(strip(text), r"([^\n]*)\z", 1))
    return F.contains(text, F.lit("## Knowledge Gaps")) & (last == "READY")


def gap_bullets(entries: Column) -> Column:
    """Bullets of the places a gap shows up in, link first, then its remark."""
    pattern = r"(?s)^.*?(\[\[[^\]]+\]\])(.*)$"

    def bullet(e: Column) -> Column:
        link = F.regexp_extract(e, pattern, 1)
        after = strip(F.regexp_extract(e, pattern, 2))
        return (
            F.when(link == "", F.concat(F.lit("- "), e))
            .when(after == "", F.concat(F.lit("- "), link))
            .otherwise(F.concat(F.lit("- "), link, F.lit(" -- "), after))
        )

    return F.array_join(F.transform(entries, bullet), "\n")


def gap_files(gaps: DataFrame, existing: DataFrame, today: Column) -> DataFrame:
    """``(analysis_id, path, text)`` of every analysed gap's page; a known page keeps its creation day."""
    path = F.concat(F.lit("wiki/gap/"), F.col("id"), F.lit("-"), prose.gap_slug("title"), F.lit(".md"))
    day = F.date_format(today, "yyyy-MM-dd")
    old = existing.select("path", fm.scalar("text", "created").alias("was_created"))
    placed = gaps.withColumn("path", path).join(old, "path", "left")
    concepts = F.array_join(F.transform("concepts", lambda c: F.concat(F.lit('"[[wiki/concepts/'), c, F.lit(']]"'))), ", ")
    text = F.concat(
        F.lit("---\ntype: gap\nid: "), F.col("id"), F.lit("\ntitle: "), F.col("title"), F.lit("\nstatus: open\npriority: "),
        F.col("priority"), F.lit("\nconcepts: ["), concepts, F.lit("]\nfillable_by: ["), F.array_join("fillable_by", ", "),
        F.lit("]\ncreated: "), F.coalesce("was_created", day), F.lit("\nupdated: "), day,
        F.lit("\n---\n\n## Missing\n"), F.col("missing"), F.lit("\n\n## Why\n"), F.col("why"),
        F.lit("\n\n## Shows up in\n"), gap_bullets(F.col("shows_up_in")), F.lit("\n"),
    )
    return placed.select("analysis_id", "path", text.alias("text"))


def synthesis_directions(texts: DataFrame) -> DataFrame:
    """One row per ``### DIRECTION:`` block of ``texts(text_id, text)`` with its known fields."""
    pieces = F.filter(
        F.split(F.concat(F.lit("\n"), F.col("text")), r"\n(?=### DIRECTION:|## )"),
        lambda b: F.startswith(b, F.lit("### DIRECTION:")),
    )
    found = texts.select("text_id", F.posexplode_outer(pieces).alias("pos", "block")).where(present("pos"))

    def field(name: str) -> Column:
        spelled = name.replace("_", "[ _]")
        hits = all_matches("block", rf"(?im)^[ \t]*-*[ \t]*{spelled}[ \t]*:[ \t]*([^\n]*?)[ \t]*$", 1)
        return F.coalesce(F.try_element_at(hits, F.lit(-1)), F.lit("")).alias(name)

    return found.select(
        "text_id", F.col("pos").cast("bigint").alias("pos"),
        strip(F.regexp_extract("block", r"^### DIRECTION:([^\n]*)", 1)).alias("title"),
        *[field(n) for n in DIRECTION_FIELDS],
    )


def synthesis_proposals(texts: DataFrame) -> DataFrame:
    """``(text_id, pos, fields)``: proposal lines of the proposals section."""
    part = F.regexp_extract("text", r"(?ms)^\s*## Proposed New Research Questions[^\n]*$(.*?)(?=^\s*## |\z)", 1)
    lines = F.transform(lines_of(part), lambda x: strip(F.regexp_replace(strip(x), "^-+", "")))
    kept = F.filter(lines, lambda x: F.startswith(F.lower(x), F.lit("proposal:")))

    def fields(line: Column) -> Column:
        pairs = F.filter(F.split(line, r"\|"), lambda p: F.contains(p, F.lit(":")))
        entries = F.transform(
            pairs,
            lambda p: F.struct(
                F.lower(strip(F.substring_index(p, ":", 1))).alias("key"), strip(F.regexp_extract(p, r"^[^:]*:(.*)$", 1)).alias("value")
            ),
        )
        return bind(entries, fm.last_wins)

    found = texts.select("text_id", F.posexplode_outer(F.transform(kept, fields)).alias("pos", "fields")).where(present("pos"))
    return found.where(F.coalesce(F.try_element_at("fields", F.lit("proposal")), F.lit("")) != "")


def reformulated_queries(replies: DataFrame) -> DataFrame:
    """``(reply_id, target_id, queries, rationale)`` of model replies.

    A reply is a JSON object, fenced or bare; any entry of a wrong shape rejects
    the whole reply.
    """
    fenced = first_match("reply", r"(?s)```(?:json)?\s*(\{.*?\})\s*```")
    bare = first_match("reply", r"(?s)(\{.*\})")
    read = replies.select("reply_id", F.from_json(F.coalesce(fenced, bare), "map<string,string>").alias("targets"))
    shaped = F.transform_values(
        "targets",
        lambda _, v: F.struct(
            F.from_json(v, "struct<queries_by_engine:map<string,array<string>>,rationale:string>").alias("p"),
            F.from_json(F.get_json_object(v, "$.queries_by_engine"), "map<string,string>").alias("raw"),
        ),
    )
    bad = F.exists(
        F.map_values("shaped"),
        lambda v: v["raw"].isNull() | F.exists(F.map_values(v["raw"]), lambda q: ~F.rlike(F.coalesce(q, F.lit("")), F.lit(r"^\s*\["))),
    )
    good = read.where(F.col("targets").isNotNull()).withColumn("shaped", shaped).where(~bad)
    return good.select("reply_id", F.explode_outer("shaped").alias("target_id", "v")).where(present("target_id")).select(
        "reply_id", "target_id", F.col("v.p.queries_by_engine").alias("queries"), F.coalesce("v.p.rationale", F.lit("")).alias("rationale")
    )


# ---- wiki state for a gap analysis --------------------------------------------


def page_entries(pages: DataFrame) -> DataFrame:
    """``(path, oq_count, entry)``: header, sections and excerpt of every page."""
    head = r"(?s)\A\s*---.*?\n---"
    body = F.regexp_replace(F.regexp_replace("text", head, ""), r"^\s+", "")
    read = pages.select("path", body.alias("body")).select(
        "path", "body", prose.section_starting("body", "for future claude").alias("ffc"),
        prose.section_starting("body", "open questions").alias("oq"),
    )
    entry = F.concat_ws(
        "\n\n",
        F.concat(F.lit("### [["), "path", F.lit("]]")),
        F.when(F.col("ffc") != "", F.concat(F.lit("#### For future Claude\n"), "ffc")),
        F.when(F.col("oq") != "", F.concat(F.lit("#### Open Questions\n"), "oq")),
        blank_to_null(strip(F.substring("body", 1, PAGE_CHARS))),
    )
    count = F.when(F.col("oq") == "", F.lit(0)).otherwise(prose.bullet_count("oq")).cast("bigint")
    return read.select("path", count.alias("oq_count"), entry.alias("entry"))


def state_pages(entries: DataFrame, cap: int = STATE_CHARS) -> DataFrame:
    """The pages that fit the character cap, most open questions first.

    The report stops at the first entry that would pass the cap. An entry holds
    its header, ``### [[]]`` at least, so at most ``cap / 8`` entries can fit:
    that many are taken by a top-k and only those are summed up in order.
    """
    from pyspark.sql.window import Window

    most = cap // len("### [[]]") + 1
    top = entries.orderBy(F.col("oq_count").desc(), "path").limit(most)
    upto = Window.partitionBy(F.lit(0)).orderBy(F.col("oq_count").desc(), "path").rowsBetween(Window.unboundedPreceding, 0)
    summed = top.withColumn("chars", F.length("entry").cast("bigint")).withColumn("running", F.sum("chars").over(upto))
    return summed.where(F.col("running") <= cap).select("path", "oq_count", "chars", "running", "entry")


def question_totals(entries: DataFrame) -> DataFrame:
    return entries.agg(F.sum("oq_count").alias("open_questions"), F.count(F.lit(1)).alias("pages"))


def concept_lines(pages: DataFrame) -> DataFrame:
    """``- slug: summary`` of concept pages; the summary is the first prose line."""
    body = fm.body("text")
    lines = F.filter(F.transform(lines_of(body), strip), lambda x: (x != "") & ~F.startswith(x, F.lit("#")))
    stem = _stem(F.col("path"))
    return pages.where(~F.startswith(stem, F.lit("_template"))).select(
        "path", F.concat(F.lit("- "), stem, F.lit(": "), F.coalesce(F.get(lines, F.lit(0)), stem)).alias("line")
    )


# ---- report headers -----------------------------------------------------------


def output_path(question: Column, concept: Column, topic: Column, today: Column) -> Column:
    """Where a report goes: by question, concept or topic; none is an error."""
    return (
        F.when(blank_to_null(question).isNotNull(), F.concat(F.lit("research/"), question, F.lit(".md")))
        .when(blank_to_null(concept).isNotNull(), F.concat(F.lit("research/"), prose.report_slug(concept), F.lit(".md")))
        .when(
            blank_to_null(topic).isNotNull(),
            F.concat(F.lit("research/deep/"), F.date_format(today, "yyyy-MM-dd"), F.lit("-"), prose.report_slug(topic), F.lit(".md")),
        )
        .otherwise(F.raise_error(F.lit("scope names no question, concept or topic")))
    )


def related_block(slugs: Column) -> Column:
    lines = F.transform(slugs, lambda s: F.concat(F.lit('  - "[[wiki/concepts/'), s, F.lit(']]"')))
    return F.when(F.size(slugs) == 0, F.lit("related: []")).otherwise(F.concat(F.lit("related:\n"), F.array_join(lines, "\n")))


def report_header(title: Column, question: Column, slugs: Column, today: Column) -> Column:
    return F.concat(
        F.lit("---\ntype: research-report\ntitle: "), title, F.lit("\nserves_question: "), question, F.lit("\n"),
        related_block(slugs), F.lit("\ncreated: "), F.date_format(today, "yyyy-MM-dd"), F.lit("\nstatus: draft\nwritten_by: research\n---\n"),
    )


def direction_header(ident: Column, title: Column, question: Column, priority: Column, slugs: Column, today: Column) -> Column:
    day = F.date_format(today, "yyyy-MM-dd")
    return F.concat(
        F.lit("---\ntype: direction\nid: "), ident, F.lit("\ntitle: "), title, F.lit("\nserves_question: "), question,
        F.lit("\npriority: "), priority_of(priority), F.lit("\nstatus: open\n"), related_block(slugs),
        F.lit("\ncreated: "), day, F.lit("\nupdated: "), day, F.lit("\nwritten_by: research\n---\n"),
    )


def proposal_header(ident: Column, slugs: Column, today: Column) -> Column:
    day = F.date_format(today, "yyyy-MM-dd")
    return F.concat(
        F.lit("---\ntype: research_question_proposal\nid: "), ident, F.lit("\nstatus: pending\n"), related_block(slugs),
        F.lit("\ncreated: "), day, F.lit("\nupdated: "), day, F.lit("\nwritten_by: research\n---\n"),
    )


def answerable(items: Column) -> Column:
    """Already answerable questions, without blanks and ``none``."""
    return F.filter(F.transform(items, strip), lambda x: ~F.lower(x).isin("", "none"))
