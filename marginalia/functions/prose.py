"""Chunks, sections, links, slugs and summaries of page text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marginalia.functions.basics import (
    all_matches,
    bind,
    blank_to_null,
    col,
    first_match,
    lines_of,
    nonblank,
    strip,
)

# Sizes, patterns and texts that must agree with the published
# behaviour.
CHUNK_CHARS = 2000
CHUNK_OVERLAP = 200
CACHE_FLOOR_CHARS = 16384
LINK_PATTERN = r"\[\[([^\]|#]+)"
CONCEPT_LINK_PATTERN = r"(?i)\[\[\s*(?:wiki/)?concepts/([^\]|#]+?)\s*(?:[|#][^\]]*)?\]\]"
NODE_ID_PATTERN = r"\b(?:QP|DIR|Q|T|D|TODO)-\d{4}\b"
INLINE_TAG_PATTERN = r"(?:^|\s)#([A-Za-z][\w/-]*)"
NO_SUMMARY = "No abstract/snippet retrieved -- fetch the URL to summarize."
# End of the fixed values.


def chunk_texts(body: Column | str, size: int = CHUNK_CHARS, overlap: int = CHUNK_OVERLAP) -> Column:
    """Overlapping chunks of a page body, cut at paragraph ends.

    Paragraphs are folded into an open chunk; once it reaches ``size`` it is
    emitted and its last ``overlap`` characters open the next one.
    """
    paragraphs = nonblank(F.transform(F.split(col(body), r"\n\s*\n"), strip))
    start = F.struct(
        F.expr("cast(array() as array<string>)").alias("done"),
        F.lit(None).cast("string").alias("open"),
        F.lit(0).alias("length"),
    )

    def step(acc: Column, p: Column) -> Column:
        joined = F.concat_ws("\n\n", acc["open"], p)
        return bind(
            F.struct(joined.alias("text"), (acc["length"] + F.length(p) + 2).alias("length")),
            lambda s: F.when(
                s["length"] >= size,
                bind(
                    F.right(s["text"], F.lit(overlap)) if overlap else F.lit(""),
                    lambda tail: F.struct(
                        F.concat(acc["done"], F.array(s["text"])).alias("done"),
                        blank_to_null(tail).alias("open"),
                        F.length(tail).alias("length"),
                    ),
                ),
            ).otherwise(F.struct(acc["done"].alias("done"), s["text"].alias("open"), s["length"].alias("length"))),
        )

    def finish(acc: Column) -> Column:
        leftover = F.coalesce(strip(acc["open"]), F.lit("")) != ""
        return F.when(leftover, F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"])

    return F.aggregate(paragraphs, start, step, finish)


def sentences_of(c: Column | str) -> Column:
    return nonblank(F.transform(F.split(col(c), r"(?<=[.!?])\s+"), strip))


def first_sentence(c: Column | str) -> Column:
    return F.element_at(F.split(strip(c), r"(?<=[.!?])\s+", 2), 1)


def page_prefix(title: Column, body: Column) -> Column:
    """Sentence that sets a chunk in the frame of its page."""
    named = F.coalesce(blank_to_null(strip(title)), F.lit("(untitled)"))
    return F.concat(
        F.lit('This passage is from the wiki page "'),
        named,
        F.lit('". The page opens: '),
        F.substring(first_sentence(body), 1, 300),
    )


def snippet(c: Column | str, size: int = 200) -> Column:
    text = col(c)
    return F.when(F.length(text) <= size, text).otherwise(
        F.concat(F.regexp_replace(F.substring(text, 1, size), r"\s+$", ""), F.lit("…"))
    )


def link_target(c: Column) -> Column:
    """Last path part of a link."""
    return strip(F.substring_index(strip(c), "/", -1))


def wiki_links(c: Column | str) -> Column:
    """Link targets of a page, repeats kept, reduced to page stems."""
    return F.transform(all_matches(c, LINK_PATTERN, 1), link_target)


def raw_links(c: Column | str) -> Column:
    return F.transform(all_matches(c, LINK_PATTERN, 1), strip)


def concept_slugs(c: Column | str) -> Column:
    return F.array_distinct(nonblank(F.transform(all_matches(F.coalesce(col(c), F.lit("")), CONCEPT_LINK_PATTERN, 1), strip)))


def inline_tags(c: Column | str) -> Column:
    return all_matches(c, INLINE_TAG_PATTERN, 1)


def ids_in_text(c: Column | str, pattern: str) -> Column:
    """Distinct ids in order of first appearance."""
    return F.array_distinct(all_matches(c, pattern, 0))


def inline_list(c: Column | str) -> Column:
    """Items of ``[a, b]`` or ``a, b``."""
    inner = F.regexp_replace(strip(c), r"^\[(.*)\]$", "$1")
    return nonblank(F.transform(F.split(inner, ","), strip))


def quoted_list(c: Column | str) -> Column:
    """As :func:`inline_list`, quotes stripped from every item."""
    inner = F.coalesce(first_match(strip(c), r"^\[([^\]]*)\]"), F.regexp_replace(strip(c), r"^\[\].*$", ""))
    return nonblank(F.transform(F.split(inner, ","), lambda x: F.regexp_replace(strip(x), "^[\"']+|[\"']+$", "")))


def normal_stem(c: Column | str) -> Column:
    """Stem without dates, case and punctuation, for duplicate detection."""
    undated = F.lower(F.regexp_replace(col(c), r"\d{4}-\d{2}-\d{2}", ""))
    return strip(F.regexp_replace(F.regexp_replace(undated, "[^a-z0-9 ]", " "), r"\s+", " "))


def section(c: Column | str, heading: str) -> Column:
    """Text below ``## heading`` up to the next ``## ``; empty when absent."""
    escaped = heading.replace(" ", r"\s")
    return strip(F.regexp_extract(col(c), rf"(?ms)^##[ \t]+{escaped}[ \t]*$(.*?)(?=^##\s|\z)", 1))


def section_starting(c: Column | str, heading: str) -> Column:
    """As :func:`section`, the heading may go on after ``heading``, in any case."""
    return strip(F.regexp_extract(col(c), rf"(?ims)^\s*## {heading}[^\n]*$(.*?)(?=^## |\z)", 1))


def bullet_count(c: Column | str) -> Column:
    return F.size(F.filter(lines_of(c), lambda x: F.rlike(x, F.lit(r"^\s*[-*+]")))).cast("bigint")


def first_heading(c: Column | str) -> Column:
    return first_match(c, r"(?m)^# +(.*?)[ \t]*$")


def stem_title(stem: Column) -> Column:
    return F.initcap(F.regexp_replace(stem, "[-_]", " "))


def clean_query_text(c: Column | str) -> Column:
    """Query phrase without links, citation marks and emphasis."""
    aliased = F.regexp_replace(col(c), r"\[\[[^\]]*\|([^\]|]*)\]\]", "[[$1]]")
    plain = F.regexp_replace(aliased, r"\[\[(?:[^\]]*/)?([^\]/]*)\]\]", "$1")
    linked = F.regexp_replace(plain, r"\[([^\]]*)\]\([^)]*\)", "$1")
    uncited = F.regexp_replace(linked, r"\[[\d\s,\-]+\]", " ")
    bare = F.regexp_replace(uncited, "[*_`#>]+", " ")
    return strip(F.regexp_replace(bare, r"\s+", " "))


def gap_queries(title: Column, missing: Column) -> Column:
    """Title and first clause of what is missing, cleaned, without repeats."""
    clause = F.element_at(F.split(strip(missing), "[;.]", 2), 1)
    return F.array_distinct(nonblank(F.array(clean_query_text(title), clean_query_text(clause))))


def plain_text(c: Column | str) -> Column:
    """Markup removed and blanks collapsed."""
    return strip(F.regexp_replace(F.regexp_replace(col(c), r"<[^>]+>", ""), r"\s+", " "))


def content_rationale(text: Column, lane: Column, origins: Column) -> Column:
    """First sentence within 220 characters, else a cut, else where it came from."""
    origin = F.coalesce(blank_to_null(F.array_join(origins, ", ")), F.lit("n/a"))

    def cut(clean: Column) -> Column:
        head = F.substring(clean, 1, 220)
        ended = first_match(head, r"(?s)^(.*?[.!?])(?=\s|$)")
        shortened = F.coalesce(strip(ended), F.concat(F.regexp_replace(head, r"\s+$", ""), F.lit("...")))
        return (
            F.when(clean == "", F.concat(F.lit("lane="), lane, F.lit("; serves "), origin))
            .when(F.length(clean) > 220, shortened)
            .otherwise(clean)
        )

    return bind(plain_text(F.coalesce(text, F.lit(""))), cut)


def content_summary(text: Column) -> Column:
    """Whole text up to 200 words, else its first sentence within them."""
    def cut(clean: Column) -> Column:
        def by_words(words: Column) -> Column:
            head = F.array_join(F.slice(words, 1, 200), " ")
            ended = first_match(head, r"(?s)^(.*?[.!?])(?=\s|$)")
            shortened = F.coalesce(strip(ended), F.concat(F.regexp_replace(head, "[,;:]+$", ""), F.lit("...")))
            return (
                F.when(F.size(words) < 5, F.lit(NO_SUMMARY))
                .when(F.size(words) > 200, shortened)
                .otherwise(clean)
            )

        return F.when(clean == "", F.lit(NO_SUMMARY)).otherwise(bind(F.split(clean, " "), by_words))

    return bind(plain_text(F.coalesce(text, F.lit(""))), cut)


def relevance_paragraph(lane, origins, evidence, score, engine, source_id) -> Column:
    origin = F.coalesce(blank_to_null(F.array_join(origins, ", ")), F.lit("n/a"))
    sought = F.regexp_replace(
        F.coalesce(blank_to_null(strip(evidence)), F.lit("evidence to close this gap")), r"\.+$", ""
    )
    return F.concat(
        F.lit("Selected for the "), strip(lane), F.lit(" lane to serve "), origin,
        F.lit(". The web agent sought: "), sought,
        F.lit(". Ranked by semantic relevance to the vault PURPOSE (score "),
        F.format_string("%.3f", score),
        F.lit("); retrieved via "), strip(engine), F.lit(" from "), strip(source_id), F.lit("."),
    )


def slug(c: Column | str, size: int, empty: str = "", ascii_only: bool = False, trim_after: bool = True) -> Column:
    """Lower-case hyphenated slug of at most ``size`` characters."""
    text = F.lower(col(c))
    if ascii_only:
        text = F.regexp_replace(text, r"[^\x00-\x7F]", "")
    hyphened = F.regexp_replace(F.regexp_replace(text, "[^a-z0-9]+", "-"), "^-+|-+$", "")
    short = F.substring(hyphened, 1, size)
    if trim_after:
        short = F.regexp_replace(short, "-+$", "")
    return F.coalesce(blank_to_null(short), F.lit(empty))


def gap_slug(c: Column | str) -> Column:
    return slug(c, 45)


def report_slug(c: Column | str) -> Column:
    return slug(c, 60, empty="untitled", ascii_only=True, trim_after=False)


def node_slug(c: Column | str) -> Column:
    return slug(c, 40, empty="item")


def article_slug(url: Column) -> Column:
    """Slug of the last path part of an address, else of its host."""
    path = F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), "/+$", "")
    host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    addressed = F.coalesce(blank_to_null(F.substring_index(path, "/", -1)), host)
    stem = F.regexp_replace(F.substring_index(url, "/", -1), r"(?<=.)\.[^.]*$", "")
    return slug(F.when(host != "", addressed).otherwise(stem), 80, empty="article", trim_after=False)


def written_by_for(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.when(
        F.get(parts, F.lit(0)) == "research",
        F.when(F.get(parts, F.lit(1)) == "notes", F.lit("USER")).otherwise(F.lit("research")),
    ).otherwise(F.lit("wiki"))


def gap_bullets(links: Column, descriptor: Column) -> Column:
    return F.array_join(F.transform(links, lambda x: F.concat(F.lit("- [["), x, F.lit("]]"), descriptor)), "\n")


def linkify(text: Column, paths: Column) -> Column:
    """Wrap bare node ids of ``paths`` (``array<struct<id, path>>``) in links.

    The text is cut into links, ids and the rest in one pass; links stay as they
    are and ids without a page stay bare.
    """
    node = NODE_ID_PATTERN
    pieces = all_matches(text, rf"(?s)\[\[[^\]]*\]\]|{node}|(?:(?!\[\[|{node}).)+|.", 0)

    def joined(known: Column) -> Column:
        def linked(piece: Column) -> Column:
            path = F.try_element_at(known, piece)
            return F.when(path.isNotNull(), F.concat(F.lit("[["), path, F.lit("]]"))).otherwise(piece)

        return F.array_join(F.transform(pieces, linked), "")

    return bind(F.map_from_entries(paths), joined)
