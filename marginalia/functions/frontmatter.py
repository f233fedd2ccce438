"""Frontmatter readers.

Pages carry a small key/value block between ``---`` lines. Every flavour below
is a fold over the block's lines in built-in expressions; the result is a
``map<string,string>`` (scalars) or ``map<string,array<string>>`` (lists).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marginalia.functions.basics import bind, blank_to_null, col, first_match, lines_of, nonblank, strip

BLOCK = r"(?s)\A---\s*\n(.*?)\n---\s*\n"
BLOCK_AT_END = r"(?s)\A---\n(.*?)\n---(?:\n|$)"
BLOCK_CRLF = r"(?s)\A---\r?\n(.*?)\r?\n---(?:\r?\n|$)"


def block(text: Column | str, pattern: str = BLOCK_AT_END) -> Column:
    return F.replace(F.regexp_extract(col(text), pattern, 1), F.lit("\r\n"), F.lit("\n"))


def body(text: Column | str, pattern: str = BLOCK_AT_END) -> Column:
    return F.regexp_replace(col(text), pattern, "")


def _key(line: Column) -> Column:
    return strip(F.regexp_extract(line, r"^([^:]*):", 1))


def _value(line: Column) -> Column:
    return strip(F.regexp_extract(line, r"^[^:]*:(.*)$", 1))


def unquote_pair(v: Column) -> Column:
    """Drop one matching pair of quotes."""
    return F.regexp_replace(v, "^([\"'])(.*)\\1$", "$2")


def unquote_all(v: Column) -> Column:
    return F.regexp_replace(v, "^[\"']+|[\"']+$", "")


def last_wins(pairs: Column) -> Column:
    """Map of key/value structs in which a later line replaces an earlier one."""
    kept = F.filter(
        pairs,
        lambda p, i: ~F.exists(
            F.slice(pairs, i + 2, F.greatest(F.size(pairs) - i - 1, F.lit(0))), lambda q: q["key"] == p["key"]
        ),
    )
    return F.map_from_entries(kept)


def scalars(text: Column | str, pattern: str = BLOCK_AT_END, quotes: str = "pair", lower_keys: bool = True) -> Column:
    """Flat string map: one entry per ``key: value`` line that is no comment."""
    unquote = {"pair": unquote_pair, "all": unquote_all, "none": lambda v: v}[quotes]

    def entry(line: Column) -> Column:
        key = F.lower(_key(line)) if lower_keys else _key(line)
        return F.struct(key.alias("key"), unquote(_value(line)).alias("value"))

    entries = F.transform(F.filter(lines_of(block(text, pattern)), lambda x: F.rlike(x, F.lit(r"^\s*[^#\s][^:]*:|^:"))), entry)
    return bind(entries, last_wins)


def scalar(text: Column | str, key: str, pattern: str = BLOCK_AT_END) -> Column:
    """One scalar field without building the map; of repeated lines the last one counts."""
    found = F.regexp_extract_all(block(text, pattern), F.lit(rf"(?mi)^[ \t]*{key}\s*:[ \t]*([^\n]*)$"), F.lit(1))
    value = strip(F.coalesce(F.try_element_at(found, F.lit(-1)), F.lit("")))
    return blank_to_null(unquote_all(value))


def list_field(text: Column | str, key: str, pattern: str = BLOCK) -> Column:
    """Items of a flow list, a block list or a single scalar field."""
    inner = block(text, pattern)
    flow = F.regexp_extract(inner, rf"(?m)^{key}[ \t]*:[ \t]*\[(.*)\][ \t]*$", 1)
    blocked = F.regexp_extract(inner, rf"(?m)^{key}[ \t]*:[ \t]*\n((?:[ \t]+-[^\n]*(?:\n|\z))+)", 1)
    plain = F.regexp_extract(inner, rf"(?m)^{key}[ \t]*:[ \t]*([^\[\s][^\n]*)$", 1)

    def cleaned(items: Column) -> Column:
        return nonblank(F.transform(items, lambda x: unquote_all(strip(x))))

    return (
        F.when(flow != "", cleaned(F.split(flow, ",")))
        .when(blocked != "", cleaned(F.transform(F.split(blocked, "\n"), lambda x: F.regexp_replace(x, r"^\s*-", ""))))
        .otherwise(nonblank(F.split(unquote_all(plain), r"[,\s]+")))
    )


def keys(text: Column | str) -> Column:
    """Distinct top-level keys of the block that ends at the first ``---``."""
    inner = F.regexp_extract(col(text), r"(?s)\A---(.*?)---", 1)
    tops = F.filter(lines_of(inner), lambda x: F.rlike(x, F.lit(r"^[A-Za-z_][^:]*:(\s|$)")))
    return F.array_distinct(F.transform(tops, _key))


def chunk_header(text: Column | str) -> Column:
    """``struct<address, title>`` read by the chunker."""
    inner = block(text, r"(?s)\A---\n(.*?)\n---\n")
    return F.struct(
        first_match(inner, r"(?m)^address:\s*(c-\d{6})\s*$").alias("address"),
        first_match(inner, r"(?m)^title:\s*['\"]?(.+?)['\"]?\s*$").alias("title"),
    )


def next_id_counters(text: Column | str) -> Column:
    """Counters nested below ``next_id:`` as ``map<string,bigint>``."""
    inner = F.regexp_extract(block(text), r"(?m)^next_id:\s*\n((?:  [^\n]+(?:\n|\z))*)", 1)
    entries = F.filter(F.split(inner, "\n"), lambda x: F.rlike(x, F.lit(r"^\s*[^:]+:\s*-?\d+\s*$")))
    return F.map_from_entries(
        F.transform(
            entries,
            lambda x: F.struct(_key(x).alias("key"), F.try_to_number(_value(x), F.lit("S9999999999999")).cast("bigint").alias("value")),
        )
    )


def rewrite(text: Column | str, updates: dict[str, Column | None], pattern: str = BLOCK_AT_END) -> Column:
    """Set, replace or drop (``None``) keys; other lines and the body stay."""
    source = col(text)
    inner = block(source, pattern)
    rest = F.regexp_replace(source, pattern, "")

    def names(line: Column, key: str) -> Column:
        field = F.contains(line, F.lit(":")) & ~F.rlike(line, F.lit(r"^\s*#"))
        return field & (F.lower(_key(line)) == key)

    def without(lines: Column, key: str) -> Column:
        return F.filter(lines, lambda x: ~names(x, key))

    def with_value(lines: Column, key: str, new: Column) -> Column:
        present = F.exists(lines, lambda x: names(x, key))
        replaced = F.transform(lines, lambda x: F.when(names(x, key), new).otherwise(x))
        return F.when(present, replaced).otherwise(F.concat(lines, F.array(new)))

    kept = lines_of(inner)
    for key, value in updates.items():
        if value is None:
            kept = without(kept, key.lower())
        else:
            kept = with_value(kept, key.lower(), F.concat(F.lit(f"{key}: "), value))
    joined = F.concat(F.lit("---\n"), F.array_join(kept, "\n"), F.lit("\n---\n"), rest)
    return F.when(F.rlike(source, F.lit(pattern)), joined).otherwise(source)
