"""Nested frontmatter as VARIANT: maps in maps, lists of maps, typed scalars; and a canonical form that reads back the same.

The header's lines become events (a key or a list item, its indentation, its scalar), and one fold over the events keeps a stack of open
maps and lists and writes the header as JSON, which ``try_parse_json`` makes a VARIANT. Typed fields are read by ``variant_get`` paths.

Scalars are those of YAML 1.1: null, booleans (yes, no, on, off too), whole and decimal numbers, quoted and plain strings; a date is a
string that reads as a date. Values in brackets are JSON or one level of plain items. A header that is no such text (an
open bracket or quote, a colon inside a plain value, an item among keys, anchors, block scalars, a repeated key) is the empty map,
as is a page without one. The fold copies what it has written at each line, so headers should stay small, which a header is.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marginalia.functions.basics import bind, col, strip

# Plain scalars with a meaning, and where a header ends.
HEADER = r"(?s)\A---(.*?)---"
NULLS = r"^(?:~|null|Null|NULL)?$"
TRUE = r"^(?:yes|Yes|YES|true|True|TRUE|on|On|ON)$"
FALSE = r"^(?:no|No|NO|false|False|FALSE|off|Off|OFF)$"
INTEGER = r"^[-+]?(?:0|[1-9][0-9_]*)$"
DECIMAL = r"^[-+]?[0-9][0-9_]*\.[0-9_]*(?:[eE][-+][0-9]+)?$"
# End of the fixed values.
_KEY = r"""^("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^\s"'\[\]{}#&*!|>%@`,?-](?:.*?[^\s])??|-[^\s](?:.*?[^\s])??)\s*:(?:\s+(.*))?$"""
_BAD = "\u0000"
_STACK = "array<struct<indent: int, is_list: boolean, n: int>>"


def json_string(c: Column) -> Column:
    """A text as a JSON string."""
    escaped = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for char, letter in (("\n", "n"), ("\r", "r"), ("\t", "t")):
        escaped = F.replace(escaped, F.lit(char), F.lit("\\" + letter))
    return F.concat(F.lit('"'), F.regexp_replace(escaped, r"[\x00-\x1F]", " "), F.lit('"'))


def _matches(c: Column, pattern: str) -> Column:
    return F.rlike(c, F.lit(pattern))


def _quoted(c: Column) -> Column | None:
    """A quoted text as a JSON string; null if it is not quoted."""
    single = F.replace(F.regexp_extract(c, r"(?s)^'((?:[^']|'')*)'$", 1), F.lit("''"), F.lit("'"))
    return F.when(_matches(c, r"""^"(?:[^"\\]|\\.)*"$"""), c).when(_matches(c, r"^'(?:[^']|'')*'$"), json_string(single))


def _plain(c: Column) -> Column:
    """A scalar without brackets as JSON."""
    digits = F.regexp_replace(c, r"[+_]", "")
    return (
        F.when(_matches(c, NULLS), F.lit("null")).when(_matches(c, TRUE), F.lit("true")).when(_matches(c, FALSE), F.lit("false"))
        .when(_matches(c, INTEGER), digits).when(_matches(c, DECIMAL), F.regexp_replace(F.regexp_replace(c, "^[+]|_", ""), r"\.(?![0-9])", ".0"))
        .when(_quoted(c).isNotNull(), _quoted(c)).when(_matches(c, r"""^["'\[\]{}&*!|>%@`,]|:(?:\s|$)"""), F.lit(_BAD)).otherwise(json_string(c))
    )


def _items(inner: Column, each) -> Column:
    """Items of a bracket, as JSON joined by commas; a bad item spoils all."""
    found = F.transform(F.regexp_extract_all(F.concat(inner, F.lit(",")), F.lit(r"""\s*("(?:[^"\\]|\\.)*"[^,]*|'(?:[^']|'')*'[^,]*|[^,]*),"""), F.lit(1)), strip)
    parts = F.transform(F.when(strip(inner) == "", F.array().cast("array<string>")).otherwise(found), each)
    return F.when(F.exists(parts, lambda p: F.contains(p, F.lit(_BAD))), F.lit(_BAD)).otherwise(F.array_join(parts, ","))


def _member(c: Column) -> Column:
    key, value = F.regexp_extract(c, r"^([^:]+?)\s*:(?:\s+(.*))?$", 1), F.regexp_extract(c, r"^([^:]+?)\s*:(?:\s+(.*))?$", 2)
    return F.when(key == "", F.lit(_BAD)).otherwise(F.concat(F.coalesce(_quoted(key), json_string(key)), F.lit(":"), _plain(strip(value))))


def _wrapped(open_: str, inner: Column, close: str) -> Column:
    return bind(inner, lambda x: F.when(x == _BAD, F.lit(_BAD)).otherwise(F.concat(F.lit(open_), x, F.lit(close))))


def scalar_json(value: Column) -> Column:
    """JSON of what stands behind a colon or a dash."""
    bare = F.when(_matches(value, r"""^["']"""), F.regexp_replace(value, r"""^("(?:[^"\\]|\\.)*"|'(?:[^']|'')*')\s+#.*$""", "$1")).otherwise(F.regexp_replace(value, r"(?:^|\s+)#.*$", ""))
    inner = lambda v: v.substr(F.lit(2), F.length(v) - 2)
    # a number sign in JSON begins no comment
    whole = _matches(value, r"^[\[{]") & F.try_parse_json(value).isNotNull()
    return bind(
        F.when(whole, value).otherwise(strip(bare)),
        lambda v: F.when(_matches(v, r"^[\[{]") & F.try_parse_json(v).isNotNull(), v)
        .when(_matches(v, r"^\[[^\[\]{}]*\]$"), _wrapped("[", _items(inner(v), _plain), "]"))
        .when(_matches(v, r"^\{[^\[\]{}]*\}$"), _wrapped("{", _items(inner(v), _member), "}"))
        .otherwise(_plain(v)),
    )


def _event(indent: Column, item: bool, key: Column, value: Column) -> Column:
    return F.struct(indent.cast("int").alias("indent"), F.lit(item).alias("item"), key.cast("string").alias("key"), value.cast("string").alias("value"))


def _keyed(indent: Column, content: Column) -> Column:
    key, value = F.regexp_extract(content, _KEY, 1), strip(F.regexp_extract(content, _KEY, 2))
    empty = _matches(value, r"^(?:#.*)?$")
    return _event(indent, False, F.coalesce(_quoted(key), json_string(key)), F.when(~empty, scalar_json(value)))


def _events(line: Column) -> Column:
    """One or two events of a line; a line that is neither a key nor an item is a bad scalar."""
    def of(parts: Column) -> Column:
        indent, rest, content = parts["indent"], parts["rest"], parts["content"]
        inner = indent + F.length(rest) - F.length(content)
        none = F.lit(None).cast("string")
        item = (
            F.when(_matches(content, r"^(?:#.*)?$"), F.array(_event(indent, True, none, none)))
            .when(_matches(content, _KEY) & ~_matches(content, r"^[\[{]"), F.array(_event(indent, True, none, none), _keyed(inner, content)))
            .otherwise(F.array(_event(indent, True, none, F.when(_matches(content, r"^- "), F.lit(_BAD)).otherwise(scalar_json(content)))))
        )
        key = F.when(_matches(rest, _KEY), F.array(_keyed(indent, rest))).otherwise(F.array(_event(indent, False, F.lit('""'), F.lit(_BAD))))
        return F.when(_matches(rest, r"^-(?:\s|$)"), item).otherwise(key)

    rest = F.regexp_replace(line, r"^ +|\s+$", "")
    return bind(F.struct(F.length(F.regexp_extract(line, "^( *)", 1)).alias("indent"), rest.alias("rest"), F.regexp_replace(rest, r"^-\s*", "").alias("content")), of)


def _last(c: Column) -> Column:
    return F.element_at(c, -1)


def _closed(stack: Column) -> Column:
    return F.array_join(F.transform(F.reverse(stack), lambda x: F.when(x["is_list"], F.lit("]")).otherwise(F.lit("}"))), "")


def header_json(text: Column | str) -> Column:
    """The header as JSON text; ``{}`` if it is none."""
    lines = F.filter(F.split(F.replace(F.regexp_extract(col(text), HEADER, 1), F.lit("\r\n"), F.lit("\n")), "\n"), lambda x: ~_matches(x, r"^\s*(?:#.*)?$"))
    return bind(F.flatten(F.transform(lines, _events)), lambda e: F.when(F.size(e) == 0, F.lit("{}")).otherwise(_folded(e)))


def _folded(events: Column) -> Column:
    paired = F.transform(events, lambda x, i: F.struct(x.alias("cur"), F.get(events, i + 1).alias("next")))
    first = F.get(events, F.lit(0))
    entry = lambda indent, is_list, n: F.struct(indent.cast("int").alias("indent"), is_list.alias("is_list"), n.cast("int").alias("n"))
    start = F.struct(F.lit("{").alias("out"), F.array(entry(first["indent"], F.lit(False), F.lit(0))).cast(_STACK).alias("stack"), F.lit(True).alias("ok"))

    def step(s: Column, x: Column) -> Column:
        cur, after = x["cur"], x["next"]
        # open maps and lists that this line lies in: indentations grow along the stack
        stays = lambda c: (c["indent"] < cur["indent"]) | ((c["indent"] == cur["indent"]) & ~(c["is_list"] & ~cur["item"]))

        def placed(kept: Column) -> Column:
            top = _last(kept)
            fits = F.coalesce((top["indent"] == cur["indent"]) & (top["is_list"] == cur["item"]), F.lit(False))
            inside = F.coalesce((after["indent"] > cur["indent"]) | ((after["indent"] == cur["indent"]) & after["item"] & ~cur["item"]), F.lit(False))
            opens = cur["value"].isNull() & inside
            value = F.when(opens, F.when(after["item"], F.lit("[")).otherwise(F.lit("{"))).otherwise(F.coalesce(cur["value"], F.lit("null")))
            piece = F.concat(
                _closed(F.slice(s["stack"], F.size(kept) + 1, F.size(s["stack"]))), F.when(top["n"] > 0, F.lit(",")).otherwise(F.lit("")),
                F.when(cur["item"], F.lit("")).otherwise(F.concat(cur["key"], F.lit(":"))), value,
            )
            counted = F.concat(F.slice(kept, 1, F.size(kept) - 1), F.array(entry(top["indent"], top["is_list"], top["n"] + 1)))
            pushed = F.when(opens, F.concat(counted, F.array(entry(after["indent"], after["item"], F.lit(0))))).otherwise(counted)
            good = s["ok"] & fits & ~F.contains(value, F.lit(_BAD)) & (opens | ~F.coalesce(after["indent"] > cur["indent"], F.lit(False)))
            return F.struct(F.when(good, F.concat(s["out"], piece)).otherwise(s["out"]).alias("out"), F.when(good, pushed).otherwise(s["stack"]).cast(_STACK).alias("stack"), good.alias("ok"))

        kept = F.filter(s["stack"], stays)
        return F.when(~s["ok"] | (F.size(kept) == 0), F.struct(s["out"].alias("out"), s["stack"].alias("stack"), F.lit(False).alias("ok"))).otherwise(bind(kept, placed))

    return F.aggregate(paired, start, step, lambda s: F.when(s["ok"], F.concat(s["out"], _closed(s["stack"]))).otherwise(F.lit("{}")))


def header(text: Column | str) -> Column:
    """The header as VARIANT."""
    return F.coalesce(F.try_parse_json(header_json(text)), F.parse_json(F.lit("{}")))


def field(header: Column | str, path: str, kind: str) -> Column:
    """A typed field, null where it is missing or of another type."""
    return F.try_variant_get(col(header), path, kind)


def serialised(header: Column | str) -> Column:
    """Canonical header: a line for each top-level key, in order of the keys, its value as JSON."""
    fields = F.array_sort(F.map_entries(col(header).cast("map<string, variant>")), lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))
    key = lambda k: F.when(_matches(k, r"^[A-Za-z_][A-Za-z0-9_]*$"), k).otherwise(json_string(k))
    # three dashes would end the header
    safe = lambda c: F.replace(c, F.lit("---"), F.lit("\\u002d--"))
    lines = F.transform(fields, lambda e: F.concat(safe(key(e["key"])), F.lit(": "), safe(F.to_json(e["value"])), F.lit("\n")))
    return F.concat(F.lit("---\n"), F.array_join(lines, ""), F.lit("---\n"))
