"""Nested headers: typed reads, malformed headers, and the canonical form."""

import json
import tempfile

from hypothesis import HealthCheck, Phase, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marginalia.functions import nested


def read(spark, texts):
    folder = tempfile.mkdtemp()
    # written first, so that the header is read once and not for each use
    spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", nested.header("text").alias("h")).write.mode("overwrite").parquet(folder)
    rows = spark.read.parquet(folder).select("i", F.to_json("h").alias("j"), nested.serialised("h").alias("s"))
    found = {r["i"]: (json.loads(r["j"]), r["s"]) for r in rows.collect()}
    return [found[i] for i in range(len(texts))]


HEADERS = [
    ("a: 1\nb: -2.50\nc: yes\nd: Off\ne: ~\nf:\ng: null\nh: 007x", {"a": 1, "b": -2.5, "c": True, "d": False, "e": None, "f": None, "g": None, "h": "007x"}),
    ("a: 'it''s # no'  # note\nb: \"q \\\" \\u00e9\"\nc: plain # note\nd: http://x.y/z#f\n# note\n\ne: x:y", {"a": "it's # no", "b": 'q " é', "c": "plain", "d": "http://x.y/z#f", "e": "x:y"}),
    ("next_id:\n  q: 4\n  d: 5\nA: 1\na: 2", {"next_id": {"q": 4, "d": 5}, "A": 1, "a": 2}),
    ("l:\n- 1\n- two\nm:\n    - a: 1\n      b:\n        c: [x, 'y, z', 3]\n    - a: 2\n    -\n      a: 3\nn: {k: v, w: [ ]}", {}),
    ("l:\n- 1\n- two\nm:\n    - a: 1\n      b:\n        c: [x, 'y, z', 3]\n    - a: 2\n    -\n      a: 3\nn: {k: v, w: 1}", {"l": [1, "two"], "m": [{"a": 1, "b": {"c": ["x", "y, z", 3]}}, {"a": 2}, {"a": 3}], "n": {"k": "v", "w": 1}}),
    ("  a: 1\n  b: 2", {"a": 1, "b": 2}), ("a: 1_000\nb: +5\nc: 1.\nd: 1e5\ne: []\nf: {}", {"a": 1000, "b": 5, "c": 1.0, "d": "1e5", "e": [], "f": {}}),
    ("created: 2024-01-02\n\"odd key\": 1\n'k''s': 2", {"created": "2024-01-02", "odd key": 1, "k's": 2}),
]


def test_headers(spark):
    expected = [e for _, e in HEADERS]
    got = read(spark, [f"---\n{h}\n---\nbody: 1" for h, _ in HEADERS] + [f"---\n{h}\n---\n".replace("\n", "\r\n") for h, _ in HEADERS])
    assert [g for g, _ in got] == expected * 2
    assert read(spark, [form + "body" for _, form in got]) == got


def test_malformed_headers_are_empty(spark):
    bad = ["a: b: c", "a: [1", "a: 'x", "- a\n- b", "a: 1\n- b", "a: 1\n   b: 2", "a: |\n  text", "a: &x 1", "just text", "a: 1\na: 2", "a: [[wiki/x]], [[y]]", "a:\n  b: 1\n c: 2", "\ta: 1: 2"]
    assert [g for g, _ in read(spark, [f"---\n{h}\n---\n" for h in bad] + ["", "no header", "---\nno end"])] == [{}] * (len(bad) + 3)
    assert spark.createDataFrame([(None,)], "text string").select(F.to_json(nested.header("text"))).first()[0] == "{}"


def test_typed_fields(spark):
    text = "---\nid: 7\ncreated: 2024-02-03\nscore: 1.5\nmeta:\n  lang: en\n  list: [a, b]\nitems:\n- name: x\n- name: y\n---\n"
    h = nested.header("text")
    got = spark.createDataFrame([(text,)], "text string").select(
        nested.field(h, "$.id", "int"), nested.field(h, "$.created", "date").cast("string"), nested.field(h, "$.score", "double"), nested.field(h, "$.meta.lang", "string"), nested.field(h, "$.meta.list", "array<string>"),
        nested.field(h, "$.items[1].name", "string"), nested.field(h, "$.none", "string"), nested.field(h, "$.meta", "int"),
    ).first()
    assert tuple(got) == (7, "2024-02-03", 1.5, "en", ["a", "b"], "y", None, None)


scalars = st.one_of(st.none(), st.booleans(), st.integers(-(10**9), 10**9), st.text(alphabet="ab :#-'\"\\,[]{}é\t1.", max_size=8))
keys = st.one_of(st.text(alphabet="abc_", min_size=1, max_size=4), st.text(alphabet="a :'\"-#\\", min_size=1, max_size=4))
values = st.recursive(scalars, lambda inner: st.one_of(st.lists(inner, max_size=3), st.dictionaries(keys, inner, max_size=3)), max_leaves=6)


def block_lines(value, indent=0):
    """A map or list as an indented block."""
    pad = " " * indent
    for key, v in value.items() if isinstance(value, dict) else enumerate(value):
        lead = f"{pad}- " if isinstance(value, list) else f"{pad}{json.dumps(key, ensure_ascii=False)}: "
        if isinstance(v, (dict, list)) and v:
            yield lead.rstrip(" ")
            yield from block_lines(v, indent + 2)
        else:
            yield lead + json.dumps(v, ensure_ascii=False)


@settings(max_examples=2, deadline=None, database=None, phases=[Phase.generate], suppress_health_check=list(HealthCheck))
@given(st.lists(st.dictionaries(keys, values, min_size=1, max_size=4), min_size=60, max_size=80))
def test_reading_writing_and_reading_is_the_identity(spark, maps):
    # a header ends at the first three dashes, so its texts are written without them
    texts = ["---\n" + "\n".join(block_lines(m)).replace("---", "-\\u002d-") + "\n---\n" for m in maps]
    got = read(spark, texts)
    assert [g for g, _ in got] == maps
    again = read(spark, [form + "body" for _, form in got])
    assert again == got
