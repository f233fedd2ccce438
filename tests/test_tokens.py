import re
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marginalia.functions import prose, tokens

TEXTS = [
    "Привет мир", "漢字 かな kana", "naïve café Ünïcode", "user's well-formed 'quoted'", "😀 only 😀", "a I x2 the of", "", "A_b c-d -e",
    "tab\tand\nline", "repeat repeat Repeat",
]


def words(text):
    found = re.findall(r"\w[\w'\-]*", text)
    return [w.lower() for w in found if len(w) > 1 and w.lower() not in tokens.RETRIEVAL_STOPWORDS]


def one(spark, expr, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(expr.alias("x")).first()["x"]


def test_retrieval_terms_follow_unicode_words(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    got = [r["x"] for r in df.select(tokens.retrieval_terms("text").alias("x")).collect()]
    assert got == [words(t) for t in TEXTS]


def test_term_counts_match_a_counter(spark):
    texts = ["b a b c a b", "x", "", "z z z"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    rows = df.select(tokens.term_counts(F.filter(F.split("text", " "), lambda w: w != "")).alias("x")).collect()
    for text, row in zip(texts, rows):
        assert {c["term"]: c["tf"] for c in row["x"]} == dict(Counter(text.split()))


def test_jaccard_conventions(spark):
    a, b = F.array(F.lit("p"), F.lit("q")), F.array(F.lit("q"), F.lit("r"))
    none = F.expr("cast(array() as array<string>)")
    row = spark.range(1).select(
        tokens.jaccard_or_zero(a, b), tokens.jaccard_or_zero(none, none), tokens.jaccard_or_one(none, none),
        tokens.overlap_coefficient(a, b), tokens.overlap_coefficient(a, none),
    ).first()
    assert [round(v, 6) for v in row] == [0.333333, 0.0, 1.0, 0.5, 0.0]


def test_word_pairs(spark):
    for given_words, wanted in ((["a"], []), (["a", "b", "c"], ["a b", "b c"]), ([], [])):
        df = spark.createDataFrame([(given_words,)], "w array<string>")
        assert df.select(tokens.word_pairs(F.col("w")).alias("x")).first()["x"] == wanted


def test_substring_score(spark):
    df = spark.createDataFrame([("wiki/Kv-cache.md", "kv kvkv KV", ["kv", "md"])], "p string, t string, k array<string>")
    assert df.select(tokens.substring_score(F.col("p"), F.col("t"), F.col("k")).alias("x")).first()["x"] == 4 + 5 + 5


def fold_chunks(body, size, overlap):
    """Independent statement of the chunk rule, over character positions."""
    parts = [p.strip() for p in re.split(r"\n\s*\n", body)]
    parts = [p for p in parts if p]
    out, text, length = [], None, 0
    for p in parts:
        text = p if text is None else text + "\n\n" + p
        length += len(p) + 2
        if length >= size:
            out.append(text)
            text = text[len(text) - min(overlap, len(text)):] or None
            length = len(text or "")
    if text is not None and text.strip():
        out.append(text)
    return out


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.text("ab \n", max_size=60), max_size=8).map("\n\n".join), min_size=1, max_size=20))
def test_chunks_match_the_fold(spark, bodies):
    df = spark.createDataFrame([(b,) for b in bodies], "body string")
    got = [r["x"] for r in df.select(prose.chunk_texts("body", 40, 7).alias("x")).collect()]
    assert got == [fold_chunks(b, 40, 7) for b in bodies]


def test_one_long_paragraph_gives_a_tail_chunk(spark):
    text = "x" * 2500
    assert one(spark, prose.chunk_texts("t"), t=text) == [text, "x" * 200]


@pytest.mark.parametrize(
    "text, wanted",
    [
        ("[[wiki/concepts/kv-cache|KV cache]] and **bold**", "KV cache and bold"), ("[text](http://x) [3]-[6] end", "text - end"),
        ("[[wiki/x/page]]", "page"), ("", ""),
    ],
)
def test_clean_query_text(spark, text, wanted):
    assert one(spark, prose.clean_query_text("t"), t=text) == wanted


def test_links_sections_and_slugs(spark):
    text = "intro\n## Missing\nline one\nline two\n## Missing more\nno\n## Open questions (x)\n- a\n* b\nplain\n## End"
    assert one(spark, prose.section("t", "Missing"), t=text) == "line one\nline two"
    assert one(spark, prose.bullet_count(prose.section_starting("t", "open questions")), t=text) == 2
    assert one(spark, prose.wiki_links("t"), t="[[a/b/C |x]] [[D#h]] [[ e ]]") == ["C", "D", "e"]
    assert one(spark, prose.concept_slugs("t"), t="[[wiki/concepts/a|A]] [[concepts/b#x]] [[concepts/a]] [[c]]") == ["a", "b"]
    assert one(spark, prose.gap_slug("t"), t="Optical prior art -- citations [3]-[6] not ingested") == "optical-prior-art-citations-3-6-not-ingested"
    assert one(spark, prose.report_slug("t"), t="é!") == "untitled"
    assert one(spark, prose.normal_stem("t"), t="2024-01-02 My_Page--x") == "my page x"
