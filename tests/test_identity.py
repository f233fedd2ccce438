import pytest
from pyspark.sql import functions as F

from marginalia.functions import identity


def one(spark, expr, t):
    return spark.createDataFrame([(t,)], "t string").select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "url, wanted",
    [
        ("HTTPS://Ex.COM/a/?utm_source=x&b=1&c=#frag", "https://ex.com/a?b=1"), ("http://e.com/", "http://e.com"), ("not a url", "not a url"),
        ("http://e.com/p;v=1?fbclid=3&GCLID=4", "http://e.com/p"), (" http://e.com/q ", "http://e.com/q"),
    ],
)
def test_canonical_url(spark, url, wanted):
    assert one(spark, identity.canonical_url("t"), url) == wanted


@pytest.mark.parametrize("url, ok", [("http://a", True), ("https://a/b", True), ("ftp://a", False), ("http://", False), ("", False), (None, False)])
def test_valid_url(spark, url, ok):
    assert one(spark, identity.valid_url("t"), url) is ok


@pytest.mark.parametrize(
    "raw, wanted",
    [
        ("arxiv:2401.00001", ("arxiv:2401.00001", "arxiv", "")), ("https://arxiv.org/abs/2401.00001v3", ("arxiv:2401.00001", "arxiv", "https://arxiv.org/abs/2401.00001v3")),
        ("https://e.com/x/", ("url:https://e.com/x", "url", "https://e.com/x/")), ("plain", ("id:plain", "explicit", "")),
        ("url:http://a", ("url:http://a", "url", "http://a")),
    ],
)
def test_proposed_identity(spark, raw, wanted):
    assert tuple(one(spark, identity.proposed_identity(F.col("t")), raw)) == wanted


@pytest.mark.parametrize("raw, wanted", [("arXiv:2401.00001v2", "arxiv:2401.00001"), (" DOI:10.1/AB ", "doi:10.1/ab"), ("x", "x"), (None, "")])
def test_ledger_identity(spark, raw, wanted):
    assert one(spark, identity.ledger_identity(F.col("t")), raw) == wanted


@pytest.mark.parametrize("title, stem", [("2504.02263v4", True), ("Photons_to_Tokens", True), ("A real title", False), ("", True), (None, True)])
def test_looks_like_stem(spark, title, stem):
    assert one(spark, identity.looks_like_stem(F.col("t")), title) is stem


def test_item_identity_falls_back_to_the_address(spark):
    df = spark.createDataFrame([("arxiv:1", "http://a/"), ("feed", "http://a/"), ("feed", ""), ("10.1/x", "http://d")], "s string, u string")
    got = [r[0] for r in df.select(identity.item_identity(F.col("s"), F.col("u"))).collect()]
    assert got == ["arxiv:1", "http://a", "feed", "http://d"]


@pytest.mark.parametrize("url, repo", [("https://github.com/o/digit.git", "o/digit"), ("git@github.com:o/r", "o/r"), ("o/r", "o/r"), ("x", None)])
def test_repo_of_url(spark, url, repo):
    assert one(spark, identity.repo_of_url(F.col("t")), url) == repo
