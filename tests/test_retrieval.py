import math
from collections import Counter

from pyspark.sql import functions as F

from marginalia.operators import retrieval
from marginalia.sources import sinks

DOCS = [(f"c{i}", t) for i, t in enumerate(
    ["alpha beta gamma", "alpha alpha delta", "beta", "gamma gamma beta alpha", "the of and", "delta epsilon zeta", "alpha beta gamma", "zeta-zeta alpha"]
)]


def brute(query, k):
    toks = {c: t.split() for c, t in DOCS}
    toks["c4"] = []
    mean = sum(map(len, toks.values())) / len(toks)
    scores = Counter()
    for term in query.split():
        df = sum(term in t for t in toks.values())
        for c, t in toks.items():
            if term in t:
                tf = t.count(term)
                scores[c] += math.log(1 + (len(toks) - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(t) / mean))
    ranked = sorted(scores.items(), key=lambda s: (-round(s[1], 9), s[0]))[:k]
    return [(c, round(s, 6)) for c, s in ranked]


def rows(df):
    return [(r["chunk_id"], r["score"]) for r in df.collect()]


def test_scan_index_and_batch_agree_with_brute_force(spark, tmp_path):
    docs = spark.createDataFrame(DOCS, "chunk_id string, text string")
    retrieval.write_index(docs, str(tmp_path / "index"), buckets=4)
    for query in ("alpha", "alpha gamma", "alpha alpha beta", "zeta-zeta unknown", "missing"):
        wanted = brute(query, 3)
        assert rows(retrieval.bm25_scan(docs, query, 3)) == wanted
        assert rows(retrieval.bm25_indexed(spark, str(tmp_path / "index"), query, 3)) == wanted
        many = retrieval.bm25_many(docs, spark.createDataFrame([(1, query)], "query_id int, text string"), 3)
        assert rows(many.orderBy("rank")) == wanted


def test_stopword_query_finds_nothing(spark):
    docs = spark.createDataFrame(DOCS, "chunk_id string, text string")
    assert retrieval.bm25_scan(docs, "the of", 3).count() == 0


def test_idf_is_positive_for_every_document_frequency(spark):
    from marginalia.functions.scoring import bm25_idf

    for n in (1, 10, 1000):
        low = spark.range(1, n + 1).select(bm25_idf(F.lit(n), F.col("id")).alias("x")).agg(F.min("x")).first()[0]
        assert low > 0


def test_cosine_edge_cases(spark):
    from marginalia.functions.scoring import cosine

    cases = [([1.0, 0.0], [1.0, 0.0], 1.0), ([1.0, 0.0], [0.0, 1.0], 0.0), ([1.0], [-1.0], -1.0), ([1.0], [1.0, 2.0], 0.0), ([0.0], [1.0], 0.0), ([], [], 0.0)]
    df = spark.createDataFrame([(a, b) for a, b, _ in cases], "a array<double>, b array<double>")
    assert [round(r[0], 9) for r in df.select(cosine(F.col("a"), F.col("b"))).collect()] == [w for *_, w in cases]


def chunk_pages(spark):
    pages = [("wiki/a.md", "---\naddress: c-000001\ntitle: \"A page\"\n---\nFirst one. Then alpha.\n\nalpha beta"), ("wiki/b.md", "beta gamma. alpha"), ("wiki/e.md", "")]
    return spark.createDataFrame(pages, "path string, text string")


def test_chunk_table_and_prefix(spark):
    got = {r["chunk_id"]: r for r in retrieval.chunk_table(chunk_pages(spark)).collect()}
    assert len(got) == 2 and "c-000001:0" in got
    first = got["c-000001:0"]
    assert first["prefix"] == 'This passage is from the wiki page "A page". The page opens: First one.'
    assert first["contextualized_text"].endswith("\n\n" + first["raw_text"])


def test_incremental_chunk_append(spark, tmp_path):
    path = str(tmp_path / "chunks")
    pages = chunk_pages(spark)
    assert sinks.append_changed_chunks(retrieval.chunk_table(pages), path, spark) == 2
    assert sinks.append_changed_chunks(retrieval.chunk_table(pages), path, spark) == 0
    edited = pages.withColumn("text", F.when(F.col("path") == "wiki/b.md", F.lit("beta changed")).otherwise(F.col("text")))
    assert sinks.append_changed_chunks(retrieval.chunk_table(edited), path, spark) == 1
    latest = sinks.latest_chunks(spark.read.parquet(path))
    assert latest.count() == 2 and latest.where("raw_text = 'beta changed'").count() == 1


def test_retrieve_modes(spark, tmp_path):
    chunks = retrieval.chunk_table(chunk_pages(spark))
    plain = retrieval.retrieve(chunks, "alpha beta", use_rerank=False).collect()
    assert plain and all(r["rerank_score"] == r["bm25_score"] for r in plain)
    noop = retrieval.retrieve(chunks, "alpha beta").collect()
    assert {r["rerank_source"] for r in noop} == {"noop"} and {r["rerank_score"] for r in noop} == {0.0}
    vectors = chunks.where("page_path = 'wiki/b.md'").select(F.lit("m").alias("model"), "body_hash", F.array(F.lit(1.0), F.lit(0.0)).alias("embedding"))
    asked = spark.createDataFrame([([1.0, 0.0],)], "embedding array<double>")
    ranked = retrieval.retrieve(chunks, "alpha beta", vectors, asked, "m").collect()
    retrieval.write_chunks(chunks, str(tmp_path / "index"), 2)
    indexed = retrieval.retrieve_indexed(spark, str(tmp_path / "index"), "alpha beta", vectors, asked, "m")
    assert [r.asDict() for r in indexed.collect()] == [r.asDict() for r in ranked]
    assert ranked[0]["page_path"] == "wiki/b.md" and ranked[0]["rerank_score"] == 1.0
    assert ranked[1]["rerank_source"] == "missing-vector" and ranked[1]["rerank_score"] == 0.0
