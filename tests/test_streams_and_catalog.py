import os

import pytest
from pyspark.sql import functions as F

from marginalia.catalog import load
from marginalia.streaming import jobs

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def decided(spark, rows):
    return spark.createDataFrame(rows, "id string, status string, discovered_by string, source_id string, engine string")


def test_learning_step_counts_once_even_when_replayed(spark, tmp_path):
    step = jobs.learn_batches(str(tmp_path))
    first = decided(spark, [("1", "ingested", "web", "s", "e"), ("2", "rejected", "web", "s", "e"), ("3", "pending", "other", "s", "e")])
    second = decided(spark, [("2", "rejected", "web", "s", "e"), ("4", "pending", "web", "s", "e")])
    step(first, 0)
    step(second, 1)
    step(second, 1)
    row = jobs.learned_counts(spark, str(tmp_path), "source_id").first()
    assert (row["accept"], row["reject"]) == (2, 1)


def test_seen_stream_keeps_first_of_each_identity(spark, tmp_path):
    rows = [("url", "f", "http://a"), ("url", "f", "http://a"), ("arxiv", "arxiv:1", "http://x"), ("arxiv", "arxiv:1", "http://y")]
    spark.createDataFrame(rows, "id_type string, source_id string, url string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id_type string, source_id string, url string").parquet(str(tmp_path / "in"))
    q = (
        jobs.unseen_candidates(stream).writeStream.format("parquet").option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    )
    q.awaitTermination()
    assert {r["ident"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"http://a", "arxiv:1"}


def test_catalog_is_checked_by_sql():
    entries = load()
    assert len(entries) > 150
    assert [n for n, e in entries.items() if e.sql is None] == []


@pytest.mark.skipif(not os.path.isdir(DATA), reason="tables are not there")
@pytest.mark.parametrize("name", [
    "bm25_topk", "retrieve_pages", "vault_audit", "spend_grouping_sets", "ledger_scan", "ledger_enqueue", "select_candidates", "routed_sources",
    "near_duplicates", "source_reputations", "calibration", "open_frontier", "review_outcomes", "backfill_set", "claim_verdicts", "wiki_state",
    "stable_ids", "candidate_scores", "facts_as_of", "stream_daily_spend",
])
def test_query_matches_its_sql(spark, name):
    import duckdb

    from tools.check import rows_of

    entry = load()[name]
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    df = entry.run(spark, DATA)
    cur = con.execute(entry.sql)
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(columns, cur.fetchall())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="tables are not there")
def test_match_trace_has_one_merge_per_unit_match(spark):
    trace = load()["match_trace"].run(spark, DATA)
    merged = trace.where("decision = 'MERGED'")
    assert merged.where("merged = 0").count() == 0 and trace.where("decision <> 'MERGED' AND merged > 0").count() == 0
    best = trace.orderBy(F.col("score").desc(), "gap_unit", "direction_unit").first()
    assert best is None or best["decision"] == "MERGED"


@pytest.mark.parametrize("name", ["stream_skill_tokens", "stream_unseen"])
def test_streams_read_a_table_that_is_a_folder_of_files(spark, tmp_path, name):
    """Both forms of a table give the same rows; a folder was read as empty."""
    table = {"stream_skill_tokens": "conversations", "stream_unseen": "events"}[name]
    spark.read.parquet(f"{DATA}/{table}.parquet").repartition(3).write.parquet(str(tmp_path / f"{table}.parquet"))
    run = load()[name].run
    assert sorted(map(str, run(spark, str(tmp_path)).collect())) == sorted(map(str, run(spark, DATA).collect())) != []
