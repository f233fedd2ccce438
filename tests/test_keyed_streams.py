"""Streams whose state ends."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from marginalia.streaming import jobs, stateful

CANDIDATES = "ts timestamp, id_type string, source_id string, url string, n long"


def feed(spark, tmp_path, name, batches, schema, start, tables=None):
    """Runs a stream over one file after the other, as a job that is started again each time; state rows after each run."""
    sizes = []
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name / "in"))
        with stateful.keyed_state(spark):
            q = start(spark.readStream.schema(schema).parquet(str(tmp_path / name / "in")))
        q.awaitTermination()
        sizes.append([s["numRowsTotal"] for s in q.recentProgress[-1]["stateOperators"]])
    return sizes


def written(df, tmp_path, name):
    return df.writeStream.format("parquet").option("path", str(tmp_path / name / "out")).option("checkpointLocation", str(tmp_path / name / "state")).trigger(availableNow=True).start()


def test_seen_state_stays_flat_over_days_and_the_first_row_is_kept(spark, tmp_path):
    day = lambda b, i: datetime(2024, 1, 1, 3, 0, i) + timedelta(days=2 * b)
    batches = [[(day(b, 19 - i), "url", "f", f"http://{(i + b * 10) % 25}", b * 100 + i) for i in range(20)] + [(day(b, 5), "url", "", "", 1000 + b)] for b in range(8)]
    known = spark.createDataFrame([("http://3", datetime(2024, 1, 1))], "ident string, ts timestamp")
    sizes = feed(spark, tmp_path, "seen", batches, CANDIDATES, lambda s: written(stateful.unseen(s, "n", timedelta(days=3), "1 hour", known), tmp_path, "seen"))
    # at most the keys of about three days, and no growth
    assert max(s[0] for s in sizes) <= 26 and max(s[0] for s in sizes[4:]) <= max(s[0] for s in sizes[:4])
    kept = {(r["ident"], r["n"]) for r in spark.read.parquet(str(tmp_path / "seen" / "out")).collect()}
    first, expected = {"http://3": datetime(2024, 1, 1)}, set()
    for rows in batches:
        for ts, _, _, url, n in sorted(rows):
            if url not in first or ts >= first[url] + timedelta(days=3):
                first[url] = ts
                expected.add((url, n))
    # a key may be forgotten later than its time, never earlier
    assert {k for k, _ in kept} == {k for k, _ in expected} and len(kept) <= len(expected)
    assert {n for k, n in kept if n < 100 and k} == {i for i in range(20) if i != 3}
    assert ("http://3", 3) not in kept


def test_equal_rows_of_one_batch_are_one(spark, tmp_path):
    rows = [(datetime(2024, 1, 1), "arxiv", "arxiv:1", f"http://{i}", 9 - i) for i in range(5)] + [(None, "url", "f", "http://x", 1), (datetime(2024, 1, 1), "url", "f", "http://x", None)]
    feed(spark, tmp_path, "one", [rows], CANDIDATES, lambda s: written(stateful.unseen(s, "n", timedelta(days=1)), tmp_path, "one"))
    got = {r["ident"]: r["n"] for r in spark.read.parquet(str(tmp_path / "one" / "out")).collect()}
    assert got["arxiv:1"] == 5 and set(got) == {"arxiv:1", "http://x"}


LEDGER = "id long, status string, discovered_by string, source_id string, engine string, ts timestamp"


def test_decisions_count_once_across_restarts(spark, tmp_path):
    root = str(tmp_path / "counts")
    batches = [[(i, "rejected" if i % 3 else "ingested", "web", "s", "e", datetime(2024, 1, 1 + b)) for i in range(b * 10, b * 10 + 20)] for b in range(3)]

    def start(stream):
        return stateful.learned_once(stream, timedelta(days=5), root).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()

    feed(spark, tmp_path, "once", batches, LEDGER, start)
    got = {(r["part"], r["name"]): (r["accept"], r["reject"]) for r in stateful.counted(spark, root).collect()}
    assert got == {("source_id", "s"): (14, 26), ("engine", "e"): (14, 26)}


def test_closed_days_leave_the_state(spark, tmp_path):
    batches = [[(datetime(2024, 1, 1 + b, h), "a", 0.5) for h in range(0, 24, 6)] for b in range(6)]
    sizes = feed(spark, tmp_path, "days", batches, "ts timestamp, action string, cost_usd double", lambda s: written(jobs.daily_spend(s, "1 hour"), tmp_path, "days"))
    assert max(s[0] for s in sizes) <= 2
    got = spark.read.parquet(str(tmp_path / "days" / "out")).orderBy("date").collect()
    assert [(str(r["date"]), r["calls"]) for r in got] == [(f"2024-01-0{d}", 4) for d in range(1, 6)]
    assert spark.read.parquet(str(tmp_path / "days" / "out")).groupBy("date").count().where(F.col("count") > 1).count() == 0


def test_only_decisions_get_to_the_state(spark, tmp_path):
    """A row that waits takes no state and does not hide the decision that comes later."""
    root = str(tmp_path / "counts")
    status = [["waiting_approval"] * 30, ["rejected"] * 10 + ["deleted"] * 20]
    batches = [[(i, s, "web", "s", "e", datetime(2024, 1, 1 + b)) for i, s in enumerate(names)] for b, names in enumerate(status)]

    def start(stream):
        return stateful.learned_once(stream, timedelta(days=5), root).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()

    sizes = feed(spark, tmp_path, "decided", batches, LEDGER, start)
    got = {(r["part"], r["name"]): (r["accept"], r["reject"]) for r in stateful.counted(spark, root).collect()}
    assert got == {("source_id", "s"): (0, 10), ("engine", "e"): (0, 10)} and sizes[0][0] == 0
