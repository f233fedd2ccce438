"""State that outlives a run: learned counts, counted tokens, allocated numbers."""

import json

import pytest
from pyspark.sql import functions as F

from marginalia.operators import allocation, learned_state, usage
from marginalia.sources.commits import Commits, Conflict

LEDGER = "id long, status string, discovered_by string, source_id string, engine string, relevance_score double, rejection_reason string"


def ledger(spark, ids):
    rows = []
    for i in ids:
        status = ["ingested", "rejected", "pending", "waiting_approval"][i % 4]
        rows.append((i, status, "web" if i % 9 else "other", f" s{i % 5} " if i % 7 else "", f"e{i % 2}", None if i % 6 == 0 else (i % 10) / 10, "vendor marketing fluff" if status == "rejected" else ""))
    return spark.createDataFrame(rows, LEDGER)


def protected(spark):
    return spark.createDataFrame([("vendor",)], "keyword string")


def snapshot(state):
    out = {name: sorted(map(tuple, df.collect()), key=str) for name, df in state.tables().items()}
    mean = out.pop("calibration")[0]
    return out, mean


def plain_means(rows, start=(0.0, 0.0, 0)):
    a, r, n = start
    for row in rows:
        if row["discovered_by"] != "web" or row["relevance_score"] is None or row["status"] not in ("ingested", "pending", "rejected"):
            continue
        n += 1
        if row["status"] == "rejected":
            r += (row["relevance_score"] - r) / n
        else:
            a += (row["relevance_score"] - a) / n
    return a, r, n


def test_two_passes_equal_one_and_a_replayed_pass_counts_nothing(spark, tmp_path):
    root, every = str(tmp_path / "state"), ledger(spark, range(1, 90))
    one = learned_state.learn_pass(learned_state.empty(spark), every, protected(spark), "d", words=True, part_rows=10)
    version, passes = None, []
    for part in (every.where("id < 40"), every, every):
        passes.append(learned_state.learn_pass(learned_state.load(spark, root), part, protected(spark), "d", words=True, part_rows=7))
        version = learned_state.publish(passes[-1].after, root, version)
    assert version == 2 and [p.decisions.count() > 0 for p in passes] == [True, True, False]
    (parts, mean), (twice, mean2) = snapshot(one.after), snapshot(learned_state.load(spark, root))
    assert parts == twice and mean[:3] == pytest.approx(mean2[:3])
    assert mean[:3] == pytest.approx(plain_means(every.orderBy("id").collect()))
    assert {r["keyword"] for r in one.after.words.collect()} == {"marketing", "fluff"} and {r["name"] for r in one.after.sources.collect()} == {f"s{i}" for i in range(5)}
    assert {r["arrow"] for r in passes[0].changes("sources").collect()} == {"new"} and passes[2].changes("engines").count() == 0
    assert {r["keyword"] for r in passes[0].promoted().collect()} == {"marketing", "fluff"} and passes[1].promoted().count() == 0


def test_stored_means_are_where_the_fold_starts(spark):
    before = learned_state.empty(spark)
    state = learned_state.Learned(**{**before.tables(), "calibration": spark.createDataFrame([(0.9, 0.2, 5, "x")], learned_state.MEANS)})
    every = ledger(spark, range(1, 60))
    for part_rows in (3, 1000):
        after = learned_state.learn_pass(state, every, protected(spark), "d", part_rows=part_rows).after.calibration.first()
        assert tuple(after)[:3] == pytest.approx(plain_means(every.orderBy("id").collect(), (0.9, 0.2, 5)))
    # nothing new: all stays
    assert tuple(learned_state.learn_pass(state, every.where("false"), protected(spark), "d").after.calibration.first()) == (0.9, 0.2, 5, "d")


@pytest.mark.parametrize("document", [
    {"sources": {"s1": {"accept": 2, "reject": 1, "rep": 0.2}}, "reject_patterns": {"keywords": ["hype", "noise", "hype"]}},
    {"reject_patterns": {"keyword_counts": {"hype": 5}, "keywords": ["hype"]}, "calibration": {"accepted_score_mean": 0.5, "n": 3}, "processed_ids": ["1", "2"]},
    {"reject_patterns": {"keyword_counts": {}, "keywords": ["hype"]}, "engines": {"e": {"accept": 1}}},
    {},
])
def test_older_documents_are_migrated(spark, tmp_path, document):
    state = learned_state.of_document(spark.createDataFrame([(json.dumps(document),)], "text string"))
    learned_state.publish(state, str(tmp_path / "s"), None)
    parts, mean = snapshot(learned_state.load(spark, str(tmp_path / "s")))
    patterns = document.get("reject_patterns", {})
    counts = patterns.get("keyword_counts", {w: 2 for w in patterns.get("keywords", [])})
    assert parts["words"] == sorted(counts.items()) and [p[0] for p in parts["processed"]] == document.get("processed_ids", [])
    assert [(n, a, r) for n, a, r, _ in parts["sources"]] == [(n, c["accept"], c["reject"]) for n, c in document.get("sources", {}).items()]
    assert len(parts["engines"]) == len(document.get("engines", {})) and mean[2] == document.get("calibration", {}).get("n", 0)


def test_broken_document_is_a_fresh_state_and_two_writers_conflict(spark, tmp_path):
    for text in ("no json", "[1, 2]", ""):
        parts, mean = snapshot(learned_state.of_document(spark.createDataFrame([(text,)], "text string")))
        assert not any(parts.values()) and mean == (0.0, 0.0, 0, "")
    root = str(tmp_path / "s")
    learned_state.publish(learned_state.empty(spark), root, None)
    with pytest.raises(Conflict):
        learned_state.publish(learned_state.empty(spark), root, None)


MESSAGES = "session_id long, uuid string, position long, role string, skill string, model string, input_tokens long, output_tokens long, cache_read_tokens long, cache_create_tokens long"


def messages(spark, n, first=0):
    return spark.createDataFrame([(i % 3, f"u{i}", i, "assistant" if i % 4 else "user", "" if i % 2 else "s", "haiku", i, 1, 0, 0) for i in range(first, n)], MESSAGES)


def totals(spark, root):
    return usage.usage(spark, root).agg(F.sum("tokens_in"), F.sum("tokens_out")).first()


def test_a_run_that_dies_between_rows_and_mark_counts_each_message_once(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "t")
    assert usage.commit_usage(messages(spark, 20), root, 1)
    publish = Commits.publish

    def die(self, number, name):
        raise OSError("lost")

    monkeypatch.setattr(Commits, "publish", die)
    with pytest.raises(OSError):
        usage.commit_usage(messages(spark, 50), root, 2)
    assert Commits(spark, root).numbers() == [1]
    monkeypatch.setattr(Commits, "publish", publish)
    assert usage.commit_usage(messages(spark, 50), root, 2) and not usage.commit_usage(messages(spark, 50), root, 2) and usage.commit_usage(messages(spark, 50), root, 3)
    assert tuple(totals(spark, root)) == (sum(i for i in range(50) if i % 4), sum(1 for i in range(50) if i % 4))
    assert {(r["session_id"], r["uuid"]) for r in usage.marks(spark, root).collect()} == {(0, "u48"), (1, "u49"), (2, "u47")}
    # a mark whose message is gone: nothing of the session is counted
    assert usage.commit_usage(messages(spark, 60, first=50), root, 4) and tuple(totals(spark, root))[0] == sum(i for i in range(50) if i % 4)


def test_a_stream_that_dies_before_its_commit_counts_each_message_once(spark, tmp_path, monkeypatch):
    source, root = str(tmp_path / "in"), str(tmp_path / "t")

    def run():
        stream = spark.readStream.schema(MESSAGES).parquet(source)
        stream.writeStream.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).foreachBatch(usage.usage_batches(root)).start().awaitTermination()

    messages(spark, 20).write.parquet(source)
    run()
    messages(spark, 40, first=20).write.mode("append").parquet(source)
    write = Commits.write

    def die(self, number, tables):
        write(self, number, tables)
        raise OSError("lost")

    monkeypatch.setattr(Commits, "write", die)
    with pytest.raises(Exception):
        run()
    monkeypatch.setattr(Commits, "write", write)
    run()
    run()
    assert tuple(totals(spark, root)) == (sum(i for i in range(40) if i % 4), sum(1 for i in range(40) if i % 4))


def test_numbers_have_no_gap_and_are_given_once(spark, tmp_path):
    allocator = allocation.Allocator(spark, str(tmp_path / "a"))
    assert allocator.seed(spark.createDataFrame([("direction", 41)], "type string, next long")) and not allocator.seed(spark.createDataFrame([("direction", 1)], "type string, next long"))
    asked = spark.createDataFrame([("direction", f"k{i:03}") for i in range(300)] + [("decision", "a"), ("decision", "a"), ("agent_todo", "z")], "type string, key string")
    first = allocator.take(asked.where("key < 'k100'"), "key").collect()
    assert len(first) == 101 and allocator.take(asked.where("key < 'k100'"), "key").count() == 0
    assert allocator.take(asked, "key").count() == 201
    by_type = {}
    for r in allocator.allocated().collect():
        by_type.setdefault(r["type"], {})[r["key"]] = r["id"]
    assert by_type["decision"] == {"a": "D-0001"} and by_type["agent_todo"] == {"z": "TODO-0001"}
    assert sorted(by_type["direction"].values()) == [f"DIR-{n:04}" for n in range(41, 341)] and by_type["direction"]["k000"] == "DIR-0041"
    assert {r["type"]: r["next"] for r in allocator.counters().collect()} == {"direction": 341, "decision": 2, "agent_todo": 2}


def test_pages_are_changed_in_their_header_only(spark):
    page = "---\nid: QP-1\n status: pending\nupdated: 2020-01-01\nsolved: no\nanswer_ref: x\n---\n\n\nstatus: in the text\n"
    rows = spark.createDataFrame([(page,), ("no header\nstatus: x",), ("---\nid: 1\n---",)], "text string")
    got = [tuple(r) for r in rows.select(allocation.approved(F.col("text")), allocation.solved(F.col("text"), F.lit("r/1.md"), "2024-01-02")).collect()]
    assert got[0][0] == "---\nid: QP-1\nupdated: 2020-01-01\nsolved: no\nanswer_ref: x\nstatus: approved\n---\nstatus: in the text\n"
    assert got[0][1] == '---\nid: QP-1\n status: pending\nupdated: 2024-01-02\nsolved: "yes"\nanswer_ref: r/1.md\n---\nstatus: in the text\n'
    assert got[1] == ("no header\nstatus: x",) * 2 and got[2][0] == "---\nid: 1\nstatus: approved\n---\n"
    made = allocation.question_pages(spark.createDataFrame([("Q-1", "A Title!", "---\npriority: \"HIGH\"\nrelated:\n  - \"[[wiki/concepts/a]]\"\n  - [[wiki/concepts/b]]\n---\nBody [[wiki/concepts/c]]")], "id string, title string, text string"), "d").first()
    assert made["path"] == "objective/research_question/Q-1-a-title.md" and 'related: ["[[wiki/concepts/a]]", "[[wiki/concepts/b]]"]\npriority: high\n' in made["text"] and made["text"].endswith("---\nBody [[wiki/concepts/c]]")
