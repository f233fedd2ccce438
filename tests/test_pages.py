import json
import os

import pytest
from pyspark.sql import functions as F

from marginalia.functions import frontmatter as fm
from marginalia.operators import graph, objectives, review, sources_ledger as led, stats
from marginalia.sources import readers

DAY = "2024-01-20"


def write(root, rel, text):
    path = os.path.join(root, rel)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8", newline="") as fh:
        fh.write(text)


def vault(tmp_path):
    root = str(tmp_path)
    good = "---\ntype: concept\ncreated: 2024-01-01\nupdated: \"2023-01-01\"\nsources: [x]\nwritten_by: wiki\ntags: [a, \"#b\"]\n---\n"
    write(root, "wiki/concepts/One.md", good + "Long enough text that links [[Two]] and [[gone|x]] and #inline tags here.")
    write(root, "wiki/concepts/Two.md", "```md\n---\ntype: concept\n---\nbody [[gone]] <% tp.date %>")
    write(root, "wiki/concepts/_template.md", "[[objective/direction/DIR-0001]]")
    write(root, "wiki/index.md", "[[One]]")
    write(root, "objective/direction/DIR-0001.md", "---\ntype: direction\nid: DIR-0001\nwritten_by: me\n---\n\n# Head\n## Empty\n\n## Full\ntext")
    write(root, "research/notes/two.md", "no frontmatter at all but certainly long enough to be a page with text")
    write(root, "stray.md", "x")
    return root


def test_vault_source_sees_hidden_names_and_filters_areas(spark, tmp_path):
    root = vault(tmp_path)
    pages = readers.vault_pages(spark, root)
    assert pages.count() == 7
    assert readers.vault_pages(spark, root, ["wiki"]).count() == 4
    assert {r["path"] for r in readers.index_pages(pages).collect()} == {"wiki/concepts/One.md", "wiki/concepts/Two.md"}
    assert readers.chunkable_pages(pages).where("path like '%_template.md'").count() == 1


def test_audit_findings(spark, tmp_path):
    pages = readers.vault_pages(spark, vault(tmp_path), ["wiki", "objective", "research"]).select("path", "text")
    found = {(r["check"], r["path"], r["detail"]) for r in graph.audit(pages, F.lit(DAY).cast("date")).collect()}
    one, two, dir1 = "wiki/concepts/One.md", "wiki/concepts/Two.md", "objective/direction/DIR-0001.md"
    assert ("code_fence_wrapped", two, "") in found and ("unfilled_template", two, "") in found
    assert not any(c == "missing_frontmatter" and p == two for c, p, _ in found)
    assert ("stale", one, "") in found and ("dead_links", one, "gone") in found and ("dead_links", two, "gone") in found
    assert ("missing_frontmatter", dir1, "created, priority, serves_question, status, updated") in found
    assert ("missing_written_by", dir1, "invalid written_by: me") in found
    assert {p for c, p, _ in found if c == "orphaned"} == {"research/notes/two.md"}
    assert {p for c, p, _ in found if c == "duplicate"} == {two, "research/notes/two.md"}
    counts = {r["area"]: r["total"] for r in graph.issue_counts(graph.audit(pages, F.lit(DAY).cast("date"))).collect()}
    assert counts["cross-area"] == 1


def test_lint_checks(spark, tmp_path):
    pages = graph.with_names(readers.vault_pages(spark, vault(tmp_path)).select("path", "text"))
    empty = {(r["path"], r["heading"]) for r in graph.empty_sections(pages).collect()}
    assert empty == {("objective/direction/DIR-0001.md", "Head"), ("objective/direction/DIR-0001.md", "Empty")}
    assert [r["path"] for r in graph.stray_root_pages(pages).collect()] == ["stray.md"]
    assert [(r["term"], r["pages"]) for r in graph.missing_pages(pages).collect()] == [("gone", 2)]


def test_page_metadata(spark, tmp_path):
    meta = stats.page_metadata(readers.vault_pages(spark, vault(tmp_path), ["wiki"]).select("path", "text"))
    rows = {r["path"]: r for r in meta.collect()}
    assert rows["wiki/concepts/One.md"]["tags"] == ["a", "b", "inline"] and str(rows["wiki/concepts/One.md"]["edited"]) == "2023-01-01"
    assert rows["wiki/concepts/Two.md"]["type"] == "untyped" and rows["wiki/concepts/Two.md"]["status"] == "unset"


def test_frontmatter_rewrite(spark):
    text = "---\nA: 1\n# c: d\ngenerated_by: x\nb: 2\nb: 3\n---\nbody --- \n"
    df = spark.createDataFrame([(text,), ("none",)], "t string")
    new = [r[0] for r in df.select(fm.rewrite("t", {"a": F.lit("9"), "generated_by": None, "z": F.lit("8")})).collect()]
    assert new == ["---\na: 9\n# c: d\nb: 2\nb: 3\nz: 8\n---\nbody --- \n", "none"]
    fields = df.select(fm.scalars("t").alias("f")).first()["f"]
    assert fields["b"] == "3" and "# c" not in fields


REPORT = """# R
- [x] approve · `orphan`
### 1. A
- **url**: http://a
- [x] approve · `a`
- [ ] reject · `a`
    - reason:
### 2. B
- [ ] approve · `b`
- [X] Reject . `b`
    - reason:  too old
### 3. C
- [x] approve · `c`
- [x] reject · `c`
- [ ] approve · `d`
    - reason: not for c
### 4. A again
- [ ] approve · `a2`
## Decision trace
### 9. decoy
- [x] approve · `decoy`
"""


def test_review_report(spark):
    reports = spark.createDataFrame([("r", REPORT)], "report_id string, text string")
    got = {(r["id"], r["action"], r["reason"]) for r in review.candidates(reports).collect()}
    assert got == {
        ("orphan", "approve", ""), ("a", "approve", ""), ("b", "reject", "too old"), ("c", "conflict", ""), ("d", "deferred", ""), ("a2", "deferred", ""),
    }
    ledger = spark.createDataFrame([("a", "http://a"), ("orphan", "nope")], "id string, url string")
    backlog = spark.createDataFrame([("d",)], "id string")
    out = {r["id"]: r["outcome"] for r in review.routed(review.candidates(reports), ledger, backlog).collect()}
    assert out == {"a": "approved", "orphan": "blocked", "b": "rejected", "c": "conflict", "d": "deferred", "a2": "backlogged"}


@pytest.fixture
def ledger(spark):
    rows = [("id:p", "pending"), ("id:i", "ingested"), ("id:d", "deleted"), ("id:w", "waiting_approval"), ("id:r", "rejected")]
    return led.migrate(spark.createDataFrame(rows, "id string, status string"))


def state(df):
    return {r["id"]: r["status"] for r in df.collect()}


def test_ledger_transitions(spark, ledger):
    now = F.lit("now")
    files = spark.createDataFrame(
        [("id:d", "explicit", "T", "raw/d.md", "", "note", "h"), ("id:n", "explicit", "N", "raw/n.md", "u", "note", "h")],
        "id string, id_type string, title string, path string, url string, source_type string, content_hash string",
    )
    assert state(led.scan_reconcile(ledger, files, now)) == {
        "id:p": "deleted", "id:i": "deleted", "id:d": "pending", "id:w": "waiting_approval", "id:r": "rejected", "id:n": "pending",
    }
    acts = spark.createDataFrame([("id:w", "approve", ""), ("id:i", "approve", ""), ("id:p", "reject", "no")], "id string, action string, reason string")
    assert state(led.decide(ledger, acts, now)) == {"id:p": "rejected", "id:i": "ingested", "id:d": "deleted", "id:w": "pending", "id:r": "rejected"}
    proposals = led.normalised_proposals(
        spark.createDataFrame(
            [("r", "http://r", "new"), ("i", "http://i", "new"), ("x", "", "new")], "ident string, url string, title string"
        ).select(
            "*", F.lit("").alias("rationale"), F.lit(0.5).alias("relevance_score"), F.lit("web").alias("discovered_by"),
            F.array(F.lit("GAP-1")).alias("objective_ids"), F.lit(None).cast("string").alias("published"), F.lit("").alias("source_id"), F.lit("rss").alias("engine"),
        )
    )
    after = {r["id"]: r for r in led.enqueue(ledger, proposals, now).collect()}
    assert after["id:r"]["title"] == "" and after["id:r"]["status"] == "rejected"
    assert after["id:i"]["status"] == "ingested" and after["id:i"]["url"] == "http://i" and after["id:i"]["objective_ids"] == ["GAP-1"]
    assert after["id:x"]["status"] == "waiting_approval" and after["id:x"]["proposed_at"] == "now"
    again = led.enqueue(led.enqueue(ledger, proposals, now), proposals, now)
    assert {r["id"]: r["objective_ids"] for r in again.collect()}["id:x"] == ["GAP-1"]


def test_json_readers(spark, tmp_path):
    cost = tmp_path / "cost.jsonl"
    cost.write_text('{"date": "2024-01-01", "cost_usd": 1.5, "action": "a"}\n\nnot json\n{"date": "2024-01-02", "cost_usd": 2}\n')
    assert [r["cost_usd"] for r in readers.cost_ledger(spark, str(cost)).orderBy("date").collect()] == [1.5, 2.0]
    doc = tmp_path / "ledger.json"
    doc.write_text(json.dumps({"version": 2, "sources": {"id:a": {"id": "id:a", "status": "ingested", "title": "T"}}}))
    row = readers.source_ledger(spark, str(doc)).first()
    assert (row["id"], row["status"], row["url"], row["objective_ids"]) == ("id:a", "ingested", "", [])
    chunks = tmp_path / "chunks" / "c-1"
    chunks.mkdir(parents=True)
    (chunks / "chunk-000.json").write_text(json.dumps({"page_address": "c-1", "chunk_index": 0, "raw_text": "r"}))
    (chunks / "chunk-001.json").write_text("{broken")
    assert [r["chunk_id"] for r in readers.chunk_records(spark, str(tmp_path / "chunks")).collect()] == ["c-1:0"]
    log = tmp_path / "s1.jsonl"
    log.write_text('{"uuid": "u1", "message": {"role": "assistant", "model": "m", "usage": {"input_tokens": 3, "output_tokens": 1}}}\nbad\n{"uuid": "u2", "message": {"role": "user"}}\n')
    got = readers.transcript(spark, str(log)).orderBy("position").collect()
    assert [(r["session_id"], r["uuid"], r["input_tokens"]) for r in got][0] == ("s1", "u1", 3)


def test_feed_and_registry(spark, tmp_path):
    feed = tmp_path / "feed.xml"
    feed.write_text(
        '<feed><entry><title>New</title><link href="http://n"/><published>2024-02-01T00:00:00Z</published><summary>s</summary></entry>'
        '<entry><title>Old</title><link href="http://o"/><published>2020-01-01T00:00:00Z</published></entry>'
        '<entry><title>Undated</title><link href="http://u"/></entry></feed>'
    )
    from marginalia.operators import harvest

    entries = readers.feed_entries(spark, str(feed), "blog")
    got = {(r["title"], r["published"]) for r in harvest.feed_candidates(entries, "2024-01-01").collect()}
    assert got == {("New", "2024-02-01"), ("Undated", "")}
    (tmp_path / "paper-publisher.json").write_text(json.dumps({"sources": [{"id": "arxiv_x", "category": "preprint_repository", "relevance": 4}]}))
    (tmp_path / "blog-newsfeed.json").write_text(json.dumps({"sources": [{"id": "b", "category": "vendor_blogs"}]}))
    (tmp_path / "github-repos.json").write_text("{broken")
    rows = {r["source_id"]: r for r in readers.registry(spark, str(tmp_path)).collect()}
    assert set(rows) == {"arxiv_x", "b"} and rows["arxiv_x"]["engine"] == "arxiv" and rows["b"]["relevance"] == 0.0


def test_links_block(spark):
    cases = {
        "top": ("body", "L\nbody"), "old": ("a <!-- links:auto -->x$1<!-- /links:auto --> b", "a L b"),
        "pre": ("## For future Claude\nnote\n# Next\nrest", "## For future Claude\nnote\nL\n\n# Next\nrest"),
    }
    df = spark.createDataFrame([(k, v[0]) for k, v in cases.items()], "k string, t string")
    got = {r["k"]: r["x"] for r in df.select("k", objectives.with_links_block(F.col("t"), F.lit("L")).alias("x")).collect()}
    assert got == {k: v[1] for k, v in cases.items()}
