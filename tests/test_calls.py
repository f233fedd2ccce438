"""Planned calls and their budgets."""

from pyspark.sql import functions as F

from marginalia.operators import calls

TARGETS = "target_id string, lane string, queries array<string>, queries_by_engine map<string,array<string>>, fillable_by array<string>"
REGISTRY = "source_id string, section string, category string, engine string, feed string, url string, subject string"


def plan(spark, targets, routes, registry):
    found = calls.planned_calls(spark.createDataFrame(targets, TARGETS), spark.createDataFrame(routes, "target_id string, position int, source_id string"), spark.createDataFrame(registry, REGISTRY))
    out = {}
    for r in found.orderBy("target_id", "nth").collect():
        out.setdefault(r["target_id"], []).append((r["engine"], r["query"], r["category"]))
    return out


def test_each_call_once_in_order(spark):
    registry = [
        ("gh", "github-repos", None, None, None, "repo/x", None), ("ar1", "paper-publisher", "p", "arxiv", "f", None, "cs.AR"), ("ar2", "paper-publisher", "p", "arxiv", None, None, "cs.DC"), ("ar3", "paper-publisher", "p", "arxiv", None, None, "cs.AR"),
        ("conf", "paper-publisher", "conference", "openalex", "feed/c", None, None), ("blog", "blog-newsfeed", "v", None, "feed/b", None, None), ("mute", "blog-newsfeed", "v", None, "", None, None), ("oa", "paper-publisher", "p", "openalex", None, None, "cs.AR"), ("pub", "paper-publisher", "p", "", "feed/p", None, None),
    ]
    targets = [
        ("t1", "gap", ["q1", "q2"], {}, ["forum"]), ("t2", "research", ["s"], {"arxiv": ["a1", "a2"]}, []), ("t3", "research", [], {}, []), ("t4", "gap", [], {"forum": ["x", "y", "z"], "openalex": []}, ["web", "forum"]), ("t5", "gap", ["q"], {}, ["arxiv"]), ("t6", "news", [], {}, ["web"]),
    ]
    routes = [("t1", 0, "ar1"), ("t1", 1, "ar2"), ("t1", 2, "ar3"), ("t1", 3, "gh"), ("t2", 0, "ar1"), ("t4", 0, "oa"), ("t4", 1, "nowhere"), ("t6", 0, "blog"), ("t6", 1, "conf"), ("t6", 2, "mute"), ("t6", 3, "pub"), ("t6", 4, "blog")]
    assert plan(spark, targets, routes, registry) == {
        "t1": [("arxiv", "q1", "cs.AR"), ("arxiv", "q2", "cs.AR"), ("arxiv", "q1", "cs.DC"), ("arxiv", "q2", "cs.DC"), ("github", "repo/x", ""), ("hackernews", "q1", ""), ("hackernews", "q2", "")],
        "t2": [("arxiv", "a1", "cs.AR"), ("arxiv", "a2", "cs.AR")], "t3": [("arxiv", "t3", "")], "t4": [("openalex", "t4", ""), ("hackernews", "x", ""), ("hackernews", "y", "")],
        "t6": [("rss", "feed/b", ""), ("rss", "feed/c", ""), ("rss", "feed/p", "")],
    }


def test_budgets_cut_a_prefix_of_each_engine(spark):
    rows = spark.createDataFrame([("big" if i % 10 else f"small{i % 3}", f"{i:05}", 1 + i % 4) for i in range(4000)], "engine string, place string, cost long")
    budgets = spark.createDataFrame([("big", 777), ("small0", 0)], "engine string, budget long")
    got = calls.within_budget(rows, "place", budgets, F.col("cost")).collect()
    kept = {r["engine"]: 0 for r in rows.select("engine").distinct().collect()}
    expected, spent = set(), dict(kept)
    for r in rows.orderBy("place").collect():
        spent[r["engine"]] += r["cost"]
        if spent[r["engine"]] <= {"big": 777, "small0": 0}.get(r["engine"], 10**9):
            expected.add((r["engine"], r["place"], spent[r["engine"]]))
    assert {(r["engine"], r["place"], r["spent"]) for r in got} == expected and len(got) == len(expected)
