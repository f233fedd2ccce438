"""Blocked overlaps and grid joins against plain loops."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marginalia.operators import decide, overlaps
from marginalia.session import spread_keys


def sides(spark, seed):
    """Sets with one word in all of them, a word of many, rare words, empty, equal and very large sets."""
    rng = np.random.default_rng(seed)
    out = []
    for prefix, n in (("g", 90), ("d", 70)):
        rows = []
        for i in range(n):
            words = {"all"} | {f"w{int(x)}" for x in rng.integers(0, 60, int(rng.integers(0, 25)))} | ({"many"} if i % 3 else set())
            rows.append((f"{prefix}{i}", sorted(words) if i else [], [f"c{i % 4}", f"k{i % 9}"] if i % 5 else []))
        rows.append((f"{prefix}-large", sorted(f"w{i}" for i in range(3000)), ["c1"]))
        rows.append((f"{prefix}-same", rows[7][1], rows[7][2]))
        out.append(rows)
    return [spark.createDataFrame(rows, "id string, terms array<string>, labels array<string>") for rows in out], out


@pytest.mark.parametrize("tokens", [2_000_000, 300])
def test_close_pairs_are_all_that_reach_the_threshold(spark, monkeypatch, tokens):
    monkeypatch.setattr(overlaps, "GROUP_TOKENS", tokens)
    monkeypatch.setattr(overlaps, "CELL_COUNTERS", 500)
    monkeypatch.setattr(overlaps, "MEETINGS", 64)
    (left, right), (lrows, rrows) = sides(spark, tokens)

    def score(a, b):
        x, y = set(a[1]), set(b[1])
        return len(x & y) / max(len(x | y), 1) + min(0.05 * len(set(a[2]) & set(b[2])), 0.10), bool(x & y)

    expected = {(a[0], b[0]) for a in lrows for b in rrows if score(a, b)[1] and score(a, b)[0] >= 0.18 - 1e-9}
    got = [tuple(r) for r in overlaps.close_pairs(left, right, 0.18, 0.05, 0.10).collect()]
    assert len(got) == len(set(got)) and expected <= set(got)
    # one token is granted for equal hashes, no more
    def granted(a, b):
        n = len(set(a[1]) & set(b[1])) + 1
        return n / max(len(a[1]) + len(b[1]) - n, 1) + min(0.05 * len(set(a[2]) & set(b[2])), 0.10) >= 0.18 - 1e-9

    by_id = {r[0]: r for r in lrows + rrows}
    assert all(granted(by_id[a], by_id[b]) for a, b in got)
    assert overlaps.close_pairs(left.where("false"), right, 0.18).count() == 0 == overlaps.close_pairs(left, right.where("false"), 0.18).count()


def test_scores_equal_a_plain_loop(spark):
    (left, right), (lrows, rrows) = sides(spark, 5)
    units = [side.select(F.col("id"), F.col("id").alias("unit"), "terms", F.col("labels").alias("concepts")) for side in (left, right)]
    got = {(r["gap_unit"], r["direction_unit"]): r["score"] for r in decide.match_scores(*units).collect()}
    for a in lrows:
        for b in rrows:
            x, y = set(a[1]), set(b[1])
            score = (len(x & y) / len(x | y) if x and y else 0) + min(0.05 * len(set(a[2]) & set(b[2])), 0.10)
            assert (a[0], b[0]) in got if score >= 0.18 + 1e-9 else score > 0.18 - 1e-9 or (a[0], b[0]) not in got
            assert got.get((a[0], b[0]), score) == pytest.approx(score)


def test_a_hot_key_is_met_in_bounded_cells(spark):
    n, cell = 3000, 100
    rows = spark.range(n).select(F.col("id").alias("left_id"), F.when(F.col("id") < 2900, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 7)).alias("token"))
    other = rows.select(F.col("left_id").alias("right_id"), "token")
    met = decide.gridded(rows, other, ["token"], "left_id", "right_id", cell)
    plain = rows.join(other, "token")
    assert met.count() == plain.count() == met.select("left_id", "right_id").distinct().count()
    # each cell of the hot key holds about cell x cell meetings, none a multiple of it
    cells = met.where("token = 'hot'").groupBy(F.pmod(F.xxhash64("left_id"), F.lit(29)), F.pmod(F.xxhash64("right_id"), F.lit(29))).count()
    assert cells.count() == 29 * 29 and cells.agg(F.max("count")).first()[0] < 2.5 * cell * cell


def test_near_duplicates_of_sets_that_all_share_one_token(spark, monkeypatch):
    monkeypatch.setattr(decide, "CELL_ROWS", 50)
    monkeypatch.setattr(decide.gridded, "__defaults__", (50,))
    rng = np.random.default_rng(3)
    rows = [(i, sorted({"hot"} | {f"w{int(x)}" for x in rng.integers(0, 9, 3)})) for i in range(400)]
    got = {(r["left_id"], r["right_id"]) for r in decide.jaccard_pairs(*[spark.createDataFrame(rows, "id long, terms array<string>")] * 2, 0.6, same_side=True).collect()}
    first = {}
    for i, words in rows:
        first.setdefault(tuple(words), i)
    reps = sorted((i, set(words)) for words, i in first.items())
    assert got == {(i, j) for i, a in reps for j, b in reps if i < j and len(a & b) / len(a | b) >= 0.6}


def test_scores_are_counted_where_pairs_are_found(spark, monkeypatch):
    """No words of close pairs are joined, however many pairs there are; few tokens are dense here, the others are postings."""
    (left, right), _ = sides(spark, 8)
    units = [side.select(F.col("id"), F.col("id").alias("unit"), "terms", F.col("labels").alias("concepts")) for side in (left, right)]
    monkeypatch.setattr(overlaps, "DENSE_ENTRIES", 100)
    scored = decide.match_scores(*units)
    assert "Join" not in scored._jdf.queryExecution().optimizedPlan().toString()
    assert scored.count() > 0


def cell_side(rows):
    """A cell's side as it travels; all tokens are rare ones."""
    lists = [pa.array([r[k] for r in rows], pa.list_(pa.int64())) for k in (1, 2)]
    return pa.table({"id": [r[0] for r in rows], "terms": lists[0], "labels": lists[1], "common": pa.array([[]] * len(rows), pa.list_(pa.int16()))})


@pytest.mark.parametrize("counters, dense", [(1 << 22, 1 << 23), (400, 1 << 23), (400, 0)])
def test_a_cell_multiplies_only_blocks_that_can_have_close_pairs(monkeypatch, counters, dense):
    """Sets lie by labels and size, so a pair of blocks whose sizes are too far apart for its labels is not looked at; the others give all pairs."""
    rng = np.random.default_rng(counters)
    sides = [[(i, [*range(0, n := int(rng.choice([3, 4, 60, 70]))), 1000 + i % 7], [i % 2, 5] if i % 3 else []) for i in range(150)] for _ in range(2)]
    monkeypatch.setattr(overlaps, "CELL_COUNTERS", counters)
    monkeypatch.setattr(overlaps, "DENSE_ENTRIES", dense)
    looked_at, real = [], overlaps.Side.overlaps
    monkeypatch.setattr(overlaps.Side, "overlaps", lambda self, left: looked_at.append(len(left.tokens)) or real(self, left))
    got = overlaps._close(0.18, 0.05, 0.10, None, *[cell_side(rows) for rows in sides]).to_pylist()

    def score(a, b):
        x, y = set(a[1]), set(b[1])
        return len(x & y) / len(x | y) + min(0.05 * len(set(a[2]) & set(b[2])), 0.10)

    expected = {(a[0], b[0]): score(a, b) for a in sides[0] for b in sides[1] if set(a[1]) & set(b[1]) and score(a, b) >= 0.18}
    assert {(r["left_id"], r["right_id"]): r["score"] for r in got} == pytest.approx(expected) and len(got) == len(expected) > 0
    blocks = [-(-150 // math.isqrt(counters))] * 2
    # one product of labels a pair of blocks, and one of words unless it is left out
    assert len(looked_at) == 2 if blocks == [1, 1] else len(looked_at) < 2 * blocks[0] * blocks[1]


@pytest.mark.parametrize("n", [1, 36, 100])
def test_cells_are_dealt_evenly_to_partitions(spark, n):
    keys = spread_keys(spark, n)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = [r["count"] for r in spark.createDataFrame([(k,) for k in keys], "key int").groupBy(F.pmod(F.hash("key"), F.lit(parts))).count().collect()]
    assert len(set(keys)) == n and len(counts) == min(n, parts) and max(counts) - min(counts) <= 1
