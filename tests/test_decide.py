import random

from pyspark.sql import functions as F

from marginalia.operators import decide, learn, objectives
from marginalia.operators.ordering import numbered


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


def random_sets(rng, n, vocabulary, copies):
    out = []
    for _ in range(n):
        out.append(sorted(rng.sample(vocabulary, rng.randint(1, 6))))
    return out + [out[0]] * copies


def test_jaccard_pairs_match_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(14)]
    sets = random_sets(rng, 60, words, 20)
    rows = [(f"{i:03d}", s) for i, s in enumerate(sets)]
    df = spark.createDataFrame(rows, "id string, terms array<string>")
    for threshold in (0.3, 0.6, 0.8):
        first = {}
        for i, s in rows:
            first.setdefault(tuple(s), i)
        reps = [(i, set(s)) for s, i in first.items()]
        wanted = {(a, b, round(jaccard(x, y), 6)) for a, x in reps for b, y in reps if a < b and jaccard(x, y) >= threshold}
        got = {(r["left_id"], r["right_id"], round(r["jaccard"], 6)) for r in decide.jaccard_pairs(df, df, threshold, True).collect()}
        assert got == wanted


def walk(gaps, directions):
    pairs = []
    for g, gt, gc in gaps:
        for d, dt, dc in directions:
            s = round(jaccard(set(gt), set(dt)) + min(len(set(gc) & set(dc)) * 0.05, 0.10), 9)
            if s >= 0.18:
                pairs.append((-s, g, d))
    used, out = set(), set()
    for s, g, d in sorted(pairs):
        if g not in used and d not in used:
            used |= {g, d}
            out.add((g, d, -s))
    return out


def test_greedy_matches_equal_the_sorted_walk_with_copies_and_ties(spark):
    rng = random.Random(11)
    words, concepts = [f"w{i}" for i in range(9)], ["c1", "c2", "c3"]
    for case in range(3):
        def side(prefix, n):
            rows = [(f"{prefix}{i:03d}", s, rng.sample(concepts, rng.randint(0, 2))) for i, s in enumerate(random_sets(rng, n, words, n // 2))]
            return [(i, s, rows[0][2] if s == rows[0][1] else c) for i, s, c in rows]

        gaps, directions = side("g", 14), side("d", 12)
        schema = "id string, terms array<string>, concepts array<string>"
        left = decide.match_units(spark.createDataFrame(gaps, schema))
        right = decide.match_units(spark.createDataFrame(directions, schema))
        found = decide.greedy_matches(left, right, decide.match_scores(left, right))
        assert {(r["gap_id"], r["direction_id"], r["score"]) for r in found.collect()} == walk(gaps, directions), case


def test_greedy_matches_in_narrow_bands_equal_the_sorted_walk(spark, monkeypatch):
    """Bands of few pairs, and levels too large for a band: tables written do not grow with the rounds."""
    rng = random.Random(12)
    words = [f"w{i}" for i in range(9)]

    def side(prefix, n):
        return [(f"{prefix}{i:03d}", s, ["c"]) for i, s in enumerate(random_sets(rng, n, words, n // 2))]

    gaps, directions = side("g", 14), side("d", 12)
    schema = "id string, terms array<string>, concepts array<string>"
    left, right = (decide.match_units(spark.createDataFrame(rows, schema)) for rows in (gaps, directions))
    scores = decide.written(decide.match_scores(left, right))
    real = decide.written
    for band in (2, 20, 1 << 19):
        made = []
        monkeypatch.setattr(decide, "BAND", band)
        monkeypatch.setattr(decide, "written", lambda x: made.append(out := real(x)) or out)
        found = decide.greedy_matches(left, right, scores)
        assert {(r["gap_id"], r["direction_id"], r["score"]) for r in found.collect()} == walk(gaps, directions), band
    assert len(made) <= 10


def test_the_walk_reads_a_pair_in_one_range_only(spark, monkeypatch):
    """Ranges of scores follow one another, and pairs of units used up above a range are not looked at; in bands, pairs were counted and read again for each."""
    rng = random.Random(13)
    gaps, directions = ([(f"{prefix}{i:03d}", sorted({f"w{rng.randrange(9)}" for _ in range(5)}), ["c"]) for i in range(30)] for prefix in "gd")
    schema = "id string, terms array<string>, concepts array<string>"
    left, right = (decide.match_units(spark.createDataFrame(rows, schema)) for rows in (gaps, directions))
    scores = decide.written(decide.match_scores(left, right))
    monkeypatch.setattr(decide, "BAND", 60)
    seen, real = [], decide._Walk.down
    monkeypatch.setattr(decide._Walk, "down", lambda self, pairs: seen.append({tuple(r) for r in pairs.select("gap_unit", "direction_unit").collect()}) or real(self, pairs))
    found = decide.greedy_matches(left, right, scores, is_written=True)
    assert {(r["gap_id"], r["direction_id"], r["score"]) for r in found.collect()} == walk(gaps, directions)
    assert len(seen) > 1 and sum(map(len, seen)) == len(set().union(*seen)) < scores.count()


def test_routes_meet_classes_of_feeds(spark, monkeypatch):
    """However many feeds hold the same keywords, a keyword list meets them once."""
    rng = random.Random(8)
    words = ["large", "ring", "hot", "bolt", "rin", "g b"]
    feeds = [(f"s{i:03d}", " ".join(rng.sample(words, 2)), "N", "blog-newsfeed", "x", rng.randint(1, 3)) for i in range(120)]
    reg = spark.createDataFrame(feeds, "source_id string, focus string, name string, section string, category string, relevance long")
    wanted = [(f"t{i}", ["web"], [rng.choice([*words, "Ring", "", None]) for _ in range(3)]) for i in range(25)]
    plain = set()
    for target, _, keys in wanted:
        value = [(-(r + 0.5 * sum(1 for k in keys if k and k.lower() in f"{focus} n")), s) for s, focus, _, _, _, r in feeds]
        plain |= {(target, n + 1, s) for n, (_, s) in enumerate(sorted(value)[:5])}
    seen, real = [], decide.gridded
    monkeypatch.setattr(decide, "gridded", lambda *a: seen.append(real(*a)) or seen[-1])
    routed = decide.routed_sources(spark.createDataFrame(wanted, "target_id string, fillable_by array<string>, keywords array<string>"), reg)
    assert {tuple(r) for r in routed.collect()} == plain
    # at most 2 ** 6 classes of 120 feeds, of which a word is held by far fewer
    assert seen and seen[0].count() <= 25 * 3 * 20


def test_no_match_gives_an_empty_result(spark):
    schema = "id string, terms array<string>, concepts array<string>"
    left = decide.match_units(spark.createDataFrame([("g", ["aaaa"], ["c"])], schema))
    right = decide.match_units(spark.createDataFrame([("d", ["bbbb"], ["c"])], schema))
    assert decide.greedy_matches(left, right, decide.match_scores(left, right)).count() == 0


def pick(rows, lanes, quotas, cap):
    pools = {lane: sorted((r for r in rows if r[1] == lane), key=lambda r: (-r[2], r[0])) for lane in lanes}
    chosen, rest, spare = [], [], 0
    for lane in lanes:
        q = quotas.get(lane, 0)
        chosen += pools[lane][:q]
        rest += pools[lane][q:]
        spare += max(0, q - len(pools[lane]))
    return [r[0] for r in (chosen + rest[: max(spare, 0)])[:cap]]


def test_selection_matches_brute_force(spark):
    rng = random.Random(3)
    for quotas, cap in (({"gap": 3, "research": 1, "news": 1}, 5), ({"gap": 0, "research": 4, "news": 2}, 9), ({"gap": 5, "research": 5, "news": 5}, 7)):
        rows = [(i, rng.choice(["gap", "gap", "gap", "news", "other"]), round(rng.random(), 2)) for i in range(40)]
        df = spark.createDataFrame(rows, "cand_id int, lane string, score double")
        got = decide.select_candidates(df, decide.LANES, quotas, cap).orderBy("slot").collect()
        assert [r["cand_id"] for r in got] == pick(rows, decide.LANES, quotas, cap)


def test_numbered_over_one_hot_group(spark):
    df = spark.range(2000).select(F.when(F.col("id") % 10 == 0, "cold").otherwise("hot").alias("g"), F.col("id").alias("k"))
    got = numbered(df, "g", "k").groupBy("g").agg(F.min("n"), F.max("n"), F.count_distinct("n")).collect()
    assert {tuple(r) for r in got} == {("hot", 1, 1800, 1800), ("cold", 1, 200, 200)}


def fold(rows):
    means, n = {True: 0.0, False: 0.0}, 0
    for _, accepted, x in sorted(rows):
        means[accepted] += (x - means[accepted]) / (n + 1)
        n += 1
    return round(means[True], 6), round(means[False], 6), n


def test_calibration_parts_compose_to_the_fold(spark):
    rng = random.Random(9)
    rows = [(i, rng.random() < 0.4, round(rng.random(), 3)) for i in range(57)]
    df = spark.createDataFrame(rows, "id int, accepted boolean, relevance_score double")
    for size in (1, 7, 100):
        assert tuple(learn.calibration(df, F.floor(F.col("id") / size)).first()) == fold(rows)
    assert tuple(learn.calibration(df.limit(0), F.col("id")).first()) == (0.0, 0.0, 0)


def test_reputation_examples(spark):
    from marginalia.functions.scoring import reputation

    df = spark.createDataFrame([(0, 0), (0, 1), (1, 0), (3, 0), (0, 3)], "a int, r int")
    got = [r[0] for r in df.select(reputation(F.col("a"), F.col("r"))).collect()]
    assert got == [0.0, -0.333333, 0.333333, 0.6, -0.6]


def test_wordless_proposals_and_questions_meet(spark):
    nodes = spark.createDataFrame(
        [("QP-2", "research_question_proposal", "pending", "", "of it"), ("QP-1", "research_question_proposal", "pending", "", "is a"),
         ("Q-1", "research_question", "", "no", "the"), ("Q-2", "research_question", "", "no", "real words here")],
        "id string, type string, status string, solved string, body string",
    )
    redundant = {(r["id"], r["other"]) for r in objectives.redundant_proposals(nodes).collect()}
    assert redundant == {("QP-1", "Q-1"), ("QP-2", "Q-1")}
    assert [(r["id"], r["other"]) for r in objectives.duplicate_proposals(nodes).collect()] == [("QP-1", "QP-2")]


def test_linkify_leaves_links_and_unknown_ids(spark):
    texts = spark.createDataFrame([("k", "See Q-0001 and [[Q-0001]], TODO-0002 [[open Q-0001 QP-0009 TBD-0001")], "key string, text string")
    paths = spark.createDataFrame([("Q-0001", "objective/research_question/Q-0001-x"), ("TODO-0002", "t/Q-0001")], "id string, path string")
    got = objectives.linkified(texts, paths).first()["text"]
    assert got == (
        "See [[objective/research_question/Q-0001-x]] and [[Q-0001]], [[t/Q-0001]] [[open [[objective/research_question/Q-0001-x]] QP-0009 TBD-0001"
    )
