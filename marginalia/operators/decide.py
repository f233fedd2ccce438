"""Targets, lanes, routing and candidate selection.

Similarity joins never build the full product. Two texts meet only if they
share a token of their rarest-first prefix, which is exact for the threshold
asked; equal token sets are folded to one representative before they meet.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marginalia.functions import identity, prose
from marginalia.functions.basics import bind, present, strip
from marginalia.functions.scoring import PRIORITY_RANK, rank_of
from marginalia.functions.tokens import jaccard_or_zero
from marginalia.operators import overlaps, prefixes, walks
from marginalia.operators.harvest import first_of_each
from marginalia.operators.ordering import numbered
from marginalia.session import BROADCAST_ROWS, cut_lineage, discard, written
from marginalia.shipping import ship

# Thresholds, categories and selection defaults.
MERGE_THRESHOLD = 0.18
CONCEPT_BONUS = 0.05
CONCEPT_BONUS_CAP = 0.10
PAPER_CATEGORIES = ["preprint_repository", "paper_api", "research_aggregator"]
NEWS_CATEGORIES = ["vendor_blogs", "benchmarking", "hardware_analysis", "specialist_research"]
ROUTED_SOURCES = 5
LANES = ["gap", "research", "news"]
QUOTAS = {"gap": 3, "research": 1, "news": 1}
TOTAL_CAP = 5
NEWS_EVIDENCE = "recent vendor/analyst announcement relevant to the vault PURPOSE"
# End of the fixed values.


#: rows of one key that a cell of a grid join takes from each side
CELL_ROWS = 2_000
#: live pairs that the greedy walk takes at a time, and levels of scores from 0 to 1 that are counted
BAND, LEVELS = 1 << 21, 10_000


# ---- similarity join ----------------------------------------------------------


def distinct_sets(rows: DataFrame) -> DataFrame:
    """``(set_id, terms, members)``: one row per distinct token set.

    Copies meet once: the set is keyed by its hash, the smallest id stands for
    all members.
    """
    keyed = rows.select("id", F.sort_array("terms").alias("terms"))
    return keyed.groupBy("terms").agg(F.min("id").alias("set_id"), F.count(F.lit(1)).alias("members"))


def set_members(rows: DataFrame) -> DataFrame:
    """``(id, set_id)``: which representative stands for each row; sets are told apart by a digest, so no words are shuffled."""
    keyed = rows.select("id", F.sha2(F.to_json(F.sort_array("terms")), 256).alias("digest"))
    reps = keyed.groupBy("digest").agg(F.min("id").alias("set_id"))
    return keyed.join(reps, "digest").select("id", "set_id")


def jaccard_pairs(left: DataFrame, right: DataFrame, threshold: float, same_side: bool) -> DataFrame:
    """Pairs ``(left_id, right_id, jaccard)`` of distinct sets at ``threshold`` or more, with how many rows have each set.

    Exact: candidates come from shared prefix tokens, compatible sizes and sketches, every candidate is then verified on
    the whole sets (``prefixes``). Shuffled are sets and close pairs, not meetings in a token.
    """
    return prefixes.jaccard_pairs(prefixes.hashed([left] if same_side else [left, right], threshold), threshold)


def jaccard_members(left: DataFrame, right: DataFrame, threshold: float, same_side: bool) -> tuple[DataFrame, list[DataFrame]]:
    """The pairs of ``jaccard_pairs`` and, of each side, ``(id, set_id, n)``: the representative and the size of every row's set, empty ones too."""
    sets = prefixes.hashed([left] if same_side else [left, right], threshold, with_members=True)
    return prefixes.jaccard_pairs(sets, threshold), [s.members for s in sets]


def gridded(left: DataFrame, right: DataFrame, keys: list[str], left_id: str, right_id: str, cell: int = CELL_ROWS) -> DataFrame:
    """Equi-join on ``keys`` whose hot keys are dealt to a grid of cells.

    The left rows of a key lie in rows of the grid, its right rows in columns, about ``cell`` of them in each; a left row goes to
    every column, a right one to every row, and each pair meets in exactly one cell. So no task gets more than
    about ``cell`` x ``cell`` meetings of a key, however many rows share it. A key with few rows is one cell.
    """
    def sizes(side: DataFrame, name: str) -> DataFrame:
        return side.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > cell).select(*keys, F.ceil(F.col("n") / cell).cast("int").alias(name))

    # keys of more than ``cell`` rows on a side, which are a ``cell``-th of the rows at most
    hot = cut_lineage(sizes(left, "rows").join(sizes(right, "columns"), keys, "full"))
    hot = hot.select(*keys, *[F.coalesce(n, F.lit(1)).alias(n) for n in ("rows", "columns")])
    few = hot.count() <= BROADCAST_ROWS

    def dealt(side: DataFrame, ident: str, own: str, other: str) -> DataFrame:
        known = side.join(F.broadcast(hot) if few else hot, keys, "left")
        return known.withColumn(f"_{own}", F.pmod(F.xxhash64(ident), F.coalesce(own, F.lit(1))).cast("int")).withColumn(
            f"_{other}", F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1))
        ).drop("rows", "columns")

    return dealt(left, left_id, "rows", "columns").join(dealt(right, right_id, "columns", "rows"), [*keys, "_rows", "_columns"]).drop("_rows", "_columns")


# ---- gap x direction matching -------------------------------------------------


def match_units(rows: DataFrame) -> DataFrame:
    """Rows of equal words and concepts folded to units ``(unit, id)``; units are told apart by a digest, so no words are shuffled for that."""
    keyed = rows.select("id", F.sort_array("terms").alias("terms"), F.sort_array(F.array_distinct("concepts")).alias("concepts"))
    keyed = written(keyed.withColumn("digest", F.sha2(F.to_json(F.struct("terms", "concepts"), {"ignoreNullFields": "false"}), 256)))
    units = keyed.groupBy("digest").agg(F.min("id").alias("unit"))
    return keyed.join(written(units), "digest").drop("digest")


def _unit_sets(members: DataFrame) -> DataFrame:
    return members.where(F.col("id") == F.col("unit")).select("unit", "terms", "concepts")


def match_scores(gap_units: DataFrame, direction_units: DataFrame) -> DataFrame:
    """``(gap_unit, direction_unit, score)`` of unit pairs at the threshold.

    The concept bonus is 0.05 per shared concept, at most 0.10, so a pair with common concepts needs a Jaccard of
    as little as 0.08. Overlaps are counted exactly as a blocked matrix product (``overlaps``), and only scores leave it.
    """
    sides = [_unit_sets(side).select(F.col("unit").alias("id"), "terms", F.col("concepts").alias("labels")) for side in (gap_units, direction_units)]
    scored = overlaps.scored_pairs(*sides, MERGE_THRESHOLD, CONCEPT_BONUS, CONCEPT_BONUS_CAP).toDF("gap_unit", "direction_unit", "score")
    return scored.withColumn("score", F.round("score", 9)).where(F.col("score") >= MERGE_THRESHOLD)


def greedy_matches(gap_units: DataFrame, direction_units: DataFrame, scores: DataFrame, is_written: bool = False) -> DataFrame:
    """One-to-one matches a greedy walk by (score desc, gap, direction) takes.

    The walk runs over units of equal rows, whose rows are taken in order. It goes down the scores in ranges: what a range takes does not
    depend on pairs below it, and pairs of units that are used up by then are dropped as the range is read, which leaves few of most. So
    each pair is read once in all, and a range is as large as about ``BAND`` live pairs need. A range is walked by itself (``walks``), or, if more is
    left of it, in bands of whole score levels. A band that cannot be so small (one level of more pairs, or units of more than
    ``BAND`` free rows) is paired off in distributed rounds of mutual firsts until it can. State between bands is the rows taken.
    Pairs are written once (``is_written``: they are a written table already).
    """
    pairs = scores if is_written else written(scores)
    # only rows whose unit has a pair can be matched
    members = [
        written(numbered(units.join(pairs.select(F.col(f"{side}_unit").alias("unit")).distinct(), "unit", "left_semi").select("unit", "id"), "unit", "id"))
        for units, side in ((gap_units, "gap"), (direction_units, "direction"))
    ]
    walk = _Walk(members)
    levels = pairs.groupBy(F.floor(F.col("score") * LEVELS).alias("level")).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("low"))
    levels = levels.orderBy(F.col("level").desc()).collect()
    at, upper, share = 0, None, 1.0
    while at < len(levels):
        end, given = at, 0
        while end < len(levels) and (end == at or (given + levels[end]["n"]) * share <= BAND):
            given += levels[end]["n"]
            end += 1
        own = pairs.where(F.col("score") >= levels[end - 1]["low"])
        rows = written(walk.unspent(own if upper is None else own.where(F.col("score") < upper)))
        share = max(walk.down(rows), 1) / given
        discard(rows)
        at, upper = end, levels[end - 1]["low"]
    if not walk.taken:
        return pairs.select(F.col("gap_unit").alias("gap_id"), F.col("direction_unit").alias("direction_id"), "score")
    return reduce(DataFrame.unionByName, walk.taken).select("gap_id", "direction_id", "score")


class _Walk:
    """The rows that the greedy walk has taken so far, and the units without a free row."""

    def __init__(self, members: list[DataFrame]):
        self.members = members
        self.sizes = [rows.groupBy("unit").agg(F.max("n").alias("size")) for rows in members]
        self.taken: list[DataFrame] = []
        self.used: DataFrame | None = None
        self.spent: list[DataFrame] = []

    def unspent(self, pairs: DataFrame) -> DataFrame:
        """The pairs whose units both have a free row."""
        for side, spent in zip(("gap", "direction"), self.spent):
            pairs = pairs.join(F.broadcast(spent) if spent.count() <= BROADCAST_ROWS else spent, f"{side}_unit", "left_anti")
        return pairs

    def down(self, pairs: DataFrame) -> int:
        """Walk down a table of live pairs that ranks before all others left; how many pairs it had."""
        n = left = stored = pairs.count()
        live, made = pairs, []
        while left:
            least = None if left <= BAND else _band(live)[1]
            if left * 2 < stored:
                made.append(live := written(live))
                stored = left
            top = live if least is None else written(live.where(F.col("score") >= least))
            free = [_free(rows, self.used, top, side) for rows, side in zip(self.members, ("gap", "direction"))]
            walked = max(left if least is None else top.count(), *[rows.count() for rows in free]) <= 2 * BAND
            self.take(_walked(top, *free) if walked else _mutual_round(top, *self.members, self.used))
            if least is not None:
                discard(top)
            elif walked:
                break
            live = self.unspent(made[-1] if made else pairs)
            left = live.count()
        for table in made:
            discard(table)
        return n

    def take(self, found: DataFrame) -> None:
        """Mark these matched rows as taken."""
        self.taken.append(written(found))
        ends = F.array(*[F.struct(F.lit(side).alias("side"), F.col(f"{side}_unit").alias("unit")) for side in ("gap", "direction")])
        done = reduce(DataFrame.unionByName, self.taken).select(F.explode(ends).alias("u"))
        self.used = written(done.groupBy("u.side", "u.unit").agg(F.count(F.lit(1)).alias("used")))
        self.spent = [
            written(self.used.where(F.col("side") == side).join(size, "unit").where("used >= size").select(F.col("unit").alias(f"{side}_unit")))
            for side, size in zip(("gap", "direction"), self.sizes)
        ]


def _band(live: DataFrame) -> tuple[int, float] | None:
    """How many live pairs there are, and the least score of the next band."""
    # shares of the pairs, each half as much again as the one before
    shares = [1.5**-i for i in range(45)]
    quantiles = F.percentile_approx(-F.col("score"), F.array(*[F.lit(s) for s in shares]), F.lit(10_000))
    row = live.agg(F.count(F.lit(1)).alias("n"), quantiles.alias("q"), F.min("score").alias("low")).first()
    if not row["n"]:
        return None
    if row["n"] <= BAND:
        return row["n"], row["low"]
    return row["n"], next((-q for share, q in zip(shares, row["q"]) if share * row["n"] <= BAND), -row["q"][-1])


def _free(members: DataFrame, used: DataFrame | None, pairs: DataFrame, side: str) -> DataFrame:
    """Free rows of the units of ``pairs``: ``unit, n, id``."""
    rows = members.join(pairs.select(F.col(f"{side}_unit").alias("unit")).distinct(), "unit", "left_semi")
    if used is not None:
        own = used.where(F.col("side") == side).select("unit", "used")
        rows = rows.join(own, "unit", "left").where(F.col("n") > F.coalesce("used", F.lit(0)))
    return rows.select("unit", "n", "id")


def _walked(pairs: DataFrame, gaps: DataFrame, directions: DataFrame) -> DataFrame:
    """Rows that the walk over one band takes; a band is bounded, whatever the tables hold."""
    ship(pairs.sparkSession)
    kinds = [pairs.schema["gap_unit"].dataType, pairs.schema["direction_unit"].dataType, gaps.schema["id"].dataType, directions.schema["id"].dataType]
    names = ["gap_unit", "direction_unit", "gap_id", "direction_id"]
    schema = ", ".join([*[f"{n} {k.simpleString()}" for n, k in zip(names, kinds)], "score double"])
    rows = gaps.select(F.lit(0).alias("side"), F.col("unit").alias("gap_unit"), F.lit(None).cast(kinds[1]).alias("direction_unit"), "n", F.col("id").alias("gap_id"), F.lit(None).cast(kinds[3]).alias("direction_id")).unionByName(
        directions.select(F.lit(1).alias("side"), F.lit(None).cast(kinds[0]).alias("gap_unit"), F.col("unit").alias("direction_unit"), "n", F.lit(None).cast(kinds[2]).alias("gap_id"), F.col("id").alias("direction_id"))
    )
    band = F.lit(0).alias("band")
    keyed = pairs.select(band, "gap_unit", "direction_unit", "score").groupBy("band"), rows.select(band, "*").groupBy("band")
    return keyed[0].cogroup(keyed[1]).applyInArrow(walks.walked, schema)


def _mutual_round(pairs: DataFrame, gaps: DataFrame, directions: DataFrame, used: DataFrame | None) -> DataFrame:
    """Rows of the unit pairs that come first for both their sides, as many as no tied rival could claim before them."""
    live = pairs.join(_heads(gaps, used, "gap"), "gap_unit").join(_heads(directions, used, "direction"), "direction_unit")
    place = F.struct((-F.col("score")).alias("s"), F.col("gap_head").alias("g"), F.col("direction_head").alias("d"))
    return _paired_rows(_mutual_firsts(written(live.withColumn("place", place))), gaps, directions).select("gap_unit", "direction_unit", "gap_id", "direction_id", "score")


def _heads(members: DataFrame, used: DataFrame | None, side: str) -> DataFrame:
    """Next free row of every unit that still has one.

    Rows of a unit are taken in order, so the number taken tells the next one.
    """
    if used is None:
        first = members.where("n = 1").withColumn("used", F.lit(0).cast("bigint"))
    else:
        own = used.where(F.col("side") == side).select("unit", F.col("used").alias("done"))
        counted = members.join(own, "unit", "left").withColumn("used", F.coalesce("done", F.lit(0)))
        first = counted.where(F.col("n") == F.col("used") + 1)
    return first.select(F.col("unit").alias(f"{side}_unit"), F.col("id").alias(f"{side}_head"), F.col("used").alias(f"{side}_used"))


def _mutual_firsts(live: DataFrame) -> DataFrame:
    """Unit pairs first on both sides, with the rival heads they tie with."""
    by_gap = live.groupBy("gap_unit").agg(F.min("place").alias("gap_first"))
    by_direction = live.groupBy("direction_unit").agg(F.min("place").alias("direction_first"))
    seen = live.join(by_gap, "gap_unit").join(by_direction, "direction_unit")
    mutual = seen.where((F.col("place") == F.col("gap_first")) & (F.col("place") == F.col("direction_first")))

    def rivals(key: str, first: str, head: str, name: str) -> DataFrame:
        tied = seen.where((F.col("place") != F.col(first)) & (F.col("place.s") == F.col(f"{first}.s")))
        return tied.groupBy(key).agg(F.min(head).alias(name))

    return mutual.join(rivals("gap_unit", "gap_first", "direction_head", "direction_bound"), "gap_unit", "left").join(
        rivals("direction_unit", "direction_first", "gap_head", "gap_bound"), "direction_unit", "left"
    )


def _paired_rows(chosen: DataFrame, gaps: DataFrame, directions: DataFrame) -> DataFrame:
    """Rows of the chosen unit pairs, matched in order up to the rivals' heads."""
    def free(members: DataFrame, side: str) -> DataFrame:
        bound = F.col(f"{side}_bound")
        mine = chosen.select("gap_unit", "direction_unit", "score", f"{side}_used", f"{side}_bound")
        rows = members.join(mine, members["unit"] == mine[f"{side}_unit"]).where(
            (F.col("n") > F.col(f"{side}_used")) & (bound.isNull() | (F.col("id") < bound))
        )
        return rows.select(
            "gap_unit", "direction_unit", "score", (F.col("n") - F.col(f"{side}_used")).alias("nth"), F.col("id").alias(f"{side}_id")
        )

    return free(gaps, "gap").join(free(directions, "direction").drop("score"), ["gap_unit", "direction_unit", "nth"])


def targets(gaps: DataFrame, directions: DataFrame, matches: DataFrame) -> DataFrame:
    """Merged targets, lone gaps and lone directions.

    ``gaps(id, title, missing, priority, fillable_by)``,
    ``directions(id, evidence, priority, engines, seeds)``.
    """
    g = gaps.select([F.col(c).alias(f"g_{c}") for c in gaps.columns])
    d = directions.select([F.col(c).alias(f"d_{c}") for c in directions.columns])
    m = matches.select(F.col("gap_id").alias("g_id"), F.col("direction_id").alias("d_id"))
    joined = g.join(m, "g_id", "left").join(d, "d_id", "full")
    has_gap, has_direction = F.col("g_id").isNotNull(), F.col("d_priority").isNotNull()
    prank = rank_of(F.col("g_priority"), PRIORITY_RANK, 1) <= rank_of(F.col("d_priority"), PRIORITY_RANK, 1)
    own = prose.gap_queries(F.col("g_title"), F.col("g_missing"))
    empty = F.expr("cast(array() as array<string>)")
    return joined.select(
        F.concat_ws("+", "g_id", F.when(has_direction, F.col("d_id"))).alias("target_id"),
        F.when(has_gap, F.lit("gap")).otherwise(F.lit("research")).alias("lane"),
        F.array_compact(F.array("g_id", F.when(has_direction, F.col("d_id")))).alias("origin_ids"),
        F.when(~has_gap, F.col("d_priority")).when(~has_direction | prank, F.col("g_priority")).otherwise(F.col("d_priority")).alias("priority"),
        F.when(has_direction & (F.size("d_seeds") > 0), F.col("d_seeds")).when(has_gap, own).otherwise(empty).alias("queries"),
        F.when(has_direction, F.col("d_evidence")).otherwise(F.col("g_missing")).alias("expected_evidence"),
        F.array_union(F.coalesce("g_fillable_by", empty), F.coalesce("d_engines", empty)).alias("fillable_by"),
    )


def in_lane_order(found: DataFrame) -> DataFrame:
    """Gap lane by priority then paper-fillable, research lane by priority."""
    lane = F.when(F.col("lane") == "gap", F.lit(0)).otherwise(F.lit(1))
    papers = F.when((F.col("lane") == "gap") & ~F.array_contains("fillable_by", "arxiv"), F.lit(1)).otherwise(F.lit(0))
    return found.select(
        "*", lane.alias("lane_rank"), rank_of(F.col("priority"), PRIORITY_RANK, 1).alias("priority_rank"), papers.alias("paper_rank")
    ).orderBy("lane_rank", "priority_rank", "paper_rank", "target_id")


def news_sources(registry: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """The five news feeds of highest weighted relevance."""
    weighted = F.col("relevance") * category_weight(F.col("category"), weights)
    return (
        registry.where((F.col("section") == "blog-newsfeed") & F.col("category").isin(*NEWS_CATEGORIES))
        .select("source_id", F.round(weighted, 6).alias("weighted"))
        .orderBy(F.col("weighted").desc(), "source_id")
        .limit(ROUTED_SOURCES)
    )


def category_weight(category: Column, weights: dict[str, float] | None) -> Column:
    if not weights:
        return F.lit(1.0)
    out = F.lit(float(weights.get("_default", 1.0)))
    for key, value in weights.items():
        if key != "_default":
            out = F.when(category == key, F.lit(float(value))).otherwise(out)
    return out


# ---- routing ------------------------------------------------------------------


def target_keywords(concepts: Column, title: Column, queries: Column) -> Column:
    """Up to twenty words a target's sources should speak of."""
    def long_words(text: Column) -> Column:
        return F.filter(F.split(F.lower(text), r"\s+"), lambda w: F.length(w) > 3)

    asked = F.flatten(F.transform(F.slice(queries, 1, 2), long_words))
    return F.slice(F.concat(concepts, long_words(title), asked), 1, 20)


def routed_sources(wanted: DataFrame, registry: DataFrame, reputations: DataFrame | None = None) -> DataFrame:
    """``(target_id, position, source_id)``: up to five sources per target.

    ``wanted(target_id, fillable_by, keywords)``. Each tag ranks its section of
    the registry; a source counts at its first tag. Sections whose rank does not
    depend on the target are cut to five before they meet the targets: a source
    in the first five over all tags is always in the first five of its own tag.
    """
    reg = registry.withColumn("rep", F.lit(0.0))
    if reputations is not None:
        reg = registry.join(reputations.select("source_id", "rep"), "source_id", "left").withColumn(
            "rep", F.coalesce("rep", F.lit(0.0))
        )
    base = F.round(F.col("relevance") + F.col("rep"), 6)
    def first_five(section: str, tag: str, kept: Column) -> DataFrame:
        rows = reg.where((F.col("section") == section) & kept).select(F.lit(tag).alias("tag"), "source_id", base.alias("value"))
        return rows.orderBy(F.col("value").desc(), "source_id").limit(ROUTED_SOURCES)

    tops = (
        first_five("paper-publisher", "arxiv", F.col("category").isin(*PAPER_CATEGORIES))
        .unionByName(first_five("github-repos", "github", F.lit(True)))
        .unionByName(first_five("blog-newsfeed", "web", F.lit(True)))
    )
    # one row: the five of each tag
    def of_tag(tag: str) -> Column:
        return F.collect_list(F.when(F.col("tag") == tag, F.struct("value", "source_id"))).alias(f"{tag}_top")

    tops = tops.agg(*[of_tag(tag) for tag in ("arxiv", "github", "web")])
    asked = wanted.select("target_id", "fillable_by", _asked(F.col("keywords")).alias("asked"))
    best = _keyword_routes(asked.where(F.exists("fillable_by", lambda t: F.lower(t) == "web")).select("asked"), reg, base)
    joined = asked.join(F.broadcast(best) if best.count() <= BROADCAST_ROWS else best, "asked", "left").crossJoin(F.broadcast(tops))
    none = F.expr("cast(array() as array<struct<value: double, source_id: string>>)")

    def entries(tag: Column, at: Column) -> Column:
        web = F.concat("web_top", F.coalesce("feeds", none))
        own = F.when(F.lower(tag) == "arxiv", F.col("arxiv_top")).when(F.lower(tag) == "github", F.col("github_top")).when(F.lower(tag) == "web", web).otherwise(none)
        return F.transform(own, lambda x: F.struct(at.alias("tag_pos"), (-x["value"]).alias("neg"), x["source_id"].alias("source_id")))

    def firsts(found: Column) -> Column:
        """The first five sources, each at its first place: places by tag, value and id."""
        return F.slice(F.array_distinct(F.transform(F.sort_array(found), lambda x: x["source_id"])), 1, ROUTED_SOURCES)

    # a target's candidates are an array of a few entries: no candidate is a row that is shuffled or aggregated
    found = joined.select("target_id", F.flatten(F.transform("fillable_by", entries)).alias("found")).where(F.size("found") > 0)
    found = found.groupBy("target_id").agg(F.flatten(F.collect_list("found")).alias("found"))
    return found.select("target_id", F.posexplode(firsts(F.col("found"))).alias("position", "source_id")).select(
        "target_id", (F.col("position") + 1).cast("bigint").alias("position"), "source_id"
    )


def _asked(keywords: Column) -> Column:
    """A keyword list as it is looked for: lower-cased, in order, repeats kept."""
    return F.sort_array(F.filter(F.transform(keywords, lambda k: F.lower(k)), lambda k: k != ""))


def _grams(text: Column) -> Column:
    """Distinct pieces of one to four characters of a text."""
    def of_size(k: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(text) - k + 1, F.lit(1)))
        return F.transform(starts, lambda i: F.substring(text, i, F.lit(k)))

    return F.array_distinct(F.concat(*[of_size(k) for k in (1, 2, 3, 4)]))


def _keyword_routes(asked: DataFrame, reg: DataFrame, base: Column) -> DataFrame:
    """``(asked, feeds)``: the five feeds of highest value whose focus text holds one of the keywords, half a point per hit.

    Distinct keywords meet the distinct focus texts on the keyword's first four characters and
    are then verified. Feeds that hold the same keywords get the same hits from every target, so of each such class its five of highest
    base can be among anybody's best five: classes, not feeds, meet the distinct keyword lists, a list and a class once, on
    the first word that they share.
    """
    focus = F.lower(F.concat_ws(" ", "focus", "name"))
    feeds = reg.where(F.col("section") == "blog-newsfeed").select("source_id", base.alias("base"), focus.alias("focus"))
    lists = written(asked.distinct().where(F.size("asked") > 0))
    list_words = lists.select("asked", F.explode(F.array_distinct("asked")).alias("kw"))
    words = list_words.select("kw").distinct().withColumn("gram", F.substring("kw", 1, 4))
    texts = feeds.select("focus").distinct()
    pieces = texts.select("focus", F.explode_outer(_grams(F.col("focus"))).alias("gram")).where(present("gram"))
    held = words.join(pieces, "gram").where(F.contains("focus", F.col("kw"))).groupBy("focus").agg(F.sort_array(F.collect_set("kw")).alias("held"))
    place = Window.partitionBy("held").orderBy(F.col("base").desc(), "source_id")
    first = feeds.join(held, "focus").select("held", "source_id", "base", F.row_number().over(place).alias("n")).where(F.col("n") <= ROUTED_SOURCES)
    classes = written(first.groupBy("held").agg(F.collect_list(F.struct("source_id", "base")).alias("feeds")))
    met = gridded(list_words, classes.select("held", "feeds", F.explode("held").alias("kw")), ["kw"], "asked", "held")
    met = met.where(F.array_min(F.array_intersect("asked", "held")) == F.col("kw"))
    hits = F.size(F.filter("asked", lambda w: F.array_contains("held", w)))
    valued = met.select("asked", hits.alias("hits"), F.explode("feeds").alias("f")).select(
        "asked", "f.source_id", F.round(F.col("f.base") + F.col("hits") * 0.5, 6).alias("value")
    )
    order = Window.partitionBy("asked").orderBy(F.col("value").desc(), "source_id")
    best = valued.withColumn("n", F.row_number().over(order)).where(F.col("n") <= ROUTED_SOURCES)
    return written(best.groupBy("asked").agg(F.collect_list(F.struct("value", "source_id")).alias("feeds")))


# ---- selection ----------------------------------------------------------------


def best_per_item(candidates: DataFrame) -> DataFrame:
    """Highest-scored candidate of every identity; rows without one all stay."""
    keyed = candidates.withColumn("ident", identity.item_identity(F.col("source_id"), F.col("url")))
    named = first_of_each(keyed.where("ident <> ''"), "ident", -F.round(F.col("score"), 9), "cand_id")
    return named.unionByName(keyed.where("ident = ''"))


def lane_ranks(candidates: DataFrame, keep: int) -> DataFrame:
    """First ``keep`` rows of each lane by score with their rank.

    A lane is cut to ``keep`` rows in each of many parts first, so a lane with most of the rows
    is no hot task, whatever ``keep`` is; the second ranking sees at most that many rows a part.
    """
    best = [F.round("score", 9).desc(), F.col("cand_id")]
    parts = int(candidates.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = candidates.withColumn("_part", F.pmod(F.xxhash64("cand_id"), F.lit(parts)))
    first = dealt.withColumn("_rank", F.row_number().over(Window.partitionBy("lane", "_part").orderBy(*best))).where(F.col("_rank") <= keep)
    order = Window.partitionBy("lane").orderBy(*best)
    return first.drop("_part", "_rank").withColumn("lane_pos", F.row_number().over(order)).where(F.col("lane_pos") <= keep)


def select_candidates(
    candidates: DataFrame,
    lanes: list[str] = LANES,
    quotas: dict[str, int] = QUOTAS,
    cap: int = TOTAL_CAP,
) -> DataFrame:
    """Quotas per lane, spare slots to the leftovers in lane order, total cap.

    At most quota + all quotas of a lane can be chosen, so ranks beyond that
    bound are dropped while ranking; what is left is a handful of rows.
    """
    total = sum(quotas.get(lane, 0) for lane in lanes)
    bound = max([quotas.get(lane, 0) for lane in lanes] + [0]) + total
    lane_rank = F.lit(len(lanes))
    quota = F.lit(0)
    for i, lane in enumerate(lanes):
        lane_rank = F.when(F.col("lane") == lane, F.lit(i)).otherwise(lane_rank)
        quota = F.when(F.col("lane") == lane, F.lit(quotas.get(lane, 0))).otherwise(quota)
    ranked = lane_ranks(candidates.where(F.col("lane").isin(*lanes)), max(bound, 1)).select(
        "*", lane_rank.alias("lane_rank"), quota.alias("quota")
    )
    first = ranked.withColumn("passed", F.when(F.col("lane_pos") <= F.col("quota"), F.lit(0)).otherwise(F.lit(1)))
    order = Window.partitionBy("passed").orderBy("lane_rank", "lane_pos")
    placed = first.withColumn("n", F.row_number().over(order))
    filled = F.broadcast(placed.where("passed = 0").agg(F.count(F.lit(1)).alias("used")))
    chosen = placed.crossJoin(filled).where(
        (F.col("passed") == 0) | (F.col("n") <= F.lit(total) - F.col("used"))
    )
    final = Window.partitionBy(F.lit(0)).orderBy("passed", "n")
    return (
        chosen.withColumn("slot", F.row_number().over(final))
        .where(F.col("slot") <= cap)
        .withColumn("spilled", F.col("passed") == 1)
        .drop("passed", "n", "used", "lane_rank", "quota")
    )


def paid_targets(found: DataFrame, max_calls: int) -> DataFrame:
    """Targets worth a paid call: lane, then priority."""
    lane = rank_of(F.col("lane"), {"gap": 0, "research": 1, "news": 2}, 9)
    return found.orderBy(lane, rank_of(F.col("priority"), PRIORITY_RANK, 1), "target_id").limit(max_calls)


# ---- deterministic queries ----------------------------------------------------


def engine_queries(title: Column, missing: Column, evidence: Column, purpose: Column, fillable: Column) -> Column:
    """``map<engine, array<query>>`` built from a target's own words."""
    from marginalia.functions.tokens import query_terms, word_pairs

    text = F.concat_ws(" ", title, missing, evidence)

    def ranked(words: Column) -> Column:
        anchor = F.slice(query_terms(F.substring(purpose, 1, 200)), 1, 3)
        return F.array_distinct(F.concat(word_pairs(words), words, anchor))

    def of(top: Column) -> Column:
        single = F.filter(top, lambda t: ~F.contains(t, F.lit(" ")))
        pairs = F.filter(top, lambda t: F.contains(t, F.lit(" ")))
        base = F.coalesce(F.nullif(strip(title), F.lit("")), strip(F.substring(evidence, 1, 80)))
        support = F.array_join(F.slice(single, 1, 3), " ")
        arxiv = F.array_join(F.slice(F.concat(F.slice(pairs, 1, 2), single), 1, 4), " ")
        arxiv = F.coalesce(F.nullif(arxiv, F.lit("")), title)
        spoken = F.substring(F.when(support == "", base).otherwise(F.concat_ws(" ", base, support)), 1, 120)
        web = F.substring(
            F.when(F.startswith(F.lower(base), F.lit("what")), base).otherwise(F.concat(F.lit("what is "), F.lower(base))), 1, 120
        )
        words4 = F.array_join(F.slice(single, 1, 4), " ")
        forum = F.coalesce(F.nullif(words4, F.lit("")), F.substring(title, 1, 80))
        made = F.map_from_arrays(
            F.array(F.lit("arxiv"), F.lit("semantic_scholar"), F.lit("web"), F.lit("forum")),
            F.array(
                F.array(arxiv),
                F.array(F.when(base == "", words4).otherwise(spoken)),
                F.array(F.when(base == "", words4).otherwise(web)),
                F.array(forum),
            ),
        )
        wanted = F.map_filter(
            made,
            lambda k, v: (F.get(v, F.lit(0)) != "") & ((F.size(fillable) == 0) | F.array_contains(fillable, k)),
        )
        fallback = F.create_map(F.lit("web"), F.array(F.substring(title, 1, 120)))
        return F.when((F.size(wanted) == 0) & (title != ""), fallback).otherwise(wanted)

    return bind(F.slice(bind(query_terms(text), ranked), 1, 8), of)


def capped_queries(by_engine: Column, per_engine: int) -> Column:
    return F.map_filter(F.transform_values(by_engine, lambda _, v: F.slice(v, 1, per_engine)), lambda _, v: F.size(v) > 0)


def all_queries(by_engine: Column) -> Column:
    return F.array_distinct(F.flatten(F.map_values(by_engine)))


