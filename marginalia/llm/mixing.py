"""Mixing sources by temperature, in DataFrame functions only.

1. ``shares``: a source's share of all tokens (words), counted over all documents.
2. ``exponent``: shares are raised to an exponent in [0, 1] and normalised. It is the largest at which the
   weights' entropy reaches ``entropy`` (a part of the largest possible, ln of the number of sources), but none at
   which some source is used more than ``repeats`` times as often as another. Entropy and repetition fall as the
   exponent grows, so it is bisected: a pass tries the inner points of ``2 ** LEVELS`` equal parts, ``LEVELS``
   bisections at once, and gives back one number. The sources stay a table.
3. ``mix``: the budget is split by weight. A source's budget is met by whole permutations of its documents, each by
   another hash order, and the first documents of one more. By default the budget is the smallest that uses
   every document at least once, so nothing is lost.
   A place in a source's run of tokens, divided by the source's budget, gives the block: blocks of about
   ``block_tokens`` tokens hold every source by its weight. In a block, documents stand in hash order.

A source may hold any part of the rows. Running sums are made in two steps, over ``SLICE_ROWS`` rows (about) of one
permutation and over the slices' sums, so that no source is one task.

Cases: a null source is a source of its own; null and empty texts have no tokens and are placed with none; repeated rows
are each placed; an empty table gives no rows; equal hashes are ordered by id.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginalia.session import cut_lineage

#: part of the largest entropy to reach, and how often a source may be used for one use of another
ENTROPY, REPEATS = 0.98, 2.0
BLOCK_TOKENS = 100_000
#: bisections in one pass, and passes
LEVELS, PASSES = 5, 5
SLICE_ROWS = 2_000
#: sources up to which their table is broadcast, after it was counted
BROADCAST_SOURCES = 100_000
WORD = r"[^\x20\x09-\x0D]+"


def counted(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``doc_id, source, n_tokens`` of every row."""
    tokens = F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD)), F.lit(0))
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), tokens.cast("long").alias("n_tokens"))


def shares(rows: DataFrame) -> DataFrame:
    """``source, tokens, share``; sources without tokens have the share 0."""
    by_source = rows.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs"))
    total = by_source.agg(F.sum("tokens").alias("all_tokens"))
    # one row on the right
    return by_source.join(F.broadcast(total)).select("source", "tokens", "docs", (F.col("tokens") / F.greatest("all_tokens", F.lit(1))).alias("share"))


def _power(exponent: Column) -> Column:
    return F.when(F.col("share") > 0, F.pow("share", exponent)).otherwise(0.0)


def exponent(table: DataFrame, entropy: float = ENTROPY, repeats: float = REPEATS) -> float:
    """The exponent for ``table(source, share)``, to six decimals."""
    lo, hi = 0.0, 1.0
    for _ in range(PASSES):
        width = (hi - lo) / 2**LEVELS
        points = [lo + width * i for i in range(1, 2**LEVELS)]
        tried = table.where("share > 0").select("share", F.explode(F.array(*map(F.lit, points))).alias("a")).withColumn("p", F.pow("share", "a"))
        told = tried.groupBy("a").agg(
            F.sum("p").alias("z"), F.sum(F.col("p") * F.log("p")).alias("plogp"), F.count(F.lit(1)).alias("n"),
            (F.max(F.col("p") / F.col("share")) / F.min(F.col("p") / F.col("share"))).alias("repeats"),
        )
        flat = F.log("z") - F.col("plogp") / F.col("z") >= F.lit(entropy) * F.log("n") - 1e-12
        # true for all exponents below the wanted one
        below = told.where(flat | (F.col("repeats") > repeats + 1e-12)).agg(F.max("a")).first()[0]
        lo = lo if below is None else below
        hi = lo + width
    return round(lo, 6)


def weights(table: DataFrame, entropy: float = ENTROPY, repeats: float = REPEATS, budget: int | None = None) -> DataFrame:
    """``source, tokens, docs, weight, quota, blocks``: weights add up to 1, quotas (tokens) to about the budget."""
    a = exponent(table, entropy, repeats)
    powered = table.withColumn("p", F.when(F.col("share") > 0, F.pow("share", F.lit(a))).otherwise(0.0))
    total = powered.agg(F.sum("p").alias("z"))
    weighted = powered.join(F.broadcast(total)).withColumn("weight", F.coalesce(F.col("p") / F.col("z"), F.lit(0.0)))
    # the least budget that uses every document once
    least = weighted.where("weight > 0").agg(F.coalesce(F.max(F.col("tokens") / F.col("weight")), F.lit(0.0)).alias("least"))
    of = F.lit(float(budget)) if budget is not None else F.col("least")
    quota = F.round(F.col("weight") * of).cast("long")
    blocks = F.greatest(F.lit(1), F.ceil(of / F.lit(BLOCK_TOKENS))).cast("long")
    return weighted.join(F.broadcast(least)).select("source", "tokens", "docs", "weight", (quota if budget is not None else F.greatest("tokens", quota)).alias("quota"), blocks.alias("blocks"))


def _order(*parts: Column | str) -> Column:
    """A number below 2^52 drawn from the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("long")


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", entropy: float = ENTROPY, repeats: float = REPEATS, budget: int | None = None) -> DataFrame:
    """``doc_id, source, n_tokens, copy, block, position``: a row for each use of a document; copy counts its uses from 0."""
    rows = counted(docs, key, text, source)
    table = cut_lineage(weights(cut_lineage(shares(rows)), entropy, repeats, budget))
    # a null source is joined as one
    table = table.withColumn("whole", F.when(F.col("tokens") > 0, F.floor(F.col("quota") / F.col("tokens"))).otherwise(1)).withColumn("rest", F.when(F.col("tokens") > 0, F.col("quota") - F.col("whole") * F.col("tokens")).otherwise(0))
    table = table.withColumn("slices", F.ceil(F.col("docs") / F.lit(SLICE_ROWS))).withColumnRenamed("source", "of")
    side = F.broadcast(table) if table.count() <= BROADCAST_SOURCES else table
    used = rows.join(side, rows["source"].eqNullSafe(side["of"])).drop("of")
    used = used.withColumn("copy", F.explode(F.sequence(F.lit(0), (F.col("whole") + F.when(F.col("rest") > 0, 1).otherwise(0) - 1).cast("int")))) if budget is None else used.withColumn(
        "copy", F.explode(F.when(F.col("whole") + F.col("rest") > 0, F.sequence(F.lit(0), (F.col("whole") + F.when(F.col("rest") > 0, 1).otherwise(0) - 1).cast("int"))).otherwise(F.array().cast("array<int>")))
    )
    drawn = used.withColumn("draw", _order(F.lit("permute"), F.col("copy"), F.col("doc_id"))).withColumn("slice", F.floor(F.col("draw") / F.lit(float(2**52)) * F.col("slices")).cast("long"))
    place = ["source", "copy", "slice"]
    sums = drawn.groupBy(*place).agg(F.sum("n_tokens").alias("held"))
    before = F.sum("held").over(W.partitionBy("source", "copy").orderBy("slice").rowsBetween(W.unboundedPreceding, 0)) - F.col("held")
    offsets = sums.select(*[F.col(c).alias("o_" + c) for c in place], before.alias("offset"))
    here = drawn.join(offsets, drawn["source"].eqNullSafe(F.col("o_source")) & (F.col("copy") == F.col("o_copy")) & (F.col("slice") == F.col("o_slice")))
    inside = F.sum("n_tokens").over(W.partitionBy(*place).orderBy("draw", "doc_id", "n_tokens").rowsBetween(W.unboundedPreceding, 0)) - F.col("n_tokens")
    started = here.withColumn("start", F.col("offset") + inside).where((F.col("copy") < F.col("whole")) | (F.col("start") < F.col("rest")))
    run = F.col("copy") * F.col("tokens") + F.col("start")
    block = F.when(F.col("quota") > 0, F.least(F.floor(run / F.col("quota") * F.col("blocks")), F.col("blocks") - 1)).otherwise(0).cast("long")
    blocked = started.select("doc_id", "source", "n_tokens", "copy", block.alias("block"))
    order = W.partitionBy("block").orderBy(_order(F.lit("block"), F.col("copy"), F.col("doc_id")), "doc_id", "copy", "source", "n_tokens")
    return blocked.withColumn("position", F.row_number().over(order).cast("long")).withColumn("copy", F.col("copy").cast("long"))
