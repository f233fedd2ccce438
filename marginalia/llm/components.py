"""Connected components of a table of links, by alternating stars.

A star step tells every neighbour of a node the smallest node it has seen; large and small
steps in turn leave each component as one star round its smallest node after few rounds,
whatever its size or shape. Only node numbers move; a node with very many links is a
skewed join key, which Spark splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.session import written


#: links that a task takes at least
TASK_LINKS = 500_000


def _large(edges: DataFrame, tasks: int) -> DataFrame:
    """Larger neighbours of each node are linked to the smallest node of its neighbourhood."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).coalesce(tasks)
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").coalesce(tasks).distinct()


def _small(edges: DataFrame, tasks: int) -> DataFrame:
    """Smaller neighbours of each node, and the node, are linked to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m")).coalesce(tasks)
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.coalesce(tasks).union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links(u, v)`` but the roots; root: smallest node of the component.

    Null ends and loops count as no link; a table without links gives no rows.
    """
    edges = written(links.where("u is not null and v is not null and u <> v").select("u", "v").distinct())
    # few links need few tasks, however many partitions a shuffle has
    tasks = 8 + edges.count() // TASK_LINKS
    edges, state = edges.coalesce(tasks), None
    while True:
        seen = edges.agg(F.count(F.lit(1)), F.sum(F.col("u").cast("decimal(38,0)")), F.sum(F.col("v").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("u", "v"))).first()
        if seen == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = seen
        edges = written(_small(_large(edges, tasks).coalesce(tasks), tasks).coalesce(tasks))
