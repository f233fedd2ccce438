"""Row numbers and running sums over very large or very skewed groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marginalia.session import cut_lineage


def sliced(df: DataFrame, group: str, order: str) -> DataFrame:
    """``df`` range-partitioned by group and order, with the slice it fell in.

    The checkpoint pins the slices: range bounds come from a sample and may
    differ if a lost task were to plan them anew.
    """
    ranged = df.repartitionByRange(F.col(group), F.col(order)).withColumn("slice", F.spark_partition_id())
    return cut_lineage(ranged)


def slice_offsets(rows: DataFrame, group: str, value: Column) -> DataFrame:
    """Total of ``value`` in the earlier slices of a group; one row per slice."""
    sums = rows.groupBy(group, "slice").agg(F.sum(value).alias("slice_sum"))
    before = Window.partitionBy(group).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(group, "slice", F.coalesce(F.sum("slice_sum").over(before), F.lit(0)).alias("before"))


def numbered(df: DataFrame, group: str, order: str, name: str = "n") -> DataFrame:
    """Position of every row in its group by ``order``, from 1.

    A group is spread over range slices; only the slice totals meet in a window,
    so one group may hold most of the rows.
    """
    rows = sliced(df, group, order)
    offsets = slice_offsets(rows, group, F.lit(1))
    inside = Window.partitionBy(group, "slice").orderBy(order)
    return (
        rows.join(offsets, [group, "slice"])
        .withColumn(name, F.row_number().over(inside) + F.col("before"))
        .drop("slice", "before")
    )
