"""Embedding whitening by distributed block matrices.

1. Usable vectors become whole numbers ``x = floor(SCALE * c) + OFFSET``. The fit list holds each distinct ``x`` once: equal
   vectors meet in a map-side combined grouping, so a vector that holds a third of all rows is one row for each task.
2. Its rows, counted and summed exactly, are centred as ``(n * x - S) / n`` before anything is multiplied, numbered, and cut into
   blocks of ``BLOCK`` rows: a ``BlockMatrix``.
3. Its transpose times itself is the scatter. The middle dimension is split over the tasks, which add their own blocks'
   products first, so that one matrix of dimensions x dimensions a task goes on.
4. ``eigh`` of the scatter over n on the driver (dimensions x dimensions) gives the whitening matrix: the leading unit
   eigenvectors over the root of their eigenvalues, signs set so that the largest entry is positive.
5. The block matrices of the fit list and of all rows, multiplied with the whitening matrix, are the projected rows. The projected fit list's
   own covariance is multiplied out in the same way and gives ``identity_error`` as measured, not as planned.

The numbered rows are written tables: numbers, blocks and projected rows come out the same when a lost executor's are computed again.

Cases: rows whose vector is null or holds a null or non-finite entry are dropped; of other rows those of the most common
width count (ties: the largest), as one matrix has one width; null and repeated ids are rows like others; components
whose variance is not above ``LEAST_VARIANCE`` times the largest have no direction and are left out, so a table with
a single distinct vector, no usable row, or empty vectors gives no rows; entries beyond +-``LIMIT`` after scaling count as that; a
deviation that fits no long is null; other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.session import written

SCALE, OFFSET = 64, 1_000_000
LIMIT = 1 << 40
COMPONENTS = 16
LEAST_VARIANCE = 1e-12
#: rows of a block, and blocks whose products a task adds
BLOCK, TASK_BLOCKS = 1024, 16
#: sums taken by one aggregation
WIDE = 128


def whole(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """``vec_id, x`` of the rows that count."""
    given = F.col(vector).cast("array<double>")
    fine = F.forall(given, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.where(F.col(vector).isNotNull() & fine)
    # one row for each width
    widths = rows.groupBy(F.size(vector).alias("width")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("width")).first()
    scaled = F.transform(given, lambda c: F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), F.floor(c * SCALE))) + F.lit(OFFSET).cast("long"))
    return rows.where(F.size(vector) == (widths["width"] if widths else -1)).select(F.col(key).cast("long").alias("vec_id"), scaled.alias("x"))


def numbered(df: DataFrame) -> DataFrame:
    """``df`` written, with row numbers 0, 1, ... in ``index``; a number for each task comes to the driver."""
    table = written(df)
    placed = table.withColumn("task", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33))
    counts = sorted((r["task"], r["count"]) for r in placed.groupBy("task").count().collect())
    before = np.concatenate([[0], np.cumsum([n for _, n in counts])])
    starts = df.sparkSession.createDataFrame([(task, int(b)) for (task, _), b in zip(counts, before)], "task int, start long")
    return placed.join(F.broadcast(starts), "task").withColumn("index", F.col("start") + F.col("at")).drop("task", "start", "at")


def blocks(rows: DataFrame, width: int) -> BlockMatrix:
    """Block matrix of ``index, row`` (an array of doubles)."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select("index", array_to_vector("row").alias("vector")), "vector")
    # every product walks the blocks more than once; blocks lost with their executor are cut again
    return IndexedRowMatrix(vectors, 0, width).toBlockMatrix(BLOCK, width).persist(StorageLevel.MEMORY_AND_DISK)


def gram(matrix: BlockMatrix, n: int, tasks: int) -> np.ndarray:
    """Transposed matrix times matrix, with the middle dimension split over tasks."""
    width = matrix.colsPerBlock
    splits = max(min(tasks, -(-n // BLOCK)), -(-n // (BLOCK * TASK_BLOCKS)))
    left = matrix.transpose()
    product = left._java_matrix_wrapper.call("multiply", matrix._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(product, width, width).toLocalMatrix().toArray()


def projected(matrix: BlockMatrix, by: np.ndarray) -> DataFrame:
    """``index, z``: rows of the block matrix times a local matrix."""
    sc = matrix.blocks.context
    local = BlockMatrix(sc.parallelize([((0, 0), DenseMatrix(*by.shape, by.ravel(order="F")))], 1), by.shape[0], by.shape[1])
    rows = matrix.multiply(local).toIndexedRowMatrix()
    return callMLlibFunc("getIndexedRows", rows._java_matrix_wrapper._java_model).select("index", vector_to_array("vector").alias("z"))


def moments(fit: DataFrame, width: int) -> tuple[int, list[int], int, int]:
    """Rows, exact sums of every dimension, least and largest entry."""
    n, sums, least, most = 0, [], 0, 0
    for lo in range(0, width, WIDE):
        own = range(lo, min(width, lo + WIDE))
        r = fit.agg(F.count(F.lit(1)).alias("n"), F.min(F.array_min("x")).alias("least"), F.max(F.array_max("x")).alias("most"), *[F.sum(F.col("x")[i].cast("decimal(20,0)")).alias(f"s{i}") for i in own]).first()
        n, least, most = r["n"], r["least"], r["most"]
        sums += [int(r[f"s{i}"] or 0) for i in own]
    return n, sums, least, most


def deviation(n: int, sums: list[int], least: int, most: int) -> Column:
    """Sum over dimensions of (n * x - S)^2, in longs where all of them fit, else in decimals."""
    # an entry is apart from its mean by the entries' range at most
    size = n * (most - least)
    pairs = F.zip_with("x", F.array(*map(F.lit, sums)), lambda x, s: F.struct(x.alias("x"), s.alias("s")))
    if size * size * len(sums) < 1 << 63 and n * max(abs(least), abs(most)) < 1 << 63:
        return F.aggregate(pairs, F.lit(0).cast("long"), lambda a, p: a + (F.lit(n).cast("long") * p["x"] - p["s"]) * (F.lit(n).cast("long") * p["x"] - p["s"]))
    # |n * x - S| takes at most 19 digits while n * x fits a long; a product beyond 38 digits is null
    apart = lambda p: (F.lit(n).cast("decimal(19,0)") * p["x"].cast("decimal(19,0)") - p["s"]).try_cast("decimal(19,0)")
    total = F.aggregate(pairs, F.lit(0).cast("decimal(38,0)"), lambda a, p: (a + apart(p) * apart(p)).try_cast("decimal(38,0)"))
    return total.try_cast("long")


def whitened(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """A row for each usable row and component: ``vec_id, component, n, deviation, whitened, explained, identity_error``."""
    spark = vectors.sparkSession
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = numbered(whole(vectors, key, vector))
    fit = numbered(rows.groupBy("x").agg(F.lit(1).alias("one")).select("x"))
    first = fit.select(F.size("x").alias("width")).first()
    if first is None or not first["width"]:
        return spark.createDataFrame([], schema)
    width = first["width"]
    n, sums, least, most = moments(fit, width)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # whole numbers as long as they fit, so that centring loses nothing
    if n * max(abs(least), abs(most)) < 1 << 62:
        centred = F.zip_with("x", F.array(*[F.lit(s).cast("long") for s in sums]), lambda x, s: (x * F.lit(n).cast("long") - s) / F.lit(float(n)))
    else:
        mean = [(s // n, (s % n) / n) for s in sums]
        centred = F.zip_with("x", F.array(*[F.struct(F.lit(a).cast("long").alias("a"), F.lit(b).alias("b")) for a, b in mean]), lambda x, m: (x - m["a"]).cast("double") - m["b"])
    fitted = blocks(fit.select("index", centred.alias("row")), width)
    covariance = gram(fitted, n, tasks) / n
    values, vectors_ = np.linalg.eigh((covariance + covariance.T) / 2)
    order = np.argsort(values)[::-1]
    order = [i for i in order[:components] if values[i] > LEAST_VARIANCE * max(values.max(), 0)]
    if not order:
        return spark.createDataFrame([], schema)
    units = vectors_[:, order]
    units = units * np.sign(units[np.abs(units).argmax(axis=0), range(len(order))])
    matrix = units / np.sqrt(values[order])
    # the projected fit list's covariance, multiplied out as the scatter was
    fit_rows = projected(fitted, matrix).withColumnRenamed("z", "row")
    error = float(np.abs(gram(blocks(fit_rows, len(order)), n, tasks) / n - np.eye(len(order))).max())
    every = projected(blocks(rows.select("index", centred.alias("row")), width), matrix)
    explained = F.array(*[F.lit(float(values[i] / np.trace(covariance))) for i in order])
    told = rows.select("index", "vec_id", deviation(n, sums, least, most).alias("deviation")).join(every, "index")
    return told.select("vec_id", "deviation", F.posexplode("z").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", explained[F.col("at")].alias("explained"), F.lit(error).alias("identity_error")
    )
