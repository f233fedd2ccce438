"""Centroid clustering by Lloyd's rounds over shards of dimensions, in whole numbers.

Vectors are cut into chunks of about ``CHUNK`` rows and shards of ``SHARD_COLUMNS`` columns. A block is one shard of one
chunk; blocks lie partitioned by (shard, group of chunks), and no block moves in a round:

1. a column-block task computes the exact partial squared distances of its blocks to its slice of the centroids,
2. ``reduceByKey`` adds the partial distances of a chunk over the shards; argmin labels its rows (ties: smaller number),
3. the labels, a byte or two a row, go back to the shards, each of which sums its own columns by label and updates its own
   slice of the centroids; what the driver sees is centroids x dimensions, whatever the number of rows.

A round moves centroids / ``SHARD_COLUMNS`` numbers for each number of the table, in the narrowest type that holds them.
Components are ``floor(SCALE * x)``, so all sums are exact and no result depends on the order of rows, tasks or shards.
The blocks are read from a written table: a lost executor's blocks and labels are computed again, with the same chunks.

Cases: vectors that are null, not of the given width, or hold a null or non-finite component are left out; null and
repeated ids and equal vectors are rows like others (start: smallest hash of the id, then smallest vector; null ids
last); fewer vectors than centroids give as many centroids as vectors; a centroid without vectors stays where it is;
components beyond +-``LIMIT`` after scaling count as that, as larger distances fit no long, and an inertia that fits
none is null; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.session import written

SCALE = 64
LIMIT = 1 << 27
CHUNK = 1024
SHARD_COLUMNS = 32
#: products of numbers up to this are exact in doubles, summed over a shard
DOUBLE_LIMIT = 1 << 22


def narrow(values: np.ndarray) -> np.ndarray:
    """The same whole numbers in the narrowest type that holds them."""
    least, most = (int(values.min()), int(values.max())) if values.size else (0, 0)
    for kind in (np.int16, np.int32):
        if np.iinfo(kind).min <= least and most <= np.iinfo(kind).max:
            return values.astype(kind)
    return values.astype(np.int64)


def usable(vectors: DataFrame, key: str, vector: str, width: int) -> DataFrame:
    """``vec_id, x``: whole-number vectors of the rows that count."""
    given = F.col(vector).cast("array<double>")
    whole = F.transform(given, lambda c: F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), F.floor(c * SCALE))).cast("int"))
    fine = F.forall(given, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vectors.where(F.col(vector).isNotNull() & (F.size(vector) == width) & fine).select(F.col(key).cast("long").alias("vec_id"), whole.alias("x"))


def _blocks(width: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of the task's rows; ids go with the first shard."""
    from pyspark import TaskContext

    chunk = TaskContext.get().partitionId() << 33
    for rows in batches:
        values = rows.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
        for at in range(0, len(values), CHUNK):
            part = values[at : at + CHUNK]
            shards = range(0, width, SHARD_COLUMNS)
            slices = [narrow(part[:, s : s + SHARD_COLUMNS]) for s in shards]
            ids = rows.column(0).slice(at, len(part)).to_pylist()
            yield pa.RecordBatch.from_pydict({
                "chunk": pa.array([chunk] * len(slices), pa.int64()), "shard": pa.array(range(len(slices)), pa.int32()), "rows": pa.array([len(part)] * len(slices), pa.int32()),
                "bytes": pa.array([x.dtype.itemsize for x in slices], pa.int32()), "data": [x.tobytes() for x in slices], "ids": pa.array([ids] + [None] * (len(slices) - 1), pa.list_(pa.int64())),
            })
            chunk += 1


BLOCKS = "chunk long, shard int, rows int, bytes int, data binary, ids array<long>"


class Block(NamedTuple):
    values: np.ndarray
    ids: list[int | None] | None


def _block(row) -> tuple[tuple[int, int], Block]:
    return (row["shard"], row["chunk"]), Block(np.frombuffer(row["data"], dtype=f"i{row['bytes']}").reshape(row["rows"], -1), row["ids"])


def squared(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to centres, over the columns given."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(centres).max(initial=0)))
    if most <= DOUBLE_LIMIT:
        a, b = x.astype(np.float64), centres.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)).astype(np.int64)
    a, b = x.astype(np.int64), centres.astype(np.int64)
    return np.stack([((a - c) ** 2).sum(axis=1) for c in b], axis=1)


def _partial(centres: np.ndarray, with_ids: bool, item: tuple[tuple[int, int], Block]) -> tuple[int, tuple]:
    (shard, chunk), block = item
    at = shard * SHARD_COLUMNS
    found = narrow(squared(block.values, centres[:, at : at + block.values.shape[1]]))
    return chunk, (found, block.ids if with_ids else None)


def _added(a: tuple, b: tuple) -> tuple:
    return narrow(a[0].astype(np.int64) + b[0]), a[1] if a[1] is not None else b[1]


def _labels(summed: tuple) -> np.ndarray:
    nearest = summed[0].argmin(axis=1)
    return nearest.astype(np.uint8 if summed[0].shape[1] <= 256 else np.uint32)


def _slice_sums(centres: int, both: Iterator) -> Iterator[tuple[int, tuple[np.ndarray, np.ndarray]]]:
    """Sums and counts by label of the task's shards; the labels of its chunks come before their blocks."""
    labels: dict[tuple[int, int], np.ndarray] = {}
    sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for (shard, chunk), value in both:
        if not isinstance(value, Block):
            labels[shard, chunk] = value
            continue
        own = labels.pop((shard, chunk))
        total, count = sums.setdefault(shard, (np.zeros((centres, value.values.shape[1]), dtype=object), np.zeros(centres, dtype=np.int64)))
        inside = np.zeros((centres, value.values.shape[1]), dtype=np.int64)
        order = np.argsort(own, kind="stable")
        present, first = np.unique(own[order], return_index=True)
        inside[present] = np.add.reduceat(value.values[order].astype(np.int64), first, axis=0)
        total += inside
        count += np.bincount(own, minlength=centres)
    yield from sums.items()


def start_vectors(kept: DataFrame, centroids: int, label: str) -> list[list[int]]:
    """Vectors of the rows with the smallest hash of ``label`` and id."""
    hashed = F.sha2(F.concat(F.lit(label), F.col("vec_id").cast("string")), 256)
    return [r["x"] for r in kept.orderBy(hashed.asc_nulls_last(), "x").limit(centroids).collect()]


def _expanded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        for i in range(rows.num_rows):
            yield pa.RecordBatch.from_arrays(
                [rows.column(0).slice(i, 1).flatten(), *[pa.array(np.frombuffer(rows.column(c)[i].as_py(), dtype=t)) for c, t in ((1, np.int32), (2, np.int64))]], names=["vec_id", "cluster", "distance"]
            )


def _chosen(item: tuple[int, tuple]) -> tuple[list[int | None], bytearray, bytearray]:
    found, ids = item[1]
    nearest = found.argmin(axis=1)
    return ids, bytearray(nearest.astype(np.int32).tobytes()), bytearray(found[np.arange(len(found)), nearest].astype(np.int64).tobytes())


def lloyd(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", width: int = 64, centroids: int = 16, rounds: int = 3, label: str = "1:") -> tuple[DataFrame, np.ndarray]:
    """``vec_id, cluster, distance`` of every usable vector, and the final centroids (as many as there are, x ``width``)."""
    spark = vectors.sparkSession
    kept = usable(vectors, key, vector, width)
    start = start_vectors(kept, centroids, label)
    if not start:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long"), np.zeros((0, width), np.int64)
    centres = np.array(start, dtype=np.int64)
    table = written(kept.mapInArrow(partial(_blocks, width), BLOCKS))
    shards = -(-width // SHARD_COLUMNS)
    groups = max(1, -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // shards))
    # one layout for blocks and labels: a shard's task finds the labels of its chunks beside them
    place = lambda k: k[0] * groups + (k[1] ^ k[1] >> 33) % groups
    by_chunk = lambda k: (k ^ k >> 33) % groups
    blocks = table.rdd.map(_block).partitionBy(shards * groups, place)

    def distances(with_ids: bool) -> RDD:
        return blocks.map(partial(_partial, centres, with_ids)).reduceByKey(_added, groups, by_chunk)

    for _ in range(rounds):
        labels = distances(False).mapValues(_labels).flatMap(lambda x: [((s, x[0]), x[1]) for s in range(shards)]).partitionBy(shards * groups, place)
        sums = labels.union(blocks).mapPartitions(partial(_slice_sums, len(centres)))
        new = centres.copy()
        for shard, (total, count) in sums.reduceByKey(lambda a, b: (a[0] + b[0], a[1] + b[1]), shards).collect():
            filled = np.flatnonzero(count)
            at = shard * SHARD_COLUMNS
            new[filled, at : at + total.shape[1]] = np.array([[int(v) // int(count[c]) for v in total[c]] for c in filled], dtype=np.int64)
        centres = new
    chosen = spark.createDataFrame(distances(True).map(_chosen), "ids array<long>, clusters binary, distances binary")
    return chosen.mapInArrow(_expanded, "vec_id long, cluster int, distance long"), centres


def clusters(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", width: int = 64, centroids: int = 16, rounds: int = 3, label: str = "1:") -> DataFrame:
    """``lloyd`` with the distances summed over each cluster and over all, and the hash of each row's centroid."""
    found, centres = lloyd(vectors, key, vector, width, centroids, rounds, label)
    if not len(centres):
        return found.select("*", F.lit(0).cast("long").alias("cluster_inertia"), F.lit(0).cast("long").alias("inertia"), F.lit("").alias("centroid_sha256"))
    rows = written(found)
    sums = {r["cluster"]: int(r["s"]) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    fits = lambda n: n if n < 1 << 63 else None
    # a row for each centroid
    told = rows.sparkSession.createDataFrame(
        [(c, fits(s), fits(sum(sums.values())), ",".join(map(str, centres[c].tolist()))) for c, s in sums.items()], "cluster int, cluster_inertia long, inertia long, text string"
    )
    return rows.join(F.broadcast(told.withColumn("centroid_sha256", F.sha2(F.col("text").cast("binary"), 256)).drop("text")), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
