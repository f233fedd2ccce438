"""Session settings, table reads and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: rows a counted side may hold to be broadcast; beyond that it is joined by shuffle
BROADCAST_ROWS = 200_000
#: Spark's setting that an execution's shuffle files go with its end
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(app: str = "marginalia", master: str | None = None, cores: int | None = None) -> SparkSession:
    """Session for local runs; a cluster supplies its own master and sizes."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    if cores:
        conf["spark.sql.shuffle.partitions"] = str(cores)
    if master and master.startswith("local"):
        conf[SPREAD] = "true"
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """Folder for lineage cuts.

    The cluster names a shared folder in ``spark.checkpoint.dir``. Only a local
    master without that setting falls back to a fresh temporary folder.
    """
    sc = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if shared:
        if current is None:
            sc.setCheckpointDir(shared)
        return shared
    if current is not None:
        return current
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    made = tempfile.mkdtemp(prefix="marginalia-checkpoint-")
    sc.setCheckpointDir(made)
    return made


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives executor loss and ends the lineage."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Lineage cut by a Parquet table in the checkpoint folder, for loops.

    A checkpoint keeps the size that its plan was estimated at, and joins multiply sizes: in a loop of
    joins the estimate gets more digits each round than a driver can hold. A table's size is that of its files.
    """
    path = f"{checkpoint_root(df.sparkSession)}/table-{uuid.uuid4()}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Delete a table that ``written`` made; nothing may read it any more."""
    spark = table.sparkSession
    for folder in {os.path.dirname(file) for file in table.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(folder))
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What is executed within leaves no shuffle files; else they stay until the driver's garbage is collected."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def spread_keys(spark: SparkSession, n: int) -> list[int]:
    """``n`` numbers that a shuffle deals out evenly: partitions get as many of them each, or one more, those with one more far apart."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    wanted = [i * parts // n for i in range(n)]
    of: dict[int, list[int]] = {part: [] for part in wanted}
    most = max(wanted.count(part) for part in of)
    lo, step = 0, 4 * parts * (most + 4)
    while min(len(keys) for keys in of.values()) < most:
        numbers = spark.range(lo, lo + step).select(F.col("id").cast("int").alias("key"))
        for key, part in numbers.select("key", F.pmod(F.hash("key"), F.lit(parts))).collect():
            if part in of:
                of[part].append(key)
        lo += step
    return [of[part].pop() for part in wanted]


#: set to true by ``build_session`` for local runs only: a text table that lies in one row group is dealt to the local cores
SPREAD = "spark.marginalia.spreadText"
#: tables whose rows are costly to process, with their unique keys
TEXT_KEYS = {"documents": ["doc_id"], "pages": ["page_id"], "conversations": ["conv_id", "turn"], "embeddings": ["vec_id"]}


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the given Parquet tables. Splits are the reader's; only a session that asks for it deals text rows out anew."""
    table = spark.read.parquet(os.path.join(folder, f"{name}.parquet"))
    if name in TEXT_KEYS and spark.conf.get(SPREAD, "false") == "true":
        return table.repartition(spark.sparkContext.defaultParallelism, *TEXT_KEYS[name])
    return table
