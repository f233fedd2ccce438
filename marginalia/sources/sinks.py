"""Writers. Each one replaces or appends a whole table or folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.operators import retrieval


def append_cost_rows(rows: DataFrame, path: str) -> None:
    rows.withColumn("date", F.date_format("date", "yyyy-MM-dd")).write.mode("append").json(path)


def write_ledger(rows: DataFrame, path: str) -> None:
    """Ledger table; read and write folders must differ, as Spark reads lazily."""
    rows.write.mode("overwrite").parquet(path)


def append_changed_chunks(chunks: DataFrame, path: str, spark: SparkSession) -> int:
    """Append the chunks whose hashes are not stored yet; returns how many."""
    try:
        existing = spark.read.parquet(path)
    except Exception as exc:
        if "PATH_NOT_FOUND" not in str(exc):
            raise
        existing = chunks.limit(0)
    fresh = retrieval.changed_chunks(chunks, existing).withColumn("created_at", F.current_timestamp())
    before = existing.count()
    fresh.write.mode("append").parquet(path)
    return spark.read.parquet(path).count() - before


def latest_chunks(stored: DataFrame) -> DataFrame:
    """Newest record of every chunk place."""
    best = stored.groupBy("page_address", "chunk_index").agg(
        F.max_by(F.struct(*stored.columns), F.struct("created_at", "body_hash")).alias("r")
    )
    return best.select("r.*")


def write_text_lines(lines: DataFrame, path: str, column: str = "line") -> None:
    """Rendered report lines as text files in row order."""
    lines.select(column).write.mode("overwrite").text(path)


def write_pages(pages: DataFrame, path: str) -> None:
    """Rendered pages as a table keyed by path, spread by path hash."""
    pages.write.mode("overwrite").parquet(path)


def write_learned(parts: dict[str, DataFrame], path: str) -> None:
    """Learned state: one small table per part."""
    for name, df in parts.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
