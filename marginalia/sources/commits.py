"""Numbered commits of tables that belong together, on any file system Spark can write.

A commit's tables are written below a folder of their own; then one small file named by the commit's number, created only if it
is not there, publishes them together. Until then nobody reads them, so a writer that dies between two tables leaves
nothing half done, and of two writers of one number exactly one succeeds.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(RuntimeError):
    """Another writer published the same number."""


@dataclass(frozen=True)
class Commits:
    """Commits below ``root``; the driver holds their numbers only."""

    spark: SparkSession
    root: str

    def _file(self, *names: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *names]))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def numbers(self) -> list[int]:
        """Published numbers in ascending order."""
        fs, path = self._file("commits")
        if not fs.exists(path):
            return []
        names = (status.getPath().getName() for status in fs.listStatus(path))
        return sorted(int(name) for name in names if name.isdigit())

    def latest(self) -> int | None:
        return max(self.numbers(), default=None)

    def folder(self, number: int) -> str:
        fs, path = self._file("commits", str(number))
        stream = fs.open(path)
        try:
            return f"{self.root}/data/{bytes(stream.readAllBytes()).decode()}"
        finally:
            stream.close()

    def write(self, number: int, tables: dict[str, DataFrame]) -> str:
        """The tables as files that nobody reads yet; returns what ``publish`` takes."""
        name = f"{number}-{uuid.uuid4().hex}"
        for table, df in tables.items():
            df.write.parquet(f"{self.root}/data/{name}/{table}")
        return name

    def publish(self, number: int, name: str) -> None:
        fs, path = self._file("commits", str(number))
        if fs.exists(path):
            raise Conflict(f"{number} is published")
        # the file appears whole or not at all: it is filled under another name
        _, filling = self._file("filling", name)
        stream = fs.create(filling, True)
        stream.write(bytearray(name.encode()))
        stream.close()
        fs.mkdirs(path.getParent())
        if not fs.rename(filling, path):
            raise Conflict(f"{number} is published")

    def commit(self, number: int, tables: dict[str, DataFrame]) -> bool:
        """Write and publish; False, and nothing written, if the number was published before (a replay)."""
        fs, path = self._file("commits", str(number))
        if fs.exists(path):
            return False
        self.publish(number, self.write(number, tables))
        return True

    def read(self, table: str, schema: str, numbers: list[int] | None = None) -> DataFrame:
        """Rows of a table in the published commits (or in some), with their ``commit``; no rows before the first."""
        parts = [
            self.spark.read.schema(schema).parquet(f"{self.folder(n)}/{table}").withColumn("commit", F.lit(n).cast("long"))
            for n in (self.numbers() if numbers is None else numbers)
        ]
        return reduce(DataFrame.unionByName, parts, self.spark.createDataFrame([], f"{schema}, commit long"))
