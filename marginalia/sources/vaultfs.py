"""Page scan as a Spark data source.

Spark's file sources skip names that start with ``_`` or ``.``; templates and
structural pages have such names and still count in link checks. This source
lists a vault folder and reads its pages in tasks, hidden names included.

    spark.read.format("vaultfs").option("path", vault).option("areas", "wiki,objective").load()
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, text string, mtime timestamp"


class FileSlice(InputPartition):
    def __init__(self, files: list[str]):
        self.files = files


class VaultReader(DataSourceReader):
    def __init__(self, root: str, areas: list[str], suffix: str, slice_bytes: int):
        self.root, self.areas, self.suffix, self.slice_bytes = root, areas, suffix, slice_bytes

    def partitions(self) -> list[FileSlice]:
        """Slices of about ``slice_bytes``; only names and sizes are listed here."""
        slices: list[FileSlice] = []
        held, size = [], 0
        for area in self.areas or [""]:
            for folder, _, names in os.walk(os.path.join(self.root, area)):
                for name in names:
                    if not name.endswith(self.suffix):
                        continue
                    full = os.path.join(folder, name)
                    held.append(os.path.relpath(full, self.root))
                    size += os.path.getsize(full)
                    if size >= self.slice_bytes:
                        slices.append(FileSlice(held))
                        held, size = [], 0
        if held or not slices:
            slices.append(FileSlice(held))
        return slices

    def read(self, partition: FileSlice) -> Iterator[tuple]:
        for rel in partition.files:
            full = os.path.join(self.root, rel)
            with open(full, encoding="utf-8", errors="replace", newline="") as fh:
                text = fh.read()
            mtime = datetime.fromtimestamp(os.path.getmtime(full), tz=timezone.utc)
            yield rel.replace(os.sep, "/"), text, mtime


class VaultSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "vaultfs"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> VaultReader:
        areas = [a.strip() for a in self.options.get("areas", "").split(",") if a.strip()]
        return VaultReader(
            self.options["path"], areas, self.options.get("suffix", ".md"), int(self.options.get("sliceBytes", str(8 << 20)))
        )


def register(spark: SparkSession) -> None:
    spark.dataSource.register(VaultSource)
