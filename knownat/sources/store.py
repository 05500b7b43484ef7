"""Stored tables as numbered folders: written first, published by a marker, never changed afterwards.

A folder counts once Spark's committer has put ``_SUCCESS`` into it, so what a lost driver left half-written is never read, and the next writer
of that number replaces it.  Folders are listed by Hadoop's file system, wherever the path lies.  There is one writer at a time.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

_DIGITS = 12


class Folders:
    """The numbered folders of a path, by kind: ``<kind>=000000000007``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        context = spark.sparkContext
        self._at = context._jvm.org.apache.hadoop.fs.Path
        self._fs = self._at(self.path).getFileSystem(context._jsc.hadoopConfiguration())

    def name(self, kind: str, number: int) -> str:
        return f"{self.path}/{kind}={number:0{_DIGITS}d}"

    def complete(self, kind: str) -> list[int]:
        """Numbers of the published folders of a kind, in order."""
        top = self._at(self.path)
        names = [f.getPath().getName() for f in self._fs.listStatus(top)] if self._fs.exists(top) else []
        found = [n for n in names if n.startswith(f"{kind}=")]
        return sorted(int(n.split("=")[1]) for n in found if self._fs.exists(self._at(f"{self.path}/{n}/_SUCCESS")))

    def write(self, rows: DataFrame, kind: str, number: int) -> None:
        rows.write.mode("overwrite").parquet(self.name(kind, number))

    def read(self, kind: str, numbers: Sequence[int]) -> DataFrame:
        return self.spark.read.parquet(*[self.name(kind, n) for n in numbers])

    def remove(self, kind: str, number: int) -> None:
        self._fs.delete(self._at(self.name(kind, number)), True)


class StoredTable:
    """A table that only grows, with a key: rows of a known key are ignored, whoever sends them again."""

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str]):
        self.folders, self.keys = Folders(spark, path), list(keys)

    def versions(self) -> list[int]:
        return self.folders.complete("version")

    def read(self, upto: int | None = None) -> DataFrame | None:
        """Everything stored, or what was stored when version ``upto`` was the newest; None before the first."""
        numbers = [n for n in self.versions() if upto is None or n <= upto]
        return self.folders.read("version", numbers) if numbers else None

    def insert_new(self, rows: DataFrame) -> int | None:
        """Publishes the rows whose key is not stored yet as the next version; its number, or None when there were none.

        Of several rows of one key the least one counts.  Null keys equal each other.  The anti-join reads only the key columns of what is
        stored; a rerun after a failure writes the same number again.
        """
        rest = [c for c in rows.columns if c not in self.keys]
        one = rows.groupBy(*self.keys).agg(F.min(F.struct(*rest)).alias("_r")).select(*self.keys, "_r.*") if rest else rows.distinct()
        held = self.read()
        if held is not None:
            known = held.select(*[F.col(k).alias(f"_{k}") for k in self.keys])
            same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in self.keys])
            one = one.join(known, same, "left_anti")
        number = max(self.versions(), default=0) + 1
        self.folders.write(one, "version", number)
        if self.folders.read("version", [number]).isEmpty():
            self.folders.remove("version", number)
            return None
        return number


class BuiltTable:
    """A table that is built whole, under a number that names what it was built from; building the same again does nothing."""

    def __init__(self, spark: SparkSession, path: str):
        self.folders = Folders(spark, path)

    def build(self, number: int, rows) -> bool:
        """Publishes what ``rows()`` returns as build ``number``, unless that is there; whether it was written."""
        if number in self.folders.complete("build"):
            return False
        self.folders.write(rows(), "build", number)
        return True

    def newest(self) -> DataFrame | None:
        numbers = self.folders.complete("build")
        return self.folders.read("build", numbers[-1:]) if numbers else None
