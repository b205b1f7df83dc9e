"""Tables in versions: readers see one version whole, whatever is written meanwhile.

A folder holds segments, which are written once and never changed, and versions, each a small
list of the segments that make up its tables. A version counts from the moment its list is complete,
so appending, replacing and compacting are each one step for readers; a writer that fails leaves
segments that no version names."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from textloom.session import delete

Segments = dict[str, list[str]]


class Versions:
    """Tables under `path`, by name."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def numbers(self) -> list[int]:
        """The complete versions, in order."""
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        done = hadoop.Path(f"{self.path}/versions/*/_SUCCESS")
        found = done.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(done)
        return sorted(int(x.getPath().getParent().getName()) for x in found or [])

    def segments(self, version: int | None = None) -> Segments:
        """Table to segments of a version, the latest one if none is named."""
        known = self.numbers()
        if version is None and not known:
            return {}
        rows = self.spark.read.schema("name string, segment string").json(f"{self.path}/versions/{version or known[-1]}").collect()  # one row for each segment
        out: Segments = {}
        for r in sorted(rows, key=lambda r: (r["name"], r["segment"])):
            out.setdefault(r["name"], []).append(r["segment"])
        return out

    def read(self, name: str, schema: StructType | str, version: int | None = None) -> DataFrame:
        """A table as it is now; what is committed later does not change it."""
        found = self.segments(version).get(name, [])
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{s}" for s in found)) if found else self.spark.createDataFrame([], schema)

    def write(self, name: str, df: DataFrame) -> str:
        """Writes a segment, which no version names yet."""
        segment = f"{name}/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{segment}")
        return segment

    def commit(self, tables: Segments) -> int:
        """Makes these segments the next version; fails if another writer made it first."""
        number = (self.numbers() or [0])[-1] + 1
        rows = [(name, s) for name, segments in tables.items() for s in segments]
        self.spark.createDataFrame(rows, "name string, segment string").coalesce(1).write.mode("error").json(f"{self.path}/versions/{number}")
        return number

    def append(self, name: str, df: DataFrame) -> int:
        new, now = self.write(name, df), self.segments()
        return self.commit(now | {name: [*now.get(name, []), new]})

    def replace(self, name: str, df: DataFrame) -> int:
        """df may read the table that it replaces."""
        new = self.write(name, df)
        return self.commit(self.segments() | {name: [new]})

    def compact(self, name: str, schema: StructType | str, by: str, parts: int = 1) -> int:
        """The same rows in one segment of `parts` files."""
        return self.replace(name, self.read(name, schema).repartition(parts, F.col(by)))

    def forget(self, keep: int = 1) -> None:
        """Deletes all versions but the last `keep`, and the segments that none of these names. Not while a writer is at work."""
        known = self.numbers()
        gone, kept = known[:-keep], known[-keep:]
        needed = {s for n in kept for segments in self.segments(n).values() for s in segments}
        old = {s for n in gone for segments in self.segments(n).values() for s in segments} - needed
        for path in (*(f"versions/{n}" for n in gone), *old):
            delete(self.spark, f"{self.path}/{path}")
