"""Shards by size-tiered compaction, with a versioned manifest.

``append`` writes an arrival as a folder of small immutable Parquet shards.  ``compact`` sorts the live
folders whose shards are below half the target size into tiers by shard size; a tier with at least FAN_IN
shards is a run of similar files, which is read and written again as files of about the target size.  The
merge only joins read partitions, so nothing is shuffled and no task holds more than a target file's rows
in its writer.

A version of the manifest lists the live folders with their files, rows and bytes: one row for each arrival
or merge, whatever the number of shards.  It is written aside and renamed to its number, which fails if that
number exists: a version appears whole or not at all, and one of two writers has to try again on the newer
version.  Readers take the newest version.

``vacuum`` deletes versions that were replaced more than ``grace`` seconds ago and the folders that only they list, so readers
of an older version have that long to finish.  What another writer has written but not committed is in no version, so it stays;
folders that no version lists go once they are older than ``grace`` seconds too, which must exceed the longest write.
The number of a deleted version stays taken: its folder stays, without its list, for at least GRACE seconds whatever ``grace`` is.  So a
writer that looked for the newest version, waited, and renames while others commit and vacuum finds its number taken and tries again.

Only DataFrame operations touch the rows; the driver handles one line of metadata for each folder.

Edge cases: rows are stored as they are, with nulls, repeats and any columns; an empty arrival adds
a version and no shard; an empty store reads as an empty table of the given schema; a tier that is
too small, or of one shard, is left alone; merging again without new arrivals changes nothing.
"""

from __future__ import annotations

import math
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TARGET_BYTES = 64 << 20
SHARD_ROWS = 2_000  # rows of an arriving shard at most
FAN_IN = 4
TIER = 4  # ratio of sizes between tiers
GRACE = 7 * 24 * 3600.0  # seconds an unlisted folder is kept: a writer may still be about to commit it
MANIFEST = T.StructType([T.StructField("path", T.StringType()), *(T.StructField(n, T.LongType()) for n in ("files", "rows", "bytes"))])


@dataclass(frozen=True)
class Shards:
    """A folder of shards that one arrival or merge wrote."""

    path: str
    files: int
    rows: int
    bytes: int

    @property
    def size(self) -> float:
        return self.bytes / self.files


class Conflict(RuntimeError):
    """Another writer committed the version first."""


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, target_bytes: int = TARGET_BYTES):
        self.spark, self.root, self.schema, self.target = spark, root.rstrip("/"), schema, target_bytes

    # ------------------------------------------------------------ manifest

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(name)

    def _fs(self):
        return self._path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _times(self) -> dict[int, int]:
        """When each version was written, in milliseconds; a vacuumed one has no list any more."""
        lists = self._fs().globStatus(self._path(f"{self.root}/manifest/v*/part-*"))
        return {int(s.getPath().getParent().getName()[1:]): s.getModificationTime() for s in lists or ()}

    def versions(self) -> list[int]:
        return sorted(self._times())

    def version(self) -> int:
        """The newest committed version, 0 for a new store."""
        return max(self.versions(), default=0)

    def shards(self, version: int) -> list[Shards]:
        """The live folders of a version."""
        if not version:
            return []
        rows = self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifest/v{version:012d}").orderBy("path").collect()
        return [Shards(r.path, r.files, r.rows, r.bytes) for r in rows]

    def newest(self) -> tuple[int, list[Shards]]:
        """The newest version and its folders; looks again if it goes while it is read."""
        while True:
            now = self.version()
            try:
                return now, self.shards(now)
            except Exception:
                if self.version() == now:
                    raise

    def commit(self, shards: list[Shards], after: int) -> int:
        """Publishes ``shards`` as the version that follows ``after``."""
        aside = f"{self.root}/aside/{uuid.uuid4().hex}"
        self.spark.createDataFrame([(s.path, s.files, s.rows, s.bytes) for s in shards], MANIFEST).coalesce(1).write.parquet(aside)
        fs = self._fs()
        fs.mkdirs(self._path(f"{self.root}/manifest"))
        to = f"{self.root}/manifest/v{after + 1:012d}"
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.root).toUri(), self.spark._jsc.hadoopConfiguration())
        plain = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        source, target = (fs.makeQualified(self._path(p)) for p in (aside, to))
        if self.version() > after:  # spares a try; what decides is the rename, as no number is ever used twice
            raise Conflict(to)
        try:
            context.rename(source, target, plain)
        except Exception as e:
            if fs.exists(target):
                raise Conflict(to) from e
            raise
        return after + 1

    # ------------------------------------------------------------ files

    def _written(self, df: DataFrame, limit: int) -> list[Shards]:
        """Writes a folder of shards of at most ``limit`` rows (0: any number); none for an empty table."""
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").option("maxRecordsPerFile", limit).parquet(folder)
        each = self.spark.read.schema(self.schema).parquet(folder).groupBy(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size")).agg(F.count("*").alias("n"))
        found = each.agg(F.count("*").alias("files"), F.sum("n").alias("rows"), F.sum("size").alias("bytes")).first()
        return [Shards(folder, found.files, found.rows, found.bytes)] if found.files else []

    def append(self, df: DataFrame) -> int:
        """Adds an arrival and returns the new version."""
        new = self._written(df.select(*self.schema.names), SHARD_ROWS)
        while True:
            now, live = self.newest()
            try:
                return self.commit([*live, *new], now)
            except Conflict:
                continue

    def tiers(self, shards: list[Shards]) -> list[list[Shards]]:
        """Runs of similarly sized shards that are worth merging, smallest first."""
        found: dict[int, list[Shards]] = {}
        for s in shards:
            if s.size < self.target / 2:
                found.setdefault(int(math.log(max(s.size, 4096) / 4096, TIER)), []).append(s)
        return [sorted(found[k], key=lambda s: s.path) for k in sorted(found) if sum(s.files for s in found[k]) >= FAN_IN]

    def compact(self) -> int:
        """Merges every run; returns the version afterwards.  Raises Conflict, and leaves the store as it was, if another writer commits meanwhile."""
        now, live = self.newest()
        gone, new = set(), []
        try:
            for run in self.tiers(live):
                files = max(1, round(sum(s.bytes for s in run) / self.target))
                merged = self._written(self.spark.read.schema(self.schema).parquet(*(s.path for s in run)).coalesce(files), 0)
                new += merged
                if sum(s.rows for s in merged) != sum(s.rows for s in run):
                    raise RuntimeError("a merge changed the number of rows")
                gone |= {s.path for s in run}
            return self.commit([*(s for s in live if s.path not in gone), *new], now) if gone else now
        except Exception as e:
            for s in new:
                self._fs().delete(self._path(s.path), True)
            if not isinstance(e, Conflict) and self.version() > now:  # a vacuum may have taken what was being read
                raise Conflict(f"version {now} is no longer the newest") from e
            raise

    def settle(self) -> int:
        """Compacts until no run is left, again from the newest version where another writer was faster.

        A run becomes fewer files each time, so this ends when arrivals do.
        """
        while True:
            before = self.version()
            try:
                if self.compact() == before:
                    return before
            except Conflict:
                continue

    def vacuum(self, grace: float = GRACE) -> None:
        """Deletes versions replaced over ``grace`` seconds ago, folders that only they list, and unlisted folders as old."""
        fs, times, before = self._fs(), self._times(), (time.time() - grace) * 1000
        order = sorted(times)
        old = [v for v, after in zip(order, order[1:], strict=False) if times[after] < before]
        lists = {v: self.shards(v) for v in order}
        live = {s.path.rpartition("/")[2] for v in order if v not in old for s in lists[v]}
        for v in old:
            for s in lists[v]:
                if s.path.rpartition("/")[2] not in live:
                    fs.delete(self._path(s.path), True)
            for file in fs.listStatus(self._path(f"{self.root}/manifest/v{v:012d}")):
                fs.delete(file.getPath(), True)
        newest = {s.path.rpartition("/")[2] for s in self.newest()[1]}
        for kind in ("data", "aside"):
            if fs.exists(self._path(f"{self.root}/{kind}")):
                for folder in fs.listStatus(self._path(f"{self.root}/{kind}")):
                    if folder.getPath().getName() not in live | newest and folder.getModificationTime() < before:
                        fs.delete(folder.getPath(), True)
        held = self._times()
        for folder in fs.listStatus(self._path(f"{self.root}/manifest")) if held else ():
            if int(folder.getPath().getName()[1:]) not in held and folder.getModificationTime() < (time.time() - GRACE) * 1000:
                fs.delete(folder.getPath(), True)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the newest by default."""
        paths = [s.path for s in (self.newest()[1] if version is None else self.shards(version))]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)
