"""Hash cache: digests from earlier runs, kept as committed Parquet segments.

A segment is written once and never changed; a segment without ``_SUCCESS`` is ignored. Reading
takes the latest entry per path. Compaction writes one segment that replaces all earlier ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import workspace

CACHE_SCHEMA = "path STRING, modified_ms BIGINT, sha256 STRING, run_id BIGINT"


def latest_entries(entries: DataFrame) -> DataFrame:
    """One live entry per path: the one with the greatest ``run_id``. Entries of vanished files stay."""
    return (
        entries.groupBy("path")
        .agg(F.max_by(F.struct("modified_ms", "sha256"), "run_id").alias("e"), F.max("run_id").alias("run_id"))
        .select("path", "e.modified_ms", "e.sha256", "run_id")
    )


def cache_lookup(files: DataFrame, cache: DataFrame) -> DataFrame:
    """Add ``sha256`` and ``cache_hit``: a hit needs the same path and the same time.

    Older and newer times both miss, and size is not compared. Both sides have one row per path,
    so the join is on the path alone and cannot skew.
    """
    known = cache.select("path", F.col("modified_ms").alias("_cached_ms"), "sha256")
    hit = F.coalesce(F.col("_cached_ms") == F.col("modified_ms"), F.lit(False))
    return (
        files.join(known, "path", "left")
        .withColumn("cache_hit", hit)
        .withColumn("sha256", F.when(F.col("cache_hit"), F.col("sha256")))
        .select(*files.columns, "sha256", "cache_hit")
    )


def cache_misses(files: DataFrame, cache: DataFrame) -> DataFrame:
    """The files that must be hashed: no cache entry has their path and time."""
    return files.join(cache.select("path", "modified_ms"), ["path", "modified_ms"], "left_anti").select(*files.columns)


def hash_stats(fingerprints: DataFrame) -> DataFrame:
    """One row: files hashed, total, cache hits and errors."""
    return fingerprints.agg(
        F.count_if(F.col("sha256").isNotNull()).alias("hashed"),
        F.count("*").alias("total"),
        F.count_if("cache_hit").alias("cache_hits"),
        F.count_if(F.col("error").isNotNull()).alias("errors"),
    )


class HashCache:
    """The stored cache below ``folder``."""

    def __init__(self, spark: SparkSession, folder: str, keep_segments: int = 8) -> None:
        self.spark = spark
        self.folder = folder.rstrip("/")
        self.keep_segments = keep_segments
        # What broken runs left behind; a segment that begins later may be one that another run is writing.
        self.abandoned = set(self._numbers()) - set(self.segments())

    def _numbers(self) -> list[int]:
        names = workspace.child_names(self.spark, self.folder)
        return [int(n.removeprefix("seg-")) for n in names if n.startswith("seg-")]

    def _path(self, number: int) -> str:
        return f"{self.folder}/seg-{number:08d}"

    def segments(self) -> list[int]:
        return [n for n in self._numbers() if workspace.is_committed(self.spark, self._path(n))]

    def read_segments(self, numbers: list[int]) -> DataFrame:
        if not numbers:
            return self.spark.createDataFrame([], CACHE_SCHEMA)
        entries = self.spark.read.schema(CACHE_SCHEMA).parquet(*(self._path(n) for n in numbers))
        return entries.filter(F.col("sha256").isNotNull())

    def load(self) -> DataFrame:
        """The live entries: path, modified_ms, sha256, run_id."""
        numbers = self.segments()
        entries = self.read_segments(numbers)
        return latest_entries(entries) if len(numbers) > 1 else entries

    def size(self) -> DataFrame:
        """One row with the number of live entries."""
        return self.load().agg(F.count("*").alias("entries"))

    def append(self, hashed: DataFrame) -> int:
        """Commit a segment and return its number. Paths must be unique; rows without digest are not entries.

        The narrow rows are put together before they are written: hashing may have a task for each
        large file, and a segment should not have a Parquet file for each.
        """
        number = max(self._numbers(), default=0) + 1
        rows = hashed.withColumn("run_id", F.lit(number).cast("bigint"))
        rows.hint("rebalance").write.parquet(self._path(number))
        return number

    def compact(self) -> None:
        """Fold the segments into one if there are more than ``keep_segments``.

        Only the folded segments go, and those that were already unfinished when this cache was opened.
        """
        old = self.segments()
        if len(old) <= self.keep_segments:
            return
        number = max(self._numbers()) + 1
        latest_entries(self.read_segments(old)).write.parquet(self._path(number))
        for n in sorted(self.abandoned - set(old)) + old:
            workspace.delete(self.spark, self._path(n))
