"""Hash cache stored by bucket: runs read and write what they touch, and the cache itself is never shuffled.

A ``BucketTable`` of the entries by path. A lookup shuffles the narrow candidates to where the cache lies, an
upsert writes its own entries, and two runs that commit at once both keep theirs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bucket_table import BucketTable
from .cache import HashCache, cache_lookup


class BucketCache(BucketTable):
    """The cache below ``folder``. Segments of a ``HashCache`` in the same folder are taken over when it is first
    changed."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int | None = None, fanout: int = 8) -> None:
        columns = {"path": "STRING", "modified_ms": "BIGINT", "sha256": "STRING"}
        super().__init__(spark, folder, columns, ["path"], buckets=buckets, fanout=fanout)

    def lookup(self, files: DataFrame) -> DataFrame:
        """``cache_lookup`` of ``files``; they are shuffled by path to where the cache lies."""
        return cache_lookup(files, self.load())

    def size(self) -> DataFrame:
        """One row with the number of live entries."""
        return self.load().agg(F.count("*").alias("entries"))

    def _take_over(self) -> None:
        """Make the segments of a ``HashCache`` the first segment."""
        if self.commits.number():
            return
        old = HashCache(self.spark, self.folder).load()
        last = old.agg(F.max("run_id")).first()[0] or 0
        staged = self.stage(old, "run_id")
        # The runs go on counting from the older cache's.
        first = {"buckets": staged["buckets"], "segments": [], "runs": max(0, last - 1)}
        made = self.commits.change(lambda now: None if now else self.added(first, staged) if last else first)
        if made is None and staged["rows"]:
            self.drop(staged["name"])

    def append(self, hashed: DataFrame) -> int:
        """Commit a segment of hashed files and return its run. Paths must be unique; rows without digest are
        not entries."""
        self._take_over()
        staged = self.stage(hashed.filter(F.col("sha256").isNotNull()))
        _, after = self.commits.change(lambda now: self.added(now, staged))
        return after["runs"]
