"""Size pruning: only files that share their size with another can be copies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import workspace
from ..functions.scalars import DEFAULT_EXTENSIONS, is_supported
from .bit_map import map_bits, mark_repeated
from .skew import HOT_ROWS, join_counted

#: Files from which on a bit map of sizes is worth its pass.
MAP_ROWS = 10_000_000


def supported_files(files: DataFrame, extensions: Sequence[str] = DEFAULT_EXTENSIONS) -> DataFrame:
    return files.filter(is_supported("path", extensions))


def size_histogram(files: DataFrame) -> DataFrame:
    """Number of files per size."""
    return files.groupBy("size_bytes").agg(F.count("*").alias("file_count"))


def size_candidates(files: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The files whose size occurs at least twice, with every column kept.

    Apply the suffix filter first: an unsupported file must not make a supported one a candidate.
    ``files`` is read twice, so pass a stored inventory and not a scan over contents.
    """
    shared = size_histogram(files).filter("file_count >= 2")
    kept = join_counted(files, shared, "size_bytes", "file_count", F.col("path"), "left_semi", hot_rows)
    return kept.select(*files.columns)


def mapped_size_candidates(files: DataFrame, bits: int | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``size_candidates`` of many files, without a shuffle of those whose size is their own.

    A map with two bits for each hash of a size, seen and seen again, tells most of them apart before
    anything is shuffled; what is left is decided exactly. ``files`` is read twice, so pass a stored inventory.
    """
    bits = bits or map_bits(files.count())
    likely = mark_repeated(files, "size_bytes", bits).filter("_marked").drop("_marked")
    return size_candidates(workspace.snapshot(likely, "likely-candidates"), hot_rows)


def candidate_stats(files: DataFrame) -> DataFrame:
    """One row: files found, candidates, and files skipped for their unique size."""
    n = F.col("file_count")
    return (
        size_histogram(files)
        .agg(
            F.coalesce(F.sum(n), F.lit(0)).alias("files_found"),
            F.coalesce(F.sum(F.when(n >= 2, n)), F.lit(0)).alias("candidates"),
        )
        .withColumn("skipped_unique_size", F.col("files_found") - F.col("candidates"))
    )
