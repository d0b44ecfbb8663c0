"""The duplicate report: one row per member of each group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import last_modified_utc, top_level_dir
from .groups import attach_groups
from .skew import HOT_ROWS

# The columns of the report, in order.
REPORT_COLUMNS = ("group_id", "sha256", "file_path", "file_size_bytes", "last_modified", "is_original")


def report_rows(members: DataFrame) -> DataFrame:
    """Report rows from members that carry ``stat_bytes`` and ``stat_ms``; null means unreadable."""
    return members.select(
        "group_id",
        "sha256",
        F.col("path").alias("file_path"),
        F.coalesce("stat_bytes", F.lit(0).cast("bigint")).alias("file_size_bytes"),
        last_modified_utc("stat_ms").alias("last_modified"),
        "is_original",
    )


def duplicate_report(fingerprints: DataFrame, groups: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Report with the size and time that the inventory holds for each file."""
    files = fingerprints.select(
        "path", "sha256", F.col("size_bytes").alias("stat_bytes"), F.col("modified_ms").alias("stat_ms")
    )
    return report_rows(attach_groups(files, groups, hot_rows))


def report_with_stats(
    fingerprints: DataFrame, groups: DataFrame, stats: DataFrame, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Report with size and time from ``stats`` (path, size_bytes, modified_ms).

    A path that ``stats`` lacks shows as size 0 and time ``unknown``.
    """
    seen = stats.select("path", F.col("size_bytes").alias("stat_bytes"), F.col("modified_ms").alias("stat_ms"))
    members = attach_groups(fingerprints.select("path", "sha256"), groups, hot_rows)
    return report_rows(members.join(seen, "path", "left"))


def groups_from_report(report: DataFrame, root: str) -> DataFrame:
    """Rebuild the groups from report rows; the row marked original gives path and size."""
    original = F.col("is_original")
    return (
        report.withColumn("_top", top_level_dir("file_path", root))
        .groupBy("group_id")
        .agg(
            F.min("sha256").alias("sha256"),
            F.count("*").alias("file_count"),
            F.max(F.when(original, F.struct("file_path", "file_size_bytes"))).alias("kept"),
            F.min(F.struct("file_path", "file_size_bytes")).alias("first"),
            (F.min("_top") != F.max("_top")).alias("spanning"),
        )
        .selectExpr(
            "group_id",
            "sha256",
            "file_count",
            "coalesce(kept, first).file_size_bytes AS size_bytes",
            "(file_count - 1) * coalesce(kept, first).file_size_bytes AS wasted_bytes",
            "coalesce(kept, first).file_path AS original_path",
            "spanning",
        )
    )


def invalid_report_groups(report: DataFrame) -> DataFrame:
    """Groups of a report that do not have exactly one original or mix digests."""
    return (
        report.groupBy("group_id")
        .agg(
            F.count_if("is_original").alias("originals"),
            (F.min("sha256") != F.max("sha256")).alias("mixed_digests"),
        )
        .filter((F.col("originals") != 1) | F.col("mixed_digests"))
    )


def report_members(report: DataFrame) -> DataFrame:
    """The (sha256, path) pairs that a report lists."""
    return report.select("sha256", F.col("file_path").alias("path"))
