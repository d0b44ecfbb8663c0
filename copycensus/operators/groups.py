"""Duplicate groups: files with equal content."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import human_size, top_level_dir
from .skew import HOT_ROWS, join_counted


def duplicate_groups(fingerprints: DataFrame, root: str) -> DataFrame:
    """One row per digest that occurs at least twice; files without a digest are left out.

    Only counts and minima are kept per digest, so the partial aggregate folds a digest that a
    third of all files share into one row per task before the shuffle. ``spanning`` compares the
    least and greatest top-level directory, which needs no distinct count.
    """
    size = "coalesce(first.size_bytes, 0L)"
    return (
        fingerprints.filter(F.col("sha256").isNotNull())
        .select("sha256", "path", "size_bytes", top_level_dir("path", root).alias("_top"))
        .groupBy("sha256")
        .agg(
            F.count("*").alias("file_count"),
            F.min(F.struct("path", "size_bytes")).alias("first"),
            (F.min("_top") != F.max("_top")).alias("spanning"),
        )
        .filter("file_count >= 2")
        .selectExpr(
            "sha256",
            "file_count",
            f"{size} AS size_bytes",
            f"(file_count - 1) * {size} AS wasted_bytes",
            "first.path AS original_path",
            "spanning",
        )
    )


def number_groups(groups: DataFrame) -> DataFrame:
    """Add ``group_id``: 1, 2, 3, ... in digest order.

    A global window would sort all groups in one task. Instead groups are counted per four-digit
    digest prefix; the running sum over those at most 65,536 counts gives each prefix its offset,
    and rows are numbered within their prefix. Digests are uniform, so prefixes are too.
    ``groups`` is read twice, so pass a stored table.
    """
    prefix = F.substring("sha256", 1, 4)
    before = Window.orderBy("_prefix").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        groups.groupBy(prefix.alias("_prefix"))
        .agg(F.count("*").alias("_n"))
        .select("_prefix", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    within = Window.partitionBy("_prefix").orderBy("sha256")
    return (
        groups.withColumn("_prefix", prefix)
        .withColumn("_rank", F.row_number().over(within))
        .join(F.broadcast(offsets), "_prefix")
        .select((F.col("_offset") + F.col("_rank")).cast("bigint").alias("group_id"), *groups.columns)
    )


def attach_groups(files: DataFrame, groups: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The members of ``groups`` with their group's columns and ``is_original``.

    ``files`` needs ``sha256`` and ``path``; its other columns are kept as they are, so it must
    not repeat the names of the group columns.
    """
    members = join_counted(files, groups, "sha256", "file_count", F.col("path"), "inner", hot_rows)
    return members.withColumn("is_original", F.col("path") == F.col("original_path"))


def spanning_groups(groups: DataFrame) -> DataFrame:
    """Groups whose copies lie under different top-level directories."""
    return groups.filter("spanning")


def scan_summary(groups: DataFrame) -> DataFrame:
    """One row: groups, redundant files, wasted bytes and the same in readable form."""
    zero = F.lit(0).cast("bigint")
    return groups.agg(
        F.count("*").alias("duplicate_groups"),
        F.coalesce(F.sum(F.col("file_count") - 1), zero).alias("redundant_files"),
        F.coalesce(F.sum("wasted_bytes"), zero).alias("wasted_bytes"),
    ).withColumn("wasted_human", human_size("wasted_bytes"))
