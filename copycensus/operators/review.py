"""Review tables: what a person works through, and what follows from their decisions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import workspace
from ..functions.scalars import human_size, short_hash
from .groups import attach_groups, scan_summary, spanning_groups
from .skew import HOT_ROWS

# The decisions a reviewer can take.
PENDING = "Pending"
ARCHIVE = "Archive duplicates"
KEEP = "Keep all"
ESCALATE = "Escalate"
DECISIONS = (PENDING, ARCHIVE, KEEP, ESCALATE)

# Labels of the summary, by row number.
SUMMARY_LABELS = {
    1: "Scan root",
    2: "Scan date",
    3: "Duplicate groups",
    4: "Redundant files",
    5: "Total wasted space",
    6: "Groups reviewed",
    7: "Marked for archive",
    8: "Marked keep all",
    9: "Escalated",
    10: "Pending",
}

# Lengths of the two short lists.
HIGH_PRIORITY_ROWS = 500
SUSPICIOUS_ROWS = 2000

# Paths listed in one cell. The review tables show the first page of a group; ``review_paths`` has all.
PAGE_PATHS = 10_000

# A short list up to this length is broadcast.
BROADCAST_ROWS = 10_000

REVIEW_COLUMNS = (
    "group_id", "sha256", "sha256_short", "file_count", "size_bytes", "size_each",
    "wasted_bytes", "wasted_space", "original_path", "page", "duplicates",
    "decision", "reviewer", "notes",
)


def one_decision_each(decisions: DataFrame) -> DataFrame:
    """One row per digest: sha256, decision, reviewer, notes.

    Of several rows the one with the latest ``updated_at`` counts, if there is such a column; then an
    answer before a pending or blank one, and of answers the greatest in byte order.
    """
    answered = F.coalesce(~F.col("decision").isin(PENDING, ""), F.lit(False))
    order = [answered.alias("answered"), "decision", "reviewer", "notes"]
    if "updated_at" in decisions.columns:
        order.insert(0, "updated_at")
    best = decisions.filter("sha256 IS NOT NULL").groupBy("sha256").agg(F.max(F.struct(*order)).alias("best"))
    return best.select("sha256", "best.decision", "best.reviewer", "best.notes")


def conflicting_decisions(decisions: DataFrame) -> DataFrame:
    """Digests with more than one answer: sha256, answers."""
    answered = decisions.filter(~F.col("decision").isin(PENDING, "") & F.col("sha256").isNotNull())
    spread = answered.groupBy("sha256").agg(
        F.min("decision").alias("least"), F.max("decision").alias("greatest")
    )
    return spread.filter("least <> greatest").select("sha256", F.array("least", "greatest").alias("answers"))


def with_decisions(groups: DataFrame, decisions: DataFrame | None = None) -> DataFrame:
    """Add decision, reviewer and notes to ``groups``; the number of rows stays.

    ``decisions`` (sha256, decision, reviewer, notes) holds earlier answers. It joins on the digest
    because group numbers change between scans, after ``one_decision_each``.
    """
    if decisions is None:
        decision = reviewer = notes = F.lit(None).cast("string")
    else:
        groups = groups.join(one_decision_each(decisions), "sha256", "left")
        decision, reviewer, notes = F.col("decision"), F.col("reviewer"), F.col("notes")
    return groups.select(
        "group_id", "sha256", "file_count", "size_bytes", "wasted_bytes", "original_path",
        F.coalesce(decision, F.lit(PENDING)).alias("decision"),
        F.coalesce(reviewer, F.lit("")).alias("reviewer"),
        F.coalesce(notes, F.lit("")).alias("notes"),
    )


def _page(page_paths: int) -> Column:
    """Page of a duplicate: always 1 unless its group has more than ``page_paths`` duplicates.

    Paths of a larger group are dealt over its pages by a path hash, so building the pages needs
    no ranking of a whole group in one task.
    """
    pages = F.ceil((F.col("file_count") - 1) / F.lit(page_paths))
    dealt = F.conv(F.substring(F.md5("path"), 1, 8), 16, 10).cast("bigint") % pages + 1
    return F.when(pages <= 1, F.lit(1).cast("bigint")).otherwise(dealt)


def _path_lists(members: DataFrame, page_paths: int) -> DataFrame:
    """sha256, page, duplicates of attached members. Only digest, page and path are shuffled."""
    listed = members.filter(~F.col("is_original")).select("sha256", _page(page_paths).alias("page"), "path")
    return listed.groupBy("sha256", "page").agg(F.array_join(F.array_sort(F.collect_list("path")), "\n").alias("duplicates"))


def _places(members: DataFrame, hot_paths: int, hot_rows: int) -> DataFrame:
    """sha256, path and place of each duplicate in the path order of its group, from attached members.

    Members of a group of more than ``hot_rows`` files are dealt by ranges of their paths: Spark samples the
    paths for the bounds, each task ranks a range, and the counts of the ranges before it are added.
    ``hot_paths`` says how many files such groups hold.
    """
    listed = members.filter(~F.col("is_original")).select("sha256", "path", "file_count")
    in_group = Window.partitionBy("sha256").orderBy("path")
    usual = listed.filter(F.col("file_count") <= hot_rows)
    usual = usual.select("sha256", "path", F.row_number().over(in_group).cast("bigint").alias("place"))
    if not hot_paths:
        return usual
    hot = listed.filter(F.col("file_count") > hot_rows).select("sha256", "path")
    dealt = hot.repartitionByRange(math.ceil(2 * hot_paths / hot_rows), "sha256", "path")
    # Stored, as the bounds are sampled anew whenever they are computed.
    dealt = workspace.snapshot(dealt.select("*", F.spark_partition_id().alias("_range")), "ranges")
    before = Window.partitionBy("sha256").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("sha256", "_range").agg(F.count("*").alias("_n"))
    # A row for each range, and one more for each border of a group within a range.
    offsets = counts.select("sha256", "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    in_range = Window.partitionBy("sha256", "_range").orderBy("path")
    ranked = dealt.withColumn("_rank", F.row_number().over(in_range)).join(F.broadcast(offsets), ["sha256", "_range"])
    return usual.union(ranked.select("sha256", "path", (F.col("_before") + F.col("_rank")).alias("place")))


def review_paths_in_order(
    groups: DataFrame, members: DataFrame, page_paths: int = PAGE_PATHS, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """All duplicates of all groups: sha256, page, duplicates, ``page_paths`` to a page but for the last.

    The pages of a group, one after another, are its duplicates in path order. ``groups`` is read
    repeatedly, so pass a stored table.
    """
    counted = groups.select("sha256", "file_count", "original_path")
    attached = attach_groups(members.select("sha256", "path"), counted, hot_rows)
    hot_paths = groups.filter(F.col("file_count") > hot_rows).agg(F.sum("file_count")).first()[0] or 0
    placed = _places(attached, hot_paths, hot_rows)
    page = (F.floor((F.col("place") - 1) / F.lit(page_paths)) + 1).cast("bigint")
    paged = placed.select("sha256", page.alias("page"), "path").groupBy("sha256", "page")
    return paged.agg(F.array_join(F.array_sort(F.collect_list("path")), "\n").alias("duplicates"))


def _review_rows(
    decided: DataFrame, members: DataFrame | None, page_paths: int, pages: DataFrame | None = None
) -> DataFrame:
    """One row per group of ``decided`` with its first page of paths."""
    if pages is None:
        first = _path_lists(members.filter(_page(page_paths) == 1), page_paths)
    else:
        first = pages.filter("page = 1").select("sha256", "page", "duplicates")
    return (
        decided.join(first, "sha256", "left")
        .withColumn("page", F.lit(1).cast("bigint"))
        .withColumn("duplicates", F.coalesce("duplicates", F.lit("")))
        .select(
            "*",
            short_hash("sha256").alias("sha256_short"),
            human_size("size_bytes").alias("size_each"),
            human_size("wasted_bytes").alias("wasted_space"),
        )
        .select(*REVIEW_COLUMNS)
    )


def review_paths(
    groups: DataFrame, members: DataFrame, page_paths: int = PAGE_PATHS, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """All duplicates of all groups: sha256, page, duplicates, at most about ``page_paths`` to a page."""
    counted = groups.select("sha256", "file_count", "original_path")
    return _path_lists(attach_groups(members.select("sha256", "path"), counted, hot_rows), page_paths)


def review_queue(
    groups: DataFrame,
    members: DataFrame,
    decisions: DataFrame | None = None,
    page_paths: int = PAGE_PATHS,
    hot_rows: int = HOT_ROWS,
    pages: DataFrame | None = None,
) -> DataFrame:
    """One row per group with its duplicates and a decision.

    ``members`` needs ``sha256`` and ``path``; paths outside the groups are ignored. A group with more than
    ``page_paths`` duplicates shows one page of them; ``review_paths`` has the others. ``pages``, the
    stored result of ``review_paths_in_order``, gives the first page if there is one.
    """
    if pages is not None:
        return _review_rows(with_decisions(groups, decisions), None, page_paths, pages)
    counted = groups.select("sha256", "file_count", "original_path")
    attached = attach_groups(members.select("sha256", "path"), counted, hot_rows)
    return _review_rows(with_decisions(groups, decisions), attached, page_paths)


def _short_list(
    top: DataFrame, rows: int, members: DataFrame, page_paths: int, hot_rows: int, pages: DataFrame | None
) -> DataFrame:
    if pages is not None:
        return _review_rows(top, None, page_paths, pages)
    counted = top.select("sha256", "file_count", "original_path")
    members = members.select("sha256", "path")
    if rows <= BROADCAST_ROWS:
        attached = members.join(F.broadcast(counted), "sha256")
        attached = attached.withColumn("is_original", F.col("path") == F.col("original_path"))
    else:
        attached = attach_groups(members, workspace.snapshot(counted, "top"), hot_rows)
    return _review_rows(top, attached, page_paths)


def high_priority(
    groups: DataFrame,
    members: DataFrame,
    decisions: DataFrame | None = None,
    rows: int = HIGH_PRIORITY_ROWS,
    page_paths: int = PAGE_PATHS,
    hot_rows: int = HOT_ROWS,
    pages: DataFrame | None = None,
) -> DataFrame:
    """The groups that waste most, greatest first; ties stay in group order."""
    order = [F.desc("wasted_bytes"), F.asc("group_id")]
    top = with_decisions(groups.orderBy(*order).limit(rows), decisions)
    return _short_list(top, rows, members, page_paths, hot_rows, pages).orderBy(*order)


def suspicious(
    groups: DataFrame,
    members: DataFrame,
    decisions: DataFrame | None = None,
    rows: int = SUSPICIOUS_ROWS,
    page_paths: int = PAGE_PATHS,
    hot_rows: int = HOT_ROWS,
    pages: DataFrame | None = None,
) -> DataFrame:
    """The first groups, in group order, whose copies span top-level directories."""
    top = with_decisions(spanning_groups(groups).orderBy("group_id").limit(rows), decisions)
    return _short_list(top, rows, members, page_paths, hot_rows, pages).orderBy("group_id")


def invalid_decisions(decisions: DataFrame) -> DataFrame:
    """Decisions that are not one of the four allowed values; an empty one is allowed."""
    return decisions.filter(~F.col("decision").isin(*DECISIONS) & (F.col("decision") != ""))


def review_progress(decisions: DataFrame) -> DataFrame:
    """One row of counters over the decisions taken so far."""

    def count_of(value: str) -> Column:
        return F.count_if(F.col("decision") == value)

    return decisions.agg(
        (F.count_if(F.col("decision") != "") - count_of(PENDING)).alias("reviewed"),
        count_of(ARCHIVE).alias("archive"),
        count_of(KEEP).alias("keep"),
        count_of(ESCALATE).alias("escalated"),
        count_of(PENDING).alias("pending"),
    )


def archive_action_list(
    groups: DataFrame, members: DataFrame, decisions: DataFrame, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """The copies in groups marked for archiving; originals stay and nothing is modified.

    Groups are picked by decision first, one row each, and only then meet their members.
    """
    marked = one_decision_each(decisions).filter(F.col("decision") == ARCHIVE).select("sha256")
    picked = workspace.snapshot(groups.join(marked, "sha256", "left_semi"), "picked")
    copies = attach_groups(members.select("sha256", "path"), picked, hot_rows).filter(~F.col("is_original"))
    return copies.select("group_id", "sha256", F.col("path").alias("file_path"), "size_bytes")


def _labelled(row: DataFrame, cells: dict[int, Column]) -> DataFrame:
    return row.select(
        F.inline(
            F.array(
                *(
                    F.struct(
                        F.lit(number).alias("row_no"),
                        F.lit(SUMMARY_LABELS[number]).alias("label"),
                        value.cast("string").alias("value"),
                    )
                    for number, value in cells.items()
                )
            )
        )
    )


def review_summary(groups: DataFrame, decisions: DataFrame, root: str, scan_date: str | None = None) -> DataFrame:
    """Scan totals and review progress as numbered ``label``, ``value`` rows."""
    head = {1: F.lit(root)}
    if scan_date is not None:
        head[2] = F.lit(scan_date)
    found = {3: F.col("duplicate_groups"), 4: F.col("redundant_files"), 5: F.col("wasted_human")}
    progress = ("reviewed", "archive", "keep", "escalated", "pending")
    totals = _labelled(scan_summary(groups), head | found)
    return totals.union(_labelled(review_progress(decisions), {6 + k: F.col(c) for k, c in enumerate(progress)}))
