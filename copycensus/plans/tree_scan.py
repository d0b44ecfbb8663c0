"""Duplicate scan of a file tree, resumable and incremental.

Below ``out``: ``hash_cache`` (kept between runs), ``candidates`` (dropped once the report is
written), ``report`` (CSV) and ``review`` (one Parquet table per review list).
"""

from __future__ import annotations

import hashlib
import json
import math
import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import workspace
from ..functions.scalars import DEFAULT_EXTENSIONS
from ..operators import candidates as c
from ..operators import groups as g
from ..operators import review as r
from ..commits import Commits
from ..operators.bucket_cache import BucketCache
from ..operators.cache import HashCache, cache_lookup, hash_stats
from ..operators.report import groups_from_report, invalid_report_groups, report_members, report_rows
from ..sources import tree
from ..sources.file_system import root_text
from ..sources.report_csv import read_report, write_report

# Bytes hashed between two commits to the cache, which is what a broken run can lose: some minutes
# of work for each core, and no less than the second number.
COMMIT_BYTES_PER_CORE = 64 << 30
LEAST_COMMIT_BYTES = 1 << 40

REVIEW_TABLES = ("totals", "summary", "review", "review_paths", "high_priority", "suspicious")

CANDIDATE_SCHEMA = "path STRING, size_bytes BIGINT, modified_ms BIGINT, is_symlink BOOLEAN"
WALK_STATS_SCHEMA = "files_found BIGINT, candidates BIGINT, skipped_unique_size BIGINT, unreadable BIGINT"


@dataclass
class TreeScan:
    """Tables that a scan left below ``out``, and its counters.

    ``totals``, ``walk_stats`` and ``hash_stats`` have one row each; ``summary`` has labelled rows.
    """

    report: DataFrame
    totals: DataFrame
    summary: DataFrame
    walk_stats: DataFrame
    hash_stats: DataFrame


def candidates_path(out: str, root: str, extensions: Sequence[str]) -> str:
    """Where the candidates of this root and these suffixes are kept; other parameters, other path."""
    key = json.dumps([root, list(extensions)])
    return f"{out}/candidates/{hashlib.sha256(key.encode()).hexdigest()[:16]}"


def find_candidates(spark: SparkSession, root: str, out: str, extensions: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The files to hash, and the walk's counters.

    A finished candidate table of an earlier, broken run spares the walk, and finished rounds of a broken
    walk are not repeated. The files may have changed since, so their times are read again before they are
    compared with the cache.
    """
    path = candidates_path(out, root, extensions)
    resumed = workspace.is_committed(spark, path) and workspace.is_committed(spark, path + "-stats")
    if not resumed:
        listed = workspace.snapshot(tree.inventory(spark, root, extensions, keep=path + "-walk"), "inventory")
        files = listed.filter(F.col("error").isNull())
        unreadable = listed.filter(F.col("error").isNotNull()).agg(F.count("*").alias("n")).scalar()
        c.candidate_stats(files).withColumn("unreadable", unreadable).write.mode("overwrite").parquet(path + "-stats")
        prune = c.mapped_size_candidates if files.count() >= c.MAP_ROWS else c.size_candidates
        prune(files).drop("error").write.mode("overwrite").parquet(path)
        workspace.delete(spark, path + "-walk")
    candidates = spark.read.schema(CANDIDATE_SCHEMA).parquet(path)
    if resumed:
        now = F.coalesce("stat_ms", F.lit(0).cast("bigint"))
        present = tree.stat_files(candidates, candidates.count())
        candidates = present.withColumn("modified_ms", now).drop("stat_bytes", "stat_ms")
    return candidates, spark.read.schema(WALK_STATS_SCHEMA).parquet(path + "-stats")


def open_cache(spark: SparkSession, folder: str, buckets: int | None = None) -> HashCache | BucketCache:
    """The cache below ``folder``: by bucket if it is stored so, or if a number of buckets is given."""
    if buckets or Commits(spark, folder).number():
        return BucketCache(spark, folder, buckets)
    return HashCache(spark, folder)


def fingerprint_candidates(
    candidates: DataFrame, cache: HashCache | BucketCache, commit_bytes: int | None = None
) -> DataFrame:
    """Digests of ``candidates``: from the cache where path and time match, else by reading files.

    Files are read in rounds of about ``commit_bytes``. Each round is committed to the cache on
    its own, so a run that breaks off resumes after its last full round.
    """
    spark = cache.spark
    if commit_bytes is None:
        commit_bytes = max(LEAST_COMMIT_BYTES, spark.sparkContext.defaultParallelism * COMMIT_BYTES_PER_CORE)
    # Both parts of the result are stored tables, so it may be read repeatedly.
    looked_up = workspace.snapshot(cache_lookup(candidates, cache.load()), "lookup")
    misses = looked_up.filter("NOT cache_hit")
    todo = misses.agg(F.count("*").alias("files"), F.sum("size_bytes").alias("bytes")).first()
    rounds = max(1, math.ceil((todo.bytes or 0) / commit_bytes)) if todo.files else 0
    hashed = looked_up.filter("cache_hit").select(
        "path", "size_bytes", "modified_ms", "sha256", F.lit(None).cast("string").alias("error"), "cache_hit"
    )
    written = []
    for i in range(rounds):
        share = misses.filter(F.pmod(F.xxhash64("path"), F.lit(rounds)) == i)
        fresh = tree.hash_files(tree.deal_by_bytes(share))
        if isinstance(cache, BucketCache):
            written.append(workspace.scratch_path(spark, "hashed"))
            fresh.hint("rebalance").write.parquet(written[-1])
            cache.append(spark.read.schema(tree.HASHED_SCHEMA).parquet(written[-1]))
        else:
            written.append(f"{cache.folder}/seg-{cache.append(fresh):08d}")
    if written:
        fresh = spark.read.schema(tree.HASHED_SCHEMA).parquet(*written)
        hashed = hashed.union(fresh.withColumn("cache_hit", F.lit(False)))
    return hashed


def scan_tree(
    spark: SparkSession,
    root: str,
    out: str,
    extensions: Sequence[str] = DEFAULT_EXTENSIONS,
    decisions: DataFrame | None = None,
    commit_bytes: int | None = None,
    high_priority_rows: int = r.HIGH_PRIORITY_ROWS,
    suspicious_rows: int = r.SUSPICIOUS_ROWS,
    cache_buckets: int | None = None,
) -> TreeScan:
    """Find duplicate files below ``root`` and write report and review tables below ``out``.

    The scanned files are only read. ``root`` is a folder on a mount or a URI. Every run writes a
    report, with just a header if there are no duplicates. ``decisions`` (sha256, decision, reviewer,
    notes) carries earlier answers over; it may be the review table of an earlier scan. ``cache_buckets`` stores
    the hash cache by so many buckets from now on, for caches that are too large to shuffle in each run.
    """
    root, out = root_text(root), out.rstrip("/")
    with workspace.scratch_scope(spark, "scan"):
        _scan(spark, root, out, extensions, commit_bytes, cache_buckets)
        tables = review_from_report(spark, root, out, decisions, high_priority_rows, suspicious_rows)
    read = spark.read.parquet
    return TreeScan(
        read_report(spark, f"{out}/report"),
        tables["totals"],
        tables["summary"],
        read(f"{out}/stats/walk"),
        read(f"{out}/stats/hash"),
    )


def _publish(table: DataFrame, path: str) -> None:
    """Store a table beside ``path`` and put it in place once it is complete."""
    new = f"{path}.new-{uuid.uuid4().hex}"
    table.write.parquet(new)
    workspace.replace(table.sparkSession, new, path)


def _scan(
    spark: SparkSession,
    root: str,
    out: str,
    extensions: Sequence[str],
    commit_bytes: int | None,
    cache_buckets: int | None,
) -> None:
    """Everything up to the report."""
    candidates, walk_stats = find_candidates(spark, root, out, extensions)
    walk_stats = workspace.snapshot(walk_stats, "walk-stats")
    cache = open_cache(spark, f"{out}/hash_cache", cache_buckets)
    fingerprints = fingerprint_candidates(candidates, cache, commit_bytes)
    _publish(hash_stats(fingerprints), f"{out}/stats/hash")
    _publish(walk_stats, f"{out}/stats/walk")

    found = workspace.snapshot(g.duplicate_groups(fingerprints, root), "groups")
    found = workspace.snapshot(g.number_groups(found), "numbered")
    members = g.attach_groups(fingerprints.select("path", "sha256"), found)
    # Size and time as they are now: the walk may have been hours ago, or in an earlier run. The
    # rows are stored before they are sorted, as sorting samples its input first and would run the
    # join and the file calls twice.
    paths = found.agg(F.coalesce(F.sum("file_count"), F.lit(0))).first()[0]
    rows = tree.stat_files(members.select("group_id", "sha256", "path", "is_original"), paths)
    write_report(workspace.snapshot(report_rows(rows), "report-rows"), f"{out}/report")

    if workspace.is_committed(spark, f"{out}/report"):
        kept = candidates_path(out, root, extensions)
        workspace.delete(spark, kept)
        workspace.delete(spark, kept + "-stats")
    cache.compact()


def review_from_report(
    spark: SparkSession,
    root: str,
    out: str,
    decisions: DataFrame | None = None,
    high_priority_rows: int = r.HIGH_PRIORITY_ROWS,
    suspicious_rows: int = r.SUSPICIOUS_ROWS,
) -> dict[str, DataFrame]:
    """Build the review tables from the CSV report below ``out``; its rows are the raw data table.

    The decisions are stored before anything is replaced, as they may come from the very tables. The
    checks of report and decisions are tables, too: groups without exactly one original or with mixed
    digests, answers that are not allowed, and digests with different answers.
    """
    root, out = root_text(root), out.rstrip("/")
    checks = {}
    if decisions is not None:
        decisions = workspace.snapshot(decisions, "decisions")
        checks["invalid_decisions"] = r.invalid_decisions(decisions).select("sha256", "decision")
        checks["conflicting_decisions"] = r.conflicting_decisions(decisions)
    report = workspace.snapshot(read_report(spark, f"{out}/report"), "report")
    checks["invalid_groups"] = invalid_report_groups(report)
    groups = workspace.snapshot(groups_from_report(report, root), "report-groups")
    members = report_members(report)
    pages = workspace.snapshot(r.review_paths_in_order(groups, members), "pages")
    today = datetime.now(timezone.utc).strftime("%Y-%m-%d %H:%M")
    tables = {
        "totals": g.scan_summary(groups),
        "summary": r.review_summary(groups, r.with_decisions(groups, decisions), root, today).orderBy("row_no"),
        "review": r.review_queue(groups, members, decisions, pages=pages).orderBy("group_id"),
        "review_paths": pages,
        "high_priority": r.high_priority(groups, members, decisions, high_priority_rows, pages=pages),
        "suspicious": r.suspicious(groups, members, decisions, suspicious_rows, pages=pages),
    }
    tables |= checks
    # All tables are complete before the first one of the earlier scan is replaced.
    new = {name: f"{out}/review/{name}.new-{uuid.uuid4().hex}" for name in tables}
    for name, table in tables.items():
        table.write.parquet(new[name])
    for name, path in new.items():
        workspace.replace(spark, path, f"{out}/review/{name}")
    return {name: spark.read.schema(table.schema).parquet(f"{out}/review/{name}") for name, table in tables.items()}
