"""Duplicate groups kept up to date from the files that changed.

Three bucketed tables change together, by one commit:

- ``files``, by path: the digest and size of each file,
- ``members``, by digest: the same turned round, to read the members of a few digests,
- ``cells``, by digest: for each digest and top-level directory the number of files and the least path.

An update finds what the changed files were before by a join with ``files``, adds and takes away per cell, and keeps
the lesser path. Only where the least path of a cell went, the members of that digest are read again. Groups are a
fold over the cells of a digest, and a digest spans directories if it has more than one. All of these tables stay
where they lie; what is shuffled are the changes and what they touch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import workspace
from ..commits import ATTEMPTS, Commits, Conflict
from ..functions.scalars import top_level_dir
from .bucket_table import BucketTable

#: Members of one digest lie in so many places of the table, as one digest may be that of a third of all files.
MEMBER_PARTS = 16
#: Digests whose members are looked up by a pushed filter; more are joined.
PUSHED_DIGESTS = 500


class GroupIndex:
    """The index below ``folder`` of files below ``root``."""

    def __init__(
        self, spark: SparkSession, folder: str, root: str, buckets: int | None = None, fanout: int = 8
    ) -> None:
        self.spark, self.root = spark, root
        self.commits = Commits(spark, folder)

        def table(part: str, key: list[str], by: list[str], others: dict[str, str]) -> BucketTable:
            columns = dict.fromkeys(key, "STRING") | others
            if "part" in columns:
                columns["part"] = "INT"
            return BucketTable(spark, folder, columns, key, by, buckets, fanout, part)

        size, n = {"size_bytes": "BIGINT"}, {"n": "BIGINT"}
        self.files = table("files", ["path"], ["path"], {"sha256": "STRING"} | size)
        self.members = table("members", ["sha256", "part", "path"], ["sha256", "part"], size | {"present": "BOOLEAN"})
        self.cells = table("cells", ["sha256", "top"], ["sha256"], n | {"path": "STRING"} | size)

    def _moves(self, changes: DataFrame, content: dict) -> DataFrame:
        """What changed for each path, with the digest before and after; null where there was or is none."""
        old = self.files.load(content).select(
            "path", F.col("sha256").alias("old_sha256"), F.col("size_bytes").alias("old_size")
        )
        new = changes.select("path", "sha256", F.when(F.col("sha256").isNotNull(), F.col("size_bytes")).alias("size_bytes"))
        moved = new.join(old, "path", "left").withColumn("top", top_level_dir("path", self.root))
        same = F.col("sha256").eqNullSafe(F.col("old_sha256")) & F.col("size_bytes").eqNullSafe(F.col("old_size"))
        return moved.filter(~same)

    def _read_again(self, cells: DataFrame, members: DataFrame) -> DataFrame:
        """sha256, top, n, path, size_bytes of cells (sha256, top) from the ``members`` that remain."""
        digests = cells.select("sha256").distinct()
        few = [r.sha256 for r in digests.limit(PUSHED_DIGESTS + 1).collect()]
        if len(few) <= PUSHED_DIGESTS:
            # Reaches the files, which are sorted by digest.
            found = members.filter(F.col("sha256").isin(few))
        else:
            parts = digests.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(MEMBER_PARTS - 1))))
            found = members.join(parts, ["sha256", "part"], "left_semi")
        found = found.filter("present").withColumn("top", top_level_dir("path", self.root))
        least = F.min(F.struct("path", "size_bytes")).alias("first")
        counted = found.groupBy("sha256", "top").agg(F.count("*").alias("n"), least)
        return cells.join(counted, ["sha256", "top"], "left").select(
            "sha256", "top", F.coalesce("n", F.lit(0)).alias("n"), "first.path", "first.size_bytes"
        )

    def _changed_cells(self, moves: DataFrame, content: dict) -> tuple[DataFrame, DataFrame]:
        """New rows of ``members`` and, for all cells that the moves touch, of ``cells``."""
        part = F.pmod(F.xxhash64("path"), F.lit(MEMBER_PARTS)).cast("int").alias("part")
        gone = moves.filter("old_sha256 IS NOT NULL").select(
            F.col("old_sha256").alias("sha256"), part, "path", "top", F.col("old_size").alias("size_bytes"), F.lit(False).alias("present")
        )
        come = moves.filter("sha256 IS NOT NULL").select(
            "sha256", part, "path", "top", "size_bytes", F.lit(True).alias("present")
        )
        # A file that keeps its digest and changes its size goes and comes; what counts is that it came.
        both = gone.unionByName(come).groupBy("sha256", "part", "path", "top")
        both = both.agg(
            F.max(F.when(F.col("present"), F.col("size_bytes"))).alias("size_bytes"), F.max("present").alias("present"),
            (F.count_if("present") - F.count_if(~F.col("present"))).alias("more"), F.max(~F.col("present")).alias("left"),
        )
        both = workspace.snapshot(both, "index-members")
        before = self.cells.load(content).select(
            "sha256", "top", F.col("n").alias("old_n"), F.struct("path", "size_bytes").alias("old_first")
        )
        # Counts and minima are folded before the shuffle, so a hot cell costs one row for each task.
        least = F.min(F.when(F.col("present"), F.struct("path", "size_bytes"))).alias("added")
        delta = both.groupBy("sha256", "top").agg(F.sum("more").alias("more"), least)
        touched = delta.join(before.filter("old_n > 0"), ["sha256", "top"], "left")
        # The least path of a cell is one path, so at most one of its changes can be it.
        lost = both.filter("left").select("sha256", "top", F.col("path").alias("lost"))
        firsts = before.filter("old_n > 0").select("sha256", "top", F.col("old_first.path").alias("lost"))
        unsure = lost.join(firsts, ["sha256", "top", "lost"], "left_semi").select("sha256", "top").distinct()
        touched = touched.join(unsure.withColumn("unsure", F.lit(True)), ["sha256", "top"], "left")
        n = F.coalesce("old_n", F.lit(0)) + F.col("more")
        first = F.least("old_first", "added")
        touched = workspace.snapshot(
            touched.select("sha256", "top", n.alias("n"), first.alias("first"), F.coalesce("unsure", F.lit(False)).alias("unsure")),
            "index-cells",
        )
        sure = touched.filter("NOT unsure OR n = 0")
        sure = sure.select("sha256", "top", "n", F.when(F.col("n") > 0, F.col("first")).alias("first"))
        sure = sure.select("sha256", "top", "n", "first.path", "first.size_bytes")
        rows = both.select("sha256", "part", "path", "size_bytes", "present")
        again = touched.filter("unsure AND n > 0").select("sha256", "top")
        if again.isEmpty():
            return rows, sure
        # What the members are after this change: the stored ones less those that it names, and those it brings.
        stored = self.members.load(content).select("sha256", "part", "path", "size_bytes", "present")
        rest = stored.join(rows.select("sha256", "part", "path"), ["sha256", "part", "path"], "left_anti")
        return rows, sure.unionByName(self._read_again(again, rest.unionByName(rows)))

    def update(self, changes: DataFrame) -> int:
        """Take in changed files (path, size_bytes, sha256; a null digest means that the file went or cannot be
        read) and return the number of the commit. Paths must be unique. Files that are not named stay as they are.

        An update is made from one commit; if another came first, it is made again from that.
        """
        changes = workspace.snapshot(changes.select("path", "size_bytes", "sha256"), "changes")
        for _ in range(ATTEMPTS):
            number = self.commits.number()
            content = self.commits.at(number)
            moves = workspace.snapshot(self._moves(changes, content), "moves")
            members, cells = self._changed_cells(moves, content)
            staged = [
                (self.files, self.files.stage(moves.select("path", "sha256", "size_bytes"))),
                (self.members, self.members.stage(members)),
                (self.cells, self.cells.stage(cells)),
            ]

            def add(now: dict) -> dict | None:
                if now != content:
                    return None
                for table, segment in staged:
                    now = table.added(now, segment)
                return now

            if self.commits.change(add) is not None:
                return number + 1
            for table, segment in staged:
                table.drop(segment["name"])
        raise Conflict(f"other updates of {self.commits.folder} were always faster")

    def compact(self, everything: bool = False) -> None:
        for table in (self.files, self.members, self.cells):
            table.compact(everything)

    def groups(self) -> DataFrame:
        """``duplicate_groups`` of the files as they are now. Cells of a digest lie together, so nothing moves."""
        size = "coalesce(first.size_bytes, 0L)"
        folded = self.cells.load().filter("n > 0").groupBy("sha256").agg(
            F.sum("n").alias("file_count"),
            F.min(F.struct("path", "size_bytes")).alias("first"),
            (F.count("*") > 1).alias("spanning"),
        )
        return folded.filter("file_count >= 2").selectExpr(
            "sha256",
            "file_count",
            f"{size} AS size_bytes",
            f"(file_count - 1) * {size} AS wasted_bytes",
            "first.path AS original_path",
            "spanning",
        )

    def fingerprints(self) -> DataFrame:
        """path, sha256, size_bytes of the files as they are now."""
        return self.files.load().filter("sha256 IS NOT NULL").select("path", "sha256", "size_bytes")
