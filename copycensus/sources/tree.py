"""File trees: listing, file attributes and hashing, on mounts that every executor sees and on URIs.

The functions that run inside tasks are nested, so they travel to the executors by value.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import workspace
from ..functions.scalars import DEFAULT_EXTENSIONS
from ..operators.candidates import supported_files
from .file_system import Files, root_text

INVENTORY_SCHEMA = "path STRING, size_bytes BIGINT, modified_ms BIGINT, is_symlink BOOLEAN, error STRING"
HASHED_SCHEMA = "path STRING, size_bytes BIGINT, modified_ms BIGINT, sha256 STRING, error STRING"

# Directories one task opens before it hands the rest of its subtree back to be spread again.
FIRST_ROUND_DIRS = 64
ROUND_DIRS = 4096

# Bytes one hashing task aims for, and paths one task takes.
TASK_BYTES = 1 << 30
TASK_PATHS = 50_000

# Bytes of a file in memory at a time; they are read into the same place again and again.
READ_BYTES = 1 << 20


def _path_tasks(spark: SparkSession, paths: int) -> int:
    """Tasks for file calls on ``paths`` paths: all cores, and more if there are many paths.

    The number is set outright because Spark would size tasks by the few bytes of a path and not
    by the time that the calls take.
    """
    return max(math.ceil(paths / TASK_PATHS), min(paths, spark.sparkContext.defaultParallelism), 1)


def _lister(budget: int):
    """Task function: list the subtrees of the given directories, at most ``budget`` directories."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from collections import deque

        import pandas as pd

        rows: list[tuple] = []
        full = 20_000
        files = Files()

        def table() -> pd.DataFrame:
            out = pd.DataFrame(rows, columns=["kind", "path", "is_symlink", "error"])
            rows.clear()
            return out

        def add(kind, path, is_symlink=False, error=None):
            rows.append((kind, path, is_symlink, error))

        opened = 0
        for batch in batches:
            waiting = deque(batch["path"])
            while waiting:
                folder = waiting.popleft()
                if opened >= budget:
                    add("dir", folder)
                else:
                    opened += 1
                    try:
                        for path, is_folder, is_link in files.of(folder).entries(folder):
                            if not is_folder:
                                add("file", path, is_link)
                            elif opened + len(waiting) < budget:
                                waiting.append(path)
                            else:
                                add("dir", path)
                            if len(rows) >= full:
                                yield table()
                    except NotADirectoryError:
                        add("file", folder)
                    except OSError as e:
                        add("error", folder, False, e.strerror or str(e))
                if len(rows) >= full:
                    yield table()
        yield table()

    return run


def _list_tree(
    spark: SparkSession, root: str, first_dirs: int, round_dirs: int, keep: str | None = None
) -> DataFrame:
    """All entries below ``root`` as kind, path, is_symlink, error.

    Tasks walk breadth-first. A task that has opened its share of directories returns the ones
    it has not opened, and the next round spreads those over all tasks; a subtree with a third of
    all directories is so shared out instead of walked by one task. A round has as many tasks as it
    takes to open all directories that wait, so none is handed back unopened, and the number of
    rounds follows the depth of the tree and not its size.

    With ``keep``, rounds are stored in that folder. What a finished round there has opened is not opened
    again: the walk goes on with the directories that the last one left.
    """
    slots = spark.sparkContext.defaultParallelism * 4
    schema = "kind STRING, path STRING, is_symlink BOOLEAN, error STRING"
    frontier = spark.createDataFrame([(root,)], "path STRING").coalesce(1)
    rounds, budget = [], first_dirs
    while True:
        path = f"{keep}/round-{len(rounds):04d}" if keep else workspace.scratch_path(spark, "walk")
        if not keep or not workspace.is_committed(spark, path):
            frontier.mapInPandas(_lister(budget), schema).write.mode("overwrite").parquet(path)
        rounds.append(path)
        left = spark.read.schema(schema).parquet(path).filter("kind = 'dir'").select("path")
        n = left.count()
        if n == 0:
            break
        # Dealt round robin, half of what a task may open: a hash of the path could give one task too many.
        frontier = left.repartition(max(min(n, slots), math.ceil(2 * n / round_dirs)))
        budget = round_dirs
    return spark.read.schema(schema).parquet(*rounds).filter("kind <> 'dir'")


def inventory(
    spark: SparkSession,
    root: str,
    extensions: Sequence[str] = DEFAULT_EXTENSIONS,
    first_dirs: int = FIRST_ROUND_DIRS,
    round_dirs: int = ROUND_DIRS,
    keep: str | None = None,
) -> DataFrame:
    """The supported files below ``root``, in schema INVENTORY_SCHEMA.

    Links are not followed while walking: a link counts as a file with its own length. Its time
    is that of its target, which is what hashing will read. What cannot be listed or read becomes
    a row with ``error``. Listing only reads names; the names are then spread evenly, so the file
    attributes of one huge directory are read by all tasks. ``keep`` names a folder for the rounds of the
    walk, so that one that broke off goes on after its last finished round.
    """
    listed = _list_tree(spark, root_text(root), first_dirs, round_dirs, keep)
    wanted = supported_files(listed.filter("kind = 'file'"), extensions).select("path", "is_symlink")
    broken = listed.filter("kind = 'error'").select(
        "path",
        F.lit(None).cast("bigint").alias("size_bytes"),
        F.lit(None).cast("bigint").alias("modified_ms"),
        "is_symlink",
        "error",
    )

    def attributes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pandas as pd

        files = Files()
        for batch in batches:
            rows = []
            for path, is_symlink in zip(batch["path"], batch["is_symlink"]):
                size = modified = error = None
                try:
                    size, modified, _ = files.of(path).attributes(path, follow=False)
                    if is_symlink:
                        modified = files.of(path).attributes(path).modified_ms
                except OSError as e:
                    if size is None:
                        error = e.strerror or str(e)
                    else:
                        # A link whose target cannot be reached still has a length, and time 0.
                        modified = 0
                rows.append((path, size, modified, is_symlink, error))
            out = pd.DataFrame(rows, columns=["path", "size_bytes", "modified_ms", "is_symlink", "error"])
            yield out.astype({"size_bytes": "Int64", "modified_ms": "Int64"})

    spread = wanted.repartition(_path_tasks(spark, wanted.count()), "path")
    return spread.mapInPandas(attributes, INVENTORY_SCHEMA).union(broken)


def stat_files(files: DataFrame, paths: int) -> DataFrame:
    """``files`` plus the present ``stat_bytes`` and ``stat_ms`` of each path; null if unreadable.

    Links are followed, as they are when content is read. ``paths`` is the number of rows.
    """
    added = [T.StructField("stat_bytes", T.LongType()), T.StructField("stat_ms", T.LongType())]
    schema = T.StructType(files.schema.fields + added)

    def attributes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pandas as pd

        files = Files()
        for batch in batches:
            sizes, times = [], []
            for path in batch["path"]:
                try:
                    now = files.of(path).attributes(path)
                    sizes.append(now.size)
                    times.append(now.modified_ms)
                except OSError:
                    sizes.append(None)
                    times.append(None)
            yield batch.assign(
                stat_bytes=pd.array(sizes, dtype="Int64"), stat_ms=pd.array(times, dtype="Int64")
            )

    spread = files.repartition(_path_tasks(files.sparkSession, paths), "path")
    return spread.mapInPandas(attributes, schema)


def deal_by_bytes(files: DataFrame, task_bytes: int = TASK_BYTES) -> DataFrame:
    """Spread ``files`` over tasks of about equal bytes, for reading their content.

    Files of at least ``task_bytes`` get a task each, largest first so that they start first. The
    rest are dealt by path over as many tasks as their bytes need. ``files`` is read three times,
    so pass a stored table.
    """
    size = F.coalesce(F.col("size_bytes"), F.lit(0))
    large, small = size >= task_bytes, size < task_bytes
    totals = files.agg(
        F.count_if(large).alias("large"),
        F.count_if(small).alias("small"),
        F.coalesce(F.sum(F.when(small, size)), F.lit(0)).alias("small_bytes"),
    ).first()
    parts = []
    if totals.large:
        parts.append(files.filter(large).repartitionByRange(totals.large, size.desc(), F.col("path")))
    if totals.small or not parts:
        tasks = max(math.ceil(totals.small_bytes / task_bytes), _path_tasks(files.sparkSession, totals.small))
        parts.append(files.filter(small).repartition(tasks, "path"))
    return parts[0] if len(parts) == 1 else parts[0].union(parts[1])


def hash_files(files: DataFrame) -> DataFrame:
    """SHA-256 of each path's whole content, in schema HASHED_SCHEMA.

    Content is read in pieces, so memory does not depend on file size. A file that cannot be
    read, or is not a regular file, gets ``error`` and no digest.
    """

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        files, buffer = Files(), bytearray(READ_BYTES)
        view = memoryview(buffer)
        for batch in batches:
            digests, errors = [], []
            for path in batch["path"]:
                found = error = None
                try:
                    content = files.of(path).open_regular(path)
                    if content is None:
                        error = "not a regular file"
                    else:
                        sha = hashlib.sha256()
                        with content:
                            while n := content.readinto(buffer):
                                sha.update(view[:n])
                        found = sha.hexdigest()
                except OSError as e:
                    error = e.strerror or str(e)
                digests.append(found)
                errors.append(error)
            yield batch.assign(sha256=digests, error=errors)[
                ["path", "size_bytes", "modified_ms", "sha256", "error"]
            ]

    return files.select("path", "size_bytes", "modified_ms").mapInPandas(digest, HASHED_SCHEMA)
