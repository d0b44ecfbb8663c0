"""Runs over tables with a content column that hash only what an earlier run has not.

The content is read once, as sizes need it, and never shuffled. Whether a row may be in the cache is asked of a bit
map during that scan, so rows that cannot be hits are hashed there and then, and rows that may be are not. The
narrow rows of the latter are joined with the cache. A few of them turn out not to be in it; only if there are
any, the content is scanned again and those are hashed.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import workspace
from ..functions.scalars import DEFAULT_EXTENSIONS
from .bit_map import MAP_BITS, mark_members
from .candidates import supported_files

KEY = ["path", "modified_ms"]


def _sha256(content: Column) -> Column:
    return F.sha2(content, 256)


def incremental_fingerprints(
    files: DataFrame,
    cache: DataFrame,
    extensions: Sequence[str] = DEFAULT_EXTENSIONS,
    bits: int = MAP_BITS,
    digest: Callable[[Column], Column] = _sha256,
) -> DataFrame:
    """path, size_bytes, modified_ms, sha256, cache_hit of the supported ``files`` (path, content, modified_ms).

    A hit has the path and time of an entry of ``cache`` (path, modified_ms, sha256), and its digest. ``cache`` is
    read repeatedly, so pass a stored one; the result reads stored tables only. Paths must be unique in both.
    Rows without a path or time are no hits.
    """
    known = cache.filter("path IS NOT NULL AND modified_ms IS NOT NULL").select(*KEY, F.col("sha256").alias("_cached"))
    rows = supported_files(files, extensions).select("path", "content", "modified_ms")
    asked = mark_members(rows, known, KEY, bits)
    asked = asked.withColumn("_marked", F.col("_marked") & F.col("modified_ms").isNotNull())
    scanned = workspace.snapshot(
        asked.select(
            "path",
            F.octet_length("content").cast("bigint").alias("size_bytes"),
            "modified_ms",
            F.when(~F.col("_marked"), digest(F.col("content"))).alias("sha256"),
            F.col("_marked").alias("_maybe"),
        ),
        "scanned",
    )
    looked_up = scanned.filter("_maybe").join(known, KEY, "left")
    looked_up = looked_up.withColumn("cache_hit", F.col("_cached").isNotNull()).withColumn("sha256", F.col("_cached"))
    looked_up = workspace.snapshot(looked_up.select("path", "size_bytes", "modified_ms", "sha256", "cache_hit"), "looked-up")
    fresh = scanned.filter("NOT _maybe").select(
        "path", "size_bytes", "modified_ms", "sha256", F.lit(False).alias("cache_hit")
    )
    result = fresh.unionByName(looked_up.filter("cache_hit"))
    missed = looked_up.filter("NOT cache_hit").drop("sha256", "cache_hit")
    if missed.isEmpty():
        return result
    # The map of so few rows is all but empty, so hardly another row is hashed with them.
    again = mark_members(rows, missed, KEY, bits, seed=1).filter("_marked")
    hashed = again.select("path", "modified_ms", digest(F.col("content")).alias("sha256"))
    late = missed.join(workspace.snapshot(hashed, "hashed-late"), KEY)
    return result.unionByName(late.withColumn("cache_hit", F.lit(False)))
