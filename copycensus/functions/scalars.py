"""Column expressions over named columns. All are built-in Spark functions, so they stay in generated code."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The suffixes scanned when none are given.
DEFAULT_EXTENSIONS = (
    ".vcf", ".vcf.gz", ".g.vcf", ".g.vcf.gz",
    ".bam", ".fastq", ".fastq.gz", ".txt",
)

# Size units, largest first.
SIZE_UNITS = (
    ("TB", 1 << 40),
    ("GB", 1 << 30),
    ("MB", 1 << 20),
    ("KB", 1 << 10),
)


def parse_extensions(text: str) -> list[str]:
    """Split a comma list of suffixes. Nothing is trimmed; empty entries at the end are dropped."""
    parts = text.split(",")
    while len(parts) > 1 and parts[-1] == "":
        parts.pop()
    return parts


def file_name(path: str) -> Column:
    return F.substring_index(path, "/", -1)


def is_supported(path: str, extensions: Sequence[str] = DEFAULT_EXTENSIONS) -> Column:
    """True if the lower-cased file name ends in any suffix.

    The suffixes are taken as given: ``.VCF`` matches nothing and an empty one matches every file.
    """
    if not extensions:
        return F.lit(False)
    # One pattern, so the name is worked out once per row and not once per suffix.
    suffixes = "|".join(re.escape(e) for e in extensions)
    return F.lower(file_name(path)).rlike(f"(?:{suffixes})\\z")


def _quoted(name: str) -> str:
    """A column name as it stands in SQL text."""
    return "`" + name.replace("`", "``") + "`"


def short_hash(sha256: str) -> Column:
    return F.expr(f"concat(substring({_quoted(sha256)}, 1, 12), '...')")


def human_size(n: str) -> Column:
    """1024-based size with one decimal; the unit is picked before rounding."""
    n = _quoted(n)
    cases = " ".join(
        f"WHEN {n} >= {scale} THEN format_string('%.1f {unit}', {n} / {scale}D)" for unit, scale in SIZE_UNITS
    )
    return F.expr(f"CASE {cases} ELSE concat({n}, ' B') END")


def top_level_dir(path: str, root: str) -> Column:
    """First directory below ``root``; empty for a file directly in it, ``..`` for one outside it."""
    prefix = root.rstrip("/") + "/"
    below = F.substr(path, F.lit(len(prefix) + 1))
    return (
        F.when(~F.startswith(path, F.lit(prefix)), F.lit(".."))
        .when(F.instr(below, "/") > 0, F.substring_index(below, "/", 1))
        .otherwise(F.lit(""))
    )


def last_modified_utc(modified_ms: str) -> Column:
    """Epoch milliseconds as ``yyyy-MM-ddTHH:mm:ssZ``, or ``unknown``.

    A zone-free timestamp is used, so the session time zone plays no part.
    """
    seconds = f"CAST(floor({_quoted(modified_ms)} / 1000) AS DECIMAL(18, 6))"
    at = f"timestamp_ntz'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, {seconds})"
    return F.expr(f"coalesce(concat(replace(CAST({at} AS STRING), ' ', 'T'), 'Z'), 'unknown')")
