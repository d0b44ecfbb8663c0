"""Tables with a content column: one row is one file."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import DEFAULT_EXTENSIONS
from ..operators.candidates import supported_files


def table_fingerprints(files: DataFrame, extensions: Sequence[str] = DEFAULT_EXTENSIONS) -> DataFrame:
    """Fingerprint the supported rows of ``files`` (path, content, modified_ms).

    Size and digest come out of the same pass over the content, which then goes no further: only
    the narrow result is ever shuffled. Pruning by size first would read every content just to
    learn its size and read it again to hash it; equal digests mean equal sizes, so the groups
    are the same without it.
    """
    return supported_files(files, extensions).select(
        "path",
        F.octet_length("content").cast("bigint").alias("size_bytes"),
        "modified_ms",
        F.sha2(F.col("content"), 256).alias("sha256"),
    )
