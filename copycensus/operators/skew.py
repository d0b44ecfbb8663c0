"""Equi-join that stays balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A key is cut into pieces once it holds more than 1/MAX_PIECES of the rows and more than
# HOT_ROWS rows. So at most MAX_PIECES keys are hot, and that bounds what is broadcast.
MAX_PIECES = 4096
HOT_ROWS = 1_000_000


def join_counted(
    rows: DataFrame,
    keyed: DataFrame,
    key: str,
    count: str,
    spread: Column,
    how: str = "inner",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Join ``rows`` to ``keyed`` on ``key``.

    ``keyed`` has one row per key, and ``count`` says how many of ``rows`` carry that key. Each hot
    key is split into pieces: its rows are dealt over them by a hash of ``spread`` and its one
    row in ``keyed`` is repeated per piece, which adds at most 2 * MAX_PIECES rows. ``keyed`` is
    read three times, so pass a stored table or a plain aggregate, whose shuffle Spark reuses.
    """
    total = keyed.agg(F.sum(count).alias("total")).scalar()
    piece_rows = F.greatest(F.lit(hot_rows), F.ceil(total / F.lit(MAX_PIECES)))
    pieces = keyed.withColumn("_pieces", F.ceil(F.col(count) / piece_rows).cast("int"))
    hot = pieces.filter("_pieces > 1").select(key, "_pieces")

    piece = F.coalesce(F.pmod(F.xxhash64(spread), F.col("_pieces")).cast("int"), F.lit(0))
    dealt = rows.join(F.broadcast(hot), key, "left").select(*rows.columns, piece.alias("_piece"))
    repeated = pieces.select(*keyed.columns, F.expr("explode(sequence(0, _pieces - 1)) AS _piece"))
    return dealt.join(repeated, [key, "_piece"], how).drop("_piece")
