"""Helpers that the operators of this package share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BITS_IN_CELL = 32768  # fixed by bitmap_construct_agg: one cell is 4096 bytes


#: Rows sent to Python at a time. With Spark's own number a batch of long texts takes a hundred megabytes on
#: both sides of every task.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Send texts to Python in batches of at most ``BATCH_ROWS`` rows from now on, in this session."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of texts, to be sent to Python in small batches."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def likely_members(
    wide: DataFrame, key: Column, wanted: DataFrame, wanted_key: Column, bits: int = 26, others: bool = False
) -> DataFrame:
    """The rows of ``wide`` whose key may be among the wanted keys, without shuffling ``wide``.

    The wanted keys set bits of a map of ``2 ** bits`` bits, which is all that is broadcast (8 MB for
    26), whatever their number. Every row with a wanted key passes; some others do too, the more the
    fuller the map, so callers must not rely on their absence. ``others=True`` gives the rest of the rows
    instead, those with a null key included.
    """
    slot = lambda of: F.pmod(F.xxhash64(of), F.lit(1 << bits))
    cells = (
        wanted.filter(wanted_key.isNotNull())
        .select(slot(wanted_key).alias("_slot"))
        .groupBy(F.floor(F.col("_slot") / BITS_IN_CELL).alias("_cell"))
        .agg(F.bitmap_construct_agg(F.col("_slot") % BITS_IN_CELL).alias("_map"))
    )
    place = F.col("_slot") % BITS_IN_CELL
    byte = F.conv(F.hex(F.substr("_map", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    marked = F.getbit(byte, (place % 8).cast("int")) == 1
    found = wide.withColumn("_slot", F.when(key.isNotNull(), slot(key)))
    found = found.withColumn("_cell", F.floor(F.col("_slot") / BITS_IN_CELL))
    if others:
        found = found.join(F.broadcast(cells), "_cell", "left").filter(~F.coalesce(marked, F.lit(False)))
    else:
        found = found.join(F.broadcast(cells), "_cell").filter(marked)
    return found.select(*wide.columns)


def node_id(docs: DataFrame) -> tuple[Column, str]:
    """The doc_id of a table and its type: a row key (``row_key``) as it is, anything else as BIGINT."""
    if dict(docs.dtypes)["doc_id"] == "binary":
        return F.col("doc_id"), "BINARY"
    return F.col("doc_id").cast("bigint"), "BIGINT"


def key_of(sha256: Column) -> Column:
    """Binary keys that tell rows apart by doc_id and the SHA-256 (hex) of a text. They are in the order of
    doc_id; those of rows without doc_id come last."""
    doc_id = F.col("doc_id").cast("bigint")
    ordered = F.unhex(F.lpad(F.hex(doc_id.bitwiseXOR(F.lit(-(1 << 63)))), 16, "0"))
    head = F.when(doc_id.isNull(), F.unhex(F.lit("01"))).otherwise(F.concat(F.unhex(F.lit("00")), ordered))
    return F.concat(head, F.unhex(sha256))


def row_key() -> Column:
    return key_of(F.sha2(text_or_empty("text"), 256))


def ids_tell_rows(docs: DataFrame) -> bool:
    """Every row has a doc_id, and no other row has it."""
    rows = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    return rows.filter("n > 1 OR doc_id IS NULL").isEmpty()


def keyed(docs: DataFrame) -> DataFrame:
    """The rows with their keys in place of doc_id."""
    return docs.withColumn("doc_id", row_key())


def worker_memory() -> dict:
    """What this Python process keeps between tasks, such as a loaded tokenizer."""
    import sys
    import types

    return sys.modules.setdefault("_copycensus_memory", types.ModuleType("_copycensus_memory")).__dict__


def without_documents(docs: DataFrame, ids: DataFrame, bits: int = 26) -> DataFrame:
    """The rows of ``docs`` whose doc_id is not among ``ids`` (a column doc_id); null ids stay.

    Rows that cannot be among them pass by a bit map and are never shuffled; only the others, mostly
    the rows to drop, go through an exact join.
    """
    key, names = F.col("doc_id"), docs.columns
    safe = likely_members(docs, key, ids, key, bits, others=True)
    unsure = likely_members(docs, key, ids, key, bits).join(ids.distinct(), "doc_id", "left_anti")
    return safe.select(*names).unionByName(unsure.select(*names))


def without_rows(docs: DataFrame, keys: DataFrame, bits: int = 26) -> DataFrame:
    """As ``without_documents``, for rows whose key (``row_key``) is among ``keys`` (a column doc_id)."""
    key, names = F.col("_row"), docs.columns
    rows = docs.withColumn("_row", row_key())
    safe = likely_members(rows, key, keys, F.col("doc_id"), bits, others=True)
    gone = keys.select(F.col("doc_id").alias("_row")).distinct()
    unsure = likely_members(rows, key, keys, F.col("doc_id"), bits).join(gone, "_row", "left_anti")
    return safe.select(*names).unionByName(unsure.select(*names))
