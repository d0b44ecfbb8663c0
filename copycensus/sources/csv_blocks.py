"""Records of CSV files of any size, read by as many tasks as there are blocks.

A quoted cell may hold line breaks, so a task that starts in the middle of a file cannot tell whether a line
break ends a record. The number of quotes before it can: if it is odd, the break is inside a cell. A doubled
quote counts twice and so changes nothing.

1. Spark cuts the files into blocks of whole lines. One pass counts the quotes of each block.
2. A running sum over the blocks of each file tells whether a block begins inside a cell.
3. A second pass puts the lines of each block together to records. What a block ends with inside a cell, and
   what it begins with, are parts of records; parts are put together over all blocks they cross.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PART_SCHEMA = "file STRING, block BIGINT, place INT, header BOOLEAN, record BINARY"

# Places of the parts of a record within a block: what closes a record comes before what opens the next one.
CLOSES, OPENS = 0, 1


class _Block:
    """The lines of one block that have been seen so far."""

    def __init__(self, file: str, block: int, inside: bool) -> None:
        self.file, self.block, self.inside = file, block, inside
        self.first = block == 0
        self.opened_here = self.header = False
        self.pending: list[bytes] = []

    def part(self, header: bool, place: int | None, record: bytes) -> tuple:
        return self.file, self.block, place, header, record

    def add(self, lines: pa.Array) -> Iterator[tuple | pa.Array]:
        """Whole records as arrays, others one by one."""
        import numpy as np
        import pyarrow.compute as pc

        quotes = pc.count_substring(lines, b'"').to_numpy(zero_copy_only=False)
        after = (np.cumsum(quotes) + self.inside) % 2 == 1
        before = np.concatenate([[self.inside], after[:-1]])
        whole = ~before & ~after
        if self.first and whole[0]:
            whole[0] = False
            self.first = False
            odd = np.flatnonzero(before | after)
        else:
            odd = np.flatnonzero(~whole)
        yield lines.filter(pa.array(whole))
        for k in odd.tolist():
            if not before[k]:
                self.opened_here, self.header, self.first = True, self.first, False
            self.pending.append(lines[k].as_py())
            if not after[k]:
                place = None if self.opened_here else CLOSES
                yield self.part(self.header, place, b"\n".join(self.pending))
                self.pending, self.opened_here, self.header = [], False, False
        self.first = False
        self.inside = bool(after[-1])

    def end(self) -> Iterator[tuple]:
        if self.pending:
            yield self.part(self.header, OPENS if self.opened_here else CLOSES, b"\n".join(self.pending))


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records and parts of records from lines (file, block, inside, line) in the order of the files."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    kinds = [("file", pa.string()), ("block", pa.int64()), ("place", pa.int32()), ("header", pa.bool_())]
    schema = pa.schema([*kinds, ("record", pa.binary())])

    def batch_of(found: list) -> Iterator[pa.RecordBatch]:
        rows = [x for x in found if isinstance(x, tuple)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
        for lines in found:
            if not isinstance(lines, tuple) and len(lines):
                none = [pa.nulls(len(lines), f.type) for f in schema][:4]
                yield pa.RecordBatch.from_arrays([*none, lines.cast(pa.binary())], schema=schema)

    current = None
    for batch in batches:
        if not batch.num_rows:
            continue
        files, blocks, inside, lines = batch.columns
        changes = pc.or_(pc.not_equal(files[1:], files[:-1]), pc.not_equal(blocks[1:], blocks[:-1]))
        cuts = [0, *(np.flatnonzero(changes.to_numpy(zero_copy_only=False)) + 1).tolist(), batch.num_rows]
        for low, high in zip(cuts, cuts[1:]):
            file, block = files[low].as_py(), blocks[low].as_py()
            if current is None or (current.file, current.block) != (file, block):
                if current is not None:
                    yield from batch_of([*current.end()])
                current = _Block(file, block, inside[low].as_py())
            yield from batch_of([*current.add(lines[low:high])])
    if current is not None:
        yield from batch_of([*current.end()])


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """file, block and line of the files at ``path``, in order within a block."""
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("value").alias("line"),
    )


def _quotes() -> Column:
    return F.octet_length("line") - F.octet_length(F.replace("line", F.lit('"'), F.lit("")))


def lines_are_records(spark: SparkSession, path: str) -> bool:
    """Whether every line is a record: no cell is open at the end of one, and no carriage return is anywhere. Then
    Spark's own reader cuts files into blocks."""
    odd = (_quotes() % 2 == 1) | F.contains("line", F.lit("\r"))
    return not _lines(spark, path).agg(F.max(odd)).first()[0]


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One column ``record``: the records of the CSV files at ``path``, without the first one of each file.

    A record ends at a line feed, or carriage return and line feed, outside quotes. Quotes that do not pair
    up in a file are an error, as nothing could tell where its records end. ``spark.sql.files.maxPartitionBytes``
    sets the size of a block.
    """
    lines = _lines(spark, path)
    counted = lines.groupBy("file", "block").agg(F.sum(_quotes()).alias("quotes"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1
    last = F.lead("block").over(Window.partitionBy("file").orderBy("block")).isNull()
    ends_inside = ((F.col("quotes") + inside.cast("int")) % 2 == 1).alias("ends_inside")
    blocks = counted.select("file", "block", inside.alias("inside"), ends_inside, last.alias("last"))
    # At most the blocks at whose borders a cell is open; the report's other blocks are of no concern.
    cut = blocks.filter("inside OR ends_inside").collect()
    for r in cut:
        if r.last and r.ends_inside:
            raise ValueError(f"the quotes in {r.file} do not pair up")
    schema = "file STRING, block BIGINT, inside BOOLEAN"
    known = F.broadcast(spark.createDataFrame([(r.file, r.block, r.inside) for r in cut], schema))
    binary = F.col("line").cast("binary").alias("line")

    # Spark keeps the rows of a scan in order through a broadcast join.
    placed = lines.join(known, ["file", "block"], "left") if cut else lines.withColumn("inside", F.lit(False))
    placed = placed.select("file", "block", F.coalesce("inside", F.lit(False)).alias("inside"), binary)
    whole = placed.mapInArrow(_records, PART_SCHEMA)
    records = whole.filter("place IS NULL AND NOT coalesce(header, false)").select("record")
    if cut:
        # Only blocks with a part of a record are read again.
        again = lines.join(known, ["file", "block"]).select("file", "block", "inside", binary)
        pieces = again.mapInArrow(_records, PART_SCHEMA).filter("place IS NOT NULL")
        in_order = Window.partitionBy("file").orderBy("block", "place").rowsBetween(Window.unboundedPreceding, 0)
        pieces = pieces.withColumn("number", F.sum((F.col("place") == OPENS).cast("int")).over(in_order))
        joined = pieces.groupBy("file", "number").agg(
            F.max("header").alias("header"),
            F.array_sort(F.collect_list(F.struct("block", "place", F.col("record").cast("string").alias("text")))).alias("p"),
        )
        joined = joined.filter("NOT header").select(F.array_join("p.text", "\n").cast("binary").alias("record"))
        records = records.union(joined)
    text = F.col("record").cast("string")
    ended = F.when(F.endswith(text, F.lit("\r")), F.left(text, F.length(text) - 1)).otherwise(text)
    return records.select(ended.alias("record"))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
