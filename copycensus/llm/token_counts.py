"""Token counts of documents in flat token files, by a scan for separators.

A flat token file is a plain run of little-endian ids of a fixed width; each document ends with the
end-of-document id, and there is no index.

1. ``write_token_files`` encodes documents into such files, one per task, in a folder that all
   executors reach. A file's name is new for every attempt at a task, and only the files of attempts
   that succeeded are listed in the result.
2. ``scan_token_files`` cuts files into blocks of a fixed number of bytes. Each task reads a block and
   finds its separators in one vectorised search. Per block that gives the lengths of the documents
   that end in it, and what is left open at its end.
3. A prefix scan over the blocks of each file carries the number of documents before a block, and the
   open tokens of the blocks since the last separator, so documents that cross any number of blocks
   are counted whole.

Defined results: a null or empty text has 0 tokens. Rows that repeat a doc_id are counted each. Rows
without doc_id are counted and keep their null. Tokens after the last separator of a file are a document
with ``complete`` false. An empty file has no documents, an empty table gives no rows. Further columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from copycensus import workspace
from copycensus.llm.common import table, text_or_empty
from copycensus.llm.tokens import encoder

END_OF_DOCUMENT = 50256
WIDTH = 2
BLOCK_BYTES = 8 << 20


def _kind(width: int) -> str:
    return {2: "<u2", 4: "<u4"}[width]


def write_token_files(
    docs: DataFrame, folder: str, end: int = END_OF_DOCUMENT, width: int = WIDTH, vocabulary: str | None = None
) -> DataFrame:
    """Writes the files below ``folder`` (a URI); returns file, ordinal, doc_id, stored."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyarrow import fs

        encode = encoder(vocabulary, special=False)
        system, place = fs.FileSystem.from_uri(folder)
        system.create_dir(place, recursive=True)
        name, out, ordinal = f"{uuid.uuid4().hex}.tokens", None, 0
        try:
            for batch in batches:
                if not batch.num_rows:
                    continue
                out = out or system.open_output_stream(f"{place}/{name}", compression=None)
                for text in batch.column(1):
                    out.write(np.array([*encode(text.as_py()), end], _kind(width)).tobytes())
                n = batch.num_rows
                columns = [pa.array([name] * n), pa.array(np.arange(ordinal, ordinal + n)), batch.column(0)]
                yield pa.RecordBatch.from_arrays(columns, names=["file", "ordinal", "doc_id"])
                ordinal += n
        finally:
            if out:
                out.close()

    texts = docs.select(F.col("doc_id").cast("bigint"), text_or_empty("text"))
    return workspace.snapshot(texts.mapInArrow(write, "file STRING, ordinal BIGINT, doc_id BIGINT"), "ordinals")


def _blocks(files: DataFrame, folder: str, block_bytes: int) -> DataFrame:
    """file, bytes, block, start, spread over all tasks."""

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, place = fs.FileSystem.from_uri(folder)
        for batch in batches:
            names = batch.column(0).to_pylist()
            found = [x.size for x in system.get_file_info([f"{place}/{n}" for n in names])] if names else []
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], names=["file", "bytes"])

    sized = files.select("file").mapInArrow(sizes, "file STRING, bytes BIGINT").filter("bytes > 0")
    cut = sized.selectExpr("file", "bytes", f"posexplode(sequence(0L, bytes - 1, {block_bytes}L)) AS (block, start)")
    return cut.repartition(F.xxhash64("file", "block"))


def scan_token_files(
    files: DataFrame, folder: str, end: int = END_OF_DOCUMENT, width: int = WIDTH, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """file, ordinal, n_tokens, complete of every document in the files (a column file, below ``folder``)."""
    if block_bytes % width:
        raise ValueError("a block must hold whole ids")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, place = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with system.open_input_file(f"{place}/{row['file']}") as f:
                    f.seek(row["start"])
                    data = f.read(min(block_bytes, row["bytes"] - row["start"]))
                ids = np.frombuffer(data, _kind(width))
                ends = np.flatnonzero(ids == end)
                lengths = np.diff(ends, prepend=-1) - 1
                left = len(ids) - 1 - ends[-1] if len(ends) else len(ids)
                last = row["start"] + len(data) == row["bytes"]
                yield pa.RecordBatch.from_pylist(
                    [{"file": row["file"], "block": row["block"], "lengths": lengths.tolist(), "left": int(left), "last": last}],
                    schema=pa.schema(
                        [("file", pa.string()), ("block", pa.int32()), ("lengths", pa.list_(pa.int64())), ("left", pa.int64()), ("last", pa.bool_())]
                    ),
                )

    schema = "file STRING, block INT, lengths ARRAY<BIGINT>, left BIGINT, last BOOLEAN"
    found = workspace.snapshot(_blocks(files, folder, block_bytes).mapInArrow(scan, schema), "separators")
    # The scan runs over two numbers per block; lengths are joined to its results.
    per_block = found.select("file", "block", F.size("lengths").alias("n"), "left")
    in_file = Window.partitionBy("file").orderBy("block")
    before = in_file.rowsBetween(Window.unboundedPreceding, -1)
    counted = per_block.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)))
    # Blocks up to and with the next separator are one segment; what they leave open adds up.
    counted = counted.withColumn("segment", F.coalesce(F.sum((F.col("n") > 0).cast("int")).over(before), F.lit(0)))
    in_segment = Window.partitionBy("file", "segment").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    opened = F.coalesce(F.sum(F.when(F.col("n") == 0, F.col("left")).otherwise(0)).over(in_segment), F.lit(0))
    last_left = F.last(F.when(F.col("n") > 0, F.col("left")), ignorenulls=True).over(before)
    carried = counted.withColumn("carry", opened + F.coalesce(last_left, F.lit(0)))
    joined = found.join(carried.select("file", "block", "first", "carry"), ["file", "block"])
    done = joined.select("file", "first", "carry", F.posexplode("lengths").alias("k", "length"))
    done = done.select(
        "file",
        (F.col("first") + F.col("k")).alias("ordinal"),
        (F.col("length") + F.when(F.col("k") == 0, F.col("carry")).otherwise(0)).alias("n_tokens"),
        F.lit(True).alias("complete"),
    )
    n = F.size("lengths")
    rest = F.col("left") + F.when(n == 0, F.col("carry")).otherwise(0)
    open_end = joined.filter("last").filter(rest > 0)
    open_end = open_end.select("file", (F.col("first") + n).alias("ordinal"), rest.alias("n_tokens"), F.lit(False).alias("complete"))
    return done.union(open_end)


def count_tokens(docs: DataFrame, folder: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, file, ordinal, n_tokens of every document, through token files below ``folder``."""
    ordinals = write_token_files(docs, folder)
    counts = scan_token_files(ordinals.select("file").distinct(), folder, block_bytes=block_bytes)
    return ordinals.join(counts, ["file", "ordinal"]).select("doc_id", "file", "ordinal", "n_tokens")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = workspace.scratch_path(spark, "token-files")
    return count_tokens(table(spark, sf_dir, "documents"), folder)
