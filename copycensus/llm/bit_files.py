"""Token ids in binary files of fixed-width bits.

Every id takes the least number of bits that the vocabulary needs. A file is a run of blocks, then a
directory with the place of each block and a footer::

    block      doc_id (int64) of each document that starts in it, its first id's place in the block
               (uint32), whether it has a doc_id (uint8); then the ids, packed, least bit first
    directory  for each block the byte where it starts, documents before it, ids before it (uint64);
               once more for the end
    footer     magic, bits, ids in a full block, ids, documents, blocks, place of the directory

Ids have one width, so the place of any id follows from its number: a range of ids is read and unpacked
without what stands before it, and numpy unpacks a block at once. The end of a document is told by the next
one's start, so any id may occur inside texts, the end-of-document id too.

``write_bit_files`` deals documents by ranges of doc_id and writes one file per task, under a new name for
every attempt; only files of attempts that succeeded are listed, in order. ``read_bit_files`` deals ranges
of blocks over all tasks; a document belongs to the task with the block in which it starts, and is read to
its end.

Defined results: a null or empty text is its end id alone. Rows without doc_id come last and keep their
null. Rows that repeat a doc_id are documents of their own, next to each other in the order of a hash of
their texts; equal rows are dealt over several files if need be. Very long texts are encoded in pieces and
cross any number of blocks; a task holds the ids of one document. An empty table gives no files and no
rows. Further columns are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from copycensus import workspace
from copycensus.llm.common import table, text_or_empty
from copycensus.llm.word_tokens import word_encoder

END_OF_DOCUMENT = 1
BLOCK_IDS = 1 << 16
#: Blocks that one task reads.
TASK_BLOCKS = 64

MAGIC = b"CCBITS01"
_FOOTER = "<8sIIQQQQ"


def bits_for(vocabulary: int) -> int:
    """Bits that the ids below ``vocabulary`` need."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """The ids in ``bits`` bits each, least bit first, padded to a whole byte."""
    ids = np.ascontiguousarray(ids, "<u4")
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"an id needs more than {bits} bits")
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    each = np.unpackbits(ids.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
    return np.packbits(each[:, :bits], bitorder="little").tobytes()


def unpack(data: bytes, bits: int, first: int, n: int) -> np.ndarray:
    """``n`` ids from ``data``, the first one at bit ``first``."""
    if bits in (8, 16, 32) and first % 8 == 0:
        return np.frombuffer(data, f"<u{bits // 8}", n, first // 8).astype("<u4")
    # Each id lies within the eight bytes from the byte of its first bit on.
    padded = np.frombuffer(data + bytes(8), np.uint8)
    words = np.ndarray(len(padded) - 7, "<u8", padded.data, strides=(1,))
    at = first + bits * np.arange(n, dtype=np.int64)
    return ((words[at >> 3] >> (at & 7).astype("<u8")) & np.uint64((1 << bits) - 1)).astype("<u4")


class BitFileWriter:
    """Writes documents one after another to an open stream."""

    def __init__(self, out, bits: int, block_ids: int = BLOCK_IDS) -> None:
        self.out, self.bits, self.block_ids = out, bits, block_ids
        self.place = self.docs = self.ids = 0
        self.directory: list[tuple[int, int, int]] = []
        self._new_block()

    def _new_block(self) -> None:
        self.doc_ids, self.starts, self.known, self.parts, self.filled = [], [], [], [], 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id or 0)
        self.starts.append(self.filled)
        self.known.append(doc_id is not None)
        while len(ids):
            part, ids = ids[: self.block_ids - self.filled], ids[self.block_ids - self.filled :]
            self.parts.append(part)
            self.filled += len(part)
            if self.filled == self.block_ids:
                self._write_block()
        if len(self.doc_ids) >= self.block_ids:
            self._write_block()

    def _write_block(self) -> None:
        ids = np.concatenate(self.parts) if self.parts else np.empty(0, "<u4")
        head = (np.array(self.doc_ids, "<i8"), np.array(self.starts, "<u4"), np.array(self.known, "u1"))
        data = b"".join([*(x.tobytes() for x in head), pack(ids, self.bits)])
        self.out.write(data)
        self.directory.append((self.place, self.docs, self.ids))
        self.place += len(data)
        self.docs += len(self.doc_ids)
        self.ids += len(ids)
        self._new_block()

    def finish(self) -> None:
        """Writes what is left, the directory and the footer; the stream stays open."""
        if self.doc_ids or self.filled:
            self._write_block()
        blocks, place = len(self.directory), self.place
        self.directory.append((self.place, self.docs, self.ids))
        self.out.write(np.array(self.directory, "<u8").tobytes())
        self.out.write(struct.pack(_FOOTER, MAGIC, self.bits, self.block_ids, self.ids, self.docs, blocks, place))


class BitFile:
    """A file of packed ids behind an open random-access stream. Only what is asked for is read."""

    def __init__(self, source) -> None:
        self.source = source
        size = source.size()
        n = struct.calcsize(_FOOTER)
        footer = self._read(size - n, n) if size >= n else b""
        if footer[:8] != MAGIC:
            raise ValueError("not a file of packed ids")
        _, self.bits, self.block_ids, self.n_ids, self.n_docs, self.n_blocks, place = struct.unpack(_FOOTER, footer)
        entries = np.frombuffer(self._read(place, 24 * (self.n_blocks + 1)), "<u8").astype(np.int64)
        self.places, self.docs_before, self.ids_before = entries.reshape(-1, 3).T

    def _read(self, place: int, n: int) -> bytes:
        self.source.seek(place)
        return self.source.read(n)

    def _heads(self, block: int) -> int:
        return int(self.docs_before[block + 1] - self.docs_before[block])

    def head(self, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """doc_id, number of the first id in the file, and whether there is a doc_id, of what starts in a block."""
        n = self._heads(block)
        data = self._read(int(self.places[block]), 13 * n)
        doc_ids, starts = np.frombuffer(data, "<i8", n), np.frombuffer(data, "<u4", n, 8 * n)
        return doc_ids, starts + self.ids_before[block], np.frombuffer(data, "u1", n, 12 * n) > 0

    def ids(self, start: int, stop: int) -> np.ndarray:
        """The ids with the numbers from ``start`` up to ``stop``."""
        start, stop = max(0, start), min(stop, self.n_ids)
        found = []
        block = int(np.searchsorted(self.ids_before, start, "right")) - 1
        while start < stop:
            first, end = int(self.ids_before[block]), int(self.ids_before[block + 1])
            n = min(stop, end) - start
            if n > 0:
                bit = (start - first) * self.bits
                place = int(self.places[block]) + 13 * self._heads(block) + bit // 8
                data = self._read(place, (bit % 8 + n * self.bits + 7) // 8)
                found.append(unpack(data, self.bits, bit % 8, n))
                start += n
            block += 1
        return np.concatenate(found) if found else np.empty(0, "<u4")

    def document(self, ordinal: int) -> tuple[int | None, np.ndarray]:
        """doc_id and ids of the document with this number in the file."""
        if not 0 <= ordinal < self.n_docs:
            raise IndexError(ordinal)
        block = int(np.searchsorted(self.docs_before, ordinal, "right")) - 1
        doc_ids, starts, known = self.head(block)
        k = ordinal - int(self.docs_before[block])
        stop = int(starts[k + 1]) if k + 1 < len(starts) else self._next_start(block + 1)
        return (int(doc_ids[k]) if known[k] else None), self.ids(int(starts[k]), stop)

    def _next_start(self, block: int) -> int:
        while block < self.n_blocks:
            if self._heads(block):
                return int(self.head(block)[1][0])
            block += 1
        return self.n_ids

    def documents(self, first: int, last: int) -> Iterator[tuple[int, int | None, int, np.ndarray]]:
        """Ordinal, doc_id, start and ids of the documents that start in the blocks from ``first`` up to ``last``."""
        for block in range(first, min(last, self.n_blocks)):
            doc_ids, starts, known = self.head(block)
            if not len(starts):
                continue
            ends = np.append(starts[1:], self._next_start(block + 1))
            ids = self.ids(int(starts[0]), int(ends[-1]))
            for k, (start, end) in enumerate(zip((starts - starts[0]).tolist(), (ends - starts[0]).tolist())):
                doc_id = int(doc_ids[k]) if known[k] else None
                yield int(self.docs_before[block]) + k, doc_id, int(starts[k]), ids[start:end]


def write_bit_files(
    docs: DataFrame, folder: str, end: int = END_OF_DOCUMENT, vocabulary: str | None = None, block_ids: int = BLOCK_IDS
) -> DataFrame:
    """Writes the files below ``folder`` (a URI) in ascending doc_id order.

    Returns file, n_ids, n_docs, n_blocks and start, the ids of all files before it. Texts are shuffled once,
    before they are encoded; a partition of that shuffle becomes a file.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyarrow import fs
        from pyspark import TaskContext

        encode = word_encoder(vocabulary)
        system, place = fs.FileSystem.from_uri(folder)
        system.create_dir(place, recursive=True)
        name, out, file, last = f"{uuid.uuid4().hex}.bits", None, None, np.array([end], "<u4")
        try:
            for batch in batches:
                if batch.num_rows and not out:
                    out = system.open_output_stream(f"{place}/{name}", compression=None)
                    file = BitFileWriter(out, bits_for(max(encode.vocabulary, end + 1)), block_ids)
                for doc_id, text in zip(batch.column(0), batch.column(1)):
                    file.add(doc_id.as_py(), np.concatenate([encode(text.as_py()), last]))
            if file:
                file.finish()
        finally:
            if out:
                out.close()
        if file:
            row = (TaskContext.get().partitionId(), name, file.ids, file.docs, len(file.directory) - 1)
            names = ["part", "file", "n_ids", "n_docs", "n_blocks"]
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in row], names=names)

    doc_id = F.col("doc_id").cast("bigint").alias("doc_id")
    texts = docs.select(doc_id, text_or_empty("text").alias("text"))
    # The last key only spreads rows that are equal in all that can be seen.
    texts = texts.select("*", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("k"))
    order = [F.col("doc_id").asc_nulls_last(), F.col("h"), F.col("k")]
    dealt = texts.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    schema = "part BIGINT, file STRING, n_ids BIGINT, n_docs BIGINT, n_blocks BIGINT"
    written = workspace.snapshot(dealt.mapInArrow(write, schema), "bit-files")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return written.select(
        "file", "n_ids", "n_docs", "n_blocks", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("start")
    )


def read_bit_files(files: DataFrame, folder: str, task_blocks: int = TASK_BLOCKS) -> DataFrame:
    """The documents of the files that ``write_bit_files`` listed: doc_id, file, ordinal, start, n_tokens,
    ids_crc32, ids.

    ``start`` counts the ids of all documents before it in all files, ``ordinal`` the documents before it in
    its file. ``ids`` are little-endian unsigned 32-bit integers, and ``ids_crc32`` is their checksum.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        from pyarrow import fs

        system, place = fs.FileSystem.from_uri(folder)
        kinds = [("doc_id", pa.int64()), ("file", pa.string()), ("ordinal", pa.int64()), ("start", pa.int64())]
        schema = pa.schema([*kinds, ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])
        rows, held = [], 0

        def table() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
            rows.clear()
            return out

        for batch in batches:
            for share in batch.to_pylist():
                with system.open_input_file(f"{place}/{share['file']}") as f:
                    found = BitFile(f).documents(share["first"], share["first"] + task_blocks)
                    for ordinal, doc_id, start, ids in found:
                        data = ids.tobytes()
                        key = (doc_id, share["file"], ordinal, share["start"] + start)
                        rows.append((*key, len(ids), zlib.crc32(data), data))
                        held += len(data)
                        if held > 16 << 20:
                            yield table()
                            held = 0
        if rows:
            yield table()

    shares = files.filter("n_blocks > 0").selectExpr("file", "start", f"explode(sequence(0L, n_blocks - 1, {task_blocks}L)) AS first")
    schema = "doc_id BIGINT, file STRING, ordinal BIGINT, start BIGINT, n_tokens BIGINT, ids_crc32 BIGINT, ids BINARY"
    # The number is set outright: Spark would size tasks by the few bytes of a share and not by what they read.
    tasks = max(shares.count(), 1)
    return shares.repartition(tasks, F.xxhash64("file", "first")).mapInArrow(read, schema)


def op11_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's place and checksum as read back from the files."""
    folder = workspace.scratch_path(spark, "bit-files")
    files = write_bit_files(table(spark, sf_dir, "documents"), folder)
    return read_bit_files(files, folder).select("doc_id", "start", "n_tokens", "ids_crc32", "file", "ordinal")
