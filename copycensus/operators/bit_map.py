"""Bit maps that spare most rows an exact join.

A map has a bit for each value of a hash. It is stored and broadcast by cells of 4096 bytes, of which only
those with a bit set exist; its size is bounded by the number of bits, whatever the number of keys. Rows whose
bit is not set are certain not to match; the others go through an exact operator.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import workspace

# Fixed by ``bitmap_construct_agg``: one cell is 4096 bytes.
CELL_BITS = 32768

#: Bits of a map as a power of two; 2**26 is 8 MB.
MAP_BITS = 26
#: Bits for each row of a map of sizes, and the largest such map (32 MB).
BITS_PER_ROW = 8
MOST_BITS = 28

#: Sizes a task counts at a time.
BATCH_SIZES = 1 << 22


def _marked(wide: DataFrame, slot: Column, cells: DataFrame) -> DataFrame:
    """``wide`` with ``_marked``: whether the bit of its slot is set in ``cells`` (_cell, _map)."""
    place = F.col("_slot") % CELL_BITS
    byte = F.conv(F.hex(F.substr("_map", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    marked = F.coalesce(F.getbit(byte, (place % 8).cast("int")) == 1, F.lit(False))
    slotted = wide.withColumn("_slot", slot).withColumn("_cell", F.floor(F.col("_slot") / CELL_BITS))
    joined = slotted.join(F.broadcast(cells), "_cell", "left")
    return joined.select(*wide.columns, marked.alias("_marked"))


def mark_members(wide: DataFrame, wanted: DataFrame, keys: list[str], bits: int = MAP_BITS, seed: int = 0) -> DataFrame:
    """Add ``_marked`` to ``wide``: true for every row whose ``keys`` are in ``wanted``, and for few others as long
    as the map is not full. Neither side is shuffled but for the map itself. Keys must not be null."""
    slot = F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << bits))
    cells = (
        wanted.select(slot.alias("_slot"))
        .groupBy(F.floor(F.col("_slot") / CELL_BITS).alias("_cell"))
        .agg(F.bitmap_construct_agg(F.col("_slot") % CELL_BITS).alias("_map"))
    )
    return _marked(wide, slot, cells)


# ---- what occurs more than once ----------------------------------------------------------------

# A part of a map as one task saw it: bits that it saw, and bits that it saw again. Few bits are a list of
# places, many are a map.
_PARTS = "_cell BIGINT, once BINARY, again BINARY"


def _pack(places) -> bytes:
    import numpy as np

    if 2 * len(places) < CELL_BITS // 8:
        return places.astype("<u2").tobytes()
    bits = np.zeros(CELL_BITS, np.uint8)
    bits[places] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def _bits(data: bytes):
    """The bits of a part, one to a byte."""
    import numpy as np

    if len(data) == CELL_BITS // 8:
        return np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little").astype(bool)
    bits = np.zeros(CELL_BITS, bool)
    bits[np.frombuffer(data, "<u2")] = True
    return bits


def _count_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts of the map from slots; a task's own repeats are found here."""
    import numpy as np
    import pyarrow as pa

    def parts(slots) -> pa.RecordBatch:
        seen, times = np.unique(slots, return_counts=True)
        cells, first = np.unique(seen // CELL_BITS, return_index=True)
        ends = [*first[1:].tolist(), len(seen)]
        once, again = [], []
        for low, high in zip(first.tolist(), ends):
            places = seen[low:high] % CELL_BITS
            once.append(_pack(places))
            again.append(_pack(places[times[low:high] > 1]))
        arrays = [pa.array(cells, pa.int64()), pa.array(once, pa.binary()), pa.array(again, pa.binary())]
        return pa.RecordBatch.from_arrays(arrays, names=["_cell", "once", "again"])

    waiting, held = [], 0
    for batch in batches:
        waiting.append(batch.column(0).to_numpy(zero_copy_only=False))
        held += batch.num_rows
        if held >= BATCH_SIZES:
            yield parts(np.concatenate(waiting))
            waiting, held = [], 0
    if held:
        yield parts(np.concatenate(waiting))


def _merge_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cells with the bits that were seen again, from parts in the order of cells; one cell at a time is held."""
    import numpy as np
    import pyarrow as pa

    def cell(number: int, again) -> pa.RecordBatch:
        data = np.packbits(again, bitorder="little").tobytes()
        return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([data], pa.binary())], names=["_cell", "_map"])

    current = once = again = None
    for batch in batches:
        for number, seen, repeated in zip(*(c.to_pylist() for c in batch.columns)):
            if number != current:
                if current is not None and again.any():
                    yield cell(current, again)
                current, once, again = number, np.zeros(CELL_BITS, bool), np.zeros(CELL_BITS, bool)
            seen = _bits(seen)
            again |= _bits(repeated) | (once & seen)
            once |= seen
    if current is not None and again.any():
        yield cell(current, again)


def repeated_cells(slots: DataFrame) -> DataFrame:
    """The map (_cell, _map) of the slots that occur at least twice in the one column of ``slots``.

    Each task sends about two bytes for a slot, and nothing else moves.
    """
    parts = slots.mapInArrow(_count_slots, _PARTS)
    sorted_parts = parts.repartition("_cell").sortWithinPartitions("_cell")
    return sorted_parts.mapInArrow(_merge_parts, "_cell BIGINT, _map BINARY")


def map_bits(rows: int) -> int:
    """Bits for a map of so many rows: few share a bit, up to the largest map."""
    return min(max(15, (BITS_PER_ROW * max(rows, 1)).bit_length()), MOST_BITS)


def mark_repeated(rows: DataFrame, key: str, bits: int) -> DataFrame:
    """Add ``_marked`` to ``rows``: true wherever the key occurs in another row, too, and for few others as long as
    the map is not full. ``rows`` is read twice."""
    slot = F.pmod(F.xxhash64(key), F.lit(1 << bits))
    cells = workspace.snapshot(repeated_cells(rows.select(slot.alias("_slot"))), "repeated")
    return _marked(rows, slot, cells)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
