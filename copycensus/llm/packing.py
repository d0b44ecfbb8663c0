"""Best-fit packing of documents into sequences of a fixed length, by linear grouping.

1. ``token_pieces`` encodes every whole text, ends it with a separator and cuts what is longer than a
   sequence.
2. Pieces are range-partitioned by length and numbered within their length, so a length that a third
   of all pieces share is spread over many tasks.
3. The driver gets the number of pieces per length: at most ``capacity`` lengths, plus a row for each
   partition border. From these counts alone ``plan`` decides. It deals the large lengths into groups
   of equal cardinality, rounds each up to the largest of its group, finds the best mix of
   configurations of these few sizes by column generation, and puts the actual pieces in the places of
   the rounded ones. What is left, and all small pieces, go best-fit into the room that is left over.
   Bins with equal content are one entry, so the size of the plan depends on the capacity and not on
   the number of documents.
4. Tasks look their pieces' places up in the plan.

Defined results: a null or empty text is a piece that holds only the separator. Rows that repeat a
doc_id are packed each. A row without doc_id is packed and keeps its null. An empty table gives no rows.
Other columns of the documents are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from copycensus import workspace
from copycensus.llm.common import table, text_or_empty
from copycensus.llm.tokens import encoder

CAPACITY = 2048
SEPARATOR = 0
PIECES = "doc_id BIGINT, piece INT, start BIGINT, length BIGINT, ids BINARY"


# ---- pieces ------------------------------------------------------------------------------------


def piece_starts(n: int, capacity: int) -> list[int]:
    """Where the pieces of ``n`` tokens begin: all are full but the first, which has the rest."""
    return [0, *range(n % capacity or capacity, n, capacity)]


def token_pieces(
    docs: DataFrame, capacity: int = CAPACITY, separator: int = SEPARATOR, folder: str | None = None
) -> DataFrame:
    """doc_id, piece, start, length, ids (little-endian unsigned 32-bit) of every piece."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(folder)

        def out(rows: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            names = ("doc_id", "piece", "start", "length", "ids")
            columns = list(zip(*rows, strict=True)) if rows else [()] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        for batch in batches:
            rows, held = [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.array([*encode(text.as_py()), separator], "<u4")
                starts = piece_starts(len(ids), capacity)
                for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True)):
                    rows.append((doc_id, k, a, b - a, ids[a:b].tobytes()))
                held += len(ids)
                if held > 1 << 20:
                    yield out(rows)
                    rows, held = [], 0
            yield out(rows)

    return docs.select(F.col("doc_id").cast("bigint"), text_or_empty("text")).mapInArrow(cut, PIECES)


# ---- the plan ----------------------------------------------------------------------------------


@dataclass
class Bins:
    """``count`` bins of equal content: per slot a length, its copies in each bin, its first rank."""

    count: int
    room: int
    slots: list[tuple[int, int, int]] = field(default_factory=list)

    def split(self, first: int) -> tuple[Bins, Bins]:
        rest = [(length, copies, rank + copies * first) for length, copies, rank in self.slots]
        return Bins(first, self.room, list(self.slots)), Bins(self.count - first, self.room, rest)


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 3000) -> list[tuple]:
    """Few-size configurations and how often each is used: the linear relaxation, rounded down.

    Column generation: the basis starts with one size per bin; a knapsack over the sizes finds the
    configuration that improves it most, until none does.
    """
    n = len(sizes)
    columns = np.diag(capacity // sizes).astype(float)
    inverse = np.diag(1 / np.diag(columns))
    used = inverse @ demand
    for _ in range(rounds):
        prices = inverse.sum(axis=0)
        best, taken = np.zeros(capacity + 1), []
        for _ in range(capacity // int(sizes.min())):
            grown, which = best.copy(), np.full(capacity + 1, -1)
            for g in range(n):
                s = int(sizes[g])
                value = best[: capacity + 1 - s] + prices[g]
                better = value > grown[s:] + 1e-12
                grown[s:][better] = value[better]
                which[s:][better] = g
            best = grown
            taken.append(which)
        if best[capacity] <= 1 + 1e-7:
            break
        column, room = np.zeros(n), capacity
        for which in reversed(taken):
            if (g := which[room]) >= 0:
                column[g] += 1
                room -= int(sizes[g])
        step = inverse @ column
        limits = np.where(step > 1e-9, used / np.where(step > 1e-9, step, 1), np.inf)
        leave = int(limits.argmin())
        used = np.maximum(used - limits[leave] * step, 0)
        used[leave] = limits[leave]
        pivot = inverse[leave] / step[leave]
        inverse = inverse - np.outer(step, pivot)
        inverse[leave] = pivot
        columns[:, leave] = column
    return [(columns[:, k].astype(int), int(used[k] + 1e-9)) for k in range(n) if used[k] >= 1 - 1e-9]


def _group(counts: dict[int, int], lengths: list[int], groups: int) -> tuple[list[int], list[list[list[int]]]]:
    """Rounded sizes, and the (length, count) runs in each, from the largest length down."""
    quota = -(-sum(counts[s] for s in lengths) // groups)
    sizes, runs, room = [], [], 0
    for s in lengths:
        left = counts[s]
        while left:
            if not room:
                room = quota
                if not sizes or sizes[-1] != s:
                    sizes.append(s)
                    runs.append([])
            take = min(left, room)
            runs[-1].append([s, take])
            left, room = left - take, room - take
    return sizes, runs


def plan(counts: dict[int, int], capacity: int = CAPACITY, groups: int = 256, small: float = 0.4) -> list[Bins]:
    """Bins for ``counts[length]`` pieces of each length up to ``capacity``."""
    given = {s: 0 for s in counts}

    def rank(s: int, n: int) -> int:
        given[s] += n
        return given[s] - n

    done: list[Bins] = []
    open_bins: list[list[Bins]] = [[] for _ in range(capacity + 1)]

    def keep(bins: Bins) -> None:
        if bins.count:
            open_bins[bins.room].append(bins)

    if counts.get(capacity):
        done.append(Bins(counts[capacity], 0, [(capacity, 1, rank(capacity, counts[capacity]))]))
    left = {s: n for s, n in counts.items() if s < capacity and n}
    large = sorted((s for s in left if s > small * capacity), reverse=True)
    if large:
        sizes, runs = _group(left, large, groups)
        demand = np.array([sum(n for _, n in r) for r in runs], float)
        chosen = configurations(np.array(sizes), demand, capacity)
        for pattern, times in chosen:
            # One list of runs for each place of the pattern; the actual pieces, largest first.
            places = []
            for g, copies in enumerate(pattern):
                for _ in range(copies):
                    place, want = [], times
                    while want and runs[g]:
                        take = min(want, runs[g][0][1])
                        place.append([runs[g][0][0], take])
                        runs[g][0][1] -= take
                        want -= take
                        if not runs[g][0][1]:
                            runs[g].pop(0)
                    if want:
                        place.append([0, want])
                    places.append(place)
            while places and places[0]:
                n = min(p[0][1] for p in places)
                held: dict[int, int] = {}
                for p in places:
                    held[p[0][0]] = held.get(p[0][0], 0) + 1
                    p[0][1] -= n
                    if not p[0][1]:
                        p.pop(0)
                held.pop(0, None)
                slots = [(s, copies, rank(s, copies * n)) for s, copies in held.items()]
                keep(Bins(n, capacity - sum(s * copies for s, copies in held.items()), slots))
        for s in large:
            left[s] = 0
        for s, n in (run for r in runs for run in r):
            left[s] += n
    for s in sorted(left, reverse=True):
        n, room = left[s], s
        while n:
            while room <= capacity and not open_bins[room]:
                room += 1
            if room > capacity:
                copies = capacity // s
                keep(Bins(-(-n // copies), capacity))
                room = capacity
                continue
            bins = open_bins[room].pop()
            copies = room // s
            if n < copies:
                copies = n
            filled, rest = bins.split(min(bins.count, n // copies))
            keep(rest)
            filled.slots.append((s, copies, rank(s, copies * filled.count)))
            filled.room -= copies * s
            keep(filled)
            n -= copies * filled.count
    for bins in open_bins:
        done += bins
    return done


def _runs(bins: list[Bins]) -> dict[str, np.ndarray]:
    """The plan as arrays, one entry per slot, by length and first rank."""
    rows, first = [], 0
    for b in bins:
        at = 0
        for length, copies, rank in b.slots:
            rows.append((length, rank, first, b.count, at))
            at += length * copies
        first += b.count
    names = ("length", "rank", "sequence", "count", "offset")
    return dict(zip(names, np.array(sorted(rows), np.int64).reshape(-1, 5).T, strict=True))


# ---- places ------------------------------------------------------------------------------------


def _numbered(pieces: DataFrame) -> DataFrame:
    """The pieces spread by length, with the partition and the number within length and partition."""
    spread = pieces.withColumn("_spread", F.xxhash64("doc_id", "piece"))
    ranged = spread.repartitionByRange("length", "_spread").drop("_spread").sortWithinPartitions(
        "length", "doc_id", "piece"
    )
    schema = T.StructType(
        [*ranged.schema, T.StructField("_part", T.IntegerType()), T.StructField("_number", T.LongType())]
    )

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, last, seen = TaskContext.get().partitionId(), -1, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            length = batch.column("length").to_numpy()
            begin = np.flatnonzero(np.diff(length, prepend=length[0] - 1))
            n = np.arange(len(length)) - np.repeat(begin, np.diff(begin, append=len(length)))
            if length[0] == last:
                n[: begin[1] if len(begin) > 1 else None] += seen
            last, seen = length[-1], int(n[-1]) + 1
            columns = [*batch.columns, pa.array(np.full(len(n), part, np.int32)), pa.array(n.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "_part", "_number"])

    return ranged.mapInArrow(number, schema)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to a stored table of pieces (doc_id, piece, length, ...)."""
    spark = pieces.sparkSession
    stored = workspace.snapshot(_numbered(pieces), "numbered")
    borders = stored.groupBy("length", "_part").agg(F.count(F.lit(1)).alias("n")).toArrow().to_pydict()
    order = np.lexsort((borders["_part"], borders["length"]))
    length, part, n = (np.array(borders[c], np.int64)[order] for c in ("length", "_part", "n"))
    before = np.cumsum(n) - n
    new = np.flatnonzero(np.diff(length, prepend=-1))
    before -= np.repeat(before[new], np.diff(new, append=len(length)))  # counted from 0 in each length
    totals: dict[int, int] = {}
    for s, k in zip(length.tolist(), n.tolist(), strict=True):
        totals[s] = totals.get(s, 0) + k
    shared = spark.sparkContext.broadcast((length << 32 | part, before, _runs(plan(totals, capacity))))
    added = [T.StructField(name, T.LongType()) for name in ("sequence_id", "offset")]
    schema = T.StructType([*pieces.schema, *added])
    names = schema.names

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, before, runs = shared.value
        at = runs["length"] << 44 | runs["rank"]
        for batch in batches:
            size = batch.column("length").to_numpy()
            key = size << 32 | batch.column("_part").to_numpy().astype(np.int64)
            rank = before[np.searchsorted(keys, key)] + batch.column("_number").to_numpy()
            k = np.searchsorted(at, size << 44 | rank, "right") - 1
            copy, bin_number = np.divmod(rank - runs["rank"][k], runs["count"][k])
            columns = [
                *(batch.column(c) for c in names[:-2]),
                pa.array(runs["sequence"][k] + bin_number),
                pa.array(runs["offset"][k] + copy * size),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return stored.mapInArrow(place, schema)


def sequences(pieces: DataFrame, places: DataFrame | None = None) -> DataFrame:
    """The packed ids: sequence_id, length, ids. A sequence has at most ``capacity`` tokens.

    ``pieces`` are packed ones that kept their ids; then every row is in exactly one sequence, whatever
    its doc_id. Where each piece has a doc_id of its own, they may also be given as they were before, with
    ``places`` apart from them.
    """
    if places is not None:
        pieces = places.select("doc_id", "piece", "sequence_id", "offset").join(pieces, ["doc_id", "piece"])
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    whole = F.aggregate(parts, F.lit(b""), lambda done, part: F.concat(done, part["ids"]))
    return pieces.groupBy("sequence_id").agg(F.sum("length").alias("length"), whole.alias("ids"))


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, folder: str | None = None) -> DataFrame:
    """Places with a digest of the ids: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = token_pieces(docs, capacity, folder=folder)
    narrow = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack(workspace.snapshot(narrow, "pieces"), capacity)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
