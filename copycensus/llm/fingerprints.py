"""Document fingerprints by locally consistent parsing.

A text is a sequence of code points, each with a 64-bit name. A level turns a sequence of names into a
shorter one of phrase names:

* a run of one name becomes one name, so neighbours differ;
* deterministic coin tossing gives each position a label from its left neighbour: twice the lowest bit in
  which both names differ, plus that bit. Four rounds leave labels below 6, and neighbours still differ;
* a phrase begins where the label is greater than on both sides, and its name is a hash of its names.

Where a phrase begins depends on a few names around it only. So equal substrings, wherever they
stand, have the same phrases but for a few at their ends, on every level.

The fingerprint has the name of the whole text and, for levels 1 to 3 (phrases of some 3, 8 and 24 code
points), the least 32-bit names of each level, where each further occurrence of a phrase has a name
of its own. The likeness of two fingerprints is the Dice coefficient of these sets, estimated from
the least names of both, on the highest level where both have enough.

``next_document_edits`` pairs each document with the next one by ascending id without a global order in
one task: ids are cut into ranges, the first document of a range is sent to the range before it, too,
and each range is one sorted stream. A text moves once.

Defined results: a null or empty text has a fingerprint without phrases; two of them are alike (1), one
is unlike any other text (0). Rows that repeat a doc_id follow each other in the order of their
texts. Rows without doc_id come before all others. After the last row comes the first; a single row
follows itself. An empty table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from copycensus import workspace
from copycensus.llm.common import table, text_or_empty, worker_memory
from copycensus.llm.shingles import mix

LEVELS = 3
KEPT = (32, 48, 48)  # least names kept of each level
ENOUGH = 16  # names on a level, to compare by it
CHUNK_CHARS = 1 << 18


# ---- parsing -----------------------------------------------------------------------------------


def _starts(counts: np.ndarray) -> np.ndarray:
    return np.cumsum(counts) - counts


def _toss() -> np.ndarray:
    """The label of a position for each pair of labels below 128, of its left neighbour and its own."""
    memory = worker_memory()
    if "toss" not in memory:
        left, own = np.divmod(np.arange(1 << 14), 128)
        differ = left ^ own
        place = np.log2(np.maximum(differ & -differ, 1)).astype(np.int64)
        memory["toss"] = (2 * place + ((own >> place) & 1)).astype(np.uint8)
    return memory["toss"]


def next_level(names: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The phrase names of texts that lie one after the other, and how many each has."""
    n = len(names)
    some = counts > 0
    head = np.zeros(n, bool)
    head[_starts(counts)[some]] = True

    new = head.copy()
    new[1:] |= names[1:] != names[:-1]
    begin = np.flatnonzero(new)
    if len(begin) < n:
        run = np.diff(begin, append=n).astype(np.uint64)
        names, head = names[begin], head[begin]
        names = np.where(run > 1, mix(names * np.uint64(0x9E3779B97F4A7C15) + run), names)
        n = len(names)
    heads = np.flatnonzero(head)

    # Round one on the names. A text's first position has no left neighbour; one that differs in bit
    # 0 stands for it.
    differ = names.copy()
    differ[1:] ^= names[:-1]
    differ[heads] = 1
    lowest = differ & (~differ + np.uint64(1))
    place = ((lowest.astype(np.float64).view(np.int64) >> 52) - 1023).astype(np.uint8)
    label = (place << 1) | ((names & lowest) != 0)
    for _ in range(3):
        pair = label.astype(np.uint16)
        pair[1:] |= label[:-1].astype(np.uint16) << 7
        pair[heads] = label[heads] | ((label[heads] ^ 1).astype(np.uint16) << 7)
        label = _toss()[pair]

    cut_here = head.copy()
    rises, falls = np.ones(n, bool), np.ones(n, bool)
    rises[1:] = label[1:] > label[:-1]
    falls[:-1] = label[:-1] > label[1:]
    falls[heads[1:] - 1] = True
    cut_here |= rises & falls
    cut = np.flatnonzero(cut_here)

    length = np.diff(cut, append=n)
    place = np.arange(1, n + 1, dtype=np.uint64) - np.repeat(cut.astype(np.uint64), length)
    terms = mix(names + place * np.uint64(0xD1B54A32D192ED03))
    phrases = mix(np.add.reduceat(terms, cut) + length.astype(np.uint64))
    found = np.zeros(len(counts), np.int64)
    found[some] = np.diff(np.searchsorted(cut, heads), append=len(cut))
    return phrases, found


def _distinct(values: np.ndarray) -> np.ndarray:
    values.sort()
    return values if len(values) < 2 else values[np.concatenate(([True], values[1:] != values[:-1]))]


def _least(names: np.ndarray, kept: int) -> np.ndarray:
    """The least of 32-bit names for each occurrence of each phrase: its first, its second, and so on."""
    names = np.sort(names)
    new = np.ones(len(names), bool)
    new[1:] = names[1:] != names[:-1]
    if not new.all():
        first = np.flatnonzero(new)
        again = np.arange(len(names)) - np.repeat(first, np.diff(first, append=len(names)))
        names = names + again.astype(np.uint64) * np.uint64(0xE7037ED1A0B428DB)
    short = (mix(names) >> np.uint64(32)).astype(np.uint32)
    if len(short) > 2 * kept:
        found = _distinct(np.partition(short, 2 * kept)[: 2 * kept])
        if len(found) >= kept:
            return found[:kept]
    return _distinct(short)[:kept]


@dataclass
class Fingerprint:
    root: int
    levels: list[np.ndarray]  # the least names of each level, ascending

    def __str__(self) -> str:
        return ".".join([f"{self.root:016x}", *(x.astype(">u4").tobytes().hex() for x in self.levels)])


def read(fingerprint: str) -> Fingerprint:
    root, *levels = fingerprint.split(".")
    return Fingerprint(int(root, 16), [np.frombuffer(bytes.fromhex(x), ">u4").astype(np.uint32) for x in levels])


def fingerprints(texts: list[str]) -> list[Fingerprint]:
    counts = np.array([len(t) for t in texts], np.int64)
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    names = mix(codes.astype(np.uint64) + np.uint64(1))
    kept: list[list[np.ndarray]] = [[] for _ in texts]
    roots = np.zeros(len(texts), np.uint64)
    for level in range(64):
        if not len(names):
            break
        names, counts = next_level(names, counts)
        begin = _starts(counts)
        if level < LEVELS:
            for k, (a, n) in enumerate(zip(begin.tolist(), counts.tolist(), strict=True)):
                kept[k].append(_least(names[a : a + n], KEPT[level]))
        done = counts == 1
        if done.any() and level >= LEVELS - 1:
            # One phrase is left: the name of the text. Its text takes no part in further levels.
            roots[done] = mix(names[begin[done]] + np.uint64(level))
            stay = np.repeat(~done, counts)
            names, counts = names[stay], np.where(done, 0, counts)
    none = np.zeros(0, np.uint32)
    return [
        Fingerprint(int(root), [*found, *([none] * (LEVELS - len(found)))])
        for root, found in zip(roots, kept, strict=True)
    ]


def likeness(a: Fingerprint, b: Fingerprint) -> float:
    """0 to 1; 1 for fingerprints of equal texts."""
    if a.root == b.root:
        return 1.0
    for level in range(LEVELS - 1, -1, -1):
        x, y = a.levels[level], b.levels[level]
        if min(len(x), len(y)) >= ENOUGH or not level:
            break
    if not len(x) or not len(y):
        return 0.0
    # Names up to the least last one of the cut lists are known of both.
    ends = [z[-1] for z in (x, y) if len(z) == KEPT[level]]
    if ends:
        x, y = x[x <= min(ends)], y[y <= min(ends)]
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 2 * both / (len(x) + len(y))


# ---- tables ------------------------------------------------------------------------------------


def fingerprint_table(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, at = batch.column(1).to_pylist(), 0
            while at < len(texts):
                stop, chars = at, 0
                while stop < len(texts) and chars < CHUNK_CHARS:
                    chars += len(texts[stop])
                    stop += 1
                found = [str(f) for f in fingerprints(texts[at:stop])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, stop - at), pa.array(found)], names=["doc_id", "fingerprint"]
                )
                at = stop

    texts = docs.select(F.col("doc_id").cast("bigint"), text_or_empty("text"))
    return texts.mapInArrow(run, "doc_id BIGINT, fingerprint STRING")


def edited(text: str, following: str) -> str:
    """The last quarter replaced by as much of the beginning of the next text."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def _numbers(values: list[int]) -> Column:
    """One constant array, however many numbers it has."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _range_of(key: Column, bounds: list[int]) -> Column:
    """The number of the range that holds a key; ``bounds`` has the least key of each, ascending.

    Two steps, each with as many comparisons as the root of their number: a block of bounds, then the bound in it.
    """
    step = max(1, int(len(bounds) ** 0.5))
    every = _numbers(bounds[::step])
    block = F.size(F.filter(every, lambda b: b <= key)) - 1
    inside = F.slice(_numbers(bounds), block * step + 1, F.lit(step))
    return block * step + F.size(F.filter(inside, lambda b: b <= key)) - 1


def next_document_edits(docs: DataFrame, ranges_per_partition: int = 8) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    spark = docs.sparkSession
    lowest = -(1 << 63)
    keyed = docs.select(
        F.col("doc_id").cast("bigint"),
        text_or_empty("text").alias("text"),
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(lowest)).alias("_key"),
    )
    n_ranges = ranges_per_partition * int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = keyed.select("_key").distinct().repartitionByRange(n_ranges, "_key")
    firsts = workspace.snapshot(ids.groupBy(F.spark_partition_id().alias("part")).agg(F.min("_key").alias("first")), "ranges")
    bounds = sorted(r["first"] for r in firsts.collect())  # one number per range
    if not bounds:
        bounds = [lowest]
    part = F.col("_part")
    held = _numbers(bounds)
    dealt = keyed.withColumn("_part", _range_of(F.col("_key"), bounds))
    own = F.struct(part.alias("part"), F.lit(False).alias("tail"))
    tail = F.struct(F.pmod(part - 1, F.lit(len(bounds))).alias("part"), F.lit(True).alias("tail"))
    is_first = F.get(held, part) == F.col("_key")
    sent = dealt.select("doc_id", "text", "_key", F.explode(F.when(is_first, F.array(own, tail)).otherwise(F.array(own))).alias("to"))
    streams = (
        sent.select(F.col("to.part").alias("part"), F.col("to.tail").alias("tail"), "_key", "doc_id", "text")
        .repartition("part")
        .sortWithinPartitions("part", "tail", "_key", "text")
    )
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def out(rows: list[tuple], texts: list[str], after: list[int]) -> pa.RecordBatch:
        changed = [edited(texts[k], texts[after[k]]) for k in range(len(rows)) if after[k] >= 0]
        of_text = fingerprints(texts)
        of_edited = iter(fingerprints(changed))
        columns: list[list] = [[] for _ in names]
        words = iter(changed)
        for k, (_, _, doc_id) in enumerate(rows):
            if after[k] < 0:
                continue
            a, b, new = of_text[k], next(of_edited), next(words)
            digest = hashlib.sha256(new.encode()).hexdigest()
            row = (doc_id, len(texts[k]), digest, str(a), str(b), likeness(a, b), likeness(a, of_text[after[k]]))
            for column, value in zip(columns, row, strict=True):
                column.append(value)
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        texts: list[str] = []
        chars = 0

        def pairs() -> list[int]:
            """For each row the place of the next one in its range, -1 for the copy that ends a range."""
            found = []
            for k, (part, tail, _) in enumerate(rows):
                follows = k + 1 < len(rows) and rows[k + 1][0] == part
                found.append(k + 1 if follows and not tail else -1)
            return found

        for batch in batches:
            columns = (batch.column("part").to_pylist(), batch.column("tail").to_pylist(), batch.column("doc_id").to_pylist())
            for *row, text in zip(*columns, batch.column("text"), strict=True):
                rows.append(tuple(row))
                texts.append(text.as_py())
                chars += len(texts[-1])
                if chars > CHUNK_CHARS:
                    yield out(rows, texts, pairs())
                    rows, texts, chars = rows[-1:], texts[-1:], len(texts[-1])
        if len(rows) > 1:
            yield out(rows, texts, pairs())

    schema = (
        "doc_id BIGINT, n_chars BIGINT, edited_sha256 STRING, fingerprint STRING, edited_fingerprint STRING, "
        "near_edited DOUBLE, near_next DOUBLE"
    )
    return streams.select("part", "tail", "doc_id", "text").mapInArrow(run, schema)


def op10_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return next_document_edits(table(spark, sf_dir, "documents"))
