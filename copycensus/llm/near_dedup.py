"""Near-duplicate detection with HyperMinHash sketches.

1. One pass takes the set of shingles of every whole text (``shingles``), hashes of 64 bits. The top 8
   bits of a hash pick one of 256 buckets; a bucket keeps the least of the rest as a register of 16
   bits, its number of leading zeros and the 10 bits after the first one.
2. Equal sets are one class, represented by its least doc_id.
3. Registers are banded, as the limit asks (``band_shape``): 36 bands of 7 for 0.85, 35 of 5 for 0.80.
   Empty registers borrow from others for this, by a fixed random order per register, so short texts
   have full bands too. Two sets at the limit share no band with a probability of at most 1e-6.
4. In a band, each member is first compared with one leader, the member whose bands are shared most.
   That settles most of a large group with one comparison per member. What is not in the leader's
   component then is compared with all members of other components in the band. So no link that
   could join two components is left out, while links inside one are not listed. Here a bound spares most
   comparisons of loose copies: pairs at the limit share one of their rarest shingles.
5. A comparison is an estimate first: equal registers, less those that are equal by chance, over those
   in use. What may reach the limit is confirmed on the full sets.
6. Links are joined to components in rounds of stars (``components``).

Defined results: a null text is empty; a text without words has an empty set and is linked with nothing.
Rows that repeat a doc_id are one node of the graph and all get its component. A row without doc_id
keeps its n_shingles, has no component and is not marked as kept. ``drop_near_duplicates`` tells rows
apart by doc_id and text where doc_id alone does not, so each row is a node of its own there, also one
without doc_id. An empty table gives no rows. Further columns of the input are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from copycensus import workspace
from copycensus.llm.common import (
    ids_tell_rows, keyed, likely_members, node_id, table, text_or_empty, without_documents, without_rows, worker_memory
)
from copycensus.llm.components import components
from copycensus.llm.shingles import mix, shingle_sets

LEAST_PERCENT = 85

BUCKET_BITS = 8
BUCKETS = 1 << BUCKET_BITS
MANTISSA_BITS = 10
MOST_MISSED = 1e-6  # of pairs at the limit, those that share no band
SKETCH = (
    "n_shingles BIGINT, set_key BINARY, bands ARRAY<BIGINT>, registers ARRAY<SMALLINT>, "
    "b0 BIGINT, b1 BIGINT, b2 BIGINT, b3 BIGINT"
)
# Expected number of registers equal by chance in 2**p buckets with r bits of mantissa is this times 2**(p - r), times
# 4 q / (1 + q) ** 2 for the ratio q of the two cardinalities (published HyperMinHash analysis).
CHANCE = 0.169919487


# ---- sketches ----------------------------------------------------------------------------------


def band_shape(percent: int) -> tuple[int, int]:
    """Bands and rows: the most rows, and for them the fewest bands, that miss at most ``MOST_MISSED`` of the
    pairs at the limit. Where the registers do not suffice for that, each one is a band."""
    for rows in range(BUCKETS, 0, -1):
        miss = 1 - (percent / 100) ** rows  # in one band
        bands = 1 if miss <= MOST_MISSED else math.ceil(math.log(MOST_MISSED) / math.log(miss)) if miss < 1 else BUCKETS
        if bands * rows <= BUCKETS:
            return bands, rows
    return BUCKETS, 1


def _random(bands: int, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each register the order in which it looks for one to borrow; factors and seeds of bands."""
    memory, name = worker_memory(), f"bands-{bands}-{rows}"
    if name not in memory:
        keys = mix(np.arange(BUCKETS * BUCKETS, dtype=np.uint64) + np.uint64(1)).reshape(BUCKETS, BUCKETS)
        factors = mix(np.arange(1 << 20, (1 << 20) + bands * rows, dtype=np.uint64)).reshape(bands, rows)
        seeds = mix(np.arange(1 << 21, (1 << 21) + bands, dtype=np.uint64))
        memory[name] = (keys.argsort(axis=1), factors | np.uint64(1), seeds)
    return memory[name]


def registers(shingles: np.ndarray) -> np.ndarray:
    """The sketch of sorted distinct hashes; 0 marks an empty bucket."""
    out = np.zeros(BUCKETS, np.uint16)
    bucket = (shingles >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    first = np.flatnonzero(np.diff(bucket, prepend=-1))  # the least hash of each bucket
    kept = 48
    rest = (shingles[first] >> np.uint64(64 - BUCKET_BITS - kept)) & np.uint64((1 << kept) - 1)
    zeros = kept - np.frexp(rest.astype(np.float64))[1]
    mantissa = (rest << zeros.astype(np.uint64)) >> np.uint64(kept - 1 - MANTISSA_BITS)
    mantissa &= np.uint64((1 << MANTISSA_BITS) - 1)
    out[bucket[first]] = ((zeros + 1) << MANTISSA_BITS).astype(np.uint16) | mantissa.astype(np.uint16)
    return out


def band_keys(sketch: np.ndarray, bands: int, rows: int) -> np.ndarray:
    order, factors, seeds = _random(bands, rows)
    used = sketch > 0
    if not used.all():
        sketch = np.where(used, sketch, sketch[order[np.arange(BUCKETS), used[order].argmax(axis=1)]])
    parts = sketch[: bands * rows].reshape(bands, rows).astype(np.uint64)
    return mix((mix(parts * factors) * factors).sum(axis=1, dtype=np.uint64) + seeds).view(np.int64)


def _sketch(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    shape = band_shape(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        names = ["doc_id", "n_shingles", "set_key", "bands", "registers", "b0", "b1", "b2", "b3"]
        for batch in batches:
            n, keys, bands, sketches = [], [], [], []
            for found in shingle_sets(batch.column(1)):
                n.append(len(found))
                sketch = registers(found)
                sketches.append(sketch)
                keys.append(hashlib.md5(found.tobytes()).digest() if len(found) else None)
                bands.append(band_keys(sketch, *shape) if len(found) else np.zeros(0, np.int64))
            flat = np.array(sketches, np.uint16).reshape(-1, BUCKETS)
            bits = np.packbits((flat & 1).astype(np.uint8), axis=1).view(np.int64)
            stops = np.cumsum([0, *map(len, bands)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(n, pa.int64()),
                    pa.array(keys, pa.binary()),
                    pa.ListArray.from_arrays(stops, np.concatenate([np.zeros(0, np.int64), *bands])),
                    pa.ListArray.from_arrays(
                        np.arange(0, flat.size + 1, BUCKETS, dtype=np.int32), flat.ravel().view(np.int16)
                    ),
                    *(pa.array(bits[:, k].copy()) for k in range(4)),
                ],
                names=names,
            )

    return run


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = list(shingle_sets(batch.column(1)))
        for k in range(0, len(sets), 256):
            part = sets[k : k + 256]
            stops = np.cumsum([0, *map(len, part)]).astype(np.int32)
            values = np.concatenate([np.zeros(0, np.uint64), *part]).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(k, 256), pa.ListArray.from_arrays(stops, values)], names=["doc_id", "set"]
            )


def sketches(docs: DataFrame, percent: int = LEAST_PERCENT) -> DataFrame:
    doc_id, kind = node_id(docs)
    return docs.select(doc_id, text_or_empty("text")).mapInArrow(_sketch(percent), f"doc_id {kind}, {SKETCH}")


# ---- comparisons -------------------------------------------------------------------------------


def _may_reach(limit: float) -> Column:
    """The estimate from both sketches reaches the limit less six standard deviations."""
    pairs = F.zip_with("a_registers", "b_registers", lambda x, y: F.when((x != 0) | (y != 0), (x == y).cast("int")))
    both = F.filter(pairs, lambda same: same.isNotNull())
    used = F.size(both)
    equal = F.aggregate(both, F.lit(0), lambda n, same: n + same)
    q = F.col("a_n") / F.col("b_n")
    chance = F.lit(CHANCE * 2.0 ** (BUCKET_BITS - MANTISSA_BITS)) * 4 * q / ((1 + q) * (1 + q))
    return (equal - chance) / used >= limit - 6 * F.sqrt(limit * (1 - limit) / used)


def _sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id, set: the full sets of the documents in ``ids``, and of few others; stored."""
    doc_id, kind = node_id(docs)
    texts = docs.select(doc_id.alias("doc_id"), text_or_empty("text"))
    wanted = likely_members(texts, F.col("doc_id"), ids, F.col("doc_id"))
    return workspace.snapshot(wanted.mapInArrow(_full_sets, f"doc_id {kind}, set ARRAY<BIGINT>"), "sets")


def _likely(known: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that may reach the limit by their sizes and sketches; stored."""
    sides = known.select("doc_id", F.col("n_shingles").alias("n"), "registers")
    near_size = f"100 * least(a_n, b_n) >= {percent} * greatest(a_n, b_n)"
    likely = (
        pairs.join(sides.toDF("a", "a_n", "a_registers"), "a")
        .join(sides.toDF("b", "b_n", "b_registers"), "b")
        .filter(near_size)
        .filter(_may_reach(percent / 100))
        .select("a", "b")
    )
    return workspace.snapshot(likely.distinct(), "likely")


def _confirmed(likely: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets reach the limit; stored."""
    common = F.size(F.array_intersect("a_set", "b_set"))
    confirmed = (
        likely.join(full.toDF("a", "a_set"), "a")
        .join(full.toDF("b", "b_set"), "b")
        .filter(100 * common >= percent * (F.size("a_set") + F.size("b_set") - common))
    )
    return workspace.snapshot(confirmed.select("a", "b"), "confirmed")


def _rare_shingles(full: DataFrame, percent: int) -> DataFrame:
    """doc_id, rare: the shingles of a document that fewest sets hold, as many as any comparison needs.

    Null where a doc_id repeats, for then its rows' sets cannot be told apart.
    """
    spread = full.select("doc_id", F.size("set").alias("n"), F.explode("set").alias("s"))
    held = spread.groupBy("s").agg(F.count(F.lit(1)).alias("sets"))
    needed = F.col("n") - F.ceil(percent * F.col("n") / 100) + 1
    ordered = F.sort_array(F.collect_list(F.struct("sets", "s")))
    rare = (
        spread.join(held, "s")
        .groupBy("doc_id", "n")
        .agg(ordered.alias("ordered"))
        .select("doc_id", F.slice("ordered", F.lit(1), needed.cast("int"))["s"].alias("rare"))
    )
    rows = full.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"))
    once = rows.filter("rows = 1").select("doc_id")
    return rows.select("doc_id").join(rare.join(once, "doc_id", "left_semi"), "doc_id", "left")


def most_bits(percent: int) -> int:
    """Of one bit per register, so many differ at the limit: half of the unequal registers, and six deviations."""
    share = (1 - percent / 100) / 2
    return math.ceil(BUCKETS * share + 6 * math.sqrt(BUCKETS * share * (1 - share)))


def _same_bits(percent: int) -> Column:
    differ = sum(F.bit_count(F.col(f"a.b{k}").bitwiseXOR(F.col(f"b.b{k}"))) for k in range(4))
    return differ <= most_bits(percent)


def _can_share(percent: int) -> Column:
    """Two sets that share enough have one in common even among their rarest shingles: all but as many,
    less one, as they must share. So a copy whose own changes are too many meets no other."""
    sizes = F.col("a.n_shingles") + F.col("b.n_shingles")
    shared = F.ceil(percent * sizes / (100 + percent))

    def first(side: str) -> Column:
        needed = F.greatest(F.col(f"{side}.n_shingles") - shared + 1, F.lit(0))
        return F.slice(f"{side}.rare", F.lit(1), needed.cast("int"))

    unknown = F.col("a.rare").isNull() | F.col("b.rare").isNull()
    return unknown | F.arrays_overlap(first("a"), first("b"))


def near_duplicates(docs: DataFrame, percent: int = LEAST_PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    known = workspace.snapshot(sketches(docs, percent), "sketches")
    classes = workspace.snapshot(
        known.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("set_key").agg(F.min("doc_id").alias("rep")),
        "classes",
    )
    reps = classes.select(F.col("rep").alias("doc_id")).distinct()
    banded = known.join(reps, "doc_id", "left_semi").select("doc_id", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    live = workspace.snapshot(banded.join(shared, "band"), "bands")

    # First, each member of a band with its leader.
    ties = live.groupBy("doc_id").agg(F.sum("n").alias("ties"))
    leaders = live.join(ties, "doc_id").groupBy("band").agg(F.max(F.struct("ties", "doc_id")).alias("best"))
    leaders = workspace.snapshot(leaders.select("band", F.col("best.doc_id").alias("leader")), "leaders")
    stars = live.join(leaders, "band").filter("leader <> doc_id")
    stars = stars.select(F.col("leader").alias("a"), F.col("doc_id").alias("b")).distinct()
    likely = _likely(known, stars, percent)
    ids = likely.select(F.col("a").alias("doc_id")).union(likely.select("b")).distinct()
    found = _confirmed(likely, _sets(docs, ids), percent)

    # Then what the leaders' components leave, with the members of other components.
    roots = components(found).withColumnRenamed("node", "doc_id")
    labelled = live.join(roots, "doc_id", "left").select(
        "doc_id", "band", F.coalesce("root", "doc_id").alias("comp")
    )
    mixed = labelled.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi")
    of_leader = leaders.join(roots.toDF("leader", "root"), "leader", "left")
    of_leader = of_leader.select("band", F.coalesce("root", "leader").alias("led"))
    inside = workspace.snapshot(labelled.join(mixed.select("band"), "band", "left_semi"), "mixed")
    ids = inside.select("doc_id").distinct()
    full = _sets(docs, ids)
    bits = known.join(ids, "doc_id", "left_semi").select("doc_id", "n_shingles", "b0", "b1", "b2", "b3").distinct()
    members = inside.join(of_leader, "band").join(bits.join(_rare_shingles(full, percent), "doc_id"), "doc_id")
    members = workspace.snapshot(members, "members")
    apart = members.filter("comp <> led")
    left = apart.alias("a").join(
        members.alias("b"),
        (F.col("a.band") == F.col("b.band"))
        & (F.col("a.comp") != F.col("b.comp"))
        & ((F.col("b.comp") == F.col("b.led")) | (F.col("a.doc_id") < F.col("b.doc_id")))
        & _same_bits(percent)
        & _can_share(percent),
    )
    left = left.select(F.col("a.doc_id").alias("a"), F.col("b.doc_id").alias("b")).distinct()
    found = found.union(_confirmed(_likely(known, left, percent), full, percent))

    roots = components(found).toDF("rep", "root")
    of_class = classes.join(roots, "rep", "left").select("set_key", F.coalesce("root", "rep").alias("component_id"))
    labels = known.select("doc_id", "n_shingles", "set_key").join(of_class, "set_key", "left")
    alone = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return labels.select(
        "doc_id",
        "n_shingles",
        alone.alias("component_id"),
        F.coalesce(F.col("doc_id") == alone, F.lit(False)).alias("kept"),
    )


def drop_near_duplicates(docs: DataFrame, percent: int = LEAST_PERCENT) -> DataFrame:
    """One document of each group, the one with the least doc_id, with all its columns. Of rows that share
    a doc_id each is judged by its own text; rows without one come last."""
    known = ids_tell_rows(docs)
    dropped = near_duplicates(docs if known else keyed(docs), percent).filter("NOT kept").select("doc_id")
    return (without_documents if known else without_rows)(docs, workspace.snapshot(dropped, "near"))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
