"""Ranked lexical search: documents grouped by the terms of an item that they hold.

Terms are the maximal runs of ASCII letters, digits and characters beyond ASCII, with A-Z lower-cased. The
score of a document adds up, over an item's terms with repeats, the term's weight (by its document
frequency) times a share that grows with its occurrences and falls with the document's length; the contract's
integers are in ``_weight``, ``_length_part`` and ``_share``.

1. Items are taken in blocks of a bounded number of terms. For a block, one pass over all texts stores the
   block's terms in each document with their counts, and the length in terms; nothing of a text but these
   numbers goes further. Number of documents, of terms and document frequencies are sums over those rows.
2. Each task reads its rows in chunks. For an item, every document of the chunk gets a bit mask of the
   item's terms that it holds, and documents of one mask form a group. No document of a group can score
   more than its mask's bound: the weights of its terms times the greatest share that any document of the
   chunk can have. Groups are scored from the highest bound down, until the ``top``-th score so far in this
   task is above the next bound. So common terms alone put no document through scoring.
3. The best ``top`` of each task are ranked once more per item.

Defined results: a null text, or one without terms, is no document of the counts and is never found; an item
without terms finds nothing. Equal scores rank by doc_id; documents without doc_id can be found, rank last
among equals and keep their null. Rows that repeat a doc_id are documents of their own. Rows that repeat an
item_id are searched each by itself, and each has its own ranks. Very long texts are cut into terms piece by
piece. Empty tables give no rows. Further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from copycensus import workspace
from copycensus.llm.common import table, text_or_empty

TOP = 20
#: Terms of one block of items, with repeats; what tasks get of the items is bounded by it.
BLOCK_TERMS = 2_000_000
#: Documents, and counts of terms in them, that a task holds at a time.
CHUNK_DOCS = 1 << 13
CHUNK_COUNTS = 1 << 21
#: Cells of masks that a task holds at a time; more terms in an item mean fewer documents at once.
MASK_CELLS = 1 << 20
PIECE_BYTES = 1 << 20

# Bytes that are no part of a term become spaces, and A-Z become a-z.
_FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


def _weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def _length_part(n: int, documents: int, terms: int) -> int:
    return 100 - 25 + (25 * n * documents) // terms


def _share(tf, m):
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def terms_of(text: str, piece_bytes: int = PIECE_BYTES) -> Iterator[list[bytes]]:
    """The terms of a text, in order, in lists of bounded size."""
    folded = text.encode("utf-8", "replace").translate(_FOLD)
    start = 0
    while start < len(folded):
        stop = folded.find(b" ", start + piece_bytes)
        stop = len(folded) if stop < 0 else stop
        yield folded[start:stop].split()
        start = stop


def read_items(items: list[tuple[int, str]]) -> tuple[dict[bytes, int], list[int], list[np.ndarray], list[np.ndarray]]:
    """The terms of all items by number; for each item with terms its key, its terms and how often it has each."""
    from collections import Counter

    vocabulary: dict[bytes, int] = {}
    keys, terms, repeats = [], [], []
    for key, text in items:
        counts = Counter(t for part in terms_of(text) for t in part)
        if counts:
            keys.append(key)
            terms.append(np.array([vocabulary.setdefault(t, len(vocabulary)) for t in counts], np.int64))
            repeats.append(np.array([*counts.values()], np.int64))
    return vocabulary, keys, terms, repeats


def term_counts(docs: DataFrame, numbers) -> DataFrame:
    """doc_id, n (terms in all), terms and counts of every document that has a term; of the terms only those that
    ``numbers`` has, a broadcast with the number of each."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter

        vocabulary = numbers.value
        wanted = vocabulary.keys()
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                found, n = Counter(), 0
                for part in terms_of(text.as_py()):
                    n += len(part)
                    counts = Counter(part)
                    for term in counts.keys() & wanted:
                        found[vocabulary[term]] += counts[term]
                if n:
                    rows.append((doc_id.as_py(), n, list(found), list(found.values())))
            columns = zip(*rows) if rows else ((),) * 4
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()))
            arrays = [pa.array(c, kind) for c, kind in zip(columns, kinds)]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n", "terms", "counts"])

    texts = docs.select(F.col("doc_id").cast("bigint"), text_or_empty("text"))
    return texts.mapInArrow(count, "doc_id BIGINT, n BIGINT, terms ARRAY<INT>, counts ARRAY<BIGINT>")


class Chunk:
    """Documents with their counts, by document and by term."""

    def __init__(self, ids: list, lengths: list, terms: list, counts: list, documents: int, total: int) -> None:
        self.ids = np.array([0 if i is None else i for i in ids], np.int64)
        self.no_id = np.array([i is None for i in ids], bool)
        self.m = np.array([_length_part(n, documents, total) for n in lengths], np.int64)
        self.first = np.cumsum([0, *map(len, terms)])
        self.term = np.concatenate([*terms, np.empty(0, np.int64)]).astype(np.int64)
        self.tf = np.concatenate([*counts, np.empty(0, np.int64)]).astype(np.int64)
        self.doc = np.repeat(np.arange(len(ids)), np.diff(self.first))
        order = np.argsort(self.term, kind="stable")
        self.by_term, starts = np.unique(self.term[order], return_index=True)
        self.ends = np.append(starts, len(order)).tolist()
        self.holders = self.doc[order]
        most = np.maximum.reduceat(self.tf[order], starts) if len(starts) else np.empty(0, np.int64)
        # The greatest share of each term: its highest count in a document as short as the shortest.
        self.bound = _share(most, int(self.m.min()))


class Search:
    """The best documents of each item so far in this task."""

    def __init__(self, keys: list, terms: list, repeats: list, weights: np.ndarray, top: int, mask_cells: int = MASK_CELLS) -> None:
        self.keys, self.terms, self.repeats, self.weights = keys, terms, repeats, weights
        self.top, self.mask_cells = top, mask_cells
        self.best = [None] * len(keys)
        self.place = np.full(len(weights) + 1, -1, np.int64)
        self.scored = 0

    def add(self, chunk: Chunk) -> None:
        for item, terms in enumerate(self.terms):
            at = np.searchsorted(chunk.by_term, terms)
            held = at < len(chunk.by_term)
            held[held] = chunk.by_term[at[held]] == terms[held]
            held &= self.weights[terms] > 0
            if held.any():
                self._item(item, chunk, terms[held], self.repeats[item][held], at[held])

    def _item(self, item: int, chunk: Chunk, terms: np.ndarray, repeats: np.ndarray, at: np.ndarray) -> None:
        worth = repeats * self.weights[terms]
        words = -(-len(terms) // 64)
        step = max(1, self.mask_cells // words)
        for low in range(0, len(chunk.ids), step):
            high = min(len(chunk.ids), low + step)
            masks = np.zeros((high - low, words), np.uint64)
            for k, a in enumerate(at.tolist()):
                docs = chunk.holders[chunk.ends[a] : chunk.ends[a + 1]]
                if step < len(chunk.ids):
                    docs = docs[np.searchsorted(docs, low) : np.searchsorted(docs, high)]
                masks[docs - low, k // 64] |= np.uint64(1 << (k % 64))
            holding = np.flatnonzero(masks.any(axis=1))
            if len(holding):
                self._groups(item, chunk, terms, worth, worth * chunk.bound[at], masks[holding], holding + low)

    def _groups(self, item, chunk, terms, worth, limits, masks, docs) -> None:
        if masks.shape[1] == 1:
            masks, group = np.unique(masks[:, 0], return_inverse=True)
            masks = masks[:, None]
        else:
            masks, group = np.unique(masks, axis=0, return_inverse=True)
        bits = np.unpackbits(masks.astype("<u8").view(np.uint8), axis=1, bitorder="little")[:, : len(terms)]
        bounds = bits.astype(np.int64) @ limits
        descending = np.argsort(-bounds, kind="stable")
        by_group = np.argsort(group.ravel(), kind="stable")
        sizes = np.bincount(group.ravel(), minlength=len(masks))
        firsts = np.cumsum(sizes) - sizes
        done, wanted = 0, self.top
        while done < len(descending):
            least = self._least(item)
            if bounds[descending[done]] < least:
                return
            # As many groups at once as can still be needed and hold ``wanted`` documents.
            able = int(np.searchsorted(-bounds[descending], -least, "right"))
            stop = done + 1 + int(np.searchsorted(np.cumsum(sizes[descending[done:able]]), wanted))
            take = descending[done : min(stop, able)]
            members = np.concatenate([by_group[firsts[g] : firsts[g] + sizes[g]] for g in take.tolist()])
            self._score(item, chunk, terms, worth, docs[members])
            done, wanted = done + len(take), wanted * 4

    def _least(self, item: int) -> int:
        best = self.best[item]
        return int(best[0][-1]) if best is not None and len(best[0]) == self.top else 1

    def _score(self, item, chunk, terms, worth, docs) -> None:
        self.place[terms] = np.arange(len(terms))
        starts, sizes = chunk.first[docs], chunk.first[docs + 1] - chunk.first[docs]
        owner = np.repeat(np.arange(len(docs)), sizes)
        cell = np.arange(len(owner)) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
        term = self.place[chunk.term[cell]]
        owner, cell, term = owner[term >= 0], cell[term >= 0], term[term >= 0]
        scores = np.zeros(len(docs), np.int64)
        np.add.at(scores, owner, worth[term] * _share(chunk.tf[cell], chunk.m[docs[owner]]))
        self.place[terms] = -1
        self.scored += len(docs)
        found = (scores, chunk.no_id[docs], chunk.ids[docs])
        if self.best[item] is not None:
            found = tuple(map(np.concatenate, zip(self.best[item], found)))
        order = np.lexsort((found[2], found[1], -found[0]))[: self.top]
        order = order[found[0][order] > 0]
        self.best[item] = tuple(x[order] for x in found)

    def rows(self) -> Iterator[tuple]:
        for key, best in zip(self.keys, self.best):
            if best is not None:
                for score, no_id, doc_id in zip(*(x.tolist() for x in best)):
                    yield key, None if no_id else doc_id, score


def _search_block(docs: DataFrame, items: list[tuple[int, str]], top: int, chunk_docs: int) -> DataFrame | None:
    """key, doc_id, score of the best documents of each task, for items given as key and text."""
    sc = docs.sparkSession.sparkContext
    vocabulary, *queries = read_items(items)
    if not vocabulary:
        return None
    held = workspace.snapshot(term_counts(docs, sc.broadcast(vocabulary)), "term-counts")
    total = held.agg(F.count("*").alias("documents"), F.sum("n").alias("terms")).first()
    if not total.documents:
        return None
    # At most a row for each term of the block.
    frequencies = held.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n")).collect()
    weights = np.zeros(len(vocabulary), np.int64)
    for term, n in frequencies:
        weights[term] = _weight(total.documents, n)
    shared, documents, terms = sc.broadcast((*queries, weights)), total.documents, total.terms

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Search(*shared.value, top)
        waiting: list[tuple] = []
        held = 0

        def flush() -> None:
            if waiting:
                found.add(Chunk(*zip(*waiting), documents, terms))
                waiting.clear()

        for batch in batches:
            ids, lengths = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            numbers, counts = batch.column(2), batch.column(3)
            offsets = numbers.offsets.to_numpy()
            term = numbers.values.to_numpy()
            tf = counts.values.to_numpy()[counts.offsets[0].as_py() :]
            for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
                base = int(offsets[0])
                waiting.append((ids[k], lengths[k], term[a:b], tf[a - base : b - base]))
                held += b - a
                if len(waiting) >= chunk_docs or held >= CHUNK_COUNTS:
                    flush()
                    held = 0
        flush()
        columns = [*zip(*found.rows())] or [()] * 3
        arrays = [pa.array(c, pa.int64()) for c in columns]
        yield pa.RecordBatch.from_arrays(arrays, names=["key", "doc_id", "score"])

    return held.filter("size(terms) > 0").mapInArrow(search, "key BIGINT, doc_id BIGINT, score BIGINT")


def rank_documents(
    docs: DataFrame, items: DataFrame, top: int = TOP, block_terms: int = BLOCK_TERMS, chunk_docs: int = CHUNK_DOCS
) -> DataFrame:
    """item_id, rank, doc_id, score of the ``top`` documents of each item (item_id, text).

    Items go in blocks of about ``block_terms`` terms, each of which is one pass over the texts. Only a
    block at a time is at the driver.
    """
    spark = docs.sparkSession
    kept = items.select("item_id", text_or_empty("text").alias("text")).withColumn("key", F.monotonically_increasing_id())
    kept = workspace.snapshot(kept, "items")
    # Bytes of text bound the number of terms.
    total = kept.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(total / (4 * block_terms)))
    found = []
    for b in range(blocks):
        share = kept.filter(F.pmod(F.xxhash64("key"), F.lit(blocks)) == b).select("key", "text")
        if (part := _search_block(docs, [tuple(r) for r in share.collect()], top, chunk_docs)) is not None:
            found.append(workspace.snapshot(part, "found"))
    if not found:
        kind = items.schema["item_id"].dataType.simpleString()
        return spark.createDataFrame([], f"item_id {kind}, rank INT, doc_id BIGINT, score BIGINT")
    best = found[0]
    for part in found[1:]:
        best = best.union(part)
    in_order = Window.partitionBy("key").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    ranked = best.withColumn("rank", F.row_number().over(in_order)).filter(F.col("rank") <= top)
    # One row for each item, so the join is on a unique key.
    return ranked.join(kept.select("key", "item_id"), "key").select("item_id", "rank", "doc_id", "score")


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = """regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"""

ORACLE_SQL = {
    "op12_ranked_search": f"""WITH d AS (
  SELECT doc_id, {_TERMS} AS terms FROM documents WHERE text IS NOT NULL),
lengths AS (SELECT doc_id, len(terms) AS n FROM d WHERE len(terms) > 0),
total AS (SELECT count(*) AS documents, CAST(sum(n) AS BIGINT) AS terms FROM lengths),
q AS (
  SELECT item_id, term, count(*) AS repeats
  FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark WHERE text IS NOT NULL) GROUP BY ALL),
tf AS (
  SELECT doc_id, term, count(*) AS tf
  FROM (SELECT doc_id, unnest(terms) AS term FROM d)
  WHERE term IN (SELECT term FROM q) GROUP BY ALL),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * documents + 2) / (2 * n + 1))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS n FROM tf GROUP BY term), total),
scores AS (
  SELECT q.item_id, tf.doc_id,
         CAST(sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * documents) // total.terms)))) AS BIGINT) AS score
  FROM q JOIN tf USING (term) JOIN weights USING (term) JOIN lengths USING (doc_id), total
  GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scores WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= {TOP}"""
}
