"""Alignment of two tokenizers' tokens over the same bytes.

A is the byte-level vocabulary on a space and the text, B the vocabulary of pieces on the text, which adds
that space itself. A group is the least run of tokens of both that covers the same bytes; its last A and
last B token end together and are linked.

1. A text is encoded by both. Tokens that begin with a space mark words; where both have such a token at the
   same byte, the tokens before it end together, which is an anchor. Anchors cut the ids into windows.
2. A window depends on its ids alone, so each worker remembers the groups of windows by their ids and aligns
   the bytes of new windows only.
3. The links of each document are stored by pair of ids, with how often it has them. Counts of pairs over
   all documents, and which pair is the commonest of its B id, are sums over those. Pairs are joined back
   to documents by a broadcast of the commonest, whose number is bounded, and by a shuffle for the others,
   each of which is rare.

Defined results: null and empty texts, and those whose tokens of A or B do not give back the bytes of space
and text (a U+2581 in it, say), have no tokens: zeros and an empty hash. Rows that repeat a doc_id, or have
none, are documents of their own. Very long texts are encoded in parts cut before single spaces, which no
token crosses, and hashed window by window; a task holds the ids of one document. An empty table gives no
rows. Further columns are ignored.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from copycensus import workspace
from copycensus.llm.common import table, text_or_empty, worker_memory
from copycensus.llm.tokens import BYTE_BPE, encoder
from copycensus.llm.word_tokens import printable_bytes

PIECES = "piece_bpe_32k"
#: Pairs of ids that are broadcast at most.
BROADCAST_pairS = 1_000_000
#: Windows that a worker remembers; others are aligned whenever they come.
REMEMBERED = 250_000
PART_CHARS = 1 << 20
#: Characters of documents that are encoded and aligned together.
SHARE_CHARS = 1 << 21
#: Windows put together at a time.
SLICE = 1 << 17

_SPACE = "▁"
_CUT = re.compile(r"(?<=\S) (?=\S)")
_OF_B = 1 << 31


def _parts(text: str, chars: int) -> Iterator[str]:
    start = 0
    while start < len(text):
        cut = _CUT.search(text, start + chars)
        stop = cut.start() if cut else len(text)
        yield text[start:stop]
        start = stop


def _taken(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of several ranges one after another, and the number of the range of each."""
    sizes = last - first
    number = np.repeat(np.arange(len(sizes)), sizes)
    return values[np.arange(len(number)) + (first - (np.cumsum(sizes) - sizes))[number]], number


class Aligner:
    """Both tokenizers of a worker, and what it remembers."""

    def __init__(self, folder: str | None = None, part_chars: int = PART_CHARS, remembered: int = REMEMBERED) -> None:
        import json
        import os

        import public_tokenizers
        import sentencepiece

        def path(file: str) -> str:
            return os.path.join(folder, file) if folder else public_tokenizers.path(file)

        self.part_chars, self.remembered = part_chars, remembered
        self.encode_a = encoder(folder, special=False)
        self.library = sentencepiece.SentencePieceProcessor(model_file=path(f"{PIECES}.model"))
        with open(path(f"{BYTE_BPE}.json"), encoding="utf-8") as f:
            read = json.load(f)
        entries = read["model"]["vocab"] | {t["content"]: t["id"] for t in read["added_tokens"]}
        byte_of = {c: b for b, c in enumerate(printable_bytes())}
        self.bytes_a = [b""] * (max(entries.values()) + 1)
        for entry, i in entries.items():
            self.bytes_a[i] = bytes(byte_of[c] for c in entry)
        pieces = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        self.bytes_b = [
            bytes([int(p[3:-1], 16)]) if self.library.is_byte(i) else p.replace(_SPACE, " ").encode()
            for i, p in enumerate(pieces)
        ]
        # Texts can be cut before a space if no piece has one after another character.
        self.by_parts = not any(_SPACE in p.lstrip(_SPACE) for p in pieces)
        # Ids as text with what may follow: another token, those of B, another group, or the end of a window.
        ids = range(max(len(self.bytes_a), len(pieces)))
        self.shown = np.array([[f"{i}{after}" for i in ids] for after in (",", "|", ";", "\n")], object)
        self.lengths_a, self.lengths_b = np.array([*map(len, self.bytes_a)]), np.array([*map(len, self.bytes_b)])
        self.spaced_a = np.array([t.startswith(b" ") for t in self.bytes_a])
        self.spaced_b = np.array([t.startswith(b" ") for t in self.bytes_b])
        self.windows: dict[bytes, tuple[str, bytes]] = {}

    def tokens(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """The ids of A and B of each text; none if either does not give back the bytes.

        One tokenizer after the other, as each needs the processor's caches for itself.
        """
        parts = [(k, p) for k, t in enumerate(texts) if t for p in _parts(" " + t, self.part_chars if self.by_parts else len(t))]
        all_a = [self.encode_a(p) for _, p in parts]
        all_b = self.library.encode([p[1:] for _, p in parts], num_threads=1) if parts else []
        found: list[tuple[list, list]] = [([], []) for _ in texts]
        broken = set()
        for (k, part), a, b in zip(parts, all_a, all_b):
            data = part.encode()
            if any(b"".join(map(of.__getitem__, ids)) != data for of, ids in ((self.bytes_b, b), (self.bytes_a, a))):
                broken.add(k)
            # An array takes a list in half the time that numpy needs.
            found[k][0].append(np.frombuffer(array("I", a), "<u4"))
            found[k][1].append(np.frombuffer(array("I", b), "<u4"))
        none = np.empty(0, "<u4")
        return [(none, none) if k in broken or not x else (np.concatenate(x), np.concatenate(y)) for k, (x, y) in enumerate(found)]

    def anchors(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where windows begin, and the ends, as places in ``a`` and in ``b``: the ids of one document, or of
        several one after another, as each begins with a space."""
        starts_a = np.cumsum(self.lengths_a[a]) - self.lengths_a[a]
        starts_b = np.cumsum(self.lengths_b[b]) - self.lengths_b[b]
        # Tokens before a space-marked one at the same byte of both end there together.
        marks_a, marks_b = starts_a[self.spaced_a[a]], starts_b[self.spaced_b[b]]
        place = np.minimum(np.searchsorted(marks_b, marks_a), len(marks_b) - 1)
        shared = marks_a[marks_b[place] == marks_a]
        at_a, at_b = np.searchsorted(starts_a, shared), np.searchsorted(starts_b, shared)
        return np.append(at_a, len(a)), np.append(at_b, len(b))

    def _align(self, a: np.ndarray, b: np.ndarray, at: list[np.ndarray]) -> list[tuple[str, bytes]]:
        """Groups as text, and links as pairs of ids, of windows given by their first and last places in ``a`` and
        ``b``."""
        a, window = _taken(a, at[0], at[1])
        b, _ = _taken(b, at[2], at[3])
        # A window has as many bytes of A as of B, so ends can be compared over all windows at once.
        ends_a, ends_b = np.cumsum(self.lengths_a[a]), np.cumsum(self.lengths_b[b])
        last_a = ends_b[np.searchsorted(ends_b, ends_a)] == ends_a
        last_b = ends_a[np.searchsorted(ends_a, ends_b)] == ends_b
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        shown_a = self.shown[np.where(last_a, 1, 0), a]
        closes = np.append(window[last_a][1:] != window[last_a][:-1], True)
        shown_b = self.shown[np.where(last_b, 2, 0), b]
        shown_b[np.flatnonzero(last_b)[closes]] = self.shown[3, b[last_b][closes]]
        # Of each group the tokens of A come before those of B.
        shown = np.empty(len(a) + len(b), object)
        shown[np.arange(len(a)) + np.searchsorted(group_b, group_a)] = shown_a
        shown[np.arange(len(b)) + np.searchsorted(group_a, group_b, "right")] = shown_b
        texts = "".join(shown.tolist()).split("\n")
        links = np.column_stack([a[last_a], b[last_b]]).astype("<u4").tobytes()
        ends = (8 * np.cumsum(np.bincount(window[last_a], minlength=len(at[0])))).tolist()
        return [(t, links[low:high]) for t, low, high in zip(texts, [0, *ends], ends)]

    def _windows(self, a: np.ndarray, b: np.ndarray, at_a: np.ndarray, at_b: np.ndarray) -> tuple[tuple, tuple]:
        """Texts and links of the windows between the given places. A window's key is its ids."""
        # Those of B have their highest bit set, which keeps the two apart.
        a4, b4 = a[at_a[0] : at_a[-1]].tobytes(), (b[at_b[0] : at_b[-1]] | np.uint32(_OF_B)).tobytes()
        ends_a, ends_b = (4 * (at_a - at_a[0])).tolist(), (4 * (at_b - at_b[0])).tolist()
        keys = [a4[w:x] + b4[y:z] for w, x, y, z in zip(ends_a, ends_a[1:], ends_b, ends_b[1:])]
        found = [*map(self.windows.get, keys)]
        new: dict[bytes, list[int]] = {}
        for k in [k for k, known in enumerate(found) if known is None]:
            new.setdefault(keys[k], []).append(k)
        if new:
            first = np.array([places[0] for places in new.values()])
            aligned = self._align(a, b, [at_a[first], at_a[first + 1], at_b[first], at_b[first + 1]])
            for (key, places), one in zip(new.items(), aligned):
                for k in places:
                    found[k] = one
                if len(self.windows) < self.remembered:
                    self.windows[key] = one
        return tuple(zip(*found))

    def align(self, texts: list[str]) -> list[tuple[int, int, str, np.ndarray]]:
        """For each text the number of tokens of A and of B, SHA-256 of the groups, and the links as rows of two ids."""
        import hashlib

        found = [(0, 0, "", np.empty((0, 2), "<u4"))] * len(texts)
        tokens = self.tokens(texts)
        docs = [k for k, (a, _) in enumerate(tokens) if len(a)]
        if not docs:
            return found
        a, b = (np.concatenate([tokens[k][side] for k in docs]) for side in (0, 1))
        at_a, at_b = self.anchors(a, b)
        # The windows of each document; its first token of A begins one.
        begins = np.searchsorted(at_a, np.cumsum([0, *(len(tokens[k][0]) for k in docs)])).tolist()
        shas, links, d = [hashlib.sha256() for _ in docs], [[] for _ in docs], 0
        for low in range(0, len(at_a) - 1, SLICE):
            high = min(low + SLICE, len(at_a) - 1)
            shown, pairs = self._windows(a, b, at_a[low : high + 1], at_b[low : high + 1])
            while d < len(docs) and begins[d] < high:
                first, last = max(low, begins[d]), min(high, begins[d + 1])
                shas[d].update(((";" if first > begins[d] else "") + ";".join(shown[first - low : last - low])).encode())
                links[d].append(b"".join(pairs[first - low : last - low]))
                if begins[d + 1] > high:
                    break
                d += 1
        for k, sha, of in zip(docs, shas, links):
            pairs = np.frombuffer(b"".join(of), "<u4").reshape(-1, 2)
            found[k] = (len(tokens[k][0]), len(tokens[k][1]), sha.hexdigest(), pairs)
        return found


def aligner(folder: str | None = None) -> Aligner:
    memory, key = worker_memory(), ("aligner", folder)
    if key not in memory:
        memory[key] = Aligner(folder)
    return memory[key]


def _shares(batch: pa.RecordBatch, chars: int) -> Iterator[list[list]]:
    """The rows of a batch in shares of about so many characters, by column."""
    share, held = [], 0
    for row in zip(*batch.columns):
        share.append([x.as_py() for x in row])
        held += len(share[-1][-1])
        if held >= chars:
            yield [*map(list, zip(*share))]
            share, held = [], 0
    if share:
        yield [*map(list, zip(*share))]


def align_documents(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """row (a number), doc_id, n_a, n_b, n_groups, groups_sha256, and the different links: a, b, times."""

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(vocabulary)
        kinds = [("row", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64())]
        kinds += [("n_groups", pa.int64()), ("groups_sha256", pa.string())]
        kinds += [(name, pa.list_(pa.int32())) for name in ("a", "b")] + [("times", pa.list_(pa.int64()))]
        schema = pa.schema(kinds)
        for batch in batches:
            for rows, ids, texts in _shares(batch, SHARE_CHARS):
                found = []
                for row, doc_id, (n_a, n_b, sha, links) in zip(rows, ids, both.align(texts)):
                    pairs, times = np.unique(links[:, 0].astype(np.int64) << 32 | links[:, 1], return_counts=True)
                    different = ((pairs >> 32).astype(np.int32), (pairs & 0xFFFFFFFF).astype(np.int32), times)
                    found.append((row, doc_id, n_a, n_b, len(links), sha, *different))
                columns = [pa.array(c, f.type) for c, f in zip(zip(*found), schema)]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    texts = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint"), text_or_empty("text")
    )
    schema = "row BIGINT, doc_id BIGINT, n_a BIGINT, n_b BIGINT, n_groups BIGINT, groups_sha256 STRING"
    return texts.mapInArrow(align, f"{schema}, a ARRAY<INT>, b ARRAY<INT>, times ARRAY<BIGINT>")


def link_counts(aligned: DataFrame) -> DataFrame:
    """a, b, n of each pair of ids that is linked, and whether no other pair of its B id is linked more often."""
    counts = _links(aligned).groupBy("a", "b").agg(F.sum("times").alias("n"))
    counts = workspace.snapshot(counts, "link-counts")
    # At most a row for each piece of B.
    most = counts.groupBy("b").agg(F.max("n").alias("most"))
    return counts.join(F.broadcast(most), "b").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best"))


def _links(aligned: DataFrame) -> DataFrame:
    each = aligned.select("row", F.explode(F.arrays_zip("a", "b", "times")).alias("link"))
    return each.select("row", "link.a", "link.b", "link.times")


def weigh_links(aligned: DataFrame, counts: DataFrame, broadcast_pairs: int = BROADCAST_pairS) -> DataFrame:
    """row, n_best, count_sum of each document with links. ``aligned`` and ``counts`` are read repeatedly, so
    pass stored tables.

    Of all links, at most ``broadcast_pairs`` pairs can hold a share of one in ``broadcast_pairs`` each. Those
    are broadcast, and the others cannot make a hot key.
    """
    size = counts.agg(F.count("*").alias("pairs"), F.sum("n").alias("links")).first()
    links = _links(aligned)
    if size.pairs <= broadcast_pairs:
        joined = links.join(F.broadcast(counts), ["a", "b"])
    else:
        common = F.col("n") >= math.ceil(size.links / broadcast_pairs)
        frequent = F.broadcast(counts.filter(common))
        hit = links.join(frequent, ["a", "b"])
        rare = links.join(F.broadcast(counts.filter(common).select("a", "b")), ["a", "b"], "left_anti")
        joined = hit.unionByName(rare.join(counts.filter(~common).hint("merge"), ["a", "b"]))
    return joined.groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
        F.sum(F.col("times") * F.col("n")).alias("count_sum"),
    )


def align_tokenizers(docs: DataFrame, vocabulary: str | None = None, broadcast_pairs: int = BROADCAST_pairS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row."""
    aligned = workspace.snapshot(align_documents(docs, vocabulary), "aligned")
    counts = workspace.snapshot(link_counts(aligned), "pairs")
    weighed = weigh_links(aligned, counts, broadcast_pairs)
    none = F.lit(0).cast("bigint")
    return aligned.drop("a", "b", "times").join(weighed, "row", "left").select(
        "doc_id",
        "n_a",
        "n_b",
        "n_groups",
        F.col("n_groups").alias("n_links"),
        F.coalesce("n_best", none).alias("n_best"),
        F.coalesce("count_sum", none).alias("count_sum"),
        "groups_sha256",
    )


def op13_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokenizers(table(spark, sf_dir, "documents"))
