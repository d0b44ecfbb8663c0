"""Encoding and decoding with a SentencePiece model, as a weighted finite-state transducer.

The model file is compiled once per Python process:

* the normaliser maps a space to the word mark and puts one mark before a text,
* the piece transducer is a trie that reads characters and writes the id of a piece,
* byte fallback reads a character that no piece holds and writes its UTF-8 bytes' ids,
* an adjacency acceptor gives a pair of neighbouring pieces the weight 0 if merging their characters by
  the model's priorities gives just these two, and infinity if not.

Composed with a text they make a lattice. For a model of merges a path has a finite weight only if
all its neighbours are compatible, and exactly one path has, the one that merging the whole text
gives: had any merge crossed the border of two pieces of it, it would cross it in those two alone, too.
So the shortest path needs one state per position, the last piece of the best path to it. No piece goes
on after the end of a word, so each word mark with what follows it is a lattice of its own; equal ones
are solved once per process.

Defined results: a null text is empty; an empty text has no ids and decodes to an empty text. A word
mark in the text itself decodes to a space. Rows that repeat a doc_id, or have none, come back each.
An empty table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

import heapq
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from copycensus.llm.common import table, text_or_empty, worker_memory

MARK = "▁"
MODEL = "piece_bpe_32k.model"
KEPT_WORDS = 400_000

# Fixed values of the model format: types of pieces.
NORMAL, USER, UNUSED, BYTE = 1, 4, 5, 6

_WORD = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


# ---- the model file ----------------------------------------------------------------------------


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The fields of a message in the wire format of the model file."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
        else:
            n = {1: 8, 5: 4}.get(key & 7) or number()
            yield key >> 3, data[at : at + n]
            at += n


def read_model(path: str) -> tuple[list[tuple[str, float, int]], dict[int, int | bytes]]:
    """The pieces (text, score, type) in the order of their ids, and the fields of the normaliser."""
    with open(path, "rb") as f:
        data = f.read()
    pieces, normaliser = [], {}
    for number, value in _fields(data):
        if number == 1:
            piece = dict(_fields(value))
            score = struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0
            pieces.append((piece[1].decode(), score, piece.get(3, NORMAL)))
        elif number == 3:
            normaliser = dict(_fields(value))
    return pieces, normaliser


# ---- the transducers ---------------------------------------------------------------------------


@dataclass
class Transducer:
    ids: dict[str, int]
    score: dict[str, float]
    byte_ids: list[bytes]  # as written, like id_bytes
    texts: list[bytes]  # of each id, what decoding writes
    trie: dict = field(default_factory=dict)
    made: dict[str, int] = field(default_factory=dict)  # rank of the merge that makes a piece, -1 for characters
    halves: dict[str, tuple[str, str]] = field(default_factory=dict)  # the two parts of that merge
    fits: dict[tuple[str, str], bool] = field(default_factory=dict)
    words: dict[str, bytes] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for piece in self.ids:
            node = self.trie
            for char in piece:
                node = node.setdefault(char, {})
            node[""] = piece
        self.id_bytes = {p: struct.pack("<I", k) for p, k in self.ids.items()}
        ranked = sorted((-s, p) for p, s in self.score.items())
        self.rank = {p: k for k, (_, p) in enumerate(ranked)}
        for piece in self.ids:
            self.made[piece] = -1 if len(piece) == 1 else self.rank[piece]
            if len(piece) > 1 and MARK + MARK not in piece and len(halves := self.merged(piece, stop=piece)) == 2:
                self.halves[piece] = tuple(halves)

    def merged(self, text: str, stop: str | None = None) -> list[str]:
        """Merging the neighbours of the best score, the first of equals, until none make a piece, or
        until the next one would make ``stop``."""
        left = list(range(-1, len(text) - 1))
        right = [*range(1, len(text)), -1]
        part: list[str | None] = list(text)
        score = self.score
        heap = [(-score[p], i, p) for i in range(len(text) - 1) if (p := text[i : i + 2]) in score]
        heapq.heapify(heap)
        while heap:
            _, i, piece = heapq.heappop(heap)
            j = right[i] if part[i] is not None else -1
            if j < 0 or part[i] + part[j] != piece:
                continue
            if piece == stop:
                break
            part[i], part[j] = piece, None
            right[i] = right[j]
            if right[i] >= 0:
                left[right[i]] = i
                if (p := piece + part[right[i]]) in score:
                    heapq.heappush(heap, (-score[p], i, p))
            if left[i] >= 0 and (p := part[left[i]] + piece) in score:
                heapq.heappush(heap, (-score[p], left[i], p))
        return [p for p in part if p is not None]

    def compatible(self, a: str, b: str) -> bool:
        """The weight of two neighbours is finite: no merge crosses their border.

        Going back in time, the later made of the two is split, until the border stands between two
        characters. A merge across it must not come before the one that made what stands there now; of
        equal merges the left one comes first. Runs of marks all have one score, so they are merged.
        """
        known = self.fits.get((a, b))
        if known is None:
            if len(self.fits) > 2 * KEPT_WORDS:
                self.fits.clear()
            known = self.fits[a, b] = self._compatible(a, b)
        return known

    def _compatible(self, a: str, b: str) -> bool:
        if (a[-1] == MARK and b[0] == MARK) or a[:2] == MARK + MARK:
            return self.merged(a + b) == [a, b]
        rank, made, halves, limit = self.rank, self.made, self.halves, 1 << 60
        if any(len(p) > 1 and p not in halves for p in (a, b)):
            return False  # merging never makes this piece
        while True:
            if rank.get(a + b, limit) < limit:
                return False
            of_a, of_b = made.get(a, -1), made.get(b, -1)
            if of_a > of_b:
                limit, a = of_a, halves[a][1]
            elif of_b < 0:
                return True
            else:
                limit, b = of_b + 1, halves[b][0]

    def shortest_path(self, word: str) -> list[str]:
        """The pieces and unknown characters on the only path of finite weight."""
        n = len(word)
        last: list[str | None] = [None] * (n + 1)
        fits, trie, halves, compatible = self.fits, self.trie, self.halves, self.compatible
        for i in range(n):
            before = last[i]
            if i and before is None:
                continue  # no finite path ends here
            node = trie.get(word[i])
            if node is None:
                last[i + 1] = word[i]  # by bytes; no merge holds it, so all neighbours are compatible
                continue
            j = i + 1
            while node is not None:
                piece = node.get("")
                if piece is None and j == i + 1:
                    piece = word[i]  # a character of pieces, that is none itself
                if piece is not None and last[j] is None:
                    if not i:
                        ok = j == 1 or piece in halves or (piece[:2] == MARK + MARK and self.merged(piece) == [piece])
                    else:
                        ok = fits.get((before, piece))
                        if ok is None:
                            ok = compatible(before, piece)
                    if ok:
                        last[j] = piece
                if j == n:
                    break
                node = node.get(word[j])
                j += 1
        path, at = [], n
        while at:
            path.append(last[at])
            at -= len(last[at])
        return path[::-1]

    def encode_word(self, word: str) -> bytes:
        ids, byte_ids = self.id_bytes, self.byte_ids
        return b"".join([ids.get(p) or b"".join([byte_ids[b] for b in p.encode()]) for p in self.shortest_path(word)])

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        known, out = self.words, []
        for word in _WORD.findall(MARK + text.replace(" ", MARK)):
            ids = known.get(word)
            if ids is None:
                ids = self.encode_word(word)
                if len(known) < KEPT_WORDS and len(word) < 64:
                    known[word] = ids
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        texts = self.texts
        text = b"".join([texts[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def transducer(path: str | None = None) -> Transducer:
    memory = worker_memory()
    if ("pieces", path) not in memory:
        import public_tokenizers

        pieces, normaliser = read_model(path or public_tokenizers.path(MODEL))
        if normaliser.get(2):
            raise ValueError("the model's normaliser rewrites characters, which this transducer does not")
        usable = (NORMAL, USER, UNUSED)
        ids = {text: k for k, (text, _, kind) in enumerate(pieces) if kind in usable}
        byte_ids, texts = [b""] * 256, []
        for k, (text, _, kind) in enumerate(pieces):
            if kind == BYTE:
                byte_ids[int(text[3:5], 16)] = struct.pack("<I", k)
                texts.append(bytes([int(text[3:5], 16)]))
            else:
                texts.append(text.replace(MARK, " ").encode() if kind in usable else b"")
        score = {text: pieces[k][1] for text, k in ids.items()}
        memory["pieces", path] = Transducer(ids, score, byte_ids, texts)
    return memory["pieces", path]


# ---- tables ------------------------------------------------------------------------------------


def encode_pieces(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = transducer(path)
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                ids = [model.encode(text.as_py()) for text in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    texts = docs.select(F.col("doc_id").cast("bigint"), text_or_empty("text"))
    return texts.mapInArrow(run, "doc_id BIGINT, ids BINARY")


def decode_pieces(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids, text of a table (doc_id, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = transducer(path)
        for batch in batches:
            texts = [model.decode(ids.as_py()) for ids in batch.column(1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=["doc_id", "ids", "text"])

    return encoded.select("doc_id", F.coalesce("ids", F.lit(b"")).alias("ids")).mapInArrow(
        run, "doc_id BIGINT, ids BINARY, text STRING"
    )


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_ids, ids_crc32 and the digest of the text that decoding gives."""
    decoded = decode_pieces(encode_pieces(table(spark, sf_dir, "documents")))
    return decoded.select(
        "doc_id",
        F.floor(F.octet_length("ids") / 4).cast("bigint").alias("n_ids"),
        F.crc32("ids").alias("ids_crc32"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )
