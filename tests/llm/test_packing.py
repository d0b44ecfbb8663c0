import random
import zlib
from bisect import bisect_left, insort
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from copycensus import workspace
from copycensus.llm import packing
from copycensus.llm.tokens import encoder

from .helpers import documents


def best_fit(counts, capacity):
    rooms, n = [], 0
    for s in sorted(counts, reverse=True):
        for _ in range(counts[s]):
            i = bisect_left(rooms, s)
            room = capacity if i == len(rooms) else rooms.pop(i)
            n += room == capacity and i == len(rooms)
            insort(rooms, room - s)
    return n


def check_plan(counts, capacity, bins):
    seen = Counter()
    ranks = {s: [] for s in counts}
    for b in bins:
        assert sum(s * copies for s, copies, _ in b.slots) == capacity - b.room and b.room >= 0 and b.count > 0
        for s, copies, rank in b.slots:
            seen[s] += copies * b.count
            ranks[s].append((rank, rank + copies * b.count))
    assert seen == Counter({s: n for s, n in counts.items() if n})
    for s, spans in ranks.items():
        spans.sort()
        assert [a for a, _ in spans] == [0, *(b for _, b in spans)][: len(spans)]


@pytest.mark.parametrize("seed", range(8))
def test_plan_places_every_piece_in_few_bins(seed):
    rng = random.Random(seed)
    capacity = rng.choice([16, 100, 2048])
    lengths = [rng.randint(1, capacity) for _ in range(rng.choice([1, 5, 60, 400]))]
    counts = {s: rng.choice([1, 3, 50, 5000]) for s in lengths}
    bins = packing.plan(counts, capacity)
    check_plan(counts, capacity, bins)
    used = sum(b.count for b in bins)
    assert used <= best_fit(Counter({s: min(n, 50) for s, n in counts.items()}), capacity) * 1.02 + 3 or max(
        counts.values()
    ) > 50
    assert used >= -(-sum(s * n for s, n in counts.items()) // capacity)


def test_plan_of_a_hot_length_grows_with_the_lengths_only():
    counts = {s: 10**9 for s in range(1, 2049, 7)}
    bins = packing.plan(counts)
    check_plan(counts, 2048, bins)
    assert len(bins) < 6000
    assert sum(b.count for b in bins) <= sum(s * n for s, n in counts.items()) / 2048 * 1.01


def test_plan_without_pieces():
    assert packing.plan({}) == []


def test_ids_are_those_of_the_tokenizers_library():
    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(1)
    alphabet = "ab zé漢字🙂\n\t '0123.,<|endoftext|>"
    for special in (True, False):
        exact.encode_special_tokens = not special
        for _ in range(400):
            text = "".join(rng.choice([*alphabet, "<|endoftext|>"]) for _ in range(rng.randint(0, 40)))
            assert encoder(special=special)(text) == exact.encode(text, add_special_tokens=False).ids


def test_documents_against_brute_force(spark):
    rng = random.Random(2)
    texts = [None, "", "", "a", "<|endoftext|>"] + ["same length of text"] * 60
    texts += [" ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(rng.randint(1, 90))) for _ in range(120)]
    texts.append(" ".join(f"n{k}" for k in range(900)))
    ids = [*range(len(texts) - 2), 7, None]
    docs = documents(spark, texts, ids, clashing=True)
    capacity = 64
    got = packing.pack_documents(docs, capacity).collect()
    encode, want = encoder(), Counter()
    for doc_id, text in zip(ids, texts, strict=True):
        tokens = [*encode(text or ""), 0]
        starts = [0, *range(len(tokens) % capacity or capacity, len(tokens), capacity)]
        for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(tokens)], strict=True)):
            want[doc_id, k, a, b - a, zlib.crc32(np.array(tokens[a:b], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    filled = {}
    for r in got:
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in filled.values():
        spans.sort()
        assert [a for a, _ in spans] == list(np.cumsum([0, *(n for _, n in spans)])[:-1])
        assert spans[-1][0] + spans[-1][1] <= capacity
    total = sum(r.length for r in got)
    assert -(-total // capacity) <= len(filled) <= total / capacity * 1.03 + 2


def test_sequences_hold_the_ids_of_their_pieces(spark):
    docs = documents(spark, [f"text number {k} " * (k % 9) for k in range(40)])
    pieces = workspace.snapshot(packing.token_pieces(docs, 32), "pieces")
    places = packing.pack(workspace.snapshot(pieces.drop("ids"), "narrow"), 32)
    ids = {(r.doc_id, r.piece): r.ids for r in pieces.collect()}
    want = {}
    for r in sorted(places.collect(), key=lambda r: r.offset):
        want[r.sequence_id] = want.get(r.sequence_id, b"") + ids[r.doc_id, r.piece]
    got = packing.sequences(pieces, places).collect()
    assert {r.sequence_id: bytes(r.ids) for r in got} == {k: bytes(v) for k, v in want.items()}
    assert all(r.length * 4 == len(r.ids) for r in got)


def test_sequences_hold_rows_with_repeated_and_no_ids(spark):
    texts = [f"text number {k} " * (k % 5) for k in range(30)] + ["again and again"] * 6
    docs = documents(spark, texts, [None if k % 3 == 0 else k % 4 for k in range(36)])
    pieces = workspace.snapshot(packing.token_pieces(docs, 32), "pieces")
    packed = workspace.snapshot(packing.pack(pieces, 32), "packed")
    rows = packed.collect()
    assert sorted(bytes(r.ids) for r in rows) == sorted(bytes(r.ids) for r in pieces.collect())
    want = {}
    for r in sorted(rows, key=lambda r: r.offset):
        want[r.sequence_id] = want.get(r.sequence_id, b"") + bytes(r.ids)
    got = packing.sequences(packed).collect()
    assert {r.sequence_id: bytes(r.ids) for r in got} == want
    assert all(r.length * 4 == len(r.ids) and r.length <= 32 for r in got)


def test_empty_table(spark):
    assert packing.pack_documents(documents(spark, [])).count() == 0
    assert packing.token_pieces(documents(spark, [])).filter(F.lit(True)).count() == 0
