import hashlib
import random

import numpy as np
import pytest

from copycensus.llm import fingerprints as fp

from .helpers import documents


def text(rng, n):
    return "".join(rng.choice("abcdefgh ") for _ in range(n))


def phrases(value, levels):
    names = fp.mix(np.frombuffer(value.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1))
    counts = np.array([len(names)])
    for _ in range(levels):
        names, counts = fp.next_level(names, counts)
    return names


@pytest.mark.parametrize("level", [1, 2, 3])
def test_equal_substrings_share_their_inner_phrases(level):
    rng = random.Random(level)
    for _ in range(20):
        shared = text(rng, 4000)
        a = phrases(text(rng, rng.randint(0, 300)) + shared + text(rng, rng.randint(0, 300)), level)
        b = phrases(text(rng, rng.randint(0, 300)) + shared, level)
        inner = phrases(shared, level)[12:-12]
        assert len(inner) > 20
        joined = inner.tobytes()
        assert joined in a.tobytes() and joined in b.tobytes()


def test_texts_are_parsed_each_for_itself():
    rng = random.Random(7)
    texts = [text(rng, rng.choice([0, 1, 2, 3, 10, 500])) for _ in range(60)] + ["aaaa", "a" * 3000, "ab" * 900, ""]
    together = [str(f) for f in fp.fingerprints(texts)]
    assert together == [str(fp.fingerprints([t])[0]) for t in texts]
    assert len({*together}) == len({*texts})
    assert all(str(fp.read(f)) == f for f in together)


def test_likeness():
    rng = random.Random(8)
    for n in (30, 200, 3000, 60_000):
        a = text(rng, n)
        b = fp.edited(a, text(rng, n))
        x, y, z = fp.fingerprints([a, b, text(rng, n)])
        assert fp.likeness(x, x) == 1 and fp.likeness(x, y) == fp.likeness(y, x)
        assert 0.45 < fp.likeness(x, y) < 0.95
        assert fp.likeness(x, z) < 0.4 if n < 100 else fp.likeness(x, z) < 0.2
    empty, other = fp.fingerprints(["", "some text"])
    assert fp.likeness(empty, empty) == 1 and fp.likeness(empty, other) == 0


@pytest.mark.parametrize("ids", ["plain", "odd"])
def test_next_documents_against_brute_force(spark, ids):
    rng = random.Random(9)
    texts = [text(rng, rng.choice([0, 3, 40, 400])) for _ in range(150)] + [None, "é🙂" * 30, "漢" * 41]
    keys = list(range(0, 3 * len(texts), 3))
    rng.shuffle(keys)
    if ids == "odd":
        keys[:6] = [None, None, 9, 9, 9, -5]
    docs = documents(spark, texts, keys, clashing=True)
    rows = sorted(((i is not None, i or 0, t or "", i) for i, t in zip(keys, texts, strict=True)), key=lambda r: r[:3])
    want = []
    for k, (_, _, t, i) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][2]
        cut = len(t) // 4
        new = t[: len(t) - cut] + following[:cut]
        a, b, c = fp.fingerprints([t, new, following])
        want.append((i, len(t), hashlib.sha256(new.encode()).hexdigest(), str(a), str(b), fp.likeness(a, b), fp.likeness(a, c)))
    got = fp.next_document_edits(docs).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_one_row_and_none(spark):
    one = fp.next_document_edits(documents(spark, ["abcdefgh"], [4])).collect()
    assert [(r.doc_id, r.edited_sha256) for r in one] == [(4, hashlib.sha256(b"abcdefab").hexdigest())]
    assert one[0].near_next == 1
    assert fp.next_document_edits(documents(spark, [])).count() == 0
    assert fp.fingerprint_table(documents(spark, ["a", None])).count() == 2
