"""Token alignment against whole encodings by the libraries and sets of byte offsets."""

import hashlib
import random
import re
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from copycensus import workspace
from copycensus.llm import alignment

from .helpers import documents, rows_of

COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def byte_of():
    """The byte-level characters, by the rule that the unprintable bytes follow from U+0100 on."""
    shown = [b for b in range(256) if chr(b).isprintable() and not chr(b).isspace() and b != 0xAD]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


def groups_of(libraries, text):
    """Lists of ids of A and B of each group; None where the bytes are not given back."""
    a_lib, b_lib = libraries
    table = byte_of()
    a = a_lib.encode(" " + text, add_special_tokens=False).ids
    b = b_lib.encode(text)
    a_bytes = [bytes(table[c] for c in a_lib.id_to_token(i)) for i in a]
    pieces = [b_lib.id_to_piece(i) for i in b]
    b_bytes = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in pieces]
    want = (" " + text).encode()
    if not text or b"".join(a_bytes) != want or b"".join(b_bytes) != want:
        return None

    def ends(parts):
        n, out = 0, []
        for p in parts:
            n += len(p)
            out.append(n)
        return out

    ends_a, ends_b = ends(a_bytes), ends(b_bytes)
    both, groups = sorted(set(ends_a) & set(ends_b)), []
    low = 0
    for high in both:
        groups.append(([i for i, e in zip(a, ends_a) if low < e <= high], [i for i, e in zip(b, ends_b) if low < e <= high]))
        low = high
    return groups


def brute(libraries, ids, texts):
    found = [groups_of(libraries, t) if t else None for t in texts]
    counts = Counter((a[-1], b[-1]) for g in found if g for a, b in g)
    most = {}
    for (_, b), n in counts.items():
        most[b] = max(n, most.get(b, 0))
    rows = []
    for i, g in zip(ids, found):
        if not g:
            rows.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        links = [(a[-1], b[-1]) for a, b in g]
        shown = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in g)
        best = sum(counts[x] == most[x[1]] for x in links)
        sizes = (sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(links))
        rows.append((i, *sizes, best, sum(counts[x] for x in links), hashlib.sha256(shown.encode()).hexdigest()))
    return sorted(rows, key=repr)


def odd_texts(n, seed=4):
    rng = random.Random(seed)
    alphabet = "ab cdeäöé   \n\t\r0159thinger'sll执行𝔘가나다 .,!?-_()<>/ \xa0\x1c\x85　​́"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 40))) for _ in range(n)]
    texts += [" ", "  ", "a ", " a", "\n", "a▁b", "▁", "<|endoftext|> x", "<s></s><unk><0x0A>", "\0", "x" * 2000, " " * 70, "a  b   c    d"]
    return texts


@pytest.mark.parametrize("part_chars, remembered", [(1 << 20, 10_000), (1, 3), (5, 0)])
def test_tokens_are_those_of_the_libraries(libraries, part_chars, remembered, monkeypatch):
    monkeypatch.setattr(alignment, "SLICE", 3)
    both = alignment.Aligner(part_chars=part_chars, remembered=remembered)
    assert both.by_parts
    texts = odd_texts(2500)
    for text, (a, b), found in zip(texts, both.tokens(texts), both.align(texts)):
        want = groups_of(libraries, text)
        if want is None:
            assert not len(a) and not len(b) and "▁" in text, repr(text)
            continue
        assert a.tolist() == [i for g, _ in want for i in g] and b.tolist() == [i for _, g in want for i in g], repr(text)
        n_a, n_b, sha, links = found
        shown = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in want)
        assert sha == hashlib.sha256(shown.encode()).hexdigest(), repr(text)
        assert links.tolist() == [[x[-1], y[-1]] for x, y in want]
    assert len(both.windows) <= remembered


def test_whole_encoding_where_pieces_cross_words(libraries):
    both = alignment.Aligner(part_chars=1)
    both.by_parts = False
    for text in odd_texts(300, 9):
        want = groups_of(libraries, text)
        assert both.tokens([text])[0][1].tolist() == ([i for _, g in want for i in g] if want else [])


def test_windows_are_remembered_by_ids():
    both = alignment.Aligner()
    both.align(["one two three one two three"])
    assert len(both.windows) == 3
    assert both.anchors(*both.tokens(["one two"])[0])[0].tolist() == [0, 1, 2]


@pytest.mark.parametrize("broadcast_pairs", [1_000_000, 40, 1])
def test_documents(spark, libraries, broadcast_pairs):
    rng = random.Random(8)
    texts = [None, "", *odd_texts(60, 2), *[" ".join(rng.choices(["the", "of", "Überzug", "naïve", "xq42", "re-use,"], k=rng.randint(1, 30))) for _ in range(40)]]
    ids = [*range(len(texts) - 3), 4, None, None]
    docs = documents(spark, texts, ids, clashing=True).repartition(3)
    got = alignment.align_tokenizers(docs, broadcast_pairs=broadcast_pairs)
    assert rows_of(got, *COLUMNS) == brute(libraries, ids, texts)


def test_counts_of_links(spark, libraries):
    docs = documents(spark, ["the the of", "of the", "xq the"])
    aligned = workspace.snapshot(alignment.align_documents(docs), "aligned")
    got = {(r.a, r.b): r.n for r in alignment.link_counts(aligned).collect()}
    want = Counter((a[-1], b[-1]) for t in ("the the of", "of the", "xq the") for a, b in groups_of(libraries, t))
    assert got == dict(want)


def test_empty_tables(spark):
    assert alignment.align_tokenizers(documents(spark, [])).count() == 0
    assert rows_of(alignment.align_tokenizers(documents(spark, [None, ""])), *COLUMNS) == [(0, 0, 0, 0, 0, 0, 0, ""), (1, 0, 0, 0, 0, 0, 0, "")]
