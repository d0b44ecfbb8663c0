"""Token counts and pieces."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from copycensus import workspace
from copycensus.llm import pieces, token_counts
from copycensus.llm.tokens import encoder

from .helpers import documents, rows_of

TEXTS = ["one two three", None, "", "x" * 5000, "<|endoftext|>", "é🙂 漢字", *(f"text {k} " * (k % 13) for k in range(60))]


@pytest.mark.parametrize("block_bytes", [6, 1 << 20])
def test_counts_for_any_block_size(spark, block_bytes):
    texts = TEXTS
    ids = [*range(len(texts) - 2), 3, None]
    docs = documents(spark, texts, ids, clashing=True)
    folder = workspace.scratch_path(spark, "files")
    got = token_counts.count_tokens(docs, folder, block_bytes=block_bytes)
    encode = encoder(special=False)
    assert rows_of(got, "doc_id", "n_tokens") == sorted(((i, len(encode(t or ""))) for i, t in zip(ids, texts, strict=True)), key=repr)


def test_files_of_others(spark, tmp_path):
    rng = np.random.default_rng(1)
    want = []
    for name in ("a", "b", "open", "none", "empty"):
        ids = rng.integers(0, 7, 3000 if name != "empty" else 0).astype("<u4")
        if name == "none":
            ids[:] = 5
        elif name in ("a", "b"):
            ids[-1] = 0
        ids.tofile(tmp_path / name)
        lengths, n = [], 0
        for x in ids:
            n += 1
            if x == 0:
                lengths.append((n - 1, True))
                n = 0
        if n:
            lengths.append((n, False))
        want += [(name, k, length, complete) for k, (length, complete) in enumerate(lengths)]
    files = spark.createDataFrame([(x,) for x in ("a", "b", "open", "none", "empty")], "file STRING")
    got = token_counts.scan_token_files(files, f"file://{tmp_path}", end=0, width=4, block_bytes=40)
    assert rows_of(got, "file", "ordinal", "n_tokens", "complete") == sorted(want, key=repr)


def test_counts_of_an_empty_table(spark):
    assert token_counts.count_tokens(documents(spark, []), workspace.scratch_path(spark, "files")).count() == 0


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def test_pieces_are_those_of_the_library(library):
    model = pieces.transducer()
    rng = random.Random(3)
    alphabet = "ab cdeäöé▁▁  \n\t0159thinger执行𝔘가나다 .,!?-_()<>/s"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(15_000)]
    texts += [" " * k + "x" + " " * (k % 7) for k in range(60)]
    texts += ["a" * 3000, "ab" * 2000, "é" * 500, "\n" * 300, "=" * 200, "aaa" * 50 + "bbb" * 40, "\0", "<s></s><unk><0x0A>"]
    for text, want in zip(texts, library.encode(texts), strict=True):
        ids = model.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == want
        assert model.decode(ids) == library.decode(want)


def test_only_one_path_has_a_finite_weight():
    """All ways to cut a word into pieces: one has compatible neighbours, and it is what merging gives."""
    model = pieces.transducer()

    def paths(word):
        if not word:
            yield []
        for k in range(1, len(word) + 1):
            if word[:k] in model.ids:
                yield from ([word[:k], *rest] for rest in paths(word[k:]))

    for word in ("▁the", "▁there", "▁Einheit", "tionn", "▁▁▁a", "ererer"):
        finite = []
        for path in paths(word):
            alone = all(len(p) == 1 or model.merged(p) == [p] for p in path)
            if alone and all(model.compatible(a, b) for a, b in zip(path, path[1:])):
                finite.append(path)
        assert finite == [model.merged(word)] == [model.shortest_path(word)]


def test_piece_tables(spark, library):
    texts = [*TEXTS[:30], "a ▁b", " lead", "trail "]
    ids = [*range(len(texts) - 2), 3, None]
    docs = documents(spark, texts, ids, clashing=True)
    got = pieces.decode_pieces(pieces.encode_pieces(docs)).collect()
    want = [(i, zlib.crc32(np.array(library.encode(t or ""), "<u4").tobytes()), (t or "").replace("▁", " ")) for i, t in zip(ids, texts, strict=True)]
    assert sorted(((r.doc_id, zlib.crc32(r.ids), r.text) for r in got), key=repr) == sorted(want, key=repr)
    assert pieces.decode_pieces(pieces.encode_pieces(documents(spark, []))).count() == 0
