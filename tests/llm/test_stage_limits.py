"""The limit of the near-copy stage, which is lower than that of operator 5's query."""

import random

import corpus_pipeline
from copycensus.llm import near_dedup

from .helpers import documents, words
from .test_near_dedup import COLUMNS, expected, near_copies, rows_of, shingles


def test_stage_links_from_080_on(spark):
    rng, texts = random.Random(8), []
    for size in (104, 404, 2004):
        base = words(rng, size, 1 << 30)
        texts += [" ".join(base + words(rng, new, 1 << 30)) for new in (0, (size - 4) // 5, (size - 4) // 3)]
    for k in (0, 3, 6):
        a, b, c = map(shingles, texts[k : k + 3])
        assert 0.8 <= len(a & b) / len(a | b) < 0.85 and max(len(x & c) / len(x | c) for x in (a, b)) < 0.8
    texts += [" ".join(words(rng, 50, 1 << 30))]
    docs = documents(spark, texts, clashing=True)
    kept = corpus_pipeline.dissimilar_documents(spark, docs, "")
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2, 3, 5, 6, 8, 9]


def test_against_brute_force_at_080(spark):
    texts = near_copies(2)
    ids = list(range(len(texts)))
    got = near_dedup.near_duplicates(documents(spark, texts, ids), 80)
    assert rows_of(got, *COLUMNS) == expected(ids, texts, 80)


def test_constants_follow_the_limit():
    assert near_dedup.band_shape(85) == (36, 7) and near_dedup.most_bits(85) == 45
    assert near_dedup.band_shape(80) == (35, 5) and near_dedup.most_bits(80) == 55
    for percent in (60, 70, 80, 85, 90, 95, 99, 100):
        bands, rows = near_dedup.band_shape(percent)
        assert bands * rows <= near_dedup.BUCKETS and (1 - (percent / 100) ** rows) ** bands <= 1e-6
