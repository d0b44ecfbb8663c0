import random

import numpy as np
import pytest

from copycensus.llm import toxicity

from .helpers import documents, rows_of, words

STEMS = ("vequ", "lowei", "chlla")
ENDINGS = ("ta", "ron", "is", "um", "ette", "ling", "o", "aire", "son", "ix")


def corpus(n, seed):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        made = words(rng, rng.randint(5, 200), 3000)
        toxic = rng.random() < 0.2
        if toxic:
            for _ in range(max(2, len(made) // 40)):
                made.insert(rng.randrange(len(made)), rng.choice(STEMS) + rng.choice(ENDINGS))
        rows.append((" ".join(made).upper() if rng.random() < 0.1 else " ".join(made), int(toxic)))
    return rows


def test_held_out_documents(spark):
    rows = corpus(1600, 1)
    docs = documents(spark, [*(t for t, _ in rows), None, "", "12 34"], [*range(len(rows) - 1), 5, 9001, 9002, None], clashing=True)
    labels = spark.createDataFrame([(k, t, 1) for k, (_, t) in enumerate(rows[:900])] + [(None, 1, 1), (3, None, 1)], "doc_id BIGINT, toxic INT, quality INT")
    model = toxicity.train(docs, labels)
    assert model.thresholds == sorted(model.thresholds) and len(model.thresholds) == 2
    got = [(model.chances(t)[0] > 0.5, bool(y)) for t, y in rows[900:]]
    assert sum(a and b for a, b in got) >= 0.97 * sum(b for _, b in got)
    assert sum(a and not b for a, b in got) <= 0.01 * sum(not b for _, b in got)
    all_found = toxicity.toxicity(docs, model).collect()
    found = {r.doc_id: r for r in all_found}
    assert len(all_found) == len(rows) + 3
    for k in (7, 1000):
        chances = model.chances(rows[k][0])
        assert found[k].severity == pytest.approx(sum(chances)) and found[k].toxic == (chances[0] > 0.5)
    assert not found[9001].toxic and found[9001].severity == found[9002].severity == found[None].severity
    # Each row goes or stays by its own text, so of two rows that share a doc_id one may go.
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns
    own = [(r.doc_id, r.text) for r in docs.collect() if model.chances(r.text or "")[0] <= 0.5]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted(own, key=repr)
    assert len(own) == len(all_found) - sum(r.toxic for r in all_found) < len(all_found)


def test_ordinal_fit_shares_weights():
    rng = np.random.default_rng(2)
    rows = [rng.choice(6, rng.integers(0, 5), replace=False) for _ in range(3000)]
    true = np.array([2.0, -1.5, 1.0, 0.0, 3.0, 0.5])
    score = np.array([true[r].sum() for r in rows]) + rng.logistic(size=3000)
    grades = (score > 1).astype(int) + (score > 3)
    weights, thresholds = toxicity.fit(rows, grades, 6)
    assert np.abs(weights - true).max() < 0.35
    assert np.abs(thresholds - [1, 3]).max() < 0.3


def test_without_labels_and_documents(spark):
    none = spark.createDataFrame([], "doc_id BIGINT, toxic INT, quality INT")
    docs = documents(spark, ["one text", None])
    assert rows_of(toxicity.toxicity(docs, toxicity.train(docs, none)), "doc_id", "severity", "toxic") == [(0, 0.0, False), (1, 0.0, False)]
    empty = documents(spark, [])
    assert toxicity.drop_toxic(empty, none).count() == 0
