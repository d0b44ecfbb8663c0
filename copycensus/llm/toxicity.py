"""Severity of toxic text by cumulative-link ordinal regression on sparse word features.

1. Features are the words of a text in lower case and the beginnings of words, so inflected forms of a
   stem share some. A sample of labelled documents, at most ``max_toxic`` and ``max_clean`` of each
   kind, the first by a hash of their id, tells how many toxic and clean ones hold each feature. The
   ``max_features`` features whose counts differ most (by the likelihood ratio) are used.
2. The labels have two values; the grades are 0 for clean text, 1 for toxic text and 2 for toxic text
   with more features of toxic text than half of the toxic sample has.
3. The model has one weight per feature, shared by all thresholds: the chance of grade k or more is the
   logistic function of the weighted features less threshold k. It is fitted on the sample.
4. Every whole text gets its expected severity, the sum of these chances over k, and is rejected if a
   grade of 1 or more is likelier than not.

Defined results: a null text is empty; a text without words has the severity of a text without features.
Without toxic labels, nothing is rejected and all severities are 0. Rows that repeat a doc_id or have
none are judged each for itself, by their text. An empty table gives no rows. Further columns are
ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from copycensus import workspace
from copycensus.llm.common import ids_tell_rows, keyed, node_id, table, text_or_empty, without_documents, without_rows

MAX_TOXIC, MAX_CLEAN, MAX_FEATURES = 4_000, 10_000, 20_000
LEAST_TEXTS = 3  # texts that hold a feature, for it to be used
LEAST_RATIO = 16.0  # likelihood ratio statistic
PREFIXES = (4, 5, 6)
GRADES = 2  # above 0

_WORD = re.compile(r"[^\W\d_]+")


def features(text: str) -> set[str]:
    """Words, and beginnings of longer words marked by a hyphen."""
    words = set(_WORD.findall(text.lower()))
    return words.union(*({w[:n] + "-" for w in words if len(w) > n} for n in PREFIXES))


# ---- the sample --------------------------------------------------------------------------------


def _sample(docs: DataFrame, labels: DataFrame, max_toxic: int, max_clean: int) -> DataFrame:
    """toxic, text of the sampled documents, each text once; stored."""
    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    toxic = known.filter("toxic = 1").orderBy(*order).limit(max_toxic)
    clean = known.filter("toxic = 0").orderBy(*order).limit(max_clean)
    chosen = workspace.snapshot(toxic.union(clean), "labelled")
    texts = docs.select("doc_id", text_or_empty("text").alias("text")).join(F.broadcast(chosen), "doc_id")
    return workspace.snapshot(texts.select("toxic", "text").dropDuplicates(), "sample")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """feature, toxic, clean: how many texts of a task hold a feature."""
    from collections import Counter

    def out(held: list[Counter]) -> pa.RecordBatch:
        names = list(held[0].keys() | held[1].keys())
        columns = [pa.array([held[k][x] for x in names], pa.int64()) for k in (1, 0)]
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *columns], names=["feature", "toxic", "clean"])

    held = [Counter(), Counter()]
    for batch in batches:
        for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            held[toxic].update(features(text.as_py()))
            if len(held[0]) + len(held[1]) > 500_000:
                yield out(held)
                held = [Counter(), Counter()]
    yield out(held)


def _chosen_features(sample: DataFrame, max_features: int) -> list[str]:
    counts = sample.mapInArrow(_counted, "feature STRING, toxic BIGINT, clean BIGINT")
    counts = counts.groupBy("feature").agg(F.sum("toxic").alias("a"), F.sum("clean").alias("b"))
    totals = sample.agg(F.sum("toxic").alias("toxic"), F.count(F.lit(1)).alias("n")).first()
    toxic, clean = totals["toxic"] or 0, totals["n"] - (totals["toxic"] or 0)
    if not toxic or not clean:
        return []

    def part(seen: str, share: float) -> str:
        return f"CASE WHEN {seen} > 0 THEN {seen} * ln({seen} / ((a + b) * {share!r})) ELSE 0 END"

    n = toxic + clean
    missing = [f"({toxic} - a)", f"({clean} - b)"]
    expected = f"({n} - a - b)"
    absent = " + ".join(
        f"CASE WHEN {m} > 0 THEN {m} * ln({m} / ({expected} * {share!r})) ELSE 0 END"
        for m, share in zip(missing, (toxic / n, clean / n), strict=True)
    )
    ratio = F.expr(f"2 * ({part('a', toxic / n)} + {part('b', clean / n)} + {absent})")
    best = counts.filter(F.col("a") + F.col("b") >= LEAST_TEXTS).withColumn("ratio", ratio)
    best = best.filter(F.col("ratio") >= LEAST_RATIO).orderBy(F.desc("ratio"), "feature").limit(max_features)
    return [r.feature for r in best.select("feature").collect()]  # at most max_features


# ---- the model ---------------------------------------------------------------------------------


@dataclass
class Severity:
    """Weights by feature, and the increasing thresholds of the grades from 1 on."""

    weights: dict[str, float]
    thresholds: list[float]

    def chances(self, text: str) -> list[float]:
        """Of each grade or more, from grade 1 on."""
        if not self.weights:
            return [0.0] * len(self.thresholds)
        score = sum(self.weights.get(x, 0.0) for x in features(text))
        return [1 / (1 + np.exp(min(t - score, 500.0))) for t in self.thresholds]


def fit(rows: list[np.ndarray], grades: np.ndarray, n_features: int, penalty: float = 3e-5, steps: int = 500):
    """Weights and thresholds by accelerated gradient descent on the penalised likelihood."""
    counts = np.array([len(r) for r in rows])
    at = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)
    row = np.repeat(np.arange(len(rows)), counts)
    k = int(grades.max())
    share = np.array([(grades >= g).mean() for g in range(1, k + 1)])
    theta = -np.log(share / (1 - share))
    gaps = np.log(np.maximum(np.diff(theta), 1e-2))
    params = np.concatenate((np.zeros(n_features), theta[:1], gaps))
    mean, square = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, steps + 1):
        w, first, gaps = params[:n_features], params[n_features], params[n_features + 1 :]
        theta = first + np.concatenate(([0.0], np.cumsum(np.exp(gaps))))
        score = np.bincount(row, w[at], len(rows))
        # Chance of grade k or more, with 1 before the first threshold and 0 after the last.
        tail = 1 / (1 + np.exp(np.clip(theta[:, None] - score, -500, 500)))
        full = np.concatenate((np.ones((1, len(rows))), tail, np.zeros((1, len(rows)))))
        slope = full * (1 - full)
        here = np.arange(len(rows))
        p = np.maximum(full[grades, here] - full[grades + 1, here], 1e-12)
        up, down = slope[grades, here] / p, slope[grades + 1, here] / p  # derivatives by the score
        by_score = -(up - down) / len(rows)
        by_theta = np.array([(up * (grades == g)).sum() - (down * (grades == g - 1)).sum() for g in range(1, k + 1)])
        by_theta = by_theta / len(rows)
        tails = by_theta[::-1].cumsum()[::-1]
        gradient = np.concatenate(
            (
                np.bincount(at, by_score[row], n_features) + penalty * w,
                tails[:1],
                tails[1:] * np.exp(gaps),
            )
        )
        mean = 0.9 * mean + 0.1 * gradient
        square = 0.999 * square + 0.001 * gradient**2
        params = params - 0.1 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    gaps = params[n_features + 1 :]
    theta = params[n_features] + np.concatenate(([0.0], np.cumsum(np.exp(gaps))))
    return params[:n_features], theta


def train(
    docs: DataFrame,
    labels: DataFrame,
    max_toxic: int = MAX_TOXIC,
    max_clean: int = MAX_CLEAN,
    max_features: int = MAX_FEATURES,
) -> Severity:
    sample = _sample(docs, labels, max_toxic, max_clean)
    names = _chosen_features(sample, max_features)
    if not names:
        return Severity({}, [0.0] * GRADES)
    number = {name: k for k, name in enumerate(names)}

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(number[x] for x in features(t.as_py()) if x in number) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found, pa.list_(pa.int32()))], names=["toxic", "features"]
            )

    kind = dict(sample.dtypes)["toxic"]
    # Bounded: max_toxic + max_clean rows of at most max_features numbers.
    table_ = sample.mapInArrow(held, f"toxic {kind}, features ARRAY<INT>").toArrow().combine_chunks()
    toxic = table_.column("toxic").to_numpy().astype(np.int64)
    rows = [np.array(r.as_py(), np.int64) for r in table_.column("features")]
    seen = np.zeros((2, len(names)))
    for t in (0, 1):
        part = [r for r, x in zip(rows, toxic, strict=True) if x == t]
        seen[t] = np.bincount(np.concatenate([*part, np.zeros(0, np.int64)]), minlength=len(names)) / max(1, len(part))
    marks = seen[1] > seen[0]
    strength = np.array([marks[r].sum() for r in rows])
    grades = np.where(toxic == 1, 1 + (strength > np.median(strength[toxic == 1])), 0)
    weights, thresholds = fit(rows, grades, len(names))
    return Severity({n: float(w) for n, w in zip(names, weights, strict=True) if w}, thresholds.tolist())


# ---- applying ----------------------------------------------------------------------------------


def toxicity(docs: DataFrame, model: Severity, limit: float = 0.5) -> DataFrame:
    """One row per document: doc_id, severity (0 to the highest grade), chance (of grade 1 or more), toxic."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.thresholds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Severity(*shared.value)
        for batch in batches:
            found = [model.chances(text.as_py()) for text in batch.column(1)]
            chance = np.array([c[0] for c in found], float)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([float(sum(c)) for c in found], pa.float64()), pa.array(chance), pa.array(chance > limit)],
                names=["doc_id", "severity", "chance", "toxic"],
            )

    doc_id, kind = node_id(docs)
    texts = docs.select(doc_id, text_or_empty("text"))
    return texts.mapInArrow(run, f"doc_id {kind}, severity DOUBLE, chance DOUBLE, toxic BOOLEAN")


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows that are not rejected, with all their columns; each is judged by its own text."""
    known = ids_tell_rows(docs)
    found = toxicity(docs if known else keyed(docs), train(docs, labels)).filter("toxic").select("doc_id").distinct()
    return (without_documents if known else without_rows)(docs, workspace.snapshot(found, "toxic"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity(docs, train(docs, table(spark, sf_dir, "labels")))
