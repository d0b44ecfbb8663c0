"""Interpolated modified Kneser-Ney models over characters: counted, trained and applied by joins.

A token is a character, and every code point is one of its own. A text begins with three start
tokens, so each of its characters is predicted from the three before it. An n-gram has two columns:
``ctx`` packs the tokens before the last by 21 bits each, and ``token`` is the last. Its context is
``ctx`` and its suffix a mask of it.

Counts are folded inside each task and then by key. All tables of a model are keyed by language and
n-gram, so joins with them are spread by both. Their size follows the number of different n-grams and
not the amount of text. A table of at most ``BROADCAST_ROWS`` rows, which is counted first, is
broadcast; a larger one is joined by a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from copycensus import workspace

ORDER = 4
BITS = 21  # the greatest code point is 0x10FFFF
NARROW_BITS = 16  # four of these, one n-gram of code points below 0x10000, fit into 64 bits
BROADCAST_ROWS = 2_000_000
FOLD_KEYS = 1 << 20
NO_GRAMS = (np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def _packed(codes: np.ndarray, bits: int, tokens: int) -> np.ndarray:
    """The first ``tokens`` tokens of the n-gram that ends at each character of a text."""
    padded = np.concatenate((np.zeros(ORDER - 1, np.uint64), codes.astype(np.uint64)))
    keys = np.zeros(len(codes), np.uint64)
    for k in range(tokens):
        keys = keys << np.uint64(bits) | padded[k : k + len(codes)]
    return keys


def distinct_grams(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ctx, token, n: each different n-gram of some texts (code points) and how often it occurs."""
    if all(codes.max(initial=0) >> NARROW_BITS == 0 for codes in texts):
        keys, n = np.unique(np.concatenate([_packed(c, NARROW_BITS, ORDER) for c in texts]), return_counts=True)
        part = np.uint64((1 << NARROW_BITS) - 1)
        ctx = np.zeros(len(keys), np.uint64)
        for k in range(ORDER - 1, 0, -1):
            ctx = ctx << np.uint64(BITS) | (keys >> np.uint64(NARROW_BITS * k) & part)
        return ctx.astype(np.int64), (keys & part).astype(np.int32), n
    ctx = np.concatenate([_packed(c, BITS, ORDER - 1) for c in texts])
    token = np.concatenate(texts)
    order = np.lexsort((token, ctx))
    ctx, token = ctx[order], token[order]
    first = np.flatnonzero(np.r_[True, (ctx[1:] != ctx[:-1]) | (token[1:] != token[:-1])])
    return ctx[first].astype(np.int64), token[first].astype(np.int32), np.diff(first, append=len(ctx))


def suffix(ctx: Column, order: int) -> Column:
    """The context of an n-gram's last ``order`` tokens."""
    return ctx.bitwiseAND(F.lit((1 << BITS * (order - 1)) - 1))


# ---- counting ----------------------------------------------------------------------------------


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the n-grams of each language over many texts."""

    def out(lang: str, parts: list[np.ndarray]) -> pa.RecordBatch:
        ctx, token, n = distinct_grams(parts)
        langs = pa.DictionaryArray.from_arrays(np.zeros(len(ctx), np.int32), pa.array([lang])).cast(pa.string())
        columns = [langs, pa.array(ctx), pa.array(token), pa.array(n, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["lang", "ctx", "token", "c"])

    held: dict[str, list[np.ndarray]] = {}
    size: dict[str, int] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            codes = _codes(text.as_py())
            if not len(codes):
                continue
            held.setdefault(lang, []).append(codes)
            size[lang] = size.get(lang, 0) + len(codes)
            if size[lang] > FOLD_KEYS:
                yield out(lang, held.pop(lang))
                del size[lang]
    for lang, parts in held.items():
        yield out(lang, parts)


def counts(texts: DataFrame) -> DataFrame:
    """lang, ctx, token, c of a table (lang, text) without nulls; stored."""
    found = texts.select("lang", "text").mapInArrow(_folded, "lang STRING, ctx BIGINT, token INT, c BIGINT")
    return workspace.snapshot(found.groupBy("lang", "ctx", "token").agg(F.sum("c").alias("c")), "ngrams")


def bags(texts: DataFrame) -> DataFrame:
    """doc_id, lang, ctx, token, n: how often each n-gram occurs in each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "lang", "ctx", "token", "n"]
        for batch in batches:
            rows, held = [], 0
            at = 0
            for text in batch.column(2):
                rows.append(distinct_grams([_codes(text.as_py())]) if len(text.as_py()) else NO_GRAMS)
                held += len(rows[-1][0])
                if held > 1 << 19 or at + len(rows) == batch.num_rows:
                    take = np.repeat(np.arange(at, at + len(rows)), [len(ctx) for ctx, _, _ in rows])
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).take(pa.array(take)),
                            batch.column(1).take(pa.array(take)),
                            *(pa.array(np.concatenate(column)) for column in zip(*rows, strict=True)),
                        ],
                        names=names,
                    )
                    at += len(rows)
                    rows, held = [], 0

    kind = dict(texts.dtypes)["doc_id"]
    return texts.select("doc_id", "lang", "text").mapInArrow(run, f"doc_id {kind}, lang STRING, ctx BIGINT, token INT, n BIGINT")


# ---- training ----------------------------------------------------------------------------------


@dataclass
class Model:
    """Stored tables: p[k] (lang, ctx, token, p) for seen n-grams of k tokens, g[k] (lang, ctx, g) for their
    contexts of k tokens, and p[0] (lang, p), the probability of a character that was never seen."""

    p: list[DataFrame]
    g: list[DataFrame]
    broadcast: bool


def _discounts(level: DataFrame) -> DataFrame:
    """lang, d1, d2, d3: the discounts of modified Kneser-Ney from the counts of counts."""
    n = level.groupBy("lang").agg(
        *(F.sum((F.col("c") == k).cast("double")).alias(f"n{k}") for k in range(1, 5))
    )
    y = "n1 / (n1 + 2 * n2)"
    # Where a count of counts is 0 the formula says nothing; then a fixed discount does.
    return n.selectExpr(
        "lang",
        f"greatest(0.1, least(0.95, coalesce(1 - 2 * {y} * n2 / nullif(n1, 0), 0.5))) AS d1",
        f"greatest(0.1, least(1.9, coalesce(2 - 3 * {y} * n3 / nullif(n2, 0), 1.0))) AS d2",
        f"greatest(0.1, least(2.9, coalesce(3 - 4 * {y} * n4 / nullif(n3, 0), 1.5))) AS d3",
    )


def vocabulary(*counted: DataFrame) -> int:
    """How many different tokens the counted n-grams end with."""
    tokens = [c.select("token").distinct() for c in counted]
    found = tokens[0]
    for more in tokens[1:]:
        found = found.union(more)
    return found.distinct().count()


def train(counted: DataFrame, tokens: int | None = None) -> Model:
    """A model per language from the counts (lang, ctx, token, c) of its n-grams. Models that are to be
    compared get the size of one vocabulary; without it each language has its own tokens and one for all
    that it never saw."""
    levels = {ORDER: counted}
    for k in range(ORDER - 1, 0, -1):  # lower orders count in how many contexts an n-gram occurs
        shorter = levels[k + 1].groupBy("lang", suffix(F.col("ctx"), k).alias("ctx"), "token")
        levels[k] = workspace.snapshot(shorter.agg(F.count(F.lit(1)).alias("c")), f"level-{k}")
    p: list[DataFrame] = []
    g: list[DataFrame] = []
    for k in range(1, ORDER + 1):
        d = _discounts(levels[k])
        cut = "CASE WHEN c = 1 THEN d1 WHEN c = 2 THEN d2 ELSE d3 END"
        cut_rows = levels[k].join(F.broadcast(d), "lang").selectExpr("lang", "ctx", "token", "c", f"{cut} AS d")
        stats = cut_rows.groupBy("lang", "ctx").agg(
            F.sum("c").alias("total"), (F.sum("d") / F.sum("c")).alias("g"), F.count(F.lit(1)).alias("types")
        )
        stats = workspace.snapshot(stats, f"contexts-{k}")
        rows = cut_rows.join(stats, ["lang", "ctx"])
        if k == 1:
            unseen = stats.selectExpr("lang", f"g / {tokens or '(types + 1)'} AS p")
            p.append(workspace.snapshot(unseen, "unseen"))
            rows = rows.join(F.broadcast(p[0]).withColumnRenamed("p", "lower"), "lang")
            found = rows.selectExpr("lang", "ctx", "token", "(c - d) / total + lower AS p")
        else:
            lower = p[k - 1].toDF("lang", "low", "token", "lower")
            rows = rows.withColumn("low", suffix(F.col("ctx"), k - 1)).join(lower, ["lang", "low", "token"])
            found = rows.selectExpr("lang", "ctx", "token", "(c - d) / total + g * lower AS p")
        g.append(stats.select("lang", "ctx", "g"))
        p.append(workspace.snapshot(found, f"p-{k}"))
    return Model(p, g, p[ORDER].count() <= BROADCAST_ROWS)


# ---- applying ----------------------------------------------------------------------------------


def with_loss(grams: DataFrame, model: Model, name: str) -> DataFrame:
    """Adds the loss in nats of one occurrence of each n-gram (columns lang, ctx, token); null if the
    language has no model."""
    small: Callable[[DataFrame], DataFrame] = F.broadcast if model.broadcast else lambda table: table
    rows, columns = grams, grams.columns
    for k in range(ORDER, 0, -1):
        rows = rows.withColumn(f"_x{k}", suffix(F.col("ctx"), k))
    for k in range(ORDER, 0, -1):
        rows = rows.join(small(model.p[k].toDF("lang", f"_x{k}", "token", f"_p{k}")), ["lang", f"_x{k}", "token"], "left")
    for k in range(ORDER, 1, -1):
        rows = rows.join(small(model.g[k - 1].toDF("lang", f"_x{k}", f"_g{k}")), ["lang", f"_x{k}"], "left")
    rows = rows.join(F.broadcast(model.p[0].toDF("lang", "_p0")), "lang", "left")
    p = F.coalesce("_p1", "_p0")
    for k in range(2, ORDER + 1):
        p = F.coalesce(F.col(f"_p{k}"), F.coalesce(F.col(f"_g{k}"), F.lit(1.0)) * p)
    return rows.select(*columns, (-F.log(p)).alias(name))


def losses_by_gram(grams: DataFrame, **models: Model) -> DataFrame:
    """lang, ctx, token and the loss under each model, of each different n-gram of a corpus; stored.

    The joins with the tables of the models run over these few rows once, so the n-grams of the
    documents need a single join.
    """
    rows = grams.select("lang", "ctx", "token")
    for name, model in models.items():
        rows = with_loss(rows, model, name)
    return workspace.snapshot(rows, "losses-by-gram")


def looked_up(bag: DataFrame, losses: DataFrame) -> DataFrame:
    """The n-grams of documents with their losses. The table is broadcast if it has few rows, which are
    counted first, else both sides are shuffled by language and n-gram."""
    return bag.join(F.broadcast(losses) if losses.count() <= BROADCAST_ROWS else losses, ["lang", "ctx", "token"])
