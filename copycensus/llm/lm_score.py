"""Scores of documents by the cross-entropy difference of two language models.

The target model is trained on all documents labelled as good, the background model on all documents.
Both are interpolated modified Kneser-Ney models of the same order over the same vocabulary, the
characters of either (``ngrams``), so their losses can be compared. Joins with both models
give the losses of each different n-gram, and a join of the n-grams of every whole text with these gives the
loss of each token under either. The score of a document is the mean difference per token, target less
background, in nats. The lower, the more a text is like the
target and unlike the rest.

Defined results: a null text is empty; an empty text has 0 tokens and no losses. Rows that repeat a
doc_id are scored as one text, and each gets that score. Rows without doc_id have no score. Without labels
there is no target and no score. An empty table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from copycensus import workspace
from copycensus.llm import ngrams
from copycensus.llm.common import likely_members, table, text_or_empty


def _texts(docs: DataFrame) -> DataFrame:
    """One language for all, so both models have one vocabulary."""
    return docs.select(F.col("doc_id").cast("bigint"), F.lit("").alias("lang"), text_or_empty("text").alias("text"))


def losses(docs: DataFrame, target: DataFrame) -> DataFrame:
    """The losses of all n-grams of the documents under the models of the target's ids (a column
    doc_id) and of all documents: lang, ctx, token, target, background."""
    texts = _texts(docs)
    ids = target.select(F.col("doc_id").cast("bigint")).distinct()
    # Only texts that may belong to the target are shuffled, and they are at any size: the target's ids are
    # a share of all and would not stay small enough to broadcast.
    wanted = likely_members(texts, F.col("doc_id"), ids, F.col("doc_id"))
    wanted = wanted.join(ids.hint("merge"), "doc_id", "left_semi")
    counted = ngrams.counts(wanted), ngrams.counts(texts)
    tokens = ngrams.vocabulary(*counted) + 1  # one for what neither saw
    near, far = (ngrams.train(c, tokens) for c in counted)
    return ngrams.losses_by_gram(counted[1], target=near, background=far)


def cross_entropy_difference(docs: DataFrame, target: DataFrame) -> DataFrame:
    """doc_id, tokens, target_loss, background_loss, score of every document."""
    known = losses(docs, workspace.snapshot(target.select("doc_id"), "target"))
    rows = ngrams.looked_up(ngrams.bags(_texts(docs.filter("doc_id IS NOT NULL"))), known)
    n = F.sum("n")
    scored = rows.groupBy("doc_id").agg(
        n.alias("tokens"),
        (F.sum(F.col("target") * F.col("n")) / n).alias("target_loss"),
        (F.sum(F.col("background") * F.col("n")) / n).alias("background_loss"),
        (F.sum((F.col("target") - F.col("background")) * F.col("n")) / n).alias("score"),
    )
    ids = docs.select(F.col("doc_id").cast("bigint"))
    found = ids.join(scored, "doc_id", "left")
    return found.withColumn("tokens", F.coalesce("tokens", F.lit(0)).cast("bigint"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "labels").filter("quality = 1 AND doc_id IS NOT NULL")
    return cross_entropy_difference(table(spark, sf_dir, "documents"), good)
