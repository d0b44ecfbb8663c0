"""Quality classifier: perplexity under a language model of trusted text, against its quantiles.

1. Trusted documents are those labelled as good. Of each language one half by a hash of the id trains its
   model (``ngrams``), whole and however large. The other half sets the thresholds, for a model tells nothing
   of the losses of unseen texts by those it has seen. So each trusted document is used, and for one of both.
2. The different n-grams of all texts are joined with the tables of the model. Every whole text is turned
   into counts of its n-grams, and a join with those losses gives its loss per character.
3. A document is rejected if its loss is above the threshold of its language and length: a high
   quantile of the losses of trusted documents that the model has not seen, plus a margin. Lengths
   fall in bands by powers of four, for the losses of short texts scatter more. A band with
   few trusted documents takes the quantile of the language, a language with few that of all.

Defined results: a null text is empty; an empty text has no perplexity and is rejected. A document in a
language without trusted text has none either and is accepted, as nothing speaks against it; a null
language is a language of its own. Rows that repeat a doc_id are judged as one text and get one result
each. Rows without doc_id have neither perplexity nor threshold and are accepted. ``keep_good`` judges
each row by its own text instead, also one without doc_id. Without trusted documents, all but the
empty ones are accepted. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from copycensus import workspace
from copycensus.llm import ngrams
from copycensus.llm.common import ids_tell_rows, keyed, likely_members, node_id, row_key, table, text_or_empty, without_documents, without_rows

QUANTILE = 0.99
MARGIN = 0.03
#: A quantile of a band or a language needs so many documents.
LEAST_IN_BAND, LEAST_IN_LANGUAGE = 80, 50
STEPS = 4096  # steps a nat in which losses are counted


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(
        node_id(docs)[0].alias("doc_id"), F.coalesce("lang", F.lit("")).alias("lang"), text_or_empty("text").alias("text")
    )


def _band() -> Column:
    return F.floor(F.log2(F.greatest("tokens", F.lit(1))) / 2).cast("int")


def losses(docs: DataFrame, model: ngrams.Model) -> DataFrame:
    """doc_id, lang, tokens, loss (nats per character) of every text that has characters."""
    texts = _texts(docs)
    rows = ngrams.looked_up(ngrams.bags(texts), ngrams.losses_by_gram(ngrams.counts(texts), loss=model))
    return rows.groupBy("doc_id", "lang").agg(
        F.sum("n").alias("tokens"), (F.sum(F.col("loss") * F.col("n")) / F.sum("n")).alias("loss")
    )


def _quantiles(losses: DataFrame, by: list[str], quantile: float) -> DataFrame:
    """The groups ``by`` with n and the exact quantile of ``loss``, interpolated as ``percentile`` does.

    ``percentile`` would hold all losses of a group in one task. Here losses are counted by fine steps
    (column ``_step``), and running sums over the steps tell the one or two that hold the quantile's
    place. Only the losses of these are ranked, each different one once.
    """
    groups = [F.col(c) for c in by] or [F.lit(0)]
    steps = losses.groupBy(*by, "_step").agg(F.count(F.lit(1)).alias("_n"))
    so_far = Window.partitionBy(*groups).orderBy("_step")
    steps = steps.withColumn("n", F.sum("_n").over(Window.partitionBy(*groups)))
    steps = steps.withColumn("_before", F.sum("_n").over(so_far) - F.col("_n")).withColumn("_at", F.lit(quantile) * (F.col("n") - 1))
    chosen = steps.filter("_before <= ceil(_at) AND _before + _n > floor(_at)").drop("_n")
    chosen = workspace.snapshot(chosen, "steps")
    values = losses.join(chosen, [*by, "_step"]).groupBy(*by, "_step", "n", "_before", "_at", "loss")
    values = values.agg(F.count(F.lit(1)).alias("_c"))
    rank = F.sum("_c").over(Window.partitionBy(*groups, "_step").orderBy("loss"))
    values = values.withColumn("_past", F.col("_before") + rank).withColumn("_from", F.col("_past") - F.col("_c"))

    def at(place: str) -> Column:
        return F.max(F.when(F.expr(f"_from <= {place} AND {place} < _past"), F.col("loss")))

    found = values.groupBy(*by).agg(
        at("floor(_at)").alias("_low"), at("ceil(_at)").alias("_high"), F.max("n").alias("n"), F.max("_at").alias("_at")
    )
    return found.selectExpr(*by, "n", "_low + (_high - _low) * (_at - floor(_at)) AS quantile")


def thresholds(scored: DataFrame, quantile: float = QUANTILE, margin: float = MARGIN) -> tuple[DataFrame, ...]:
    """Thresholds by (lang, band), by lang, and of all, where enough documents stand behind them."""
    step = F.floor(F.col("loss") * STEPS).alias("_step")
    banded = scored.filter("loss IS NOT NULL").select("lang", _band().alias("band"), "loss", step)
    banded = workspace.snapshot(banded, "held-out")

    def above(by: list[str], least: int) -> DataFrame:
        found = _quantiles(banded, by, quantile).filter(F.col("n") >= least)
        return found.select(*by, (F.col("quantile") + margin).alias("threshold"))

    return above(["lang", "band"], LEAST_IN_BAND), above(["lang"], LEAST_IN_LANGUAGE), above([], 1)


def split_trusted(docs: DataFrame, labels: DataFrame, max_trusted: int | None = None) -> DataFrame:
    """doc_id, lang, trains of all trusted documents; stored. Those that do not train set thresholds.

    Only a caller who names ``max_trusted`` gets a smaller model, of about half as many texts a language.
    """
    good = labels.filter("quality = 1 AND doc_id IS NOT NULL").select(node_id(labels)[0].alias("doc_id")).distinct()
    known = docs.select(node_id(docs)[0].alias("doc_id"), F.coalesce("lang", F.lit("")).alias("lang"))
    known = likely_members(known, F.col("doc_id"), good, F.col("doc_id")).join(good, "doc_id", "left_semi").distinct()
    order = F.xxhash64("doc_id")
    half = F.pmod(order, F.lit(2)) == 0
    if max_trusted is None:
        return workspace.snapshot(known.withColumn("trains", half), "split")
    halves = known.withColumn("half", half).withColumn("at", F.pmod(F.shiftright(order, 1), F.lit(1 << 30)))
    halves = workspace.snapshot(halves, "trusted")
    # By the hash, the share of a language's half that makes up the sample; no task sorts a language.
    share = halves.filter("half").groupBy("lang").agg((F.lit(float(1 << 30) * (max_trusted // 2)) / F.count("at")).alias("below"))
    split = halves.join(F.broadcast(share), "lang", "left")
    trains = F.col("half") & F.coalesce(F.col("at") < F.col("below"), F.lit(False))
    return workspace.snapshot(split.select("doc_id", "lang", trains.alias("trains")), "split")


def training_texts(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """doc_id, lang, text of the documents that train. Their ids grow with the corpus and are never
    broadcast; of the texts only those that may be among them are shuffled."""
    train = trusted.filter("trains").select("doc_id", "lang")
    texts = likely_members(_texts(docs), F.col("doc_id"), train, F.col("doc_id"))
    # No semi-join: Spark would put it before the bit map and shuffle all texts. The ids are different ones.
    return texts.join(train.hint("merge"), ["doc_id", "lang"])


def quality(docs: DataFrame, labels: DataFrame, max_trusted: int | None = None) -> DataFrame:
    """One row per document: doc_id, lang, tokens, perplexity, threshold, accepted."""
    trusted = split_trusted(docs, labels, max_trusted)
    model = ngrams.train(ngrams.counts(training_texts(docs, trusted)))
    scored = workspace.snapshot(losses(docs.filter("doc_id IS NOT NULL"), model), "losses")
    others = trusted.filter("NOT trains").select("doc_id", "lang")
    held_out = likely_members(scored, F.col("doc_id"), others, F.col("doc_id"))
    held_out = held_out.join(others.hint("merge"), ["doc_id", "lang"], "left_semi")
    by_band, by_lang, of_all = thresholds(held_out)
    by_band, by_lang = workspace.snapshot(by_band, "by-band"), workspace.snapshot(by_lang, "by-lang")
    of_all = F.lit(next((r.threshold for r in of_all.collect()), None)).cast("double")  # one number
    limits = (
        scored.withColumn("band", _band())
        .join(F.broadcast(by_band), ["lang", "band"], "left")
        .join(F.broadcast(by_lang.withColumnRenamed("threshold", "of_lang")), "lang", "left")
    )
    limits = limits.select(
        "doc_id", "lang", "tokens", "loss", F.coalesce("threshold", "of_lang", of_all).alias("threshold")
    )
    rows = docs.select(
        node_id(docs)[0].alias("doc_id"), F.coalesce("lang", F.lit("")).alias("lang"),
        (F.length(text_or_empty("text")) == 0).alias("empty"),
    )
    joined = rows.join(limits, ["doc_id", "lang"], "left")
    return joined.select(
        "doc_id",
        "lang",
        F.coalesce("tokens", F.lit(0)).cast("bigint").alias("tokens"),
        F.exp("loss").alias("perplexity"),
        F.exp("threshold").alias("threshold"),
        (F.col("doc_id").isNull() | (~F.col("empty") & F.coalesce(F.col("loss") <= F.col("threshold"), F.lit(True))))
        .alias("accepted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The accepted rows with all their columns; each is judged by its own text."""
    known = ids_tell_rows(docs)
    if known:
        found = quality(docs, labels)
    else:  # a label holds for all rows of its doc_id
        of_row = docs.filter("doc_id IS NOT NULL").select("doc_id", row_key().alias("_row")).distinct()
        labels = labels.join(of_row, "doc_id").drop("doc_id").withColumnRenamed("_row", "doc_id")
        found = quality(keyed(docs), labels)
    rejected = workspace.snapshot(found.filter("NOT accepted").select("doc_id").distinct(), "rejected")
    return (without_documents if known else without_rows)(docs, rejected)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
