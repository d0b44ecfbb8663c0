"""Exact deduplication: group by a 128-bit content hash, then compare bytes inside the groups.

Only built-in functions run here. Steps:

1. One narrow pass takes the 128-bit hash and the SHA-256 of every normalised text.
2. Hashes that occur more than once mark a bit map of fixed size. Only texts that pass it are shuffled,
   grouped by hash and bytes. The grouping folds copies inside each map task, so a text that a third of
   all rows share arrives as one row per task.
3. Each row takes the result of its group. Two different texts under one hash are two groups. Should
   they even share their SHA-256, rows of that hash are matched by their bytes.

Defined results: a null text is an empty one; empty texts are equal to each other. Rows that repeat a
doc_id count as rows of their group, and all rows with the smallest doc_id are marked as kept. A row
without doc_id counts in its group, is never kept and never the one that stays. An empty table
gives an empty result. Further columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from copycensus import workspace
from copycensus.llm.common import ids_tell_rows, key_of, likely_members, table, text_or_empty, without_documents

WHITE_SPACE = r"[\x20\x09-\x0D]+"


def content_hash(text: Column) -> Column:
    """128 bits, as binary."""
    return F.unhex(F.md5(text))


def exact_duplicates(
    docs: DataFrame,
    hash_of: Callable[[Column], Column] = content_hash,
    check_of: Callable[[Column], Column] = lambda text: F.sha2(text, 256),
    filter_bits: int = 26,
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    texts = docs.select("doc_id", F.regexp_replace(text_or_empty("text"), WHITE_SPACE, " ").alias("norm"))
    hashed = texts.select("doc_id", "norm", hash_of(F.col("norm")).alias("h"))
    narrow = workspace.snapshot(
        hashed.select("doc_id", "h", check_of(F.col("norm")).alias("check"), F.sha2("norm", 256).alias("text_sha256")),
        "hashes",
    )
    repeated = narrow.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    equal = (
        likely_members(hashed, F.col("h"), repeated, F.col("h"), filter_bits)
        .groupBy("h", "norm")
        .agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    )
    classes = workspace.snapshot(
        equal.withColumn("check", check_of(F.col("norm"))).drop("norm"), "classes"
    )
    clashes = classes.groupBy("h", "check").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1").select("h")
    if clashes.isEmpty():
        found = narrow.join(classes, ["h", "check"], "left")
    else:
        odd = workspace.snapshot(clashes.distinct(), "clashes")
        by_bytes = hashed.join(odd, "h", "left_semi").join(equal, ["h", "norm"], "left")
        plain = narrow.join(odd, "h", "left_anti").join(classes, ["h", "check"], "left")
        columns = ["doc_id", "keep_id", "group_size", "text_sha256"]
        found = plain.select(columns).unionByName(
            by_bytes.withColumn("text_sha256", F.sha2("norm", 256)).select(columns)
        )
    found = found.withColumn("keep_id", F.coalesce("keep_id", "doc_id"))
    return found.select(
        "doc_id",
        "keep_id",
        F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"),
        F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)).alias("kept"),
        "text_sha256",
    )


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """One row of each text, with all its columns: one with the least doc_id, or one without where no row
    of the text has a doc_id. Rows that share a doc_id but not the text are told apart by both; of rows that share
    both the least by all columns stays."""
    found = workspace.snapshot(exact_duplicates(docs).select("doc_id", "keep_id", "kept", "text_sha256"), "exact")
    if ids_tell_rows(found):
        return without_documents(docs, found.filter("NOT kept").select("doc_id"))
    goes = F.col("keep_id").isNotNull() & ~F.col("kept")
    rows = found.select(key_of(F.col("text_sha256")).alias("_row"), goes.alias("goes"))
    rows = rows.groupBy("_row").agg(F.count(F.lit(1)).alias("n"), F.max("goes").alias("goes"))
    odd = workspace.snapshot(rows.filter("n > 1 OR goes"), "odd")
    norm = F.regexp_replace(text_or_empty("text"), WHITE_SPACE, " ")
    wide, key, names = docs.withColumn("_row", key_of(F.sha2(norm, 256))), F.col("_row"), docs.columns
    once = likely_members(wide, key, odd, key).join(odd.filter("goes").select("_row"), "_row", "left_anti")
    # The least by all columns that have an order, so that a task run again keeps the same row.
    order = F.struct(*(F.col(f"`{n}`") for n, kind in docs.dtypes if not any(k in kind for k in ("map<", "variant"))))
    once = once.groupBy("_row").agg(F.min_by(F.struct(*(F.col(f"`{n}`") for n in names)), order).alias("_kept"))
    return likely_members(wide, key, odd, key, others=True).select(*names).unionByName(once.select("_kept.*"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


ORACLE_SQL = {
    "op2_exact_dedup": r"""
        WITH n AS (
          SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
        ), g AS (
          SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY norm
        )
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256
        FROM n JOIN g USING (norm)"""
}
