import hashlib
import re

from pyspark.sql import functions as F

from copycensus.llm import exact_dedup

from .helpers import documents, rows_of

TEXTS = ["a b", "a  b", "a\tb", "a\x0b\x0cb", "a b", "", None, "x", "x", "x", " x", "y" * 50_000, "y" * 50_000, "A b"]


def expected(ids, texts):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for t in texts]
    out = []
    for i, t in zip(ids, norm, strict=True):
        group = [j for j, u in zip(ids, norm, strict=True) if t == u]
        known = [j for j in group if j is not None]
        keep = min(known) if known else i
        out.append((i, keep, len(group), i is not None and i == keep, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=repr)


COLUMNS = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def test_against_brute_force(spark):
    ids = [5, 3, 9, 1, 2, 8, 7, 20, 20, 11, 12, 14, 13, None]
    got = exact_dedup.exact_duplicates(documents(spark, TEXTS, ids, clashing=True))
    assert rows_of(got, *COLUMNS) == expected(ids, TEXTS)


def test_colliding_hashes_are_told_apart_by_bytes(spark):
    ids = list(range(len(TEXTS)))
    weak = [lambda t: F.unhex(F.lit("00")), lambda t: F.unhex(F.lpad(F.hex(F.length(t)), 4, "0"))]
    for hash_of in weak:
        for check_of in (lambda t: F.lit("same"), lambda t: F.sha2(t, 256)):
            got = exact_dedup.exact_duplicates(documents(spark, TEXTS), hash_of, check_of, filter_bits=16)
            assert rows_of(got, *COLUMNS) == expected(ids, TEXTS)


def test_stage_keeps_one_row_of_each_text(spark):
    ids = [5, 3, 9, 1, 2, 8, 7, 20, 20, 11, 12, 14, 14, 15]
    docs = documents(spark, TEXTS, ids, clashing=True)
    got = exact_dedup.drop_exact_duplicates(docs)
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == [1, 2, 7, 11, 12, 14, 15]


def test_empty_table(spark):
    docs = documents(spark, [])
    assert exact_dedup.exact_duplicates(docs).count() == 0
    assert exact_dedup.drop_exact_duplicates(docs).count() == 0


def test_only_built_in_functions_run(spark):
    plan = exact_dedup.exact_duplicates(documents(spark, TEXTS))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_least_of_rows_that_share_id_and_text_stays(spark):
    rows = [(7, "a  b", "zz", "s"), (7, "a b", "de", "t"), (7, "a b", "de", "s"), (None, "c", "fr", "u"), (None, "c", "en", "u")]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, lang STRING, source STRING")
    docs = docs.selectExpr("*", "map('k', source) AS extra")
    for parts in (1, 5):
        got = exact_dedup.drop_exact_duplicates(docs.repartition(parts))
        assert got.columns == docs.columns
        assert sorted((tuple(r)[:4] for r in got.collect()), key=repr) == [(7, "a  b", "zz", "s"), (None, "c", "en", "u")]
