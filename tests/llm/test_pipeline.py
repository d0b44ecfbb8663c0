"""The stages one after the other, and the registered queries."""

import os

import corpus_pipeline
import duckdb
from copycensus.llm import quality, registry, toxicity

import __spark_entry__ as entry

from .helpers import Groups, rows_of
from .test_near_dedup import shingles

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_queries_are_registered():
    numbers = sorted(int(name[2:].split("_")[0]) for name in registry.QUERIES)
    assert numbers == list(range(1, 14))
    assert {*registry.QUERIES, "pipeline"} <= set(entry.queries())
    assert set(registry.ORACLE_SQL) <= set(entry.oracle_sql())


def test_exact_dedup_matches_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF_DIR}/documents.parquet'")
    got = registry.QUERIES["op2_exact_dedup"](spark, SF_DIR)
    result = con.execute(registry.ORACLE_SQL["op2_exact_dedup"])
    names = [d[0] for d in result.description]
    assert rows_of(got, *names) == sorted(result.fetchall(), key=repr)


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    good = [r for r in quality.quality(docs, labels).collect()]
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    ids = {r.doc_id for r in good if r.accepted}
    kept = spark.createDataFrame([(i,) for i in sorted(ids)], "doc_id BIGINT")
    left = docs.join(kept, "doc_id", "left_semi")
    ids -= {r.doc_id for r in toxicity.toxicity(left, toxicity.train(left, labels)).collect() if r.toxic}
    groups, sets = Groups(), {i: shingles(texts[i]) for i in ids}
    norm = {}
    for i in sorted(ids):
        norm.setdefault(" ".join(texts[i].split()) if texts[i].strip() else texts[i], i)
    for i in sorted(norm.values()):
        for j in norm.values():
            if j < i and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= corpus_pipeline.NEAR_PERCENT * len(sets[i] | sets[j]):
                groups.join(i, j)
    want = {i for i in norm.values() if groups.find(i) == i}
    assert corpus_pipeline.NEAR_PERCENT == 80
    got = corpus_pipeline.run(spark, SF_DIR)
    assert {r.doc_id for r in got.select("doc_id").collect()} == want
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality_classifier", "toxicity", "exact_dedup", "minhash_near_dedup", "best_fit_packing"
    ]
