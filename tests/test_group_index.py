"""Groups kept up to date against groups built anew."""

import random
import threading

import pytest

from copycensus import operators as op
from copycensus.commits import Commits
from copycensus.operators import group_index
from copycensus.operators.group_index import GroupIndex

CHANGES = "path STRING, size_bytes BIGINT, sha256 STRING"
FILES = "path STRING, size_bytes BIGINT, sha256 STRING, modified_ms BIGINT"
ROOT = "/data"


def rows_of(groups):
    columns = ("sha256", "file_count", "size_bytes", "wasted_bytes", "original_path", "spanning")
    return sorted(tuple(r) for r in groups.select(*columns).collect())


def rebuilt(spark, files):
    rows = [(p, s, d, 0) for p, (s, d) in files.items()]
    return rows_of(op.duplicate_groups(spark.createDataFrame(rows, FILES), ROOT))


def path(rng):
    return ROOT + rng.choice(["", "/a", "/b", "/c/d"]) + f"/f{rng.randrange(60):02d}"


def digest(kind):
    return f"{kind:064x}"


@pytest.mark.parametrize("pushed", [500, 1])
def test_equal_to_a_rebuild_after_any_changes(spark, tmp_path, monkeypatch, pushed):
    monkeypatch.setattr(group_index, "PUSHED_DIGESTS", pushed)
    rng = random.Random(pushed)
    index = GroupIndex(spark, str(tmp_path), ROOT, buckets=3, fanout=2)
    files = {}
    assert rows_of(index.groups()) == []
    for step, n in enumerate((60, 1, 25, 0, 40)):
        changes = {}
        for _ in range(n):
            p = path(rng)
            # One digest is that of a third of the files; sizes follow the digest but for a few.
            kind = 0 if rng.random() < 0.33 else rng.randrange(1, 12)
            gone = rng.random() < 0.3
            changes[p] = (kind * 10 + (rng.random() < 0.1), None if gone else digest(kind))
        if step == 2:
            # The least path of the hot group goes, and a file that never was.
            least = min(p for p, (_, d) in files.items() if d == digest(0))
            changes |= {least: (None, None), ROOT + "/never": (1, None)}
        index.update(spark.createDataFrame([(p, s, d) for p, (s, d) in changes.items()], CHANGES))
        files = {p: v for p, v in (files | changes).items() if v[1]}
        assert rows_of(index.groups()) == rebuilt(spark, files), step
        assert {r.path: (r.size_bytes, r.sha256) for r in index.fingerprints().collect()} == files
        if step in (2, 4):
            index.compact(everything=step == 4)
            assert rows_of(GroupIndex(spark, str(tmp_path), ROOT).groups()) == rebuilt(spark, files)


def index_of(spark, tmp_path, n):
    index = GroupIndex(spark, str(tmp_path), ROOT, buckets=4)
    many = spark.range(n).selectExpr("concat('/data/', id % 3, '/f', id) AS path", "7L AS size_bytes", "sha2(string(id % 500), 256) AS sha256")
    index.update(many)
    return index, many


def test_nothing_stored_is_shuffled(spark, tmp_path):
    index, many = index_of(spark, tmp_path, 2000)
    index.update(many.limit(3).withColumn("size_bytes", many.size_bytes + 1))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        groups = index.groups()._jdf.queryExecution().executedPlan().toString()
        moves = index._moves(many.limit(5), Commits(spark, str(tmp_path)).latest())._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Exchange" not in groups and "Bucketed: true" in groups
    stored = moves[moves.index("FileScan parquet spark_catalog") - 900 : moves.index("FileScan parquet spark_catalog")]
    assert "Exchange" not in stored


def test_a_small_change_writes_little(spark, tmp_path):
    index, many = index_of(spark, tmp_path, 20_000)

    def size():
        return sum(p.stat().st_size for p in tmp_path.rglob("*.parquet"))

    before = size()
    index.update(many.filter("path LIKE '/data/1/f1234%'").selectExpr("path", "9L AS size_bytes", "sha2(path, 256) AS sha256"))
    assert size() - before < 0.1 * before


def test_updates_at_once_are_both_taken_in(spark, tmp_path):
    index = GroupIndex(spark, str(tmp_path), ROOT, buckets=2)
    index.update(spark.createDataFrame([("/data/x", 1, digest(1))], CHANGES))
    changes = [[("/data/a", 1, digest(1)), ("/data/x", 2, digest(2))], [("/data/b", 1, digest(1)), ("/data/c", 2, digest(2))]]
    threads = [
        threading.Thread(target=GroupIndex(spark, str(tmp_path), ROOT).update, args=(spark.createDataFrame(c, CHANGES),)) for c in changes
    ]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    files = {"/data/a": (1, digest(1)), "/data/x": (2, digest(2)), "/data/b": (1, digest(1)), "/data/c": (2, digest(2))}
    assert rows_of(index.groups()) == rebuilt(spark, files) and index.commits.number() == 3
