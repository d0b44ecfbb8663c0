"""The bucketed hash cache and the commits behind it."""

import os
import random
import threading

import pytest
from pyspark.sql import functions as F

from copycensus import operators as op
from copycensus.commits import Commits, Conflict, create_once
from copycensus.operators.bucket_cache import BucketCache
from copycensus.operators.cache import HashCache

CACHE = "path STRING, modified_ms BIGINT, sha256 STRING"


def entries(cache):
    return {r.path: (r.modified_ms, r.sha256, r.run_id) for r in cache.load().collect()}


def rows(spark, pairs):
    return spark.createDataFrame(pairs, CACHE)


# ---- commits -----------------------------------------------------------------------------------


def test_a_number_is_taken_once(spark, tmp_path):
    path = str(tmp_path / "c/x.json")
    assert create_once(spark, path, "ä") and not create_once(spark, path, "b")
    assert (tmp_path / "c/x.json").read_text() == "ä" and len(os.listdir(tmp_path / "c")) == 1 + os.path.exists(tmp_path / "c/.x.json.crc")


def test_writers_at_once_lose_nothing(spark, tmp_path):
    def work(name):
        commits = Commits(spark, str(tmp_path))
        for k in range(6):
            commits.change(lambda now: {"seen": [*now.get("seen", []), f"{name}{k}"]})

    threads = [threading.Thread(target=work, args=(n,)) for n in "abcd"]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    commits = Commits(spark, str(tmp_path))
    assert sorted(commits.latest()["seen"]) == sorted(f"{n}{k}" for n in "abcd" for k in range(6))
    assert commits.number() == 24 and commits.at(0) == {}


def test_a_change_that_no_longer_applies(spark, tmp_path):
    commits = Commits(spark, str(tmp_path))
    assert commits.latest() == {} and commits.change(lambda now: None) is None and commits.number() == 0

    def late(now):
        # Another writer is always faster.
        create_once(spark, commits._path(commits.number() + 1), '{"n": 1}')
        return {"n": 2}

    with pytest.raises(Conflict):
        commits.change(late)


# ---- cache -------------------------------------------------------------------------------------


def test_cache_is_the_last_entry_of_each_path(spark, tmp_path):
    """Random upserts and merges against a dictionary."""
    rng = random.Random(4)
    cache = BucketCache(spark, str(tmp_path / "it's"), buckets=3, fanout=2)
    assert cache.size().first().entries == 0 and entries(cache) == {}
    want = {}
    for run in range(1, 9):
        paths = rng.sample([f"/p{k}" for k in range(30)], rng.choice([0, 1, 5, 20]))
        pairs = [(p, rng.randrange(99), rng.choice([None, f"h{run}", f"h{run}x"])) for p in paths]
        assert cache.append(rows(spark, pairs)) == run
        want |= {p: (m, h, run) for p, m, h in pairs if h}
        if run % 2 == 0:
            cache.compact()
        assert entries(BucketCache(spark, str(tmp_path / "it's"))) == want
    assert cache.size().first().entries == len(want)
    cache.compact(everything=True)
    assert len(cache.segments()) == 1 and entries(cache) == want and cache.buckets == 3
    cache.compact()
    kept = [n for n in os.listdir(tmp_path / "it's") if n.startswith("segment-")]
    assert kept == [cache.segments()[0]["name"]]


def test_the_cache_is_not_shuffled(spark, tmp_path):
    cache = BucketCache(spark, str(tmp_path), buckets=4)
    for run in range(3):
        cache.append(rows(spark, [(f"/p{k}", k, f"h{run}") for k in range(run * 10, 40)]))
    files = rows(spark, [(f"/p{k}", k + k % 2, None) for k in range(60)]).drop("sha256")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = cache.lookup(files)
        plan = found._jdf.queryExecution().executedPlan().toString()
        got = {r.path: (r.cache_hit, r.sha256) for r in found.collect()}
        alone = cache.load()._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == {f"/p{k}": (True, f"h{min(k // 10, 2)}") if k < 40 and k % 2 == 0 else (False, None) for k in range(60)}
    assert plan.count("Exchange") == 1 and "Bucketed: true" in plan and "Exchange" not in alone
    exchange = plan.index("Exchange")
    assert "FileScan" not in plan[exchange : plan.index("Scan", exchange)]


def test_a_small_change_writes_little(spark, tmp_path):
    cache = BucketCache(spark, str(tmp_path), buckets=4, fanout=4)
    many = spark.range(20_000).selectExpr("concat('/some/folder/', id) AS path", "id AS modified_ms", "sha2(string(id), 256) AS sha256")
    cache.append(many)

    def files():
        return {p: p.stat().st_size for p in tmp_path.rglob("*.parquet")}

    before = files()
    cache.append(many.filter("modified_ms % 100 = 0").withColumn("modified_ms", F.lit(7).cast("bigint")))
    cache.compact()
    after = files()
    assert before.items() <= after.items()
    assert sum(after.values()) - sum(before.values()) < 0.03 * sum(before.values())
    # Over many small changes an entry is rewritten about once per level.
    written, known = 0, set(after)
    for run in range(16):
        cache.append(many.filter(f"modified_ms % 100 = {run}"))
        written += sum(size for p, size in files().items() if p not in known)
        known |= set(files())
        cache.compact()
        written += sum(size for p, size in files().items() if p not in known)
        known |= set(files())
    assert written < 16 * 0.03 * sum(before.values()) * 3 and len(cache.segments()) < 9
    assert cache.size().first().entries == 20_000


def test_merging_does_not_shuffle(spark, tmp_path):
    cache = BucketCache(spark, str(tmp_path), buckets=3, fanout=2)
    for run in range(2):
        cache.append(rows(spark, [(f"/p{k}", k, f"h{run}") for k in range(9)]))
    merged = cache._entries(cache.segments(), 3)
    assert "Exchange" not in op.latest_entries(merged.withColumnRenamed("run", "run_id"))._jdf.queryExecution().executedPlan().toString()
    name = cache.segments()[0]["name"]
    assert cache.compact() == sorted([name, cache.commits.at(3)["segments"][1]["name"]])
    parts = [p.name for p in (tmp_path / cache.segments()[0]["name"]).glob("*.parquet")]
    assert len(parts) == len({p.split("_")[-1] for p in parts}) <= 3


def test_runs_that_commit_at_once(spark, tmp_path):
    caches = [BucketCache(spark, str(tmp_path), buckets=2, fanout=2) for _ in range(3)]
    caches[0].append(rows(spark, [("/a", 0, "old")]))
    threads = [
        threading.Thread(target=c.append, args=(rows(spark, [(f"/{k}", k, f"h{k}"), ("/a", k, f"a{k}")]),))
        for k, c in enumerate(caches)
    ]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    got = entries(caches[0])
    assert {p: v[1] for p, v in got.items() if p != "/a"} == {"/0": "h0", "/1": "h1", "/2": "h2"}
    assert sorted(s["run"] for s in caches[1].segments()) == [1, 2, 3, 4]
    assert got["/a"][2] == 4 and got["/a"][1] == f"a{got['/a'][0]}"


def test_a_merge_that_came_too_late_is_dropped(spark, tmp_path, monkeypatch):
    one, two = (BucketCache(spark, str(tmp_path), buckets=2, fanout=2) for _ in range(2))
    for run in range(2):
        one.append(rows(spark, [(f"/p{k}", run, f"h{run}") for k in range(4)]))
    write = one._write

    def slow(rows, name, buckets):
        n = write(rows, name, buckets)
        two.compact()
        return n

    monkeypatch.setattr(one, "_write", slow)
    assert one.compact() == []
    assert len(one.segments()) == 1 and {v[1] for v in entries(one).values()} == {"h1"}
    assert one.segments()[0]["name"] in os.listdir(tmp_path)


def test_an_uncommitted_segment_is_not_read(spark, tmp_path, monkeypatch):
    cache = BucketCache(spark, str(tmp_path), buckets=2)
    cache.append(rows(spark, [("/a", 1, "x")]))
    monkeypatch.setattr(cache.commits, "change", lambda edit: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        cache.append(rows(spark, [("/a", 2, "y")]))
    assert entries(BucketCache(spark, str(tmp_path))) == {"/a": (1, "x", 1)}


def test_segments_of_an_older_cache_are_taken_over(spark, tmp_path):
    old = HashCache(spark, str(tmp_path))
    old.append(rows(spark, [("/a", 1, "x"), ("/b", 1, "y")]))
    old.append(rows(spark, [("/a", 2, "z")]))
    cache = BucketCache(spark, str(tmp_path), buckets=2)
    assert cache.append(rows(spark, [("/c", 3, "w")])) == 3
    assert entries(cache) == {"/a": (2, "z", 2), "/b": (1, "y", 1), "/c": (3, "w", 3)}


def test_fanout(spark, tmp_path):
    with pytest.raises(ValueError):
        BucketCache(spark, str(tmp_path), fanout=1)
