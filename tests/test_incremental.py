"""Maps of sizes and keys, incremental runs, pages in path order, and walks that broke off."""

import collections
import hashlib
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from copycensus import operators as op
from copycensus import sources, workspace
from copycensus.operators import bit_map, candidates
from copycensus.plans import tree_scan
from copycensus.sources import file_system

LISTING = "path STRING, size_bytes BIGINT, modified_ms BIGINT"
FILES = "path STRING, content STRING, modified_ms BIGINT"
CACHE = "path STRING, modified_ms BIGINT, sha256 STRING"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


# ---- sizes -------------------------------------------------------------------------------------


def sizes(n, seed):
    rng = random.Random(seed)
    kinds = [rng.randrange(10**12) for _ in range(n)]
    return [(f"/f{k}", rng.choice(kinds) if k % 3 else 10**13 + k, k) for k in range(n)] + [("/none", None, 0), ("/none2", None, 0)]


@pytest.mark.parametrize("n, bits", [(0, None), (1, 4), (400, 1), (400, 9), (400, 15), (400, None)])
def test_candidates_do_not_depend_on_the_map(spark, bits, n):
    files = spark.createDataFrame(sizes(n, n), LISTING).repartition(5)
    files = workspace.snapshot(files, "files")
    got = op.mapped_size_candidates(files, bits=bits, hot_rows=3)
    assert got.columns == files.columns
    assert sorted(tuple(r) for r in got.collect()) == sorted(tuple(r) for r in op.size_candidates(files).collect())


def test_unique_sizes_are_not_shuffled(spark):
    files = [(f"/u{k}", 10**9 + k, 0) for k in range(5000)] + [(f"/s{k}", k % 7, 0) for k in range(50)]
    files = workspace.snapshot(spark.createDataFrame(files, LISTING).repartition(6), "files")
    marked = bit_map.mark_repeated(files, "size_bytes", bit_map.map_bits(files.count()))
    likely = marked.filter("_marked")
    assert "Exchange hashpartitioning" not in plan_of(likely) and "BroadcastExchange" in plan_of(likely)
    # The others share a bit by chance, about one in eight.
    assert likely.filter("size_bytes < 7").count() == 50 and likely.count() < 50 + 5000 * 0.3


def test_map_of_repeated_slots(spark):
    """Against a count, for parts that are lists of places and parts that are maps."""
    rng = np.random.default_rng(3)
    slots = [*rng.integers(0, 300_000, 2000).tolist(), *rng.integers(0, bit_map.CELL_BITS, 30_000).tolist(), 299_999, 299_999]
    df = spark.createDataFrame([(int(s),) for s in slots], "s BIGINT").repartition(7)
    got = set()
    for r in bit_map.repeated_cells(df).collect():
        got |= {r._cell * bit_map.CELL_BITS + int(k) for k in np.flatnonzero(bit_map._bits(bytes(r._map)))}
    assert got == {s for s, n in collections.Counter(slots).items() if n > 1}


def test_bits_follow_the_rows():
    assert [bit_map.map_bits(n) for n in (0, 1000, 10**6, 10**8, 10**10)] == [15, 15, 23, 28, 28]


def test_a_scan_of_many_files_uses_the_map(spark, tmp_path, monkeypatch):
    for k in range(40):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / f"in/f{k}.txt").write_text("x" * (k % 30))
    want = tree_scan.scan_tree(spark, str(tmp_path / "in"), str(tmp_path / "a")).report.collect()
    used = []
    monkeypatch.setattr(candidates, "MAP_ROWS", 10)
    monkeypatch.setattr(candidates, "mark_repeated", lambda *a, f=candidates.mark_repeated: used.append(a) or f(*a))
    assert tree_scan.scan_tree(spark, str(tmp_path / "in"), str(tmp_path / "b")).report.collect() == want and used


# ---- content tables ----------------------------------------------------------------------------


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def table(spark):
    files = [(f"/d/f{k}.txt", f"text {k % 20}", k) for k in range(120)] + [("/d/no.pdf", "x", 1), ("/d/null.txt", None, 3), ("/d/t.txt", "t", None), (None, "t", 3)]
    cache = [(f"/d/f{k}.txt", k + (k % 4 == 0), f"CACHED {k}") for k in range(0, 120, 2)] + [("/gone", 1, "x"), ("/d/t.txt", None, "y")]
    return spark.createDataFrame(files, FILES).repartition(4), spark.createDataFrame(cache, CACHE), files


def expected(files):
    rows = []
    for path, text, ms in files:
        if path is None or path.endswith(".pdf"):
            continue
        k = int(path[4:-4]) if path[4:-4].isdigit() else None
        hit = k is not None and k % 2 == 0 and k % 4 != 0
        digest = f"CACHED {k}" if hit else None if text is None else sha(text)
        rows.append((path, None if text is None else len(text), ms, digest, hit))
    return sorted(rows, key=repr)


@pytest.mark.parametrize("bits", [1, 6, 26])
def test_incremental_runs_for_any_map(spark, bits):
    files, cache, rows = table(spark)
    got = op.incremental_fingerprints(files, cache, bits=bits)
    assert got.columns == ["path", "size_bytes", "modified_ms", "sha256", "cache_hit"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == expected(rows)


def test_a_hit_is_not_hashed(spark):
    files = spark.createDataFrame([(f"/f{k}.txt", "hit" if k % 2 else f"new {k}", k) for k in range(50)], FILES)
    cache = spark.createDataFrame([(f"/f{k}.txt", k, "known") for k in range(1, 50, 2)], CACHE)

    def digest(content):
        return F.when(content == "hit", F.raise_error(F.lit("hashed a hit")).cast("string")).otherwise(F.sha2(content, 256))

    got = {r.path: r.sha256 for r in op.incremental_fingerprints(files, cache, digest=digest).collect()}
    assert got == {f"/f{k}.txt": "known" if k % 2 else sha(f"new {k}") for k in range(50)}
    with pytest.raises(Exception, match="hashed a hit"):
        op.incremental_fingerprints(files, cache.limit(0), digest=digest).collect()


def test_content_is_not_shuffled(spark, monkeypatch):
    files, cache, _ = table(spark)
    plans = []
    monkeypatch.setattr(workspace, "snapshot", lambda df, label, f=workspace.snapshot: plans.append(plan_of(df)) or f(df, label))
    op.incremental_fingerprints(files.coalesce(2), cache, bits=4).collect()
    assert len(plans) == 3
    for plan in plans:
        # The rows with their content meet the map by a broadcast.
        assert "BroadcastHashJoin" in plan or "content" not in plan
        for line in plan.splitlines():
            assert "Exchange" not in line or "content" not in line


def test_empty_tables(spark):
    files, cache, rows = table(spark)
    assert op.incremental_fingerprints(files.limit(0), cache).count() == 0
    fresh = op.incremental_fingerprints(files, cache.limit(0)).collect()
    assert len(fresh) == len(expected(rows)) and not any(r.cache_hit for r in fresh)


# ---- pages in path order -----------------------------------------------------------------------


@pytest.mark.parametrize("page_paths, hot_rows", [(1, 1), (2, 7), (10, 7), (2, 10**6), (10**4, 1)])
def test_pages_are_the_sorted_paths(spark, hot_rows, page_paths):
    rng = random.Random(hot_rows + page_paths)
    rows = [(f"/{'abé Z'[rng.randrange(5)]}{k}.vcf", 5, k, f"{(0 if k % 3 == 0 else rng.randrange(1, 40)):064x}") for k in range(300)]
    files = spark.createDataFrame(rows, f"{LISTING}, sha256 STRING").repartition(5)
    groups = workspace.snapshot(op.number_groups(workspace.snapshot(op.duplicate_groups(files, "/"), "g")), "n")
    pages = {}
    for r in op.review_paths_in_order(groups, files, page_paths, hot_rows).collect():
        pages.setdefault(r.sha256, {})[r.page] = r.duplicates.split("\n")
    members = {}
    for path, _, _, digest in rows:
        members.setdefault(digest, []).append(path)
    want = {d: sorted(p, key=str.encode)[1:] for d, p in members.items() if len(p) > 1}
    assert set(pages) == set(want)
    for digest, of in pages.items():
        assert sorted(of) == list(range(1, len(of) + 1))
        assert [p for k in sorted(of) for p in of[k]] == want[digest]
        assert all(len(of[k]) == page_paths for k in of if k < len(of))


def test_a_large_group_is_ranked_by_many_tasks(spark):
    rows = [(f"/p{k:05d}", 5, k, "a" * 64) for k in range(3000)] + [("/q1", 5, 1, "b" * 64), ("/q2", 5, 1, "b" * 64)]
    files = spark.createDataFrame(rows, f"{LISTING}, sha256 STRING").repartition(4)
    groups = workspace.snapshot(op.duplicate_groups(files, "/"), "g")
    seen = []
    snapshot = workspace.snapshot
    try:
        workspace.snapshot = lambda df, label: seen.append((label, out := snapshot(df, label))) or out
        op.review_paths_in_order(groups, files, 10, hot_rows=300).collect()
    finally:
        workspace.snapshot = snapshot
    ranges = dict(seen)["ranges"].groupBy("_range").count().collect()
    assert len(ranges) >= 10 and max(r["count"] for r in ranges) < 600


# ---- walks that broke off ----------------------------------------------------------------------


def test_a_walk_goes_on_after_its_last_round(spark, tmp_path, monkeypatch):
    root = tmp_path / "in"
    for k in range(6):
        for j in range(4):
            folder = root / f"a{k}/b{j}/c"
            folder.mkdir(parents=True)
            (folder / "f.txt").write_text("x")
    opened = tmp_path / "opened"
    opened.mkdir()
    entries = file_system.Mount.entries

    def counted(self, folder):
        # Tasks run in other processes; a file for each call tells what was opened.
        import os
        import uuid

        with open(f"{opened}/{uuid.uuid4().hex}", "w") as f:
            f.write(os.fspath(folder))
        return entries(self, folder)

    monkeypatch.setattr(file_system.Mount, "entries", counted)

    def folders():
        return collections.Counter(p.read_text() for p in opened.iterdir())

    keep = str(tmp_path / "walk")
    want = sources.inventory(spark, str(root), first_dirs=1, round_dirs=2, keep=keep).orderBy("path").collect()
    whole = folders()
    rounds = sorted(os.listdir(keep))
    assert len(want) == 24 and len(rounds) > 2 and max(whole.values()) == 1
    # The last round did not end: nothing of the others is opened again.
    os.unlink(f"{keep}/{rounds[-1]}/_SUCCESS")
    assert sources.inventory(spark, str(root), first_dirs=1, round_dirs=2, keep=keep).orderBy("path").collect() == want
    again = folders()
    assert 0 < sum(again.values()) - sum(whole.values()) < sum(whole.values()) / 2
    left = {r.path for r in spark.read.schema("kind STRING, path STRING").parquet(f"{keep}/{rounds[-2]}").collect() if r.kind == "dir"}
    reopened = {f for f, n in again.items() if n == 2}
    assert left <= reopened and all(any(f.startswith(d) for d in left) for f in reopened)


def test_a_scan_clears_the_rounds_of_its_walk(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / f"in/{k}.txt").write_text("x")
    tree_scan.find_candidates(spark, str(tmp_path / "in"), str(tmp_path / "out"), [".txt"])
    path = tree_scan.candidates_path(str(tmp_path / "out"), str(tmp_path / "in"), [".txt"])
    assert os.path.exists(path) and not os.path.exists(path + "-walk")


def test_scan_with_the_cache_by_bucket(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(12):
        (tmp_path / f"in/{k}.txt").write_text(f"x{k % 4}")
    os.symlink("g1", tmp_path / "in/dangling.txt")
    root, out = str(tmp_path / "in"), str(tmp_path / "out")
    first = tree_scan.scan_tree(spark, root, out, cache_buckets=3, commit_bytes=10)
    assert tuple(first.hash_stats.first()) == (12, 13, 0, 1)
    report = sorted(first.report.collect())
    # The cache is by bucket from now on.
    second = tree_scan.scan_tree(spark, root, out)
    assert tuple(second.hash_stats.first()) == (12, 13, 12, 1)
    assert sorted(second.report.collect()) == report and second.totals.first().duplicate_groups == 4
    cache = tree_scan.open_cache(spark, out + "/hash_cache")
    assert isinstance(cache, op.BucketCache) and cache.size().first().entries == 12

