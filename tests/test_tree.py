"""Scans of real file trees."""

import hashlib
import os
import random

import pyarrow.fs
import pytest
from pyspark.sql import functions as F

from copycensus import operators as op
from copycensus import scan_tree, sources
from copycensus.operators.cache import HashCache
from copycensus.plans import tree_scan
from copycensus.sources import file_system, tree


def write(root, contents):
    for name, content in contents.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content if isinstance(content, bytes) else content.encode())
    root.mkdir(parents=True, exist_ok=True)
    return root


def totals(scan):
    r = scan.totals.first()
    return r.duplicate_groups, r.redundant_files


def hash_counts(scan):
    r = scan.hash_stats.first()
    return r.hashed, r.total, r.cache_hits, r.errors


def listed(spark, root, **options):
    return {os.path.relpath(r.path, root): r for r in sources.inventory(spark, str(root), **options).collect()}


# ---- inventory and candidates ------------------------------------------------------------------


SUFFIXES = (".vcf", ".g.vcf.gz", ".bam", ".fastq.gz", ".txt", ".TXT", ".pdf", "")
SUPPORTED = (".vcf", ".g.vcf.gz", ".bam", ".fastq.gz", ".txt", ".TXT")


def forest(seed, files=60):
    """Files of few sizes and contents, at depths 0 to 4; some empty, some not to be scanned."""
    rng = random.Random(seed)
    contents = {}
    for k in range(files):
        folder = "/".join(f"{rng.choice(['ward', '.night', '_raw', 'Å b'])}{rng.randrange(3)}" for _ in range(rng.randrange(5)))
        sign = rng.choice("xyz")
        body = sign * rng.choice([0, 1, 40, 41, 5000]) if rng.random() < 0.7 else f"{sign}{k}" * rng.randrange(1, 50)
        contents[f"{folder}/probe {k}{rng.choice(SUFFIXES)}".lstrip("/")] = body
    return contents


def brute_force(contents):
    """Supported files, those of them that share a size, and the members of each group."""
    files = {n: c for n, c in contents.items() if n.endswith(SUPPORTED)}
    sizes = [len(c.encode()) for c in files.values()]
    shared = {n for n, c in files.items() if sizes.count(len(c.encode())) > 1}
    groups = {}
    for name in files:
        groups.setdefault(files[name], []).append(name)
    return files, shared, sorted(sorted(g) for g in groups.values() if len(g) > 1)


@pytest.mark.parametrize("files", [0, 1, 60])
def test_candidates(spark, tmp_path, files):
    contents = forest(files, files)
    root = write(tmp_path / "in", contents)
    supported, shared, _ = brute_force(contents)
    found = sources.inventory(spark, str(root))
    assert {os.path.relpath(r.path, root) for r in op.size_candidates(found).collect()} == shared
    stats = op.candidate_stats(found).first()
    assert (stats.files_found, stats.candidates) == (len(supported), len(shared))


def test_inventory_rows(spark, tmp_path):
    root = write(tmp_path / "in", {"a.vcf": "12345", ".hidden/_b.txt": "", "no.pdf": "x"})
    os.utime(root / "a.vcf", ns=(0, 1_704_067_200_123_999_999))
    found = listed(spark, root)
    assert set(found) == {"a.vcf", ".hidden/_b.txt"}
    a = found["a.vcf"]
    assert (a.size_bytes, a.modified_ms, a.is_symlink, a.error) == (5, 1704067200123, False, None)
    assert found[".hidden/_b.txt"].size_bytes == 0


def test_walk_does_not_depend_on_its_budget(spark, tmp_path):
    names = {f"d{i}/e{j}/f{k}.txt": "x" for i in range(4) for j in range(4) for k in range(2)}
    names["d0/" + "deep/" * 12 + "last.txt"] = "x"
    root = write(tmp_path / "in", names)
    for name in (b"\xff\xfe", b"d1/\xc3("):
        folder = os.fsencode(str(root)) + b"/" + name
        os.makedirs(folder)
        for k in range(3):
            with open(folder + b"/%d\x80.txt" % k, "wb") as f:
                f.write(b"odd")
    found = [listed(spark, root, first_dirs=budget, round_dirs=budget) for budget in (1, 2, 64)]
    assert len(found[0]) == len(names) + 6 and not any(r.error for r in found[0].values())
    assert found[0] == found[1] == found[2]


def test_rounds_of_the_walk_follow_its_depth(spark, tmp_path, monkeypatch):
    root = write(tmp_path / "in", {f"a{i}/b{j}/f.txt": "x" for i in range(20) for j in range(20)})
    rounds = []
    monkeypatch.setattr(tree.workspace, "scratch_path", lambda s, label, f=tree.workspace.scratch_path: rounds.append(label) or f(s, label))
    assert len(listed(spark, root, first_dirs=1, round_dirs=4)) == 400
    assert rounds.count("walk") <= 4


def test_links(spark, tmp_path):
    root = write(tmp_path / "in", {"real/a.vcf": "content"})
    outside = write(tmp_path / "other", {"b.vcf": "content"})
    os.symlink(outside / "b.vcf", root / "link.vcf")
    os.symlink(outside, root / "dirlink.vcf")
    os.symlink(root / "gone", root / "dangling.vcf")
    found = listed(spark, root)
    assert set(found) == {"real/a.vcf", "link.vcf", "dirlink.vcf", "dangling.vcf"}
    link = found["link.vcf"]
    assert link.is_symlink and link.size_bytes == len(str(outside / "b.vcf"))
    assert link.modified_ms == os.stat(outside / "b.vcf").st_mtime_ns // 1_000_000
    assert found["dangling.vcf"].modified_ms == 0 and found["dangling.vcf"].error is None


def test_missing_root_is_an_error_row(spark, tmp_path):
    rows = sources.inventory(spark, str(tmp_path / "none")).collect()
    assert len(rows) == 1 and rows[0].error and rows[0].size_bytes is None


def test_any_name_has_one_text():
    rng = random.Random(5)
    names = {bytes(rng.choice(b"ab/\xef\xbf\xbd\xff\x80_f0") for _ in range(rng.randrange(1, 9))) for _ in range(4000)}
    texts = {file_system.to_text(os.fsdecode(n)): n for n in names}
    assert len(texts) == len(names)
    for text, name in texts.items():
        text.encode("utf-8")
        assert os.fsencode(file_system.to_path(text)) == name


def test_files_of_any_name_are_grouped(spark, tmp_path):
    root = write(tmp_path / "in", {"plain.vcf": "same", "�.vcf": "same"})
    with open(os.fsencode(str(root)) + b"/\xff.vcf", "wb") as f:
        f.write(b"same")
    scan = scan_tree(spark, "file://" + str(root), str(tmp_path / "out"))
    assert totals(scan) == (1, 2)
    assert {os.path.basename(r.file_path) for r in scan.report.collect()} == {"plain.vcf", "�__.vcf", "�ff.vcf"}


def test_uri_gives_the_rows_of_the_mount(spark, tmp_path):
    root = write(tmp_path / "in", forest(4))
    with open(root / "sparse.bam", "wb") as f:
        f.truncate((2 << 30) + 5)
    mount, uri = (listed(spark, root), {os.path.relpath(r.path, root): r for r in sources.inventory(spark, f"file://{root}").collect()})
    assert mount == uri and mount["sparse.bam"].size_bytes == (2 << 30) + 5


def test_store_calls_agree_with_the_mount(tmp_path):
    """The calls that other URIs take, on a local folder."""
    root = write(tmp_path / "in", forest(6))
    store = file_system.Store(pyarrow.fs.LocalFileSystem(), "far://host", str(root))
    mount = file_system.Mount()
    waiting, seen = ["far://host"], set()
    while waiting:
        folder = waiting.pop()
        own = str(root) + folder.removeprefix("far://host")
        entries = sorted(store.entries(folder))
        assert [(p.replace("far://host", str(root)), d) for p, d, _ in entries] == sorted((p, d) for p, d, _ in mount.entries(own))
        for path, is_folder, _ in entries:
            if is_folder:
                waiting.append(path)
                continue
            local = path.replace("far://host", str(root))
            seen.add(os.path.relpath(local, root))
            assert store.attributes(path) == mount.attributes(local)
            with store.open(path) as a, mount.open(local) as b:
                assert a.read() == b.read()
    assert seen == set(forest(6))
    with pytest.raises(FileNotFoundError):
        store.attributes("far://host/none")
    with pytest.raises(FileNotFoundError):
        list(store.entries("far://host/none"))
    with pytest.raises(NotADirectoryError):
        list(store.entries("far://host/" + sorted(seen)[0]))


# ---- hashing -----------------------------------------------------------------------------------


def hashed(spark, paths):
    rows = [(str(p), 0, 0) for p in paths]
    df = tree.hash_files(spark.createDataFrame(rows, "path STRING, size_bytes BIGINT, modified_ms BIGINT"))
    return {r.path: r for r in df.collect()}


def test_hash_files(spark, tmp_path):
    contents = {"nothing.bam": b"", "short.bam": b"\x00\xffline\r\n", "pieces.bam": os.urandom(tree.READ_BYTES * 2 + 7)}
    root = write(tmp_path, contents)
    os.mkfifo(root / "queue.bam")
    got = hashed(spark, [root / n for n in (*contents, "gone.bam", "queue.bam")] + [root])
    for name, content in contents.items():
        assert got[str(root / name)].sha256 == hashlib.sha256(content).hexdigest()
    for bad in (root / "gone.bam", root / "queue.bam", root):
        assert got[str(bad)].sha256 is None and got[str(bad)].error


def test_deal_by_bytes(spark):
    rows = [(f"/s{i}", 10) for i in range(100)] + [(f"/l{i}", 1000 + i) for i in range(4)]
    dealt = tree.deal_by_bytes(spark.createDataFrame(rows, "path STRING, size_bytes BIGINT"), task_bytes=500)
    placed = dealt.withColumn("task", F.spark_partition_id()).collect()
    assert sorted((r.path, r.size_bytes) for r in placed) == sorted(rows)
    large = {r.task: r.size_bytes for r in placed if r.size_bytes >= 500}
    assert len(large) == 4 and large[min(large)] == 1003
    assert not {r.task for r in placed if r.size_bytes < 500} & set(large)


# ---- whole scan --------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", [1])
def test_scan_against_brute_force(spark, tmp_path, seed):
    contents = forest(seed, 90)
    root = write(tmp_path / "in", contents)
    scan = scan_tree(spark, str(root), str(tmp_path / "out"))
    groups = {}
    for r in scan.report.collect():
        groups.setdefault(r.group_id, []).append(os.path.relpath(r.file_path, root))
    want = brute_force(contents)[2]
    assert len(want) > 3 and sorted(sorted(g) for g in groups.values()) == want
    assert totals(scan) == (len(want), sum(len(g) - 1 for g in want))


@pytest.mark.parametrize("contents", [{}, {"left/one.bam": "0123", "right/two.bam": "3210"}])
def test_scan_without_duplicates(spark, tmp_path, contents):
    out = tmp_path / "out"
    scan = scan_tree(spark, str(write(tmp_path / "vcf", contents)), str(out))
    assert totals(scan) == (0, 0) and scan.report.count() == 0
    # A report with its header and the review tables stay; the candidates go.
    header = "group_id,sha256,file_path,file_size_bytes,last_modified,is_original"
    parts = [p for p in (out / "report").iterdir() if p.name.startswith("part-")]
    assert [p.read_text() for p in parts] == [header + "\n"]
    assert sorted(p.name for p in (out / "review").iterdir()) == [
        "high_priority", "invalid_groups", "review", "review_paths", "summary", "suspicious", "totals"
    ]
    assert not list((out / "candidates").iterdir())


def test_scan_report(spark, tmp_path):
    body = "pedigree\t7\n" * 3
    names = ("mid/two.bam", "early.bam", "zeta/three.bam", "zeta/four.bam")
    root = write(tmp_path / "in", dict.fromkeys(names, body) | {"zeta/alone.bam": "p"})
    os.utime(root / "early.bam", ns=(0, 1_234_567_890_987_654_321))
    out = tmp_path / "out"
    scan = scan_tree(spark, str(root), str(out))
    rows = scan.report.orderBy("group_id", "file_path").collect()
    digest = hashlib.sha256(body.encode()).hexdigest()
    assert [(r.group_id, r.sha256, r.file_size_bytes, r.file_path) for r in rows] == [
        (1, digest, 33, str(root / n)) for n in sorted(names)
    ]
    assert [r.is_original for r in rows] == [True, False, False, False]
    assert rows[0].last_modified == "2009-02-13T23:31:30Z"
    review = spark.read.parquet(str(out / "review/review")).collect()
    assert [(r.wasted_bytes, r.decision, r.reviewer, r.notes) for r in review] == [(99, "Pending", "", "")]
    assert review[0].duplicates.split("\n") == [str(root / n) for n in sorted(names)[1:]]
    assert [r.duplicates for r in spark.read.parquet(str(out / "review/review_paths")).collect()] == [review[0].duplicates]
    assert [r.group_id for r in spark.read.parquet(str(out / "review/suspicious")).collect()] == [1]
    assert spark.read.parquet(str(out / "review/invalid_groups")).count() == 0
    assert tuple(scan.walk_stats.first()) == (5, 4, 1, 0)
    assert tuple(scan.totals.first()) == (1, 3, 99, "99 B")


def test_scan_with_relative_root(spark, tmp_path, monkeypatch):
    write(tmp_path / "vcf", {"d/a.vcf": "same", "d/b.vcf": "same"})
    monkeypatch.chdir(tmp_path)
    scan_tree(spark, "vcf", str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out/review/suspicious")).count() == 0


def test_link_to_a_copy_takes_the_size_of_its_target(spark, tmp_path):
    target = tmp_path / "x" / "copy.bin"
    text = "t" * len(str(target))
    write(tmp_path / "x", {"copy.bin": text})
    root = write(tmp_path / "vcf", {"b.vcf": text})
    os.symlink(target, root / "a.vcf")
    scan = scan_tree(spark, str(root), str(tmp_path / "out"))
    rows = scan.report.orderBy("file_path").collect()
    assert [(r.file_path, r.file_size_bytes, r.is_original) for r in rows] == [
        (str(root / "a.vcf"), len(text), True), (str(root / "b.vcf"), len(text), False)
    ]


def test_awkward_names_come_back_whole(spark, tmp_path):
    names = [" lead.txt", "comma, in.txt", 'quote".txt', "line\nbreak.txt", "trail \\.txt", "plain.txt", "ünï.txt"]
    root = write(tmp_path / "vcf", {f"d /{n}": "same" for n in names})
    scan = scan_tree(spark, str(root), str(tmp_path / "out"))
    assert {r.file_path for r in scan.report.collect()} == {f"{root}/d /{n}" for n in names}


def test_second_scan_uses_the_cache(spark, tmp_path):
    root = write(tmp_path / "vcf", {"a.vcf": "same", "b.vcf": "same", "c.vcf": "diff"})
    out = str(tmp_path / "out")
    assert hash_counts(scan_tree(spark, str(root), out)) == (3, 3, 0, 0)
    assert hash_counts(scan_tree(spark, str(root), out)) == (3, 3, 3, 0)
    # A changed file is read again, also with an older time; a vanished one keeps its entry.
    (root / "c.vcf").write_text("same")
    os.utime(root / "c.vcf", ns=(0, 1_000_000_000))
    (root / "a.vcf").unlink()
    scan = scan_tree(spark, str(root), out)
    assert hash_counts(scan) == (2, 2, 1, 0) and totals(scan) == (1, 1)
    cache = HashCache(spark, out + "/hash_cache")
    assert {os.path.basename(r.path) for r in cache.load().collect()} == {"a.vcf", "b.vcf", "c.vcf"}


def test_cached_digest_is_trusted(spark, tmp_path):
    """A planted digest comes back, so the content of a hit is not read."""
    root = write(tmp_path / "vcf", {"a.vcf": "AAAA", "b.vcf": "BBBB"})
    cache = HashCache(spark, str(tmp_path / "out/hash_cache"))
    files = sources.inventory(spark, str(root))
    cache.append(files.select("path", "modified_ms", F.lit("f" * 64).alias("sha256")))
    scan = scan_tree(spark, str(root), str(tmp_path / "out"))
    assert totals(scan) == (1, 1) and hash_counts(scan) == (2, 2, 2, 0)


def test_resume_skips_the_walk(spark, tmp_path):
    root = write(tmp_path / "vcf", {"a.vcf": "same", "b.vcf": "same"})
    out = str(tmp_path / "out")
    tree_scan.find_candidates(spark, str(root), out, [".vcf"])
    # Not in the stored candidates, so a resumed scan does not see it.
    write(root, {"c.vcf": "same"})
    # Hashed under its old time before the scan broke off; changed since.
    HashCache(spark, out + "/hash_cache").append(
        sources.inventory(spark, str(root)).select("path", "modified_ms", F.lit("f" * 64).alias("sha256"))
    )
    (root / "a.vcf").write_text("DIFF")
    os.utime(root / "a.vcf", ns=(0, 5_000_000_000))
    scan = scan_tree(spark, str(root), out, [".vcf"])
    assert hash_counts(scan) == (2, 2, 1, 0) and totals(scan) == (0, 0)
    # The candidates were dropped with the report, so the next scan walks; so do other suffixes.
    assert hash_counts(scan_tree(spark, str(root), out, [".vcf"]))[1] == 3


def test_candidates_belong_to_root_and_suffixes(tmp_path):
    paths = {
        tree_scan.candidates_path("out", root, suffixes)
        for root in ("/a", "/b")
        for suffixes in ([".vcf"], [".vcf", ".bam"])
    }
    assert len(paths) == 4


def test_unfinished_candidates_are_not_trusted(spark, tmp_path):
    root = write(tmp_path / "vcf", {"a.vcf": "same", "b.vcf": "same"})
    out = str(tmp_path / "out")
    path = tree_scan.candidates_path(out, str(root), [".vcf"])
    tree_scan.find_candidates(spark, str(root), out, [".vcf"])
    os.unlink(f"{path}/_SUCCESS")
    write(root, {"c.vcf": "same"})
    assert tree_scan.find_candidates(spark, str(root), out, [".vcf"])[0].count() == 3


def test_hashing_commits_in_rounds(spark, tmp_path):
    root = write(tmp_path / "vcf", {f"f{i}.vcf": f"{i % 10:04d}" for i in range(40)})
    scan = scan_tree(spark, str(root), str(tmp_path / "out"), commit_bytes=50)
    assert totals(scan) == (10, 30)
    cache = HashCache(spark, str(tmp_path / "out/hash_cache"))
    assert len(cache.segments()) == 4 and cache.size().first().entries == 40


def test_unreadable_file_is_counted_and_skipped(spark, tmp_path):
    root = write(tmp_path / "vcf", {"a.vcf": "same", "b.vcf": "same"})
    os.symlink("gone", root / "c.vcf")
    scan = scan_tree(spark, str(root), str(tmp_path / "out"))
    assert totals(scan) == (1, 1) and hash_counts(scan) == (2, 3, 0, 1)


def test_edited_review_table_goes_into_the_next_scan(spark, tmp_path):
    root, out = write(tmp_path / "in", {"u/a.bam": "one", "v/b.bam": "one", "u/c.bam": "other", "v/d.bam": "other"}), tmp_path / "out"
    scan_tree(spark, str(root), str(out))
    digest = hashlib.sha256(b"other").hexdigest()
    review = spark.read.parquet(str(out / "review/review"))
    chosen = F.col("sha256") == digest
    edited = review.withColumn("decision", F.when(chosen, "Keep all").otherwise(F.col("decision")))
    edited = edited.withColumn("reviewer", F.when(chosen, "kim").otherwise(F.col("reviewer")))
    edited.write.parquet(str(tmp_path / "edited"))
    tree_scan.workspace.replace(spark, str(tmp_path / "edited"), str(out / "review/review"))
    write(root, {"u/e.bam": "third", "w/f.bam": "third"})
    scan = scan_tree(spark, str(root), str(out), decisions=spark.read.parquet(str(out / "review/review")))
    for name in ("review", "high_priority", "suspicious"):
        rows = {r.sha256: r for r in spark.read.parquet(str(out / "review" / name)).collect()}
        assert len(rows) == 3 and (rows[digest].decision, rows[digest].reviewer) == ("Keep all", "kim")
    labels = {r.label: r.value for r in scan.summary.collect()}
    assert (labels["Groups reviewed"], labels["Marked keep all"], labels["Pending"]) == ("1", "1", "2")
    assert labels["Scan root"] == str(root) and len(labels["Scan date"]) == 16
    assert {p.name for p in (out / "review").iterdir()} >= {"invalid_decisions", "conflicting_decisions"}
    assert not [p for p in out.rglob("*") if ".new-" in p.name or ".old-" in p.name]


def test_failing_write_leaves_the_last_report(spark, tmp_path, monkeypatch):
    root, out = write(tmp_path / "in", {"a.bam": "one", "b.bam": "one"}), str(tmp_path / "out")
    scan = scan_tree(spark, str(root), out)
    before = scan.report.collect()
    write(root, {"c.bam": "one"})

    def broken(rows):
        return report_rows(rows).withColumn("sha256", F.raise_error(F.lit("no")).cast("string"))

    report_rows = tree_scan.report_rows
    monkeypatch.setattr(tree_scan, "report_rows", broken)
    with pytest.raises(Exception, match="no"):
        scan_tree(spark, str(root), out)
    assert sources.read_report(spark, out + "/report").collect() == before
    assert spark.read.parquet(out + "/review/review").count() == 1


def test_lists_have_the_length_asked_for(spark, tmp_path):
    contents = {f"{top}/{k}.bam": f"body {k}" for top in ("u", "v") for k in range(5)}
    out = str(tmp_path / "out")
    scan_tree(spark, str(write(tmp_path / "in", contents)), out, high_priority_rows=3, suspicious_rows=2)
    assert spark.read.parquet(out + "/review/high_priority").count() == 3
    assert spark.read.parquet(out + "/review/suspicious").count() == 2


def test_scan_leaves_no_scratch_tables(spark, tmp_path):
    before = tree_scan.workspace.child_names(spark, os.path.dirname(tree_scan.workspace.scratch_path(spark, "x")))
    scan_tree(spark, str(write(tmp_path / "in", {"a.bam": "one", "b.bam": "one"})), str(tmp_path / "out"))
    after = tree_scan.workspace.child_names(spark, os.path.dirname(tree_scan.workspace.scratch_path(spark, "x")))
    assert after == before
