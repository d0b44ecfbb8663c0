"""Operators on hand-made tables, including hot keys and brute-force comparisons."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from copycensus import operators as op
from copycensus.operators import review as rv
from copycensus.operators.cache import HashCache
from copycensus.operators.skew import join_counted
from copycensus.sources import read_report, write_report

ROOT = "/data"
FILES = "path STRING, size_bytes BIGINT, modified_ms BIGINT, sha256 STRING"
CACHE = "path STRING, modified_ms BIGINT, sha256 STRING"


def digest(n):
    return f"{n:064x}"


@pytest.fixture(scope="module")
def hot(spark):
    """300 files; one content holds a third of them."""
    rng = random.Random(7)
    rows = []
    for i in range(300):
        kind = 0 if i % 3 == 0 else rng.randrange(1, 80)
        path = f"/data/{'abc'[i % 2 if kind % 2 else 0]}/f{i:03d}.vcf" if kind % 5 else f"/data/f{i:03d}.vcf"
        rows.append((path, 10 * kind, 1000 * i, digest(kind * 7919 << 230)))
    rng.shuffle(rows)
    return rows


def expected_groups(rows):
    groups = []
    by_digest = sorted(rows, key=lambda r: (r[3], r[0]))
    for sha256, members in itertools.groupby(by_digest, key=lambda r: r[3]):
        members = list(members)
        if len(members) >= 2:
            groups.append((len(groups) + 1, sha256, members))
    return groups


def numbered(spark, rows):
    return op.number_groups(op.duplicate_groups(spark.createDataFrame(rows, FILES), ROOT))


# ---- join on a hot key -------------------------------------------------------------------------


@pytest.mark.parametrize("hot_rows", [1, 7, 1_000_000])
def test_join_counted(spark, hot, hot_rows):
    rows = spark.createDataFrame(hot, FILES)
    keyed = rows.groupBy("size_bytes").agg(F.count("*").alias("n"), F.max("path").alias("last")).filter("n >= 2")
    want = rows.join(keyed, "size_bytes").select("path", "size_bytes", "n", "last")
    got = join_counted(rows, keyed, "size_bytes", "n", F.col("path"), hot_rows=hot_rows)
    assert sorted(got.select(*want.columns).collect()) == sorted(want.collect())
    semi = join_counted(rows, keyed, "size_bytes", "n", F.col("path"), "left_semi", hot_rows)
    assert sorted(semi.select("path").collect()) == sorted(want.select("path").collect())


def test_hot_key_is_split(spark, hot):
    """With broadcasts off, the rows of the hot key end up in many partitions."""
    rows = spark.createDataFrame(hot, FILES)
    keyed = rows.groupBy("size_bytes").agg(F.count("*").alias("n"))
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.shuffle.partitions": "8",
    }
    before = {name: spark.conf.get(name) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        joined = join_counted(rows, keyed, "size_bytes", "n", F.col("path"), hot_rows=5)
        spread = joined.filter("size_bytes = 0").groupBy(F.spark_partition_id()).count().collect()
        assert sum(r["count"] for r in spread) == 100 and len(spread) >= 6
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


# ---- candidates --------------------------------------------------------------------------------


def test_unsupported_file_does_not_make_a_candidate(spark):
    rows = [("/d/a.vcf", 5, 0, None), ("/d/b.pdf", 5, 0, None), ("/d/c.vcf", 6, 0, None), ("/d/e.vcf", 6, 0, None)]
    files = op.supported_files(spark.createDataFrame(rows, FILES))
    assert sorted(r.path for r in op.size_candidates(files).collect()) == ["/d/c.vcf", "/d/e.vcf"]
    assert tuple(op.candidate_stats(files).first()) == (3, 2, 1)


def test_candidate_stats_of_nothing(spark):
    assert tuple(op.candidate_stats(spark.createDataFrame([], FILES)).first()) == (0, 0, 0)


# ---- groups ------------------------------------------------------------------------------------


def test_groups_against_brute_force(spark, hot):
    def top(path):
        below = path[len("/data/"):]
        return below.split("/")[0] if "/" in below else ""

    want = [
        (number, sha256, len(m), m[0][1], (len(m) - 1) * m[0][1], m[0][0], len({top(r[0]) for r in m}) > 1)
        for number, sha256, m in expected_groups(hot)
    ]
    assert sorted(tuple(r) for r in numbered(spark, hot).collect()) == want
    assert {w[6] for w in want} == {True, False}


def test_numbers_follow_digests_over_all_prefixes(spark):
    rng = random.Random(1)
    shas = [f"{rng.getrandbits(256):064x}" for _ in range(500)] + [digest(1), "f" * 64]
    rows = [(f"/data/{i}-{k}", 1, 0, s) for i, s in enumerate(shas) for k in range(2)]
    got = {r.sha256: r.group_id for r in numbered(spark, rows).collect()}
    assert got == {s: n + 1 for n, s in enumerate(sorted(shas))}


def test_group_size_is_that_of_the_first_path(spark):
    rows = [("/data/b", 7, 0, digest(1)), ("/data/a", None, 0, digest(1)), ("/data/c", 7, 0, None)]
    (g,) = numbered(spark, rows).collect()
    assert (g.original_path, g.size_bytes, g.wasted_bytes, g.file_count) == ("/data/a", 0, 0, 2)


def test_paths_sort_by_bytes(spark):
    rows = [(p, 1, 0, digest(1)) for p in ("/data/é", "/data/z", "/data/Z", "/data/a/b", "/data/a-b")]
    assert numbered(spark, rows).first().original_path == "/data/Z"


def test_summary_of_nothing(spark):
    assert tuple(op.scan_summary(numbered(spark, [])).first()) == (0, 0, 0, "0 B")


def test_summary(spark):
    rows = [(f"/data/{i}", 1000, 0, digest(1)) for i in range(3)] + [(f"/data/x{i}", 0, 0, digest(2)) for i in range(2)]
    assert tuple(op.scan_summary(numbered(spark, rows)).first()) == (2, 3, 2000, "2.0 KB")


# ---- report ------------------------------------------------------------------------------------


@pytest.mark.parametrize("hot_rows", [3, 1_000_000])
def test_report_against_brute_force(spark, hot, hot_rows):
    files = spark.createDataFrame(hot, FILES)
    report = op.duplicate_report(files, numbered(spark, hot), hot_rows)
    got = sorted((r.group_id, r.sha256, r.file_path, r.file_size_bytes, r.is_original) for r in report.collect())
    want = [
        (number, sha256, m[0], m[1], place == 0)
        for number, sha256, members in expected_groups(hot)
        for place, m in enumerate(members)
    ]
    assert got == want


def test_report_stats_default_when_unreadable(spark):
    rows = [("/data/a", 5, 1000, digest(1)), ("/data/b", 5, 2000, digest(1))]
    files = spark.createDataFrame(rows, FILES)
    stats = files.filter("path = '/data/b'")
    got = op.report_with_stats(files, numbered(spark, rows), stats).orderBy("file_path").collect()
    assert [(r.file_size_bytes, r.last_modified) for r in got] == [(0, "unknown"), (5, "1970-01-01T00:00:02Z")]


HEADER = "group_id,sha256,file_path,file_size_bytes,last_modified,is_original"
# group, top folder, size, second, original
LINES = [
    (7, "lab", 900, 11, "false"), (7, "lab", 900, 12, "true"), (7, "tape", 901, 13, "false"), (7, "lab", 900, 14, "false"),
    (8, "tape", 0, 15, "true"), (8, "tape", 0, 16, "false"),
    (9, "old", 3_000_000_007, 17, "true"), (9, "lab", 3_000_000_007, 18, "false"), (9, "tape", 1, 19, "false"),
]


def report_text(lines):
    rows = (
        f"{group},{digest(group)},/store/{top}/run {second}.bam,{size},2021-05-06T07:08:{second}Z,{original}"
        for group, top, size, second, original in lines
    )
    return "\n".join([HEADER, *rows]) + "\n"


def report_of(spark, tmp_path, text):
    (tmp_path / "report.csv").write_text(text)
    return read_report(spark, str(tmp_path / "report.csv"))


def test_groups_of_a_report(spark, tmp_path):
    report = report_of(spark, tmp_path, report_text(LINES))
    groups = op.groups_from_report(report, "/store").orderBy("group_id").collect()
    assert [(g.group_id, g.file_count, g.size_bytes, g.wasted_bytes, g.original_path, g.spanning) for g in groups] == [
        (7, 4, 900, 2700, "/store/lab/run 12.bam", True),
        (8, 2, 0, 0, "/store/tape/run 15.bam", False),
        (9, 3, 3_000_000_007, 6_000_000_014, "/store/old/run 17.bam", True),
    ]


def test_read_odd_report_lines(spark, tmp_path):
    text = f"""{HEADER}
 5 , 0f ,"/store/one, two.bam", 77 , then ,TruE
5,0f,"/store/say ""ah"".bam",lots,then,
5,0f,/store/no size.bam,,then,false
5,0f,/store/five cells.bam,1,then
five,0f,/store/no number.bam,2,then,yes
"""
    rows = report_of(spark, tmp_path, text).collect()
    assert sorted(tuple(r) for r in rows) == [
        (0, "0f", "/store/no number.bam", 2, "then", False),
        (5, "0f", "/store/no size.bam", 0, "then", False),
        (5, "0f", "/store/one, two.bam", 77, "then", True),
        (5, "0f", '/store/say "ah".bam', 0, "then", False),
    ]


def test_report_groups_are_checked(spark, tmp_path):
    two = [(g, top, size, second, "true" if second == 16 else original) for g, top, size, second, original in LINES]
    none = [line for line in two if line[3] != 17]
    found = op.invalid_report_groups(report_of(spark, tmp_path, report_text(none))).orderBy("group_id").collect()
    assert [tuple(r) for r in found] == [(8, 2, False), (9, 0, False)]
    mixed = report_text(LINES).replace(digest(7), digest(6), 1)
    assert [tuple(r) for r in op.invalid_report_groups(report_of(spark, tmp_path, mixed)).collect()] == [(7, 1, True)]
    assert op.invalid_report_groups(report_of(spark, tmp_path, report_text(LINES))).count() == 0


def test_group_without_original_takes_its_first_path(spark, tmp_path):
    report = report_of(spark, tmp_path, report_text(LINES).replace("true", "false"))
    groups = op.groups_from_report(report, "/store").orderBy("group_id").collect()
    assert [(g.original_path, g.size_bytes) for g in groups] == [
        ("/store/lab/run 11.bam", 900), ("/store/tape/run 15.bam", 0), ("/store/lab/run 18.bam", 3_000_000_007)
    ]


def test_report_is_written_in_group_order(spark, hot, tmp_path):
    path = str(tmp_path / "report")
    written = write_report(op.duplicate_report(spark.createDataFrame(hot, FILES), numbered(spark, hot)), path)
    groups = expected_groups(hot)
    assert written == {"groups": len(groups), "rows": sum(len(m) for _, _, m in groups)}
    lines = []
    for part in sorted((tmp_path / "report").glob("part-*")):
        lines += part.read_text().splitlines()[1:]
    keys = [(int(c[0]), c[5] != "true", c[2]) for c in (line.split(",") for line in lines)]
    assert keys == sorted(keys) and len(keys) == sum(len(m) for _, _, m in expected_groups(hot))


def test_any_path_comes_back_from_the_report(spark, tmp_path):
    rng = random.Random(3)
    signs = "ab \"',\\\n\r\t#é中\U0001f600\x01 ;|"
    paths = sorted({"/" + "".join(rng.choice(signs) for _ in range(rng.randrange(1, 12))) for _ in range(3000)})
    rows = [(1, "a" * 64, p, 5, "2024-01-01T00:00:00Z", i == 0) for i, p in enumerate(paths)]
    schema = (
        "group_id BIGINT, sha256 STRING, file_path STRING, file_size_bytes BIGINT, last_modified STRING,"
        " is_original BOOLEAN"
    )
    report = spark.createDataFrame(rows, schema)
    assert write_report(report, str(tmp_path / "report")) == {"groups": 1, "rows": len(paths)}
    assert sorted(tuple(r) for r in read_report(spark, str(tmp_path / "report")).collect()) == sorted(rows)
    assert write_report(report.limit(0), str(tmp_path / "empty")) == {"groups": 0, "rows": 0}


# ---- hash cache --------------------------------------------------------------------------------


def test_cache_hits_and_misses(spark):
    times = (("hit", 1000), ("newer", 9999), ("older", 1), ("new", 5))
    files = spark.createDataFrame(
        [(f"/{n}", 1, t) for n, t in times], "path STRING, size_bytes BIGINT, modified_ms BIGINT"
    )
    cache = spark.createDataFrame([(f"/{n}", 1000, "old" + n) for n in ("hit", "newer", "older", "gone")], CACHE)
    found = {r.path: (r.cache_hit, r.sha256) for r in op.cache_lookup(files, cache).collect()}
    assert found == {"/hit": (True, "oldhit"), "/newer": (False, None), "/older": (False, None), "/new": (False, None)}
    assert sorted(r.path for r in op.cache_misses(files, cache).collect()) == ["/new", "/newer", "/older"]


def test_latest_entry_wins(spark):
    rows = [("/a", 1, "a1", 1), ("/b", 1, "b1", 1), ("/b", 3, "b3", 3), ("/b", 9, "b2", 2), ("/c", 1, "c1", 2)]
    entries = spark.createDataFrame(rows, CACHE + ", run_id BIGINT")
    got = sorted(tuple(r) for r in op.latest_entries(entries).collect())
    assert got == [("/a", 1, "a1", 1), ("/b", 3, "b3", 3), ("/c", 1, "c1", 2)]


def test_cache_store(spark, tmp_path):
    folder = str(tmp_path / "cache")
    cache = HashCache(spark, folder, keep_segments=2)
    assert cache.size().first().entries == 0
    cache.append(spark.createDataFrame([("/a", 1000, "old"), ("/b", 5, "b")], CACHE))
    cache.append(spark.createDataFrame([("/a", 2000, "new"), ("/c", 1, None)], CACHE))
    want = {("/a", 2000, "new"), ("/b", 5, "b")}

    def entries():
        again = HashCache(spark, folder)
        assert again.size().first().entries == 2
        return {(r.path, r.modified_ms, r.sha256) for r in again.load().collect()}

    assert entries() == want
    # A segment that was not finished is not read.
    cache.append(spark.createDataFrame([("/b", 6, "broken")], CACHE))
    (tmp_path / "cache/seg-00000003/_SUCCESS").unlink()
    assert entries() == want
    cache.append(spark.createDataFrame([("/b", 5, "b")], CACHE))
    cache.compact()
    assert cache.segments() == [5] and entries() == want
    # Another run may be writing what this cache did not find unfinished when it was opened.
    assert sorted(p.name for p in (tmp_path / "cache").iterdir()) == ["seg-00000003", "seg-00000005"]
    again = HashCache(spark, folder, keep_segments=1)
    again.append(spark.createDataFrame([("/b", 5, "b")], CACHE))
    again.compact()
    assert sorted(p.name for p in (tmp_path / "cache").iterdir()) == ["seg-00000007"] and entries() == want


def test_segments_have_few_files(spark, tmp_path):
    rows = spark.range(2000).selectExpr("concat('/', id) AS path", "id AS modified_ms", "hex(id) AS sha256")
    cache = HashCache(spark, str(tmp_path / "cache"))
    cache.append(rows.repartition(2000, "path"))
    assert len(list((tmp_path / "cache/seg-00000001").glob("part-*"))) < 20
    assert cache.size().first().entries == 2000


def test_hash_stats(spark):
    rows = [("x", True, None), ("y", False, None), (None, False, "gone")]
    df = spark.createDataFrame(rows, "sha256 STRING, cache_hit BOOLEAN, error STRING")
    assert tuple(op.hash_stats(df).first()) == (2, 3, 1, 1)


# ---- review ------------------------------------------------------------------------------------


def duplicates_of(rows):
    return {number: [m[0] for m in members[1:]] for number, _, members in expected_groups(rows)}


def test_review_queue(spark, hot):
    rows = op.review_queue(numbered(spark, hot), spark.createDataFrame(hot, FILES), hot_rows=4).collect()
    assert {r.group_id: r.duplicates.split("\n") for r in rows} == duplicates_of(hot)
    assert {(r.page, r.decision, r.reviewer, r.notes) for r in rows} == {(1, "Pending", "", "")}


def test_review_pages_hold_every_path(spark, hot):
    groups, files = numbered(spark, hot), spark.createDataFrame(hot, FILES)
    number = {sha256: n for n, sha256, _ in expected_groups(hot)}
    found, pages = {}, {}
    for r in op.review_paths(groups, files, page_paths=10, hot_rows=5).collect():
        paths = r.duplicates.split("\n")
        assert paths == sorted(paths) and len(paths) < 30
        found.setdefault(number[r.sha256], []).extend(paths)
        pages.setdefault(number[r.sha256], []).append((r.page, r.duplicates))
    assert {n: sorted(p) for n, p in found.items()} == duplicates_of(hot)
    rows = op.review_queue(groups, files, page_paths=10, hot_rows=5).collect()
    assert sorted(r.group_id for r in rows) == sorted(pages)
    assert {r.group_id: r.duplicates for r in rows} == {n: dict(p)[1] for n, p in pages.items()}
    for r in rows:
        assert sorted(page for page, _ in pages[r.group_id]) == list(range(1, max(1, -(-(r.file_count - 1) // 10)) + 1))


def test_repeated_decisions_change_no_count(spark, hot):
    groups, files = numbered(spark, hot), spark.createDataFrame(hot, FILES)
    first = expected_groups(hot)[0][1]
    answers = [(s, "Pending", None, None, 5) for _, s, _ in expected_groups(hot)]
    answers += [(first, "Keep all", "kim", "a", 1), (first, "Escalate", "lee", "b", 3), (first, "Keep all", "kim", "c", 2), (None, "Escalate", None, None, 1)]
    timed = spark.createDataFrame(answers, DECISIONS + ", updated_at INT")
    untimed = timed.drop("updated_at")
    for decisions, want in ((timed, "Pending"), (untimed, "Keep all")):
        rows = op.review_queue(groups, files, decisions).collect()
        assert len(rows) == len(expected_groups(hot))
        assert {r.sha256: r.decision for r in rows}[first] == want
    assert op.with_decisions(groups, timed).count() == len(expected_groups(hot))
    assert [(r.sha256, r.answers) for r in op.conflicting_decisions(untimed).collect()] == [(first, ["Escalate", "Keep all"])]


def test_high_priority(spark, hot):
    want = sorted(
        (-(len(m) - 1) * m[0][1], number) for number, _, m in expected_groups(hot)
    )
    files = spark.createDataFrame(hot, FILES)
    got = op.high_priority(numbered(spark, hot), files, rows=5).collect()
    assert [(-r.wasted_bytes, r.group_id) for r in got] == want[:5]
    assert {r.group_id: r.duplicates.split("\n") for r in got} == {n: duplicates_of(hot)[n] for _, n in want[:5]}
    # Longer lists than are broadcast take the other join and give the same.
    long = op.high_priority(numbered(spark, hot), files, rows=rv.BROADCAST_ROWS + 1).collect()
    assert [(-r.wasted_bytes, r.group_id) for r in long] == want


def test_high_priority_ties_stay_in_group_order(spark):
    rows = [(f"/data/{n}{k}", 5, 0, digest(n << 240)) for n in range(1, 6) for k in range(2)]
    got = op.high_priority(numbered(spark, rows), spark.createDataFrame(rows, FILES), rows=3).collect()
    assert [r.group_id for r in got] == [1, 2, 3]


def test_suspicious(spark, hot):
    groups = numbered(spark, hot)
    want = [r.group_id for r in groups.filter("spanning").orderBy("group_id").collect()]
    got = op.suspicious(groups, spark.createDataFrame(hot, FILES), rows=4).collect()
    assert len(want) > 4 and [r.group_id for r in got] == want[:4]


DECISIONS = "sha256 STRING, decision STRING, reviewer STRING, notes STRING"


def test_decisions(spark):
    given = ["Pending", "Archive duplicates", "Keep all", "Escalate", "Delete", "pending", "", None, "Keep all"]
    df = spark.createDataFrame([(digest(i), d, None, None) for i, d in enumerate(given)], DECISIONS)
    assert sorted(r.decision for r in op.invalid_decisions(df).collect()) == ["Delete", "pending"]
    assert tuple(op.review_progress(df).first()) == (6, 1, 2, 1, 1)


def test_archive_list(spark, hot):
    groups = numbered(spark, hot)
    picked = {number: sha256 for number, sha256, _ in expected_groups(hot) if number % 2}
    marked = [*picked.values(), digest(5)]
    rows = [(s, "Archive duplicates", "kim", None) for s in marked]
    got = op.archive_action_list(
        groups, spark.createDataFrame(hot, FILES), spark.createDataFrame(rows, DECISIONS), hot_rows=4
    ).collect()
    want = sorted((n, p) for n, paths in duplicates_of(hot).items() if n in picked for p in paths)
    assert sorted((r.group_id, r.file_path) for r in got) == want


def test_review_summary(spark, hot):
    groups = numbered(spark, hot)
    rows = op.review_summary(groups, op.with_decisions(groups), ROOT, "2024-01-01 00:00").orderBy("row_no").collect()
    n = len(expected_groups(hot))
    assert [r.label for r in rows] == [
        "Scan root", "Scan date", "Duplicate groups", "Redundant files", "Total wasted space",
        "Groups reviewed", "Marked for archive", "Marked keep all", "Escalated", "Pending",
    ]
    assert (rows[2].value, rows[5].value, rows[9].value) == (str(n), "0", str(n))
