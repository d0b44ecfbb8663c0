"""CSV reports read by blocks, and reports put in place by commits."""

import csv
import io
import random
import threading

import pytest

from copycensus.commits import Commits, published
from copycensus.sources import read_report, write_report
from copycensus.sources.csv_blocks import read_records

HEADER = "group_id,sha256,file_path,file_size_bytes,last_modified,is_original"


@pytest.fixture
def block_bytes(spark):
    """Sets the size of a block for a test."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.shuffle.partitions")

    def use(n):
        for name, value in zip(names, (n, 1, 2)):
            spark.conf.set(name, str(value))

    before = [spark.conf.get(n) for n in names]
    yield use
    for name, value in zip(names, before):
        spark.conf.set(name, value)


def quoted(text):
    return '"' + text.replace('"', '""') + '"'


def odd_rows(seed, n, longest):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        path = "/" + "".join(rng.choice('ab"\n,\r é') for _ in range(rng.choice([0, 1, 5, longest])))
        rows.append((k, f"{k:x}", path, k * 3, "t", rng.random() < 0.5))
    return rows


def text_of(rows, end):
    lines = [HEADER, *(f"{g},{h},{quoted(p)},{s},{t},{str(o).lower()}" for g, h, p, s, t, o in rows)]
    return end.join(lines) + end


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("block", [17, 64, 300, 1 << 20])
def test_a_report_in_one_file_for_any_block(spark, tmp_path, block_bytes, block, end):
    block_bytes(block)
    rows = odd_rows(block, 12 if block < 64 else 30, 150)
    text = text_of(rows, end)
    (tmp_path / "r.csv").write_bytes(text.encode())
    records = [r.record for r in read_records(spark, str(tmp_path / "r.csv")).collect()]
    assert sorted(records) == sorted(text_of([r], end).removeprefix(HEADER + end).removesuffix(end) for r in rows)
    got = sorted(tuple(r) for r in read_report(spark, str(tmp_path / "r.csv")).collect())
    assert got == sorted(rows)
    # The csv module reads the same.
    assert [r[2] for r in csv.reader(io.StringIO(text, newline=""))][1:] == [r[2] for r in rows]


def test_blocks_are_tasks_of_their_own(spark, tmp_path, block_bytes):
    block_bytes(200)
    (tmp_path / "r.csv").write_text(text_of(odd_rows(1, 60, 40), "\n"))
    whole = read_records(spark, str(tmp_path / "r.csv"))
    assert whole.rdd.getNumPartitions() >= len((tmp_path / "r.csv").read_bytes()) // 200


def test_a_record_over_many_blocks(spark, tmp_path, block_bytes):
    block_bytes(20)
    rows = [(1, "a", "/x" + '\n"line, ' * 40, 5, "t", True), (2, "b", "/y", 6, "t", False)]
    (tmp_path / "r.csv").write_text(text_of(rows, "\n"))
    assert sorted(tuple(r) for r in read_report(spark, str(tmp_path / "r.csv")).collect()) == rows


def test_a_header_over_many_blocks(spark, tmp_path, block_bytes):
    block_bytes(10)
    (tmp_path / "r.csv").write_text('a,"b\n\nc\nd\n""e""\nf",c,d,e,f\n1,a,/x,5,t,true\n')
    assert [tuple(r) for r in read_report(spark, str(tmp_path / "r.csv")).collect()] == [(1, "a", "/x", 5, "t", True)]


def test_several_files_and_none_with_rows(spark, tmp_path):
    (tmp_path / "d").mkdir()
    for k in range(3):
        (tmp_path / f"d/{k}.csv").write_text(text_of(odd_rows(k, 9 * k, 30), "\n"))
    want = sorted(r for k in range(3) for r in odd_rows(k, 9 * k, 30))
    assert sorted(tuple(r) for r in read_report(spark, str(tmp_path / "d")).collect()) == want
    (tmp_path / "only.csv").write_text(HEADER)
    assert read_report(spark, str(tmp_path / "only.csv")).count() == 0
    (tmp_path / "empty.csv").write_text("")
    assert read_report(spark, str(tmp_path / "empty.csv")).count() == 0


def test_unpaired_quotes_are_an_error(spark, tmp_path, block_bytes):
    (tmp_path / "r.csv").write_text(HEADER + '\n1,a,"/x,5,t,true\n2,a,/y,5,t,true\n')
    with pytest.raises(ValueError, match="r.csv"):
        read_report(spark, str(tmp_path / "r.csv"))


# ---- commits of a report -----------------------------------------------------------------------


def report(spark, rows):
    return spark.createDataFrame(rows, "group_id BIGINT, sha256 STRING, file_path STRING, file_size_bytes BIGINT, last_modified STRING, is_original BOOLEAN")


def content(spark, path):
    return sorted(tuple(r) for r in read_report(spark, path).collect())


def test_a_report_takes_the_place_of_another(spark, tmp_path):
    path, one, two = str(tmp_path / "report"), odd_rows(1, 20, 9), odd_rows(2, 15, 9)
    write_report(report(spark, one), path)
    assert content(spark, path) == sorted(one)
    assert write_report(report(spark, two), path)["rows"] == 15
    assert content(spark, path) == sorted(two) and Commits(spark, path).number() == 2
    # Readers that know nothing of commits find the same.
    parts = [p for p in (tmp_path / "report").iterdir() if p.name.startswith("part-")]
    assert parts and all(p.name.startswith(Commits(spark, path).latest()["version"]) for p in parts)


def test_readers_see_one_whole_version_at_any_time(spark, tmp_path, monkeypatch):
    """After the files are written and before the commit, and after the commit and before the old ones go."""
    path, one, two = str(tmp_path / "report"), odd_rows(1, 20, 9), odd_rows(2, 15, 9)
    write_report(report(spark, one), path)
    seen = []
    change = Commits.change

    def watched(self, edit):
        seen.append(content(spark, path))
        out = change(self, edit)
        seen.append(content(spark, path))
        return out

    monkeypatch.setattr(Commits, "change", watched)
    write_report(report(spark, two), path)
    assert seen == [sorted(one), sorted(two)]

    def broken(self, edit):
        raise OSError("gone")

    monkeypatch.setattr(Commits, "change", broken)
    with pytest.raises(OSError, match="gone"):
        write_report(report(spark, one), path)
    assert content(spark, path) == sorted(two)


def test_two_reports_at_once(spark, tmp_path):
    path, rows = str(tmp_path / "report"), {k: odd_rows(k, 20, 9) for k in range(3)}
    threads = [threading.Thread(target=write_report, args=(report(spark, r), path)) for r in rows.values()]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert content(spark, path) in [sorted(r) for r in rows.values()] and Commits(spark, path).number() == 3


def test_a_folder_of_an_earlier_release(spark, tmp_path):
    folder = tmp_path / "report"
    folder.mkdir()
    (folder / "part-00000-old.csv").write_text(text_of(odd_rows(1, 9, 9), "\n"))
    assert published(spark, str(folder)) == str(folder) and len(content(spark, str(folder))) == 9
    write_report(report(spark, odd_rows(2, 5, 9)), str(folder))
    assert len(content(spark, str(folder))) == 5 and not (folder / "part-00000-old.csv").exists()
