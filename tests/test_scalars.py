"""Scalar functions on hand-made values."""

import pytest
from pyspark.sql import functions as F

from copycensus import functions as fn
from copycensus.functions.scalars import DEFAULT_EXTENSIONS


def values(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).coalesce(1).select(column).collect()]


@pytest.mark.parametrize(
    "n, shown",
    [
        (0, "0 B"),
        (500, "500 B"),
        (1023, "1023 B"),
        (1024, "1.0 KB"),
        (1280, "1.3 KB"),
        (2048, "2.0 KB"),
        (1048575, "1024.0 KB"),
        (1048576, "1.0 MB"),
        (5 * 1024 * 1024, "5.0 MB"),
        (1073741824, "1.0 GB"),
        (2147483648, "2.0 GB"),
        (1099511627776, "1.0 TB"),
        (1125899906842624, "1024.0 TB"),
    ],
)
def test_human_size(spark, n, shown):
    assert values(spark, [(n,)], "n BIGINT", fn.human_size("n")) == [shown]


def test_short_hash(spark):
    got = values(spark, [("abcdef123456" + "x" * 52,)], "h STRING", fn.short_hash("h"))
    assert got == ["abcdef123456..."] and len(got[0]) == 15


def supported(spark, names, *args):
    return values(spark, [(n,) for n in names], "p STRING", fn.is_supported("p", *args))


def test_default_suffixes(spark):
    good = [f"/lab/run {k}/{name}" for k, x in enumerate(DEFAULT_EXTENSIONS) for name in (f"probe{k}{x}", x, f"Q{x.upper()}")]
    bad = [f"/lab/probe{x}{tail}" for x in DEFAULT_EXTENSIONS for tail in ("~", "/notes", " ", "\n", ".zip")]
    bad += ["", "/", "vcf", "/lab.txt/readme", "probe_bam", "probe.vc", "probe.fastq.bz2"]
    assert supported(spark, good) == [True] * len(good)
    assert supported(spark, bad) == [False] * len(bad)


def test_suffixes_are_taken_as_given(spark):
    assert supported(spark, ["a.vcf", "a.VCF"], [".VCF"]) == [False, False]
    assert supported(spark, ["a.pdf", "b"], [".vcf", ""]) == [True, True]
    assert supported(spark, ["a.vcf"], []) == [False]
    assert supported(spark, ["a.vcf"], [" .vcf"]) == [False]


def test_parse_extensions():
    assert fn.parse_extensions(".vcf,.bam") == [".vcf", ".bam"]
    assert fn.parse_extensions(".vcf,,") == [".vcf"]
    assert fn.parse_extensions("a,,b") == ["a", "", "b"]
    assert fn.parse_extensions("") == [""]


@pytest.mark.parametrize("root", ["/data", "/data/"])
def test_top_level_dir(spark, root):
    paths = ["/data/a.vcf", "/data/x/a.vcf", "/data/x/y/a.vcf", "/data2/x/a.vcf"]
    got = values(spark, [(p,) for p in paths], "p STRING", fn.top_level_dir("p", root))
    assert got == ["", "x", "x", ".."]


def test_top_level_dir_of_file_system_root(spark):
    got = values(spark, [("/a.vcf",), ("/x/a.vcf",)], "p STRING", fn.top_level_dir("p", "/"))
    assert got == ["", "x"]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_last_modified(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        # The third falls into the hour that New York skips in spring.
        rows = [(1704067200999,), (0,), (1710037800000,), (-1,), (None,)]
        got = values(spark, rows, "ms BIGINT", fn.last_modified_utc("ms"))
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert got == [
        "2024-01-01T00:00:00Z",
        "1970-01-01T00:00:00Z",
        "2024-03-10T02:30:00Z",
        "1969-12-31T23:59:59Z",
        "unknown",
    ]


def test_columns_of_any_name(spark):
    name = "size in `bytes`"
    assert values(spark, [(2048,)], "n BIGINT", fn.human_size("n")) == ["2.0 KB"]
    df = spark.createDataFrame([(2048, "ab" * 32)], "n BIGINT, h STRING").toDF(name, "the hash")
    row = df.select(fn.human_size(name), fn.short_hash("the hash"), fn.last_modified_utc(name)).first()
    assert tuple(row) == ("2.0 KB", "abababababab...", "1970-01-01T00:00:02Z")
