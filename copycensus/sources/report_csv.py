"""The duplicate report as CSV, written and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..commits import publish, published
from ..operators.report import REPORT_COLUMNS
from .csv_blocks import lines_are_records, read_records

# Paths may hold quotes, line breaks and spaces at either end; these options bring them back whole.
CSV_OPTIONS = {
    "header": True,
    "escape": '"',
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}

ROWS_PER_FILE = 1_000_000


def write_report(report: DataFrame, path: str) -> dict[str, int]:
    """Write the report in group order and return its ``groups`` and ``rows``.

    A report without rows still gets its header. The totals are taken while writing. It takes the
    place of an earlier report by a commit, once it is complete.
    """
    totals = Observation("report")
    rows = (
        report.select(*REPORT_COLUMNS)
        .orderBy("group_id", F.desc("is_original"), "file_path")
        .observe(totals, F.count_if("is_original").alias("groups"), F.count("*").alias("rows"))
    )
    writer = rows.write.option("maxRecordsPerFile", ROWS_PER_FILE).options(**CSV_OPTIONS)
    publish(report.sparkSession, writer, "csv", path)
    return totals.get


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """Read a report: rows with fewer than six cells are dropped, bad numbers become 0.

    A blank last cell is a cell; its row is no original. Files of any size are read block by block, also
    where paths hold line breaks.
    """
    # Both a blank and a missing cell are null; the reader sets aside the text of rows with too few cells.
    schema = ", ".join(f"{c} STRING" for c in (*REPORT_COLUMNS, "_odd_row"))
    path, options = published(spark, path), CSV_OPTIONS | {"columnNameOfCorruptRecord": "_odd_row"}
    if lines_are_records(spark, path):
        raw = spark.read.schema(schema).options(**options).csv(path)
    else:
        options |= {"header": False, "multiLine": True}
        options = {name: str(value).lower() if isinstance(value, bool) else value for name, value in options.items()}
        raw = read_records(spark, path).select(F.from_csv("record", schema, options).alias("row")).select("row.*")
    whole = F.col("is_original").isNotNull() | F.col("_odd_row").isNull()

    def number(name: str):
        return F.coalesce(F.expr(f"try_cast(trim({name}) AS BIGINT)"), F.lit(0).cast("bigint")).alias(name)

    return raw.filter(whole).select(
        number("group_id"),
        F.trim("sha256").alias("sha256"),
        "file_path",
        number("file_size_bytes"),
        F.trim("last_modified").alias("last_modified"),
        F.coalesce(F.lower(F.trim("is_original")) == "true", F.lit(False)).alias("is_original"),
    )
