"""

The ``documents`` table plays a file tree with root ``/data``: one row is one file and ``text`` is
its content. Paths, suffixes and times follow from ``doc_id``, ``source`` and ``lang``.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Callable

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from copycensus import functions as fn
from copycensus import operators as op
from copycensus import sources, workspace
from copycensus.operators.cache import HashCache
from copycensus.plans.table_scan import scan_groups, scan_table
from copycensus.plans.tree_scan import find_candidates, scan_tree
from copycensus.sources import read_report, table_fingerprints, write_report
from copycensus.sources.report_csv import CSV_OPTIONS
from oracle_queries import ORACLE_SQL

ROOT = "/data"

DOCUMENTS_SCHEMA = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"
PAGES_SCHEMA = "page_id BIGINT, url STRING, html STRING"

# The suffix of a document is the one at position doc_id % 10.
SUFFIX = """element_at(
  array('.vcf', '.vcf.gz', '.g.vcf', '.g.vcf.gz', '.bam', '.fastq', '.fastq.gz', '.txt', '.VCF', '.pdf'),
  int(doc_id % 10 + 1))"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as files: doc_id, path, content, modified_ms."""
    documents = spark.read.schema(DOCUMENTS_SCHEMA).parquet(f"{sf_dir}/documents.parquet")
    deeper = f"concat('{ROOT}/vol', int(substr(source, 4)) % 3, '/', lang, '/')"
    folder = f"CASE WHEN doc_id % 7 = 0 THEN '{ROOT}/' ELSE {deeper} END"
    return documents.selectExpr(
        "doc_id",
        f"concat({folder}, 'doc_', doc_id, {SUFFIX}) AS path",
        "text AS content",
        "1704067200000 + doc_id * 61001 AS modified_ms",
    )


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inventory of those files: doc_id, path, size_bytes, modified_ms."""
    return files(spark, sf_dir).select(
        "doc_id", "path", F.octet_length("content").cast("bigint").alias("size_bytes"), "modified_ms"
    )


def stored_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The supported part of the inventory, stored so that sizes are taken in one pass over the texts."""
    return workspace.snapshot(op.supported_files(listing(spark, sf_dir)), "listing")


def table_folder(sf_dir: str) -> str:
    """The folder of the tables as a plain path; it must be on a mount that executors see."""
    return os.path.abspath(sf_dir.removeprefix("file://").removeprefix("file:"))


def below(root: str):
    return F.substr("path", F.lit(len(root) + 2)).alias("name")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The web pages as files; no two are alike."""
    return spark.read.schema(PAGES_SCHEMA).parquet(f"{sf_dir}/pages.parquet").select(
        F.concat(F.lit(f"{ROOT}/page_"), F.col("page_id").cast("string"), F.lit(".txt")).alias("path"),
        F.col("html").alias("content"),
        F.lit(1704067200000).alias("modified_ms"),
    )


def earlier_cache(spark: SparkSession, fingerprinted: DataFrame) -> DataFrame:
    """Cache of an earlier run: every third file, half of them with an outdated time.

    Digests are stored in upper case, so a reused one can be told from a fresh one.
    """
    doc = F.regexp_extract("path", "doc_([0-9]+)", 1).cast("bigint")
    return fingerprinted.filter(doc % 3 == 0).select(
        "path",
        F.when(doc % 2 == 0, F.col("modified_ms")).otherwise(F.col("modified_ms") - 1).alias("modified_ms"),
        F.upper("sha256").alias("sha256"),
    )


def stored_cache(spark: SparkSession, fingerprinted: DataFrame) -> HashCache:
    cache = HashCache(spark, workspace.scratch_path(spark, "hash-cache"))
    cache.append(earlier_cache(spark, fingerprinted))
    return cache


def decisions(groups: DataFrame) -> DataFrame:
    """Answers of reviewers, picked by the first byte of the digest; some are blank or not allowed."""
    kind = (F.conv(F.substring("sha256", 1, 2), 16, 10).cast("int") % 6).cast("int")
    answers = ("Pending", "Archive duplicates", "Keep all", "Escalate", "Delete", None)
    return groups.select(
        "sha256",
        F.element_at(F.array(*(F.lit(a) for a in answers)), kind + 1).alias("decision"),
        F.when(kind > 0, F.concat(F.lit("reviewer "), kind.cast("string"))).alias("reviewer"),
        F.when(kind == 3, F.lit("please check")).alias("notes"),
    )


# ---- files -------------------------------------------------------------------------------------


def q_inventory_virtual(spark, sf_dir):
    return listing(spark, sf_dir)


def q_supported_files(spark, sf_dir):
    return op.supported_files(listing(spark, sf_dir)).select("path", "size_bytes")


def q_supported_files_custom(spark, sf_dir):
    wanted = fn.parse_extensions(".vcf,.VCF,.bam,")
    return op.supported_files(listing(spark, sf_dir), wanted).select("path", "size_bytes")


def q_size_candidates(spark, sf_dir):
    return op.size_candidates(stored_listing(spark, sf_dir)).select("path", "size_bytes", "modified_ms")


def q_mapped_size_candidates(spark, sf_dir):
    return op.mapped_size_candidates(stored_listing(spark, sf_dir)).select("path", "size_bytes", "modified_ms")


def q_full_map_size_candidates(spark, sf_dir):
    """The same with a map so small that all its bits are set."""
    return op.mapped_size_candidates(stored_listing(spark, sf_dir), bits=4).select("path", "size_bytes", "modified_ms")


def q_candidate_snapshot(spark, sf_dir):
    found = op.size_candidates(stored_listing(spark, sf_dir))
    return workspace.snapshot(found, "candidates").select("path")


def q_size_histogram(spark, sf_dir):
    return op.size_histogram(op.supported_files(listing(spark, sf_dir)))


def q_candidate_stats(spark, sf_dir):
    return op.candidate_stats(op.supported_files(listing(spark, sf_dir)))


def q_content_fingerprint(spark, sf_dir):
    return table_fingerprints(files(spark, sf_dir)).select("path", "size_bytes", "sha256")


def q_human_size(spark, sf_dir):
    scaled = listing(spark, sf_dir).select(
        "doc_id", F.explode(F.array(*(F.col("size_bytes") * F.lit(1024**i) for i in range(4)))).alias("n_bytes")
    )
    return scaled.select("doc_id", "n_bytes", fn.human_size("n_bytes").alias("shown"))


def q_top_level_dir(spark, sf_dir):
    return files(spark, sf_dir).select("path", fn.top_level_dir("path", ROOT).alias("top_dir"))


def q_last_modified_utc(spark, sf_dir):
    known = F.when(F.col("doc_id") % 5 != 2, F.col("modified_ms")).alias("known_ms")
    seen = files(spark, sf_dir).select("path", known)
    return seen.select("path", fn.last_modified_utc("known_ms").alias("last_modified"))


def q_inventory(spark, sf_dir):
    """The files that hold the tables, listed as a tree."""
    root = table_folder(sf_dir)
    return sources.inventory(spark, root, [".parquet"]).select(below(root), "size_bytes", "error")


def q_file_fingerprints(spark, sf_dir):
    """Digests of the files that hold the tables, each read in full."""
    root = table_folder(sf_dir)
    found = workspace.snapshot(sources.inventory(spark, root, [".parquet"]), "inventory")
    dealt = sources.deal_by_bytes(found.filter(F.col("error").isNull()))
    return sources.hash_files(dealt).select(below(root), "size_bytes", "sha256", "error")


#: Every so many documents one is a dangling link in the tree, with a target of this length.
BROKEN_EVERY, BROKEN_LINK = 97, "missing-file"


def documents_tree(spark: SparkSession, sf_dir: str) -> str:
    """The documents as files in a tree below the shared folder, with their times; some are dangling links.

    Tasks write them; the shared folder must be on a mount.
    """
    root = workspace.scratch_path(spark, "tree").removeprefix("file://").removeprefix("file:")

    def write(batches):
        import os

        import pyarrow as pa

        for batch in batches:
            for doc_id, path, content, modified_ms in zip(*(c.to_pylist() for c in batch.columns)):
                place = root + path.removeprefix(ROOT)
                os.makedirs(os.path.dirname(place), exist_ok=True)
                if doc_id % BROKEN_EVERY == 0:
                    if not os.path.islink(place):
                        os.symlink(BROKEN_LINK, place)
                    continue
                with open(place, "wb") as f:
                    f.write((content or "").encode())
                os.utime(place, ns=(0, modified_ms * 1_000_000))
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    dealt = files(spark, sf_dir).select("doc_id", "path", "content", "modified_ms")
    dealt.mapInArrow(write, "n BIGINT").write.format("noop").mode("overwrite").save()
    return root


def tree_scan_of(spark: SparkSession, sf_dir: str, scans: int = 1, **options):
    """The scan of that tree, after ``scans`` scans with one output folder."""
    root, out = documents_tree(spark, sf_dir), workspace.scratch_path(spark, "scan-out")
    if options.pop("resumed", False):
        find_candidates(spark, root, out, fn.scalars.DEFAULT_EXTENSIONS)
    for _ in range(scans):
        found = scan_tree(spark, root, out, **options)
    return root, out, found


def q_tree_report(spark, sf_dir):
    """The report of a scan of the documents as a file tree, with its paths below the root of the other queries."""
    root, _, found = tree_scan_of(spark, sf_dir)
    return found.report.withColumn("file_path", F.replace("file_path", F.lit(root), F.lit(ROOT)))


def q_tree_report_resumed(spark, sf_dir):
    """The same after a run that broke off once its candidates were stored, with the cache by bucket."""
    root, _, found = tree_scan_of(spark, sf_dir, resumed=True, cache_buckets=4)
    return found.report.withColumn("file_path", F.replace("file_path", F.lit(root), F.lit(ROOT)))


def q_tree_walk_stats(spark, sf_dir):
    return tree_scan_of(spark, sf_dir)[2].walk_stats


def q_tree_hash_stats(spark, sf_dir):
    """Counters of a first scan: dangling links fail and go no further."""
    return tree_scan_of(spark, sf_dir)[2].hash_stats


def q_tree_hash_stats_again(spark, sf_dir):
    """Counters of a second scan: all but the failed ones are hits."""
    return tree_scan_of(spark, sf_dir, scans=2, cache_buckets=4)[2].hash_stats


# ---- groups and report -------------------------------------------------------------------------


def q_duplicate_groups(spark, sf_dir):
    return scan_groups(files(spark, sf_dir), ROOT)


def q_group_index(spark, sf_dir):
    """Groups kept up to date: an index of earlier files takes in the files that came, changed and went."""
    known = fingerprints(spark, sf_dir)
    doc = F.regexp_extract("path", "doc_([0-9]+)", 1).cast("bigint")
    changed, came = doc % 7 == 3, doc % 5 == 0
    earlier = known.filter(~came).withColumn("sha256", F.when(changed, F.sha2("path", 256)).otherwise(F.col("sha256")))
    gone = known.filter(doc % 3 == 0).withColumn("path", F.replace("path", F.lit("/doc_"), F.lit("/a_doc_")))
    index = op.GroupIndex(spark, workspace.scratch_path(spark, "group-index"), ROOT, buckets=8)
    index.update(earlier.unionByName(gone))
    index.update(known.filter(came | changed).unionByName(gone.withColumn("sha256", F.lit(None).cast("string"))))
    return index.groups()


def q_spanning_groups(spark, sf_dir):
    found = op.duplicate_groups(table_fingerprints(files(spark, sf_dir)), ROOT)
    return op.spanning_groups(found).select("sha256", "file_count")


def q_scan_summary(spark, sf_dir):
    return op.scan_summary(op.duplicate_groups(table_fingerprints(files(spark, sf_dir)), ROOT))


def q_pages_scan_summary(spark, sf_dir):
    return op.scan_summary(op.duplicate_groups(table_fingerprints(pages(spark, sf_dir)), ROOT))


def q_duplicate_report(spark, sf_dir):
    return scan_table(files(spark, sf_dir), ROOT).report()


def q_duplicate_report_split(spark, sf_dir):
    """The report with every group of more than two files cut into pieces."""
    scan = scan_table(files(spark, sf_dir), ROOT)
    return op.duplicate_report(scan.fingerprints, scan.groups, hot_rows=2)


def q_invalid_report_groups(spark, sf_dir):
    """Groups of a report in which every fifth file is marked as an original, too."""
    report = scan_table(files(spark, sf_dir), ROOT).report()
    doc = F.regexp_extract("file_path", "doc_([0-9]+)", 1).cast("bigint")
    return op.invalid_report_groups(report.withColumn("is_original", F.col("is_original") | (doc % 5 == 0)))


def q_report_with_stats(spark, sf_dir):
    scan = scan_table(files(spark, sf_dir), ROOT)
    doc = F.regexp_extract("path", "doc_([0-9]+)", 1).cast("bigint")
    stats = scan.fingerprints.filter(doc % 5 != 2)
    return op.report_with_stats(scan.fingerprints, scan.groups, stats)


def q_groups_from_report(spark, sf_dir):
    path = workspace.scratch_path(spark, "report")
    write_report(scan_table(files(spark, sf_dir), ROOT).report(), path)
    return op.groups_from_report(read_report(spark, path), ROOT)


def odd_path(path: str):
    """Paths with quotes, a comma and a line break of two characters."""
    return F.replace(path, F.lit("/doc_"), F.lit('/"doc",\r\n_'))


def q_groups_from_one_file(spark, sf_dir):
    """Groups of a report that another tool wrote: one file, and cells that hold quotes and line breaks."""
    report = scan_table(files(spark, sf_dir), ROOT).report().withColumn("file_path", odd_path("file_path"))
    path = workspace.scratch_path(spark, "one-file")
    report.coalesce(1).write.options(**CSV_OPTIONS).csv(path)
    return op.groups_from_report(read_report(spark, path), ROOT)


def q_report_committed_twice(spark, sf_dir):
    """What a reader finds after a report has taken the place of another."""
    report = workspace.snapshot(scan_table(files(spark, sf_dir), ROOT).report(), "report")
    path = workspace.scratch_path(spark, "report")
    write_report(report.withColumn("group_id", F.col("group_id") + 1), path)
    write_report(report, path)
    return read_report(spark, path)


# ---- hash cache --------------------------------------------------------------------------------


def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workspace.snapshot(table_fingerprints(files(spark, sf_dir)), "fingerprints")


def q_hash_cache_size(spark, sf_dir):
    return stored_cache(spark, fingerprints(spark, sf_dir)).size()


def q_cache_lookup(spark, sf_dir):
    known = fingerprints(spark, sf_dir)
    cache = stored_cache(spark, known).load()
    return op.cache_lookup(op.size_candidates(known.drop("sha256")), cache).select("path", "cache_hit", "sha256")


def q_incremental_misses(spark, sf_dir):
    known = fingerprints(spark, sf_dir)
    cache = stored_cache(spark, known).load()
    return op.cache_misses(op.size_candidates(known.drop("sha256")), cache).select("path", "size_bytes", "modified_ms")


def incremental(known: DataFrame, cache: DataFrame) -> DataFrame:
    """Digests of the candidates: the cached one on a hit, else the fresh one.

    The content sits in the scanned row, so the fresh digest is taken during the scan; joining
    the cache first would shuffle the content itself.
    """
    candidates = op.size_candidates(known.withColumnRenamed("sha256", "fresh"))
    return op.cache_lookup(candidates, cache).withColumn("sha256", F.coalesce("sha256", "fresh"))


def q_incremental_fingerprints(spark, sf_dir):
    known = fingerprints(spark, sf_dir)
    found = incremental(known, stored_cache(spark, known).load())
    return found.select("path", "size_bytes", "modified_ms", "sha256", "cache_hit")


def q_hash_cache_upsert(spark, sf_dir):
    known = fingerprints(spark, sf_dir)
    cache = stored_cache(spark, known)
    fresh = incremental(known, cache.load()).filter("NOT cache_hit").select("path", "modified_ms", "sha256")
    cache.append(fresh)
    return cache.load()


def q_cache_compacted(spark, sf_dir):
    known = fingerprints(spark, sf_dir)
    cache = stored_cache(spark, known)
    cache.keep_segments = 1
    fresh = incremental(known, cache.load()).filter("NOT cache_hit").select("path", "modified_ms", "sha256")
    cache.append(fresh)
    cache.compact()
    return cache.load()


def bucket_cache(spark: SparkSession, fingerprinted: DataFrame) -> op.BucketCache:
    """The earlier cache, stored by bucket."""
    cache = op.BucketCache(spark, workspace.scratch_path(spark, "bucket-cache"), buckets=8, fanout=2)
    cache.append(earlier_cache(spark, fingerprinted))
    return cache


def q_bucket_cache_lookup(spark, sf_dir):
    known = fingerprints(spark, sf_dir)
    candidates = op.size_candidates(known.drop("sha256"))
    return bucket_cache(spark, known).lookup(candidates).select("path", "cache_hit", "sha256")


def q_bucket_cache_upsert(spark, sf_dir):
    """The cache after the misses were added and its segments merged."""
    known = fingerprints(spark, sf_dir)
    cache = bucket_cache(spark, known)
    fresh = incremental(known, cache.load()).filter("NOT cache_hit").select("path", "modified_ms", "sha256")
    cache.append(fresh)
    cache.compact(everything=True)
    return cache.load()


def q_incremental_table(spark, sf_dir):
    """Digests of all supported files: those of the cache where path and time are known, others from the scan."""
    cache = bucket_cache(spark, fingerprints(spark, sf_dir)).load()
    found = op.incremental_fingerprints(files(spark, sf_dir), cache)
    return found.select("path", "size_bytes", "modified_ms", "sha256", "cache_hit")


def q_hash_stats_with_errors(spark, sf_dir):
    """Every fourth file that the cache lacks cannot be read."""
    known = fingerprints(spark, sf_dir)
    found = incremental(known, stored_cache(spark, known).load())
    doc = F.regexp_extract("path", "doc_([0-9]+)", 1).cast("bigint")
    broken = ~F.col("cache_hit") & (doc % 4 == 1)
    found = found.withColumn("error", F.when(broken, F.lit("gone")))
    return op.hash_stats(found.withColumn("sha256", F.when(~broken, F.col("sha256"))))


def q_hash_stats(spark, sf_dir):
    known = fingerprints(spark, sf_dir)
    found = incremental(known, stored_cache(spark, known).load())
    return op.hash_stats(found.withColumn("error", F.lit(None).cast("string")))


# ---- review ------------------------------------------------------------------------------------


def q_review_queue(spark, sf_dir):
    scan = scan_table(files(spark, sf_dir), ROOT)
    return op.review_queue(scan.groups, scan.fingerprints, decisions(scan.groups))


def q_high_priority(spark, sf_dir):
    scan = scan_table(files(spark, sf_dir), ROOT)
    return op.high_priority(scan.groups, scan.fingerprints)


def q_suspicious(spark, sf_dir):
    scan = scan_table(files(spark, sf_dir), ROOT)
    return op.suspicious(scan.groups, scan.fingerprints)


def q_review_paths(spark, sf_dir):
    scan = scan_table(files(spark, sf_dir), ROOT)
    return op.review_paths(scan.groups, scan.fingerprints)


def q_review_paths_paged(spark, sf_dir):
    scan = scan_table(files(spark, sf_dir), ROOT)
    return op.review_paths(scan.groups, scan.fingerprints, page_paths=2, hot_rows=3)


def q_review_paths_in_order(spark, sf_dir):
    scan = scan_table(files(spark, sf_dir), ROOT)
    return op.review_paths_in_order(scan.groups, scan.fingerprints, page_paths=2)


def q_review_paths_in_order_split(spark, sf_dir):
    """The same with the members of every group of more than two files dealt by ranges of their paths."""
    scan = scan_table(files(spark, sf_dir), ROOT)
    return op.review_paths_in_order(scan.groups, scan.fingerprints, page_paths=2, hot_rows=2)


def q_high_priority_top(spark, sf_dir):
    scan = scan_table(files(spark, sf_dir), ROOT)
    return op.high_priority(scan.groups, scan.fingerprints, rows=10)


def q_high_priority_decided(spark, sf_dir):
    scan = scan_table(files(spark, sf_dir), ROOT)
    return op.high_priority(scan.groups, scan.fingerprints, decisions(scan.groups))


def q_suspicious_top(spark, sf_dir):
    scan = scan_table(files(spark, sf_dir), ROOT)
    return op.suspicious(scan.groups, scan.fingerprints, rows=10)


def q_invalid_decisions(spark, sf_dir):
    return op.invalid_decisions(decisions(unnumbered(spark, sf_dir))).select("sha256", "decision")


def unnumbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.duplicate_groups(table_fingerprints(files(spark, sf_dir)), ROOT)


def q_review_progress(spark, sf_dir):
    return op.review_progress(decisions(unnumbered(spark, sf_dir)))


def q_archive_action_list(spark, sf_dir):
    scan = scan_table(files(spark, sf_dir), ROOT)
    return op.archive_action_list(scan.groups, scan.fingerprints, decisions(scan.groups))


def q_review_summary(spark, sf_dir):
    found = workspace.snapshot(unnumbered(spark, sf_dir), "groups")
    return op.review_summary(found, decisions(found), ROOT)


_PREFIX = "q_"


def entry(spark: SparkSession) -> DataFrame:
    return q_duplicate_report(spark, "/root/testdata/sf0.001")


def own_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The queries of this module by name; each takes the session and the folder of the tables."""
    return {name[len(_PREFIX):]: f for name, f in globals().items() if name.startswith(_PREFIX)}


def _training_data() -> tuple[dict, dict]:
    """Queries and SQL of the training-data operators; none where those folders are not installed."""
    try:
        import corpus_pipeline
        from copycensus.llm import registry
    except ModuleNotFoundError as missing:
        if not (missing.name or "").startswith(("copycensus.llm", "corpus_pipeline")):
            raise
        return {}, {}
    sql = dict(registry.ORACLE_SQL)
    if corpus_pipeline.ORACLE_SQL:
        sql["pipeline"] = corpus_pipeline.ORACLE_SQL
    return registry.QUERIES | {"pipeline": corpus_pipeline.run}, sql


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Every registered query by name."""
    return own_queries() | _training_data()[0]


def oracle_sql() -> dict[str, str]:
    """The same queries in DuckDB SQL, where SQL can express them."""
    return ORACLE_SQL | _training_data()[1]
