"""DuckDB SQL for every registered query, over the same tables."""

# The documents as files below /data.
FILES = """
files AS (
  SELECT doc_id,
         CASE WHEN doc_id % 7 = 0 THEN '/data/doc_' || doc_id || e
              ELSE '/data/vol' || (CAST(substr(source, 4) AS INT) % 3) || '/' || lang || '/doc_' || doc_id || e
         END AS path,
         CAST(strlen(text) AS BIGINT) AS size_bytes,
         1704067200000 + doc_id * 61001 AS modified_ms,
         sha256(text) AS sha256
  FROM (SELECT *, (['.vcf', '.vcf.gz', '.g.vcf', '.g.vcf.gz', '.bam', '.fastq', '.fastq.gz', '.txt', '.VCF',
                    '.pdf'])[doc_id % 10 + 1] AS e
        FROM documents))"""

# Suffix filter, then files that share their size.
CANDIDATES = FILES + """,
supported AS (
  SELECT * FROM files
  WHERE regexp_matches(lower(path), '(\\.vcf|\\.vcf\\.gz|\\.bam|\\.fastq|\\.fastq\\.gz|\\.txt)$')),
candidates AS (
  SELECT * FROM supported
  WHERE size_bytes IN (SELECT size_bytes FROM supported GROUP BY size_bytes HAVING count(*) > 1))"""

GROUPS = CANDIDATES + """,
members AS (
  SELECT c.*,
         CASE WHEN instr(substr(path, 7), '/') > 0 THEN split_part(substr(path, 7), '/', 1) ELSE '' END AS top_dir,
         row_number() OVER (PARTITION BY sha256 ORDER BY path) AS place,
         count(*) OVER (PARTITION BY sha256) AS file_count
  FROM candidates c),
groups AS (
  SELECT CAST(row_number() OVER (ORDER BY sha256) AS BIGINT) AS group_id, *,
         (file_count - 1) * size_bytes AS wasted_bytes
  FROM (SELECT sha256, CAST(count(*) AS BIGINT) AS file_count,
               max(CASE WHEN place = 1 THEN size_bytes END) AS size_bytes,
               max(CASE WHEN place = 1 THEN path END) AS original_path,
               count(DISTINCT top_dir) > 1 AS spanning
        FROM members WHERE file_count > 1 GROUP BY sha256)),
decisions AS (
  SELECT sha256,
         (['Pending', 'Archive duplicates', 'Keep all', 'Escalate', 'Delete', NULL])[kind + 1] AS decision,
         CASE WHEN kind > 0 THEN 'reviewer ' || kind END AS reviewer,
         CASE WHEN kind = 3 THEN 'please check' END AS notes
  FROM (SELECT sha256, CAST('0x' || substr(sha256, 1, 2) AS INT) % 6 AS kind FROM groups))"""

CACHE = CANDIDATES + """,
cache AS (
  SELECT path, CASE WHEN doc_id % 2 = 0 THEN modified_ms ELSE modified_ms - 1 END AS modified_ms,
         upper(sha256) AS sha256
  FROM supported WHERE doc_id % 3 = 0),
found AS (
  SELECT c.path, c.size_bytes, c.modified_ms, c.sha256 AS fresh, h.sha256 AS cached,
         h.sha256 IS NOT NULL AS cache_hit
  FROM candidates c LEFT JOIN cache h ON h.path = c.path AND h.modified_ms = c.modified_ms)"""


def human(n: str) -> str:
    return f"""CASE WHEN {n} >= 1099511627776 THEN printf('%.1f TB', round({n} / 1099511627776.0, 1))
         WHEN {n} >= 1073741824 THEN printf('%.1f GB', round({n} / 1073741824.0, 1))
         WHEN {n} >= 1048576 THEN printf('%.1f MB', round({n} / 1048576.0, 1))
         WHEN {n} >= 1024 THEN printf('%.1f KB', round({n} / 1024.0, 1))
         ELSE {n} || ' B' END"""


UTC = "strftime(make_timestamp(modified_ms * 1000), '%Y-%m-%dT%H:%M:%SZ')"

TOTALS = f"""
totals AS (
  SELECT count(*) AS duplicate_groups,
         CAST(coalesce(sum(file_count - 1), 0) AS BIGINT) AS redundant_files,
         CAST(coalesce(sum(wasted_bytes), 0) AS BIGINT) AS wasted_bytes
  FROM groups),
summary AS (SELECT *, {human('wasted_bytes')} AS wasted_human FROM totals)"""

PROGRESS = """
progress AS (
  SELECT count(CASE WHEN decision <> '' THEN 1 END) - count(CASE WHEN decision = 'Pending' THEN 1 END) AS reviewed,
         count(CASE WHEN decision = 'Archive duplicates' THEN 1 END) AS archive,
         count(CASE WHEN decision = 'Keep all' THEN 1 END) AS keep,
         count(CASE WHEN decision = 'Escalate' THEN 1 END) AS escalated,
         count(CASE WHEN decision = 'Pending' THEN 1 END) AS pending
  FROM decisions)"""


def review(source: str, decided: bool) -> str:
    """Review rows of the groups in ``source``; a page holds 10000 paths."""
    if decided:
        cells = """coalesce(d.decision, 'Pending') AS decision, coalesce(d.reviewer, '') AS reviewer,
       coalesce(d.notes, '') AS notes"""
    else:
        cells = "'Pending' AS decision, '' AS reviewer, '' AS notes"
    return f"""
copies AS (
  SELECT m.sha256, m.path,
         CASE WHEN m.file_count - 1 <= 10000 THEN 1
              ELSE CAST('0x' || substr(md5(m.path), 1, 8) AS BIGINT)
                   % CAST(ceil((m.file_count - 1) / 10000.0) AS BIGINT) + 1
         END AS page
  FROM members m WHERE m.file_count > 1 AND m.place > 1),
pages AS (
  SELECT sha256, CAST(page AS BIGINT) AS page, string_agg(path, chr(10) ORDER BY path) AS duplicates
  FROM copies GROUP BY ALL)
SELECT g.group_id, g.sha256, substr(g.sha256, 1, 12) || '...' AS sha256_short, g.file_count, g.size_bytes,
       {human('g.size_bytes')} AS size_each, g.wasted_bytes, {human('g.wasted_bytes')} AS wasted_space,
       g.original_path, p.page, p.duplicates, {cells}
FROM {source} g JOIN pages p USING (sha256) LEFT JOIN decisions d USING (sha256)"""


REPORT = f"""
SELECT g.group_id, m.sha256, m.path AS file_path, m.size_bytes AS file_size_bytes,
       {UTC.replace('modified_ms', 'm.modified_ms')} AS last_modified, m.place = 1 AS is_original
FROM members m JOIN groups g USING (sha256)"""

def paths(page_paths: int) -> str:
    """All duplicates of all groups, ``page_paths`` to a page on average."""
    return f"""
copies AS (
  SELECT sha256, path,
         CASE WHEN file_count - 1 <= {page_paths} THEN 1
              ELSE CAST('0x' || substr(md5(path), 1, 8) AS BIGINT)
                   % CAST(ceil((file_count - 1) / {page_paths}.0) AS BIGINT) + 1
         END AS page
  FROM members WHERE file_count > 1 AND place > 1)
SELECT sha256, CAST(page AS BIGINT) AS page, string_agg(path, chr(10) ORDER BY path) AS duplicates
FROM copies GROUP BY ALL"""


# The documents as a tree in which some files are dangling links; those count by the length of the link.
def broken(sql: str) -> str:
    sql = sql.replace("CAST(strlen(text) AS BIGINT) AS size_bytes",
                      "CASE WHEN doc_id % 97 = 0 THEN 12 ELSE CAST(strlen(text) AS BIGINT) END AS size_bytes")
    sql = sql.replace("sha256(text) AS sha256", "CASE WHEN doc_id % 97 <> 0 THEN sha256(text) END AS sha256")
    return sql.replace("FROM candidates c)", "FROM candidates c WHERE sha256 IS NOT NULL)")


IN_ORDER = """
SELECT sha256, CAST((place - 2) // 2 + 1 AS BIGINT) AS page, string_agg(path, chr(10) ORDER BY path) AS duplicates
FROM members WHERE file_count > 1 AND place > 1 GROUP BY ALL"""

ODD_PATH = """replace(original_path, '/doc_', '/"doc",' || chr(13) || chr(10) || '_')"""

ORACLE_SQL = {
    "inventory_virtual": f"WITH {FILES} SELECT doc_id, path, size_bytes, modified_ms FROM files",
    "supported_files": f"WITH {CANDIDATES} SELECT path, size_bytes FROM supported",
    "supported_files_custom": f"""WITH {FILES}
SELECT path, size_bytes FROM files
WHERE regexp_matches(lower(split_part(path, '/', -1)), '(\\.vcf|\\.VCF|\\.bam)$')""",
    "size_candidates": f"WITH {CANDIDATES} SELECT path, size_bytes, modified_ms FROM candidates",
    "candidate_snapshot": f"WITH {CANDIDATES} SELECT path FROM candidates",
    "mapped_size_candidates": f"WITH {CANDIDATES} SELECT path, size_bytes, modified_ms FROM candidates",
    "full_map_size_candidates": f"WITH {CANDIDATES} SELECT path, size_bytes, modified_ms FROM candidates",
    "size_histogram": f"""WITH {CANDIDATES}
SELECT size_bytes, count(*) AS file_count FROM supported GROUP BY size_bytes""",
    "candidate_stats": f"""WITH {CANDIDATES}
SELECT (SELECT count(*) FROM supported) AS files_found, (SELECT count(*) FROM candidates) AS candidates,
       (SELECT count(*) FROM supported) - (SELECT count(*) FROM candidates) AS skipped_unique_size""",
    "content_fingerprint": f"WITH {CANDIDATES} SELECT path, size_bytes, sha256 FROM supported",
    "human_size": f"""WITH {FILES}, scaled AS (
  SELECT doc_id, size_bytes * unnest([1, 1024, 1048576, 1073741824]) AS n_bytes FROM files)
SELECT doc_id, n_bytes, {human('n_bytes')} AS shown FROM scaled""",
    "top_level_dir": f"""WITH {FILES}
SELECT path,
       CASE WHEN instr(substr(path, 7), '/') > 0 THEN split_part(substr(path, 7), '/', 1) ELSE '' END AS top_dir
FROM files""",
    "last_modified_utc": f"""WITH {FILES}
SELECT path, CASE WHEN doc_id % 5 = 2 THEN 'unknown' ELSE {UTC} END AS last_modified FROM files""",
    "duplicate_groups": f"""WITH {GROUPS}
SELECT group_id, sha256, file_count, size_bytes, wasted_bytes, original_path, spanning FROM groups""",
    "group_index": f"""WITH {GROUPS}
SELECT sha256, file_count, size_bytes, wasted_bytes, original_path, spanning FROM groups""",
    "spanning_groups": f"WITH {GROUPS} SELECT sha256, file_count FROM groups WHERE spanning",
    "scan_summary": f"WITH {GROUPS}, {TOTALS} SELECT * FROM summary",
    "pages_scan_summary": f"""WITH copies AS (
  SELECT count(*) - 1 AS extra, (count(*) - 1) * any_value(strlen(html)) AS wasted
  FROM pages GROUP BY sha256(html) HAVING count(*) > 1),
totals AS (
  SELECT count(*) AS duplicate_groups, CAST(coalesce(sum(extra), 0) AS BIGINT) AS redundant_files,
         CAST(coalesce(sum(wasted), 0) AS BIGINT) AS wasted_bytes
  FROM copies)
SELECT *, {human('wasted_bytes')} AS wasted_human FROM totals""",
    "duplicate_report": f"WITH {GROUPS} {REPORT}",
    "report_with_stats": f"""WITH {GROUPS}
SELECT g.group_id, m.sha256, m.path AS file_path,
       CASE WHEN m.doc_id % 5 = 2 THEN 0 ELSE m.size_bytes END AS file_size_bytes,
       CASE WHEN m.doc_id % 5 = 2 THEN 'unknown' ELSE {UTC.replace('modified_ms', 'm.modified_ms')}
       END AS last_modified, m.place = 1 AS is_original
FROM members m JOIN groups g USING (sha256)""",
    "groups_from_report": f"""WITH {GROUPS}
SELECT group_id, sha256, file_count, size_bytes, wasted_bytes, original_path, spanning FROM groups""",
    "groups_from_one_file": f"""WITH {GROUPS}
SELECT group_id, sha256, file_count, size_bytes, wasted_bytes, {ODD_PATH} AS original_path, spanning FROM groups""",
    "report_committed_twice": f"WITH {GROUPS} {REPORT}",
    "tree_report": broken(f"WITH {GROUPS} {REPORT}"),
    "tree_report_resumed": broken(f"WITH {GROUPS} {REPORT}"),
    "tree_walk_stats": broken(f"""WITH {CANDIDATES}
SELECT (SELECT count(*) FROM supported) AS files_found, (SELECT count(*) FROM candidates) AS candidates,
       (SELECT count(*) FROM supported) - (SELECT count(*) FROM candidates) AS skipped_unique_size,
       CAST(0 AS BIGINT) AS unreadable"""),
    "tree_hash_stats": broken(f"""WITH {CANDIDATES}
SELECT count(sha256) AS hashed, count(*) AS total, CAST(0 AS BIGINT) AS cache_hits,
       count(*) - count(sha256) AS errors FROM candidates"""),
    "tree_hash_stats_again": broken(f"""WITH {CANDIDATES}
SELECT count(sha256) AS hashed, count(*) AS total, count(sha256) AS cache_hits,
       count(*) - count(sha256) AS errors FROM candidates"""),
    "bucket_cache_lookup": f"WITH {CACHE} SELECT path, cache_hit, cached AS sha256 FROM found",
    "bucket_cache_upsert": f"""WITH {CACHE}, entries AS (
  SELECT path, modified_ms, sha256, 1 AS run_id FROM cache
  UNION ALL SELECT path, modified_ms, fresh, 2 FROM found WHERE NOT cache_hit)
SELECT path, modified_ms, sha256, CAST(run_id AS BIGINT) AS run_id FROM entries
QUALIFY row_number() OVER (PARTITION BY path ORDER BY run_id DESC) = 1""",
    "incremental_table": f"""WITH {CACHE}
SELECT s.path, s.size_bytes, s.modified_ms, coalesce(h.sha256, s.sha256) AS sha256, h.sha256 IS NOT NULL AS cache_hit
FROM supported s LEFT JOIN cache h ON h.path = s.path AND h.modified_ms = s.modified_ms""",
    "hash_cache_size": f"WITH {CACHE} SELECT count(*) AS entries FROM cache",
    "cache_lookup": f"WITH {CACHE} SELECT path, cache_hit, cached AS sha256 FROM found",
    "incremental_misses": f"WITH {CACHE} SELECT path, size_bytes, modified_ms FROM found WHERE NOT cache_hit",
    "incremental_fingerprints": f"""WITH {CACHE}
SELECT path, size_bytes, modified_ms, coalesce(cached, fresh) AS sha256, cache_hit FROM found""",
    "hash_cache_upsert": f"""WITH {CACHE}, entries AS (
  SELECT path, modified_ms, sha256, 1 AS run_id FROM cache
  UNION ALL SELECT path, modified_ms, fresh, 2 FROM found WHERE NOT cache_hit)
SELECT path, modified_ms, sha256, CAST(run_id AS BIGINT) AS run_id FROM entries
QUALIFY row_number() OVER (PARTITION BY path ORDER BY run_id DESC) = 1""",
    "hash_stats": f"""WITH {CACHE}
SELECT count(coalesce(cached, fresh)) AS hashed, count(*) AS total,
       count(CASE WHEN cache_hit THEN 1 END) AS cache_hits, CAST(0 AS BIGINT) AS errors FROM found""",
    "review_queue": f"WITH {GROUPS}, {review('groups', True)}",
    "high_priority": f"""WITH {GROUPS},
top AS (SELECT * FROM groups ORDER BY wasted_bytes DESC, group_id LIMIT 500), {review('top', False)}""",
    "suspicious": f"""WITH {GROUPS},
top AS (SELECT * FROM groups WHERE spanning ORDER BY group_id LIMIT 2000), {review('top', False)}""",
    "review_paths": f"WITH {GROUPS}, {paths(10000)}",
    "review_paths_paged": f"WITH {GROUPS}, {paths(2)}",
    "review_paths_in_order": f"WITH {GROUPS} {IN_ORDER}",
    "review_paths_in_order_split": f"WITH {GROUPS} {IN_ORDER}",
    "high_priority_top": f"""WITH {GROUPS},
top AS (SELECT * FROM groups ORDER BY wasted_bytes DESC, group_id LIMIT 10), {review('top', False)}""",
    "high_priority_decided": f"""WITH {GROUPS},
top AS (SELECT * FROM groups ORDER BY wasted_bytes DESC, group_id LIMIT 500), {review('top', True)}""",
    "suspicious_top": f"""WITH {GROUPS},
top AS (SELECT * FROM groups WHERE spanning ORDER BY group_id LIMIT 10), {review('top', False)}""",
    "duplicate_report_split": f"WITH {GROUPS} {REPORT}",
    "invalid_report_groups": f"""WITH {GROUPS}
SELECT group_id, count(CASE WHEN place = 1 OR doc_id % 5 = 0 THEN 1 END) AS originals, false AS mixed_digests
FROM members m JOIN groups g USING (sha256) GROUP BY group_id
HAVING count(CASE WHEN place = 1 OR doc_id % 5 = 0 THEN 1 END) <> 1""",
    "cache_compacted": f"""WITH {CACHE}, entries AS (
  SELECT path, modified_ms, sha256, 1 AS run_id FROM cache
  UNION ALL SELECT path, modified_ms, fresh, 2 FROM found WHERE NOT cache_hit)
SELECT path, modified_ms, sha256, CAST(run_id AS BIGINT) AS run_id FROM entries
QUALIFY row_number() OVER (PARTITION BY path ORDER BY run_id DESC) = 1""",
    "hash_stats_with_errors": f"""WITH {CACHE}, read AS (
  SELECT *, NOT cache_hit AND CAST(regexp_extract(path, 'doc_([0-9]+)', 1) AS BIGINT) % 4 = 1 AS broken FROM found)
SELECT count(CASE WHEN NOT broken THEN 1 END) AS hashed, count(*) AS total,
       count(CASE WHEN cache_hit THEN 1 END) AS cache_hits, count(CASE WHEN broken THEN 1 END) AS errors FROM read""",
    "invalid_decisions": f"""WITH {GROUPS}
SELECT sha256, decision FROM decisions
WHERE decision NOT IN ('Pending', 'Archive duplicates', 'Keep all', 'Escalate', '')""",
    "review_progress": f"WITH {GROUPS}, {PROGRESS} SELECT * FROM progress",
    "archive_action_list": f"""WITH {GROUPS}
SELECT g.group_id, g.sha256, m.path AS file_path, m.size_bytes
FROM members m JOIN groups g USING (sha256) JOIN decisions d USING (sha256)
WHERE d.decision = 'Archive duplicates' AND m.place > 1""",
    "review_summary": f"""WITH {GROUPS}, {TOTALS}, {PROGRESS}
SELECT 1 AS row_no, 'Scan root' AS label, '/data' AS value
UNION ALL SELECT 3, 'Duplicate groups', CAST(duplicate_groups AS VARCHAR) FROM summary
UNION ALL SELECT 4, 'Redundant files', CAST(redundant_files AS VARCHAR) FROM summary
UNION ALL SELECT 5, 'Total wasted space', wasted_human FROM summary
UNION ALL SELECT 6, 'Groups reviewed', CAST(reviewed AS VARCHAR) FROM progress
UNION ALL SELECT 7, 'Marked for archive', CAST(archive AS VARCHAR) FROM progress
UNION ALL SELECT 8, 'Marked keep all', CAST(keep AS VARCHAR) FROM progress
UNION ALL SELECT 9, 'Escalated', CAST(escalated AS VARCHAR) FROM progress
UNION ALL SELECT 10, 'Pending', CAST(pending AS VARCHAR) FROM progress""",
}
