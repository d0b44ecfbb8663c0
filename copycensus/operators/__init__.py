from .bucket_cache import BucketCache
from .bucket_table import BucketTable
from .cache import HashCache, cache_lookup, cache_misses, hash_stats, latest_entries
from .candidates import candidate_stats, mapped_size_candidates, size_candidates, size_histogram, supported_files
from .group_index import GroupIndex
from .groups import attach_groups, duplicate_groups, number_groups, scan_summary, spanning_groups
from .incremental import incremental_fingerprints
from .report import (
    duplicate_report,
    groups_from_report,
    invalid_report_groups,
    report_members,
    report_with_stats,
)
from .review import (
    archive_action_list,
    conflicting_decisions,
    high_priority,
    invalid_decisions,
    one_decision_each,
    review_paths,
    review_paths_in_order,
    review_progress,
    review_queue,
    review_summary,
    suspicious,
    with_decisions,
)

__all__ = [
    "BucketCache",
    "BucketTable",
    "GroupIndex",
    "HashCache",
    "archive_action_list",
    "attach_groups",
    "cache_lookup",
    "cache_misses",
    "conflicting_decisions",
    "candidate_stats",
    "duplicate_groups",
    "duplicate_report",
    "groups_from_report",
    "hash_stats",
    "high_priority",
    "incremental_fingerprints",
    "invalid_decisions",
    "invalid_report_groups",
    "latest_entries",
    "mapped_size_candidates",
    "number_groups",
    "one_decision_each",
    "report_members",
    "report_with_stats",
    "review_paths",
    "review_paths_in_order",
    "review_progress",
    "review_queue",
    "review_summary",
    "scan_summary",
    "size_candidates",
    "size_histogram",
    "spanning_groups",
    "suspicious",
    "supported_files",
    "with_decisions",
]
