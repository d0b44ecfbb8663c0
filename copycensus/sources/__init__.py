from .content import table_fingerprints
from .report_csv import read_report, write_report
from .tree import deal_by_bytes, hash_files, inventory, stat_files

__all__ = [
    "deal_by_bytes",
    "hash_files",
    "inventory",
    "read_report",
    "stat_files",
    "table_fingerprints",
    "write_report",
]
