"""Find and review duplicate content at scale with Spark."""

from .plans import TableScan, TreeScan, review_from_report, scan_table, scan_tree

__all__ = ["TableScan", "TreeScan", "review_from_report", "scan_table", "scan_tree"]
