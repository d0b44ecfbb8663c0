from .table_scan import TableScan, scan_table
from .tree_scan import TreeScan, review_from_report, scan_tree

__all__ = ["TableScan", "TreeScan", "review_from_report", "scan_table", "scan_tree"]
