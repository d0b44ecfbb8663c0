"""Duplicate scan of a table with a content column."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from .. import workspace
from ..functions.scalars import DEFAULT_EXTENSIONS
from ..operators import groups as g
from ..operators.report import duplicate_report
from ..sources.content import table_fingerprints


@dataclass
class TableScan:
    """Results of a scan. Both tables are stored and narrow, so they may be read repeatedly."""

    fingerprints: DataFrame
    groups: DataFrame

    def report(self) -> DataFrame:
        return duplicate_report(self.fingerprints, self.groups)

    def summary(self) -> DataFrame:
        return g.scan_summary(self.groups)


def scan_groups(files: DataFrame, root: str, extensions: Sequence[str] = DEFAULT_EXTENSIONS) -> DataFrame:
    """Numbered duplicate groups of ``files`` (path, content, modified_ms).

    One pass over the content. Only the groups are stored, as numbering reads them twice.
    """
    found = g.duplicate_groups(table_fingerprints(files, extensions), root)
    return g.number_groups(workspace.snapshot(found, "groups"))


def scan_table(files: DataFrame, root: str, extensions: Sequence[str] = DEFAULT_EXTENSIONS) -> TableScan:
    """Fingerprint ``files`` (path, content, modified_ms) and group equal content.

    One pass over the content. The narrow fingerprints are stored, as the members of a group can
    be picked only once all groups are known.
    """
    fingerprints = workspace.snapshot(table_fingerprints(files, extensions), "fingerprints")
    found = workspace.snapshot(g.duplicate_groups(fingerprints, root), "groups")
    return TableScan(fingerprints, workspace.snapshot(g.number_groups(found), "numbered"))
