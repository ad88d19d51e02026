"""Raw text files, catalog tables and report files."""

from burnish.sources.raw import malformed_count, read_raw
from burnish.sources.reports import ReportSet, current_reports, publish_reports, write_report
from burnish.sources.scratch import scratch_dir, stored
from burnish.sources.tables import load_table, save_table

__all__ = [
    "ReportSet", "current_reports", "load_table", "malformed_count", "publish_reports", "read_raw", "save_table",
    "scratch_dir", "stored", "write_report",
]
