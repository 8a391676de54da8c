"""Readers, writers and synthetic inputs."""

from maskframe.sources.read import (
    apply_strategy, cursor_after, range_predicates, read_after, read_files, read_jdbc, read_table,
    row_filter, split_query,
)
from maskframe.sources.synth import synth_customers
from maskframe.sources.write import (
    copy_passthrough, dual_write, sink_stats, write_files, write_jdbc, write_table,
)

__all__ = [
    "apply_strategy", "copy_passthrough", "cursor_after", "dual_write", "range_predicates", "read_after",
    "read_files", "read_jdbc", "read_table", "row_filter", "sink_stats", "split_query",
    "synth_customers", "write_files", "write_jdbc", "write_table",
]
