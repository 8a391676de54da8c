"""All registered queries, in one place."""

from checks import io_queries, masking_queries, run_queries, table_queries  # noqa: F401
from checks.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
