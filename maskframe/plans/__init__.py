"""Whole-run plans built from the operators."""

from maskframe.plans.config import RunConfig
from maskframe.plans.ledger import audit_of_tables, latest_status, run_events, summary_of_run
from maskframe.plans.publish import published, settle
from maskframe.plans.run import Inspection, RunResult, dry_run, report_lines, run, verify_run

__all__ = [
    "Inspection", "RunConfig", "RunResult", "audit_of_tables", "dry_run", "latest_status", "published",
    "report_lines", "run", "run_events", "settle", "summary_of_run", "verify_run",
]
