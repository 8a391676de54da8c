"""What happened in a run: an append-only list of events, and the state it adds up to."""

from __future__ import annotations

import json
import threading
from collections.abc import Iterable, Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskframe.operators import audit
from maskframe.plans.publish import AUDIT_FIELDS, Store, live, manifests

EVENT_SCHEMA = (
    "run_id string, seq long, level string, event_type string, table_id string, column_name string, "
    "status string, rows long, payload string"
)
_LEVELS = {
    "polymorphic_fk_warning": "warning", "implied_fk_warning": "warning", "strict_mode_violation": "error",
    "table.failed": "error", "run.failed": "error",
}
#: The state a table or a run is in after an event.
_STATUS = {
    "table.pending": "pending", "table.started": "in_progress", "table.done": "done", "table.failed": "failed",
    "run.started": "in_progress", "run.succeeded": "succeeded", "run.failed": "failed",
}


class Ledger:
    """Appends events of one run below ``out/_events``; no event is ever changed.

    Each append is one small file that appears whole or not at all, so what was reported before
    a crash stays. Payloads hold names, counts and reasons, never values of the data. A run that goes on
    under the same id continues its numbers.
    """

    def __init__(self, spark: SparkSession, out: str, run_id: str) -> None:
        self._store, self._run_id = Store(spark, out), run_id
        self._folder = f"{out}/_events/{run_id}"
        self._lock = threading.Lock()
        self._next = max((int(n.split("-")[1][:8]) + 1 for n in self._store.names(self._folder) if n.endswith(".json")), default=0)

    def append(self, events: Iterable[Mapping[str, Any]]) -> None:
        """Write events given as mappings with ``event_type`` and, if it applies, table, column, rows and payload."""
        with self._lock:
            lines, first = [], self._next
            for event in events:
                kind = event["event_type"]
                lines.append(json.dumps({
                    "run_id": self._run_id, "seq": self._next, "level": _LEVELS.get(kind, "info"), "event_type": kind,
                    "table_id": event.get("table_id"), "column_name": event.get("column_name"),
                    "status": _STATUS.get(kind), "rows": event.get("rows"),
                    "payload": json.dumps(event.get("payload", {}), sort_keys=True),
                }))
                self._next += 1
            if lines:
                self._store.write_text(f"{self._folder}/{first:08d}-{self._next - 1:08d}.json", "\n".join(lines) + "\n")


def run_events(spark: SparkSession, out: str, run_id: str | None = None) -> DataFrame:
    """All events below ``out``, or those of one run. ``seq`` gives their order within a run."""
    store = Store(spark, out)
    runs = [r for r in store.names(f"{out}/_events") if run_id in (None, r)]
    if not runs:
        return spark.createDataFrame([], EVENT_SCHEMA)
    return spark.read.schema(EVENT_SCHEMA).option("mode", "FAILFAST").json([f"{out}/_events/{r}" for r in runs])


def latest_status(events: DataFrame) -> DataFrame:
    """``(run_id, table_id, status, rows)``: what the last event with a status left; table null is the run itself."""
    return events.where("status IS NOT NULL").groupBy("run_id", "table_id").agg(
        F.max_by("status", "seq").alias("status"), F.max_by("rows", "seq").alias("rows")
    )


def previous_tables(spark: SparkSession, out: str, run_id: str) -> set[str] | None:
    """Tables that other runs below ``out`` knew, None if there was no other run."""
    events = run_events(spark, out).where((F.col("event_type") == "table.pending") & (F.col("run_id") != run_id))
    found = {r["table_id"] for r in events.select("table_id").distinct().collect()}
    return found or None


def finished_attempts(spark: SparkSession, out: str) -> DataFrame:
    """``(run_id, table_id, attempt, seq, rows, bytes, salt_fingerprint, rules_hash)`` of the attempts tables consist of."""
    store = Store(spark, out)
    rows = [
        (m.run_id, m.table_id, m.attempt, m.seq, m.rows, m.bytes, m.salt_fingerprint, m.rules_hash)
        for t in sorted(store.names(f"{out}/_manifests")) for m in live(manifests(spark, out, t))
    ]
    return spark.createDataFrame(
        rows, "run_id string, table_id string, attempt string, seq long, rows long, bytes long, salt_fingerprint string, rules_hash string"
    )


def audit_of_tables(spark: SparkSession, out: str) -> DataFrame:
    """Cells seen and changed per column over all attempts a table consists of, so before a resume as well."""
    store = Store(spark, out)
    fields = [f.split()[0] for f in AUDIT_FIELDS.split(", ")]
    rows = [
        (m.table_id, *(a[f] for f in fields))
        for t in sorted(store.names(f"{out}/_manifests")) for m in live(manifests(spark, out, t)) for a in m.audit
    ]
    events = spark.createDataFrame(rows, f"table_id string, {AUDIT_FIELDS}")
    return events.groupBy("event_type", "table_id", "column_name", "action").agg(
        F.sum("cells_seen").alias("cells_seen"), F.sum("cells_changed").alias("cells_changed")
    )


def summary_of_run(spark: SparkSession, out: str, run_id: str, profiles: DataFrame | None = None) -> DataFrame:
    """Per table of a run: attempts, rows, bytes, last attempt, status, salt fingerprint and hash of its rules.

    Status comes from the ledger, rows from the manifests. Bytes are those of the files, or with
    ``profiles`` (as :func:`maskframe.operators.profile.profile` gives) rows times average widths.
    """
    attempts = finished_attempts(spark, out).where(F.col("run_id") == run_id)
    rolled = attempts.groupBy("table_id").agg(
        F.count("*").alias("attempts"), F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes"),
        F.max_by("attempt", "seq").alias("last_attempt"), F.max_by("salt_fingerprint", "seq").alias("salt_fingerprint"),
        F.max_by("rules_hash", "seq").alias("rules_hash"),
    )
    status = latest_status(run_events(spark, out, run_id)).where("table_id IS NOT NULL").select("table_id", "status")
    joined = status.join(rolled, "table_id", "left_outer")
    if profiles is not None:
        joined = joined.join(audit.row_widths(profiles), "table_id", "left_outer").withColumn(
            "bytes", F.floor(F.coalesce("row_width", F.lit(0.0)) * F.col("rows")).cast("long")
        )
    return joined.select(
        F.lit(run_id).alias("run_id"), "table_id", F.coalesce("attempts", F.lit(0)).alias("attempts"),
        F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("bytes", F.lit(0)).alias("bytes"), "last_attempt", "status",
        "salt_fingerprint", "rules_hash",
    )
