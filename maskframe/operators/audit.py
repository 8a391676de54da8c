"""Run roll-ups without values: what was masked, detected, skipped and how much was written."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping
from dataclasses import asdict

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from maskframe.context import MaskContext
from maskframe.functions.text import quoted
from maskframe.operators import actions as act
from maskframe.operators.mask import MaskPlan, plan_mask
from maskframe.operators.ner import SpanFinder
from maskframe.operators.profile import unpivot_stats
from maskframe.spec import TableSpec


def audit_masking(
    df: DataFrame,
    rules: act.Rules,
    ctx: MaskContext,
    *,
    table: str | TableSpec,
    run_id: str,
    finder: SpanFinder | None = None,
) -> DataFrame:
    """Per column: the action, non-null cells seen and cells changed.

    Original and masked value sit side by side in the masking projection, so one aggregation
    answers it without joining the output back to the input.
    """
    plan = plan_mask(df, rules, ctx, table=table, finder=finder)
    name = table.name if isinstance(table, TableSpec) else table
    pairs = plan.staged.select(
        *[quoted(c).alias(f"o{i}") for i, c in enumerate(plan.columns)],
        *[plan.masked[c].alias(f"m{i}") for i, c in enumerate(plan.columns) if c in plan.masked],
    )
    aggs = []
    for i, c in enumerate(plan.columns):
        aggs.append(F.count(F.col(f"o{i}")).alias(f"c{i}_cells_seen"))
        changed = F.lit(0)
        if c in plan.masked:
            changed = F.count(F.when(~F.col(f"o{i}").eqNullSafe(F.col(f"m{i}")), 1))
        aggs.append(changed.alias(f"c{i}_cells_changed"))
    stats = unpivot_stats(
        pairs.agg(*aggs), plan.columns, {"cells_seen": "bigint", "cells_changed": "bigint"}
    )
    kinds = F.create_map(*[F.lit(v) for c in plan.columns for v in (c, _kind(rules.get(c)))])
    action = kinds[F.col("column_name")]
    return stats.select(
        F.lit(run_id).alias("run_id"),
        F.when(action == "passthrough", "column.passed_through").otherwise("column.masked").alias("event_type"),
        F.lit(name).alias("table_id"),
        "column_name",
        action.alias("action"),
        "cells_seen",
        "cells_changed",
    )


def observed_mask(plan: MaskPlan, name: str) -> tuple[DataFrame, Observation]:
    """The masked table, counting cells while whatever action consumes it runs.

    Saves the separate pass of :func:`audit_masking`. The observation fills in once a write
    or another full action over the returned frame has finished.
    """
    observation = Observation(name)
    pairs = plan.staged.select(
        *[quoted(c).alias(f"o{i}") for i, c in enumerate(plan.columns)],
        *[plan.masked[c].alias(f"m{i}") for i, c in enumerate(plan.columns) if c in plan.masked],
    )
    metrics = [F.count("*").alias("rows")]
    for i, c in enumerate(plan.columns):
        metrics.append(F.count(F.col(f"o{i}")).alias(f"seen{i}"))
        if c in plan.masked:
            differs = ~F.col(f"o{i}").eqNullSafe(F.col(f"m{i}"))
            metrics.append(F.count(F.when(differs, 1)).alias(f"changed{i}"))
    counted = pairs.observe(observation, *metrics)
    side = {c: "m" if c in plan.masked else "o" for c in plan.columns}
    out = counted.select(*[F.col(f"{side[c]}{i}").alias(c) for i, c in enumerate(plan.columns)])
    return out, observation


def observed_events(
    spark: SparkSession, plan: MaskPlan, observation: Observation, *, table: str, run_id: str
) -> DataFrame:
    """The audit rows of a finished :func:`observed_mask`, one per column."""
    counts = observation.get
    kinds = {c.name: c.action.kind for c in plan.cells}
    rows = [
        (
            run_id,
            "column.masked" if c in plan.masked else "column.passed_through",
            table, c, kinds.get(c, "passthrough"),
            counts[f"seen{i}"], counts.get(f"changed{i}", 0),
        )
        for i, c in enumerate(plan.columns)
    ]
    return spark.createDataFrame(
        rows,
        "run_id string, event_type string, table_id string, column_name string, action string, "
        "cells_seen long, cells_changed long",
    )


def _kind(rule: act.Action | None) -> str:
    return rule.kind if rule is not None else "passthrough"


def audit_detection(findings: DataFrame, run_id: str) -> DataFrame:
    """Every finding as an audit event, overridden ones included."""
    return findings.select(
        F.lit(run_id).alias("run_id"), F.lit("column.pii_detected").alias("event_type"), "*"
    )


def conditional_skips(df: DataFrame, rules: act.Rules, *, table: str, run_id: str) -> DataFrame:
    """Per guarded column, the rows its predicate left alone. The predicate itself is hashed."""
    guarded = {c: r.when for c, r in rules.items() if r.when is not None}
    if not guarded:
        return df.sparkSession.createDataFrame(
            [], "run_id string, event_type string, table_id string, column_name string, "
            "predicate_hash string, skipped long"
        )
    aggs = [
        F.count(F.when(~F.coalesce(F.expr(p), F.lit(False)), 1)).alias(f"c{i}_skipped")
        for i, p in enumerate(guarded.values())
    ]
    stats = unpivot_stats(df.agg(*aggs), list(guarded), {"skipped": "bigint"})
    hashes = F.create_map(
        *[F.lit(v) for c, p in guarded.items() for v in (c, hashlib.sha256(p.encode()).hexdigest())]
    )
    return stats.select(
        F.lit(run_id).alias("run_id"), F.lit("conditional_skip").alias("event_type"),
        F.lit(table).alias("table_id"), "column_name",
        hashes[F.col("column_name")].alias("predicate_hash"), "skipped",
    )


def rules_hash(rules: Mapping[str, act.Rules]) -> str:
    """SHA-256 of the rules in canonical JSON, independent of the order they were given in."""
    document = {
        table: {c: {"action": r.kind, **asdict(r)} for c, r in columns.items()}
        for table, columns in rules.items()
    }
    canonical = json.dumps(document, sort_keys=True, separators=(",", ":"), default=str)
    return hashlib.sha256(canonical.encode()).hexdigest()


def row_widths(profiles: DataFrame) -> DataFrame:
    """``(table_id, row_width)``: the summed average widths of each table's columns."""
    return profiles.groupBy("table_id").agg(F.sum("avg_width").alias("row_width"))


def run_summary(
    batches: DataFrame, profiles: DataFrame, ctx: MaskContext, rules: Mapping[str, act.Rules]
) -> DataFrame:
    """Per run and table: batches, rows, estimated bytes, and the last batch's cursor and status.

    ``batches`` holds (run_id, table_id, batch_id, rows, cursor, status); the byte estimate
    is rows times the summed average widths of ``profiles``.
    """
    rolled = batches.groupBy("run_id", "table_id").agg(
        F.count("*").alias("batches"),
        F.sum("rows").alias("rows"),
        F.max_by("cursor", "batch_id").alias("last_cursor"),
        F.max_by("status", "batch_id").alias("status"),
    )
    widths = row_widths(profiles)
    estimate = F.floor(F.coalesce(F.col("row_width"), F.lit(0.0)) * F.col("rows")).cast("long")
    return rolled.join(widths, "table_id", "left_outer").select(
        "run_id", "table_id", "batches", "rows", estimate.alias("bytes"), "last_cursor", "status",
        F.lit(ctx.salt_fingerprint).alias("salt_fingerprint"),
        F.lit(rules_hash(rules)).alias("config_hash"),
    )
