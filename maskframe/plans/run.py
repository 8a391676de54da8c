"""Whole runs over a set of tables: inspect, mask and write, verify, continue."""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskframe.context import MaskContext, MaskError
from maskframe.operators import actions as act
from maskframe.operators import audit
from maskframe.operators.detect import (
    detect_pii, detection_summary, effective_rules, settled, uncovered_columns,
)
from maskframe.operators.mask import MaskPlan, null_rule_conflicts, plan_tables
from maskframe.operators.ner import SpanFinder
from maskframe.operators.references import implied_candidates, polymorphic_pairs
from maskframe.operators.referential import null_orphan_fks, remaining, subset
from maskframe.operators.verify import verify
from maskframe.plans.config import RunConfig
from maskframe.plans.ledger import Ledger, previous_tables
from maskframe.plans.publish import Manifest, Store, commit, live, manifests, settle, staging
from maskframe.sources.read import apply_strategy
from maskframe.sources.write import POLICIES, write_table
from maskframe.spec import TableSpec


@dataclass(frozen=True)
class Inspection:
    """What a run would do: findings per column, their summary and undecided columns."""

    findings: DataFrame
    summary: DataFrame
    uncovered: DataFrame


@dataclass(frozen=True)
class RunResult:
    run_id: str
    paths: dict[str, str] = field(default_factory=dict)
    rules: dict[str, dict] = field(default_factory=dict)
    audit_path: str | None = None


def dry_run(
    tables: Mapping[str, DataFrame], specs: Mapping[str, TableSpec], config: RunConfig
) -> Inspection:
    """Detection without masking."""
    findings = settled(detect_pii(
        tables, config.rules, specs=specs, strategies=config.strategies,
        auto_detect=config.auto_detect,
    ))
    return Inspection(findings, detection_summary(findings), uncovered_columns(findings))


def preflight(specs: Mapping[str, TableSpec], tables: Mapping[str, DataFrame], config: RunConfig) -> None:
    """Refuse rules that constraints rule out, before reading any data."""
    emptied = [c for n, r in config.rules.items() if n in specs for c in null_rule_conflicts(r, specs[n])]
    if emptied:
        raise MaskError("null action on NOT NULL column(s): " + ", ".join(sorted(emptied)))
    dangling = sorted(
        f"{name}.{col}"
        for name, spec in specs.items()
        if name in tables and name not in config.null_orphan_fks
        and config.strategies.get(name) != "exclude"
        for fk in spec.fks if config.strategies.get(fk.parent) == "exclude"
        for col in fk.cols if col in spec.not_null
    )
    if dangling:
        raise MaskError("excluded table is referenced by NOT NULL key(s): " + ", ".join(dangling))


def prepare(
    tables: Mapping[str, DataFrame],
    specs: Mapping[str, TableSpec],
    config: RunConfig,
    ctx: MaskContext,
    *,
    roots: Mapping[str, str] | None = None,
    finder: SpanFinder | None = None,
    existing: Mapping[str, DataFrame] | None = None,
    ledger: Ledger | None = None,
) -> tuple[dict[str, MaskPlan], dict[str, dict]]:
    """Subset, repair and plan the mask: (mask plan per table, effective rules).

    Rows whose key ``existing`` holds already are left out before masking, where no rule
    changes the key. Findings, doubtful references and refusals are reported to ``ledger``.
    """
    preflight(specs, tables, config)
    rules = {t: dict(r) for t, r in config.rules.items()}
    if ledger is not None:
        ledger.append(reference_warnings(tables, specs, config))
    if config.auto_detect:
        inspection = dry_run(tables, specs, config)
        if ledger is not None:
            ledger.append(_detections(inspection.findings))
        if config.strict_autodetect:
            undecided = sorted((r.table_id, r.column_name) for r in inspection.uncovered.collect())
            if undecided:
                if ledger is not None:
                    ledger.append({"event_type": "strict_mode_violation", "table_id": t, "column_name": c} for t, c in undecided)
                raise MaskError("uncovered PII columns: " + ", ".join(f"{t}.{c}" for t, c in undecided))
        rules = effective_rules(inspection.findings, rules, ctx)
    rows = subset(tables, specs, roots) if roots else dict(tables)
    rows = apply_strategy(rows, config.strategies)
    for name in config.null_orphan_fks & set(rows):
        spec = specs[name]
        held = {
            fk.parent: rows.get(fk.parent, tables[fk.parent].limit(0))
            for fk in spec.fks if fk.parent in tables
        }
        rows[name] = null_orphan_fks(rows[name], held, spec, measured=tables[name])
    for name, held in (existing or {}).items():
        if name in rows and _key_is_plain(specs.get(name), rules.get(name, {})):
            rows[name] = remaining(rows[name], held, specs[name].pk)
    plans = plan_tables(rows, rules, ctx, specs, fk_paths=config.fk_paths, finder=finder)
    return plans, rules


def _key_is_plain(spec: TableSpec | None, rules: Mapping[str, act.Action]) -> bool:
    """Whether the table has a primary key that masking leaves as it is."""
    if spec is None or not spec.pk:
        return False
    return all(c not in rules or isinstance(rules[c], act.Passthrough) for c in spec.pk)


def reference_warnings(
    tables: Mapping[str, DataFrame], specs: Mapping[str, TableSpec], config: RunConfig
) -> list[dict]:
    """Warnings about columns that look like references but are not declared as such, from names alone.

    Columns that ``implied_fk_ignore`` lists as ``table.column`` give none.
    """
    soft = [
        {
            "event_type": "implied_fk_warning", "table_id": t, "column_name": c,
            "payload": {"suggested_alias": f"{target}.{suffix}"},
        }
        for t, c, target, suffix in implied_candidates(tables, specs, ignore=config.implied_fk_ignore)
    ]
    pairs = [
        {"event_type": "polymorphic_fk_warning", "table_id": t, "column_name": i, "payload": {"type_column": k}}
        for t, k, i in polymorphic_pairs(tables, specs)
    ]
    return soft + pairs


def _detections(findings: DataFrame) -> list[dict]:
    """Every finding as an event, those a rule overrides included; one for each column of the schema."""
    rows = findings.orderBy("table_id", "column_name").collect()
    return [
        {
            "event_type": "column.pii_detected", "table_id": r["table_id"], "column_name": r["column_name"],
            "payload": {
                "confidence": r["confidence"], "matched_pattern": r["matched_pattern"], "provider": r["provider"],
                "action": r["action"], "source": r["source"], "reasons": list(r["reasons"]),
            },
        }
        for r in rows
    ]


def run(
    spark: SparkSession,
    tables: Mapping[str, DataFrame],
    specs: Mapping[str, TableSpec],
    config: RunConfig,
    ctx: MaskContext,
    out: str,
    *,
    roots: Mapping[str, str] | None = None,
    finder: SpanFinder | None = None,
    resume: bool = False,
    run_id: str | None = None,
    concurrent_tables: int = 4,
) -> RunResult:
    """Mask every table and write it below ``out``; events go to ``out/_events``, audit rows to ``out/_audit``.

    Rows of a table are staged, listed in a manifest together with their audit counts, and then moved
    into place (:mod:`maskframe.plans.publish`), so a run that dies at any point leaves tables whole or
    untouched. ``resume`` finishes what such a run had listed, sets aside what it had not, and adds only
    rows that are still missing by primary key; tables without a key are written anew unless they are
    finished. It refuses tables written with another salt or other rules. Audit counts are
    collected while the rows are written. Independent tables are written side by side,
    ``concurrent_tables`` at a time; one process may work on ``out`` at a time.
    """
    run_id = run_id or uuid.uuid4().hex
    attempt, store = uuid.uuid4().hex, Store(spark, out)
    replace_all = not resume and POLICIES.get(config.on_existing_data) == "overwrite"
    if not resume and not replace_all:
        taken = sorted(n for n in tables if store.exists(f"{out}/{n}") or manifests(spark, out, n))
        if taken:
            raise MaskError(f"PATH_ALREADY_EXISTS: {', '.join(taken)} below {out}")
    ledger = Ledger(spark, out, run_id)
    known = previous_tables(spark, out, run_id)
    config_hash = audit.rules_hash({t: dict(r) for t, r in config.rules.items()})
    ledger.append([{
        "event_type": "run.started",
        "payload": {"salt_fingerprint": ctx.salt_fingerprint, "config_hash": config_hash, "resume": resume},
    }])
    try:
        result = _run(
            spark, tables, specs, config, ctx, out, attempt, ledger, known, replace_all=replace_all, roots=roots,
            finder=finder, resume=resume, run_id=run_id, concurrent_tables=concurrent_tables,
        )
    except BaseException as exc:
        ledger.append([{"event_type": "run.failed", "payload": {"error": type(exc).__name__}}])
        raise
    ledger.append([{"event_type": "run.succeeded"}])
    return result


def _run(
    spark: SparkSession, tables: Mapping[str, DataFrame], specs: Mapping[str, TableSpec], config: RunConfig,
    ctx: MaskContext, out: str, attempt: str, ledger: Ledger, known: set[str] | None, *, replace_all: bool,
    roots: Mapping[str, str] | None, finder: SpanFinder | None, resume: bool, run_id: str, concurrent_tables: int,
) -> RunResult:
    finished = {n: settle(spark, out, n) for n in sorted(tables)} if resume else {n: [] for n in tables}
    held = {n: spark.read.parquet(f"{out}/{n}") for n, found in finished.items() if found}
    existing = {n: df for n, df in held.items() if specs.get(n, TableSpec(n)).pk}
    plans, rules = prepare(
        tables, specs, config, ctx, roots=roots, finder=finder, existing=existing, ledger=ledger
    )
    paths = {name: f"{out}/{name}" for name in plans}
    marks = {n: (ctx.salt_fingerprint, audit.rules_hash({n: rules.get(n, {})})) for n in plans}
    for name in sorted(plans):
        if any((m.salt_fingerprint, m.rules_hash) != marks[name] for m in finished[name]):
            raise MaskError(f"{name}: the rows already there were not written with this salt and these rules")
    if known is not None:
        ledger.append({"event_type": "new_table", "table_id": n} for n in sorted(set(tables) - known))
    ledger.append({"event_type": "table.pending", "table_id": n} for n in sorted(plans))

    def write(name: str) -> DataFrame | None:
        if name in held and name not in existing:
            return None  # without a key rows cannot be told apart, and the manifest says that all are there
        spec, plan = specs.get(name, TableSpec(name)), plans[name]
        masked, observation = audit.observed_mask(plan, f"audit-{attempt}-{name}") if config.audit_log else (plan.project(), None)
        if name in existing and not _key_is_plain(spec, rules.get(name, {})):
            masked = remaining(masked, existing[name], spec.pk)
        staged = staging(out, attempt, name)
        write_table(masked, staged)
        events = None if observation is None else audit.observed_events(spark, plan, observation, table=name, run_id=run_id)
        counted = [] if events is None else events.drop("run_id", "table_id").collect()
        sizes = Store(spark, out).sizes(staged)
        earlier = manifests(spark, out, name)
        commit(spark, out, Manifest(
            table_id=name, attempt=attempt, run_id=run_id, seq=1 + max((m.seq for m in earlier), default=0),
            replaces=not live(earlier) or replace_all or not finished[name], salt_fingerprint=marks[name][0],
            rules_hash=marks[name][1], rows=spark.read.parquet(staged).count(), bytes=sum(sizes.values()),
            files=tuple(sorted(sizes)), audit=tuple(r.asDict() for r in counted),
        ))
        settle(spark, out, name, drop_unlisted=replace_all)
        return events

    def reported(name: str) -> DataFrame | None:
        ledger.append([{"event_type": "table.started", "table_id": name}])
        try:
            events = write(name)
        except BaseException as exc:
            ledger.append([{"event_type": "table.failed", "table_id": name, "payload": {"error": type(exc).__name__}}])
            raise
        rows = sum(m.rows for m in live(manifests(spark, out, name)))
        ledger.append([{"event_type": "table.done", "table_id": name, "rows": rows}])
        return events

    with ThreadPoolExecutor(concurrent_tables) as pool:
        events = [e for e in pool.map(reported, sorted(plans)) if e is not None]
    Store(spark, out).delete(f"{out}/_staging/{attempt}")
    audit_path = None
    if events:
        audit_path = f"{out}/_audit/run_id={run_id}"
        together = reduce(lambda a, b: a.unionByName(b), events)
        together.drop("run_id").coalesce(1).write.mode("overwrite").parquet(audit_path)
    return RunResult(run_id, paths, rules, audit_path)


def verify_run(
    spark: SparkSession,
    source: Mapping[str, DataFrame],
    result: RunResult,
    specs: Mapping[str, TableSpec],
    config: RunConfig,
    *,
    sample: int | None = None,
    roots: Mapping[str, str] | None = None,
) -> DataFrame:
    """Compare a finished run with its source, or with the subset that ``roots`` give.

    Whole tables are compared unless ``sample`` asks for the first rows by key only.
    """
    if roots:
        source = subset(source, specs, roots)
    target = {n: spark.read.schema(source[n].schema).parquet(p) for n, p in result.paths.items()}
    return verify(
        {n: source[n] for n in target}, target, specs, result.rules,
        strategies=config.strategies, sample=sample,
    )


def report_lines(inspection: Inspection) -> DataFrame:
    """The detection report as ordered text lines per table, for writing as Markdown."""
    f = inspection.findings
    section = (
        F.when(F.col("source") == "config", "Explicit config")
        .when(F.col("confidence") == "medium", "Uncertain (manual review)")
        .when(F.col("action").isNotNull(), "Masked (auto-detect)")
        .otherwise("Passthrough")
    )
    line = F.concat(
        F.lit("- `"), F.col("column_name"), F.lit("`: "),
        F.coalesce(F.col("action"), F.lit("passthrough")),
        F.coalesce(F.concat(F.lit(", provider="), F.col("provider")), F.lit("")),
        F.coalesce(F.concat(F.lit(", pattern="), F.col("matched_pattern")), F.lit("")),
        F.lit(" ("), F.col("confidence"), F.lit(")"),
    )
    return f.select("table_id", section.alias("section"), line.alias("line")).orderBy(
        "table_id", "section", "line"
    )
