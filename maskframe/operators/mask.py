"""The masking projection: one action per column, one select per table."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskframe.context import MaskContext, MaskError
from maskframe.functions.coerce import coerce_to
from maskframe.functions.providers import check_providers, get_provider
from maskframe.functions.regex import regex_replace
from maskframe.functions.seeds import Seed, keyed_digest, seed_hex
from maskframe.functions.text import nfc, python_str, quoted
from maskframe.functions.unique import unique_suffix
from maskframe.operators import actions as act
from maskframe.operators.jsonpaths import JsonPlan
from maskframe.operators.ner import SpanFinder, installed_finder, join_segments, segments_of
from maskframe.spec import TableSpec

PostProcess = Mapping[str, Callable[[Column], Column]]

_TEXT = (T.StringType, T.CharType, T.VarcharType)
_SEEDED = (act.Fake, act.Pseudonym)


@dataclass(frozen=True)
class _Cell:
    """One configured column with the names of its helper columns."""

    name: str
    dtype: T.DataType
    action: act.Action
    path: str
    unique: bool
    helper: str

    @property
    def source(self) -> Column:
        return quoted(self.name)

    @property
    def is_text(self) -> bool:
        return isinstance(self.dtype, _TEXT)

    @property
    def seed_path(self) -> str:
        return getattr(self.action, "seed_alias", None) or self.path

    @property
    def guard(self) -> Column:
        return F.lit(True) if self.action.when is None else F.expr(self.action.when)

    @property
    def guarded_source(self) -> Column:
        """The cell where its guard holds, NULL elsewhere, so skipped cells cost nothing."""
        return self.source if self.action.when is None else F.when(self.guard, self.source)

    def temp(self, part: str) -> str:
        return f"{self.helper}_{part}"


class _Residues:
    """Seed residues that providers asked for, each a helper column of its own."""

    def __init__(self) -> None:
        self.columns: list[Column] = []

    def define(self, residue: Column) -> Column:
        name = f"__mod{len(self.columns)}"
        self.columns.append(residue.alias(name))
        return F.col(name)


@dataclass(frozen=True)
class MaskPlan:
    """Helper columns added to the input, and the masked expression of each configured column."""

    staged: DataFrame
    columns: list[str]
    masked: dict[str, Column]
    cells: list[_Cell]

    def project(self) -> DataFrame:
        return self.staged.select(
            *[
                self.masked[c].alias(c) if c in self.masked else quoted(c)
                for c in self.columns
            ]
        )


def mask_table(
    df: DataFrame,
    rules: act.Rules,
    ctx: MaskContext,
    *,
    table: str | TableSpec,
    unique: Iterable[str] | None = None,
    coerce: bool = True,
    post_process: PostProcess | None = None,
    finder: SpanFinder | None = None,
    where: str | Column | None = None,
) -> DataFrame:
    """Mask the configured columns and pass the others through; schema order is kept.

    ``where`` keeps only the rows that satisfy it before masking. It reaches the scan, partition
    pruning included, and so does a later filter on columns that are passed through.

    ``table`` supplies the seed path prefix and, given as a TableSpec, which columns are
    unique. Works on batch and streaming inputs alike: there is no shuffle and no state.
    """
    if where is not None:
        df = df.where(where)
    return plan_mask(
        df, rules, ctx, table=table, unique=unique, coerce=coerce,
        post_process=post_process, finder=finder,
    ).project()


def plan_mask(
    df: DataFrame,
    rules: act.Rules,
    ctx: MaskContext,
    *,
    table: str | TableSpec,
    unique: Iterable[str] | None = None,
    coerce: bool = True,
    post_process: PostProcess | None = None,
    finder: SpanFinder | None = None,
) -> MaskPlan:
    """Build the projection without applying it (audit roll-ups reuse the expressions)."""
    table_id = table.name if isinstance(table, TableSpec) else table
    if unique is None:
        unique = table.unique_columns if isinstance(table, TableSpec) else ()
    cells = _cells(df, rules, table_id, frozenset(unique))
    hooks = dict(post_process or {})
    residues = _Residues()
    staged, json_plans = _stage(df, cells, ctx, finder, residues)
    masked = {}
    for cell in cells:
        value = _expression(cell, ctx, json_plans, residues)
        masked[cell.name] = _guarded(cell, _contract(cell, value, coerce))
    if residues.columns:
        staged = staged.select("*", *residues.columns)
    for name, hook in hooks.items():
        masked[name] = hook(masked.get(name, quoted(name)))
    return MaskPlan(staged, df.columns, masked, cells)


def _cells(
    df: DataFrame, rules: act.Rules, table_id: str, unique: frozenset[str]
) -> list[_Cell]:
    types = {f.name: f.dataType for f in df.schema.fields}
    missing = sorted(set(rules) - set(types))
    if missing:
        raise MaskError(f"{table_id}: no such column(s): {', '.join(missing)}")
    check_providers(
        (f"{table_id}.{name}", rule.provider)
        for name, rule in rules.items()
        if isinstance(rule, _SEEDED)
    )
    cells = []
    for i, (name, rule) in enumerate(rules.items()):
        if isinstance(rule, act.Passthrough):
            continue
        cell = _Cell(
            name, types[name], rule, f"{table_id}.{name}", name in unique, f"__mask{i}"
        )
        if isinstance(rule, (act.RegexMask, act.NerMask, act.JsonMask)) and not cell.is_text:
            raise MaskError(f"{cell.path}: {rule.kind} requires a text column")
        cells.append(cell)
    return cells


def _stage(
    df: DataFrame,
    cells: list[_Cell],
    ctx: MaskContext,
    finder: SpanFinder | None,
    residues: _Residues,
) -> tuple[DataFrame, dict[str, JsonPlan]]:
    """Add parsed documents, their fields, normalised text and seeds, each in a select of its own.

    Catalyst keeps the selects apart because later ones use each helper several times, and
    drops helpers nobody reads. The residues providers take of the seeds come in one more.
    """
    documents, found, texts, seeds = [], [], [], []
    json_plans: dict[str, JsonPlan] = {}
    for cell in cells:
        if isinstance(cell.action, act.NerMask):
            spans = segments_of(cell.guarded_source, cell.action.entities, finder or installed_finder())
            texts.append(spans.alias(cell.temp("parts")))
        elif isinstance(cell.action, act.JsonMask):
            plan = JsonPlan(
                cell.guarded_source, cell.action, ctx, cell.path, cell.helper, residues.define
            )
            json_plans[cell.name] = plan
            documents.append(plan.parsed)
            found.extend(plan.found)
            texts.extend(plan.texts)
            seeds.extend(plan.seeds)
        elif isinstance(cell.action, (*_SEEDED, act.HmacHash)):
            text = python_str(cell.guarded_source, cell.dtype)
            if cell.is_text:
                text = F.nullif(nfc(text, ctx.nfc), F.lit(""))
            texts.append(text.alias(cell.temp("text")))
            if isinstance(cell.action, _SEEDED):
                seeds.append(_seed(cell, ctx).alias(cell.temp("seed")))
    for helpers in (documents, found, texts, seeds):
        if helpers:
            df = df.select("*", *helpers)
    return df, json_plans


def _seed(cell: _Cell, ctx: MaskContext) -> Column:
    text = F.col(cell.temp("text"))
    if isinstance(cell.action, act.Pseudonym):
        return F.substring(keyed_digest(text, ctx.require_key(cell.path), cell.seed_path), 1, 32)
    return seed_hex(text, ctx.salt, cell.seed_path)


def _expression(
    cell: _Cell, ctx: MaskContext, json_plans: dict[str, JsonPlan], residues: _Residues
) -> Column:
    action, source = cell.action, cell.source
    if isinstance(action, act.Null):
        return F.lit(None).cast("string")
    if isinstance(action, act.Static):
        return F.lit(action.value)
    if isinstance(action, act.Hash):
        return hash_text(python_str(source, cell.dtype), ctx.salt)
    if isinstance(action, act.HmacHash):
        digest = keyed_digest(F.col(cell.temp("text")), ctx.require_key(cell.path), cell.path)
        return base64url(digest) if action.encoding == "base64url" else digest
    if isinstance(action, act.RegexMask):
        return regex_replace(
            cell.guarded_source, action.pattern, action.replace, action.flags, cell.path, action.max_chars
        )
    if isinstance(action, act.NerMask):
        return join_segments(F.col(cell.temp("parts")), ctx, cell.path)
    if isinstance(action, act.JsonMask):
        return json_plans[cell.name].result()
    if isinstance(action, _SEEDED):
        seed = Seed(F.col(cell.temp("seed")), residues.define)
        provider = get_provider(action.provider)
        base = provider.fn(seed, F.col(cell.temp("text")), dict(action.params), ctx)
        return unique_suffix(base, seed, provider.shape) if cell.unique else base
    raise TypeError(f"unsupported action: {type(action).__name__}")


def _contract(cell: _Cell, value: Column, coerce: bool) -> Column:
    """NULL stays NULL; empty text stays empty except under ``null`` and ``static``."""
    dtype = cell.dtype if coerce else T.StringType()
    if isinstance(cell.action, act.Null):
        return F.lit(None).cast(dtype)
    if cell.is_text and isinstance(cell.action, _SEEDED) and get_provider(cell.action.provider).strict:
        # NULL for NULL and empty text; unlike a CASE branch this lets Spark share the seed's
        # hex conversions between the numbers taken from it.
        return F.coalesce(value, cell.source)
    typed = value if cell.is_text else coerce_to(value, dtype, cell.path)
    if cell.is_text and not isinstance(cell.action, act.Static):
        return F.when(cell.source.isNull() | (cell.source == ""), cell.source).otherwise(typed)
    return F.when(cell.source.isNotNull(), typed)


def _guarded(cell: _Cell, value: Column) -> Column:
    if cell.action.when is None:
        return value
    return F.when(cell.guard, value).otherwise(cell.source)


def hash_text(text: Column, salt: str) -> Column:
    """Salted sha256 as 64 hex digits, over the plain concatenation of salt and text."""
    return F.sha2(F.concat(F.lit(bytearray(salt.encode())), text.cast("binary")), 256)


def base64url(digest_hex: Column) -> Column:
    """Unpadded URL-safe base64 of a hex digest."""
    return F.rtrim(F.translate(F.base64(F.unhex(digest_hex)), "+/", "-_"), F.lit("="))


def resolve_aliases(rules: act.Rules, spec: TableSpec) -> dict[str, act.Action]:
    """Seed each faked foreign-key column with the path of the column it references."""
    out = dict(rules)
    for fk in spec.fks:
        for col, parent_col in zip(fk.cols, fk.parent_cols, strict=True):
            rule = out.get(col)
            if isinstance(rule, _SEEDED) and rule.seed_alias is None:
                out[col] = replace(rule, seed_alias=f"{fk.parent}.{parent_col}")
    return out


def suffixed_columns(
    rules: act.Rules, spec: TableSpec, specs: Mapping[str, TableSpec]
) -> frozenset[str]:
    """Columns that get a uniqueness suffix.

    An aliased column follows the column it is aliased to, so that both sides of a join
    mask to the same text; other columns follow their own constraints.
    """
    out = set()
    for name, rule in rules.items():
        owner, column = spec, name
        alias = getattr(rule, "seed_alias", None)
        if alias:
            table, _, target = alias.rpartition(".")
            if table in specs:
                owner, column = specs[table], target
        if column in owner.unique_columns:
            out.add(name)
    return frozenset(out)


def mask_tables(
    tables: Mapping[str, DataFrame],
    rules: Mapping[str, act.Rules],
    ctx: MaskContext,
    specs: Mapping[str, TableSpec] | None = None,
    *,
    fk_paths: bool = False,
    post_process: Mapping[str, PostProcess] | None = None,
    finder: SpanFinder | None = None,
) -> dict[str, DataFrame]:
    """Mask several tables with consistent aliases and uniqueness suffixes."""
    plans = plan_tables(
        tables, rules, ctx, specs, fk_paths=fk_paths, post_process=post_process, finder=finder
    )
    return {name: plan.project() for name, plan in plans.items()}


def plan_tables(
    tables: Mapping[str, DataFrame],
    rules: Mapping[str, act.Rules],
    ctx: MaskContext,
    specs: Mapping[str, TableSpec] | None = None,
    *,
    fk_paths: bool = False,
    post_process: Mapping[str, PostProcess] | None = None,
    finder: SpanFinder | None = None,
) -> dict[str, MaskPlan]:
    """The mask plans behind :func:`mask_tables`."""
    specs = dict(specs or {})
    hooks = post_process or {}
    out = {}
    for name, df in tables.items():
        spec = specs.get(name, TableSpec(name))
        table_rules = dict(rules.get(name, {}))
        if fk_paths:
            table_rules = resolve_aliases(table_rules, spec)
        out[name] = plan_mask(
            df, table_rules, ctx, table=spec,
            unique=suffixed_columns(table_rules, spec, specs),
            post_process=hooks.get(name), finder=finder,
        )
    return out


def mask_partitioned(
    children: Mapping[str, DataFrame],
    rules: act.Rules,
    ctx: MaskContext,
    *,
    parent: TableSpec,
    seed_by: str = "parent",
) -> DataFrame:
    """Mask every partition child with the parent's rules and return them as one table.

    Seeding by the parent keeps equal values equal across partitions; ``seed_by="child"``
    seeds with each child's own name.
    """
    if seed_by not in ("parent", "child"):
        raise MaskError(f"seed_by must be parent or child, not {seed_by!r}")
    masked = [
        mask_table(
            df, rules, ctx, table=parent if seed_by == "parent" else name,
            unique=parent.unique_columns,
        )
        for name, df in children.items()
    ]
    out = masked[0]
    for part in masked[1:]:
        out = out.unionByName(part)
    return out


def null_rule_conflicts(rules: act.Rules, spec: TableSpec) -> list[str]:
    """Columns declared NOT NULL that a ``null`` action would empty."""
    return [
        f"{spec.name}.{name}"
        for name, rule in rules.items()
        if isinstance(rule, act.Null) and name in spec.not_null
    ]
