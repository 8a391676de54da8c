"""Foreign-key-aware subsetting, repair and consistency checks."""

from __future__ import annotations

import uuid
from collections.abc import Collection, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskframe.context import MaskError
from maskframe.functions.text import quoted
from maskframe.operators.skew import NO_HEAVY_KEYS, HeavyKeys, distinct_keys, heavy_keys, key_join, key_types, typed_key
from maskframe.operators.verify import _union
from maskframe.session import run_dir
from maskframe.spec import ForeignKey, TableSpec


@dataclass(frozen=True)
class _Edge:
    child: str
    fk: ForeignKey

    @property
    def parent(self) -> str:
        return self.fk.parent


def subset(
    tables: Mapping[str, DataFrame],
    specs: Mapping[str, TableSpec],
    roots: Mapping[str, str],
    *,
    max_rounds: int | None = None,
) -> dict[str, DataFrame]:
    """Rows reachable from the root predicates, closed under foreign keys.

    Children of kept rows are kept, round by round, and then every parent a kept row refers
    to, so no reference dangles. Tables that are not reached give no rows.

    A table that can be reached is read once for its key columns, which are written to the shared
    folder, and once more for the rows returned. Rounds work on the key columns alone, cycles
    or not: each joins the keys that the round before found and writes those that are new, so
    a key is written once however many rounds there are. Rounds end when nothing new turns up or, if
    given, after ``max_rounds`` in either direction, beyond which it is an error. Tables without a
    primary key are followed by the combinations of key values they hold.
    """
    edges = [
        _Edge(name, fk) for name, spec in specs.items() if name in tables
        for fk in spec.fks if fk.parent in tables
    ]
    unknown = set(roots) - set(tables)
    if unknown:
        raise MaskError(f"unknown root table(s): {', '.join(sorted(unknown))}")
    below = _connected(set(roots), [(e.parent, e.child) for e in edges])
    involved = _connected(below, [(e.child, e.parent) for e in edges])
    edges = [e for e in edges if e.child in involved and e.parent in involved]
    keys = _KeyTables({n: tables[n] for n in sorted(involved)}, specs, edges, roots)
    down = [(e.parent, e.fk.parent_cols, e.child, e.fk.cols) for e in edges]
    entries = {n: [e for e in edges if e.child == n and e.parent in below] for n in involved}
    keys.follow(down, max_rounds)
    # Rows that came in over one key alone have their parents already.
    implied = {
        (e.child, e.fk.cols, e.parent, e.fk.parent_cols) for e in edges if entries[e.child] == [e] and e.child not in roots
    }
    up = [(e.child, e.fk.cols, e.parent, e.fk.parent_cols) for e in edges]
    keys.follow(up, max_rounds, not_first=implied)
    return {name: keys.rows(name) if name in involved else df.limit(0) for name, df in tables.items()}


def _connected(start: set[str], ways: Sequence[tuple[str, str]]) -> set[str]:
    """Everything that can be reached from ``start``."""
    out, more = set(start), True
    while more:
        found = {b for a, b in ways if a in out} - out
        out, more = out | found, bool(found)
    return out


_Step = tuple[str, Sequence[str], str, Sequence[str]]


class _KeyTables:
    """The key columns of the tables a subset can reach, and the keys kept so far as one file set per round."""

    def __init__(
        self, tables: Mapping[str, DataFrame], specs: Mapping[str, TableSpec], edges: Sequence[_Edge], roots: Mapping[str, str]
    ) -> None:
        self._tables, self._roots = tables, roots
        self._spark = next(iter(tables.values())).sparkSession if tables else None
        self._pk = {n: list(specs.get(n, TableSpec(n)).pk) for n in tables}
        self._unique = {n: specs.get(n, TableSpec(n)).unique_groups for n in tables}
        self._columns = {
            n: list(dict.fromkeys([
                *self._pk[n], *[c for e in edges if e.child == n for c in e.fk.cols],
                *[c for e in edges if e.parent == n for c in e.fk.parent_cols],
            ]))
            for n in tables
        }
        self._folder = run_dir(self._spark, "subset") if tables else ""
        self._heavy: dict[_Step, HeavyKeys] = {}
        self._deltas: dict[str, list[str]] = {n: [] for n in tables}
        self._schemas: dict[str, T.StructType] = {}
        with ThreadPoolExecutor(4) as pool:
            self._whole = dict(zip(tables, pool.map(self._project, tables), strict=True))
        self._seeds = {n: self._whole[n].where("__root").drop("__root").distinct() for n in roots}

    def _project(self, name: str) -> DataFrame:
        df = self._tables[name]
        root = F.coalesce(F.expr(self._roots[name]), F.lit(False)) if name in self._roots else F.lit(False)
        # A table without a key that refers to nothing and is not referred to has roots at most.
        keys = df.select(*[quoted(c) for c in self._columns[name]], root.alias("__root"))
        path = f"{self._folder}/{name}/keys"
        keys.write.parquet(path)
        self._schemas[name] = keys.drop("__root").schema
        return self._spark.read.schema(keys.schema).parquet(path)

    def _kept(self, name: str) -> DataFrame | None:
        paths = self._deltas[name]
        return self._spark.read.schema(self._schemas[name]).parquet(*paths) if paths else None

    def _add(self, name: str, found: DataFrame, known: bool) -> DataFrame | None:
        """Write the keys of ``found`` that are not kept yet; None if there are none."""
        fresh, kept = found.distinct(), self._kept(name) if known else None
        if kept is not None:
            fresh = fresh.join(kept, self._same(name, fresh, kept), "left_anti")
        count, path = Observation(), f"{self._folder}/{name}/{len(self._deltas[name]):05d}-{uuid.uuid4().hex}"
        fresh.observe(count, F.count(F.lit(1)).alias("n")).write.parquet(path)
        if not count.get["n"]:
            return None
        self._deltas[name].append(path)
        return self._spark.read.schema(self._schemas[name]).parquet(path)

    def _same(self, name: str, a: DataFrame, b: DataFrame) -> Column:
        """Equal primary keys or, where there is none, equal key values throughout."""
        names = self._pk[name] or self._columns[name]
        return reduce(lambda x, y: x & y, [a[_tick(c)].eqNullSafe(b[_tick(c)]) for c in names])

    def follow(self, steps: Sequence[_Step], max_rounds: int | None, not_first: Collection[_Step] = ()) -> None:
        """Keep whatever ``steps`` (from, columns, to, columns) reach from the keys kept so far and the roots.

        Steps in ``not_first`` need not be taken from the keys kept at the start.
        """
        frontier = {n: kept for n in self._tables if (kept := self._kept(n)) is not None}
        for name, seeds in self._seeds.items():
            if self._columns[name]:
                # Without a primary key equal keys do not make equal rows: roots are not yet kept keys.
                fresh = self._add(name, seeds, known=True) if self._pk[name] else seeds
                if fresh is not None:
                    frontier[name] = frontier[name].unionByName(fresh) if name in frontier else fresh
        skipped, rounds = set(not_first), 0
        while frontier:
            found: dict[str, list[DataFrame]] = {}
            taken = [s for s in steps if s[0] in frontier and s not in skipped]
            with ThreadPoolExecutor(4) as pool:
                self._heavy.update(pool.map(lambda s: (s, self._heavy.get(s) or self._measured(s)), taken))
            for step in taken:
                origin, origin_cols, to, to_cols = step
                reached = key_join(
                    self._whole[to].drop("__root"), distinct_keys(frontier[origin], origin_cols),
                    list(zip(to_cols, origin_cols, strict=True)), "left_semi", heavy=self._heavy[step],
                )
                found.setdefault(to, []).append(reached)
            if not found:
                return
            if max_rounds is not None and rounds >= max_rounds:
                raise MaskError(f"subset did not settle within {max_rounds} rounds")
            with ThreadPoolExecutor(4) as pool:
                added = pool.map(lambda item: (item[0], self._add(item[0], _union(item[1]), known=True)), found.items())
                frontier = {name: fresh for name, fresh in added if fresh is not None}
            skipped, rounds = set(), rounds + 1

    def _measured(self, step: _Step) -> HeavyKeys:
        """The heavy keys on the side a step leads to; a key that identifies rows has none."""
        origin, origin_cols, to, to_cols = step
        if tuple(to_cols) in self._unique[to]:
            return NO_HEAVY_KEYS
        return heavy_keys(self._whole[to], to_cols, key_types(self._whole[to], to_cols, self._whole[origin], origin_cols))

    def rows(self, name: str) -> DataFrame:
        """The rows of a table whose keys were kept, or that are roots."""
        df, kept = self._tables[name], self._kept(name)
        if self._pk[name]:
            if kept is None:
                return df.limit(0)
            return key_join(df, distinct_keys(kept, self._pk[name]), [(c, c) for c in self._pk[name]], "left_semi", heavy=NO_HEAVY_KEYS)
        root = F.coalesce(F.expr(self._roots[name]), F.lit(False)) if name in self._roots else None
        if kept is None:
            return df.limit(0) if root is None else df.where(root)
        held = kept.distinct().select(*[quoted(c).alias(f"__k{i}") for i, c in enumerate(self._columns[name])])
        pairs = reduce(
            lambda x, y: x & y, [df[_tick(c)].eqNullSafe(held[f"__k{i}"]) for i, c in enumerate(self._columns[name])]
        )
        if root is None:
            return df.join(held, pairs, "left_semi")
        marked = df.join(held.withColumn("__kept", F.lit(True)), pairs, "left_outer")
        return marked.where(F.coalesce(F.col("__kept"), F.lit(False)) | root).select(*[df[_tick(c)] for c in df.columns])


def _tick(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def null_orphan_fks(
    child: DataFrame, parents: Mapping[str, DataFrame], spec: TableSpec, *, measured: DataFrame | None = None
) -> DataFrame:
    """Set the columns of each foreign key to NULL in rows whose parent is missing.

    Heavy keys are looked for in ``measured``: the stored table that ``child`` is taken from, where
    ``child`` itself would have to be worked out for it.
    """
    measured = child if measured is None else measured
    out = child
    for i, fk in enumerate(spec.fks):
        if fk.parent not in parents:
            continue
        names = [f"__p{i}_{j}" for j in range(len(fk.cols))]
        keys = distinct_keys(parents[fk.parent], fk.parent_cols, names).withColumn("__held", F.lit(True))
        joined = key_join(
            out, keys, list(zip(fk.cols, names, strict=True)), "left_outer",
            heavy=heavy_keys(measured, fk.cols, key_types(child, fk.cols, keys, names)),
        )
        out = joined.select(
            *[
                F.when(F.col("__held"), quoted(c)).alias(c) if c in fk.cols else quoted(c)
                for c in child.columns
            ]
        )
    return out


def exclude_conflicts(
    tables: Mapping[str, DataFrame],
    specs: Mapping[str, TableSpec],
    strategies: Mapping[str, str],
    *,
    nulling: Sequence[str] = (),
) -> DataFrame:
    """NOT NULL foreign-key columns that point at an excluded table, with the rows affected.

    Tables that are excluded themselves or listed in ``nulling`` do not conflict.
    """
    parts = []
    for name, spec in specs.items():
        if name not in tables or strategies.get(name) == "exclude" or name in nulling:
            continue
        for fk in spec.fks:
            if strategies.get(fk.parent) != "exclude":
                continue
            for col in fk.cols:
                if col in spec.not_null:
                    count = tables[name].agg(F.count(quoted(col)).alias("affected_rows"))
                    parts.append(
                        count.select(
                            F.lit(name).alias("table_id"), F.lit(col).alias("column_name"),
                            F.lit(fk.parent).alias("excluded_parent"), "affected_rows",
                        )
                    )
    spark = next(iter(tables.values())).sparkSession
    empty = spark.createDataFrame(
        [], "table_id string, column_name string, excluded_parent string, affected_rows long"
    )
    return _union(parts) or empty


def _join_size(child: DataFrame, parent: DataFrame, fk: ForeignKey, side: str) -> DataFrame:
    """Row count of the equi-join, computed from per-key counts of both sides.

    Counted in one grouping, without a join or a filter: conditions on masked keys would be
    pushed below the masking, whose expressions then stand in the plan many times over.
    """
    types = key_types(child, fk.cols, parent, fk.parent_cols)
    names = [f"k{i}" for i in range(len(fk.cols))]

    def tagged(df: DataFrame, cols: Sequence[str], label: int) -> DataFrame:
        keys = [typed_key(df, c, t).alias(n) for c, t, n in zip(cols, types, names, strict=True)]
        return df.select(*keys, F.lit(label).alias("child"))

    both = tagged(child, fk.cols, 1).unionAll(tagged(parent, fk.parent_cols, 0))
    pairs = both.groupBy(*names).agg(F.sum("child").alias("nc"), F.sum(1 - F.col("child")).alias("np"))
    present = reduce(lambda a, b: a & b, [F.col(n).isNotNull() for n in names])
    size = F.coalesce(F.sum(F.when(present, F.col("nc") * F.col("np"))), F.lit(0)).alias("n")
    return pairs.agg(size).select(F.lit(side).alias("side"), "n")


def fk_mask_consistency(
    before: tuple[DataFrame, DataFrame], after: tuple[DataFrame, DataFrame], fk: ForeignKey, child: str
) -> DataFrame:
    """Whether child and parent join to as many rows after masking as before."""
    sizes = _join_size(*before, fk, "before").unionAll(_join_size(*after, fk, "after"))
    return sizes.agg(
        F.sum(F.when(F.col("side") == "before", F.col("n"))).alias("joined_before"),
        F.sum(F.when(F.col("side") == "after", F.col("n"))).alias("joined_after"),
    ).select(
        F.lit(f"{child}({', '.join(fk.cols)})").alias("foreign_key"),
        "joined_before", "joined_after",
        (F.col("joined_before") == F.col("joined_after")).alias("consistent"),
    )


def remaining(source: DataFrame, target: DataFrame, pk: Sequence[str]) -> DataFrame:
    """Source rows whose primary key the target does not hold yet."""
    keys = distinct_keys(target, pk)
    return key_join(source, keys, [(c, c) for c in pk], "left_anti", heavy=NO_HEAVY_KEYS)
