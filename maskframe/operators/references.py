"""Undeclared relationships: columns that look like soft or polymorphic references."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskframe.functions.text import quoted
from maskframe.operators.profile import unique_columns
from maskframe.operators.skew import distinct_keys
from maskframe.spec import TableSpec

# Suffixes that by convention point at a unique column, most specific first.
REFERENCE_SUFFIXES = ("user_id", "username", "email", "mrn")

_IMPLIED_SCHEMA = (
    "source_table string, source_column string, suggested_alias string, "
    "n_rows long, matched_rows long, containment double"
)
_POLYMORPHIC_SCHEMA = (
    "table_id string, type_column string, id_column string, type_value string, "
    "n_rows long, n_ids long"
)


def implied_fks(
    tables: Mapping[str, DataFrame],
    specs: Mapping[str, TableSpec],
    *,
    suffixes: Iterable[str] = REFERENCE_SUFFIXES,
    ignore: Iterable[str] = (),
    infer_unique: bool = False,
) -> DataFrame:
    """Columns ``<x>_<suffix>`` without a declared key that name a unique column elsewhere.

    Names decide the candidates; the data then says which share of the values the suggested
    target really holds. Values are counted per key before any join, so a value repeated in
    a third of the rows travels as one row.
    """
    spark = next(iter(tables.values())).sparkSession
    out = spark.createDataFrame([], _IMPLIED_SCHEMA)
    for table_id, name, target, suffix in implied_candidates(
        tables, specs, suffixes=suffixes, ignore=ignore, infer_unique=infer_unique
    ):
        out = out.unionByName(_containment(tables[table_id], table_id, name, tables[target], target, suffix))
    return out


def implied_candidates(
    tables: Mapping[str, DataFrame],
    specs: Mapping[str, TableSpec],
    *,
    suffixes: Iterable[str] = REFERENCE_SUFFIXES,
    ignore: Iterable[str] = (),
    infer_unique: bool = False,
) -> list[tuple[str, str, str, str]]:
    """``(table, column, target table, target column)`` by names and declared keys alone.

    Reads no data unless ``infer_unique`` asks which target columns are unique.
    """
    suffixes, ignored = tuple(suffixes), frozenset(ignore)
    targets = _targets(tables, specs, suffixes, infer_unique)
    out = []
    for table_id, df in tables.items():
        declared = {c for fk in specs.get(table_id, TableSpec(table_id)).fks for c in fk.cols}
        for name in df.columns:
            suffix = next((s for s in suffixes if name.endswith(f"_{s}") and name != f"_{s}"), None)
            if suffix is None or name in declared or f"{table_id}.{name}" in ignored:
                continue
            candidates = [t for t in targets.get(suffix, []) if (t, suffix) != (table_id, name)]
            if candidates:
                target = min(candidates, key=lambda t: _distance(table_id, name, suffix, t))
                out.append((table_id, name, target, suffix))
    return out


def _targets(
    tables: Mapping[str, DataFrame],
    specs: Mapping[str, TableSpec],
    suffixes: tuple[str, ...],
    infer_unique: bool,
) -> dict[str, list[str]]:
    """Tables by the name of a single-column unique column they own."""
    out: dict[str, list[str]] = {}
    for table_id, df in tables.items():
        unique = set(specs.get(table_id, TableSpec(table_id)).single_unique_columns)
        open_names = [c for c in df.columns if c in suffixes and c not in unique]
        if infer_unique and open_names:
            found = unique_columns(df, table_id, open_names).where("is_unique").collect()
            unique |= {r.column_name for r in found}
        for name in unique & set(df.columns):
            out.setdefault(name, []).append(table_id)
    return out


def _distance(table_id: str, column: str, suffix: str, target: str) -> tuple[bool, bool, str]:
    """Prefer a target named in the column's prefix, then the same schema, then the id."""
    prefix = set(column[: -len(suffix) - 1].split("_"))
    bare = target.rpartition(".")[2]
    names = {bare, bare[:-1]} if bare.endswith("s") and not bare.endswith("ss") else {bare}
    same_schema = target.rpartition(".")[0] == table_id.rpartition(".")[0]
    return not (names & prefix), not same_schema, target


def _containment(
    df: DataFrame, table_id: str, name: str, target_df: DataFrame, target: str, column: str
) -> DataFrame:
    counts = (
        df.select(quoted(name).alias("k")).where("k IS NOT NULL")
        .groupBy("k").agg(F.count("*").alias("n"))
    )
    held = distinct_keys(target_df, [column], ["held"]).withColumn("found", F.lit(True))
    joined = counts.join(held, F.col("k") == F.col("held"), "left_outer")
    totals = joined.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        F.coalesce(F.sum(F.when(F.col("found"), F.col("n"))), F.lit(0)).alias("matched_rows"),
    )
    return totals.select(
        F.lit(table_id).alias("source_table"),
        F.lit(name).alias("source_column"),
        F.lit(f"{target}.{column}").alias("suggested_alias"),
        "n_rows",
        "matched_rows",
        F.try_divide("matched_rows", "n_rows").alias("containment"),
    )


def polymorphic_refs(
    tables: Mapping[str, DataFrame], specs: Mapping[str, TableSpec] | None = None
) -> DataFrame:
    """``<p>_type`` text with ``<p>_id`` pairs outside any declared key, sized per type value."""
    spark = next(iter(tables.values())).sparkSession
    out = spark.createDataFrame([], _POLYMORPHIC_SCHEMA)
    for table_id, type_col, id_col in polymorphic_pairs(tables, specs or {}):
        sizes = tables[table_id].groupBy(quoted(type_col).alias("type_value")).agg(
            F.count("*").alias("n_rows"), F.count_distinct(quoted(id_col)).alias("n_ids")
        )
        out = out.unionByName(
            sizes.select(
                F.lit(table_id).alias("table_id"), F.lit(type_col).alias("type_column"), F.lit(id_col).alias("id_column"),
                "type_value", "n_rows", "n_ids",
            )
        )
    return out


def polymorphic_pairs(
    tables: Mapping[str, DataFrame], specs: Mapping[str, TableSpec]
) -> list[tuple[str, str, str]]:
    """``(table, type column, id column)`` by names, types and declared keys alone; reads no data."""
    out = []
    for table_id, df in tables.items():
        types = {f.name: f.dataType for f in df.schema.fields}
        declared = {c for fk in specs.get(table_id, TableSpec(table_id)).fks for c in fk.cols}
        for type_col in df.columns:
            id_col = f"{type_col.removesuffix('_type')}_id"
            if not type_col.endswith("_type") or id_col not in types:
                continue
            if type_col in declared or id_col in declared:
                continue
            if isinstance(types[type_col], T.StringType) and isinstance(types[id_col], (T.IntegralType, T.StringType)):
                out.append((table_id, type_col, id_col))
    return out
