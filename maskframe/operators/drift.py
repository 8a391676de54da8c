"""Differences between two runs' declared schemas, table profiles and partitions."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskframe.functions.text import quoted
from maskframe.spec import TableSpec

_SNAPSHOT = "table_id string, kind string, name string, definition string, is_nullable boolean"


def declared_schema(
    spark: SparkSession, tables: Mapping[str, DataFrame], specs: Mapping[str, TableSpec] | None = None
) -> DataFrame:
    """What is declared about tables, one row per column, primary key, unique group and foreign key.

    ``name`` is the column, or the list of columns of a key as JSON; ``definition`` is the column's type with
    its parameters (the logical one where the spec names it), the columns of a primary key, or where a foreign key leads to. A
    column is nullable unless its schema, its primary key or ``not_null`` says otherwise. Only
    metadata is read, so the rows can be stored after a run and compared with the next one's.
    Repeated declarations count once; a table without columns or keys has no rows.
    """
    rows: dict[tuple[str, str, str], tuple] = {}

    def declare(table: str, kind: str, name: str, definition: str, is_nullable: bool | None = None) -> None:
        rows[table, kind, name] = (table, kind, name, definition, is_nullable)

    for table, df in tables.items():
        spec = (specs or {}).get(table) or TableSpec(table)
        required = spec.not_null | set(spec.pk)
        for f in df.schema.fields:
            kind = spec.types.get(f.name, f.dataType.simpleString())
            declare(table, "column", f.name, kind, f.nullable and f.name not in required)
        if spec.pk:
            declare(table, "primary_key", "primary key", json.dumps(spec.pk))
        for group in spec.uniques:
            declare(table, "unique", json.dumps(group), json.dumps(group))
        for fk in spec.fks:
            declare(table, "foreign_key", json.dumps([fk.cols, fk.parent]), json.dumps([fk.parent, fk.parent_cols]))
    return spark.createDataFrame(list(rows.values()), _SNAPSHOT)


def drift_declared(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Compare two results of :func:`declared_schema`, declaration by declaration.

    ``change`` is ``new_table``, ``dropped_table``, ``added``, ``removed``, ``retyped`` (columns),
    ``changed`` (keys), ``nullability`` or ``none``. A new type goes before another nullability; both
    sides' values are returned. Rows of a table that either side lacks say so, whatever their kind.
    """
    keys = ["table_id", "kind", "name"]
    sides = {}
    for side, snapshot in (("prev", previous), ("cur", current)):
        sides[side] = snapshot.select(
            *keys, F.col("definition").alias(f"{side}_definition"), F.col("is_nullable").alias(f"{side}_nullable")
        )
        sides[f"{side}_tables"] = snapshot.select("table_id").distinct().withColumn(f"in_{side}", F.lit(True))
    joined = (
        sides["prev"].join(sides["cur"], keys, "full_outer")
        .join(sides["prev_tables"], "table_id", "left").join(sides["cur_tables"], "table_id", "left")
    )
    change = (
        F.when(F.col("in_prev").isNull(), "new_table")
        .when(F.col("in_cur").isNull(), "dropped_table")
        .when(F.col("prev_definition").isNull(), "added")
        .when(F.col("cur_definition").isNull(), "removed")
        .when(F.col("prev_definition") != F.col("cur_definition"), F.when(F.col("kind") == "column", "retyped").otherwise("changed"))
        .when(~F.col("prev_nullable").eqNullSafe(F.col("cur_nullable")), "nullability")
        .otherwise("none")
    )
    return joined.select(
        *keys, change.alias("change"), (change != "none").alias("has_drift"),
        "prev_definition", "cur_definition", "prev_nullable", "cur_nullable",
    )


def drift(previous: DataFrame, current: DataFrame, declared: DataFrame | None = None) -> DataFrame:
    """Compare two profiles column by column: added, removed, retyped, nullability changed.

    Every column of either profile gives a row with ``has_drift`` and the change in rows,
    share of nulls and average width. Profiles hold one row per column. With ``declared``, a
    result of :func:`drift_declared`, types and nullability are those declared, and a first NULL
    in a nullable column is no drift; without it nullability is what the data show.
    """
    keys = ["table_id", "column_name"]
    stats = ["data_type", "n_rows", "nulls", "avg_width"]
    before = previous.select(*keys, *[F.col(c).alias(f"prev_{c}") for c in stats])
    after = current.select(*keys, *[F.col(c).alias(f"cur_{c}") for c in stats])
    joined = before.join(after, keys, "full_outer")
    null_share = {
        side: F.try_divide(F.col(f"{side}_nulls"), F.col(f"{side}_n_rows")) for side in ("prev", "cur")
    }
    change = (
        F.when(F.col("prev_data_type").isNull(), "added")
        .when(F.col("cur_data_type").isNull(), "removed")
        .when(F.col("prev_data_type") != F.col("cur_data_type"), "retyped")
    )
    if declared is None:
        change = change.when((F.col("prev_nulls") > 0) != (F.col("cur_nulls") > 0), "nullability")
    else:
        columns = declared.where("kind = 'column' AND change IN ('retyped', 'nullability')")
        joined = joined.join(columns.select("table_id", F.col("name").alias("column_name"), F.col("change").alias("said")), keys, "left")
        change = change.when(F.col("said").isNotNull(), F.col("said"))
    change = change.otherwise("none")
    return joined.select(
        *keys,
        change.alias("change"),
        (change != "none").alias("has_drift"),
        "prev_data_type",
        "cur_data_type",
        (F.col("cur_n_rows") - F.col("prev_n_rows")).alias("rows_delta"),
        (null_share["cur"] - null_share["prev"]).alias("null_share_delta"),
        (F.col("cur_avg_width") - F.col("prev_avg_width")).alias("avg_width_delta"),
    )


def new_partitions(previous: DataFrame, current: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Partition values of the current input that the previous one did not have."""
    cols = [quoted(k) for k in keys]
    return current.select(*cols).distinct().join(previous.select(*cols).distinct(), list(keys), "left_anti")
