"""Column statistics computed from the data."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskframe.functions.checks import passes_luhn
from maskframe.functions.text import quoted

_NESTED = (T.ArrayType, T.MapType, T.StructType, T.VariantType)


def base_type(dtype: T.DataType) -> str:
    """Type name without its parameters (``decimal(10,2)`` gives ``decimal``)."""
    return dtype.simpleString().partition("(")[0].partition("<")[0]


def unpivot_stats(row: DataFrame, names: Iterable[str], fields: dict[str, str]) -> DataFrame:
    """Turn a one-row aggregate of ``c{i}_{field}`` values into one row per column."""
    names = list(names)
    cells = ", ".join(
        ", ".join([_literal(n), *[f"CAST(c{i}_{f} AS {t}) " for f, t in fields.items()]])
        for i, n in enumerate(names)
    )
    return row.select(F.expr(f"stack({len(names)}, {cells}) AS (column_name, {', '.join(fields)})"))


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _ident(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def profile(df: DataFrame, table: str, *, exact_distinct: bool = False) -> DataFrame:
    """One row per column: rows, nulls, distinct, avg width in bytes, longest text, type.

    One scan. The default distinct count is a sketch, merged layer by layer (:func:`profile_state`);
    ``exact_distinct`` counts digests of the values in a second pass (:func:`value_counts`).
    """
    if not exact_distinct:
        return profile_of(profile_state(df, table))
    fields = df.schema.fields
    aggs = [F.expr("count(1) AS n_rows")]
    for i, f in enumerate(fields):
        c, text = _ident(f.name), _text_of(f)
        aggs += [
            F.expr(f"count_if({c} IS NULL) AS c{i}_nulls"),
            F.expr(f"avg(octet_length({text})) AS c{i}_avg_width"),
            F.expr(f"max(char_length({text})) AS c{i}_max_length"),
        ]
    row = df.agg(*aggs).selectExpr(
        "*",
        *[f"n_rows AS c{i}_n_rows" for i in range(len(fields))],
        *[f"{_literal(base_type(f.dataType))} AS c{i}_data_type" for i, f in enumerate(fields)],
    )
    stats = unpivot_stats(
        row,
        [f.name for f in fields],
        {"data_type": "string", "n_rows": "bigint", "nulls": "bigint", "avg_width": "double", "max_length": "bigint"},
    )
    names = F.array(*[F.lit(f.name) for f in fields])
    counted = value_counts(df, df.columns).groupBy("i").agg(F.count(F.lit(1)).alias("n"))
    counted = counted.select(F.get(names, F.col("i")).alias("counted_name"), "n")
    stats = stats.join(counted, F.col("column_name") == F.col("counted_name"), "left").withColumn(
        "n_distinct", F.coalesce("n", F.lit(0).cast("long"))
    )
    return stats.select(F.lit(table).alias("table_id"), *_PROFILE)


_PROFILE = ["column_name", "data_type", "n_rows", "nulls", "n_distinct", "avg_width", "max_length"]
_STATE_KEY = ["table_id", "column_name", "data_type"]
_STATE = (
    "table_id string, column_name string, data_type string, n_rows bigint, nulls bigint, "
    "width bigint, max_length bigint, sketch binary"
)


def _text_of(f: T.StructField) -> str:
    return f"to_json({_ident(f.name)})" if isinstance(f.dataType, _NESTED) else f"CAST({_ident(f.name)} AS STRING)"


def profile_state(df: DataFrame, table: str, *, fan: int = 256) -> DataFrame:
    """What a profile is worked out from, one row per column, made to be stored and merged.

    Every task makes one sketch per column; each further step merges at most ``fan`` of them, column
    by column: those of neighbouring tasks, then those of neighbouring groups, then (up to ``fan`` ** 3
    tasks) what is left. An empty table gives rows with zeros. States of separate parts of a
    table, a new partition say, are put together by :func:`merge_profiles` without a scan of the others.
    """
    fields = df.schema.fields
    part = F.floor(F.spark_partition_id() / F.lit(fan)).cast("int").alias("part")
    cells, aggs, states = [part], [F.count(F.lit(1)).alias("n_rows")], []
    for i, f in enumerate(fields):
        c, text = _ident(f.name), _text_of(f)
        value = text if isinstance(f.dataType, _NESTED) else c
        cells += [
            F.expr(f"CASE WHEN {c} IS NOT NULL THEN xxhash64({value}) END AS c{i}_hash"),
            F.expr(f"CAST(octet_length({text}) AS BIGINT) AS c{i}_width"), F.expr(f"char_length({text}) AS c{i}_length"),
        ]
        aggs += [
            F.count(f"c{i}_hash").alias(f"c{i}_filled"), F.sum(f"c{i}_width").alias(f"c{i}_width"),
            F.max(f"c{i}_length").alias(f"c{i}_length"), F.hll_sketch_agg(f"c{i}_hash").alias(f"c{i}_sketch"),
        ]
        states.append(F.struct(
            F.lit(table).alias("table_id"), F.lit(f.name).alias("column_name"), F.lit(base_type(f.dataType)).alias("data_type"),
            F.col("n_rows"), (F.col("n_rows") - F.col(f"c{i}_filled")).alias("nulls"),
            F.coalesce(f"c{i}_width", F.lit(0).cast("long")).alias("width"), F.col(f"c{i}_length").cast("long").alias("max_length"),
            F.col(f"c{i}_sketch").alias("sketch"),
        ))
    spark = df.sparkSession
    zeros = spark.createDataFrame([(table, f.name, base_type(f.dataType), 0, 0, 0, None, None) for f in fields], _STATE)
    if not fields:
        return zeros
    layer = df.select(*cells).groupBy("part").agg(*aggs).select("part", F.explode(F.array(*states)).alias("s")).select("part", "s.*")
    layer = _merged(layer.withColumn("part", F.floor(F.col("part") / F.lit(fan)).cast("int")), [*_STATE_KEY, "part"])
    return _merged(layer.drop("part").unionByName(zeros), _STATE_KEY)


def _merged(states: DataFrame, keys: list[str]) -> DataFrame:
    return states.groupBy(*keys).agg(
        F.sum("n_rows").alias("n_rows"), F.sum("nulls").alias("nulls"), F.sum("width").alias("width"),
        F.max("max_length").alias("max_length"), F.hll_union_agg("sketch").alias("sketch"),
    )


def merge_profiles(*states: DataFrame) -> DataFrame:
    """The state of all parts together. Parts must not share rows; a column retyped between two has a row for each type."""
    out = states[0]
    for state in states[1:]:
        out = out.unionByName(state)
    return _merged(out, _STATE_KEY)


def profile_of(state: DataFrame) -> DataFrame:
    """The profile that a state amounts to."""
    filled = F.nullif(F.col("n_rows") - F.col("nulls"), F.lit(0).cast("long"))
    return state.select(
        "table_id", "column_name", "data_type", "n_rows", "nulls",
        F.coalesce(F.hll_sketch_estimate("sketch"), F.lit(0).cast("long")).alias("n_distinct"),
        (F.col("width") / filled).alias("avg_width"), "max_length",
    ).select("table_id", *_PROFILE)


def value_counts(df: DataFrame, names: list[str]) -> DataFrame:
    """``(i, digest, n_rows)``: how often each non-null value of the i-th named column occurs.

    One narrow pass turns every cell into a number and a 128-bit digest, so that whole texts
    never travel; equal cells are added up before the shuffle.
    """
    def digest(name: str) -> Column:
        kind, c = df.schema[name].dataType, quoted(name)
        if isinstance(kind, _NESTED):
            c = F.to_json(c)
        elif isinstance(kind, (T.FloatType, T.DoubleType)):
            c = (c + F.lit(0.0)).cast("string")  # the two zeros are one value
        elif not isinstance(kind, (T.StringType, T.BinaryType)):
            c = c.cast("string")
        return F.unhex(F.md5(c))

    cells = F.array(*[F.struct(F.lit(i).alias("i"), digest(n).alias("digest")) for i, n in enumerate(names)])
    each = df.select(F.explode(cells).alias("cell")).select("cell.i", "cell.digest").where("digest IS NOT NULL")
    return each.groupBy("i", "digest").agg(F.count(F.lit(1)).alias("n_rows"))


def profile_tables(tables: dict[str, DataFrame], *, exact_distinct: bool = False) -> DataFrame:
    out = None
    for name, df in tables.items():
        part = profile(df, name, exact_distinct=exact_distinct)
        out = part if out is None else out.unionByName(part)
    return out


# Output shapes the masking actions are checked against.
VALUE_SHAPES = {
    "email": r"^[^@\s]+@[^@\s]+\.[^@\s]+$",
    "phone": r"^\+\d{11,13}$",
    "ssn": r"^\d{3}-\d{2}-\d{4}$",
    "ip_address": r"^\d{1,3}(\.\d{1,3}){3}$",
    "dob": r"^\d{4}-\d{2}-\d{2}$",
    "hash": r"^[0-9a-f]{64}$",
}


def value_evidence(df: DataFrame, table: str) -> DataFrame:
    """Per text column, how many non-empty values have each masked-value shape.

    Cards count when they also pass the Luhn check. One scan, one aggregation.
    """
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    shapes = [*VALUE_SHAPES, "credit_card"]
    aggs = []
    for i, name in enumerate(names):
        c = quoted(name)
        aggs.append(F.count(F.when(c != "", 1)).alias(f"c{i}_n_values"))
        for shape, pattern in VALUE_SHAPES.items():
            aggs.append(F.count(F.when(c.rlike(pattern), 1)).alias(f"c{i}_{shape}"))
        card = c.rlike(r"^\d{15,16}$") & passes_luhn(c)
        aggs.append(F.count(F.when(card, 1)).alias(f"c{i}_credit_card"))
    stats = unpivot_stats(
        df.agg(*aggs), names, {"n_values": "bigint", **dict.fromkeys(shapes, "bigint")}
    )
    return stats.select(F.lit(table).alias("table_id"), "*")


def unique_columns(df: DataFrame, table: str, names: list[str] | None = None) -> DataFrame:
    """For each column, whether its non-null values are all different, by :func:`value_counts`."""
    nested = {f.name for f in df.schema.fields if isinstance(f.dataType, _NESTED)}
    names = [n for n in (names or df.columns) if n not in nested]
    most = value_counts(df, names).groupBy("i").agg(F.max("n_rows").alias("most"))
    listed = df.sparkSession.createDataFrame(list(enumerate(names)), "at int, column_name string")
    return listed.join(most, F.col("at") == F.col("i"), "left").select(
        F.lit(table).alias("table_id"), "column_name", (F.coalesce("most", F.lit(0)) <= 1).alias("is_unique")
    )


def not_null_conflicts(df: DataFrame, table: str, not_null: Iterable[str]) -> DataFrame:
    """NULL count of every column declared NOT NULL."""
    names = sorted(not_null)
    row = df.agg(
        *[F.count(F.when(quoted(n).isNull(), 1)).alias(f"c{i}_null_rows") for i, n in enumerate(names)]
    )
    stats = unpivot_stats(row, names, {"null_rows": "bigint"})
    return stats.select(F.lit(table).alias("table_id"), "*")
