"""Readers: whole tables, keyset slices, filters, per-table strategies and file inputs."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Mapping, Sequence
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskframe.context import MaskError
from maskframe.functions.text import quoted
from maskframe.spec import STRATEGIES

FILE_FORMATS = ("csv", "jsonl", "parquet")
_RANGE_TYPES = (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Whole-table scan; projections and filters applied later reach the Parquet reader."""
    return spark.read.parquet(path)


def read_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    *,
    key: str | Sequence[str],
    partitions: int,
    properties: Mapping[str, str] | None = None,
    fetch_size: int = 10_000,
    quote: str = '"',
) -> DataFrame:
    """Database table read over ``partitions`` ranges of its key.

    A single numeric, date or timestamp key is cut evenly between its smallest and largest value.
    Any other key - text, uuid, several columns - is cut where the database says that each range has
    a like share of rows (:func:`split_query`, at most ``partitions`` rows); see
    :func:`range_predicates`. ``table`` is split at its dots; all names are quoted with ``quote``.
    """
    keys = [key] if isinstance(key, str) else list(key)
    source = quoted_name(table, quote)
    options = {"url": url, "fetchsize": str(fetch_size), **(properties or {})}

    def answer(statement: str) -> DataFrame:
        return spark.read.format("jdbc").options(**options).option("query", statement).load()

    reader = spark.read.format("jdbc").options(**options).option("dbtable", source)
    whole = reader.load()
    if partitions < 2:
        return whole
    if len(keys) == 1 and isinstance(whole.schema[keys[0]].dataType, _RANGE_TYPES):
        name = quoted_name(keys[0], quote, dotted=False)
        bounds = answer(f"SELECT min({name}) AS lo, max({name}) AS hi FROM {source}").first()
        if bounds is None or bounds["lo"] is None or bounds["lo"] == bounds["hi"]:
            return whole
        return reader.options(
            partitionColumn=keys[0], lowerBound=str(bounds["lo"]), upperBound=str(bounds["hi"]),
            numPartitions=str(partitions),
        ).load()
    cuts = [tuple(r) for r in answer(split_query(table, keys, partitions, quote=quote)).collect()]
    plain = {k: v for k, v in options.items() if k != "url"}
    return spark.read.jdbc(url, source, predicates=range_predicates(keys, cuts, quote=quote), properties=plain)


def quoted_name(name: str, quote: str = '"', *, dotted: bool = True) -> str:
    """An SQL identifier; a dotted one is quoted part by part. Control characters are refused."""
    if not name or any(ord(c) < 32 or ord(c) == 127 for c in name):
        raise MaskError("a name is empty or holds control characters")
    return ".".join(quote + part.replace(quote, quote * 2) + quote for part in (name.split(".") if dotted else [name]))


def sql_literal(value: object) -> str:
    """A key value as an SQL literal; types without one are refused, and so are texts with a NUL."""
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, (int, Decimal)):
        return format(value, "f") if isinstance(value, Decimal) else str(value)
    if isinstance(value, dt.datetime):
        return f"TIMESTAMP '{value.isoformat(sep=' ')}'"
    if isinstance(value, dt.date):
        return f"DATE '{value.isoformat()}'"
    if isinstance(value, (str, uuid.UUID)) and "\0" not in str(value):
        return "'" + str(value).replace("'", "''") + "'"
    raise MaskError(f"no SQL literal for a key of type {type(value).__name__}")


def split_query(table: str, key: Sequence[str], partitions: int, *, quote: str = '"') -> str:
    """SQL for the keys at which a table falls into ``partitions`` ranges of like size, in order.

    The database walks its key index; at most ``partitions - 1`` rows come back, none of them with a NULL.
    """
    names = [quoted_name(k, quote, dotted=False) for k in key]
    listed, filled = ", ".join(names), " AND ".join(f"{n} IS NOT NULL" for n in names)
    share = f"ntile({int(partitions)}) OVER (ORDER BY {listed})"
    ranked = f"SELECT {listed}, {share} AS part_no FROM {quoted_name(table, quote)} WHERE {filled}"
    first = f"row_number() OVER (PARTITION BY part_no ORDER BY {listed})"
    return (
        f"SELECT {listed} FROM (SELECT {listed}, part_no, {first} AS place FROM ({ranked}) ranked) parts "
        f"WHERE place = 1 AND part_no > 1 ORDER BY {listed}"
    )


def range_predicates(key: Sequence[str], cuts: Sequence[Sequence[object]], *, quote: str = '"') -> list[str]:
    """Conditions that give every row to exactly one range between neighbouring ``cuts``.

    ``cuts`` are row values without NULL, in the order of the database that compares them; a range
    begins with its cut. NULLs come before everything, so rows with one are not lost. Repeated cuts
    count once. The comparison of row values is spelled out as a chain of ORs, with the bound on the
    first column in front, so that indexes and statistics can be used. Without cuts there is one
    condition that is always true.
    """
    names = [quoted_name(k, quote, dotted=False) for k in key]
    edges = list(dict.fromkeys(tuple(c) for c in cuts))
    if not names or any(len(e) != len(names) or None in e for e in edges):
        raise MaskError("cuts need one value, not NULL, for every key column")

    def start(i: int, edge: tuple) -> str:
        name, value = names[i], sql_literal(edge[i])
        if i == len(names) - 1:
            return f"{name} >= {value}"
        return f"({name} >= {value} AND ({name} > {value} OR ({start(i + 1, edge)})))"

    def end(i: int, edge: tuple) -> str:
        name, value = names[i], sql_literal(edge[i])
        if i == len(names) - 1:
            return f"({name} < {value} OR {name} IS NULL)"
        return f"({name} < {value} OR {name} IS NULL OR ({name} = {value} AND {end(i + 1, edge)}))"

    bounds = [*edges, None]
    out = []
    for low, high in zip([None, *edges], bounds):
        parts = ([start(0, low)] if low is not None else []) + ([end(0, high)] if high is not None else [])
        out.append(" AND ".join(parts) or "1 = 1")
    return out


def read_after(df: DataFrame, pk: str | Sequence[str], cursor: object, n: int | None = None) -> DataFrame:
    """Rows after a key cursor. The filter reaches the scan; with ``n``, the first n by key.

    A key of several columns takes a cursor of as many values, compared as a row value. NULLs come
    first in the order, also in the cursor. ``None`` as the cursor starts at the beginning.
    """
    keys = [pk] if isinstance(pk, str) else list(pk)
    if cursor is None:
        after = df
    else:
        values = (cursor,) if isinstance(pk, str) else tuple(cursor)
        if not keys or len(values) != len(keys):
            raise MaskError("a cursor needs one value for every key column")
        after = df.where(_after(keys, values))
    return after if n is None else after.orderBy(*[quoted(k) for k in keys]).limit(n)


def _after(keys: list[str], values: tuple) -> Column:
    """Row value comparison as a chain of ORs, with the bound on the first column in front of it."""
    first, value = quoted(keys[0]), values[0]
    beyond = first.isNotNull() if value is None else first > F.lit(value)
    if len(keys) == 1:
        return beyond
    same = first.isNull() if value is None else first == F.lit(value)
    rest = beyond | (same & _after(keys[1:], values[1:]))
    return rest if value is None else (first >= F.lit(value)) & rest


def cursor_after(batch: DataFrame, pk: str | Sequence[str]) -> object:
    """The cursor that continues behind a batch: its greatest key; ``None`` for an empty batch."""
    keys = [pk] if isinstance(pk, str) else list(pk)
    last = batch.agg(F.max(F.struct(*[quoted(k) for k in keys])).alias("last")).first()["last"]
    if last is None:
        return None
    return last[0] if isinstance(pk, str) else tuple(last)


def row_filter(df: DataFrame, *predicates: str | Column | None) -> DataFrame:
    """Keep rows satisfying every given predicate; missing predicates are ignored."""
    given = [F.expr(p) if isinstance(p, str) else p for p in predicates if p is not None]
    return df.where(reduce(lambda a, b: a & b, given)) if given else df


def apply_strategy(tables: Mapping[str, DataFrame], strategies: Mapping[str, str]) -> dict[str, DataFrame]:
    """Drop excluded tables, empty the ``empty`` and ``truncate`` ones, keep the others."""
    unknown = sorted({s for s in strategies.values() if s not in STRATEGIES})
    if unknown:
        raise MaskError(f"unknown table strategy: {unknown[0]}")
    missing = sorted(set(strategies) - set(tables))
    if missing:
        raise MaskError("configured tables are absent from the source: " + ", ".join(missing))
    out = {}
    for name, df in tables.items():
        strategy = strategies.get(name, "transform")
        if strategy != "exclude":
            out[name] = df if strategy == "transform" else df.limit(0)
    return out


def read_files(
    spark: SparkSession,
    path: str,
    fmt: str,
    *,
    schema: str | T.StructType | None = None,
    header: bool = True,
    rename: Mapping[str, str] | None = None,
    multi_line: bool = False,
    bad_rows: str | None = None,
) -> DataFrame:
    """CSV, JSON lines or Parquet input with optional column renaming.

    CSV columns stay text unless a schema is given, and JSON lines need one: inferring types
    would read the whole input once more. A row that does not fit ends the job. With
    ``bad_rows``, which needs a schema, it is kept instead, its text in the column of that
    name, which is null for good rows. ``multi_line`` reads CSV cells with line breaks, or one
    JSON document per file; such files are not split.
    """
    if fmt not in FILE_FORMATS:
        raise MaskError(f"unknown file format: {fmt!r}; expected one of {FILE_FORMATS}")
    if fmt == "parquet":
        df = (spark.read if schema is None else spark.read.schema(schema)).parquet(path)
    else:
        if schema is None and (fmt == "jsonl" or bad_rows):
            raise MaskError("jsonl input needs a schema" if fmt == "jsonl" else "bad_rows needs a schema")
        options = {"mode": "FAILFAST", "multiLine": multi_line}
        if bad_rows:
            options |= {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad_rows}
            fields = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
            schema = T.StructType([*fields.fields, T.StructField(bad_rows, T.StringType())])
        reader = spark.read.options(**options)
        reader = reader if schema is None else reader.schema(schema)
        df = reader.csv(path, header=header, escape='"') if fmt == "csv" else reader.json(path)
    names = rename or {}
    return df.select(*[quoted(c).alias(names.get(c, c)) for c in df.columns])
