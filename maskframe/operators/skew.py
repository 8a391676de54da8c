"""Joins against a unique-key side that stay balanced when a few keys hold most rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskframe.context import MaskError
from maskframe.functions.text import quoted

#: A key with more rows than this is spread over as many tasks as it has multiples of it.
ROWS_PER_TASK = 2_000_000
#: Items that the frequent-items sketch of a group of partitions tracks, and returns.
_SKETCH_ITEMS = 8192
_SKETCH_TOP = 1024
#: Partitions are sketched in so many groups before one task combines the sketches.
_SKETCH_GROUPS = 256

_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_DIGITS = {T.ByteType: 3, T.ShortType: 5, T.IntegerType: 10, T.LongType: 20}


@dataclass(frozen=True)
class HeavyKeys:
    """Hashes of the heavy keys of a frame, and over how many salts their rows are spread."""

    hashes: tuple[int, ...] = ()
    salts: int = 1


NO_HEAVY_KEYS = HeavyKeys()


def comparison_type(a: T.DataType, b: T.DataType) -> T.DataType:
    """The type in which keys of types ``a`` and ``b`` are compared.

    Whole numbers meet in the wider one, decimals in one that holds both, anything with a
    floating-point side as double, dates as timestamps where one side is one, and text in the
    type of the other side, so that ``'07'`` equals 7. Other mixtures are refused.
    """
    if a == b:
        return a
    if isinstance(b, T.StringType) and not isinstance(a, T.StringType):
        a, b = b, a
    if isinstance(a, T.StringType):
        if isinstance(b, T.StringType):
            return T.StringType()
        if isinstance(b, _INTEGERS):
            return T.LongType()
        if isinstance(b, (T.FractionalType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BooleanType)):
            return b
    if isinstance(a, _INTEGERS) and isinstance(b, _INTEGERS):
        return max(a, b, key=lambda t: _DIGITS[type(t)])
    if isinstance(a, (T.FloatType, T.DoubleType)) and isinstance(b, T.NumericType):
        return T.DoubleType()
    if isinstance(b, (T.FloatType, T.DoubleType)) and isinstance(a, T.NumericType):
        return T.DoubleType()
    if isinstance(a, T.NumericType) and isinstance(b, T.NumericType):
        scales = [t.scale if isinstance(t, T.DecimalType) else 0 for t in (a, b)]
        wholes = [t.precision - t.scale if isinstance(t, T.DecimalType) else _DIGITS[type(t)] for t in (a, b)]
        return T.DecimalType(min(38, max(wholes) + max(scales)), min(max(scales), 38 - min(38, max(wholes))))
    moments = (T.DateType, T.TimestampType, T.TimestampNTZType)
    if isinstance(a, moments) and isinstance(b, moments):
        return T.TimestampType() if T.TimestampType() in (a, b) else T.TimestampNTZType()
    raise MaskError(f"keys of types {a.simpleString()} and {b.simpleString()} cannot be compared")


def key_types(
    left: DataFrame, left_cols: Sequence[str], right: DataFrame, right_cols: Sequence[str]
) -> list[T.DataType]:
    """The types in which the key parts of two frames are compared."""
    return [
        comparison_type(left.schema[a].dataType, right.schema[b].dataType)
        for a, b in zip(left_cols, right_cols, strict=True)
    ]


def _typed(df: DataFrame, cols: Sequence[str], types: Sequence[T.DataType] | None) -> list[Column]:
    """Key parts in the types of the comparison; text that is no such value becomes NULL."""
    if types is None:
        return [quoted(c) for c in cols]
    return [typed_key(df, c, t) for c, t in zip(cols, types, strict=True)]


def typed_key(df: DataFrame, col: str, kind: T.DataType) -> Column:
    """A key part in the type of the comparison; text that is no such value becomes NULL."""
    return quoted(col) if df.schema[col].dataType == kind else quoted(col).try_cast(kind)


def key_hash(df: DataFrame, cols: Sequence[str], types: Sequence[T.DataType] | None = None) -> Column:
    """64-bit hash of a key, its parts first brought to ``types``."""
    return F.xxhash64(*_typed(df, cols, types))


def row_hash(df: DataFrame) -> Column:
    """64-bit hash of a row, over every column Spark can hash."""
    plain = [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    return F.xxhash64(*[quoted(c) for c in plain])


def heavy_keys(
    df: DataFrame,
    cols: Sequence[str],
    types: Sequence[T.DataType] | None = None,
    *,
    rows_per_task: int = ROWS_PER_TASK,
) -> HeavyKeys:
    """The keys with more than ``rows_per_task`` rows, by a frequent-items sketch.

    One pass over the key columns. Partitions are sketched in groups, so that no task combines
    more than a few hundred sketches, and at most 1,024 numbers reach the driver. The choice
    only steers the physical plan, results never depend on it.
    """
    group = F.pmod(F.spark_partition_id(), F.lit(_SKETCH_GROUPS))
    sketches = df.select(key_hash(df, cols, types).alias("h"), group.alias("g")).groupBy("g").agg(
        F.expr(f"approx_top_k_accumulate(h, {_SKETCH_ITEMS})").alias("s")
    )
    # Grouped by a constant: an empty table has no sketches, which cannot be combined.
    row = sketches.withColumn("all", F.lit(0)).groupBy("all").agg(
        F.expr(f"approx_top_k_estimate(approx_top_k_combine(s, {_SKETCH_ITEMS}), {_SKETCH_TOP})").alias("top")
    ).first()
    heavy = [item for item in (row["top"] if row else None) or [] if item["count"] > rows_per_task]
    if not heavy:
        return NO_HEAVY_KEYS
    most = max(item["count"] for item in heavy)
    return HeavyKeys(tuple(item["item"] for item in heavy), -(-most // rows_per_task))


def key_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[tuple[str, str]],
    how: str,
    *,
    heavy: HeavyKeys | None = None,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Join ``left`` to a side holding each key once, keeping left's rows whole.

    Keys are compared in one type (:func:`comparison_type`), and hashed in it. Rows of heavy
    keys are spread over salts by a hash of the row and the number of its partition, so equal
    rows are spread as well and a task that is run again salts them alike. The few right rows
    with those keys are repeated once per salt; everything else joins on salt zero. Where no key
    is heavy the join is left as it is. ``heavy`` takes the result of an earlier
    :func:`heavy_keys` in the same types; :data:`NO_HEAVY_KEYS` says that no key repeats much.
    """
    if how not in ("inner", "left_outer", "left_semi", "left_anti"):
        raise ValueError(f"unsupported join type: {how}")
    left_cols = [a for a, _ in on]
    right_cols = [b for _, b in on]
    types = key_types(left, left_cols, right, right_cols)
    if heavy is None:
        heavy = NO_HEAVY_KEYS if left.isStreaming else heavy_keys(left, left_cols, types, rows_per_task=rows_per_task)
    # Different spellings of one key ('7', '07') are one key in the type of the comparison.
    merged = any(right.schema[b].dataType != t for b, t in zip(right_cols, types, strict=True))
    names = [f"__key{i}" for i in range(len(on))]
    right = right.select(
        *[c.alias(n) for c, n in zip(_typed(right, right_cols, types), names, strict=True)],
        *[quoted(c) for c in right.columns if c not in right_cols],
    )
    if merged:
        right = right.dropDuplicates(names)
    pairs = list(zip(_typed(left, left_cols, types), [F.col(n) for n in names], strict=True))
    if heavy.hashes:
        salt = F.pmod(F.xxhash64(row_hash(left), F.spark_partition_id()), F.lit(heavy.salts)).cast("int")
        left = left.withColumn(
            "__salt", F.when(key_hash(left, left_cols, types).isin(*heavy.hashes), salt).otherwise(0)
        )
        salts = F.sequence(F.lit(0), F.lit(heavy.salts - 1))
        right = right.withColumn(
            "__salt_r",
            F.explode(F.when(F.xxhash64(*names).isin(*heavy.hashes), salts).otherwise(F.array(F.lit(0)))),
        )
        pairs.append((F.col("__salt"), F.col("__salt_r")))
    out = left.join(right, reduce(lambda a, b: a & b, [a == b for a, b in pairs]), how)
    if how not in ("left_semi", "left_anti"):
        out = out.drop(*names, "__salt_r")
    return out.drop("__salt")


def distinct_keys(df: DataFrame, cols: Sequence[str], names: Sequence[str] | None = None) -> DataFrame:
    """Distinct complete keys (no NULL part), deduplicated before and after the shuffle."""
    names = list(names or cols)
    present = reduce(lambda a, b: a & b, [quoted(c).isNotNull() for c in cols])
    return df.where(present).select(*[quoted(c).alias(n) for c, n in zip(cols, names, strict=True)]).distinct()
