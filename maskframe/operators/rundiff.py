"""Rows in which two runs' outputs differ, found through a tree of bucket fingerprints."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskframe.functions.text import quoted

_PIECES = 4  # 24-bit pieces of a row's digest that fingerprints add up
_HALVES = ("__high", "__low")


def cell_text(c: Column, kind: T.DataType) -> Column:
    """A text that is equal exactly for equal values: both zeros are one, map entries have no order."""
    if isinstance(kind, T.StructType):
        return F.concat(*[_framed(c[f.name], f.dataType) for f in kind.fields], F.lit(""))
    if isinstance(kind, T.ArrayType):
        return F.array_join(F.transform(c, lambda e: _framed(e, kind.elementType)), "")
    if isinstance(kind, T.MapType):
        entries = F.transform(
            F.map_entries(c),
            lambda e: F.concat(_framed(e["key"], kind.keyType), _framed(e["value"], kind.valueType)),
        )
        return F.array_join(F.array_sort(entries), "")
    if isinstance(kind, T.VariantType):
        return F.to_json(c)
    if isinstance(kind, T.BinaryType):
        return F.hex(c)
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return (c + F.lit(0).cast(kind)).cast("string")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(c).cast("string")  # local times repeat when clocks go back
    return c.cast("string")


def _framed(c: Column, kind: T.DataType) -> Column:
    """Length and text of a value, so that neighbours cannot run into each other; null has a mark of its own."""
    text = cell_text(c, kind)
    return F.coalesce(F.concat(F.char_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def row_digest(df: DataFrame) -> Column:
    """128 bits, as 32 hex digits, of all columns of a row in order."""
    return F.md5(F.concat(*[_framed(quoted(f.name), f.dataType) for f in df.schema.fields], F.lit("")))


def diff_runs(a: DataFrame, b: DataFrame, *, fanout: Sequence[int] = (64, 64)) -> DataFrame:
    """Rows of one output missing from the other, with ``side`` and the surplus ``copies``.

    Rows fall into buckets by a digest of all their cells. Per bucket the signed numbers and sums
    of hashes of digests, which do not depend on order, are compared; buckets that differ are split
    once more for every further number in ``fanout`` (at most their product is broadcast). Only rows of
    differing buckets have their digests counted, and only rows with a surplus travel whole. Equal
    runs are scanned once and shuffle a few numbers per task; a run with differences is scanned once
    more a level, so give it stored outputs, not views that compute. ``fanout=()`` compares digests at once, for runs that differ nearly everywhere.

    NULL equals NULL, NaN equals NaN, the two zeros are one value, maps have no order, variants are
    compared by their JSON text. Columns of ``b`` are matched by name; a missing one is an error.
    Two empty tables have no differences. Column names that begin with two underscores are reserved.
    """
    side, digest, at, n = "__side", "__digest", "__bucket", "__n"
    both = a.select("*", F.lit(1).alias(side)).unionByName(b.select("*", F.lit(-1).alias(side)))
    rows = both.withColumn(digest, row_digest(both.drop(side)))
    # Numbers of their own columns, so that a row's digest is worked out once however often they are used.
    hashed = rows.select(side, digest, *[h.alias(name) for h, name in zip(_hashes(digest), _HALVES, strict=True)])
    suspects = hashed
    for level in range(len(fanout)):
        bucket = _bucket(math.prod(fanout[: level + 1]))
        sums = [F.sum(F.col(side) * piece).alias(f"__s{i}") for i, piece in enumerate(_pieces())]
        counted = suspects.groupBy(bucket.alias(at)).agg(F.sum(side).alias(n), *sums)
        unequal = counted.where(" OR ".join([f"{n} <> 0", *[f"__s{i} <> 0" for i in range(_PIECES)]])).select(at)
        # All rows again, not the suspects: buckets of this level lie within one of the level above, and one scan suffices.
        # Buckets are unique, so an inner join keeps each row once; a semi join would be copied into the union.
        suspects = hashed.withColumn(at, bucket).join(F.broadcast(unequal), at)
    surplus = suspects.groupBy(digest).agg(F.sum(side).alias(n)).where(f"{n} <> 0")
    whole = F.struct(*[quoted(c) for c in a.columns])
    found = rows.join(surplus.select(digest), digest).groupBy(digest).agg(
        F.any_value(whole).alias("__row"), F.sum(side).alias(n)
    )
    return found.select(
        "__row.*", F.when(F.col(n) > 0, "a_only").otherwise("b_only").alias("side"), F.abs(n).alias("copies")
    )


def _hashes(digest: str) -> list[Column]:
    """A 64-bit number of either half of a digest, far cheaper than reading its digits."""
    return [F.xxhash64(F.substring(digest, 1, 16)), F.xxhash64(F.substring(digest, 17, 16))]


def _pieces() -> list[Column]:
    """24-bit numbers of a digest; sums of them stay exact up to 2 ** 39 rows a bucket."""
    return [
        F.shiftrightunsigned(h, bits).bitwiseAND(F.lit((1 << 24) - 1)) for h in map(F.col, _HALVES) for bits in (0, 24)
    ]


def _bucket(size: int) -> Column:
    """Number of a row's bucket out of ``size``, from bits that no piece holds; buckets of a multiple lie within it.

    It is never null, and says so: a join on it would else ask for that below all that a computed row is made of.
    """
    high, low = (F.shiftrightunsigned(F.col(h), 48) for h in _HALVES)
    return F.coalesce(F.pmod(high * F.lit(1 << 16) + low, F.lit(size)), F.lit(0).cast("long"))
