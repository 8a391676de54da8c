"""All counting checks of a verification from one pass over every table and one grouped shuffle."""

from __future__ import annotations

from collections.abc import Collection, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskframe.functions.text import quoted
from maskframe.operators.skew import key_types, typed_key
from maskframe.operators.verify import _comparable, _label
from maskframe.spec import TableSpec

#: Bits of a cell's hash that make room for adding up rows of one key.
_SPARE = 10
#: Columns whose NULLs one mask of bits can tell.
_BITS = 63


@dataclass(frozen=True)
class _Check:
    """A number that tags facts, what they count, and how results name it."""

    kind: str
    label: str
    columns: tuple[str, ...] = ()


def _digest(parts: Sequence[Column]) -> tuple[Column, Column]:
    """128 bits of a key, as two numbers."""
    return F.xxhash64(*parts), F.xxhash64(F.lit("second"), *parts)


def _present(parts: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, [p.isNotNull() for p in parts])


class _Facts:
    """Facts about single rows: ``(check, k1, k2, s, t, null masks, cell hashes)``.

    ``s`` and ``t`` count the row on its side, or child and parent rows for a foreign key. Hashes of
    source cells are added and those of target cells subtracted, so what is equal cancels out.
    """

    def __init__(self, width: int) -> None:
        self._width, self._masks = width, -(-width // _BITS)

    def fact(self, check: int, key: tuple[Column, Column], side: str, cells: Sequence[Column] = ()) -> Column:
        sign = 1 if side == "s" else -1
        hashes = [F.shiftright(F.xxhash64(c), _SPARE) * F.lit(sign) for c in cells] + [F.lit(0).cast("long")] * (self._width - len(cells))
        masks = []
        for m in range(self._masks):
            bits = [F.when(c.isNull(), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, c in enumerate(cells[m * _BITS:(m + 1) * _BITS])]
            masks.append(reduce(lambda a, b: a + b, bits) if bits else F.lit(0).cast("long"))
        return F.struct(
            F.lit(check).alias("check"), key[0].alias("k1"), key[1].alias("k2"),
            F.lit(1 if side == "s" else 0).cast("long").alias("s"), F.lit(1 if side == "t" else 0).cast("long").alias("t"),
            *[m.alias(f"m{i}") for i, m in enumerate(masks)], *[h.alias(f"h{i}") for i, h in enumerate(hashes)],
        )

    def counts(self, facts: DataFrame) -> DataFrame:
        """One row per check, from one shuffle of facts added up by key and a second one of a row per task and check."""
        sums = [F.sum(c).alias(c) for c in ("s", "t")]
        # Too many rows of one key to add up count as different.
        sums += [F.try_sum(f"h{i}").alias(f"h{i}") for i in range(self._width)]
        masks = [F.bit_and(f"m{i}").alias(f"m{i}") for i in range(self._masks)]
        keyed = facts.groupBy("check", "k1", "k2").agg(*sums, *masks)
        s, t = F.col("s"), F.col("t")
        matched, pairs = (s > 0) & (t > 0), s * t

        def per_column(hit: Column) -> Column:
            return F.coalesce(F.sum(F.when(matched & hit, pairs)), F.lit(0))

        changed = [per_column(F.coalesce(F.col(f"h{i}"), F.lit(1)) != 0) for i in range(self._width)]
        nulls = [
            per_column((F.shiftright(f"m{i // _BITS}", i % _BITS).bitwiseAND(F.lit(1)) == 1) & (F.col(f"h{i}") == 0))
            for i in range(self._width)
        ]
        empty = F.array().cast("array<bigint>")
        return keyed.groupBy("check").agg(
            F.sum(s).alias("rows_s"), F.sum(t).alias("rows_t"), F.count(F.when(t > 1, 1)).alias("repeated"),
            F.coalesce(F.sum(F.when(t == 0, s)), F.lit(0)).alias("orphans"), per_column(F.lit(True)).alias("total"),
            (F.array(*changed) if changed else empty).alias("changed"), (F.array(*nulls) if nulls else empty).alias("both_null"),
        )


def check_counts(
    source: Mapping[str, DataFrame],
    target: Mapping[str, DataFrame],
    specs: Mapping[str, TableSpec],
    masked: Mapping[str, Collection[str]],
    *,
    compare_rows: bool = True,
) -> DataFrame:
    """``(kind, label, column_name, is_masked, is_first, s, t, n, total, changed, both_null)``.

    Kinds are ``rows`` (one per table), ``unique`` and ``fk`` (per key), ``no_key`` (a table whose rows cannot
    be matched) and ``column`` (per column of the others). ``s`` and ``t`` are the rows on either side,
    ``n`` the repeated keys or the rows without a parent. Keys with a NULL part are ignored, as
    are foreign keys whose parent is not among the targets. Tables of ``specs`` are checked.
    """
    checks: list[_Check] = []

    def number(*what: object) -> int:
        checks.append(_Check(*what))
        return len(checks) - 1

    def narrowed(frames: Mapping[str, DataFrame], name: str) -> dict[str, T.DataType]:
        return {f.name: f.dataType for f in frames[name].schema.fields}

    width = max([len(source[n].columns) for n in specs if specs[n].pk] or [0]) if compare_rows else 0
    make, facts = _Facts(width), {("s", n): [] for n in specs} | {("t", n): [] for n in target}
    no_key = (F.lit(0).cast("long"), F.lit(0).cast("long"))
    for name, spec in specs.items():
        own = number("rows", name)
        columns = tuple(sorted(source[name].columns)) if spec.pk and compare_rows else ()
        compared = number("columns", name, columns) if columns else None
        types = key_types(source[name], spec.pk, target[name], spec.pk) if columns else []
        for side, frames in (("s", source), ("t", target)):
            df = frames[name]
            row = make.fact(own, no_key, side)
            facts[side, name].append(row)
            if columns:
                key = [typed_key(df, c, t) for c, t in zip(spec.pk, types, strict=True)]
                dtypes = narrowed(frames, name)
                cells = [_comparable(quoted(c), dtypes[c]) for c in columns]
                # Rows without a complete key match nothing, but are rows.
                facts[side, name].append(F.when(_present(key), make.fact(compared, _digest(key), side, cells)))
        for group in spec.unique_groups:
            check, parts = number("unique", _label(spec, group)), [quoted(c) for c in group]
            facts["t", name].append(F.when(_present(parts), make.fact(check, _digest(parts), "t")))
        for fk in spec.fks:
            if fk.parent not in target:
                continue
            child, parent = target[name], target[fk.parent]
            kinds = key_types(child, fk.cols, parent, fk.parent_cols)
            check = number("fk", _label(spec, fk.cols))
            mine = [typed_key(child, c, t) for c, t in zip(fk.cols, kinds, strict=True)]
            theirs = [typed_key(parent, c, t) for c, t in zip(fk.parent_cols, kinds, strict=True)]
            # A text that is no value of the parent's type is a key without parent.
            facts["t", name].append(
                F.when(_present([quoted(c) for c in fk.cols]), make.fact(check, _digest(mine), "s"))
            )
            facts["t", fk.parent].append(F.when(_present(theirs), make.fact(check, _digest(theirs), "t")))
    frames = []
    for (side, name), found in facts.items():
        if found:
            df = (source if side == "s" else target)[name]
            frames.append(df.select(F.explode(F.array_compact(F.array(*found))).alias("f")).select("f.*"))
    counted = make.counts(reduce(lambda a, b: a.unionByName(b), frames))
    return _named(counted, checks, masked, [n for n, s in specs.items() if not s.pk])


def _named(
    counted: DataFrame, checks: Sequence[_Check], masked: Mapping[str, Collection[str]], keyless: Sequence[str]
) -> DataFrame:
    """Results by check and column; checks that no row took part in count nothing."""
    rows = []
    for i, c in enumerate(checks):
        if c.kind == "columns":
            rows += [(i, "column", c.label, x, x in masked.get(c.label, ()), k == 0, k) for k, x in enumerate(c.columns)]
        else:
            rows.append((i, c.kind, c.label, None, False, True, 0))
    rows += [(-1, "no_key", n, None, False, True, 0) for n in keyless]
    spark = counted.sparkSession
    wanted = spark.createDataFrame(
        rows, "wanted int, kind string, label string, column_name string, is_masked boolean, is_first boolean, place int"
    )
    joined = wanted.join(counted, F.col("wanted") == F.col("check"), "left_outer")

    def number(c: Column) -> Column:
        return F.coalesce(c, F.lit(0).cast("long"))

    # Rows of a table, with or without a complete key, are counted by its first check.
    table_rows = F.max(F.when(F.col("kind") == "rows", F.col("rows_s"))).over(Window.partitionBy("label"))
    return joined.select(
        "kind", "label", "column_name", "is_masked", "is_first", number(table_rows).alias("s"), number(F.col("rows_t")).alias("t"),
        number(F.when(F.col("kind") == "unique", F.col("repeated")).otherwise(F.col("orphans"))).alias("n"),
        number(F.col("total")).alias("total"),
        *[number(F.get(c, F.col("place"))).alias(c) for c in ("changed", "both_null")],
    )
