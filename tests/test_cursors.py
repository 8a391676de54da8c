import datetime as dt
import uuid
from decimal import Decimal

import duckdb
import pytest

from maskframe import MaskError
from maskframe.sources import cursor_after, range_predicates, read_after, split_query
from maskframe.sources.read import quoted_name, sql_literal

ROWS = [(a, b) for a in (None, "", "a", "b", "B", "é", "o'x") for b in (None, 1, 2, 3)] + [("a", 2)]


@pytest.fixture(scope="module")
def con():
    db = duckdb.connect()
    db.execute('CREATE TABLE "order" (k VARCHAR, "n""o" INT)')
    db.executemany('INSERT INTO "order" VALUES (?, ?)', ROWS)
    return db


def test_batches_of_a_composite_key_with_nulls(spark):
    rows = list(dict.fromkeys(ROWS))
    df, seen, cursor = spark.createDataFrame(rows, "k string, n int"), [], None
    while (batch := read_after(df, ["k", "n"], cursor, 5)).count():
        seen += [tuple(r) for r in batch.collect()]
        cursor = cursor_after(batch, ["k", "n"])
    expected = sorted(rows, key=lambda r: [(v is not None, v.encode() if isinstance(v, str) else v) for v in r])
    assert seen == expected
    assert cursor_after(df.limit(0), "k") is None and cursor_after(df, "n") == 3


def test_a_cursor_needs_every_column(spark):
    df = spark.range(3)
    for cursor in ((1,), (1, 2, 3)):
        with pytest.raises(MaskError, match="every key column"):
            read_after(df, ["id", "id"], cursor)


def test_composite_cursor_reaches_the_scan(spark, sf):
    df = read_after(spark.read.parquet(f"{sf}/lineitem.parquet"), ["l_orderkey", "l_linenumber"], (300, 2))
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    plan = df.select("l_partkey")._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = plan[plan.index("PushedFilters"):]
    assert "GreaterThanOrEqual(l_orderkey,300)" in pushed
    assert "Or(GreaterThan(l_orderkey,300),And(EqualTo(l_orderkey,300),GreaterThan(l_linenumber,2)))" in pushed
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint,l_linenumber:" in plan


@pytest.mark.parametrize("parts", [1, 2, 3, 7, 50])
def test_ranges_hold_every_row_once(con, parts):
    key = ["k", 'n"o']
    cuts = con.execute(split_query("order", key, parts)).fetchall()
    assert len(cuts) <= parts - 1 and all(None not in c for c in cuts)
    predicates = range_predicates(key, cuts)
    assert len(predicates) == len(set(cuts)) + 1
    found = [r for p in predicates for r in con.execute(f'SELECT * FROM "order" WHERE {p}').fetchall()]
    assert sorted(map(repr, found)) == sorted(map(repr, ROWS))


def test_ranges_have_like_shares():
    db = duckdb.connect()
    db.execute("CREATE TABLE t AS SELECT md5(i::VARCHAR) AS k FROM range(1000) r(i)")
    sizes = [
        db.execute(f"SELECT count(*) FROM t WHERE {p}").fetchone()[0]
        for p in range_predicates(["k"], db.execute(split_query("t", ["k"], 8)).fetchall())
    ]
    assert sizes == [125] * 8


def test_the_same_ranges_in_spark(spark, con):
    df = spark.createDataFrame(ROWS, "k string, n int")
    predicates = range_predicates(["k", "n"], [("a", 2), ("b", 1)], quote="`")
    found = [tuple(r) for p in predicates for r in df.where(p).collect()]
    assert sorted(map(repr, found)) == sorted(map(repr, ROWS))
    assert range_predicates(["k"], []) == ["1 = 1"]


def test_names_and_literals_are_quoted(con):
    assert quoted_name('a.b"c') == '"a"."b""c"' and quoted_name("a.b", "`", dotted=False) == "`a.b`"
    for bad in ("", "a\nb", "a\x00"):
        with pytest.raises(MaskError, match="control characters"):
            quoted_name(bad)
    values = ["o'x\\", 7, Decimal("1E+2"), dt.date(2024, 2, 29), dt.datetime(2024, 2, 29, 1, 2, 3, 4), True, uuid.UUID(int=5)]
    for value in values:
        got = con.execute(f"SELECT {sql_literal(value)}").fetchone()[0]
        assert got == (str(value) if isinstance(value, uuid.UUID) else value)
    for bad in (b"x", 1.5, None, "a\x00b"):
        with pytest.raises(MaskError, match="no SQL literal"):
            sql_literal(bad)
    for cuts in ([("a",)], [("a", None)]):
        with pytest.raises(MaskError, match="every key column"):
            range_predicates(["k", "n"], cuts)
