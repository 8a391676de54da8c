import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from maskframe.operators.rundiff import diff_runs


def surplus(a, b):
    left, right = Counter(map(repr, a)), Counter(map(repr, b))
    return {(k, "a_only" if left[k] > right[k] else "b_only", abs(left[k] - right[k]))
            for k in left | right if left[k] != right[k]}


def found(df):
    return {(repr(tuple(r[:-2])), r.side, r.copies) for r in df.collect()}


@pytest.mark.parametrize("fanout", [(), (3,), (2, 5), (64, 64), (8, 8, 8)])
def test_equals_a_multiset_difference(spark, fanout):
    rnd = random.Random(len(fanout))
    rows = [(rnd.choice([None, 1, 2, 3]), rnd.choice([None, "", "-", "1:a", "a", "é" * 50]), rnd.choice([None, 0.5, 1e300]))
            for _ in range(3000)]
    a, b = rows[:2000] + rows[:300], rows[200:] + [(9, "only b", None)]
    schema = "k int, t string, x double"
    out = diff_runs(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), fanout=fanout)
    assert out.columns == ["k", "t", "x", "side", "copies"] and found(out) == surplus(a, b)


def test_neighbouring_cells_do_not_run_together(spark):
    a = spark.createDataFrame([("a", "bc"), ("1:", "x"), (None, "")], "p string, q string")
    b = spark.createDataFrame([("ab", "c"), ("1", ":x"), ("", None)], "p string, q string")
    assert diff_runs(a, b).count() == 6


def test_nested_and_special_values(spark):
    schema = "m map<string,int>, l array<string>, s struct<x:int,y:string>, d double, at timestamp, z binary"
    moment = dt.datetime(2024, 3, 1, 12, 0, 0, 123456)
    row = ({"a": 1, "b": None}, ["x", None], (1, None), float("nan"), moment, bytearray(b"\xff\x00"))
    same = ({"b": None, "a": 1}, *row[1:])
    one = spark.createDataFrame([row], schema)
    assert diff_runs(one, spark.createDataFrame([same], schema)).isEmpty()
    changed = [
        ({"a": 1}, *row[1:]), (row[0], ["x"], *row[2:]), (*row[:2], (1, ""), *row[3:]), (*row[:3], None, *row[4:]),
        (*row[:4], moment + dt.timedelta(microseconds=1), row[5]), (*row[:5], bytearray(b"\xff")),
    ]
    for other in changed:
        assert {(r.side, r.copies) for r in diff_runs(one, spark.createDataFrame([other], schema)).collect()} == {
            ("a_only", 1), ("b_only", 1)
        }
    zeros = spark.createDataFrame([(0.0,)], "d double"), spark.createDataFrame([(-0.0,)], "d double")
    assert diff_runs(*zeros).isEmpty()
    variant = one.select(F.parse_json(F.lit('{"b":1,"a":[null]}')).alias("v"))
    assert diff_runs(variant, one.select(F.parse_json(F.lit('{"a":[null],"b":1}')).alias("v"))).isEmpty()


def test_empty_tables_and_missing_columns(spark):
    empty = spark.createDataFrame([], "k int")
    assert diff_runs(empty, empty).isEmpty()
    assert found(diff_runs(empty, spark.createDataFrame([(None,)] * 3, "k int"))) == {("(None,)", "b_only", 3)}
    with pytest.raises(Exception, match="k"):
        diff_runs(empty, spark.createDataFrame([], "other int"))


def test_equal_runs_are_scanned_once(spark, tmp_path):
    for n in ("a", "b"):
        spark.range(20_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("t")).repartition(3).write.parquet(f"{tmp_path}/{n}")
    out = diff_runs(spark.read.parquet(f"{tmp_path}/a"), spark.read.parquet(f"{tmp_path}/b"))
    assert out.collect() == []
    final = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("FileScan parquet") <= 2
    planned = out._jdf.queryExecution().sparkPlan().toString()
    assert planned.count("FileScan parquet") == 2 * 4  # per side: two levels, digests, rows


def test_fingerprints_read_no_digits(spark):
    """Base conversions of every digest cost four times what the digest does."""
    one, other = (spark.range(n).select("id", (F.col("id") % 7).alias("k")) for n in (1000, 1001))
    out = diff_runs(one, other)
    assert "conv(" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert found(out) == {("(1000, 6)", "b_only", 1)}


def test_joins_on_buckets_ask_nothing_of_computed_columns(spark):
    """A bucket that might be null would be tested for it below the select that works a row out, all of it copied."""
    stored = spark.range(5).select("id", F.concat(F.lit("v"), "id").alias("v"))
    computed = stored.select("id", F.sha2(F.concat("v", F.upper("v")), 256).alias("v"))
    plan = diff_runs(stored, computed)._jdf.queryExecution().optimizedPlan().toString()
    assert "isnotnull(pmod" not in plan and "isnotnull(xxhash64" not in plan
