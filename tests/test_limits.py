"""No width, modulus, list or file defect changes what comes out unasked."""

import hashlib

import pytest
from pyspark.sql import functions as F

from maskframe import Fake, MaskError, TableSpec, mask_table
from maskframe.functions.seeds import Seed
from maskframe.functions.unique import unique_numeric, unique_suffix
from maskframe.operators import profile, verify
from maskframe.operators.skew import key_join
from maskframe.sources.read import read_files


@pytest.fixture(scope="module")
def hexes(spark):
    digests = [hashlib.sha256(str(i).encode()).hexdigest()[:32] for i in range(40)] + ["f" * 32, "0" * 32]
    return spark.createDataFrame([(h,) for h in digests], "h string")


def test_seed_numbers_of_every_size(hexes):
    moduli = [25, 10**10, 10**16, 10**17, 10**18, 2**61 - 1, 2**63 - 1, 10**19, 10**30, 2**118 - 1]
    seed = Seed(F.col("h"))
    out = hexes.select("h", seed.digits().alias("digits"), *[seed.mod(n).alias(f"m{i}") for i, n in enumerate(moduli)])
    for r in out.collect():
        assert int(r.digits) == int(r.h, 16) and len(r.digits) == 54
        assert [int(r[f"m{i}"]) for i in range(len(moduli))] == [int(r.h, 16) % n for n in moduli]


def test_digit_strings_of_every_width_and_sign(hexes):
    texts = ["", *["9" * w for w in range(1, 19)], "-12345", "-7", "1" * 45, "5" * 60]
    seed = Seed(F.col("h"))
    out = hexes.select("h", *[unique_numeric(F.lit(t), seed).alias(f"t{i}") for i, t in enumerate(texts)],
                       unique_suffix(F.lit("-1234"), seed, "any").alias("any"), unique_suffix(F.lit(""), seed, "text").alias("empty"))
    for r in out.collect():
        for i, t in enumerate(texts):
            width = len(t.lstrip("-"))
            want = ("-" if t.startswith("-") else "") + str(int(r.h, 16) % 10**width).zfill(width) if t else ""
            assert r[f"t{i}"] == want
        assert r.any == "-" + str(int(r.h, 16) % 10**4).zfill(4) and r.empty == ""


def test_long_literal_lists_on_a_number_column(spark):
    df = spark.range(5000).selectExpr("cast(id % 1500 AS int) AS v")
    literals = [str(i) for i in range(0, 3000, 2)] + ["no number"]
    assert tuple(verify.leak_probe(df, "t", "v", literals).first())[2:] == (750, sum(1 for i in range(5000) if i % 1500 % 2 == 0))


def test_large_samples_are_compared(spark):
    df = spark.range(150_000).selectExpr("id", "id * 2 AS v")
    assert verify.sample_match(df, df, ["id"], sample=120_000).count() == 120_000


def test_exact_counts_need_no_expand(spark):
    df = spark.createDataFrame(
        [(1, "a", 0.0, None), (2, "a", -0.0, None), (3, "b", float("nan"), None), (4, None, float("nan"), None)],
        "id int, v string, d double, n string",
    )
    for frame in (profile.profile(df, "t", exact_distinct=True), profile.unique_columns(df, "t")):
        assert "Expand" not in frame._jdf.queryExecution().toString()
    assert {r.column_name: r.n_distinct for r in profile.profile(df, "t", exact_distinct=True).collect()} == {"id": 4, "v": 2, "d": 2, "n": 0}
    assert {r.column_name: r.is_unique for r in profile.unique_columns(df, "t").collect()} == {"id": True, "v": False, "d": False, "n": True}


def test_bad_rows_end_the_job_or_are_kept(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,v\n1,x\nzwei,y\n3,"two\nlines"\n')
    (tmp_path / "a.jsonl").write_text('{"id": 1}\n{"id": \n{"id": 3}\n')
    for fmt in ("csv", "jsonl"):
        schema = "id int, v string"
        path = str(tmp_path / f"a.{fmt}")
        with pytest.raises(Exception):
            read_files(spark, path, fmt, schema=schema, multi_line=fmt == "csv").collect()
        kept = read_files(spark, path, fmt, schema=schema, multi_line=fmt == "csv", bad_rows="bad").collect()
        assert [r.bad is not None for r in kept] == [False, True, False]
    assert kept[0].id == 1 and kept[2].id == 3
    csv = read_files(spark, str(tmp_path / "a.csv"), "csv", schema="id int, v string", multi_line=True, bad_rows="bad").collect()
    assert csv[2].v == "two\nlines" and csv[1].v == "y"
    with pytest.raises(MaskError):
        read_files(spark, str(tmp_path / "a.csv"), "csv", bad_rows="bad")


def test_where_reaches_the_scan(spark, ctx, tmp_path):
    spark.range(100).selectExpr("id", "id % 5 AS part", "concat('n', id) AS name").write.partitionBy("part").parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    masked = mask_table(df, {"name": Fake("city")}, ctx, table="t", where="part = 3 AND id > 50")
    plan = masked._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(id,50)" in plan and "PartitionFilters: [isnotnull(part" in plan
    assert masked.count() == 10


def test_rows_are_compared_by_a_key_of_several_columns(spark):
    df = spark.range(20).selectExpr("id % 4 AS a", "id AS b", "concat('v', id) AS v")
    spec = TableSpec("t", pk=("a", "b"))
    out = verify.row_checks(df, df.withColumn("v", F.lit("x")), spec, ["v"], sample=None).collect()
    assert {r.target: r.verdict for r in out} == {"t.a": "pass", "t.b": "pass", "t.v": "pass"}


def test_key_join_of_an_empty_table(spark):
    """A table without rows has no heavy keys to look for."""
    left = spark.createDataFrame([], "k long, v string")
    right = spark.createDataFrame([(1, "x")], "k2 long, w string")
    for how in ("inner", "left_outer", "left_semi", "left_anti"):
        assert key_join(left, right, [("k", "k2")], how).count() == 0
