import pytest
from pyspark.sql import functions as F

from maskframe.operators import profile

SCHEMA = "k bigint, t string, x double, l array<int>, m map<string,int>, z binary, n int"


def rows(n):
    return [(i, None if i % 3 == 0 else f"é{i % 50}", -0.0 if i % 2 else 0.0, [i % 4], {"a": i % 5}, bytes([i % 7]), None) for i in range(n)]


def exact(df):
    return {r.column_name: tuple(r) for r in profile.profile(df, "t", exact_distinct=True).collect()}


def sketched(state):
    return {r.column_name: tuple(r) for r in profile.profile_of(state).collect()}


@pytest.mark.parametrize("fan", [1, 2, 3, 256])
def test_layers_add_up_to_the_exact_profile(spark, fan):
    df = spark.createDataFrame(rows(150), SCHEMA).repartition(11)
    assert sketched(profile.profile_state(df, "t", fan=fan)) == exact(df)


def test_parts_merge_without_a_scan(spark, tmp_path):
    df = spark.createDataFrame(rows(150), SCHEMA)
    for i, part in enumerate((df.where("k < 40"), df.where("k >= 40"), df.limit(0))):
        profile.profile_state(part, "t").write.parquet(f"{tmp_path}/{i}")
    merged = profile.merge_profiles(*[spark.read.parquet(f"{tmp_path}/{i}") for i in range(3)])
    assert sketched(merged) == exact(df)


def test_empty_tables_and_odd_names(spark):
    empty = spark.createDataFrame([], "`part` int, `a.b` string, `n_rows` int, `c0_hash` int")
    assert sketched(profile.profile_state(empty, "t")) == exact(empty)
    assert [r.n_distinct for r in profile.profile(empty, "t").collect()] == [0] * 4
    one = spark.createDataFrame([(1, "x", None, 2)], empty.schema)
    assert sketched(profile.profile_state(one, "t")) == exact(one)
    assert profile.profile(spark.range(3).select(), "t").isEmpty()


def test_no_task_merges_more_than_fan_sketches(spark):
    df = spark.range(0, 1000, 1, 9).select(F.col("id") % 10)
    plan = profile.profile_state(df, "t", fan=3)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(part" in plan  # by groups of tasks
    assert "hashpartitioning(table_id" in plan and "column_name" in plan  # then column by column
    assert "SinglePartition" not in plan


def test_large_counts_are_close(spark):
    df = spark.range(0, 200_000, 1, 20).select("id", (F.col("id") % 5000).alias("v"))
    got = {r.column_name: r.n_distinct for r in profile.profile(df, "t").collect()}
    assert abs(got["id"] - 200_000) < 10_000 and abs(got["v"] - 5000) < 250
