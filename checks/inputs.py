"""Inputs shared by the registered queries: the given tables and columns derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskframe import ForeignKey, TableSpec


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def people(spark: SparkSession, sf: str) -> DataFrame:
    """Customers with personal columns derived from their key; some cells NULL or empty."""
    key = F.col("c_custkey")
    text = key.cast("string")
    email = F.concat(F.lower("c_name"), F.lit("@example.test"))
    return table(spark, sf, "customer").select(
        key.alias("id"),
        F.col("c_nationkey").alias("nation_id"),
        F.col("c_name").alias("name"),
        F.when(key % 10 == 9, None).when(key % 10 == 8, "").otherwise(email).alias("email"),
        F.concat(F.lit("+"), (key % 90 + 1).cast("string"), F.lit(" 555 "), F.lpad(text, 7, "0")).alias("phone"),
        F.concat(
            F.lpad((key % 900 + 100).cast("string"), 3, "0"), F.lit("-"),
            F.lpad((key % 100).cast("string"), 2, "0"), F.lit("-"),
            F.lpad((key % 10000).cast("string"), 4, "0"),
        ).alias("ssn"),
        F.when(key % 13 == 0, "unknown")
        .otherwise(F.date_add(F.lit("1950-01-01").cast("date"), (key % 20000).cast("int")).cast("string"))
        .alias("dob"),
        F.concat(F.lit("Cafe\u0301 "), F.col("c_mktsegment"), F.lit(" A\u030a "), text).alias("nickname"),
    )


PEOPLE_SQL = """
people AS (
  SELECT c_custkey AS id, c_nationkey AS nation_id, c_name AS name,
    CASE WHEN c_custkey % 10 = 9 THEN NULL WHEN c_custkey % 10 = 8 THEN ''
         ELSE lower(c_name) || '@example.test' END AS email,
    '+' || (c_custkey % 90 + 1)::VARCHAR || ' 555 ' || lpad(c_custkey::VARCHAR, 7, '0') AS phone,
    lpad((c_custkey % 900 + 100)::VARCHAR, 3, '0') || '-' || lpad((c_custkey % 100)::VARCHAR, 2, '0')
      || '-' || lpad((c_custkey % 10000)::VARCHAR, 4, '0') AS ssn,
    CASE WHEN c_custkey % 13 = 0 THEN 'unknown'
         ELSE (DATE '1950-01-01' + (c_custkey % 20000)::INT)::DATE::VARCHAR END AS dob,
    'Cafe' || chr(769) || ' ' || c_mktsegment || ' A' || chr(778) || ' ' || c_custkey::VARCHAR AS nickname
  FROM customer)
"""

SPECS = {
    "region": TableSpec("region", pk=("r_regionkey",)),
    "nation": TableSpec("nation", pk=("n_nationkey",), fks=(ForeignKey(("n_regionkey",), "region", ("r_regionkey",)),)),
    "customer": TableSpec(
        "customer", pk=("c_custkey",), uniques=(("c_name",),),
        fks=(ForeignKey(("c_nationkey",), "nation", ("n_nationkey",)),), not_null=frozenset({"c_nationkey"}),
    ),
    "supplier": TableSpec(
        "supplier", pk=("s_suppkey",), uniques=(("s_name",),),
        fks=(ForeignKey(("s_nationkey",), "nation", ("n_nationkey",)),),
    ),
    "part": TableSpec("part", pk=("p_partkey",)),
    "orders": TableSpec(
        "orders", pk=("o_orderkey",), fks=(ForeignKey(("o_custkey",), "customer", ("c_custkey",)),),
        not_null=frozenset({"o_custkey"}),
    ),
    "lineitem": TableSpec(
        "lineitem",
        fks=(
            ForeignKey(("l_orderkey",), "orders", ("o_orderkey",)),
            ForeignKey(("l_partkey",), "part", ("p_partkey",)),
            ForeignKey(("l_suppkey",), "supplier", ("s_suppkey",)),
        ),
    ),
    "events": TableSpec("events", pk=("event_id",), fks=(ForeignKey(("user_id",), "customer", ("c_custkey",)),)),
}


def star(spark: SparkSession, sf: str, *names: str) -> dict[str, DataFrame]:
    return {n: table(spark, sf, n) for n in names or SPECS}
