"""Deterministic synthetic customer rows for load tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Multipliers of the 32 digests that make up the 1,024-character filler.
BIO_FACTORS = (
    2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37, 41, 43, 47, 53, 59, 61, 67, 71, 73, 79, 83, 89,
    97, 101, 103, 107, 109, 113, 127, 131,
)


def customer_columns(n: Column, orgs: int) -> list[Column]:
    """Columns of one synthetic customer as functions of its number."""
    text = n.cast("string")
    return [
        n.alias("id"),
        (n % F.lit(orgs) + F.lit(1)).alias("org_id"),
        F.concat(F.lit("customer"), text, F.lit("@example.test")).alias("email"),
        F.concat(F.lit("Customer Number "), text).alias("full_name"),
        F.lpad((n % F.lit(1_000_000_000)).cast("string"), 9, "0").alias("ssn"),
        F.concat(*[F.md5((n * F.lit(k)).cast("string").cast("binary")) for k in BIO_FACTORS]).alias("bio"),
    ]


def synth_customers(
    spark: SparkSession, n: int, orgs: int = 100, partitions: int | None = None
) -> DataFrame:
    """``n`` rows of about 1.1 KB, generated in parallel without any input."""
    numbers = spark.range(1, n + 1, 1, partitions) if partitions else spark.range(1, n + 1)
    return numbers.select(*customer_columns(F.col("id"), orgs))
