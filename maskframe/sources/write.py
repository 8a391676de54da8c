"""Writers: collision policies, passthrough copies, file exports and dual targets."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F

from maskframe.context import MaskError
from maskframe.functions.text import quoted
from maskframe.operators.skew import row_hash

POLICIES = {"fail": "errorifexists", "truncate": "overwrite", "drop_create": "overwrite"}
_SINKS = ("parquet", "jsonl")


def _mode(policy: str) -> str:
    if policy == "append":
        raise ValueError("append is not supported; use truncate or drop_create")
    if policy not in POLICIES:
        raise ValueError(f"unknown collision policy: {policy!r}")
    return POLICIES[policy]


def write_table(
    df: DataFrame,
    path: str,
    *,
    policy: str = "fail",
    fmt: str = "parquet",
    partition_by: Sequence[str] = (),
) -> None:
    """Write a table under a collision policy: fail, truncate or drop_create."""
    if fmt not in _SINKS:
        raise MaskError(f"unknown sink format: {fmt!r}; expected one of {_SINKS}")
    writer: DataFrameWriter = df.write.mode(_mode(policy))
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "jsonl":
        writer.option("ignoreNullFields", "false").json(path)
    else:
        writer.parquet(path)


def write_jdbc(
    df: DataFrame,
    url: str,
    table: str,
    *,
    policy: str = "fail",
    properties: dict[str, str] | None = None,
    batch_size: int = 10_000,
) -> None:
    """Write to a database table; ``truncate`` keeps its definition, ``drop_create`` does not."""
    writer = df.write.format("jdbc").mode(_mode(policy))
    options = {"url": url, "dbtable": table, "batchsize": str(batch_size), **(properties or {})}
    writer.options(**options).option("truncate", str(policy == "truncate").lower()).save()


def copy_passthrough(spark: SparkSession, source: str, target: str, *, policy: str = "fail") -> None:
    """Copy a table in which no column is masked: read and write, nothing in between."""
    write_table(spark.read.parquet(source), target, policy=policy)


def write_files(
    df: DataFrame,
    path: str,
    fmt: str,
    *,
    key: Sequence[str] = (),
    policy: str = "fail",
    mask: Callable[[DataFrame], DataFrame] | None = None,
) -> None:
    """Export masked rows with names and types kept.

    With ``key`` the files are range-partitioned and sorted by it: a global order without
    passing everything through one task. A hash of the row breaks ties, so that the rows of
    one very frequent key can still be divided between several files. Finding the ranges reads
    the rows once more; ``mask`` is applied after that, so masking runs only once. The order
    is then that of the keys before masking.
    """
    ordered = df
    if key:
        cols = [quoted(c) for c in key]
        ordered = df.repartitionByRange(*cols, row_hash(df)).sortWithinPartitions(*cols)
    if mask is not None:
        ordered = mask(ordered)
    write_table(ordered, path, policy=policy, fmt=fmt)


def dual_write(
    df: DataFrame, first: str, second: str, *, second_fmt: str = "jsonl", policy: str = "fail"
) -> DataFrame:
    """Mask once, write twice: the second target is produced from the first one's files.

    Reading the finished table back costs less than masking again and survives lost
    executors, which a cached copy would not.
    """
    write_table(df, first, policy=policy)
    written = df.sparkSession.read.schema(df.schema).parquet(first)
    write_table(written, second, policy=policy, fmt=second_fmt)
    return written


def sink_stats(written: DataFrame, table: str, fmt: str) -> DataFrame:
    """Row count of an export, for the run summary."""
    return written.agg(F.count("*").alias("rows")).select(
        F.lit(table).alias("table_id"), F.lit(fmt).alias("sink_format"), "rows"
    )
