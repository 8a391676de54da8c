"""The masking projection on unbounded inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from maskframe.context import MaskContext, MaskError
from maskframe.functions.text import quoted
from maskframe.operators import actions as act
from maskframe.operators.mask import mask_table
from maskframe.operators.ner import SpanFinder
from maskframe.session import path_exists
from maskframe.spec import TableSpec


def read_stream(
    spark: SparkSession, path: str, schema: T.StructType, *, max_files_per_trigger: int = 1_000
) -> DataFrame:
    """Parquet files as a stream, a bounded number of them per micro-batch."""
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", max_files_per_trigger)
        .parquet(path)
    )


def mask_stream(
    stream: DataFrame,
    rules: act.Rules,
    ctx: MaskContext,
    *,
    table: str | TableSpec,
    finder: SpanFinder | None = None,
) -> DataFrame:
    """Mask a streaming DataFrame: a stateless projection, so no watermark is needed."""
    return mask_table(stream, rules, ctx, table=table, finder=finder)


def write_available(
    masked: DataFrame, path: str, checkpoint: str
) -> StreamingQuery:
    """Write everything available to Parquet and stop; a restart continues where this ended."""
    return (
        masked.writeStream.format("parquet").outputMode("append")
        .option("path", path).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def foreach_batch_sink(
    masked: DataFrame, path: str, checkpoint: str, *, table: str, run_id: str, cursor: str
) -> StreamingQuery:
    """Write each micro-batch together with its progress row.

    Rows go to ``path/rows/batch_id=N`` and the batch's (rows, last cursor) to
    ``path/progress/batch_id=N``. Both folders are replaced when a batch is replayed after a
    failure, so nothing is lost or doubled. Without its checkpoint a stream may be cut into
    other batches, so a new checkpoint over rows that are there already is refused.
    """
    spark = masked.sparkSession
    if path_exists(spark, f"{path}/rows") and not path_exists(spark, checkpoint):
        raise MaskError(f"{path} holds rows of another checkpoint; clear it or go on with that one")

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        rows_path = f"{path}/rows/batch_id={batch_id}"
        batch.write.mode("overwrite").parquet(rows_path)
        written = batch.sparkSession.read.schema(batch.schema).parquet(rows_path)
        progress = written.agg(
            F.count("*").alias("rows"), F.max(quoted(cursor)).cast("string").alias("cursor")
        ).select(
            F.lit(run_id).alias("run_id"), F.lit(table).alias("table_id"), "rows", "cursor",
            F.lit("in_progress").alias("status"),
        )
        progress.coalesce(1).write.mode("overwrite").parquet(f"{path}/progress/batch_id={batch_id}")

    return (
        masked.writeStream.foreachBatch(write_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
