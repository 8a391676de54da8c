"""Session defaults and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Salt and key reach the plan as binary literals; this hides them in explain() and the UI.
SECRET_LITERAL_REGEX = r"0x[0-9A-Fa-f]{16,}|X'[0-9A-Fa-f]{16,}'"


def session_builder(app: str = "maskframe") -> SparkSession.Builder:
    """Builder with the settings the operators assume; callers add master and memory.

    A projection with several fakes compiles to a method the JIT refuses above 8,000
    bytecodes. The method limit makes Spark fall back to split-up code there, which runs
    two to three times faster than the interpreted large method.
    """
    return (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        # Recording a Python call site per Column operation doubles the time to build a plan.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.redaction.string.regex", SECRET_LITERAL_REGEX)
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach: ``spark.checkpoint.dir``, or a test folder locally."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to storage that every executor can reach")
    folder = tempfile.mkdtemp(prefix="maskframe-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def run_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder name below :func:`shared_dir`."""
    return f"{shared_dir(spark)}/maskframe/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the reliable checkpoint folder, so losing executors loses no work."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether there is such a file or folder, in whatever store the path names."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
