"""Session settings used by tests and the benchmark, and the lineage cut used by iterative operators."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession


def local_session(cpus: str | int = 8, app: str = "panelspark") -> SparkSession:
    """A local session for tests and benchmarks. Cluster jobs bring their own session."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # Small local inputs: keep all cores busy instead of merging shuffles down to one-megabyte partitions.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("PANELSPARK_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the data lands in the shared checkpoint folder, so a lost executor costs nothing.

    The folder is the one the cluster names in ``spark.checkpoint.dir``; only a session without one
    (a local test) gets a temporary folder.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over as many tasks as a shuffle has, in turn: for costly columns of rows that lie in few files."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


#: Rows of a table that one task of ``dealt`` takes.
ROWS_A_TASK = 250_000


def dealt(df: DataFrame, rows: int, *keys: str | Column) -> DataFrame:
    """``df`` of about ``rows`` rows by its keys over so many tasks that each takes few, however large the table is.

    Joins and groups by the same keys that follow need no shuffle of their own. Adaptive execution merges its own
    shuffles up to a size in compressed bytes, and 64 MB may be millions of groups.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(cores, -(-rows // ROWS_A_TASK)), *keys)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet in the shared checkpoint folder and read again.

    For loops: a checkpoint remembers what the optimizer had inferred about its columns, and that grows from round to
    round; a table that is read starts afresh.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
        context.setCheckpointDir(folder)
    path = f"{folder.rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
