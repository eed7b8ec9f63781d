"""What the operators of this folder share: text patterns, row keys, tables in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words and the runs between them, as Java and RE2 patterns.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\f\r"


def shared_folder(spark: SparkSession) -> str:
    """The folder that every executor and the driver see: ``spark.checkpoint.dir``; a new local one only where it is unset."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
        context.setCheckpointDir(folder)
    return folder


def shared_table(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read again.

    Cuts the lineage like ``checkpoint()``, keeps only what is written if an executor is lost, and gives the
    optimizer the true size, so that it broadcasts a table only when that is small.
    """
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._shared_path = path
    return table


def text_of(column: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def row_key(*columns: str) -> Column:
    """128 bits that name a row by its columns' values, as a struct of two longs; equal rows share it."""
    values = [F.coalesce(F.col(c).cast("string"), F.lit("\x00null")) for c in columns]
    return F.struct(*[F.xxhash64(F.lit(seed), *values).alias(f"h{seed}") for seed in (1, 2)])


def free(*tables: DataFrame) -> None:
    """Removes what ``shared_table`` wrote; for tables that nothing reads any more."""
    for table in tables:
        context = table.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(table._shared_path)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


#: Bits of a filter of keys at most, and bits for each key up to that.
SIFT_BITS, KEY_BITS = 1 << 26, 16


def flagged(rows: DataFrame, keys: DataFrame, key: str, flag: str = "_may") -> DataFrame:
    """``rows`` with ``flag``: whether their ``key`` may be among ``keys``, told by a Bloom filter before any row moves.

    No row of ``keys`` is missed and a few others are flagged too, so an exact join follows. The filter adds up from
    parts and is 8 MB at most, whatever the number of keys; with over four million of them more rows are flagged.
    """
    spark = rows.sparkSession
    bits = max(1 << 10, min(SIFT_BITS, 1 << (KEY_BITS * keys.count()).bit_length()))
    places = [F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(bits)) for seed in ("a", "b")]
    marks = keys.select(F.explode(F.array(*places)).alias("at")).selectExpr("shiftright(at, 6) as word", "shiftleft(1L, cast(at & 63 as int)) as bits")
    words = marks.unionByName(spark.range(bits >> 6).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bits"))).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    table = shared_table(words.agg(F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("all")).select(F.transform("all", lambda x: x["bits"]).alias("_filter")))
    at = lambda p: F.get("_filter", F.shiftright(p, 6).cast("int"))
    hit = lambda p: F.call_function("shiftright", at(p), p.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1
    return rows.crossJoin(F.broadcast(table)).withColumn(flag, hit(places[0]) & hit(places[1])).drop("_filter")


def sifted(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows that ``flagged`` flags; for an inner join, as the optimizer moves semi and anti joins in front of the filter."""
    return flagged(rows, keys, key).where("_may").drop("_may")


def blocks(spark: SparkSession) -> int:
    """In how many blocks to deal rows: it decides only how work is spread, never a result."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
