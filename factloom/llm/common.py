"""Helpers that the corpus operators share: input tables, tables in the shared folder, numbering, bounded bins."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Stands for a missing id wherever rows are matched by id.
NO_ID = -(2**63)
_written: list[str] = []
_kept: dict = {}


def kept(name, make):
    """What a Python worker keeps between tasks under `name`, as make() gave it. A worker keeps one at a time: that of an
    earlier operator goes, so stages that follow each other in reused workers don't add up."""
    if name not in _kept:
        if _kept:
            _kept.clear()
            gc.collect()
            pa.default_memory_pool().release_unused()
        _kept[name] = make()
    return _kept[name]


def few(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Batches in slices of a few rows, so that a worker holds Python objects of few texts at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only local mode does without: one machine, one folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = f"{tempfile.gettempdir()}/factloom-checkpoints"
    return folder.rstrip("/")


def store(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet into the shared folder and read it again.

    This cuts the lineage (a lost executor costs no recomputation before this point) and computes an input that
    several branches read only once. Files go when the application ends, or by drop_stored().
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/factloom-{uuid.uuid4().hex}/{name}"
    _written.append(path.rsplit("/", 1)[0])
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_in = _written[-1]
    return out


def discard(*stored: DataFrame) -> None:
    """Delete tables of store() that no later step reads: what was made of them is stored by now."""
    for df in stored:
        _written.remove(df._stored_in)
        _delete(df._stored_in)


def _delete(folder: str) -> None:
    context = SparkContext._active_spark_context
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def drop_stored() -> None:
    """Delete every table that store() wrote in this application; results that still read them become invalid."""
    context = SparkContext._active_spark_context
    if context is None or context._jsc is None or context._gateway is None:
        return
    try:
        while _written:
            _delete(_written.pop())
    except Exception:  # the JVM is already gone at exit
        _written.clear()


atexit.register(drop_stored)


def key_of(id_col: str | Column) -> Column:
    """An id that can be joined on: missing ids become NO_ID."""
    return F.coalesce((F.col(id_col) if isinstance(id_col, str) else id_col).cast("long"), F.lit(NO_ID))


def id_of(key: str) -> Column:
    return F.when(F.col(key) != NO_ID, F.col(key))


def with_bin(df: DataFrame, bins: int = 64) -> DataFrame:
    """Deal rows into `bins` even bins, whatever their keys; store() the result before numbering by it."""
    return df.withColumn("_bin", F.pmod(F.monotonically_increasing_id(), F.lit(bins)).cast("int"))


def number_within(df: DataFrame, keys: list[str], order: list[str], out: str) -> DataFrame:
    """Number the rows of each key from 0 without gaps, a hot key's rows in many tasks.

    `df` is a stored table from with_bin(). Rows are numbered inside (key, bin); the bins' counts, as few as keys times
    bins, give what comes before each bin.
    """
    counts = df.groupBy(*keys, "_bin").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*keys, "_bin", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys, "_bin").orderBy(*order)
    numbered = df.withColumn("_in_bin", F.row_number().over(inside))
    return numbered.join(counts, [*keys, "_bin"]).withColumn(out, F.col("_before") + F.col("_in_bin") - 1).drop("_before", "_in_bin")


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of steps whose results are stored by now."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
