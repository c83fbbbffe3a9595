"""Semi-naive fixpoints over DataFrames."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

_written: set[str] = set()
#: The codec of tables in the shared folder: a third to a half smaller than Spark's own.
PACKING = "zstd"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only local mode does without: one machine, one folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = f"{tempfile.gettempdir()}/factloom-checkpoints"
    return folder.rstrip("/")


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder. What is written there goes when the application ends."""
    path = f"{shared_dir(spark)}/factloom-rounds-{uuid.uuid4().hex}"
    _written.add(path)
    return path


def settle(df: DataFrame) -> DataFrame:
    """Write `df` to the shared folder and read it again: plans stay short, and a lost executor costs no recomputation of
    earlier rounds. Files go by forget(), or when the application ends."""
    spark = df.sparkSession
    path = scratch(spark)
    df.write.option("compression", PACKING).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled_in = path
    return out


def dealt(df: DataFrame, *columns: str) -> DataFrame:
    """settle() into buckets by the hash of `columns`, one for each partition of a shuffle: a join on them, in any number of rounds, shuffles none of these rows again.
    What is dealt so already is given back as it is."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if getattr(df, "_dealt_by", None) == (columns, n):
        return df
    path, name = scratch(spark), f"factloom_{uuid.uuid4().hex}"
    df.repartition(n, *columns).write.bucketBy(n, *columns).option("path", path).option("compression", PACKING).format("parquet").saveAsTable(name)
    out = spark.table(name)
    out._settled_in, out._settled_as, out._dealt_by = path, name, (columns, n)
    return out


def dealt_more(table: DataFrame, rows: DataFrame) -> DataFrame:
    """A table of dealt() with more rows of its columns."""
    name = table._settled_as
    rows.select(table.columns).write.insertInto(name)
    out = table.sparkSession.table(name)
    out._settled_in, out._settled_as, out._dealt_by = table._settled_in, name, table._dealt_by
    return out


@contextlib.contextmanager
def together(spark: SparkSession) -> Iterator[None]:
    """Within it, tables dealt by some columns are joined where they are on these and more columns; by default Spark deals them anew by all of them, lest a few values be large."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def forget(*settled: DataFrame) -> None:
    """Delete tables of settle() that nothing reads any more."""
    context = SparkContext._active_spark_context
    for df in settled:
        if getattr(df, "_settled_as", None):
            df.sparkSession.sql(f"DROP TABLE IF EXISTS {df._settled_as}")
    for path in {df._settled_in for df in settled} & _written:
        where = context._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)
        _written.discard(path)


def _forget_all() -> None:
    context = SparkContext._active_spark_context
    if context is None or context._jsc is None or context._gateway is None:
        return
    try:
        for path in list(_written):
            where = context._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the JVM is already gone at exit
        pass
    _written.clear()


atexit.register(_forget_all)


def fixpoint(seed: DataFrame, step: Callable[[DataFrame], DataFrame], apart: Sequence[str] = ()) -> DataFrame:
    """The least set of rows that holds `seed` and step() of its rows: each round steps only from the rows that are new.
    It ends when a round finds none, after as many rounds as the longest derivation has steps.

    Where step() never leads from one value of the columns `apart` to another, rows stay dealt by these, and so may be what step() joins (see dealt()): a round
    shuffles at most what it derives. A task holds whole values of them then; its sorts spill."""
    spark = seed.sparkSession
    with together(spark) if apart else contextlib.nullcontext():
        keep = (lambda df: dealt(df, *apart)) if apart else settle
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        known = delta = keep(seed.distinct())
        parts = [known]
        while True:
            found = step(delta).select(seed.columns)
            found = (found.repartition(n, *apart) if apart else found).distinct()
            for part in parts if apart else [known]:  # a union would lose where its rows are
                found = found.join(part, seed.columns, "left_anti")
            delta = keep(found.select(seed.columns))
            if delta.isEmpty():
                return known
            parts.append(delta)
            known = known.unionByName(delta)
            if len(parts) == 8:  # keep the union short; the newest rows are still read
                known = keep(known)
                forget(*parts[:-1])
                parts = [known]
