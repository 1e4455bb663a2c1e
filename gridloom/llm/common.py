"""What the operators share: the shared folder, written intermediate tables, Arrow helpers."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: With it Spark removes a query's shuffle files when the query is over, not when its objects are collected.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Narrow rows of one file, where their number is known beforehand.
FILE_ROWS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only on one machine (tests) a folder of our own is set where none is named; a cluster has to name one.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[.*\])?$", spark.conf.get("spark.master", "local")):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="gridloom-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def work_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/gridloom/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Writes df as Parquet into the shared folder and returns the table read back.

    It cuts the lineage with files that outlive any executor, and Spark then deletes the shuffle
    files that led to it. rows: about how many narrow rows df has at most; few are written by few tasks.
    """
    spark, path = df.sparkSession, work_dir(df.sparkSession, name)
    if rows is not None and -(-rows // FILE_ROWS) < partitions(spark):
        df = df.coalesce(max(1, -(-rows // FILE_ROWS)))
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Deletes the files of a table of materialize() that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark._jvm
    for f in {x.rpartition("/")[0] for x in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Lets Spark's context cleaner remove the shuffle files of phases that are over."""
    gc.collect()
    spark._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def small_text(c: Column | str) -> Column:
    """Null text counts as empty."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)


def text_groups(batches, column: str = "text", most: int = 4 << 20):
    """Splits Arrow batches so that a part holds at most `most` bytes of text, or one row."""
    for b in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < b.num_rows:
            base = sizes[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(sizes, base + most, side="right")))
            yield b.slice(start, end - start)
            start = end
