"""Helpers that the training-data operators share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder path below ``spark.checkpoint.dir``, which driver and executors share; an error where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def stage_table(df: DataFrame, path: str | None = None) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = path or shared_dir(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A stage_table whose tables are deleted at the end: only for what no later DataFrame reads."""
    root = shared_dir(spark)
    try:
        yield lambda df: stage_table(df, f"{root}/{uuid.uuid4().hex}")
    finally:
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_words(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column of an Arrow batch."""
    return column.cast(pa.large_binary()).to_pylist()


def small_batches(spark: SparkSession) -> None:
    """Texts and arrays go to Python in Arrow batches of at most 1000 rows and 8 MB, not of 10,000 rows: batches lie in
    memory outside of the heap, on both sides. Smaller settings of the session stay."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", 1000), ("spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20)):
        now = spark.conf.get(key, None)
        digits = "".join(c for c in str(now) if c.isdigit())
        plain = digits and str(now).strip("bB") == digits
        if not plain or not 0 < int(digits) <= most:
            spark.conf.set(key, str(most))
