"""Shared helpers of the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reqlens.session import checkpoint_dir

#: Space and tab to carriage return, as a character class of Java's regex.
ASCII_SPACE = "[\x20\x09-\x0d]"


def shared_path(spark: SparkSession, label: str) -> str:
    """A new folder below the session's shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/llm-{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet below the shared checkpoint
    folder and read it back.  The table outlives lost executors, and Spark
    knows its size when it plans the joins that follow."""
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.staged_path)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Bound the rows of an Arrow batch, so that a Python worker holds a few
    MB of texts at a time however long the partition is."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body``; a plain column
    expression inside a lambda would be evaluated for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """Maximal runs of characters other than space and tab to carriage
    return; null counts as the empty text."""
    parts = F.split(F.coalesce(text.cast("string"), F.lit("")), ASCII_SPACE + "+")
    return F.filter(parts, lambda w: w != "")


def require(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
