"""Tables of versions, written by the micro-batches of streaming queries.

A version is a folder of its own and counts once its mark is there: an empty
file, created as the last step, that names the version and the batch that made
it.  So a version is there as a whole or not at all, a batch that runs again
after its mark is known by it, and one that died before writes the same version
over."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession

_MARK = re.compile(r"_done-(\d+)-(\S+)")


def batch_name(spark: SparkSession, checkpoint: str, epoch: int) -> str:
    """A name of a micro-batch that stays when it runs again: the query's id,
    which its checkpoint keeps, and the epoch."""
    query = spark.sparkContext.getLocalProperty("sql.streaming.queryId")
    return f"{query or hashlib.sha256(checkpoint.encode()).hexdigest()[:16]}-{epoch}"


def _path(spark: SparkSession, *parts: str):
    return spark._jvm.org.apache.hadoop.fs.Path("/".join(p.rstrip("/") for p in parts))


def _fs(spark: SparkSession, path):
    return path.getFileSystem(spark._jsc.hadoopConfiguration())


def _folder(base: str, version: int) -> str:
    return f"{base.rstrip('/')}/version={version:010d}"


def committed(spark: SparkSession, base: str) -> dict[int, str]:
    """The versions that count and the batches that made them, ascending."""
    folder = _path(spark, base)
    fs = _fs(spark, folder)
    if not fs.exists(folder):
        return {}
    marks = [_MARK.fullmatch(f.getPath().getName()) for f in fs.listStatus(folder)]
    return dict(sorted((int(m[1]), m[2]) for m in marks if m))


def latest(spark: SparkSession, base: str) -> int:
    """The newest version's number, -1 without any."""
    return max(committed(spark, base), default=-1)


def read(spark: SparkSession, base: str, version: int) -> DataFrame:
    return spark.read.parquet(_folder(base, version))


def write(df: DataFrame, base: str, version: int, batch: str) -> None:
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(_folder(base, version))
    mark = _path(spark, base, f"_done-{version}-{batch}")
    _fs(spark, mark).create(mark, True).close()


def forget(spark: SparkSession, base: str, before: int) -> None:
    """Delete the versions before one; their marks stay, empty files that tell
    their batches again."""
    for version in committed(spark, base):
        folder = _path(spark, _folder(base, version))
        if version < before:
            _fs(spark, folder).delete(folder, True)


def rows(spark: SparkSession, path: str) -> DataFrame:
    """All rows that a stateful job (T3, T8) has committed."""
    return spark.read.parquet(*[_folder(f"{path.rstrip('/')}/rows", v) for v in committed(spark, f"{path}/rows")])
