"""Readers and writers for the telemetry tables.

Tables are Parquet, partitioned by day (``dt``) in place of hypertable
chunks; readers take an explicit schema (no inference), turn a time filter
into a ``dt`` partition filter so whole days are pruned, and let Catalyst
push the remaining predicate into the Parquet scan (row-group min/max)."""

from __future__ import annotations

import json

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

REQUESTS_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("server_id", T.IntegerType()),
    T.StructField("status", T.BooleanType()), T.StructField("response_time_ms", T.LongType()),
    T.StructField("created_at", T.TimestampNTZType())])

SERVERS_SCHEMA = T.StructType([
    T.StructField("id", T.IntegerType()), T.StructField("name", T.StringType()),
    T.StructField("ip_address", T.StringType()), T.StructField("port", T.IntegerType()),
    T.StructField("status", T.StringType()), T.StructField("is_active", T.BooleanType()),
    T.StructField("weight", T.IntegerType()), T.StructField("capacity", T.IntegerType()),
    T.StructField("created_at", T.TimestampNTZType()), T.StructField("updated_at", T.TimestampNTZType())])

METRICS_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("server_id", T.IntegerType()),
    T.StructField("cpu_usage", T.DoubleType()), T.StructField("memory_usage", T.DoubleType()),
    T.StructField("request_count", T.IntegerType()), T.StructField("success_rate", T.DoubleType()),
    T.StructField("created_at", T.TimestampNTZType())])

# Older schema variant: column renames accepted at read time.
LEGACY_RENAMES = {"response_time": "response_time_ms", "timestamp": "created_at", "last_checked": "updated_at"}

# Columns that a table may lack, with what they hold then; any other missing
# column is an error.
OPTIONAL = {"weight": 1, "capacity": 1, "updated_at": None, "request_count": None, "success_rate": None}


def _time_window(df: DataFrame, ts: str, as_of: str | None, lookback_s: int | None) -> DataFrame:
    if as_of is None:
        return df
    hi = F.lit(as_of).cast("timestamp_ntz")
    cond = F.col(ts) <= hi
    if lookback_s is not None:
        lo = hi - F.expr(f"INTERVAL {int(lookback_s)} SECONDS")
        cond = cond & (F.col(ts) >= lo)
        if "dt" in df.columns:  # partition pruning on the day column
            cond = cond & (F.col("dt") >= F.to_date(lo)) & (F.col("dt") <= F.to_date(hi))
    return df.filter(cond)


def _adapt(df: DataFrame, schema: T.StructType) -> DataFrame:
    for old, new in LEGACY_RENAMES.items():
        if old in df.columns and new not in df.columns and new in schema.fieldNames():
            df = df.withColumnRenamed(old, new)
    missing = [f.name for f in schema.fields if f.name not in df.columns and f.name not in OPTIONAL]
    if missing:
        raise ValueError(f"table lacks columns {missing}; it has {df.columns}")

    def column(f: T.StructField):
        if f.name not in df.columns:
            return F.lit(OPTIONAL[f.name]).cast(f.dataType)
        c = F.col(f.name)
        if isinstance(df.schema[f.name].dataType, (T.FloatType, T.DoubleType)) and isinstance(f.dataType, T.LongType):
            c = F.round(c)          # the older schema has fractional milliseconds
        return c.cast(f.dataType)

    cols = [column(f).alias(f.name) for f in schema.fields]
    extra = [c for c in ("dt",) if c in df.columns]
    return df.select(*cols, *extra)


def read_requests(spark: SparkSession, path: str, as_of: str | None = None,
                  lookback_s: int | None = None) -> DataFrame:
    """Request log, optionally restricted to ``[as_of - lookback, as_of]``."""
    df = _adapt(spark.read.parquet(path), REQUESTS_SCHEMA)
    return _time_window(df, "created_at", as_of, lookback_s)


def read_requests_jdbc(spark: SparkSession, url: str, table: str = "requests", lower_id: int | None = None,
                       upper_id: int | None = None, partitions: int = 64, properties: dict | None = None,
                       as_of: str | None = None, lookback_s: int | None = None) -> DataFrame:
    """S1 from the relational store: parallel JDBC read split on the id
    column (``partitions`` range queries between the least and largest id, which
    are read first unless given); the time filter is pushed to the database by
    Spark's JDBC source."""
    if lower_id is None or upper_id is None:
        ids = spark.read.jdbc(url, f"(select min(id) as lo, max(id) as hi from {table}) as ids",
                              properties=properties or {}).first()
        lower_id = (ids["lo"] or 0) if lower_id is None else lower_id
        upper_id = (ids["hi"] or 0) + 1 if upper_id is None else upper_id
    df = spark.read.jdbc(url, table, column="id", lowerBound=lower_id, upperBound=upper_id,
                         numPartitions=partitions, properties=properties or {})
    return _time_window(_adapt(df, REQUESTS_SCHEMA), "created_at", as_of, lookback_s)


def read_servers(spark: SparkSession, path: str) -> DataFrame:
    """Server registry."""
    return _adapt(spark.read.parquet(path), SERVERS_SCHEMA)


def read_metrics(spark: SparkSession, path: str, as_of: str | None = None,
                 lookback_s: int | None = None) -> DataFrame:
    """S3: metric samples."""
    df = _adapt(spark.read.parquet(path), METRICS_SCHEMA)
    return _time_window(df, "created_at", as_of, lookback_s)


def append_partitioned(df: DataFrame, path: str, ts: str = "created_at", rows_per_file: int = 5_000_000) -> None:
    """Append rows to a day-partitioned Parquet table, sorted
    within files by (server_id, ts) so row-group statistics prune on both.
    Tasks are ranges of (day, server, time) of about ``rows_per_file`` rows, so
    a large day or server is written by many tasks."""
    out = df.withColumn("dt", F.to_date(F.col(ts)))
    sort_cols = [c for c in ("server_id", ts) if c in out.columns]
    n = max(1, -(-out.count() // int(rows_per_file)))
    out.repartitionByRange(n, "dt", *sort_cols).sortWithinPartitions("dt", *sort_cols) \
       .write.mode("append").partitionBy("dt").parquet(path)


append_requests = append_partitioned
append_metrics = append_partitioned


def retain(df: DataFrame, ts: str, horizon_s: int, as_of: str) -> DataFrame:
    """Keep rows younger than the retention horizon at ``as_of``
    (``ts > as_of - horizon``).  Dropping whole ``dt`` partitions with a
    dynamic-overwrite write is the table-level form."""
    lo = F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {int(horizon_s)} SECONDS")
    return df.filter(F.col(ts) > lo)


# Retention horizons of the log, metric and trace stores (seconds).
RETENTION_S = {"logs": 744 * 3600, "metrics": 15 * 86400, "traces": 48 * 3600}


# --- S12 / S13 -----------------------------------------------------------------

def save_scaler(spark: SparkSession, scaler: DataFrame, path: str) -> None:
    """One-row scaler (mean, scale arrays) as JSON."""
    scaler.coalesce(1).write.mode("overwrite").json(path)


def load_scaler(spark: SparkSession, path: str) -> dict:
    row = spark.read.schema("mean array<double>, scale array<double>").json(path).first()
    return {"mean": list(row["mean"]), "scale": list(row["scale"])}


def save_manifest(spark: SparkSession, features, path: str) -> None:
    """Feature manifest (ordered names) as one JSON row."""
    spark.createDataFrame([(json.dumps(list(features)),)], "features string") \
         .coalesce(1).write.mode("overwrite").json(path)


def load_manifest(spark: SparkSession, path: str) -> list[str]:
    return json.loads(spark.read.schema("features string").json(path).first()["features"])


def save_model(model: PipelineModel, path: str) -> None:
    """Persist the fitted scoring pipeline."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
