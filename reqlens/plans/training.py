"""M2: training-set build = J1 + J2 + P3 + A4 + A5."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reqlens.functions.scalars import lookback
from reqlens.operators.aggs import server_features
from reqlens.operators.joins import join_servers
from reqlens.operators.timebucket import asof_left, ts_micros

ASOF_TOLERANCE_US = 120_000_000  # fixed value: metric look-back of the training query, 2 minutes
METRIC_COLS = ["cpu_usage", "memory_usage", "request_count"]


def requests_with_metrics(requests: DataFrame, servers: DataFrame, metrics: DataFrame,
                          as_of: str, days: float = 7, seconds: int | None = None) -> DataFrame:
    """Requests in the look-back window (P3), joined to their server (J1) and
    to the latest metric sample of that server taken at most 2 minutes
    before the request (J2, unmatched requests kept with null metrics)."""
    r = lookback(requests, "created_at", as_of, days=days, seconds=seconds)
    r = join_servers(r, servers, cols=("capacity", "weight")).withColumn("_us", ts_micros("created_at"))
    m = metrics.select("id", "server_id", *METRIC_COLS, ts_micros("created_at").alias("_us"))
    # buckets = the tolerance, per server: ~1.5 GB for a server holding a
    # third of 100 TB over a month; asof_left takes a narrower width if needed
    out = asof_left(r, m, ["server_id"], "_us", "_us", ASOF_TOLERANCE_US, METRIC_COLS, tie="id")
    return out.drop("_us")


def training_set(requests: DataFrame, servers: DataFrame, metrics: DataFrame, as_of: str,
                 days: float = 7, bucket: str | None = None) -> DataFrame:
    """One row per server (or per server x ``bucket``): the six features and
    the composite target."""
    j = requests_with_metrics(requests, servers, metrics, as_of, days)
    if bucket:
        j = j.withColumn(bucket, F.date_trunc(bucket, "created_at").cast("timestamp_ntz"))
    # Features and target in one aggregation: one pass over the joined rows.
    return server_features(j, bucket=bucket or None, with_target=True)
