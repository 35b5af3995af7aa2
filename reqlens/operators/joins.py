"""Joins J1-J8 (J2, the as-of join, lives in ``timebucket``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reqlens.functions.scalars import with_host_port
from reqlens.operators.sizing import broadcast_if_small
from reqlens.operators.timebucket import floor_div


def join_servers(requests: DataFrame, servers: DataFrame,
                 cols=("name", "weight", "capacity")) -> DataFrame:
    """Requests x registry on server id (inner; orphans drop out)."""
    s = servers.select(F.col("id").alias("server_id"), *cols)
    return requests.join(broadcast_if_small(s), "server_id", "inner")


def drop_orphans(df: DataFrame, servers: DataFrame, key: str = "server_id") -> DataFrame:
    """Keep rows whose server exists (cascade semantics)."""
    ids = servers.select(F.col("id").alias(key))
    return df.join(broadcast_if_small(ids), key, "left_semi")


def orphans(df: DataFrame, servers: DataFrame, key: str = "server_id") -> DataFrame:
    """Rows pointing at a server that does not exist."""
    ids = servers.select(F.col("id").alias(key))
    return df.join(broadcast_if_small(ids), key, "left_anti")


def resolve_server_ids(urls: DataFrame, servers: DataFrame, url: str = "url", pos: str = "pos") -> DataFrame:
    """Configured URL -> registry id by (host, port); unresolved URLs get
    ``-(pos + 1)``.  Adds ``host``, ``port`` (default 80), ``valid`` (URL and
    port parse) and ``server_id``."""
    u = with_host_port(urls, url)
    u = u.withColumn("valid", F.col("host").isNotNull() & F.col("port").isNotNull())
    reg = servers.select(F.col("ip_address").alias("host"), F.col("port"), F.col("id").alias("_id"))
    j = u.join(broadcast_if_small(reg), ["host", "port"], "left")
    return j.withColumn("server_id", F.coalesce(F.col("_id"), -(F.col(pos) + 1)).cast("bigint")).drop("_id")


def weight_overrides(config_kv: DataFrame, key: str = "key", value: str = "value", pos: str = "pos") -> DataFrame:
    """``SERVER_WEIGHT_<host>_<port>=w`` -> (host_port, weight).  Every
    ``_`` of the suffix becomes ``:``; only integer w > 0 counts; for repeated
    keys the last one (highest ``pos``) wins."""
    prefix = "SERVER_WEIGHT_"
    kv = config_kv.filter(F.col(key).startswith(prefix))
    hp = F.replace(F.substr(F.col(key), F.lit(len(prefix) + 1)), F.lit("_"), F.lit(":"))
    w = F.when(F.col(value).rlike(r"^[+-]?[0-9]+$"), F.col(value).try_cast("bigint"))
    kv = kv.select(hp.alias("host_port"), w.alias("weight"), F.col(pos)).filter(F.col("weight") > 0)
    return kv.groupBy("host_port").agg(F.max_by("weight", pos).alias("weight"))


def with_weight_capacity(pool: DataFrame, servers: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Attach weight (default 1, non-positive -> 1) and capacity (default
    10) from the registry; weight overrides keyed by ``host:port`` win."""
    reg = servers.select(F.col("id").alias("server_id"), F.col("weight").alias("_w"),
                         F.col("capacity").alias("_c"))
    j = pool.join(broadcast_if_small(reg), "server_id", "left")
    weight = F.coalesce(F.col("_w"), F.lit(1))
    if overrides is not None:
        j = j.withColumn("_hp", F.concat_ws(":", F.col("host"), F.col("port").cast("string")))
        ov = overrides.select(F.col("host_port").alias("_hp"), F.col("weight").alias("_ow"))
        j = j.join(broadcast_if_small(ov), "_hp", "left")
        weight = F.coalesce(F.col("_ow"), weight)
    j = j.withColumn("weight", F.when(weight <= 0, 1).otherwise(weight).cast("int")) \
         .withColumn("capacity", F.coalesce(F.col("_c"), F.lit(10)).cast("int"))
    return j.drop(*[c for c in ("_w", "_c", "_hp", "_ow") if c in j.columns])


def pool_at(requests: DataFrame, runs: DataFrame, pool: DataFrame, end_us: int, ts_us: str = "t_us") -> DataFrame:
    """The healthy pool at each request's time, as ``members``
    (array<struct<pos, server_id, weight>> in pool order).

    ``runs`` are the W7 state runs of the pool servers.  The alive sets are
    piecewise constant, so they are first reduced to pool versions (one row
    per change) and each request looks up its version: one output row per
    request, no request x server pairs."""
    from reqlens.operators.routing import attach_pool, pool_versions
    return attach_pool(requests, pool_versions(pool, runs, end_us), arrival_us=ts_us)


def correlate_logs_spans(logs: DataFrame, spans: DataFrame, log_ts_us: str = "ts_us",
                         before_us: int = 60_000_000, after_us: int = 60_000_000) -> DataFrame:
    """Log line <-> span with the same trace id and the log time within
    ``[span start - before, span end + after]`` (``l.*`` and ``s.*``).

    An equi-join on (trace id, time bucket): a span goes to every bucket its
    range touches, a log line to its own, so each pair meets once and a trace
    with most of all logs and spans is spread over its time.  Both sides are
    shuffled: the planner guesses the size of the parsed lines by their columns'
    types, a small part of it, and would send all of them through the driver."""
    w = max(1, before_us + after_us)
    first, last = (floor_div(c, w) for c in (F.col("start_us") - before_us, F.col("end_us") + after_us))
    touched = F.when(last >= first, F.sequence(first, last))
    l = logs.withColumn("_bucket", floor_div(F.col(log_ts_us), w)).alias("l")
    s = spans.withColumn("_bucket", F.explode(touched)).alias("s")
    cond = ((F.col("l.trace_id") == F.col("s.trace_id")) & (F.col("l._bucket") == F.col("s._bucket"))
            & (F.col("l." + log_ts_us) >= F.col("s.start_us") - before_us)
            & (F.col("l." + log_ts_us) <= F.col("s.end_us") + after_us))
    return l.join(s.hint("merge"), cond, "inner").drop("_bucket")


def service_edges(spans: DataFrame) -> DataFrame:
    """Caller -> callee edges: child.parent_span_id = parent.span_id
    within a trace, different services; calls, failed calls and callee
    latency (ms)."""
    p = spans.select("trace_id", F.col("span_id").alias("_pid"), F.col("service").alias("client"))
    c = spans.filter(F.col("parent_span_id").isNotNull()).select(
        "trace_id", F.col("parent_span_id").alias("_pid"), F.col("service").alias("server"),
        "failed", ((F.col("end_us") - F.col("start_us")) / 1000.0).alias("_ms"))
    e = c.join(p, ["trace_id", "_pid"], "inner").filter(F.col("client") != F.col("server"))
    return e.groupBy("client", "server").agg(
        F.count(F.lit(1)).alias("calls"),
        F.count_if("failed").cast("bigint").alias("failed_calls"),
        F.avg("_ms").alias("avg_latency_ms"),
        F.max("_ms").alias("max_latency_ms"))
