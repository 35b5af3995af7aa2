"""Dashboard panels Q1-Q11 as DataFrame compositions over a time range
``[start_us, end_us)``.  Tick grids are generated per pool server with
``explode(sequence(...))`` (rows = servers x ticks, independent of the
request volume)."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reqlens.functions.scalars import breaker_label, select_servers
from reqlens.operators import aggs as A
from reqlens.operators import series as S
from reqlens.operators.timebucket import inflight, interval_lookup, micros_ts


def _in_range(df: DataFrame, us: str, start_us: int, end_us: int) -> DataFrame:
    return df.filter((F.col(us) >= start_us) & (F.col(us) < end_us))


def _scan(df: DataFrame, start_us: int, end_us: int, width_s: int) -> DataFrame:
    """Rows that a look-back of ``width_s`` at some time in the range can see."""
    return _in_range(df, "t_us", start_us - width_s * 1_000_000, end_us)


def _evaluated(df: DataFrame, start_us: int, end_us: int, width_s: int) -> DataFrame:
    """Windows whose end, the time they are evaluated at, lies in the range."""
    at = F.unix_micros(F.col("window_start").cast("timestamp")) + width_s * 1_000_000
    return df.filter((at >= start_us) & (at < end_us))


def tick_grid(keys: DataFrame, start_us: int, end_us: int, step_s: int = 15) -> DataFrame:
    """Ticks ``k * step`` in ``[start, end)`` for every key row."""
    step = int(step_s) * 1_000_000
    first, last = -(-start_us // step), (end_us - 1) // step
    g = keys.select("*", F.explode(F.sequence(F.lit(first).cast("bigint"), F.lit(last).cast("bigint"))).alias("_k"))
    return g.withColumn("tick_us", F.col("_k") * F.lit(step)).drop("_k")


def panel_requests_per_s(log: DataFrame, start_us: int, end_us: int, by: Sequence[str] = (),
                         server_ids=None) -> DataFrame:
    """Q1: requests per second, 1-minute look-back every 15 s."""
    d = select_servers(_scan(log, start_us, end_us, 60), server_ids)
    return _evaluated(S.rate_grid(d, "ts", by), start_us, end_us, 60)


def panel_duration_p95(log: DataFrame, start_us: int, end_us: int, q: float = 0.95, server_ids=None) -> DataFrame:
    """Q2: p95 request duration by server from the duration histogram over
    1-minute windows every 15 s (A7 -> A16)."""
    d = select_servers(_scan(log, start_us, end_us, 60), server_ids)
    h = A.latency_histogram(d, "duration_s", ["server_id"], A.REQUEST_DURATION_EDGES, ("ts", "1 minute", "15 seconds"))
    return A.histogram_quantile(_evaluated(h, start_us, end_us, 60), q, ["server_id", "window_start"])


def panel_error_rate(log: DataFrame, start_us: int, end_us: int, by: Sequence[str] = ("server_id",),
                     server_ids=None) -> DataFrame:
    """Q3: 5xx percentage (P7 + A10)."""
    d = select_servers(_scan(log, start_us, end_us, 60), server_ids)
    return _evaluated(A.error_pct(d, by=by), start_us, end_us, 60)


def panel_active_connections(intervals: DataFrame, pool: DataFrame, start_us: int, end_us: int,
                             step_s: int = 15, server_ids=None) -> DataFrame:
    """Q4: requests in flight per server at each tick (W5 at grid points)."""
    p = select_servers(pool.select("server_id"), server_ids)
    grid = tick_grid(p, start_us, end_us, step_s)
    met = intervals.filter((F.col("end_us") > start_us) & (F.col("start_us") < end_us))
    out = inflight(met, ["server_id"], "start_us", "end_us", points=grid, point_us="tick_us",
                   name="active_connections")
    return out.select("server_id", micros_ts("tick_us").alias("tick"), "active_connections")


def panel_gauge(metrics: DataFrame, value: str, start_us: int, end_us: int, server_ids=None,
                step_s: int = 15, lookback_s: int = 300) -> DataFrame:
    """Q5 / Q6: cpu or memory gauge per server at each tick (W6 + P15)."""
    d = select_servers(_scan(metrics, start_us, end_us, lookback_s), server_ids)
    g = S.gauge_at_ticks(d, ["server_id"], "t_us", value, "id", step_s, lookback_s)
    g = g.withColumn("_t", F.unix_micros(F.col("tick").cast("timestamp")))
    return _in_range(g, "_t", start_us, end_us).select("server_id", "tick", value)


def panel_model_predictions_per_s(calls: DataFrame, start_us: int, end_us: int) -> DataFrame:
    """Q7: successful model predictions per second (A14 + W10)."""
    ok = _scan(calls, start_us, end_us, 60).filter(F.col("outcome") == "ok")
    return _evaluated(S.rate_grid(ok, "ts"), start_us, end_us, 60)


def panel_breaker_state(breaker: DataFrame, start_us: int, end_us: int, step_s: int = 15) -> DataFrame:
    """Q8: breaker state per tick: 1 / OPEN inside an open interval (W9),
    else 0 / CLOSED (P14); ticks are looked up in the merged intervals."""
    spark = breaker.sparkSession
    step = int(step_s) * 1_000_000
    first, last = -(-start_us // step), (end_us - 1) // step
    ticks = spark.range(first, last + 1).select((F.col("id") * step).alias("tick_us"))
    iv = breaker.select(F.col("open_us").alias("start_us"), F.col("close_us").alias("end_us"))
    j = interval_lookup(ticks, iv, [], "tick_us", name="_open")
    state = F.when(F.col("_open").isNotNull(), 1).otherwise(0)
    return j.select(micros_ts("tick_us").alias("tick"), state.alias("state"), breaker_label(state).alias("label"))


def panel_memo_hit_pct(calls: DataFrame, start_us: int, end_us: int) -> DataFrame:
    """Q9: memo hit percentage over 5-minute windows every 15 s."""
    d = _scan(calls, start_us, end_us, 300)
    o = F.col("outcome")
    g = A.sliding(d, [], "ts", "5 minutes", "15 seconds",
                  {"hits": F.count_if(o == "hit"), "misses": F.count_if(o.isin("ok", "error"))},
                  {"hits": F.sum("hits"), "misses": F.sum("misses")})
    tot = F.col("hits") + F.col("misses")
    out = g.select("window_start",
                   F.when(tot > 0, F.col("hits") * 100.0 / tot).alias("hit_pct"))
    return _evaluated(out, start_us, end_us, 300)


def panel_model_latency_p95_ms(calls: DataFrame, start_us: int, end_us: int, q: float = 0.95) -> DataFrame:
    """Q10: p95 model latency in ms from the inference histogram over
    5-minute windows every 15 s (A15 -> A16, x 1000)."""
    d = _scan(calls, start_us, end_us, 300).filter(F.col("outcome") == "ok")
    h = A.latency_histogram(d, "latency_s", [], A.MODEL_LATENCY_EDGES, ("ts", "5 minutes", "15 seconds"))
    out = A.histogram_quantile(_evaluated(h, start_us, end_us, 300), q, ["window_start"])
    return out.select("window_start", (F.col("quantile_value") * 1000).alias("p95_ms"))


def panel_logs(lines: DataFrame, start_us: int, end_us: int, service: str = "load-balancer") -> DataFrame:
    """Q11: every parsed log line of the service in the range."""
    return _in_range(lines, "t_us", start_us, end_us).filter(F.col("service") == service)
