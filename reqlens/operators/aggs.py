"""Aggregations A1-A19.

The aggregations over request-sized data are single ``groupBy`` plans with
partial (map-side) aggregation, so a hot server costs one partial aggregate
per input partition, not one giant task; joins and windows here only touch
the aggregated (per-server / per-bucket) rows.  Exact percentiles keep a
value -> count map per group (bounded by the number of distinct latencies,
which are integer milliseconds in the request log)."""

from __future__ import annotations

import math
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reqlens.functions.aggs import count_where, exact_percentile
from reqlens.functions.scalars import fill_and_clip, is_server_error
from reqlens.operators.sizing import broadcast_if_small

# Histogram bucket edges (seconds) of the request-duration and
# model-inference histograms, and the summary objectives (quantile: error).
REQUEST_DURATION_EDGES = [0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1, 2.5, 5]
MODEL_LATENCY_EDGES = [0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25]
SUMMARY_OBJECTIVES = {0.5: 0.05, 0.9: 0.01, 0.95: 0.005, 0.99: 0.001}

FEATURES = ["cpu_usage", "memory_usage", "active_conns", "error_rate", "response_p95", "capacity"]


def le_label(edge: float) -> str:
    """Bucket label as the metrics exposition writes it ('0.005', '1', '+Inf')."""
    if math.isinf(edge):
        return "+Inf"
    return f"{edge:g}"


def _ts_between(ts: str, lo: Column, hi: Column, lo_strict=True) -> Column:
    c = F.col(ts)
    return ((c > lo) if lo_strict else (c >= lo)) & (c <= hi)


# --- sliding windows -----------------------------------------------------------

def sliding(df: DataFrame, by: Sequence[str], ts: str, width: str, slide: str, panes: dict[str, Column],
            merge: dict[str, Column]) -> DataFrame:
    """Aggregates over windows of ``width`` every ``slide`` (a part of the width),
    as ``by, window_start`` and the names of ``merge``; windows without rows are
    left out.

    Every row is aggregated once, into the pane of one slide (``panes``: name ->
    aggregate of rows).  Only the panes, one row per key and slide, go to the
    windows that hold them (``merge``: name -> aggregate of panes)."""
    p = df.groupBy(*by, F.window(ts, slide).alias("_pane")).agg(*[c.alias(n) for n, c in panes.items()])
    starts = F.expr(f"sequence(_pane.start - interval {width} + interval {slide}, _pane.start, interval {slide})")
    w = p.select(*by, F.explode(starts).alias("window_start"), *panes)
    return w.groupBy(*by, "window_start").agg(*[c.alias(n) for n, c in merge.items()])


# --- A1 -----------------------------------------------------------------------

def success_rate(requests: DataFrame, servers: DataFrame, as_of: str, window_s: int = 300) -> DataFrame:
    """A1: success rate per registered server over ``(as_of - window, as_of]``;
    1.0 for a server without requests in the window."""
    hi = F.lit(as_of).cast("timestamp_ntz")
    lo = hi - F.expr(f"INTERVAL {int(window_s)} SECONDS")
    r = requests.filter(_ts_between("created_at", lo, hi)).groupBy("server_id").agg(
        F.count(F.lit(1)).alias("total"), count_where(F.col("status")).alias("successes"))
    reg = servers.select(F.col("id").alias("server_id"))
    j = reg.join(r, "server_id", "left")
    return j.select(
        "server_id",
        F.coalesce("total", F.lit(0)).cast("bigint").alias("total"),
        F.coalesce("successes", F.lit(0)).cast("bigint").alias("successes"),
        F.when(F.col("total") > 0, F.col("successes") / F.col("total")).otherwise(F.lit(1.0)).alias("success_rate"))


# --- A3 -----------------------------------------------------------------------

def rollup_1m(metrics: DataFrame, width: str = "1 minute", ts: str = "created_at") -> DataFrame:
    """A3: per (server, minute) averages of cpu / memory / success rate and
    summed request count (the continuous aggregate of the metric store)."""
    g = metrics.groupBy("server_id", F.window(ts, width).alias("w")).agg(
        F.avg("cpu_usage").alias("avg_cpu"), F.avg("memory_usage").alias("avg_memory"),
        F.sum("request_count").cast("bigint").alias("total_requests"),
        F.avg("success_rate").alias("avg_success_rate"))
    return g.select("server_id", F.col("w.start").alias("bucket"), "avg_cpu", "avg_memory",
                    "total_requests", "avg_success_rate")


# --- A4 / A5 ------------------------------------------------------------------

def target_expr(w_latency: float = 0.70, w_cpu: float = 0.20, w_error: float = 0.10) -> Column:
    """A5 per-row score ``w_latency*rt + w_cpu*cpu + w_error*error``."""
    return (F.col("response_time_ms") * w_latency + F.col("cpu_usage") * w_cpu
            + F.when(F.col("status"), 0.0).otherwise(1.0) * w_error)


def server_features(joined: DataFrame, bucket: str | None = None, with_target: bool = False) -> DataFrame:
    """A4: the six model features per server (optionally per time bucket).

    error_rate = errors / active_conns (0 -> 1) keeps the training job's
    formula; error_rate_true = errors / rows is the real rate.  Nulls become 0
    and negatives are clipped (P16).  ``with_target`` adds the A5 target in
    the same aggregation (one pass over the joined rows)."""
    keys = ["server_id"] + ([bucket] if bucket else [])
    extra = [F.avg(target_expr()).alias("target")] if with_target else []
    g = joined.groupBy(*keys).agg(
        *extra,
        F.avg("cpu_usage").alias("cpu_usage"),
        F.avg("memory_usage").alias("memory_usage"),
        F.coalesce(F.sum("request_count"), F.lit(0)).cast("bigint").alias("active_conns"),
        count_where(~F.col("status")).alias("_errors"),
        F.count(F.lit(1)).alias("_rows"),
        exact_percentile("response_time_ms", 0.95).alias("response_p95"),
        F.first("capacity", ignorenulls=True).alias("capacity"))
    g = g.withColumn("error_rate", F.col("_errors") / F.when(F.col("active_conns") == 0, 1)
                     .otherwise(F.col("active_conns")))
    g = g.withColumn("error_rate_true", F.col("_errors") / F.col("_rows"))
    g = fill_and_clip(g, FEATURES)
    return g.select(*keys, *FEATURES, "error_rate_true", *(["target"] if with_target else []))


def composite_target(joined: DataFrame, w_latency: float = 0.70, w_cpu: float = 0.20,
                     w_error: float = 0.10, bucket: str | None = None) -> DataFrame:
    """A5: mean of ``w_latency*rt + w_cpu*cpu + w_error*error`` per server;
    rows without a cpu sample do not contribute."""
    keys = ["server_id"] + ([bucket] if bucket else [])
    return joined.groupBy(*keys).agg(F.avg(target_expr(w_latency, w_cpu, w_error)).alias("target"))


# --- A6 / A7 / A15 / A19 ------------------------------------------------------

def requests_total(log: DataFrame, by: Sequence[str] = ("method", "path", "status_code", "server_id")) -> DataFrame:
    """Request counter by labels."""
    return log.groupBy(*by).agg(F.count(F.lit(1)).alias("requests"))


def latency_histogram(df: DataFrame, value: str, by: Sequence[str], edges: Sequence[float],
                      sliding_by: tuple[str, str, str] | None = None) -> DataFrame:
    """Cumulative histogram in long form: one row per (group, le) with
    ``bucket_count`` = observations <= le, plus the group's ``observations``
    and ``value_sum``.  One pass: every edge is a conditional count.  With
    ``sliding_by`` (time column, width, slide) also per ``window_start``."""
    by = list(by)
    aggs = {f"_le{i}": count_where(F.col(value) <= F.lit(float(e))) for i, e in enumerate(edges)}
    aggs |= {"observations": F.count(F.lit(1)), "value_sum": F.sum(F.col(value).cast("double"))}
    if sliding_by:
        g = sliding(df, by, *sliding_by, aggs, {n: F.sum(n) for n in aggs})
        by = [*by, "window_start"]
    else:
        g = df.groupBy(*by).agg(*[c.alias(n) for n, c in aggs.items()])
    labels = [le_label(float(e)) for e in edges] + ["+Inf"]
    cols = [f"_le{i}" for i in range(len(edges))] + ["observations"]
    pairs = ", ".join(f"'{lab}', {c}" for lab, c in zip(labels, cols))
    long = g.select(*by, "observations", "value_sum",
                    F.expr(f"stack({len(labels)}, {pairs}) as (le, bucket_count)"))
    return long.select(*by, "le", F.col("bucket_count").cast("bigint").alias("bucket_count"),
                       "observations", "value_sum")


def model_latency_histogram(calls: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Inference-latency histogram of successful model calls."""
    ok = calls.filter(F.col("outcome") == "ok")
    return latency_histogram(ok, "latency_s", by, MODEL_LATENCY_EDGES)


def span_metrics(spans: DataFrame, edges: Sequence[float] = REQUEST_DURATION_EDGES) -> DataFrame:
    """Span count, failures and duration histogram by service, span
    name and status."""
    s = spans.withColumn("duration_s", (F.col("end_us") - F.col("start_us")) / 1e6) \
             .withColumn("status", F.when(F.col("failed"), "error").otherwise("ok"))
    return latency_histogram(s, "duration_s", ["service", "name", "status"], edges)


# --- A8 / A9 ------------------------------------------------------------------

def quantile_summary(df: DataFrame, value: str, by: Sequence[str], ts: str,
                     objectives: dict | None = None, width: str = "5 minutes",
                     slide: str = "1 minute") -> DataFrame:
    """Approximate quantiles over sliding windows, each with the rank error
    of its objective at most (column ``max_error``).

    A row enters one KLL sketch, that of its key and slide; a window merges the
    sketches of its panes.  The sketches are as large as the tightest objective
    needs, and exact while a window has no more values than that.  Null values
    are no observations; the quantile is the smallest value whose rank reaches
    it."""
    objectives = objectives or SUMMARY_OBJECTIVES
    qs = sorted(objectives)
    k = kll_size(min(objectives.values()))
    rows = df.filter(F.col(value).isNotNull()).withColumn("_x", F.col(value).cast("double"))
    g = sliding(rows, by, ts, width, slide,
                {"_sketch": F.kll_sketch_agg_double("_x", k), "observations": F.count(F.lit(1))},
                {"_sketch": F.kll_merge_agg_double("_sketch", k), "observations": F.sum("observations")})
    table = F.array(*[F.struct(F.lit(q).alias("quantile"), F.lit(float(objectives[q])).alias("max_error")) for q in qs])
    found = F.kll_sketch_get_quantile_double("_sketch", F.array(*[F.lit(q) for q in qs]))
    return g.select(*by, "window_start", "observations", F.explode(F.arrays_zip(table.alias("o"), found.alias("value"))).alias("_q")).select(
        *by, "window_start", "observations", "_q.o.quantile", "_q.o.max_error", "_q.value")


def kll_size(error: float) -> int:
    """The size parameter at which a KLL sketch has a normalised rank error of
    ``error`` (with a probability of 99 %): the published fit 2.296 / k^0.9021,
    within the range of the parameter, 8 to 65535."""
    return int(min(65535, max(8, math.ceil((2.296 / error) ** (1 / 0.9021)))))


def summary_rank_errors(summary: DataFrame, df: DataFrame, value: str, by: Sequence[str], ts: str,
                        width: str = "5 minutes", slide: str = "1 minute") -> DataFrame:
    """Holds a summary (:func:`quantile_summary`) against its rows: per key,
    window and quantile whether the value's ranks come within ``max_error`` of
    the quantile (``within``).  Rows are counted per value and slide first."""
    by = list(by)
    counts = sliding(df.filter(F.col(value).isNotNull()).withColumn("_x", F.col(value).cast("double")), [*by, "_x"], ts,
                     width, slide, {"_n": F.count(F.lit(1))}, {"_n": F.sum("_n")})
    j = summary.join(counts, [*by, "window_start"])
    g = j.groupBy(*by, "window_start", "quantile", "observations", "max_error").agg(
        F.sum(F.when(F.col("_x") < F.col("value"), F.col("_n")).otherwise(0)).alias("_below"),
        F.sum(F.when(F.col("_x") <= F.col("value"), F.col("_n")).otherwise(0)).alias("_upto"))
    lo, hi = (F.col("quantile") + s * F.col("max_error") for s in (-1, 1))
    within = (F.col("_below") / F.col("observations") <= hi) & (F.col("_upto") / F.col("observations") >= lo)
    return g.select(*by, "window_start", "quantile", "observations", within.alias("within"))


def latency_percentiles(df: DataFrame, value: str, by: Sequence[str],
                        qs: Sequence[float] = (0.5, 0.9, 0.95, 0.99), slices: int = 64) -> DataFrame:
    """Exact percentiles (linear interpolation) per group; nulls do not
    count, a group of nulls only has no row.

    Rows are first counted per value (map-side combine).  A group's values are
    then dealt in ``slices`` by approximate quantiles, and the slices' running
    totals give every value its ranks, so no task holds a group."""
    by = list(by)
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_v")).agg(
        F.count(F.lit(1)).alias("_n"))
    cuts = [k / slices for k in range(1, slices)]
    edges = counts.groupBy(*by).agg(F.percentile_approx("_v", cuts, 1000).alias("_edges"), F.sum("_n").alias("_all"))
    edges = edges.select(*[F.col(c).alias(f"_by{j}") for j, c in enumerate(by)], "_edges", "_all")

    def on(left: DataFrame, right: DataFrame):
        cond = F.lit(True)
        for j, c in enumerate(by):
            cond = cond & left[c].eqNullSafe(right[f"_by{j}"])
        return cond

    dealt = counts.join(edges, on(counts, edges)).drop(*[f"_by{j}" for j in range(len(by))]).withColumn(
        "_s", F.size(F.filter("_edges", lambda e: e < F.col("_v")))).drop("_edges")
    before = Window.partitionBy(*by).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy(*by, "_s").agg(F.sum("_n").alias("_t")).select(
        *[F.col(c).alias(f"_by{j}") for j, c in enumerate(by)], F.col("_s").alias("_s2"),
        F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_first"))
    inside = Window.partitionBy(*by, "_s").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = dealt.withColumn("_to", F.sum("_n").over(inside))
    ranked = ranked.join(totals, on(ranked, totals) & (ranked["_s"] == totals["_s2"])).withColumn(
        "_to", F.col("_to") + F.col("_first")).withColumn("_from", F.col("_to") - F.col("_n"))

    def at(rank):
        return F.max(F.when((F.col("_from") <= rank) & (rank < F.col("_to")), F.col("_v")))

    picks = []
    for k, q in enumerate(qs):
        place = F.lit(float(q)) * (F.col("_all") - 1)
        picks += [at(F.floor(place)).alias(f"_lo{k}"), at(F.ceil(place)).alias(f"_hi{k}"),
                  F.max(place - F.floor(place)).alias(f"_w{k}")]
    g = ranked.groupBy(*by).agg(*picks)
    return g.select(*by, *[(F.col(f"_lo{k}") + (F.col(f"_hi{k}") - F.col(f"_lo{k}")) * F.col(f"_w{k}")).alias(
        f"p{int(round(q * 100))}") for k, q in enumerate(qs)])


# --- A10 / A14 / A18 ----------------------------------------------------------

def error_pct(log: DataFrame, width: str = "1 minute", slide: str = "15 seconds",
              by: Sequence[str] = (), ts: str = "ts") -> DataFrame:
    """A10: 100 * 5xx / all per sliding window (null when no requests)."""
    g = sliding(log, by, ts, width, slide,
                {"requests": F.count(F.lit(1)), "errors": count_where(is_server_error("status_code"))},
                {"requests": F.sum("requests"), "errors": F.sum("errors")})
    return g.select(*by, "window_start", "requests", "errors",
                    F.when(F.col("requests") > 0, F.col("errors") * 100.0 / F.col("requests")).alias("error_pct"))


def model_counters(calls: DataFrame, width: str = "5 minutes", ts: str = "ts") -> DataFrame:
    """Predictions (successful calls), errors, memo hits and misses per
    window, and the hit percentage."""
    o = F.col("outcome")
    g = calls.groupBy(F.window(ts, width).alias("w")).agg(
        count_where(o == "ok").alias("predictions"), count_where(o == "error").alias("errors"),
        count_where(o == "hit").alias("hits"), count_where(o.isin("ok", "error")).alias("misses"))
    tot = F.col("hits") + F.col("misses")
    return g.select(F.col("w.start").alias("window_start"), "predictions", "errors", "hits", "misses",
                    F.when(tot > 0, F.col("hits") * 100.0 / tot).alias("hit_pct"))


def rate_breaches(log: DataFrame, limit: int = 100, width: str = "1 second",
                  client: str = "remote_ip", ts: str = "ts") -> DataFrame:
    """(client, window) pairs with more than ``limit`` requests."""
    g = log.groupBy(client, F.window(ts, width).alias("w")).agg(F.count(F.lit(1)).alias("requests"))
    return g.filter(F.col("requests") > limit).select(client, F.col("w.start").alias("window_start"), "requests")


# --- A11 / A12 / A13 / A16 / A17 ----------------------------------------------

def readiness(inventory: DataFrame) -> DataFrame:
    """Total, healthy and ready / not ready over a server inventory."""
    g = inventory.agg(F.count(F.lit(1)).alias("total"), count_where(F.col("alive")).alias("healthy"))
    return g.select(F.col("total").cast("bigint").alias("total"), "healthy",
                    F.when(F.col("healthy") > 0, "ready").otherwise("not ready").alias("status"))


def inventory(pool: DataFrame, health: DataFrame, intervals: DataFrame, as_of_us: int) -> DataFrame:
    """Per pool server (id, url, weight, capacity): alive = latest health
    state at ``as_of`` (servers start alive) and active connections = request
    intervals open at ``as_of``."""
    h = health.filter(F.col("t_us") <= as_of_us).groupBy("server_id").agg(
        F.max_by("alive", F.struct("t_us", "seq")).alias("_alive"))
    c = intervals.filter((F.col("start_us") <= as_of_us) & (F.col("end_us") > as_of_us)) \
                 .groupBy("server_id").agg(F.count(F.lit(1)).alias("_conns"))
    j = pool.join(broadcast_if_small(h), "server_id", "left").join(broadcast_if_small(c), "server_id", "left")
    return j.select("server_id", "url", F.coalesce("_alive", F.lit(True)).alias("alive"), "weight", "capacity",
                    F.coalesce("_conns", F.lit(0)).cast("bigint").alias("active_connections"))


def traffic_share(requests: DataFrame, pool: DataFrame, server: str = "server_id") -> DataFrame:
    """Per pool server, request count, share of all requests, expected
    share from the weights and observed/expected ratio."""
    n = requests.groupBy(server).agg(F.count(F.lit(1)).alias("requests"))
    j = pool.select(server, "weight").join(n, server, "left").fillna(0, ["requests"])
    allw = Window.partitionBy()  # one row per pool server: tiny
    j = j.withColumn("share", F.col("requests") / F.sum("requests").over(allw)) \
         .withColumn("expected_share", F.col("weight") / F.sum("weight").over(allw))
    return j.select(server, F.col("requests").cast("bigint").alias("requests"), "weight", "share", "expected_share",
                    (F.col("share") / F.col("expected_share")).alias("weight_ratio"))


def histogram_quantile(hist: DataFrame, q: float, by: Sequence[str], le: str = "le",
                       count: str = "bucket_count") -> DataFrame:
    """Quantile estimate from a cumulative histogram (long form, ``le``
    labels incl. '+Inf'), interpolating linearly inside the bucket that holds
    rank ``q * total``.  The first bucket starts at 0; a rank in the +Inf
    bucket returns the highest finite edge; an empty histogram gives null."""
    by = list(by)
    h = hist.select(*by, F.col(le).alias("le"), F.col(count).cast("double").alias("cnt"))
    h = h.withColumn("le_v", F.when(F.col("le") == "+Inf", F.lit(float("inf"))).otherwise(F.col("le").cast("double")))
    # Small per-group windows (a dozen buckets per group).
    w = Window.partitionBy(*by).orderBy("le_v")
    h = h.withColumn("prev_cnt", F.coalesce(F.lag("cnt").over(w), F.lit(0.0))) \
         .withColumn("prev_le", F.coalesce(F.lag("le_v").over(w), F.lit(0.0))) \
         .withColumn("total", F.max("cnt").over(Window.partitionBy(*by))) \
         .withColumn("max_finite", F.max(F.when(F.col("le") != "+Inf", F.col("le_v"))).over(Window.partitionBy(*by)))
    h = h.withColumn("rank", F.lit(float(q)) * F.col("total"))
    pick = h.filter(F.col("cnt") >= F.col("rank")).groupBy(*by).agg(
        F.min_by(F.struct("le", "le_v", "cnt", "prev_cnt", "prev_le", "total", "rank", "max_finite"),
                 F.col("le_v")).alias("b"))
    b = lambda c: F.col("b." + c)
    inside = b("prev_le") + (b("le_v") - b("prev_le")) * (b("rank") - b("prev_cnt")) / (b("cnt") - b("prev_cnt"))
    val = (F.when(b("total") == 0, F.lit(None).cast("double"))
           .when(b("le") == "+Inf", b("max_finite"))
           .when((b("prev_cnt") == 0) & (b("prev_le") == 0) & (b("le_v") <= 0), b("le_v"))
           .otherwise(inside))
    return pick.select(*by, val.alias("quantile_value"))


def label_values(df: DataFrame, label: str) -> DataFrame:
    """Distinct values of a label."""
    return df.select(label).distinct()
