"""Window and time-series operators W1-W10.

Ordered state (previous / next row, running counts, recurrences) is
computed per (key, slice of the order) with a carry from the slices before, so
that no window is partitioned by a low-cardinality key alone.
"""

from __future__ import annotations

import math

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reqlens.functions.scalars import clamp, round1
from reqlens.operators.aggs import sliding
from reqlens.operators.sizing import materialize
from reqlens.operators.timebucket import (MINUTE_US, SLICE, bucketed, cut_in_order, floor_div, join_back,
                                          micros_ts, ordered_index, running_count, running_sum, slices_of, trailing_at)


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ---------------------------------------------------------------------------
# Previous / next row with a carry over slices
# ---------------------------------------------------------------------------

def neighbor(df: DataFrame, by: Sequence[str], order_us: str, tie: str, cols: Sequence[str],
             direction: str = "prev", bucket_us: int | None = None, name: str | None = None) -> DataFrame:
    """Adds ``name`` = struct of ``cols`` of the previous (``direction='prev'``)
    or next row per ``by`` in (``order_us``, ``tie``) order; null at the ends.

    Inside a slice this is ``lag`` / ``lead``; the first (last) row of a
    slice takes the last (first) row of the nearest earlier (later) slice of
    the key, found on the table of one edge row per key and slice."""
    by = list(by)
    name = name or ("prev" if direction == "prev" else "next")
    d, several = bucketed(df, by, order_us, tie, bucket_us)
    s = F.struct(*[F.col(c) for c in cols])
    key = F.struct(F.col(order_us), F.col(tie))
    w = Window.partitionBy(*by, "_b").orderBy(order_us, tie)
    if not several:
        return d.withColumn(name, (F.lag(s) if direction == "prev" else F.lead(s)).over(w)).drop("_b")
    if direction == "prev":
        edge = d.groupBy(*by, "_b").agg(F.max_by(s, key).alias("_edge"))
        bw = Window.partitionBy(*by).orderBy("_b") if by else Window.partitionBy().orderBy("_b")
        carry = edge.select(*by, "_b", F.lag("_edge").over(bw).alias("_carry"))
        within = F.lag(s).over(w)
    else:
        edge = d.groupBy(*by, "_b").agg(F.min_by(s, key).alias("_edge"))
        bw = Window.partitionBy(*by).orderBy("_b") if by else Window.partitionBy().orderBy("_b")
        carry = edge.select(*by, "_b", F.lead("_edge").over(bw).alias("_carry"))
        within = F.lead(s).over(w)
    # The struct of a real row is never null, so a null lag / lead marks the
    # slice's edge, where the carry applies.
    j = join_back(d, carry, by)
    j = j.withColumn(name, F.coalesce(within, F.col("_carry")))
    return j.drop("_b", "_carry")


# ---------------------------------------------------------------------------
# W1 exponential smoothing
# ---------------------------------------------------------------------------

#: Steps that are taken again one by one, at most.
_MOST_STEPS = 64
#: A carry that has decayed below e^-_GONE is nothing beside the row before it.
_GONE = 200.0


def _folded(d: DataFrame, by: Sequence[str], keep: float, most: int, rows: int) -> DataFrame:
    """Adds ``_s`` with ``s_i = keep * s_(i-1) + _x_i`` along ``_i`` = 0, 1, ... of
    each key of at most ``rows`` rows, by a scan of affine maps: the recurrence
    inside a chunk is a running sum of ``_x`` over powers of ``keep``, and the
    chunks' last values obey the same recurrence with ``keep ** chunk``.

    Chunks end before the powers underflow.  Once ``keep ** chunk`` is below
    e^-200, what enters a chunk is the last value of the chunk before, and the
    scan is done.  Otherwise a chunk has ``most`` rows or the power is still
    above e^-200, so the next level can take two rows and more: the levels
    shrink at least by half."""
    by = list(by)
    if keep <= 0.0:
        return d.withColumn("_s", F.col("_x"))
    decay = -math.log(keep)  # of one row
    n = max(2, min(most, int(2 * _GONE / decay) if decay > 0 else most))
    d = d.withColumn("_c", floor_div(F.col("_i"), n))
    k = (F.col("_i") - F.col("_c") * n).cast("double")
    w = Window.partitionBy(*by, "_c").orderBy("_i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.withColumn("_k", k).withColumn("_own", F.sum(F.col("_x") * F.pow(F.lit(keep), -F.col("_k"))).over(w)
                                         * F.pow(F.lit(keep), F.col("_k")))
    if rows <= n:
        return d.withColumn("_s", F.col("_own")).drop("_c", "_k", "_own")
    ends = d.groupBy(*by, "_c").agg(F.max_by("_own", "_i").alias("_x")).withColumnRenamed("_c", "_i")
    if n * decay > _GONE:
        into = ends.withColumn("_s", F.col("_x"))
    else:
        into = _folded(ends, by, keep ** n, most, -(-rows // n))
    carry = into.select(
        *[F.col(c).alias(f"_by{j}") for j, c in enumerate(by)], (F.col("_i") + 1).alias("_n"), F.col("_s").alias("_in"))
    on = [d[c].eqNullSafe(carry[f"_by{j}"]) for j, c in enumerate(by)] + [d["_c"] == carry["_n"]]
    s = F.col("_own") + F.coalesce(F.col("_in"), F.lit(0.0)) * F.pow(F.lit(keep), F.col("_k") + 1)
    return d.join(carry, on, "left").withColumn("_s", s).drop(
        "_c", "_k", "_own", "_in", "_n", *[f"_by{j}" for j in range(len(by))])


def recurrence(df: DataFrame, values: dict[str, str], by: Sequence[str], order_us: str, tie: str,
               alpha: float = 0.3, chunk: int = 65536) -> DataFrame:
    """Adds, for each ``name: column`` of ``values``, the smoothed value
    ``s <- (1 - alpha) * s + alpha * x``, seeded by the first row of the key.

    The whole history counts, whatever ``alpha``.  Rows are numbered per key
    (W8 index over slices) and cut into chunks of at most ``chunk`` rows, so every
    window is per (key, chunk); see :func:`_folded` for the carry.

    Sums over powers round otherwise than one step after the other, which shows
    where a value lies on the edge of a rounded digit.  Where ``alpha`` forgets
    fast, the last steps are therefore taken again one by one, from the value a
    few rows before: their rounding is then all there is."""
    by, keep = list(by), 1.0 - alpha
    d = materialize(ordered_index(df, order_us, tie, by=by, name="_i"))  # read twice below
    rows = (d.agg(F.max("_i")).first()[0] or 0) + 1
    for name, column in values.items():
        x = F.col(column).cast("double")
        d = d.withColumn("_x", F.when(F.col("_i") == 0, x).otherwise(x * alpha))
        d = _folded(d, by, keep, max(2, int(chunk)), rows).drop("_x").withColumnRenamed("_s", name)
    steps = math.ceil(16 / -math.log(keep)) if 0.0 < keep < 1.0 else _MOST_STEPS + 1
    if steps <= _MOST_STEPS:
        block = Window.partitionBy(*by, floor_div(F.col("_i"), 64 * steps)).orderBy("_i")
        for name, column in values.items():
            x = F.col(column).cast("double")
            recent = F.collect_list(x).over(block.rowsBetween(1 - steps, Window.currentRow))
            d = d.withColumn("_recent", recent).withColumn("_before", F.lag(name, steps).over(block))

            def on(xs: Column, start: Column) -> Column:
                return F.aggregate(xs, start, lambda s, v: s * F.lit(keep) + v * F.lit(alpha))

            d = d.withColumn(name, F.when(F.col("_i") + 1 == F.size("_recent"), on(F.slice("_recent", 2, steps), F.get("_recent", F.lit(0))))
                             .when(F.col("_before").isNotNull() & (F.size("_recent") == steps), on(F.col("_recent"), F.col("_before")))
                             .otherwise(F.col(name))).drop("_recent", "_before")
    return d.drop("_i")


def smooth(df: DataFrame, value: str, by: Sequence[str], order_us: str, tie: str,
           alpha: float = 0.3, chunk: int = 65536, name: str = "smoothed") -> DataFrame:
    """Exponential smoothing (:func:`recurrence`), then clamped to [0, 100]
    and rounded to one decimal (P8)."""
    out = recurrence(df, {"_smooth": value}, by, order_us, tie, alpha, chunk)
    return out.withColumn(name, round1(clamp(F.col("_smooth")))).drop("_smooth")


# ---------------------------------------------------------------------------
# W2 error-rate blend
# ---------------------------------------------------------------------------

def error_blend(requests: DataFrame, by: Sequence[str] = ("server_id",), order_us: str = "t_us",
                tie: str = "id", ok: str = "status", alpha: float = 0.1,
                bucket_us: int | None = None, name: str = "error_rate") -> DataFrame:
    """The blended error-rate gauge after each request.  Each failure
    sets ``e <- (1 - alpha) e + alpha``; successes leave it; e starts at 0.
    Closed form: ``1 - (1 - alpha)^k`` with k = failures so far."""
    d = running_count(requests, ~F.col(ok), by, order_us, tie, bucket_us, name="_k")
    return d.withColumn(name, 1 - F.pow(F.lit(1.0 - alpha), F.col("_k"))).drop("_k")


# ---------------------------------------------------------------------------
# W3 success rate at sample times
# ---------------------------------------------------------------------------

def success_rate_at(samples: DataFrame, requests: DataFrame, window_s: int = 300,
                    by: Sequence[str] = ("server_id",), sample_us: str = "t_us",
                    request_us: str = "t_us", ok: str = "status") -> DataFrame:
    """For each sample, the request success rate over the previous
    ``window_s`` seconds ``(t - w, t]``; 1.0 when no request."""
    ev = requests.select(*by, request_us, ok)
    out = trailing_at(samples, ev, by, sample_us, request_us, window_s * 1_000_000,
                      {"requests": F.lit(1), "successes": F.when(F.col(ok), 1).otherwise(0)})
    out = out.fillna(0, ["requests", "successes"])
    return out.withColumn("success_rate", F.when(F.col("requests") > 0, F.col("successes") / F.col("requests"))
                          .otherwise(F.lit(1.0)))


# ---------------------------------------------------------------------------
# W4 counter rate
# ---------------------------------------------------------------------------

def counter_rate(samples: DataFrame, by: Sequence[str], ts_us: str, value: str, window_s: int = 60,
                 tie: str | None = None) -> DataFrame:
    """Per key and window, the counter increase (reset-tolerant: a drop
    counts the new value as the increase) divided by the window length.
    Only consecutive samples inside the same window contribute.  Samples at
    one instant go by ``tie``, then by value."""
    by = list(by)
    W = int(window_s) * 1_000_000
    d = samples.withColumn("_b", floor_div(F.col(ts_us).cast("bigint"), W))
    w = Window.partitionBy(*by, "_b").orderBy(ts_us, *([tie] if tie else []), value)
    prev = F.lag(value).over(w)
    d = d.withColumn("_d", F.when(prev.isNull(), F.lit(None))
                     .when(F.col(value) < prev, F.col(value)).otherwise(F.col(value) - prev))
    g = d.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("samples"),
                                 F.coalesce(F.sum("_d"), F.lit(0.0)).alias("increase"))
    return g.select(*by, micros_ts(F.col("_b") * W).alias("window_start"), "samples", "increase",
                    (F.col("increase") / float(window_s)).alias("rate"))


# ---------------------------------------------------------------------------
# W6 gauge value at scrape ticks
# ---------------------------------------------------------------------------

def gauge_at_ticks(samples: DataFrame, by: Sequence[str], ts_us: str, value: str, tie: str,
                   step_s: int = 15, lookback_s: int = 300, bucket_us: int | None = None) -> DataFrame:
    """Value of the latest sample at or before each tick (multiples of
    ``step_s``) within ``lookback_s``.

    Each sample owns the ticks from its own time up to (not including) the
    next sample of the same key, and at most ``lookback_s`` after itself;
    the next sample comes from :func:`neighbor`.  Every tick is
    emitted exactly once, so no aggregation is needed and the work is
    proportional to the output."""
    by = list(by)
    step = int(step_s) * 1_000_000
    lb = int(lookback_s) * 1_000_000
    d = samples.select(*by, F.col(ts_us).cast("bigint").alias("_t"), F.col(tie).alias("_tie"), F.col(value).alias("_v"))
    d = neighbor(d, by, "_t", "_tie", ["_t"], "next", bucket_us)
    t = F.col("_t")
    own_end = F.least(F.coalesce(F.col("next._t"), t + (lb + 1)), t + (lb + 1))  # exclusive
    first = floor_div(t + (step - 1), step)
    last = floor_div(own_end - 1, step)
    ticks = F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
    g = d.select(*by, F.explode(ticks).alias("_k"), F.col("_v").alias(value), t.alias("sample_us"))
    return g.select(*by, micros_ts(F.col("_k") * step).alias("tick"), value, "sample_us")


# ---------------------------------------------------------------------------
# W7 health transitions, alive intervals, uptime
# ---------------------------------------------------------------------------

def probe_outcomes(probes: DataFrame, ok_status: int = 200) -> DataFrame:
    """One row per probe: alive if any attempt returned ``ok_status``; the
    decision time is the first successful attempt, else the last attempt."""
    ok = F.col("status_code") == ok_status
    g = probes.groupBy("server_id", "probe_id").agg(
        F.max(ok).alias("alive"),
        F.min(F.when(ok, F.col("t_us"))).alias("_first_ok"), F.max("t_us").alias("_last"))
    return g.select("server_id", F.col("probe_id").alias("seq"),
                    F.coalesce("_first_ok", "_last").alias("t_us"), "alive")


def health_transitions(outcomes: DataFrame, request_failures: DataFrame | None = None,
                       bucket_us: int | None = None) -> DataFrame:
    """Rows where a server's state changes (servers start alive).  A
    transport failure of a proxied request (``request_failures``: server_id,
    seq, t_us) also marks the server down."""
    o = outcomes.select("server_id", "seq", "t_us", "alive")
    if request_failures is not None:
        o = o.unionByName(request_failures.select("server_id", "seq", "t_us", F.lit(False).alias("alive")))
    d = neighbor(o, ["server_id"], "t_us", "seq", ["alive"], "prev", bucket_us)
    out = d.filter(F.col("alive") != F.coalesce(F.col("prev.alive"), F.lit(True))).drop("prev")
    return materialize(out)  # small (changes only) and read by further carry operators


def state_intervals(transitions: DataFrame, first_seen: DataFrame, end_us: int,
                    bucket_us: int | None = None) -> DataFrame:
    """``[start_us, end_us)`` per state run: an initial alive run from
    the server's first observation, then one run per transition until the
    next one (or ``end_us``)."""
    init = first_seen.select("server_id", F.lit(-1).cast("bigint").alias("seq"),
                             F.col("t_us").cast("bigint").alias("t_us"), F.lit(True).alias("alive"))
    t = transitions.select("server_id", F.col("seq").cast("bigint"), F.col("t_us").cast("bigint"), "alive")
    d = neighbor(init.unionByName(t), ["server_id"], "t_us", "seq", ["t_us"], "next", bucket_us)
    d = d.select("server_id", "alive", F.col("t_us").alias("start_us"),
                 F.coalesce(F.col("next.t_us"), F.lit(int(end_us))).alias("end_us"))
    return materialize(d.filter(F.col("end_us") > F.col("start_us")))


def uptime(intervals: DataFrame, start_us: int, end_us: int) -> DataFrame:
    """Share of ``[start_us, end_us)`` each server spent alive."""
    lo, hi = F.lit(int(start_us)), F.lit(int(end_us))
    ov = F.greatest(F.least(F.col("end_us"), hi) - F.greatest(F.col("start_us"), lo), F.lit(0))
    g = intervals.filter("alive").groupBy("server_id").agg(F.sum(ov).alias("alive_us"))
    return g.select("server_id", F.col("alive_us").cast("bigint").alias("alive_us"),
                    (F.col("alive_us") / float(end_us - start_us)).alias("uptime"))


# ---------------------------------------------------------------------------
# W9 circuit-breaker open intervals
# ---------------------------------------------------------------------------

def breaker_intervals(calls: DataFrame, reset_s: int = 30, ts_us: str = "t_us", tie: str = "id",
                      outcome: str = "outcome", bucket_us: int | None = None) -> DataFrame:
    """Open intervals of the model-call breaker.  A failed call opens it
    until the next call outcome or ``reset_s`` after the failure, whichever
    comes first; touching intervals merge.  Memo hits are not calls."""
    R = int(reset_s) * 1_000_000
    c = calls.filter(F.col(outcome).isin("ok", "error")).select(
        F.col(ts_us).cast("bigint").alias("t_us"), F.col(tie).alias("seq"), (F.col(outcome) == "error").alias("fail"))
    sliced = not bucket_us and slices_of(c) > 1
    if sliced:
        c = cut_in_order(c, [], "t_us", "seq")  # both neighbours go by the same slices
    c = materialize(neighbor(c, [], "t_us", "seq", ["t_us"], "next", bucket_us))
    c = neighbor(c, [], "t_us", "seq", ["t_us", "fail"], "prev", bucket_us)
    f = c.filter("fail").select(
        "t_us", "seq", *([SLICE] if sliced else []),
        F.least(F.coalesce(F.col("next.t_us"), F.col("t_us") + R), F.col("t_us") + R).alias("open_end"),
        (~(F.coalesce(F.col("prev.fail"), F.lit(False)) & (F.col("t_us") - F.col("prev.t_us") <= R))).alias("_start"))
    f = running_count(materialize(f), F.col("_start"), [], "t_us", "seq", bucket_us, name="_island")
    g = f.groupBy("_island").agg(F.min("t_us").alias("open_us"), F.max("open_end").alias("close_us"),
                                 F.count(F.lit(1)).alias("failures"))
    return g.select(micros_ts("open_us").alias("opened_at"), micros_ts("close_us").alias("closed_at"),
                    "open_us", "close_us", "failures")


# ---------------------------------------------------------------------------
# W10 step grid of look-back rates
# ---------------------------------------------------------------------------

def rate_grid(df: DataFrame, ts: str = "ts", by: Sequence[str] = (), width_s: int = 60,
              step_s: int = 15) -> DataFrame:
    """Requests per second over ``width_s`` look-back windows every
    ``step_s`` (sliding windows over panes of a step)."""
    g = sliding(df, by, ts, f"{int(width_s)} seconds", f"{int(step_s)} seconds",
                {"requests": F.count(F.lit(1))}, {"requests": F.sum("requests")})
    return g.select(*by, "window_start", "requests",
                    (F.col("requests") / float(width_s)).alias("per_second"))


__all__ = ["neighbor", "recurrence", "smooth", "error_blend", "success_rate_at", "counter_rate", "gauge_at_ticks",
           "probe_outcomes", "health_transitions", "state_intervals", "uptime", "breaker_intervals",
           "rate_grid", "ordered_index", "running_sum", "running_count", "MINUTE_US"]
