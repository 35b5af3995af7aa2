"""Ordered operators keyed by (entity, time bucket).

A handful of servers can carry billions of requests, so a window partitioned
by server alone gives one task per server however large the cluster.  Every
ordered operator here partitions by ``by + [time bucket]`` instead and makes
the bucket self-sufficient:

* bounded look-back (as-of join): rows of the looked-up side are replicated
  into every bucket whose rows may look back at them;
* unbounded look-back (running counts, global row index, trailing sums as
  differences of running sums, forward fill, previous / next row): rows are
  dealt to slices, ranges of (key, time, tie) with about equal numbers of rows
  (:func:`cut_in_order`).  One row per key and slice -- a total or an edge
  row -- is prefix-combined and joined back as a carry, then each slice is
  worked on by itself.  A burst, or all rows at one instant, is cut like any
  other range;
* interval sweeps (in-flight counts): each interval is cut at bucket edges and
  re-opened at the start of every bucket it spans.

Within a bucket the work is a sort + a streaming window frame; the join back
of the carry uses the same keys as the window.  The carry operators also take
an explicit time width (``bucket_us``) in place of slices.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MINUTE_US = 60_000_000
HOUR_US = 60 * MINUTE_US


def floor_div(c: Column, width: int) -> Column:
    """Exact integer floor division (also for negative values)."""
    w = F.lit(int(width))
    return ((c - F.pmod(c, w)) / w).cast("bigint")


def ts_micros(ts) -> Column:
    """TIMESTAMP / TIMESTAMP_NTZ -> epoch micros (session time zone UTC)."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(c.cast("timestamp"))


def micros_ts(us) -> Column:
    c = F.col(us) if isinstance(us, str) else us
    return F.timestamp_micros(c).cast("timestamp_ntz")


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ---------------------------------------------------------------------------
# As-of join
# ---------------------------------------------------------------------------

def asof_left(left: DataFrame, right: DataFrame, by: Sequence[str], left_us, right_us,
              tolerance_us: int, right_cols: Sequence[str], tie=None,
              bucket_us: int | None = None, prefix: str = "") -> DataFrame:
    """For each left row, the latest right row with equal ``by`` keys and
    ``right_us`` in ``[left_us - tolerance_us, left_us]`` (both ends
    inclusive).  Ties on time go to the highest ``tie``.  Unmatched left rows
    are kept with null right columns.

    Plan: right rows are replicated into each bucket of width ``bucket_us``
    (default: the tolerance) that a left row could look back from, unioned
    with the left rows, and one running ``last(ignorenulls)`` over
    ``(by, bucket)`` ordered by time picks the partner.  One shuffle, no
    range join, and a hot key is spread over its time buckets.
    """
    by = list(by)
    tol = int(tolerance_us)
    w = int(bucket_us or tol)
    m_fields = [_col(right_us).cast("bigint").alias("_rus")] + [F.col(c).alias(prefix + c) for c in right_cols]
    L = left.select(*[F.col(k).alias("_k_" + k) for k in by],
                    _col(left_us).cast("bigint").alias("_us"),
                    F.lit(1).alias("_side"), F.lit(None).cast("bigint").alias("_tie"),
                    F.struct(*[F.col(c) for c in left.columns]).alias("_l"))
    R = right.select(*[F.col(k).alias("_k_" + k) for k in by],
                     _col(right_us).cast("bigint").alias("_us"),
                     F.lit(0).alias("_side"),
                     (_col(tie).cast("bigint") if tie is not None else F.lit(0).cast("bigint")).alias("_tie"),
                     F.struct(*m_fields).alias("_m"))
    L = L.withColumn("_b", floor_div(F.col("_us"), w)) \
         .withColumn("_m", F.lit(None).cast(R.schema["_m"].dataType))
    R = R.withColumn("_b", F.explode(F.sequence(floor_div(F.col("_us"), w),
                                                floor_div(F.col("_us") + F.lit(tol), w)))) \
         .withColumn("_l", F.lit(None).cast(L.schema["_l"].dataType))
    keys = ["_k_" + k for k in by] + ["_b"]
    win = (Window.partitionBy(*keys).orderBy("_us", "_side", "_tie")
           .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    u = L.unionByName(R).withColumn("_hit", F.last("_m", ignorenulls=True).over(win))
    u = u.filter(F.col("_side") == 1)
    hit = F.when(F.col("_hit._rus") >= F.col("_us") - F.lit(tol), F.col("_hit"))
    u = u.select("_l", hit.alias("_hit"))
    return u.select(*[F.col("_l." + c).alias(c) for c in left.columns],
                    *[F.col("_hit." + prefix + c).alias(prefix + c) for c in right_cols])


# ---------------------------------------------------------------------------
# Slices: ranges of the order with about equal numbers of rows
# ---------------------------------------------------------------------------

#: Slice number of a row, as :func:`cut_in_order` sets it.
SLICE = "_slice"
#: Rows that are one slice, and rows of a slice where there are several.
ONE_SLICE, SLICE_ROWS = 1_000_000, 4_000_000


def slices_of(df: DataFrame) -> int:
    """How many slices ``df`` is cut into: one if a task can sort all its rows,
    else at least as many as there are shuffle partitions, of SLICE_ROWS rows at
    most.  One count of the rows."""
    n = df.count()
    if n <= ONE_SLICE:
        return 1
    return max(-(-n // SLICE_ROWS), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def cut_in_order(df: DataFrame, by: Sequence[str], order_us, tie=None, slices: int | None = None) -> DataFrame:
    """Adds ``SLICE``: rows are range-partitioned by (``by``, ``order_us``,
    ``tie``), so that every row of a slice comes before every row of the next
    one and slices hold about equal numbers of rows however the times are
    spread.  There are ``slices`` of them (default: :func:`slices_of`).  The
    carry operators keep and use the column, so a frame that several of them
    read in the same order is cut once.

    The cut rows are checkpointed: the range bounds come from a sample of the
    rows, and reading them again must not number them anew."""
    order = [F.col(k) for k in by] + [_col(order_us)] + ([_col(tie)] if tie is not None else [])
    d = df.repartitionByRange(int(slices or slices_of(df)), *order).withColumn(SLICE, F.spark_partition_id().cast("bigint"))
    return materialize_points(d)


def bucketed(df: DataFrame, by: Sequence[str], order_us, tie, bucket_us: int | None) -> tuple[DataFrame, bool]:
    """``df`` with ``_b``, the time bucket of an explicit width or else the
    slice, and whether there are several: a single slice needs no carry."""
    if bucket_us:
        return df.withColumn("_b", floor_div(_col(order_us).cast("bigint"), bucket_us)), True
    if SLICE in df.columns:
        return df.withColumn("_b", F.col(SLICE)), True
    n = slices_of(df)
    if n == 1:
        return df.withColumn("_b", F.lit(0)), False
    return cut_in_order(df, by, order_us, tie, n).withColumnRenamed(SLICE, "_b"), True


def join_back(d: DataFrame, carry: DataFrame, by: Sequence[str]) -> DataFrame:
    """``d`` with the columns of ``carry`` (one row per ``by`` and ``_b``); null
    keys are keys like others."""
    keys = [*by, "_b"]
    c = carry.withColumnsRenamed({k: "_j_" + k for k in keys})
    on = [d[k].eqNullSafe(c["_j_" + k]) for k in keys]
    return d.join(c, on, "inner").drop(*["_j_" + k for k in keys])


# ---------------------------------------------------------------------------
# Running sums / global ordered index
# ---------------------------------------------------------------------------

def running_sums(df: DataFrame, values: dict, by: Sequence[str], order_us, tie=None,
                 bucket_us: int | None = None) -> DataFrame:
    """Running sums (inclusive) of several BIGINT-castable columns per
    ``by`` ordered by (``order_us``, ``tie``), without a window over the
    whole key.  ``values`` maps output name -> Column.

    Per-(by, slice) totals are prefix-summed on that small table and joined
    back on (by, slice)."""
    by = list(by)
    order = [_col(order_us)] + ([_col(tie)] if tie is not None else [])
    d, several = bucketed(df, by, order_us, tie, bucket_us)
    for k, v in values.items():
        d = d.withColumn("_v_" + k, _col(v).cast("bigint"))
    within = Window.partitionBy(*by, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if not several:
        for k in values:
            d = d.withColumn(k, F.sum("_v_" + k).over(within))
        return d.drop("_b", *["_v_" + k for k in values])
    totals = d.groupBy(*by, "_b").agg(*[F.sum("_v_" + k).alias("_t_" + k) for k in values])
    pw = (Window.partitionBy(*by) if by else Window.partitionBy()).orderBy("_b") \
        .rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*by, "_b", *[F.coalesce(F.sum("_t_" + k).over(pw), F.lit(0)).cast("bigint")
                                         .alias("_o_" + k) for k in values])
    j = join_back(d, offsets, by)
    for k in values:
        j = j.withColumn(k, F.col("_o_" + k) + F.sum("_v_" + k).over(within))
    return j.drop("_b", *[p + k for k in values for p in ("_v_", "_o_")])


def running_sum(df: DataFrame, value, by: Sequence[str], order_us, tie=None,
                bucket_us: int | None = None, name: str = "running") -> DataFrame:
    """Running sum of one column (see :func:`running_sums`)."""
    return running_sums(df, {name: value}, by, order_us, tie, bucket_us)


def ordered_index(df: DataFrame, order_us, tie=None, by: Sequence[str] = (),
                  bucket_us: int | None = None, name: str = "idx") -> DataFrame:
    """0-based row index ordered by (``order_us``, ``tie``), globally or per
    ``by``; equal to ``row_number() - 1`` over one unpartitioned window but
    computed slice by slice."""
    out = running_sum(df, F.lit(1), by, order_us, tie, bucket_us, name=name)
    return out.withColumn(name, F.col(name) - 1)


def running_count(df: DataFrame, cond, by: Sequence[str], order_us, tie=None,
                  bucket_us: int | None = None, name: str = "running_count") -> DataFrame:
    """Number of rows so far (inclusive) with ``cond`` true, per ``by``."""
    return running_sum(df, F.when(_col(cond), 1).otherwise(0), by, order_us, tie, bucket_us, name=name)


# ---------------------------------------------------------------------------
# Interval sweep
# ---------------------------------------------------------------------------

def inflight(intervals: DataFrame, by: Sequence[str], start_us: str, end_us: str,
             bucket_us: int | None = None, points: DataFrame | None = None,
             point_us: str | None = None, name: str = "inflight") -> DataFrame:
    """Number of intervals ``[start, end)`` open at a time point, per ``by``.

    Without ``points`` the points are the interval starts themselves, and
    every interval counts itself.  An interval that ends as it starts is open
    for no time: it counts itself, and no other row counts it, not even one
    that starts at the same instant.  With ``points`` (columns ``by`` and
    ``point_us``), every point row gets the count at its time.

    Each interval is cut into buckets: +1 at ``max(start, bucket start)`` in
    every bucket it touches and -1 at ``end`` in its last one.  A RANGE frame
    over time makes every event at the same instant a peer, so intervals that
    end exactly at a point are not counted and those that start there are."""
    by = list(by)
    # one minute per key: even a key with a third of 100 TB over a month
    # is ~1 GB per bucket; pass a narrower width for denser data
    w = int(bucket_us or MINUTE_US)
    iv = intervals.filter(F.col(end_us) > F.col(start_us))
    b0 = floor_div(F.col(start_us), w)
    b1 = floor_div(F.col(end_us) - 1, w)
    opens = F.transform(F.sequence(b0, b1), lambda b: F.struct(
        b.alias("b"), F.greatest(F.col(start_us), b * F.lit(w)).alias("t"), F.lit(1).alias("d")))
    closes = F.array(F.struct(b1.alias("b"), F.col(end_us).alias("t"), F.lit(-1).alias("d")))
    ev = iv.select(*by, F.explode(F.concat(opens, closes)).alias("e"))
    ev = ev.select(*by, F.col("e.b").alias("_b"), F.col("e.t").alias("_t"), F.col("e.d").alias("_d"),
                   F.lit(None).cast("struct<x:int>").alias("_p"))
    if points is None:
        pts, pt_col = intervals, start_us
        # the arriving interval's own +1 is already an event: points add 0;
        # an empty interval has no event and counts itself below
    else:
        pts, pt_col = points, point_us
    pstruct = F.struct(*[F.col(c) for c in pts.columns])
    p = pts.select(*by, floor_div(F.col(pt_col), w).alias("_b"), F.col(pt_col).cast("bigint").alias("_t"),
                   F.lit(0).alias("_d"), pstruct.alias("_p"))
    ev = ev.withColumn("_p", F.lit(None).cast(p.schema["_p"].dataType))
    u = ev.unionByName(p)
    win = Window.partitionBy(*by, "_b").orderBy("_t").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    u = u.withColumn(name, F.greatest(F.sum("_d").over(win), F.lit(0)).cast("bigint"))
    u = u.filter(F.col("_p").isNotNull())
    if points is None:
        empty = F.col("_p." + end_us) <= F.col("_p." + start_us)
        u = u.withColumn(name, F.when(empty, F.col(name) + 1).otherwise(F.col(name)))
    return u.select(*[F.col("_p." + c).alias(c) for c in pts.columns], name)


# ---------------------------------------------------------------------------
# Trailing window at sample times
# ---------------------------------------------------------------------------

def trailing_at(points: DataFrame, events: DataFrame, by: Sequence[str], point_us: str, event_us: str,
                window_us: int, aggs: dict[str, Column], bucket_us: int | None = None) -> DataFrame:
    """For each point row, sums over events with equal ``by`` and time in
    ``(point - window, point]``.  ``aggs`` maps output name -> numeric
    Column evaluated on event rows.

    A trailing sum is ``S(t) - S(t - window)`` of the per-key cumulative sum
    S (events at a time count before points at that time).  Each point is
    entered twice -- at t and at t - window -- into one bucketed running sum
    over events and points, so there is no event replication and no window
    as wide as the look-back.  Events of one key and instant are added up
    first: however many there are, they are one row."""
    by = list(by)
    W = int(window_us)
    pstruct = F.struct(*[F.col(c) for c in points.columns])
    ev = events.select(*by, F.col(event_us).cast("bigint").alias("_t"), *[v.cast("bigint").alias(k) for k, v in aggs.items()])
    ev = ev.groupBy(*by, "_t").agg(*[F.sum(k).alias(k) for k in aggs]).select(
        *by, "_t", F.lit(0).alias("_side"), F.lit(None).cast("bigint").alias("_pid"), F.lit(0).alias("_sign"), *aggs)
    p = points.select(*by, F.col(point_us).cast("bigint").alias("_pt"), pstruct.alias("_p")) \
              .withColumn("_pid", F.monotonically_increasing_id())
    p = materialize_points(p)
    hi = p.select(*by, F.col("_pt").alias("_t"), F.lit(1).alias("_side"), "_pid", F.lit(1).alias("_sign"),
                  *[F.lit(0).cast("bigint").alias(k) for k in aggs])
    lo = p.select(*by, (F.col("_pt") - W).alias("_t"), F.lit(1).alias("_side"), "_pid", F.lit(-1).alias("_sign"),
                  *[F.lit(0).cast("bigint").alias(k) for k in aggs])
    u = ev.unionByName(hi).unionByName(lo)
    # points at one instant see the same sums: their order is any fixed one
    u = u.withColumn("_tie", F.struct("_side", F.coalesce("_pid", F.lit(0)), "_sign"))
    s = running_sums(u, {"_s_" + k: F.col(k) for k in aggs}, by, "_t", "_tie", bucket_us).filter(F.col("_sign") != 0)
    g = s.groupBy("_pid").agg(*[F.sum(F.col("_s_" + k) * F.col("_sign")).alias(k) for k in aggs])
    out = p.join(g, "_pid", "inner")
    return out.select(*[F.col("_p." + c).alias(c) for c in points.columns], *list(aggs))


def materialize_points(df: DataFrame) -> DataFrame:
    """Point rows get an id from ``monotonically_increasing_id`` and are
    read three times below; a reliable checkpoint pins the ids (and the
    rows) so every read sees the same values."""
    from reqlens.operators.sizing import materialize
    return materialize(df)


# ---------------------------------------------------------------------------
# Forward fill (last non-null value so far)
# ---------------------------------------------------------------------------

def forward_fill(df: DataFrame, value, by: Sequence[str], order_us, tie,
                 bucket_us: int | None = None, name: str = "filled") -> DataFrame:
    """Last non-null ``value`` at or before each row per ``by`` in
    (``order_us``, ``tie``) order.  Inside a slice a running
    ``last(ignorenulls)``; the carry is the last non-null value of earlier
    slices, from the table of one row per key and slice."""
    by = list(by)
    d, several = bucketed(df, by, order_us, tie, bucket_us)
    d = d.withColumn("_v", _col(value))
    within = Window.partitionBy(*by, "_b").orderBy(_col(order_us), _col(tie)) \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if not several:
        return d.withColumn(name, F.last("_v", ignorenulls=True).over(within)).drop("_b", "_v")
    key = F.when(F.col("_v").isNotNull(), F.struct(_col(order_us), _col(tie)))
    edge = d.groupBy(*by, "_b").agg(F.max_by("_v", key).alias("_e"))
    bw = (Window.partitionBy(*by) if by else Window.partitionBy()).orderBy("_b") \
        .rowsBetween(Window.unboundedPreceding, -1)
    carry = edge.select(*by, "_b", F.last("_e", ignorenulls=True).over(bw).alias("_carry"))
    j = join_back(d, carry, by)
    j = j.withColumn(name, F.coalesce(F.last("_v", ignorenulls=True).over(within), F.col("_carry")))
    return j.drop("_b", "_v", "_carry")


# ---------------------------------------------------------------------------
# Point-in-interval lookup for non-overlapping intervals
# ---------------------------------------------------------------------------

def interval_lookup(points: DataFrame, intervals: DataFrame, by: Sequence[str], point_us: str,
                    start_us: str = "start_us", end_us: str = "end_us", cols: Sequence[str] = (),
                    bucket_us: int | None = None, name: str = "interval") -> DataFrame:
    """For each point, the interval ``[start, end)`` of the same key that
    contains it (struct ``name`` with start_us, end_us and ``cols``; null
    when none).  Intervals of one key must not overlap (state runs, pool
    versions, merged breaker intervals).

    Interval starts and points are unioned and the latest start at or
    before each point is forward-filled over time (slices with a carry, starts
    before points at equal times); the point matches when it lies before
    that interval's end.  Work is linear in points + intervals: no
    candidate pairs, however many intervals fall in one slice.  Points at one
    instant are told apart by their content, so a burst of them is cut too."""
    by = list(by)
    iv = F.struct(F.col(start_us).cast("bigint").alias("start_us"), F.col(end_us).cast("bigint").alias("end_us"),
                  *[F.col(c) for c in cols])
    pstruct = F.struct(*[F.col(c) for c in points.columns])
    I = intervals.select(*by, F.col(start_us).cast("bigint").alias("_t"), F.lit(0).alias("_side"), iv.alias("_iv"))
    P = points.select(*by, F.col(point_us).cast("bigint").alias("_t"), F.lit(1).alias("_side"), pstruct.alias("_p"))
    I = I.withColumn("_p", F.lit(None).cast(P.schema["_p"].dataType))
    P = P.withColumn("_iv", F.lit(None).cast(I.schema["_iv"].dataType))
    u = I.unionByName(P).withColumn("_tie", F.struct("_side", F.when(F.col("_side") == 1, F.xxhash64("_p"))))
    u = forward_fill(u, "_iv", by, "_t", "_tie", bucket_us, name="_hit")
    u = u.filter(F.col("_side") == 1)
    hit = F.when(F.col("_hit.end_us") > F.col("_t"), F.col("_hit"))
    return u.select(*[F.col("_p." + c).alias(c) for c in points.columns], hit.alias(name))
