"""Routing policies re-aimed as batch what-if over a request log.

``assign(requests, pool, policy)`` answers "which server would this policy
have chosen for each logged request?".  Requests carry ``id``, the server
actually used (``server_id``) and the arrival time (``arrival_us``).  The
pool is small (one row per backend: ``server_id``, ``pos`` = position in
pool order, ``weight``, ``capacity``) and is broadcast after a size check.

Counter-based policies become closed forms over the global arrival index
(W8); least connections audits the observed load at each arrival.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reqlens.functions.scalars import stable_hash
from reqlens.operators.sizing import broadcast_if_small, materialize
from reqlens.operators.timebucket import (MINUTE_US, cut_in_order, floor_div, forward_fill, interval_lookup,
                                          ordered_index, slices_of, SLICE)


def make_pool(servers: DataFrame, active_only: bool = True) -> DataFrame:
    """Pool in registry order (P2: active servers by name), with 0-based
    ``pos``, ``weight`` (non-positive or null -> 1) and ``capacity``
    (default 10).  The registry is a small table."""
    s = servers.filter(F.col("is_active")) if active_only else servers
    w = Window.partitionBy().orderBy("name", "id")  # one row per server
    return s.select(
        F.col("id").alias("server_id"), F.col("name").alias("url"),
        (F.row_number().over(w) - 1).cast("int").alias("pos"),
        F.when(F.coalesce(F.col("weight"), F.lit(1)) <= 0, 1).otherwise(F.coalesce(F.col("weight"), F.lit(1)))
         .cast("int").alias("weight"),
        F.coalesce(F.col("capacity"), F.lit(10)).cast("int").alias("capacity"))


def _by_pos(pool: DataFrame, slot_col: str = "pos") -> DataFrame:
    return broadcast_if_small(pool.select(F.col(slot_col).alias("_slot"), F.col("server_id").alias("assigned")))


def _null_assign(requests: DataFrame, policy: str) -> DataFrame:
    return requests.select("*", F.lit(None).cast("int").alias("assigned"), F.lit(policy).alias("policy"))


def round_robin(requests: DataFrame, pool: DataFrame, order_us: str = "arrival_us", tie: str = "id") -> DataFrame:
    """The i-th request (0-based, arrival order) goes to pool[i mod n]."""
    n = pool.count()
    if n == 0:
        return _null_assign(requests, "round_robin")
    r = ordered_index(requests, order_us, tie, name="_i") \
        .withColumn("_slot", F.pmod("_i", F.lit(n)).cast("int"))
    return r.join(_by_pos(pool), "_slot", "left").drop("_slot", "_i").withColumn("policy", F.lit("round_robin"))


def weighted_slots(pool: DataFrame) -> DataFrame:
    """R2 slot table: each server repeated ``weight`` times in pool order
    (contiguous slots)."""
    w = Window.partitionBy().orderBy("pos")  # one row per server
    p = pool.withColumn("_first", F.sum("weight").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    p = p.withColumn("_first", F.coalesce("_first", F.lit(0)))
    return p.select("server_id", F.explode(F.sequence(F.col("_first"), F.col("_first") + F.col("weight") - 1)).alias("slot"))


def weighted_round_robin(requests: DataFrame, pool: DataFrame, order_us: str = "arrival_us",
                         tie: str = "id") -> DataFrame:
    """R2: the i-th request goes to slot i mod (sum of weights)."""
    slots = weighted_slots(pool)
    total = slots.count()
    if total == 0:
        return _null_assign(requests, "weighted_round_robin")
    r = ordered_index(requests, order_us, tie, name="_i") \
        .withColumn("_slot", F.pmod("_i", F.lit(total)).cast("int"))
    return r.join(_by_pos(slots, "slot"), "_slot", "left").drop("_slot", "_i") \
            .withColumn("policy", F.lit("weighted_round_robin"))


def random_pick(requests: DataFrame, pool: DataFrame, seed: int = 42, key: str = "id") -> DataFrame:
    """Uniform choice, reproducible: pool[h mod n], h being the first 32 bits
    of the MD5 of the id and the seed (:func:`stable_hash`)."""
    n = pool.count()
    if n == 0:
        return _null_assign(requests, "random")
    r = requests.withColumn("_slot", F.pmod(stable_hash(key, seed), F.lit(n)).cast("int"))
    return r.join(_by_pos(pool), "_slot", "left").drop("_slot").withColumn("policy", F.lit("random"))


# ---------------------------------------------------------------------------
# R3 least connections (observed-load audit)
# ---------------------------------------------------------------------------

_LC_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("assigned", T.IntegerType()),
    T.StructField("assigned_conns", T.LongType())])


class Tournament:
    """The least (connections, pool position) of a changing pool: a complete
    binary tree over the servers whose inner nodes hold the lesser child, so a
    change of one server is a walk to the root.  A server that is not in the
    pool loses against all."""

    OUT = 1 << 62

    def __init__(self, n: int):
        self.n, self.size = n, 1 << max(0, n - 1).bit_length()
        self.tree = [self.OUT] * (2 * self.size)
        self.conns, self.member = [0] * n, [False] * n

    def _put(self, k: int) -> None:
        tree, i = self.tree, self.size + k
        tree[i] = self.conns[k] * self.n + k if self.member[k] else self.OUT
        while i > 1:
            i >>= 1
            least = min(tree[2 * i], tree[2 * i + 1])
            if tree[i] == least:
                return
            tree[i] = least

    def add(self, k: int, d: int) -> None:
        self.conns[k] += d
        if self.member[k]:
            self._put(k)

    def members(self, wanted: set[int]) -> None:
        for k in range(self.n):
            if self.member[k] != (k in wanted):
                self.member[k] = not self.member[k]
                self._put(k)

    def best(self, own: int | None = None) -> tuple[int, int] | None:
        """(server, connections) of the least, server ``own`` counted with one
        connection less; None when nobody is in the pool."""
        least = self.tree[1]
        if own is not None and self.member[own]:
            least = min(least, (self.conns[own] - 1) * self.n + own)
        return None if least >= self.OUT else (least % self.n, max(0, least // self.n))


#: Rows whose member lists a worker holds as Python objects at a time.
_LC_ROWS = 1024


def _lc_sweep(pool_ids: np.ndarray, pool_pos: np.ndarray, live: bool) -> Callable:
    """Goes through a partition's events in order of bucket and time: in a bucket
    the carry first, at an instant ends and starts first, then the arrivals, each
    answered by the tournament in a logarithm of the pool's size.  Buckets are
    read batch by batch: memory is that of the pool and one batch, however many
    events a bucket holds."""
    order = np.lexsort((pool_ids, pool_pos))
    ids = [int(x) for x in pool_ids[order]]
    place = {s: k for k, s in enumerate(ids)}
    at_pos = {int(p): k for k, p in enumerate(pool_pos[order])}
    columns = ["_b", "kind", "server_id", "n", "id"] + (["mem"] if live else [])

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Tournament | None = None  # of the bucket that is being read
        bucket: int | None = None
        now: tuple | None = None
        for batch in batches:
            for lo in range(0, batch.num_rows, _LC_ROWS):
                part = batch.slice(lo, _LC_ROWS)
                out_id, out_srv, out_n = [], [], []
                for b, what, server, n, rid, *mem in zip(*(part.column(c).to_pylist() for c in columns)):
                    if held is None or b != bucket:
                        held, bucket, now = Tournament(len(ids)), b, None
                        if not live:
                            held.members(set(range(len(ids))))
                    k = place.get(server)  # None for servers outside the pool
                    if what < 3:
                        if k is not None:
                            held.add(k, -n if what == 2 else n)
                        continue
                    if live:
                        members = tuple(mem[0] or ())
                        if members != now:
                            held.members({at_pos[p] for p in members if p in at_pos})
                            now = members
                    found = held.best(k if n == 1 else None)
                    out_id.append(rid)
                    out_srv.append(None if found is None else ids[found[0]])
                    out_n.append(None if found is None else found[1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out_id, pa.int64()), pa.array(out_srv, pa.int32()), pa.array(out_n, pa.int64())],
                    names=_LC_SCHEMA.names)
    return fn


def sweep_bucket_width(requests: DataFrame, start_us: str = "arrival_us", max_events: int = 2_000_000,
                       ceiling_us: int = 3600 * 1_000_000, floor_us: int = 10_000) -> int:
    """Bucket width for the LC sweep: as wide as possible up to
    ``ceiling_us`` (fewer carry rows) while the busiest bucket
    holds at most about ``max_events`` events (3 per request).  Computed
    from the peak per-minute arrival count (one small aggregate) scaled to
    the candidate width, which over-estimates and so stays on the safe side."""
    peak = requests.groupBy(floor_div(F.col(start_us), MINUTE_US).alias("_m")).count() \
                   .agg(F.max("count").alias("p")).first()["p"] or 0
    per_us = 3.0 * peak / MINUTE_US  # events per microsecond at the peak minute
    if per_us * ceiling_us <= max_events:
        return ceiling_us
    return max(floor_us, int(max_events / per_us))


def least_connections(requests: DataFrame, pool: DataFrame, start_us: str = "arrival_us",
                      end_us: str = "end_us", bucket_us: int | None = None,
                      versions: DataFrame | None = None) -> DataFrame:
    """For each arrival, the pool server with the fewest requests in
    flight at that instant (the arriving one excluded), first in pool order
    on ties -- an audit of the observed load, not a closed-loop simulation.

    Plan: everything is cut into time buckets of ``bucket_us``.  A Spark
    aggregate gives, per (server, bucket), the number of intervals already
    open at the bucket start (the carry).  Each bucket then holds its start
    / end events, its arrivals and the carry rows.  Spark deals the buckets to
    tasks and sorts them, and each task reads its events as a stream that a
    tournament tree over the servers sweeps (memory bounded by the pool and one
    batch of rows, time by events x log servers).  Without an
    explicit ``bucket_us`` the width is chosen from the peak arrival rate
    so that no bucket holds more than about two million events.  With
    ``versions`` (pool versions from the health runs) the candidates of each
    arrival are the servers alive at that instant; none alive -> null."""
    pool_pd = pool.select("server_id", "pos").toPandas()  # pool: one row per server
    if len(pool_pd) == 0:
        return _null_assign(requests, "least_connections")
    pool_ids = pool_pd["server_id"].to_numpy().astype("int64")
    pool_pos = pool_pd["pos"].to_numpy().astype("int64")
    w = int(bucket_us or sweep_bucket_width(requests, start_us))
    iv = requests.filter(F.col(end_us) > F.col(start_us))
    b0 = floor_div(F.col(start_us), w)
    b1 = floor_div(F.col(end_us) - 1, w)
    later = F.when(b1 > b0, F.sequence(b0 + 1, b1)).otherwise(F.array().cast("array<bigint>"))
    carry = iv.select("server_id", F.explode(later).alias("_b")) \
              .groupBy("_b", "server_id").agg(F.count(F.lit(1)).alias("n"))
    carry = carry.select("_b", F.lit(0).alias("kind"), F.col("server_id").cast("int"),
                         F.lit(None).cast("bigint").alias("t"), F.lit(None).cast("bigint").alias("id"),
                         F.col("n").cast("bigint"))
    starts = iv.select(b0.alias("_b"), F.lit(1).alias("kind"), F.col("server_id").cast("int"),
                       F.col(start_us).cast("bigint").alias("t"), F.lit(None).cast("bigint").alias("id"),
                       F.lit(1).cast("bigint").alias("n"))
    ends = iv.select(b1.alias("_b"), F.lit(2).alias("kind"), F.col("server_id").cast("int"),
                     F.col(end_us).cast("bigint").alias("t"), F.lit(None).cast("bigint").alias("id"),
                     F.lit(1).cast("bigint").alias("n"))
    arr_src = requests
    mem = F.lit(None).cast("array<int>")
    if versions is not None:
        arr_src = attach_pool(requests, versions, start_us)
        mem = F.transform("members", lambda x: x["pos"].cast("int"))
    arrivals = arr_src.select(floor_div(F.col(start_us), w).alias("_b"), F.lit(3).alias("kind"),
                              F.col("server_id").cast("int"), F.col(start_us).cast("bigint").alias("t"),
                              F.col("id").cast("bigint").alias("id"),
                              (F.col(end_us) > F.col(start_us)).cast("bigint").alias("n"), mem.alias("mem"))
    none = F.lit(None).cast("array<int>").alias("mem")
    ev = carry.select("*", none).unionByName(starts.select("*", none)).unionByName(ends.select("*", none)) \
              .unionByName(arrivals)
    if versions is None:
        ev = ev.drop("mem")
    ev = ev.repartition("_b").sortWithinPartitions("_b", "t", "kind")  # carry rows have no time and come first
    picked = ev.mapInArrow(_lc_sweep(pool_ids, pool_pos, versions is not None), _LC_SCHEMA)
    return requests.join(picked, "id", "left").withColumn("policy", F.lit("least_connections"))


# ---------------------------------------------------------------------------
# R5 model pick, R6 decision source
# ---------------------------------------------------------------------------

def model_pick(candidates: DataFrame, fallback: DataFrame | None = None, key: str = "decision_id") -> DataFrame:
    """Per decision, the lowest-scored server among those alive and
    below capacity (``conns < capacity``); ties go to the first in pool
    order.  Decisions without an eligible server take the ``fallback``
    assignment (``key``, ``assigned``), e.g. weighted round robin."""
    ok = candidates.filter(F.col("alive") & (F.col("conns") < F.col("capacity")))
    best = ok.groupBy(key).agg(F.min_by("server_id", F.struct("score", "pos")).alias("_model"))
    allk = candidates.select(key).distinct()
    out = allk.join(best, key, "left")
    if fallback is not None:
        out = out.join(fallback.select(key, F.col("assigned").alias("_fb")), key, "left")
        return out.select(key, F.coalesce("_model", "_fb").alias("assigned"),
                          F.when(F.col("_model").isNotNull(), "model").otherwise("fallback").alias("source"))
    return out.select(key, F.col("_model").alias("assigned"),
                      F.when(F.col("_model").isNotNull(), "model").alias("source"))


def decision_source(calls: DataFrame, breaker: DataFrame, ts_us: str = "t_us", tie: str = "id", key: str = "memo_key",
                    bucket_us: int | None = None) -> DataFrame:
    """Where each model-routed decision comes from, by its memo ``key`` (M8)
    and the breaker's open intervals (W9).

    Under an open breaker: 'fallback_breaker'; such a decision neither reads nor
    fills the memo.  Of the others, the first of a key whose call does not fail
    fills the memo ('model') and those after it are hits ('memo'); before it,
    failed calls are 'fallback_error'.  ``outcome`` counts only as failed
    ('error') or not: whether a decision is a hit follows from the keys.
    Decisions without a key (no healthy server) never meet the memo.  The memo
    does not forget.

    The open interval is a point-in-interval lookup (intervals are merged, so
    they never overlap); the fills are one row per key, joined back."""
    iv = breaker.select(F.col("open_us").alias("start_us"), F.col("close_us").alias("end_us"))
    j = interval_lookup(calls, iv, [], ts_us, bucket_us=bucket_us, name="_open")
    j = materialize(j.withColumn("_at", F.struct(F.col(ts_us), F.col(tie))))
    asks = F.col("_open").isNull()
    failed = F.coalesce(F.col("outcome") == "error", F.lit(False))
    fills = j.filter(asks & ~failed & F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.min("_at").alias("_fill"))
    j = j.join(fills, F.col(key) == F.col("_key"), "left")
    src = (F.when(~asks, "fallback_breaker")
           .when(F.col("_at") > F.col("_fill"), "memo")
           .when(failed, "fallback_error")
           .otherwise("model"))
    return j.select(*calls.columns, src.alias("source"))


def decision_source_counts(sources: DataFrame, width: str = "5 minutes", ts: str = "ts") -> DataFrame:
    """R6 report: decisions per source per window."""
    g = sources.groupBy(F.window(ts, width).alias("w"), "source").agg(F.count(F.lit(1)).alias("decisions"))
    return g.select(F.col("w.start").alias("window_start"), "source", "decisions")


# ---------------------------------------------------------------------------
# Registry and comparison
# ---------------------------------------------------------------------------

POLICIES = {
    "round_robin": round_robin,
    "weighted_round_robin": weighted_round_robin,
    "least_connections": least_connections,
    "random": random_pick,
}


def ml_pick(requests: DataFrame, pool: DataFrame, snapshots: DataFrame, step_s: int = 15) -> DataFrame:
    """R5 as a policy: ``snapshots`` are per (server, tick) rows with a
    ``score`` column (from a fitted model, M7/M8); each request takes the
    choice of its tick, else weighted round robin."""
    from reqlens.operators.model import pick_per_tick, route_by_model
    fb = weighted_round_robin(requests, pool)
    out = route_by_model(requests, pick_per_tick(snapshots), fb, step_s)
    return out.withColumn("policy", F.lit("ml"))


def assign(requests: DataFrame, pool: DataFrame, policy: str, **opts) -> DataFrame:
    """Dispatch by policy name (round_robin, weighted_round_robin,
    least_connections, random, ml); unknown names are an error."""
    if policy == "ml":
        return ml_pick(requests, pool, **opts)
    if policy not in POLICIES:
        raise ValueError(f"unknown strategy: {policy}")
    return POLICIES[policy](requests, pool, **opts)


def latency_counts(requests: DataFrame, value: str = "response_time_ms", server: str = "server_id") -> DataFrame:
    """Observed latencies as ``server_id, latency_ms, n``: how often each server
    took each time."""
    return requests.filter(F.col(value).isNotNull()).groupBy(
        F.col(server).alias("server_id"), F.col(value).alias("latency_ms")).agg(F.count(F.lit(1)).alias("n"))


def compare_policies(requests: DataFrame, pool: DataFrame, latency: DataFrame,
                     policies=("round_robin", "weighted_round_robin", "least_connections", "random"),
                     versions: DataFrame | None = None, q: float = 0.95) -> DataFrame:
    """Per policy and pool server: requests assigned and share, agreement
    of the policy with the server actually used, and the mean and p95 of the
    chosen servers' observed latency (``latency``: :func:`latency_counts`).
    With ``versions`` the round-robin, weighted and least-connections policies
    route over the healthy pool at each arrival.

    The latency under a policy is the mixture of its servers' distributions,
    each weighted by the requests the policy gives it; the p95 is the smallest
    latency that 95 % of the mixture does not exceed.  It is read off the value
    counts, policies x servers x distinct latencies, never off requests x
    latencies.  Servers without an observation have no part in either figure's
    sum."""
    cols = ["id", "server_id", "policy", "assigned"]
    live = {
        "round_robin": lambda: round_robin_live(requests, versions),
        "weighted_round_robin": lambda: weighted_round_robin_live(requests, versions),
        "least_connections": lambda: least_connections(requests, pool, versions=versions),
    }
    u = None
    for p in policies:
        a = (live[p]() if versions is not None and p in live else assign(requests, pool, p)).select(*cols)
        u = a if u is None else u.unionByName(a)
    g = materialize(u.groupBy("policy", "assigned").agg(
        F.count(F.lit(1)).alias("requests"), F.count_if(F.col("assigned") == F.col("server_id")).alias("_agree")))

    seen = latency.groupBy(F.col("server_id").alias("assigned")).agg(
        F.sum("n").alias("_seen"), (F.sum(F.col("latency_ms") * F.col("n")) / F.sum("n")).alias("mean_ms"))
    mix = g.join(seen, "assigned").join(latency.withColumnRenamed("server_id", "assigned"), "assigned").groupBy(
        "policy", "latency_ms").agg(F.sum(F.col("requests") * F.col("n") / F.col("_seen")).alias("_w"))
    upto = Window.partitionBy("policy").orderBy("latency_ms")  # distinct latencies
    mix = mix.withColumn("_upto", F.sum("_w").over(upto)).withColumn("_all", F.sum("_w").over(Window.partitionBy("policy")))
    enough = F.col("_upto") >= F.col("_all") * (float(q) - 1e-9)  # sums of doubles, in any order
    p95 = mix.filter(enough).groupBy("policy").agg(F.min("latency_ms").cast("double").alias("p95_chosen_latency_ms"))

    per_policy = Window.partitionBy("policy")  # a handful of rows per policy after the aggregate
    g = g.join(broadcast_if_small(seen), "assigned", "left").withColumn("_n", F.sum("requests").over(per_policy))
    g = g.select(
        "policy", F.col("assigned").alias("server_id"), F.col("requests").cast("bigint").alias("requests"),
        (F.col("requests") / F.col("_n")).alias("share"),
        (F.sum("_agree").over(per_policy) / F.col("_n")).alias("agreement"),
        (F.sum(F.col("requests") * F.col("mean_ms")).over(per_policy) / F.col("_n")).alias("mean_chosen_latency_ms"))
    return g.join(broadcast_if_small(p95), "policy", "left")


# ---------------------------------------------------------------------------
# Policies over the live (healthy) pool: pool versions and WRR epochs
# ---------------------------------------------------------------------------

def pool_versions(pool: DataFrame, runs: DataFrame, end_us: int, bucket_us: int | None = None) -> DataFrame:
    """Piecewise-constant healthy pool: one row per version ``[start_us,
    end_us)`` with ``members`` = alive pool servers in pool order
    (array<struct<pos, server_id, weight, upto>>, ``upto`` being the weights so
    far).  ``runs`` are the W7 state
    runs (server_id, alive, start_us, end_us).  Versions change only at run
    boundaries, so the table grows with health transitions, not requests."""
    from reqlens.operators.series import neighbor

    p = pool.select("server_id", "pos", "weight")
    r = runs.join(broadcast_if_small(p), "server_id", "inner")
    bounds = r.select(F.col("start_us").alias("t_us")).distinct()
    # every pool server's state at every boundary: one lookup per (boundary,
    # server) -- the size of the member lists themselves, nothing quadratic
    rows = p.collect()  # the pool: one row per server
    pts = bounds.select("t_us", F.explode(F.array(*[
        F.struct(F.lit(int(x["server_id"])).alias("server_id"), F.lit(int(x["pos"])).alias("pos"),
                 F.lit(int(x["weight"])).alias("weight")) for x in rows])).alias("_s"))
    pts = pts.select("t_us", "_s.*")
    st = interval_lookup(pts, r, ["server_id"], "t_us", cols=["alive"], bucket_us=bucket_us, name="_run")
    so_far = Window.partitionBy("t_us").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # a pool's rows
    st = st.withColumn("upto", F.sum(F.when(F.col("_run.alive"), F.col("weight").cast("bigint")).otherwise(0)).over(so_far))
    members = st.groupBy("t_us").agg(F.array_sort(F.collect_list(
        F.when(F.col("_run.alive"), F.struct("pos", "server_id", "weight", "upto")))).alias("members"))
    nxt = neighbor(materialize(members.withColumn("_seq", F.lit(0))), [], "t_us", "_seq", ["t_us"], "next")
    return materialize(nxt.select(F.col("t_us").alias("start_us"),
                      F.coalesce(F.col("next.t_us"), F.lit(int(end_us))).alias("end_us"), "members"))


def attach_pool(requests: DataFrame, versions: DataFrame, arrival_us: str = "arrival_us",
                bucket_us: int | None = None) -> DataFrame:
    """Each request with the pool version live at its arrival (point in
    non-overlapping interval lookup: linear, one match per request)."""
    j = interval_lookup(requests, versions, [], arrival_us, cols=["members"], bucket_us=bucket_us, name="_v")
    return j.select(*requests.columns, F.col("_v.members").alias("members"))


def _with_upto(versions: DataFrame) -> DataFrame:
    """Versions whose members have ``upto``, as :func:`pool_versions` gives them;
    of a table without it, the weights are added up member by member."""
    if "upto" in versions.schema["members"].dataType.elementType.names:
        return versions
    so_far = lambda i: F.aggregate(F.slice("members", 1, i + 1), F.lit(0).cast("bigint"), lambda t, m: t + m["weight"])
    return versions.withColumn("members", F.transform("members", lambda m, i: F.struct(
        m["pos"].alias("pos"), m["server_id"].alias("server_id"), m["weight"].alias("weight"), so_far(i).alias("upto"))))


def count_upto(members: Column, slot: Column) -> Column:
    """How many members have all their slots before ``slot``: the place of the
    member that has it.  A binary search over ``upto``, from the highest bit of
    the size down."""
    bits = F.transform(F.sequence(F.length(F.bin(F.size(members))) - 1, F.lit(0), F.lit(-1)), lambda b: F.pow(F.lit(2), b).cast("int"))
    return F.aggregate(bits, F.lit(0), lambda at, step: F.when(
        (at + step <= F.size(members)) & (F.get(members, at + step - 1)["upto"] <= slot), at + step).otherwise(at))


def round_robin_live(requests: DataFrame, versions: DataFrame, order_us: str = "arrival_us",
                     tie: str = "id") -> DataFrame:
    """R1 over the healthy pool at each arrival: the i-th request (global
    counter, never reset) goes to members[i mod n]; no member -> null."""
    r = ordered_index(attach_pool(requests, versions, order_us), order_us, tie, name="_i")
    n = F.size("members")
    pick = F.when(n > 0, F.element_at("members", (F.pmod("_i", n) + 1).cast("int"))["server_id"])
    return r.withColumn("assigned", pick).withColumn("policy", F.lit("round_robin")).drop("_i", "members")


def weighted_round_robin_live(requests: DataFrame, versions: DataFrame, order_us: str = "arrival_us",
                              tie: str = "id", legacy: bool = False) -> DataFrame:
    """R2 over the healthy pool: slots = members repeated by weight; the
    slot index restarts whenever the pool seen by consecutive requests
    changes (membership; ``legacy=True``: only its length, as the original
    balancer did).  The epoch start index is a forward fill of the
    index at each change row, so there is no join on an epoch key (which
    would put a long epoch into one task)."""
    from reqlens.operators.series import neighbor

    r = attach_pool(requests, _with_upto(versions), order_us)
    if slices_of(requests) > 1:
        r = cut_in_order(r, [], order_us, tie)  # one cut for the three steps
    r = materialize(ordered_index(r, order_us, tie, name="_i"))
    ids = F.transform("members", lambda m: m["server_id"])
    key = F.size("members").cast("string") if legacy else F.array_join(ids, ",")
    r = r.withColumn("_key", F.coalesce(key, F.lit("")))
    r = materialize(neighbor(r, [], order_us, tie, ["_key"], "prev"))
    r = r.withColumn("_chg", F.col("prev._key").isNull() | (F.col("prev._key") != F.col("_key"))).drop("prev")
    # index of the epoch's first request: forward fill of the change rows' index
    r = forward_fill(r, F.when(F.col("_chg"), F.col("_i")), [], order_us, tie, name="_i0")
    total = F.element_at("members", -1)["upto"]
    slot = F.pmod(F.col("_i") - F.col("_i0"), total)
    pick = F.when(F.size("members") > 0, F.get("members", count_upto(F.col("members"), slot))["server_id"])
    out = r.withColumn("assigned", pick).withColumn("policy", F.lit("weighted_round_robin"))
    return out.drop("_i", "_i0", "_key", "_chg", "members", SLICE)
