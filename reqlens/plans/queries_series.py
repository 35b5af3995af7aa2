"""Queries for the time-series operators W1-W10."""

from __future__ import annotations

from pyspark.sql import functions as F

from reqlens.operators import series as S
from reqlens.operators.timebucket import inflight, ordered_index
from reqlens.plans.catalog import AS_OF_US, MID_US, query
from reqlens.sources.fixtures import BASE_US


def _smooth_sql(alpha: float) -> str:
    return f"""
select id, server_id, created_at,
  round(least(greatest(list_reduce(list(cpu_usage) over (partition by server_id order by t_us, id
        rows between unbounded preceding and current row),
        lambda acc, x: acc * cast({1 - alpha} as double) + x * cast({alpha} as double)), 0), 100), 1) as smoothed
from fx_metrics"""


@query("w1_smooth_cpu", _smooth_sql(0.3))
def w1_smooth_cpu(fx):
    """W1 + P8: exponentially smoothed cpu per server (seeded by the first
    sample), clamped to [0, 100] and rounded to one decimal."""
    m = fx.fx_metrics.select("id", "server_id", "created_at", "t_us", "cpu_usage")
    return S.smooth(m, "cpu_usage", ["server_id"], "t_us", "id").select("id", "server_id", "created_at", "smoothed")


@query("w1_smooth_cpu_slow", _smooth_sql(0.01))
def w1_smooth_cpu_slow(fx):
    """W1 with alpha 0.01, where thousands of samples back still count."""
    m = fx.fx_metrics.select("id", "server_id", "created_at", "t_us", "cpu_usage")
    return S.smooth(m, "cpu_usage", ["server_id"], "t_us", "id", alpha=0.01).select("id", "server_id", "created_at", "smoothed")


@query("w2_error_blend", """
select id, server_id, created_at,
  round(1 - pow(0.9, sum(case when not status then 1 else 0 end) over (partition by server_id order by t_us, id
        rows between unbounded preceding and current row)), 6) as error_rate
from fx_requests""")
def w2_error_blend(fx):
    """Blended error-rate gauge after each request, per server."""
    return S.error_blend(fx.fx_requests).select("id", "server_id", "created_at", "error_rate")


@query("w3_success_rate_at_samples", """
select m.id, m.server_id, m.t_us, count(r.id) as requests, count(r.id) filter (where r.status) as successes,
       round(case when count(r.id) > 0 then (count(r.id) filter (where r.status)) / count(r.id) else 1.0 end, 6) as success_rate
from fx_metrics m left join fx_requests r
  on r.server_id = m.server_id and r.t_us > m.t_us - 300000000 and r.t_us <= m.t_us
group by m.id, m.server_id, m.t_us""")
def w3_success_rate_at_samples(fx):
    """Success rate of the server's requests in the 5 minutes before
    each metric sample (1.0 when none)."""
    pts = fx.fx_metrics.select("id", "server_id", "t_us")
    return S.success_rate_at(pts, fx.fx_requests)


@query("w4_counter_rate_1m", """
with d as (select server_id, t_us // 60000000 as b, value,
                  lag(value) over (partition by server_id, t_us // 60000000 order by t_us, id) as prev
           from fx_counter_samples)
select server_id, make_timestamp(b * 60000000) as window_start, count(*) as samples,
       round(coalesce(sum(case when prev is null then null when value < prev then value else value - prev end), 0), 6) as increase,
       round(coalesce(sum(case when prev is null then null when value < prev then value else value - prev end), 0) / 60.0, 6) as rate
from d group by server_id, b""")
def w4_counter_rate_1m(fx):
    """Reset-tolerant counter increase and per-second rate, 1-minute
    windows per server."""
    return S.counter_rate(fx.fx_counter_samples, ["server_id"], "t_us", "value", 60, tie="id")


@query("w5_inflight_at_arrival", """
select a.id, a.server_id, a.start_us, count(*) as inflight
from fx_intervals a join fx_intervals b
  on a.server_id = b.server_id and b.start_us <= a.start_us and (b.end_us > a.start_us or b.id = a.id)
group by a.id, a.server_id, a.start_us""")
def w5_inflight_at_arrival(fx):
    """In-flight requests on the server when each request arrives
    (counting itself), by a bucketed +1/-1 sweep."""
    iv = fx.fx_intervals
    out = inflight(iv, ["server_id"], "start_us", "end_us")
    return out.select("id", "server_id", "start_us", "inflight")


@query("w6_cpu_gauge_ticks", """
with ticks as (
  select server_id, unnest(generate_series((min(t_us) + 14999999) // 15000000, (max(t_us) + 300000000) // 15000000)) as k
  from fx_metrics group by server_id),
j as (
  select t.server_id, t.k, m.cpu_usage, m.t_us,
         row_number() over (partition by t.server_id, t.k order by m.t_us desc, m.id desc) as rn
  from ticks t join fx_metrics m
    on m.server_id = t.server_id and m.t_us <= t.k * 15000000 and m.t_us >= t.k * 15000000 - 300000000)
select server_id, make_timestamp(k * 15000000) as tick, round(cpu_usage, 6) as cpu_usage, t_us as sample_us
from j where rn = 1""")
def w6_cpu_gauge_ticks(fx):
    """Cpu gauge per 15-s scrape tick: latest sample within 5 minutes."""
    return S.gauge_at_ticks(fx.fx_metrics, ["server_id"], "t_us", "cpu_usage", "id")


TRANSITIONS_SQL = """
o as (select server_id, probe_id as seq,
             coalesce(min(case when status_code = 200 then t_us end), max(t_us)) as t_us,
             bool_or(status_code = 200) as alive
      from fx_probes group by server_id, probe_id),
l as (select *, lag(alive) over (partition by server_id order by t_us, seq) as prev from o),
tr as (select server_id, seq, t_us, alive from l where alive <> coalesce(prev, true))"""


@query("w7_health_transitions", f"with {TRANSITIONS_SQL.strip()} select * from tr")
def w7_health_transitions(fx):
    """Health state changes per server from probe attempts (alive if
    any attempt of a probe returned 200; servers start alive)."""
    return S.health_transitions(S.probe_outcomes(fx.fx_probes))


@query("w7_transitions_with_request_failures", f"""
with {TRANSITIONS_SQL.strip().replace("l as (", """f as (
  select server_id, cast(id + 1000000000 as bigint) as seq, t_us, false as alive from fx_proxy_outcomes where transport_error),
l0 as (select * from o union all select * from f),
l as (""").replace("from o),", "from l0),")} select * from tr""")
def w7_transitions_with_request_failures(fx):
    """W7 where a proxied request that fails in transport takes its server down
    too, until the next good probe."""
    failed = fx.fx_proxy_outcomes.filter("transport_error").select(
        "server_id", (F.col("id") + 1_000_000_000).cast("bigint").alias("seq"), "t_us")
    return S.health_transitions(S.probe_outcomes(fx.fx_probes), failed)


@query("w7_uptime", f"""
with {TRANSITIONS_SQL.strip()},
fs as (select server_id, min(t_us) as t_us from o group by server_id),
runs as (select server_id, -1 as seq, t_us, true as alive from fs union all select server_id, seq, t_us, alive from tr),
iv as (select server_id, alive, t_us as start_us,
              coalesce(lead(t_us) over (partition by server_id order by t_us, seq), {AS_OF_US}) as end_us from runs)
select server_id, cast(sum(greatest(least(end_us, {AS_OF_US}) - greatest(start_us, {BASE_US}), 0)) as bigint) as alive_us,
       round(sum(greatest(least(end_us, {AS_OF_US}) - greatest(start_us, {BASE_US}), 0)) / {float(AS_OF_US - BASE_US)}, 6) as uptime
from iv where alive and end_us > start_us group by server_id""")
def w7_uptime(fx):
    """Alive intervals from the transitions and the uptime share of
    each server over the whole 12-hour range."""
    o = S.probe_outcomes(fx.fx_probes)
    tr = S.health_transitions(o)
    first = o.groupBy("server_id").agg(F.min("t_us").alias("t_us"))
    iv = S.state_intervals(tr, first, AS_OF_US)
    return S.uptime(iv, BASE_US, AS_OF_US)


@query("w8_global_index", "select id, row_number() over (order by t_us, id) - 1 as idx from fx_requests")
def w8_global_index(fx):
    """Global 0-based arrival index without a single-partition window
    over the rows (bucket counts -> prefix sums -> per-bucket row_number)."""
    req = fx.fx_requests
    return ordered_index(req, "t_us", "id").select("id", "idx")


BREAKER_SQL = """
c as (select t_us, id as seq, outcome = 'error' as fail from fx_model_calls where outcome in ('ok', 'error')),
n as (select *, lead(t_us) over (order by t_us, seq) as next_t, lag(t_us) over (order by t_us, seq) as prev_t,
             lag(fail) over (order by t_us, seq) as prev_fail from c),
f as (select t_us, seq, least(coalesce(next_t, t_us + 30000000), t_us + 30000000) as open_end,
             not (coalesce(prev_fail, false) and coalesce(t_us - prev_t <= 30000000, false)) as st from n where fail),
i as (select *, sum(case when st then 1 else 0 end) over (order by t_us, seq rows between unbounded preceding and current row) as island from f)"""


@query("w9_breaker_intervals", f"""
with {BREAKER_SQL.strip()}
select make_timestamp(min(t_us)) as opened_at, make_timestamp(max(open_end)) as closed_at,
       min(t_us) as open_us, max(open_end) as close_us, count(*) as failures
from i group by island""")
def w9_breaker_intervals(fx):
    """Circuit-breaker open intervals from model-call outcomes (30 s
    reset)."""
    return S.breaker_intervals(fx.fx_model_calls)


@query("w10_rate_grid", """
with w as (select (t_us - t_us % 15000000) - k * 15000000 as ws from fx_request_log, range(4) r(k))
select make_timestamp(ws) as window_start, count(*) as requests, round(count(*) / 60.0, 6) as per_second
from w group by ws""")
def w10_rate_grid(fx):
    """Requests per second over 1-minute windows every 15 s."""
    return S.rate_grid(fx.fx_request_log)


# ---------------------------------------------------------------------------
# Queries built on the health runs: J5 pool at request time, A12 inventory,
# A11 readiness.
# ---------------------------------------------------------------------------

HEALTH_END_US = AS_OF_US + 86_400_000_000


def _health_runs(fx, pool_ids):
    """State runs per server; every server is alive from t = 0 until its
    first down transition (servers start alive)."""
    o = S.probe_outcomes(fx.fx_probes)
    tr = S.health_transitions(o)
    start = pool_ids.select("server_id", F.lit(0).cast("bigint").alias("t_us"))
    return S.state_intervals(tr.join(pool_ids, "server_id", "left_semi"), start, HEALTH_END_US)


POOL_IDS_SQL = "pool_ids as (select id as server_id from fx_servers where is_active)"
ALIVE_AT_SQL = """
alive_at as (
  select q.qid, p.server_id,
         coalesce(arg_max(tr.alive, (tr.t_us, tr.seq)) filter (where tr.t_us is not null), true) as alive
  from {points} q cross join pool_ids p
  left join tr on tr.server_id = p.server_id and tr.t_us <= q.t_us
  group by q.qid, p.server_id)"""


@query("j5_pool_at_request", f"""
with {TRANSITIONS_SQL.strip()}, {POOL_IDS_SQL},
pts as (select id as qid, t_us from fx_requests),
{ALIVE_AT_SQL.format(points="pts").strip()}
select qid as id, cast(count(*) filter (where alive) as bigint) as alive_servers,
       coalesce(string_agg(cast(server_id as varchar), ',' order by server_id) filter (where alive), '') as pool
from alive_at group by qid""")
def j5_pool_at_request(fx):
    """J5 + W7: the healthy pool (alive pool servers) at each request's
    time, from pool versions derived from the health runs."""
    from reqlens.operators import routing as R
    from reqlens.operators.joins import pool_at
    pool = R.make_pool(fx.fx_servers)
    runs = _health_runs(fx, pool.select("server_id"))
    req = fx.fx_requests.select("id", "t_us")
    out = pool_at(req, runs, pool, HEALTH_END_US, ts_us="t_us")
    ids = F.transform("members", lambda m: m["server_id"].cast("string"))
    return out.select("id", F.coalesce(F.size("members"), F.lit(0)).cast("bigint").alias("alive_servers"),
                      F.coalesce(F.array_join(F.array_sort(ids), ","), F.lit("")).alias("pool"))


INVENTORY_SQL = f"""
{TRANSITIONS_SQL.strip()}, {POOL_IDS_SQL},
pts as (select 0 as qid, {MID_US} as t_us),
{ALIVE_AT_SQL.format(points="pts").strip()},
conns as (select server_id, count(*) as c from fx_intervals where start_us <= {MID_US} and end_us > {MID_US}
          group by server_id),
inv as (select s.id as server_id, s.name as url, a.alive, s.weight, s.capacity,
               cast(coalesce(c.c, 0) as bigint) as active_connections
        from fx_servers s join alive_at a on a.server_id = s.id left join conns c on c.server_id = s.id
        where s.is_active)"""


def _inventory(fx):
    from reqlens.operators import aggs as A
    from reqlens.operators import routing as R
    pool = R.make_pool(fx.fx_servers)
    o = S.probe_outcomes(fx.fx_probes)
    health = S.health_transitions(o).select("server_id", "seq", "t_us", "alive")
    return A.inventory(pool, health, fx.fx_intervals, MID_US)


@query("a12_inventory", f"with {INVENTORY_SQL.strip()} select * from inv")
def a12_inventory(fx):
    """Server inventory at a point in time: url, alive (latest health
    state, servers start alive), weight, capacity, active connections."""
    return _inventory(fx)


@query("a11_readiness", f"""
with {INVENTORY_SQL.strip()}
select cast(count(*) as bigint) as total, cast(count(*) filter (where alive) as bigint) as healthy,
       case when count(*) filter (where alive) > 0 then 'ready' else 'not ready' end as status from inv""")
def a11_readiness(fx):
    """Readiness summary over the inventory."""
    from reqlens.operators import aggs as A
    return A.readiness(_inventory(fx))


SUMMARY_SQL = """
select server_id, (t_us // 60000000 - j) * 60000000 as ws, duration_s as v
from fx_request_log, range(5) r(j) where duration_s is not null"""


@query("a8_quantile_summary", f"""
with w as ({SUMMARY_SQL.strip()}),
r as (select *, row_number() over (partition by server_id, ws order by v) as k, count(*) over (partition by server_id, ws) as n from w)
select server_id, make_timestamp(ws) as window_start, n as observations, o.quantile, o.max_error, round(min(v), 6) as value
from r, (values (0.5::double, 0.05::double), (0.9, 0.01), (0.95, 0.005), (0.99, 0.001)) o(quantile, max_error)
where k >= o.quantile * n - 1e-9 group by server_id, ws, n, o.quantile, o.max_error""")
def a8_quantile_summary(fx):
    """Approximate duration quantiles (0.5/0.9/0.95/0.99) per server
    over 5-minute windows sliding by 1 minute.  The sketches are exact at the
    size of these windows, as is the SQL."""
    from reqlens.operators import aggs as A
    return A.quantile_summary(fx.fx_request_log, "duration_s", ["server_id"], "ts")


@query("a8_rank_errors", """
with w as (select server_id, t_us // 3600000000 * 3600000000 as ws from fx_request_log where duration_s is not null)
select server_id, make_timestamp(ws) as window_start, o.quantile, count(*) as observations, true as within
from w, (values (0.5::double), (0.9), (0.95), (0.99)) o(quantile) group by server_id, ws, o.quantile""")
def a8_rank_errors(fx):
    """Quantiles per server and hour held against the hour's rows; each
    has at most its objective's rank error."""
    from reqlens.operators import aggs as A
    log, hour = fx.fx_request_log, {"width": "1 hour", "slide": "1 hour"}
    found = A.quantile_summary(log, "duration_s", ["server_id"], "ts", **hour)
    return A.summary_rank_errors(found, log, "duration_s", ["server_id"], "ts", **hour)
