"""Queries for the routing what-if policies R1-R7."""

from __future__ import annotations

from pyspark.sql import functions as F

from reqlens.operators import routing as R
from reqlens.operators import series as S
from reqlens.plans.catalog import query
from reqlens.plans.queries_series import TRANSITIONS_SQL


def _requests(fx):
    """Request log as (id, server actually used, arrival, completion)."""
    return fx.fx_intervals.select("id", "server_id", F.col("start_us").alias("arrival_us"), "end_us")


POOL_SQL = """
pool as (select id as server_id, cast(row_number() over (order by name, id) - 1 as integer) as pos,
                cast(case when coalesce(weight, 1) <= 0 then 1 else coalesce(weight, 1) end as integer) as weight,
                cast(coalesce(capacity, 10) as integer) as capacity
         from fx_servers where is_active),
rq as (select id, server_id, start_us as arrival_us, end_us,
              row_number() over (order by start_us, id) - 1 as i from fx_intervals)"""


@query("r1_round_robin", f"""
with {POOL_SQL.strip()}
select rq.id, rq.server_id, p.server_id as assigned
from rq left join pool p on p.pos = rq.i % (select count(*) from pool)""")
def r1_round_robin(fx):
    """Round robin over the active pool in arrival order."""
    return R.round_robin(_requests(fx), R.make_pool(fx.fx_servers)).select("id", "server_id", "assigned")


@query("r2_weighted_round_robin", f"""
with {POOL_SQL.strip()},
pw as (select *, coalesce(sum(weight) over (order by pos rows between unbounded preceding and 1 preceding), 0) as first
       from pool),
slots as (select server_id, unnest(generate_series(cast(first as bigint), cast(first + weight - 1 as bigint))) as slot from pw)
select rq.id, rq.server_id, s.server_id as assigned
from rq left join slots s on s.slot = rq.i % (select count(*) from slots)""")
def r2_weighted_round_robin(fx):
    """R2: weighted round robin (contiguous weight slots) in arrival order."""
    return R.weighted_round_robin(_requests(fx), R.make_pool(fx.fx_servers)).select("id", "server_id", "assigned")


@query("r3_least_connections", f"""
with {POOL_SQL.strip()},
iv as (select * from fx_intervals where end_us > start_us),
c as (select rq.id, p.server_id as cand, p.pos, count(b.id) as conns
      from rq cross join pool p
      left join iv b on b.server_id = p.server_id and b.start_us <= rq.arrival_us and b.end_us > rq.arrival_us
                    and b.id <> rq.id
      group by rq.id, p.server_id, p.pos),
k as (select *, row_number() over (partition by id order by conns, pos) as rn from c)
select rq.id, rq.server_id, k.cand as assigned, k.conns as assigned_conns
from rq join k on k.id = rq.id and k.rn = 1""")
def r3_least_connections(fx):
    """Least-connections audit: server with the fewest in-flight
    requests at each arrival (self excluded), first in pool order on ties."""
    out = R.least_connections(_requests(fx), R.make_pool(fx.fx_servers))
    return out.select("id", "server_id", "assigned", "assigned_conns")


RANDOM_POS = "('0x' || substr(md5(cast(rq.id as varchar) || '#42'), 1, 8))::bigint % (select count(*) from pool)"


@query("r4_random", f"""
with {POOL_SQL.strip()}
select rq.id, rq.server_id, p.server_id as assigned from rq left join pool p on p.pos = {RANDOM_POS}""")
def r4_random(fx):
    """Reproducible uniform choice (hash of the request id, seed 42)."""
    return R.random_pick(_requests(fx), R.make_pool(fx.fx_servers)).select("id", "server_id", "assigned")


# Over ``asg`` (policy, used, assigned): the report of R7.
COMPARE_SQL = """
per as (select policy, assigned, count(*) as w, count(*) filter (where assigned = used) as agree from asg group by all),
cnt as (select server_id, response_time_ms as v, count(*) as n, sum(count(*)) over (partition by server_id) as seen
        from fx_requests group by server_id, response_time_ms),
mean as (select server_id, sum(v * n)::double / sum(n) as mean_ms from cnt group by server_id),
mix as (select policy, v, sum(w * n::double / seen) as m from per join cnt on cnt.server_id = per.assigned group by policy, v),
upto as (select policy, v, sum(m) over (partition by policy order by v) as c, sum(m) over (partition by policy) as t from mix),
p95 as (select policy, min(v)::double as p95 from upto where c >= t * (0.95 - 1e-9) group by policy)
select per.policy, per.assigned as server_id, w::bigint as requests, round(w::double / sum(w) over p, 6) as share,
       round(sum(agree) over p::double / sum(w) over p, 6) as agreement,
       round(sum(w * mean_ms) over p / sum(w) over p, 6) as mean_chosen_latency_ms, p95 as p95_chosen_latency_ms
from per left join mean on mean.server_id = per.assigned left join p95 on p95.policy = per.policy
window p as (partition by per.policy)"""

WRR_SQL = """
pw as (select *, coalesce(sum(weight) over (order by pos rows between unbounded preceding and 1 preceding), 0) as first
       from pool),
slots as (select server_id, unnest(generate_series(cast(first as bigint), cast(first + weight - 1 as bigint))) as slot from pw)"""

LC_SQL = """
iv as (select * from fx_intervals where end_us > start_us),
c as (select rq.id, p.server_id as cand, p.pos, count(b.id) as conns
      from rq cross join pool p
      left join iv b on b.server_id = p.server_id and b.start_us <= rq.arrival_us and b.end_us > rq.arrival_us
                    and b.id <> rq.id
      group by rq.id, p.server_id, p.pos),
k as (select *, row_number() over (partition by id order by conns, pos) as rn from c)"""

RANDOM_SQL = f"""select 'random' as policy, rq.server_id as used, p.server_id as assigned
  from rq left join pool p on p.pos = {RANDOM_POS}"""


@query("r7_compare_policies", f"""
with {POOL_SQL.strip()},
{WRR_SQL.strip()},
{LC_SQL.strip()},
asg as (
  select 'round_robin' as policy, rq.server_id as used, p.server_id as assigned
  from rq left join pool p on p.pos = rq.i % (select count(*) from pool)
  union all select 'weighted_round_robin', rq.server_id, s.server_id
  from rq left join slots s on s.slot = rq.i % (select count(*) from slots)
  union all select 'least_connections', rq.server_id, k.cand from rq join k on k.id = rq.id and k.rn = 1
  union all {RANDOM_SQL}),
{COMPARE_SQL.strip()}""")
def r7_compare_policies(fx):
    """Share, agreement with the actual server, mean and p95 of the chosen
    servers' latency per policy (RR, WRR, LC, random)."""
    return R.compare_policies(_requests(fx), R.make_pool(fx.fx_servers), R.latency_counts(fx.fx_requests))


# ---------------------------------------------------------------------------
# R1 / R2 over the healthy pool at each arrival (pool versions from W7)
# ---------------------------------------------------------------------------

LIVE_SQL = f"""
{POOL_SQL.strip()},
{TRANSITIONS_SQL.strip()},
alive_at as (
  select rq.id, rq.i, p.server_id, p.pos, p.weight,
         coalesce(arg_max(tr.alive, (tr.t_us, tr.seq)) filter (where tr.t_us is not null), true) as alive
  from rq cross join pool p
  left join tr on tr.server_id = p.server_id and tr.t_us <= rq.arrival_us
  group by rq.id, rq.i, p.server_id, p.pos, p.weight),
lp as (select id, i,
              coalesce(list(server_id order by pos) filter (where alive), []) as mem,
              coalesce(list(weight order by pos) filter (where alive), []) as wts
       from alive_at group by id, i)"""


def _versions(fx):
    from reqlens.plans.queries_series import HEALTH_END_US
    pool = R.make_pool(fx.fx_servers)
    o = S.probe_outcomes(fx.fx_probes)
    tr = S.health_transitions(o).join(pool.select("server_id"), "server_id", "left_semi")
    start = pool.select("server_id", F.lit(0).cast("bigint").alias("t_us"))
    runs = S.state_intervals(tr, start, HEALTH_END_US)
    return R.pool_versions(pool, runs, HEALTH_END_US)


@query("r1_round_robin_live_pool", f"""
with {LIVE_SQL.strip()}
select rq.id, rq.server_id, case when len(lp.mem) > 0 then lp.mem[(lp.i % len(lp.mem)) + 1] end as assigned
from rq join lp using (id)""")
def r1_round_robin_live_pool(fx):
    """R1 + J5 + W7: round robin over the servers healthy at each arrival
    (the counter never resets)."""
    return R.round_robin_live(_requests(fx), _versions(fx)).select("id", "server_id", "assigned")


WRR_LIVE_SQL = """
ep as (select *, case when lag({key}) over (order by i) is distinct from {key} then i end as st from lp),
ep2 as (select *, max(st) over (order by i rows between unbounded preceding and current row) as i0 from ep),
sl as (select id, i, i0,
              flatten(list_transform(range(1, len(mem) + 1), lambda k: list_resize([mem[k]], wts[k], mem[k]))) as slots
       from ep2)
select sl.id, rq.server_id,
       case when len(slots) > 0 then slots[((sl.i - sl.i0) % len(slots)) + 1] end as assigned
from sl join rq using (id)"""


@query("r2_wrr_live_pool_epochs", f"""
with {LIVE_SQL.strip()},
{WRR_LIVE_SQL.format(key="array_to_string(mem, ',')").strip()}""")
def r2_wrr_live_pool_epochs(fx):
    """R2 + J5 + W7: weighted round robin over the healthy pool; the slot
    index restarts when the pool membership changes."""
    return R.weighted_round_robin_live(_requests(fx), _versions(fx)).select("id", "server_id", "assigned")


@query("r2_wrr_live_pool_legacy", f"""
with {LIVE_SQL.strip()},
{WRR_LIVE_SQL.format(key="len(mem)").strip()}""")
def r2_wrr_live_pool_legacy(fx):
    """R2 legacy mode: slots rebuilt only when the pool length changes, as
    the original balancer did."""
    return R.weighted_round_robin_live(_requests(fx), _versions(fx), legacy=True).select("id", "server_id", "assigned")


@query("r3_least_connections_live_pool", f"""
with {LIVE_SQL.strip()},
iv as (select * from fx_intervals where end_us > start_us),
c as (select a.id, a.server_id as cand, a.pos, count(b.id) as conns
      from alive_at a join rq on rq.id = a.id
      left join iv b on b.server_id = a.server_id and b.start_us <= rq.arrival_us and b.end_us > rq.arrival_us
                    and b.id <> rq.id
      where a.alive group by a.id, a.server_id, a.pos),
k as (select *, row_number() over (partition by id order by conns, pos) as rn from c)
select rq.id, rq.server_id, k.cand as assigned, k.conns as assigned_conns
from rq left join k on k.id = rq.id and k.rn = 1""")
def r3_least_connections_live_pool(fx):
    """R3 + W7: least-connections audit among the servers healthy at each
    arrival (self excluded, first in pool order on ties; none alive -> null)."""
    out = R.least_connections(_requests(fx), R.make_pool(fx.fx_servers), versions=_versions(fx))
    return out.select("id", "server_id", "assigned", "assigned_conns")


@query("r7_compare_policies_live_pool", f"""
with {LIVE_SQL.strip()},
ep as (select *, case when lag(array_to_string(mem, ',')) over (order by i) is distinct from array_to_string(mem, ',') then i end as st
       from lp),
ep2 as (select *, max(st) over (order by i rows between unbounded preceding and current row) as i0 from ep),
sl as (select id, i, i0, mem,
              flatten(list_transform(range(1, len(mem) + 1), lambda k: list_resize([mem[k]], wts[k], mem[k]))) as slots
       from ep2),
iv as (select * from fx_intervals where end_us > start_us),
c as (select a.id, a.server_id as cand, a.pos, count(b.id) as conns
      from alive_at a join rq on rq.id = a.id
      left join iv b on b.server_id = a.server_id and b.start_us <= rq.arrival_us and b.end_us > rq.arrival_us
                    and b.id <> rq.id
      where a.alive group by a.id, a.server_id, a.pos),
k as (select *, row_number() over (partition by id order by conns, pos) as rn from c),
asg as (
  select 'round_robin' as policy, rq.server_id as used,
         case when len(mem) > 0 then mem[(sl.i % len(mem)) + 1] end as assigned from rq join sl using (id)
  union all select 'weighted_round_robin', rq.server_id,
         case when len(slots) > 0 then slots[((sl.i - i0) % len(slots)) + 1] end from rq join sl using (id)
  union all select 'least_connections', rq.server_id, k.cand from rq left join k on k.id = rq.id and k.rn = 1
  union all {RANDOM_SQL}),
{COMPARE_SQL.strip()}""")
def r7_compare_policies_live_pool(fx):
    """R7 over the healthy pool: share, agreement, mean and p95 of the chosen
    servers' latency per policy, with RR / WRR / LC routing among the servers
    alive at each arrival."""
    return R.compare_policies(_requests(fx), R.make_pool(fx.fx_servers), R.latency_counts(fx.fx_requests),
                              versions=_versions(fx))
