"""Queries for model features, training, scoring and the model pick
(M4-M10, R5)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from reqlens.operators import model as M
from reqlens.operators import routing as R
from reqlens.operators import series as S
from reqlens.operators.aggs import FEATURES
from reqlens.operators.sizing import materialize
from reqlens.plans.catalog import AS_OF, AS_OF_US, query
from reqlens.plans.queries_core import JOINED_SQL
from reqlens.plans.queries_routing import POOL_SQL
from reqlens.plans.queries_series import BREAKER_SQL, TRANSITIONS_SQL
from reqlens.plans.training import training_set
from reqlens.session import checkpoint_dir
from reqlens.sources import readers as IO

HEALTH_END_US = AS_OF_US + 86_400_000_000  # runs stay open past the data


def snapshots(fx):
    o = S.probe_outcomes(fx.fx_probes)
    tr = S.health_transitions(o)
    first = o.groupBy("server_id").agg(F.min("t_us").alias("t_us"))
    runs = S.state_intervals(tr, first, HEALTH_END_US)
    pool = R.make_pool(fx.fx_servers)
    return M.decision_snapshots(fx.fx_metrics, fx.fx_intervals, fx.fx_requests, runs, pool)


SNAP_SQL = f"""
{POOL_SQL.strip()},
{TRANSITIONS_SQL.strip()},
tk as (select server_id, unnest(generate_series((min(t_us) + 14999999) // 15000000,
                                                (max(t_us) + 300000000) // 15000000)) as k
       from fx_metrics group by server_id),
g as (select t.server_id, t.k * 15000000 as tick_us, m.cpu_usage, m.memory_usage,
             row_number() over (partition by t.server_id, t.k order by m.t_us desc, m.id desc) as rn
      from tk t join fx_metrics m
        on m.server_id = t.server_id and m.t_us <= t.k * 15000000 and m.t_us >= t.k * 15000000 - 300000000),
ticks as (select unnest(generate_series(lo, hi)) * 15000000 as tick_us
          from (select (min(t_us) + 14999999) // 15000000 as lo, (max(t_us) + 300000000) // 15000000 as hi from fx_metrics)),
s0 as (select p.server_id, ticks.tick_us, p.pos, coalesce(g.cpu_usage, 0) as cpu_usage,
              coalesce(g.memory_usage, 0) as memory_usage, p.weight, p.capacity
       from pool p cross join ticks
       left join g on g.server_id = p.server_id and g.tick_us = ticks.tick_us and g.rn = 1),
cn as (select s0.server_id, s0.tick_us, count(i.id) as conns from s0 left join fx_intervals i
         on i.server_id = s0.server_id and i.start_us <= s0.tick_us and i.end_us > s0.tick_us and i.end_us > i.start_us
       group by s0.server_id, s0.tick_us),
er as (select s0.server_id, s0.tick_us, count(r.id) as k from s0 left join fx_requests r
         on r.server_id = s0.server_id and r.t_us <= s0.tick_us and not r.status
       group by s0.server_id, s0.tick_us),
pw as (select server_id, e, quantile_cont(response_time_ms, 0.95) as p95
       from (select server_id, response_time_ms, (t_us // 60000000 + 1 + j) * 60000000 as e
             from fx_requests, range(5) rr(j))
       group by server_id, e),
lt as (select s0.server_id, s0.tick_us, tr.alive,
              row_number() over (partition by s0.server_id, s0.tick_us order by tr.t_us desc, tr.seq desc) as rn
       from s0 join tr on tr.server_id = s0.server_id and tr.t_us <= s0.tick_us),
snap as (
  select s0.server_id, make_timestamp(s0.tick_us) as tick, s0.tick_us, s0.pos, s0.cpu_usage, s0.memory_usage,
         cn.conns as active_conns, 1 - pow(0.9, er.k) as error_rate, coalesce(pw.p95, 0) as response_p95,
         s0.weight, s0.capacity, coalesce(lt.alive, true) as alive
  from s0 join cn on cn.server_id = s0.server_id and cn.tick_us = s0.tick_us
  join er on er.server_id = s0.server_id and er.tick_us = s0.tick_us
  left join pw on pw.server_id = s0.server_id and pw.e = s0.tick_us // 60000000 * 60000000
  left join lt on lt.server_id = s0.server_id and lt.tick_us = s0.tick_us and lt.rn = 1)"""


@query("m10_decision_snapshots", f"""
with {SNAP_SQL.strip()}
select server_id, tick, tick_us, pos, round(cpu_usage, 6) as cpu_usage, round(memory_usage, 6) as memory_usage,
       active_conns, round(error_rate, 6) as error_rate, round(response_p95, 6) as response_p95,
       weight, capacity, alive
from snap""")
def m10_decision_snapshots(fx):
    """Per pool server and 15-s tick, the features the model strategy
    sees (cpu, memory, active connections, blended error rate, windowed p95,
    weight, capacity, alive)."""
    return snapshots(fx)


@query("m8_memo_hits", f"""
with {SNAP_SQL.strip()},
keys as (select tick_us, string_agg(printf('%d|%.2f|%.2f|', server_id, cpu_usage, memory_usage), '' order by pos) as memo_key
         from snap where alive group by tick_us),
fs as (select memo_key, min(tick_us) as first from keys group by memo_key)
select keys.tick_us, keys.memo_key, keys.tick_us > fs.first as hit from keys join fs using (memo_key)""")
def m8_memo_hits(fx):
    """M8: memo key per decision tick (id|cpu|mem| over the pool in order)
    and whether an earlier tick already produced that key."""
    keys = M.memo_key(snapshots(fx), decision="tick_us")
    return M.memo_hits(keys, decision="tick_us")


SOURCE_SQL = f"""
{SNAP_SQL.strip()},
keys as (select tick_us, string_agg(printf('%d|%.2f|%.2f|', server_id, cpu_usage, memory_usage), '' order by pos) as memo_key
         from snap where alive group by tick_us),
{BREAKER_SQL.strip()},
iv as (select min(t_us) as open_us, max(open_end) as close_us from i group by island),
cl as (select m.id, m.outcome, m.t_us, keys.memo_key, iv.open_us is not null as open
       from fx_model_calls m left join keys on keys.tick_us = m.t_us // 15000000 * 15000000
       left join iv on iv.open_us <= m.t_us and m.t_us < iv.close_us),
fl as (select *, row_number() over (partition by memo_key order by t_us, id) as rn from cl
       where not open and outcome <> 'error' and memo_key is not null),
src as (
  select cl.id, cl.outcome, cl.t_us,
         case when cl.open then 'fallback_breaker'
              when cl.t_us > fl.t_us or cl.t_us = fl.t_us and cl.id > fl.id then 'memo'
              when cl.outcome = 'error' then 'fallback_error' else 'model' end as source
  from cl left join fl on fl.memo_key = cl.memo_key and fl.rn = 1)"""


def _decision_sources(fx):
    """Model calls with the memo key of their tick, and where they come from."""
    step = 15_000_000
    keys = M.memo_key(snapshots(fx), decision="tick_us")
    calls = fx.fx_model_calls.withColumn("tick_us", F.expr(f"t_us div {step} * {step}")).join(keys, "tick_us", "left")
    return R.decision_source(calls, S.breaker_intervals(fx.fx_model_calls))


@query("r6_decision_source", f"with {SOURCE_SQL.strip()}\nselect id, outcome, source from src")
def r6_decision_source(fx):
    """R6 + W9 + M8: source of each model-routed decision (breaker fallback,
    memo, model, error fallback)."""
    return _decision_sources(fx).select("id", "outcome", "source")


@query("r6_source_counts_5m", f"""with {SOURCE_SQL.strip()}
select make_timestamp(t_us - t_us % 300000000) as window_start, source, count(*) as decisions
from src group by t_us - t_us % 300000000, source""")
def r6_source_counts_5m(fx):
    """Decisions per source (breaker fallback, memo, model, error
    fallback) per 5 minutes."""
    return R.decision_source_counts(_decision_sources(fx))


@query("r5_model_pick", f"""
with {SNAP_SQL.strip()},
pw2 as (select *, coalesce(sum(weight) over (order by pos rows between unbounded preceding and 1 preceding), 0) as first
        from pool),
slots as (select server_id, unnest(generate_series(cast(first as bigint), cast(first + weight - 1 as bigint))) as slot from pw2),
fb as (select rq.id, s.server_id as assigned from rq left join slots s on s.slot = rq.i % (select count(*) from slots)),
pk as (select tick_us, server_id,
              row_number() over (partition by tick_us
                                 order by response_p95 * 0.7 + cpu_usage * 0.2 + error_rate * 0.1, pos) as rn
       from snap where alive and active_conns < capacity)
select rq.id, rq.server_id, coalesce(pk.server_id, fb.assigned) as assigned,
       case when pk.server_id is not null then 'model' else 'fallback' end as source
from rq left join pk on pk.tick_us = rq.arrival_us // 15000000 * 15000000 and pk.rn = 1
left join fb on fb.id = rq.id""")
def r5_model_pick(fx):
    """R5 + M10: per tick, the lowest-scored server that is alive and below
    capacity (score = the composite-target formula on the snapshot
    features); each request takes its tick's choice, else weighted round
    robin."""
    snap = snapshots(fx).withColumn(
        "score", F.col("response_p95") * 0.7 + F.col("cpu_usage") * 0.2 + F.col("error_rate") * 0.1)
    picks = M.pick_per_tick(snap)
    req = fx.fx_intervals.select("id", "server_id", F.col("start_us").alias("arrival_us"), "end_us")
    fb = R.weighted_round_robin(req, R.make_pool(fx.fx_servers))
    return M.route_by_model(req, picks, fb).select("id", "server_id", "assigned", "source")


def _hourly(fx):
    """Hourly training rows with the key that the split goes by."""
    tr = training_set(fx.fx_requests, fx.fx_servers, fx.fx_metrics, AS_OF, bucket="hour")
    return materialize(tr.withColumn("key", F.concat_ws("|", "server_id", F.col("hour").cast("string"))))


@query("m5_scaled_features", f"""
{JOINED_SQL.strip()},
f as (select server_id, date_trunc('hour', created_at) as hour,
        greatest(coalesce(avg(cpu_usage), 0), 0) as cpu_usage, greatest(coalesce(avg(memory_usage), 0), 0) as memory_usage,
        greatest(coalesce(sum(request_count), 0), 0) as active_conns,
        greatest(coalesce(count(*) filter (where not status)
          / (case when coalesce(sum(request_count), 0) = 0 then 1 else sum(request_count) end), 0), 0) as error_rate,
        greatest(coalesce(quantile_cont(response_time_ms, 0.95), 0), 0) as response_p95,
        greatest(coalesce(first(capacity), 0), 0) as capacity
      from joined group by server_id, date_trunc('hour', created_at)),
sc as (select {", ".join(f"avg({c}) as {c}_mean, case when min({c}) = max({c}) then 0 else stddev_pop({c}) end as {c}_std" for c in FEATURES)}
       from f where ('0x' || substr(md5(cast(server_id as varchar) || '|' || cast(hour as varchar) || '#42'), 1, 8))::bigint % 100 < 80)
select server_id, hour,
  {", ".join(f"round(case when {c}_std = 0 then 0 else ({c} - {c}_mean) / {c}_std end, 6) as {c}_scaled" for c in FEATURES)}
from f, sc""")
def m5_scaled_features(fx):
    """M3 + M4 + M5: standard scaler (population std) fitted on the training
    part of the hourly rows and applied to all of them (scale 0 -> 0)."""
    tr = _hourly(fx)
    train, _ = M.split(tr, "key")
    out = M.apply_scaler(tr, M.fit_scaler(train))
    return out.select("server_id", "hour", *[c + "_scaled" for c in FEATURES])


@query("m6_fit_score_mae", None)
def m6_fit_score_mae(fx):
    """M3 + M4 + M6 + M7 + M9 + S13: hash split of the hourly training rows,
    scaler and GBT fitted on the train rows with early stopping on a validation
    slice of them, the pipeline saved and read again, scoring of the test rows
    and their mean absolute error."""
    train, test = M.split(_hourly(fx), "key")
    train = train.withColumn("is_val", F.pmod(F.xxhash64("key", F.lit(7)), F.lit(10)) == 0)
    path = f"{checkpoint_dir(fx.spark).rstrip('/')}/models/{uuid.uuid4().hex}"
    IO.save_model(M.fit_score_model(train, validation_col="is_val"), path)
    scored = M.score(test, IO.load_model(path))
    return M.mae(scored, "target", "score")
