"""Dashboard panel queries Q1-Q11."""

from __future__ import annotations

from pyspark.sql import functions as F

from reqlens.operators import aggs as A
from reqlens.operators import routing as R
from reqlens.operators import series as S
from reqlens.plans import panels as Q
from reqlens.plans.catalog import AS_OF_US, MID_US, query
from reqlens.plans.queries_core import edge_values
from reqlens.plans.queries_series import BREAKER_SQL
from reqlens.sources import logs as L
from reqlens.sources.fixtures import BASE_US

START, END = BASE_US, AS_OF_US  # the whole 12-hour range of the data


def hist_quantile_sql(source: str, keys: list[str], value: str, edges, q: float, out: str = "quantile_value",
                      scale: float = 1.0, where: str = "true") -> str:
    k = ", ".join(keys)
    return f"""
h as (select {k}, e.le, e.edge, count(*) filter (where {value} <= e.edge) as cnt
      from ({source}) src, {edge_values(edges)} e(le, edge) where {where} group by {k}, e.le, e.edge),
h2 as (select *, coalesce(lag(cnt) over (partition by {k} order by edge), 0) as prev_cnt,
              coalesce(lag(edge) over (partition by {k} order by edge), 0) as prev_le,
              max(cnt) over (partition by {k}) as total,
              max(case when le <> '+Inf' then edge end) over (partition by {k}) as max_finite from h),
h3 as (select *, {q} * total as rnk from h2),
pick as (select *, row_number() over (partition by {k} order by edge) as rn from h3 where cnt >= rnk),
res as (select {k}, (case when total = 0 then null when le = '+Inf' then max_finite
          when prev_cnt = 0 and prev_le = 0 and edge <= 0 then edge
          else prev_le + (edge - prev_le) * (rnk - prev_cnt) / (cnt - prev_cnt) end) * {scale} as {out}
        from pick where rn = 1)"""




def rng(width_s: int, start: int = START) -> str:
    """Rows a look-back can see."""
    return f"t_us >= {start - width_s * 1000000} and t_us < {END}"


def ends(width_s: int, start: int = START) -> str:
    """Windows evaluated inside the range."""
    return f"ws + {width_s * 1000000} >= {start} and ws + {width_s * 1000000} < {END}"


@query("q1_requests_per_s_by_server", f"""
with w as (select server_id, (t_us - t_us % 15000000) - k * 15000000 as ws
           from fx_request_log, range(4) r(k) where {rng(60)})
select server_id, make_timestamp(ws) as window_start, count(*) as requests, round(count(*) / 60.0, 6) as per_second
from w where {ends(60)} group by server_id, ws""")
def q1_requests_per_s_by_server(fx):
    """Q1: requests/s per server series (1-minute look-back every 15 s)."""
    return Q.panel_requests_per_s(fx.fx_request_log, START, END, by=["server_id"])


@query("q1_requests_per_s_from_mid_day", f"""
with w as (select (t_us - t_us % 15000000) - k * 15000000 as ws from fx_request_log, range(4) r(k) where {rng(60, MID_US)})
select make_timestamp(ws) as window_start, count(*) as requests, round(count(*) / 60.0, 6) as per_second
from w where {ends(60, MID_US)} group by ws""")
def q1_requests_per_s_from_mid_day(fx):
    """Q1 over a range that begins inside the data: the first points still see
    their whole look-back."""
    return Q.panel_requests_per_s(fx.fx_request_log, MID_US, END)


@query("q2_duration_p95_by_server", f"""
with {hist_quantile_sql(f"select server_id, duration_s, (t_us - t_us % 15000000) - k * 15000000 as ws from fx_request_log, range(4) r(k) where {rng(60)}", ["server_id", "ws"], "duration_s", A.REQUEST_DURATION_EDGES, 0.95, where=ends(60)).strip()}
select server_id, make_timestamp(ws) as window_start, round(quantile_value, 6) as quantile_value from res""")
def q2_duration_p95_by_server(fx):
    """Q2: p95 duration by server from 1-minute histograms every 15 s."""
    return Q.panel_duration_p95(fx.fx_request_log, START, END)


@query("q3_error_rate_by_server", f"""
with w as (select server_id, status_code, (t_us - t_us % 15000000) - k * 15000000 as ws
           from fx_request_log, range(4) r(k) where {rng(60)})
select server_id, make_timestamp(ws) as window_start, count(*) as requests,
       count(*) filter (where regexp_matches(cast(status_code as varchar), '^5..$')) as errors,
       round(100.0 * count(*) filter (where regexp_matches(cast(status_code as varchar), '^5..$')) / count(*), 6) as error_pct
from w where {ends(60)} group by server_id, ws""")
def q3_error_rate_by_server(fx):
    """Q3: 5xx percentage per server (1-minute windows every 15 s)."""
    return Q.panel_error_rate(fx.fx_request_log, START, END)


@query("q4_active_connections", f"""
with pool as (select id as server_id from fx_servers where is_active),
g as (select server_id, unnest(generate_series(cast({-(-START // 15000000)} as bigint), cast({(END - 1) // 15000000} as bigint))) * 15000000 as tick_us
      from pool)
select g.server_id, make_timestamp(g.tick_us) as tick, count(i.id) as active_connections
from g left join fx_intervals i on i.server_id = g.server_id and i.start_us <= g.tick_us and i.end_us > g.tick_us
  and i.end_us > i.start_us
group by g.server_id, g.tick_us""")
def q4_active_connections(fx):
    """Q4: active connections per pool server every 15 s."""
    return Q.panel_active_connections(fx.fx_intervals, R.make_pool(fx.fx_servers), START, END)


GAUGE_SQL = """
with ticks as (
  select server_id, unnest(generate_series((min(t_us) + 14999999) // 15000000, (max(t_us) + 300000000) // 15000000)) as k
  from fx_metrics where {filt} group by server_id),
j as (
  select t.server_id, t.k, m.{v}, row_number() over (partition by t.server_id, t.k order by m.t_us desc, m.id desc) as rn
  from ticks t join fx_metrics m
    on m.server_id = t.server_id and m.t_us <= t.k * 15000000 and m.t_us >= t.k * 15000000 - 300000000)
select server_id, make_timestamp(k * 15000000) as tick, round({v}, 6) as {v}
from j where rn = 1 and k * 15000000 >= {start} and k * 15000000 < {end}"""


@query("q5_cpu_servers_1_2", GAUGE_SQL.format(filt="server_id in (1, 2)", v="cpu_usage", start=START, end=END))
def q5_cpu_servers_1_2(fx):
    """Q5 + P15: cpu gauge for a multi-select of servers 1 and 2."""
    return Q.panel_gauge(fx.fx_metrics, "cpu_usage", START, END, server_ids=[1, 2])


@query("q6_memory_all_servers", GAUGE_SQL.format(filt="true", v="memory_usage", start=START, end=END))
def q6_memory_all_servers(fx):
    """Q6 + P15 (All): memory gauge for every server."""
    return Q.panel_gauge(fx.fx_metrics, "memory_usage", START, END)


@query("q7_model_predictions_per_s", f"""
with w as (select (t_us - t_us % 15000000) - k * 15000000 as ws
           from fx_model_calls, range(4) r(k) where outcome = 'ok' and {rng(60)})
select make_timestamp(ws) as window_start, count(*) as requests, round(count(*) / 60.0, 6) as per_second
from w where {ends(60)} group by ws""")
def q7_model_predictions_per_s(fx):
    """Q7: model predictions per second."""
    return Q.panel_model_predictions_per_s(fx.fx_model_calls, START, END)


@query("q8_breaker_state", f"""
with {BREAKER_SQL.strip()},
iv as (select min(t_us) as open_us, max(open_end) as close_us from i group by island),
ticks as (select unnest(generate_series(cast({-(-START // 15000000)} as bigint), cast({(END - 1) // 15000000} as bigint))) * 15000000 as tick_us)
select make_timestamp(tick_us) as tick, case when iv.open_us is not null then 1 else 0 end as state,
       case when iv.open_us is not null then 'OPEN' else 'CLOSED' end as label
from ticks left join iv on iv.open_us <= ticks.tick_us and ticks.tick_us < iv.close_us""")
def q8_breaker_state(fx):
    """Q8 + W9 + P14: breaker state every 15 s."""
    return Q.panel_breaker_state(S.breaker_intervals(fx.fx_model_calls), START, END)


@query("q9_memo_hit_pct", f"""
with w as (select outcome, (t_us - t_us % 15000000) - k * 15000000 as ws
           from fx_model_calls, range(20) r(k) where {rng(300)})
select make_timestamp(ws) as window_start,
       round(case when count(*) filter (where outcome in ('hit', 'ok', 'error')) > 0 then
         100.0 * count(*) filter (where outcome = 'hit') / count(*) filter (where outcome in ('hit', 'ok', 'error')) end, 6)
         as hit_pct
from w where {ends(300)} group by ws""")
def q9_memo_hit_pct(fx):
    """Q9: memo hit % over 5-minute windows every 15 s."""
    return Q.panel_memo_hit_pct(fx.fx_model_calls, START, END)


@query("q10_model_latency_p95_ms", f"""
with {hist_quantile_sql(f"select latency_s, (t_us - t_us % 15000000) - k * 15000000 as ws from fx_model_calls, range(20) r(k) where outcome = 'ok' and {rng(300)}", ["ws"], "latency_s", A.MODEL_LATENCY_EDGES, 0.95, "p95_ms", 1000.0, ends(300)).strip()}
select make_timestamp(ws) as window_start, round(p95_ms, 6) as p95_ms from res""")
def q10_model_latency_p95_ms(fx):
    """Q10: p95 model latency (ms) from 5-minute inference histograms."""
    return Q.panel_model_latency_p95_ms(fx.fx_model_calls, START, END)


@query("q11_service_logs", f"""
select id, json_extract_string(line, '$.level') as level, cast(json_extract(line, '$.status') as integer) as status
from fx_log_lines where service = 'load-balancer'
  and cast(json_extract_string(line, '$.ts') as bigint) * 1000 >= {MID_US}
  and cast(json_extract_string(line, '$.ts') as bigint) * 1000 < {END}""")
def q11_service_logs(fx):
    """Q11: every log line of the service from mid-day on."""
    logs = L.parse_logs(fx.fx_log_lines)
    logs = logs.withColumn("t_us", F.unix_micros(F.col("ts").cast("timestamp")))
    return Q.panel_logs(logs, MID_US, END).select("id", "level", "status")
