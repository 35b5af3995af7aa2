"""Queries over the request log, registry, metrics and spans:
training set, joins, aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from reqlens.functions.scalars import lookback
from reqlens.operators import aggs as A
from reqlens.operators import joins as J
from reqlens.plans.catalog import AS_OF, MID, query
from reqlens.plans.training import requests_with_metrics, training_set
from reqlens.sources.logs import parse_logs


def edge_values(edges) -> str:
    rows = [f"('{A.le_label(float(e))}', cast({float(e)!r} as double))" for e in edges]
    rows.append("('+Inf', cast('inf' as double))")
    return "(values " + ", ".join(rows) + ")"


# ---------------------------------------------------------------------------
# M2 / J2 / J1 / P3
# ---------------------------------------------------------------------------

ASOF_SQL = """
asof_m as (
  select r.id as rid, m.cpu_usage, m.memory_usage, m.request_count,
         row_number() over (partition by r.id order by m.t_us desc, m.id desc) as rn
  from fx_requests r join fx_metrics m
    on m.server_id = r.server_id and m.t_us between r.t_us - 120000000 and r.t_us
)"""

JOINED_SQL = f"""
with {ASOF_SQL.strip()},
joined as (
  select r.id, r.server_id, r.status, r.response_time_ms, r.created_at, s.capacity, s.weight,
         a.cpu_usage, a.memory_usage, a.request_count
  from fx_requests r join fx_servers s on r.server_id = s.id
  left join asof_m a on a.rid = r.id and a.rn = 1
  where r.created_at >= timestamp '{AS_OF}' - interval 7 day and r.created_at <= timestamp '{AS_OF}'
)"""


@query("m2_training_set", f"""{JOINED_SQL}
select server_id,
  round(greatest(coalesce(avg(cpu_usage), 0), 0), 6) as cpu_usage,
  round(greatest(coalesce(avg(memory_usage), 0), 0), 6) as memory_usage,
  cast(greatest(coalesce(sum(request_count), 0), 0) as bigint) as active_conns,
  round(greatest(coalesce(count(*) filter (where not status)
        / (case when coalesce(sum(request_count), 0) = 0 then 1 else sum(request_count) end), 0), 0), 6) as error_rate,
  round(greatest(coalesce(quantile_cont(response_time_ms, 0.95), 0), 0), 6) as response_p95,
  greatest(coalesce(first(capacity), 0), 0) as capacity,
  round(count(*) filter (where not status) / count(*), 6) as error_rate_true,
  round(avg(response_time_ms * 0.7 + cpu_usage * 0.2 + case when status then 0.0 else 1.0 end * 0.1), 6) as target
from joined group by server_id""")
def m2_training_set(fx):
    """M2 (flagship): per-server features + composite target from requests
    joined to the registry and, as of each request, to the latest metric
    sample of its server within 2 minutes."""
    return training_set(fx.fx_requests, fx.fx_servers, fx.fx_metrics, AS_OF)


@query("j2_asof_metrics", f"""{JOINED_SQL}
select id, server_id, created_at, round(cpu_usage, 6) as cpu_usage, round(memory_usage, 6) as memory_usage,
       request_count from joined""")
def j2_asof_metrics(fx):
    """Every request with the latest metric sample of its server in
    [t - 2 min, t]; requests without one keep nulls."""
    j = requests_with_metrics(fx.fx_requests, fx.fx_servers, fx.fx_metrics, AS_OF)
    return j.select("id", "server_id", "created_at", "cpu_usage", "memory_usage", "request_count")


@query("a4_features_hourly", f"""{JOINED_SQL}
select server_id, date_trunc('hour', created_at) as hour,
  round(greatest(coalesce(avg(cpu_usage), 0), 0), 6) as cpu_usage,
  round(greatest(coalesce(avg(memory_usage), 0), 0), 6) as memory_usage,
  cast(greatest(coalesce(sum(request_count), 0), 0) as bigint) as active_conns,
  round(greatest(coalesce(count(*) filter (where not status)
        / (case when coalesce(sum(request_count), 0) = 0 then 1 else sum(request_count) end), 0), 0), 6) as error_rate,
  round(greatest(coalesce(quantile_cont(response_time_ms, 0.95), 0), 0), 6) as response_p95,
  greatest(coalesce(first(capacity), 0), 0) as capacity,
  round(count(*) filter (where not status) / count(*), 6) as error_rate_true,
  round(avg(response_time_ms * 0.7 + cpu_usage * 0.2 + case when status then 0.0 else 1.0 end * 0.1), 6) as target
from joined group by server_id, date_trunc('hour', created_at)""")
def a4_features_hourly(fx):
    """A4 + A5 at server x hour granularity (training rows grow with time,
    not with the number of servers)."""
    return training_set(fx.fx_requests, fx.fx_servers, fx.fx_metrics, AS_OF, bucket="hour")


@query("j1_join_servers", """
select r.id, r.server_id, s.name, s.weight, s.capacity
from fx_requests r join fx_servers s on r.server_id = s.id""")
def j1_join_servers(fx):
    """Request log x registry."""
    return J.join_servers(fx.fx_requests, fx.fx_servers).select("id", "server_id", "name", "weight", "capacity")


@query("p3_lookback_6h", f"""
select id, server_id, created_at from fx_requests
where created_at >= timestamp '{AS_OF}' - interval 6 hour and created_at <= timestamp '{AS_OF}'""")
def p3_lookback_6h(fx):
    """Look-back filter (6 hours before as_of)."""
    return lookback(fx.fx_requests, "created_at", AS_OF, seconds=6 * 3600).select("id", "server_id", "created_at")


# ---------------------------------------------------------------------------
# A1 / A2 / A3
# ---------------------------------------------------------------------------

@query("a1_success_rate_30m", f"""
select s.id as server_id, coalesce(r.total, 0) as total, coalesce(r.successes, 0) as successes,
       round(case when coalesce(r.total, 0) > 0 then r.successes / r.total else 1.0 end, 6) as success_rate
from fx_servers s left join (
  select server_id, count(*) as total, count(*) filter (where status) as successes
  from fx_requests
  where created_at > timestamp '{MID}' - interval 1800 second and created_at <= timestamp '{MID}'
  group by server_id) r on r.server_id = s.id""")
def a1_success_rate_30m(fx):
    """A1 + A2: success rate per registered server over the 30 minutes up to
    a point in time (strict lower bound; 1.0 when empty)."""
    return A.success_rate(fx.fx_requests, fx.fx_servers, MID, window_s=1800)


@query("a3_rollup_1m", """
select server_id, make_timestamp(t_us - t_us % 60000000) as bucket,
       round(avg(cpu_usage), 6) as avg_cpu, round(avg(memory_usage), 6) as avg_memory,
       cast(sum(request_count) as bigint) as total_requests, round(avg(success_rate), 6) as avg_success_rate
from fx_metrics group by server_id, t_us - t_us % 60000000""")
def a3_rollup_1m(fx):
    """A3: 1-minute roll-up of metric samples per server."""
    return A.rollup_1m(fx.fx_metrics)


# ---------------------------------------------------------------------------
# A6 / A7 / A9 / A10 / A16 / A17 / A18
# ---------------------------------------------------------------------------

@query("a6_requests_total", """
select method, path, status_code, server_id, count(*) as requests
from fx_request_log group by method, path, status_code, server_id""")
def a6_requests_total(fx):
    """Request counter by method, path, status and server."""
    return A.requests_total(fx.fx_request_log)


@query("a7_latency_histogram", f"""
select method, path, server_id, e.le, count(*) filter (where duration_s <= e.edge) as bucket_count,
       count(*) as observations, round(sum(duration_s), 6) as value_sum
from fx_request_log, {edge_values(A.REQUEST_DURATION_EDGES)} e(le, edge)
group by method, path, server_id, e.le""")
def a7_latency_histogram(fx):
    """Cumulative request-duration histogram by method, path, server."""
    return A.latency_histogram(fx.fx_request_log, "duration_s", ["method", "path", "server_id"],
                               A.REQUEST_DURATION_EDGES)


@query("a9_latency_percentiles", """
select server_id, round(quantile_cont(duration_s, 0.5), 6) as p50, round(quantile_cont(duration_s, 0.9), 6) as p90,
       round(quantile_cont(duration_s, 0.95), 6) as p95, round(quantile_cont(duration_s, 0.99), 6) as p99
from fx_request_log group by server_id""")
def a9_latency_percentiles(fx):
    """Exact duration percentiles per server."""
    return A.latency_percentiles(fx.fx_request_log, "duration_s", ["server_id"])


@query("a10_error_pct", """
with w as (select status_code, (t_us - t_us % 15000000) - k * 15000000 as ws
           from fx_request_log, range(4) r(k))
select make_timestamp(ws) as window_start, count(*) as requests,
       count(*) filter (where regexp_matches(cast(status_code as varchar), '^5..$')) as errors,
       round(100.0 * count(*) filter (where regexp_matches(cast(status_code as varchar), '^5..$')) / count(*), 6) as error_pct
from w group by ws""")
def a10_error_pct(fx):
    """A10 + P7: 5xx percentage over 1-minute windows every 15 s."""
    return A.error_pct(fx.fx_request_log)


HIST_Q_SQL = """
with h as (
  select server_id, e.le, e.edge, count(*) filter (where duration_s <= e.edge) as cnt
  from fx_request_log, {edges} e(le, edge) group by server_id, e.le, e.edge),
h2 as (
  select *, coalesce(lag(cnt) over (partition by server_id order by edge), 0) as prev_cnt,
         coalesce(lag(edge) over (partition by server_id order by edge), 0) as prev_le,
         max(cnt) over (partition by server_id) as total,
         max(case when le <> '+Inf' then edge end) over (partition by server_id) as max_finite
  from h),
h3 as (select *, {q} * total as rnk from h2),
pick as (select *, row_number() over (partition by server_id order by edge) as rn from h3 where cnt >= rnk)
select server_id, round(case when total = 0 then null when le = '+Inf' then max_finite
  when prev_cnt = 0 and prev_le = 0 and edge <= 0 then edge
  else prev_le + (edge - prev_le) * (rnk - prev_cnt) / (cnt - prev_cnt) end, 6) as quantile_value
from pick where rn = 1"""


@query("a16_histogram_p95", HIST_Q_SQL.format(edges=edge_values(A.REQUEST_DURATION_EDGES), q=0.95))
def a16_histogram_p95(fx):
    """p95 estimated from the cumulative duration histogram per server."""
    h = A.latency_histogram(fx.fx_request_log, "duration_s", ["server_id"], A.REQUEST_DURATION_EDGES)
    return A.histogram_quantile(h, 0.95, ["server_id"])


@query("a17_label_values", "select distinct server_id from fx_request_log")
def a17_label_values(fx):
    """Distinct server label values."""
    return A.label_values(fx.fx_request_log, "server_id")


@query("a18_rate_breaches", """
select remote_ip, make_timestamp(t_us - t_us % 1000000) as window_start, count(*) as requests
from fx_request_log group by remote_ip, t_us - t_us % 1000000 having count(*) > 100""")
def a18_rate_breaches(fx):
    """Clients above 100 requests in one second."""
    return A.rate_breaches(fx.fx_request_log)


@query("a18_rate_breaches_per_minute", """
select remote_ip, make_timestamp(t_us - t_us % 60000000) as window_start, count(*) as requests
from fx_request_log group by remote_ip, t_us - t_us % 60000000 having count(*) > 1""")
def a18_rate_breaches_per_minute(fx):
    """A18 with a limit that the data breaks: above 1 request in a minute."""
    return A.rate_breaches(fx.fx_request_log, limit=1, width="1 minute")


@query("a13_traffic_share", """
with n as (select server_id, count(*) as requests from fx_requests group by server_id),
j as (select s.id as server_id, coalesce(n.requests, 0) as requests, s.weight from fx_servers s
      left join n on n.server_id = s.id)
select server_id, requests, weight,
       round(requests / sum(requests) over (), 6) as share,
       round(weight / sum(weight) over (), 6) as expected_share,
       round((requests / sum(requests) over ()) / (weight / sum(weight) over ()), 6) as weight_ratio
from j""")
def a13_traffic_share(fx):
    """Traffic share per server against its weight share."""
    pool = fx.fx_servers.select(F.col("id").alias("server_id"), "weight")
    return A.traffic_share(fx.fx_requests, pool)


# ---------------------------------------------------------------------------
# A14 / A15 / A19 (model calls and spans)
# ---------------------------------------------------------------------------

@query("a14_model_counters", """
select make_timestamp(t_us - t_us % 300000000) as window_start,
       count(*) filter (where outcome = 'ok') as predictions, count(*) filter (where outcome = 'error') as errors,
       count(*) filter (where outcome = 'hit') as hits, count(*) filter (where outcome in ('ok', 'error')) as misses,
       round(100.0 * count(*) filter (where outcome = 'hit') / count(*), 6) as hit_pct
from fx_model_calls group by t_us - t_us % 300000000""")
def a14_model_counters(fx):
    """Model predictions, errors, memo hits / misses and hit % per 5 min."""
    return A.model_counters(fx.fx_model_calls)


@query("a15_model_latency_histogram", f"""
select e.le, count(*) filter (where latency_s <= e.edge) as bucket_count, count(*) as observations,
       round(sum(latency_s), 6) as value_sum
from (select * from fx_model_calls where outcome = 'ok'), {edge_values(A.MODEL_LATENCY_EDGES)} e(le, edge)
group by e.le""")
def a15_model_latency_histogram(fx):
    """Model inference latency histogram (successful calls)."""
    return A.model_latency_histogram(fx.fx_model_calls)


@query("a19_span_metrics", f"""
select service, name, case when failed then 'error' else 'ok' end as status, e.le,
       count(*) filter (where (end_us - start_us) / 1e6 <= e.edge) as bucket_count, count(*) as observations,
       round(sum((end_us - start_us) / 1e6), 6) as value_sum
from fx_spans, {edge_values(A.REQUEST_DURATION_EDGES)} e(le, edge)
group by service, name, case when failed then 'error' else 'ok' end, e.le""")
def a19_span_metrics(fx):
    """Span counts, failures and duration histogram by service, name
    and status."""
    return A.span_metrics(fx.fx_spans)


# ---------------------------------------------------------------------------
# J3 / J4 / P17 / J6 / J7 / J8
# ---------------------------------------------------------------------------

URL_SQL = """
u as (
  select pos, url, nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^:/?#]+)', 1), '') as host,
         regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^:/?#]+:([^/?#]*)', 1) as pt
  from fx_config_urls),
u2 as (
  select pos, url, host, case when pt = '' then 80 when regexp_matches(pt, '^[0-9]{1,5}$') then cast(pt as integer) end as port
  from u)"""


@query("j3_resolve_server_ids", f"""
with {URL_SQL.strip()}
select u2.pos, u2.url, u2.host, u2.port, (u2.host is not null and u2.port is not null) as valid,
       cast(coalesce(s.id, -(u2.pos + 1)) as bigint) as server_id
from u2 left join fx_servers s on s.ip_address = u2.host and s.port = u2.port""")
def j3_resolve_server_ids(fx):
    """J3 + P1: configured URL -> registry id, fallback -(pos+1)."""
    return J.resolve_server_ids(fx.fx_config_urls, fx.fx_servers).select(
        "pos", "url", "host", "port", "valid", "server_id")


OVERRIDES_SQL = """
ov as (
  select replace(substring(key, 15), '_', ':') as host_port,
         case when regexp_matches(trim(value), '^[+-]?[0-9]{1,9}$') then cast(trim(value) as integer) end as weight,
         pos
  from fx_config_kv where starts_with(key, 'SERVER_WEIGHT_')),
ovl as (select host_port, arg_max(weight, pos) as weight from ov where weight > 0 group by host_port)"""


@query("p17_weight_overrides", f"with {OVERRIDES_SQL.strip()} select host_port, weight from ovl")
def p17_weight_overrides(fx):
    """Weight overrides from SERVER_WEIGHT_<host>_<port> settings."""
    return J.weight_overrides(fx.fx_config_kv)


@query("j4_weight_capacity", f"""
with {URL_SQL.strip()}, {OVERRIDES_SQL.strip()},
pool as (
  select u2.pos, u2.host, u2.port, cast(coalesce(s.id, -(u2.pos + 1)) as bigint) as server_id
  from u2 left join fx_servers s on s.ip_address = u2.host and s.port = u2.port
  where u2.host is not null and u2.port is not null)
select p.pos, p.server_id,
       cast(case when coalesce(o.weight, s.weight, 1) <= 0 then 1 else coalesce(o.weight, s.weight, 1) end as integer) as weight,
       cast(coalesce(s.capacity, 10) as integer) as capacity
from pool p left join fx_servers s on s.id = p.server_id
left join ovl o on o.host_port = concat(p.host, ':', cast(p.port as varchar))""")
def j4_weight_capacity(fx):
    """J4 + P17: pool entries with weight / capacity defaults and overrides."""
    pool = J.resolve_server_ids(fx.fx_config_urls, fx.fx_servers).filter("valid")
    out = J.with_weight_capacity(pool, fx.fx_servers, J.weight_overrides(fx.fx_config_kv))
    return out.select("pos", "server_id", "weight", "capacity")


@query("j6_logs_spans", r"""
with l as (select id, nullif(regexp_extract(line, '"traceID":"(\w+)"', 1), '') as trace_id,
                  cast(json_extract_string(line, '$.ts') as bigint) * 1000 as ts_us from fx_log_lines)
select l.id as log_id, s.span_id, s.trace_id
from l join fx_spans s on s.trace_id = l.trace_id
 and l.ts_us >= s.start_us - 60000000 and l.ts_us <= s.end_us + 60000000""")
def j6_logs_spans(fx):
    """J6 + S5 + P11 + P13: log lines parsed, trace id extracted, and joined
    to spans of the same trace within [start - 1 min, end + 1 min]."""
    logs = parse_logs(fx.fx_log_lines)
    out = J.correlate_logs_spans(logs, fx.fx_spans)
    return out.select(F.col("l.id").alias("log_id"), F.col("s.span_id"), F.col("s.trace_id"))


@query("j7_orphans", "select * from fx_status_changes where server_id not in (select id from fx_servers)")
def j7_orphans(fx):
    """Status changes that point at no registered server."""
    return J.orphans(fx.fx_status_changes, fx.fx_servers)


@query("j7_drop_orphans", "select * from fx_status_changes where server_id in (select id from fx_servers)")
def j7_drop_orphans(fx):
    """Cascade semantics, rows of registered servers only."""
    return J.drop_orphans(fx.fx_status_changes, fx.fx_servers)


@query("j8_service_edges", """
select p.service as client, c.service as server, count(*) as calls,
       count(*) filter (where c.failed) as failed_calls,
       round(avg((c.end_us - c.start_us) / 1000.0), 6) as avg_latency_ms,
       round(max((c.end_us - c.start_us) / 1000.0), 6) as max_latency_ms
from fx_spans c join fx_spans p on c.trace_id = p.trace_id and c.parent_span_id = p.span_id
where p.service <> c.service group by p.service, c.service""")
def j8_service_edges(fx):
    """Caller -> callee service-graph edges."""
    return J.service_edges(fx.fx_spans)
