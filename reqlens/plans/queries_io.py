"""Queries for sources, registry operations, log ingest and scalar
functions (S4-S6, S9-S11, P2, P4-P6, P8, P10-P12, P18)."""

from __future__ import annotations

from pyspark.sql import functions as F

from reqlens.functions import scalars as P
from reqlens.plans.catalog import AS_OF, query
from reqlens.sources import logs as L
from reqlens.sources import readers as IO
from reqlens.sources import registry as REG


@query("s4_server_list_rows", """
with e as (select list_id, unnest(string_split(raw, ',')) as u, generate_subscripts(string_split(raw, ','), 1) as i
           from fx_server_lists),
k as (select list_id, i, trim(u) as url from e where trim(u) <> '')
select list_id, cast(row_number() over (partition by list_id order by i) - 1 as integer) as pos, url from k""")
def s4_server_list_rows(fx):
    """Comma-separated server lists -> (list, position, url), trimmed,
    empty entries dropped."""
    return REG.server_list_to_rows(fx.fx_server_lists)


URL_PARSE_SQL = """
uu as (select pos, url, nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^:/?#]+)', 1), '') as host,
              regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^:/?#]+:([^/?#]*)', 1) as pt
       from fx_config_urls),
inc as (select url, pos, host as ip_address,
               case when pt = '' then 80 when regexp_matches(pt, '^[0-9]{1,5}$') then cast(pt as integer) end as port
        from uu),
inc2 as (select ip_address, port, arg_min(url, pos) as url, min(pos) as pos, count(*) as cnt from inc
         where ip_address is not null and port is not null group by ip_address, port)"""


@query("s9_upsert_servers", f"""
with {URL_PARSE_SQL.strip()},
cur as (select *, cast(null as timestamp) as created_at, cast(null as timestamp) as updated_at from fx_servers),
upd as (select c.id, c.name, c.ip_address, c.port,
               case when i.url is not null then 'active' else c.status end as status,
               case when i.url is not null then true else c.is_active end as is_active,
               c.weight, c.capacity, c.created_at,
               case when i.url is not null then timestamp '{AS_OF}' else c.updated_at end as updated_at
        from cur c left join inc2 i on i.ip_address = c.ip_address and i.port = c.port),
nw as (select i.* from inc2 i anti join cur c on c.ip_address = i.ip_address and c.port = i.port)
select * from upd
union all
select cast((select max(id) from cur) + row_number() over (order by pos, ip_address, port) as integer) as id,
       url as name, ip_address, port, 'active' as status, true as is_active, 1 as weight, 10 as capacity,
       timestamp '{AS_OF}' as created_at,
       case when cnt > 1 then timestamp '{AS_OF}' end as updated_at
from nw""")
def s9_upsert_servers(fx):
    """S9 + P1: upsert of every configured URL into the registry keyed by
    (host, port): known servers refreshed, new ones inserted with the next
    ids in first-seen order, invalid URLs skipped."""
    return REG.upsert_servers(fx.fx_servers, fx.fx_config_urls, AS_OF)


@query("s10_apply_status", """
with last as (select server_id, arg_max(is_active, (changed_at, change_id)) as a, max(changed_at) as t
              from fx_status_changes group by server_id)
select s.id, s.name, s.ip_address, s.port, s.status, coalesce(l.a, s.is_active) as is_active, s.weight, s.capacity,
       cast(null as timestamp) as created_at, l.t as updated_at
from fx_servers s left join last l on l.server_id = s.id""")
def s10_apply_status(fx):
    """Latest status change per registered server applied to the
    registry (unknown servers' changes ignored)."""
    return REG.apply_status(fx.fx_servers, fx.fx_status_changes)


@query("s5_parse_logs", """
select id, json_extract_string(line, '$.level') as level, json_extract_string(line, '$.msg') as msg,
       json_extract_string(line, '$.request_id') as request_id, json_extract_string(line, '$.method') as method,
       json_extract_string(line, '$.path') as path, cast(json_extract(line, '$.status') as integer) as status,
       round(cast(json_extract(line, '$.duration') as double), 6) as duration,
       json_extract_string(line, '$.remote_ip') as remote_ip, cast(json_extract(line, '$.response_bytes') as bigint) as response_bytes,
       make_timestamp(cast(json_extract_string(line, '$.ts') as bigint) * 1000) as ts,
       nullif(regexp_extract(line, '"traceID":"(\\w+)"', 1), '') as trace_id, false as corrupt
from fx_log_lines""")
def s5_parse_logs(fx):
    """S5 + P11 + P13: JSON log lines -> typed fields, timestamp (Unix-ms
    fallback) and trace id."""
    return L.parse_logs(fx.fx_log_lines).select(
        "id", "level", "msg", "request_id", "method", "path", "status", "duration", "remote_ip",
        "response_bytes", "ts", "trace_id", "corrupt")


@query("s5_bytes_per_path", """
select json_extract_string(line, '$.path') as path, count(*) as lines,
       cast(sum(cast(json_extract(line, '$.response_bytes') as bigint)) as bigint) as response_bytes
from fx_log_lines group by 1""")
def s5_bytes_per_path(fx):
    """Bytes sent per path, from the access log."""
    return L.parse_logs(fx.fx_log_lines).groupBy("path").agg(
        F.count(F.lit(1)).alias("lines"), F.sum("response_bytes").alias("response_bytes"))


@query("p12_server_error_logs", """
select id, cast(json_extract(line, '$.status') as integer) as status,
       round(cast(json_extract(line, '$.duration') as double), 6) as duration
from fx_log_lines where service = 'load-balancer' and cast(json_extract(line, '$.status') as integer) >= 500""")
def p12_server_error_logs(fx):
    """P12 (log panel): load-balancer lines with status >= 500."""
    logs = L.parse_logs(fx.fx_log_lines)
    return L.filter_logs(logs, service="load-balancer", min_status=500).select("id", "status", "duration")


@query("p12_slow_requests", """
select id, cast(json_extract(line, '$.status') as integer) as status,
       round(cast(json_extract(line, '$.duration') as double), 6) as duration
from fx_log_lines where cast(json_extract(line, '$.duration') as double) > 1""")
def p12_slow_requests(fx):
    """Lines whose parsed duration exceeds 1 s."""
    return L.filter_logs(L.parse_logs(fx.fx_log_lines), min_duration_s=1.0).select("id", "status", "duration")


@query("p11_parse_ts", r"""
with b as (select id, ts_text, epoch_us(strptime(substr(ts_text, 1, 19), '%Y-%m-%dT%H:%M:%S')) as base_us,
                  try_cast(rpad(substr(regexp_extract(ts_text, '\.([0-9]+)', 1), 1, 6), 6, '0') as bigint) as frac_us,
                  regexp_extract(ts_text, '([+-])([0-9]{2}):([0-9]{2})$', ['s', 'h', 'm']) as off
           from fx_ts_strings where not regexp_matches(ts_text, '^-?[0-9]{1,18}$'))
select id, make_timestamp(base_us + coalesce(frac_us, 0)
         - case when off.s = '' then 0 else (case when off.s = '-' then -1 else 1 end)
               * (try_cast(off.h as bigint) * 3600 + try_cast(off.m as bigint) * 60) * 1000000 end) as ts
from b
union all
select id, make_timestamp(cast(ts_text as bigint) * 1000) as ts from fx_ts_strings
where regexp_matches(ts_text, '^-?[0-9]{1,18}$')""")
def p11_parse_ts(fx):
    """RFC3339 (nanos truncated to micros, any offset) with Unix-ms
    fallback."""
    return fx.fx_ts_strings.select("id", P.parse_log_ts("ts_text").alias("ts"))


@query("s6_parse_samples", """
with j as (select *, case when json_valid(body) then json_type(body) = 'OBJECT' else false end as ok_json
           from fx_raw_samples),
v as (select id, server_id, http_status, ts, t_us, ok_json,
             coalesce(cast(json_extract(case when ok_json then body end, '$.cpu_usage') as double), 0) as cpu0,
             coalesce(cast(json_extract(case when ok_json then body end, '$.memory_usage') as double), 0) as mem0
      from j),
v2 as (select *, case when ok_json then cpu0 end as cpu, case when ok_json then mem0 end as mem from v)
select id, server_id, http_status, ts, t_us, round(cpu, 6) as cpu_usage, round(mem, 6) as memory_usage,
       case when http_status <> 200 then 'status' when not ok_json then 'decode'
            when cpu < 0 or cpu > 100 then 'cpu' when mem < 0 or mem > 100 then 'memory' end as reject_reason,
       coalesce(http_status = 200 and ok_json and cpu between 0 and 100 and mem between 0 and 100, false) as valid
from v2""")
def s6_parse_samples(fx):
    """Backend sample payloads validated (status 200, JSON object, cpu
    and memory within [0, 100]) with a reject reason."""
    return L.parse_samples(fx.fx_raw_samples)


@query("p8_clamp_round_samples", """
with j as (select id, case when json_valid(body) then json_type(body) = 'OBJECT' else false end as ok, body
           from fx_raw_samples)
select id, round(least(greatest(coalesce(cast(json_extract(case when ok then body end, '$.cpu_usage') as double), 0), 0), 100), 1)
       as cpu_clamped
from j where ok""")
def p8_clamp_round_samples(fx):
    """Raw cpu readings clamped to [0, 100] and rounded to 1 decimal."""
    s = L.parse_samples(fx.fx_raw_samples).filter(F.col("cpu_usage").isNotNull())  # decodable payloads
    return s.select("id", P.round1(P.clamp("cpu_usage")).alias("cpu_clamped"))


@query("p10_relabel", """
select id, case when regexp_matches(container_name, '^/.*$') then regexp_extract(container_name, '^/(.*)$', 1) end as job,
       compose_service as service, compose_project as project,
       case when length(container_id) >= 12 then substring(container_id, 1, 12) end as container_id
from fx_targets""")
def p10_relabel(fx):
    """P10: discovery labels -> log stream labels."""
    return L.relabel(fx.fx_targets)


@query("p2_active_servers", f"""
with {URL_PARSE_SQL.strip()},
cur as (select * from fx_servers),
nw as (select i.* from inc2 i anti join cur c on c.ip_address = i.ip_address and c.port = i.port),
reg as (select c.id, c.name, case when i.url is not null then true else c.is_active end as is_active
        from cur c left join inc2 i on i.ip_address = c.ip_address and i.port = c.port
        union all
        select cast((select max(id) from cur) + row_number() over (order by pos, ip_address, port) as integer) as id,
               url as name, true as is_active from nw)
select id, name from reg where is_active""")
def p2_active_servers(fx):
    """Active entries, ordered by name, of the registry after the S9
    upsert of every configured URL."""
    reg = REG.upsert_servers(fx.fx_servers, fx.fx_config_urls, AS_OF)
    return P.active_servers(reg).select("id", "name")


@query("p4_duration_ms", "select id, (end_us - start_us) // 1000 as duration_ms from fx_intervals")
def p4_duration_ms(fx):
    """Request durations (micros) -> whole milliseconds, truncating."""
    return fx.fx_intervals.select("id", P.to_millis(F.col("end_us") - F.col("start_us")).alias("duration_ms"))


@query("p5_p6_outcomes", """
select id,
       case when transport_error then 502 else upstream_status end as status_code,
       (not transport_error) and upstream_status < 500 as success,
       case when transport_error then 'error' when upstream_status >= 500 then 'error'
            when upstream_status >= 400 then 'warn' else 'info' end as level,
       case when transport_error then 'request error' when upstream_status >= 500 then 'server error'
            when upstream_status >= 400 then 'client error' else 'request' end as message
from fx_proxy_outcomes""")
def p5_p6_outcomes(fx):
    """P5 + P6: effective status (502 on transport failure), success flag,
    and log severity / message of each proxied request."""
    o = fx.fx_proxy_outcomes
    err = F.when(F.col("transport_error"), F.lit("transport"))
    return o.select("id", P.effective_status("upstream_status", "transport_error").alias("status_code"),
                    P.is_success("upstream_status", "transport_error").alias("success"),
                    P.severity("upstream_status", err).alias("level"),
                    P.severity_message("upstream_status", err).alias("message"))


@query("p18_dedup_double_insert", "select distinct * from fx_requests")
def p18_dedup_double_insert(fx):
    """A request log in which every row was inserted twice (the
    double-insert defect) de-duplicated on the request id."""
    doubled = fx.fx_requests.unionAll(fx.fx_requests)
    return P.dedup_requests(doubled, "id")


@query("s11_retain_traces", f"""
select trace_id, span_id, start_us from fx_spans
where make_timestamp(start_us) > timestamp '2024-01-03 06:00:00' - interval 172800 second""")
def s11_retain_traces(fx):
    """Trace retention (48 h) evaluated as of 2024-01-03 06:00."""
    s = fx.fx_spans.withColumn("_ts", F.timestamp_micros("start_us").cast("timestamp_ntz"))
    return IO.retain(s, "_ts", IO.RETENTION_S["traces"], "2024-01-03 06:00:00").select("trace_id", "span_id", "start_us")


def _table_folder(spark) -> str:
    import uuid
    from reqlens.session import checkpoint_dir
    return f"{checkpoint_dir(spark).rstrip('/')}/tables/{uuid.uuid4().hex}"


@query("s1_s7_requests_roundtrip", f"""
select id, server_id, status, response_time_ms, created_at from fx_requests
where created_at >= timestamp '{AS_OF}' - interval 6 hour and created_at <= timestamp '{AS_OF}'""")
def s1_s7_requests_roundtrip(fx):
    """S7 + S1: the request log appended to a day-partitioned table (two
    appends), then read back for the 6 hours before as_of with the time
    filter also applied to the day partitions."""
    spark = fx.spark
    path = _table_folder(spark)
    req = fx.fx_requests.select("id", "server_id", "status", "response_time_ms", "created_at")
    mid = "2024-01-01 06:00:00"
    IO.append_requests(req.filter(F.col("created_at") < F.lit(mid).cast("timestamp_ntz")), path)
    IO.append_requests(req.filter(F.col("created_at") >= F.lit(mid).cast("timestamp_ntz")), path)
    return IO.read_requests(spark, path, as_of=AS_OF, lookback_s=6 * 3600).drop("dt")


@query("s3_s8_metrics_roundtrip", f"""
select id, server_id, cpu_usage, memory_usage, request_count, success_rate, created_at from fx_metrics
where created_at >= timestamp '{AS_OF}' - interval 3 hour and created_at <= timestamp '{AS_OF}'""")
def s3_s8_metrics_roundtrip(fx):
    """S8 + S3: metric snapshots appended to a day-partitioned table and
    read back for the 3 hours before as_of."""
    spark = fx.spark
    path = _table_folder(spark)
    m = fx.fx_metrics.select("id", "server_id", "cpu_usage", "memory_usage", "request_count", "success_rate",
                             "created_at")
    IO.append_metrics(m, path)
    return IO.read_metrics(spark, path, as_of=AS_OF, lookback_s=3 * 3600).drop("dt")
