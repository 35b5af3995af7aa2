"""Telemetry-shaped views over the driver's test tables.

The test tables are TPC-H-ish plus an ``events`` table.  Each view below maps
events onto the schema of one telemetry input (request log, metric samples,
probes, spans, ...).  The views only *shape* rows; they compute nothing the
operators compute.  The same SQL text runs in Spark (``spark.sql`` with
DataFrame arguments) and in DuckDB (as CTEs of the oracle queries), so both
engines see identical inputs.

Requests take the odd event ids and metric samples the even ones: one events
table feeds two interleaved streams, and every event is used.  Event time is
compressed 60-fold (30 days -> 12 hours) so that a 2-minute as-of tolerance
finds partners.
"""

from __future__ import annotations

import re
from pyspark.sql import DataFrame, SparkSession

# Macros replaced per engine.
_SPARK_MACROS = {
    "@US": "unix_micros(cast(ts as timestamp))",
    "@K": "cast(get_json_object(props, '$.k') as int)",
    "@DIV": "div",
}
_DUCK_MACROS = {
    "@US": "epoch_us(ts)",
    "@K": "cast(json_extract_string(props, '$.k') as integer)",
    "@DIV": "//",
}
_TS_RE = re.compile(r"@TS\[([^\]]+)\]")
_STR_RE = re.compile(r"@STR\[([^\]]+)\]")
_FMT_RE = re.compile(r"@FMT\[(@TS\[[^\]]+\])\]")

BASE_US = 1704067200000000  # 2024-01-01 00:00:00 UTC

# View name -> SQL.  ``{name}`` refers to another view (or ``events`` /
# ``region``).  Order matters: a view may only refer to earlier ones.
VIEWS: dict[str, str] = {
    "ev": f"""
select event_id, user_id, event_type, value, @K as k,
       {BASE_US} + (@US - {BASE_US}) @DIV 60 as t_us
from {{events}}""",
    "fx_servers": """
select r_regionkey + 1 as id,
       concat('http://backend-', @STR[r_regionkey + 1], ':', @STR[8001 + r_regionkey]) as name,
       concat('backend-', @STR[r_regionkey + 1]) as ip_address,
       8001 + r_regionkey as port, 'active' as status, r_regionkey <> 4 as is_active,
       1 + r_regionkey % 3 as weight, 2 + r_regionkey as capacity
from {region}""",
    "fx_requests": """
select event_id as id, cast(user_id % 5 + 1 as int) as server_id, event_type <> 'error' as status,
       cast(floor(value) as bigint) as response_time_ms, @TS[t_us] as created_at, t_us
from {ev}""",
    "fx_metrics": """
select event_id as id, cast(user_id % 5 + 1 as int) as server_id,
       least(value, cast(100 as double)) as cpu_usage, cast(k as double) as memory_usage,
       cast(event_id % 7 as int) as request_count,
       cast(case when event_type = 'error' then 0.5 else 1.0 end as double) as success_rate,
       @TS[t_us + 1700000] as created_at, t_us + 1700000 as t_us
from {ev}""",
    "fx_request_log": """
select event_id as id, concat('req-', @STR[event_id]) as request_id,
       case when event_id % 5 = 0 then 'GET' else 'POST' end as method,
       case when event_id % 3 = 0 then '/api/v1/servers' else '/api/v1/request' end as path,
       case when event_type = 'error' then case when k % 2 = 0 then 500 else 502 end
            when k < 10 then 404 else 200 end as status_code,
       value / 1000 as duration_s, concat('10.0.0.', @STR[user_id % 256]) as remote_ip,
       cast(user_id % 5 + 1 as int) as server_id, @TS[t_us] as ts, t_us
from {ev}""",
    "fx_probes": """
select event_id @DIV 3 as probe_id, cast(event_id % 3 as int) as attempt,
       cast((event_id @DIV 3) % 5 + 1 as int) as server_id,
       case when event_type in ('error', 'view') then 503 else 200 end as status_code,
       @TS[t_us] as ts, t_us
from {ev}""",
    "fx_intervals": """
select event_id as id, cast(user_id % 5 + 1 as int) as server_id,
       t_us - cast(floor(value * 1000000) as bigint) as start_us, t_us as end_us
from {ev}""",
    "fx_counter_samples": """
select event_id as id, cast(user_id % 5 + 1 as int) as server_id, cast((event_id @DIV 2) % 50 as double) as value,
       @TS[t_us] as ts, t_us
from {ev}""",
    "fx_model_calls": """
select event_id as id,
       case event_type when 'view' then 'hit' when 'error' then 'error' else 'ok' end as outcome,
       value / 1000 as latency_s, @TS[t_us] as ts, t_us
from {ev}""",
    "fx_spans": """
select md5(@STR[event_id]) as trace_id, concat('a', @STR[event_id]) as span_id,
       cast(null as string) as parent_span_id, 'load-balancer' as service, 'ProxyRequest' as name,
       event_type = 'error' as failed, t_us as start_us, t_us + cast(floor(value * 1000) as bigint) as end_us
from {ev}
union all
select md5(@STR[event_id]), concat('b', @STR[event_id]), concat('a', @STR[event_id]),
       concat('backend-', @STR[user_id % 5 + 1]), 'handle', event_type = 'error',
       t_us + 100, t_us + 100 + cast(floor(value * 900) as bigint)
from {ev}""",
    "fx_log_lines": """
select event_id as id, 'load-balancer' as service,
       concat('{"level":"', case when event_type = 'error' then 'error' when k < 10 then 'warn' else 'info' end,
              '","ts":"', @STR[t_us @DIV 1000], '","msg":"request","request_id":"req-', @STR[event_id],
              '","method":"POST","path":"', case when event_id % 3 = 0 then '/api/v1/servers' else '/api/v1/request' end,
              '","response_bytes":', @STR[k * 131 + event_id % 1000], ',"status":',
              @STR[case when event_type = 'error' then 500 when k < 10 then 404 else 200 end],
              ',"duration":', @STR[cast(floor(value) as bigint) @DIV 100], '.',
              @STR[cast(floor(value) as bigint) % 100 @DIV 10],
              ',"remote_ip":"10.0.0.', @STR[user_id % 256], '","traceID":"', md5(@STR[event_id]), '"}') as line
from {ev}""",
    # One configured backend URL per event.  Hosts 6 and 7 are not in the
    # registry; some URLs lack a port (-> 80) and some have a bad port.
    "fx_config_urls": """
select event_id as pos,
       case when k % 10 = 0 then concat('http://backend-', @STR[user_id % 7 + 1])
            when k % 10 = 1 then concat('http://backend-', @STR[user_id % 7 + 1], ':x', @STR[user_id % 7])
            else concat('http://backend-', @STR[user_id % 7 + 1], ':', @STR[8001 + user_id % 7]) end as url
from {ev}""",
    # Comma-separated server lists with blanks and empty entries.
    "fx_server_lists": """
select event_id as list_id,
       concat(' http://backend-', @STR[user_id % 7 + 1], ':', @STR[8001 + user_id % 7],
              case when k % 3 = 0 then ', ,' else ',' end,
              'http://backend-', @STR[(user_id + k) % 7 + 1], ':', @STR[8001 + (user_id + k) % 7],
              case when k % 4 = 0 then ',' else '' end) as raw
from {ev}""",
    # Environment-style key/value configuration (weight overrides and noise).
    "fx_config_kv": """
select event_id as pos,
       case when event_type = 'view' then concat('OTHER_', @STR[user_id % 7 + 1])
            else concat('SERVER_WEIGHT_backend-', @STR[user_id % 7 + 1], '_', @STR[8001 + user_id % 7]) end as key,
       case when k % 4 = 0 then '0' when k % 9 = 1 then 'x' else @STR[k % 5 + 1] end as value
from {ev}""",
    # Registry status changes (server, active flag, time).
    "fx_status_changes": """
select event_id as change_id, cast(user_id % 6 + 1 as int) as server_id,
       event_type not in ('error', 'view') as is_active, @TS[t_us] as changed_at
from {ev}""",
    # Backend sample payloads as fetched by the poller (some invalid).
    "fx_raw_samples": """
select event_id as id, cast(user_id % 5 + 1 as int) as server_id,
       case when event_type = 'error' then 500 else 200 end as http_status,
       case when k % 25 = 0 then 'not json'
            else concat('{"cpu_usage":', @STR[cast(floor(value) as bigint) - 5], '.', @STR[k % 10],
                        ',"memory_usage":', @STR[k + 2 - (event_id % 5)], '}') end as body,
       @TS[t_us] as ts, t_us
from {ev}""",
    # Proxied request outcomes: upstream status, or a transport failure.
    "fx_proxy_outcomes": """
select event_id as id, cast(user_id % 5 + 1 as int) as server_id, t_us,
       case when event_type = 'error' and k % 2 = 1 then cast(null as int)
            when event_type = 'error' then 503 when k < 10 then 404 else 200 end as upstream_status,
       event_type = 'error' and k % 2 = 1 as transport_error
from {ev}""",
    # Log timestamps as shipped: RFC3339 with nanos (UTC or an offset), or Unix ms.
    "fx_ts_strings": """
select event_id as id,
       case when k % 3 = 0 then @STR[t_us @DIV 1000]
            when k % 3 = 1 then concat(@FMT[@TS[t_us]], '.', lpad(@STR[t_us % 1000000], 6, '0'), '789Z')
            else concat(@FMT[@TS[t_us + 7200000000]], '+02:00') end as ts_text
from {ev}""",
    # Container discovery targets (log-shipper relabel input).
    "fx_targets": """
select event_id as id, concat('/backend-', @STR[user_id % 5 + 1], '-', @STR[k]) as container_name,
       md5(@STR[event_id]) as container_id, concat('backend-', @STR[user_id % 5 + 1]) as compose_service,
       'telemetry' as compose_project
from {ev}""",
}

_REF_RE = re.compile(r"\{(\w+)\}")


def _render(sql: str, engine: str) -> str:
    macros = _SPARK_MACROS if engine == "spark" else _DUCK_MACROS
    for k, v in macros.items():
        sql = sql.replace(k, v)
    if engine == "spark":
        sql = _FMT_RE.sub(lambda m: f"date_format({m.group(1)}, \"yyyy-MM-dd'T'HH:mm:ss\")", sql)
        sql = _TS_RE.sub(r"cast(timestamp_micros(\1) as timestamp_ntz)", sql)
        sql = _STR_RE.sub(r"cast(\1 as string)", sql)
    else:
        sql = _FMT_RE.sub(r"strftime(\1, '%Y-%m-%dT%H:%M:%S')", sql)
        sql = _TS_RE.sub(r"make_timestamp(\1)", sql)
        sql = _STR_RE.sub(r"cast(\1 as varchar)", sql)
        sql = sql.replace("as string)", "as varchar)")
    return sql


def _deps(name: str, seen: list[str]) -> list[str]:
    for ref in _REF_RE.findall(VIEWS[name]):
        if ref in VIEWS and ref not in seen:
            _deps(ref, seen)
    if name not in seen:
        seen.append(name)
    return seen


def duckdb_with(body: str) -> str:
    """Prefix an oracle query with the fixture views it uses, as CTEs."""
    wanted: list[str] = []
    for name in VIEWS:
        if re.search(rf"\b{name}\b", body):
            _deps(name, wanted)
    if not wanted:
        return body
    ctes = ",\n".join(f"{n} as ({_REF_RE.sub(lambda m: m.group(1), _render(VIEWS[n], 'duck'))})"
                      for n in wanted)
    stripped = body.lstrip()
    if stripped[:5].lower() == "with ":
        return f"with {ctes},\n{stripped[5:]}"
    return f"with {ctes}\n{body}"


class Fixtures:
    """Lazily built fixture DataFrames for one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._cache: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def view(self, name: str) -> DataFrame:
        if name not in self._cache:
            sql = _render(VIEWS[name], "spark")
            refs = set(_REF_RE.findall(sql))
            # Escape literal braces (JSON text) for spark.sql's formatter.
            sql = _REF_RE.sub(lambda m: f"\x00{m.group(1)}\x01", sql)
            sql = sql.replace("{", "{{").replace("}", "}}")
            sql = sql.replace("\x00", "{").replace("\x01", "}")
            args = {}
            for ref in refs:
                args[ref] = self.view(ref) if ref in VIEWS else self.table(ref)
            self._cache[name] = self.spark.sql(sql, **args)
        return self._cache[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("fx_") or name == "ev":
            return self.view(name)
        raise AttributeError(name)
