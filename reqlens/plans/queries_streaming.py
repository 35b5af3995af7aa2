"""Streaming jobs run to completion on a file stream and read back as a
table, so the driver's batch comparison also covers them (T1, T4, T5, T7).

The input view is staged as time-ordered Parquet / text files in a fresh
folder under the session's checkpoint directory (the shared folder), the
query drains it with ``availableNow`` into a Parquet sink next to it, and
the sink is returned.  T1's append-mode windows close only when the
watermark passes them, so one sentinel row dated far after the data goes
in a last file; its own window never closes and is never emitted.
"""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reqlens.plans.catalog import query
from reqlens.session import checkpoint_dir
from reqlens.streaming import epochs
from reqlens.streaming import jobs as T

N_FILES = 4


def _folder(spark) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/streams/{uuid.uuid4().hex}"


def _stage(df: DataFrame, path: str, ts: str, fmt: str = "parquet") -> None:
    """Write ``df`` as N_FILES time slices, each by a task of its own.  The file
    source reads by modification time, so the files get times in the order of
    their slices."""
    cols = ["value"] if fmt == "text" else df.columns
    out = df.repartitionByRange(N_FILES, ts).sortWithinPartitions(ts).select(*cols)
    (out.write.text if fmt == "text" else out.write.parquet)(path)
    jvm = df.sparkSession._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration())
    parts = sorted((f.getPath() for f in fs.listStatus(folder) if f.getPath().getName().startswith("part-")),
                   key=lambda p: p.getName())
    first = jvm.System.currentTimeMillis() - 1000 * (len(parts) + 1)
    for k, part in enumerate(parts):
        fs.setTimes(part, first + 1000 * k, -1)


def _drain(sdf: DataFrame, base: str) -> DataFrame:
    q = (sdf.writeStream.format("parquet").option("path", f"{base}/out")
         .option("checkpointLocation", f"{base}/ckpt").outputMode("append")
         .trigger(availableNow=True).start())
    _finish(q)
    return sdf.sparkSession.read.parquet(f"{base}/out")


def _finish(q) -> None:
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))


def _stream(spark, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


@query("t1_stream_rollup_1m", """
select server_id, make_timestamp(t_us - t_us % 60000000) as bucket,
       round(avg(cpu_usage), 6) as avg_cpu, round(avg(memory_usage), 6) as avg_memory,
       cast(sum(request_count) as bigint) as total_requests, round(avg(success_rate), 6) as avg_success_rate
from fx_metrics group by server_id, t_us - t_us % 60000000""")
def t1_stream_rollup_1m(fx):
    """The 1-minute roll-up maintained by a watermarked streaming
    aggregation over the metric stream (drained; equals A3)."""
    spark = fx.spark
    m = fx.fx_metrics.select("id", "server_id", "cpu_usage", "memory_usage", "request_count", "success_rate",
                             "created_at")
    base = _folder(spark)
    _stage(m, f"{base}/in", "created_at")
    sentinel = spark.createDataFrame([(-1, -1, 0.0, 0.0, 0, 1.0, datetime.datetime(2100, 1, 1))], m.schema)
    sentinel.coalesce(1).write.mode("append").parquet(f"{base}/in")
    return _drain(T.stream_rollup_1m(_stream(spark, f"{base}/in", m.schema)), base)


@query("t4_stream_dedup", "select distinct id, server_id, status, created_at from fx_requests")
def t4_stream_dedup(fx):
    """T4: a request stream in which every row arrives twice, de-duplicated
    on the id within the watermark."""
    spark = fx.spark
    r = fx.fx_requests.select("id", "server_id", "status", "created_at")
    base = _folder(spark)
    _stage(r.unionAll(r), f"{base}/in", "created_at")
    return _drain(T.stream_dedup(_stream(spark, f"{base}/in", r.schema)), base)


@query("t5_stream_error_logs", """
select id, cast(json_extract(line, '$.status') as integer) as status,
       round(cast(json_extract(line, '$.duration') as double), 6) as duration
from fx_log_lines where cast(json_extract(line, '$.status') as integer) >= 500""")
def t5_stream_error_logs(fx):
    """T5: raw log lines streamed as text, parsed (S5) and filtered to
    status >= 500 (P12)."""
    spark = fx.spark
    lines = fx.fx_log_lines.select("id", F.concat_ws("\t", F.col("id").cast("string"), "line").alias("value"))
    base = _folder(spark)
    _stage(lines, f"{base}/in", "id", fmt="text")
    s = spark.readStream.option("maxFilesPerTrigger", 1).text(f"{base}/in").select(
        F.split("value", "\t", 2).getItem(0).cast("bigint").alias("id"),
        F.split("value", "\t", 2).getItem(1).alias("line"))
    out = T.stream_logs(s, line="line", min_status=500).select("id", "status", "duration")
    return _drain(out, base)


@query("t7_stream_join_servers", """
select r.id, r.server_id, s.name, s.weight, s.capacity
from fx_requests r join fx_servers s on r.server_id = s.id""")
def t7_stream_join_servers(fx):
    """Request stream enriched with the registry (stream-static join)."""
    spark = fx.spark
    r = fx.fx_requests.select("id", "server_id", "status", "created_at")
    base = _folder(spark)
    _stage(r, f"{base}/in", "created_at")
    out = T.stream_join_servers(_stream(spark, f"{base}/in", r.schema), fx.fx_servers)
    return _drain(out.select("id", "server_id", "name", "weight", "capacity"), base)


@query("t2_stream_success_rate", """
with w as (select server_id, status, (t_us - t_us % 10000000) - k * 10000000 as ws
           from fx_requests, range(30) r(k))
select server_id, make_timestamp(ws) as window_start, count(*) as requests,
       count(*) filter (where status) as successes,
       round(count(*) filter (where status) / count(*), 6) as success_rate
from w group by server_id, ws""")
def t2_stream_success_rate(fx):
    """Per-server success rate over 5-minute windows sliding by 10 s,
    from a watermarked request stream (drained; a sentinel closes the last
    windows)."""
    spark = fx.spark
    r = fx.fx_requests.select("id", "server_id", "status", "created_at")
    base = _folder(spark)
    _stage(r, f"{base}/in", "created_at")
    spark.createDataFrame([(-1, -1, True, datetime.datetime(2100, 1, 1))], r.schema) \
        .coalesce(1).write.mode("append").parquet(f"{base}/in")
    return _drain(T.stream_success_rate(_stream(spark, f"{base}/in", r.schema)), base)


@query("t3_stream_health_transitions", """
with o as (select server_id, probe_id as seq,
                  coalesce(min(case when status_code = 200 then t_us end), max(t_us)) as t_us,
                  bool_or(status_code = 200) as alive
           from fx_probes group by server_id, probe_id),
l as (select *, lag(alive) over (partition by server_id order by t_us, seq) as prev from o)
select server_id, seq, t_us, alive from l where alive <> coalesce(prev, true)""")
def t3_stream_health_transitions(fx):
    """Health transitions from a stream of probe outcomes; the last
    state per server is carried across micro-batches."""
    from reqlens.operators.series import probe_outcomes
    spark = fx.spark
    o = probe_outcomes(fx.fx_probes).select(F.col("server_id").cast("int"), F.col("seq").cast("bigint"),
                                            F.col("t_us").cast("bigint"), "alive")
    base = _folder(spark)
    _stage(o, f"{base}/in", "t_us")
    _finish(T.stream_health_transitions(_stream(spark, f"{base}/in", o.schema), f"{base}/out", f"{base}/ckpt"))
    return epochs.rows(spark, f"{base}/out")


@query("t6_stream_upsert_servers", """
with uu as (select pos, url, nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^:/?#]+)', 1), '') as host,
                   regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^:/?#]+:([^/?#]*)', 1) as pt
            from fx_config_urls),
inc as (select url, pos, host as ip_address,
               case when pt = '' then 80 when regexp_matches(pt, '^[0-9]{1,5}$') then cast(pt as integer) end as port
        from uu),
inc2 as (select ip_address, port, arg_min(url, pos) as url, min(pos) as pos, count(*) as cnt from inc
         where ip_address is not null and port is not null group by ip_address, port),
cur as (select *, cast(null as timestamp) as created_at, cast(null as timestamp) as updated_at from fx_servers),
upd as (select c.id, c.name, c.ip_address, c.port,
               case when i.url is not null then 'active' else c.status end as status,
               case when i.url is not null then true else c.is_active end as is_active,
               c.weight, c.capacity, c.created_at,
               case when i.url is not null then timestamp '2024-01-01 12:00:00' else c.updated_at end as updated_at
        from cur c left join inc2 i on i.ip_address = c.ip_address and i.port = c.port),
nw as (select i.* from inc2 i anti join cur c on c.ip_address = i.ip_address and c.port = i.port)
select * from upd
union all
select cast((select max(id) from cur) + row_number() over (order by pos, ip_address, port) as integer) as id,
       url as name, ip_address, port, 'active' as status, true as is_active, 1 as weight, 10 as capacity,
       timestamp '2024-01-01 12:00:00' as created_at,
       case when cnt > 1 then timestamp '2024-01-01 12:00:00' end as updated_at
from nw""")
def t6_stream_upsert_servers(fx):
    """Configured URLs arriving as a stream, upserted batch by batch
    (foreachBatch + S9) into the registry table; the final table is read
    back."""
    spark = fx.spark
    base = _folder(spark)
    reg = f"{base}/registry"
    fx.fx_servers.withColumn("created_at", F.lit(None).cast("timestamp_ntz")) \
        .withColumn("updated_at", F.lit(None).cast("timestamp_ntz")).coalesce(1).write.parquet(reg)
    urls = fx.fx_config_urls.withColumn("now", F.lit("2024-01-01 12:00:00"))
    _stage(urls, f"{base}/in", "pos")
    _finish(T.stream_upsert_servers(_stream(spark, f"{base}/in", urls.schema), reg, f"{base}/ckpt"))
    return T.read_registry(spark, reg)


@query("t8_stream_smooth", """
select id, server_id, t_us,
  round(least(greatest(list_reduce(list(cpu_usage) over w, lambda a, x: a * cast(0.7 as double) + x * cast(0.3 as double)), 0), 100), 1) as cpu,
  round(least(greatest(list_reduce(list(memory_usage) over w, lambda a, x: a * cast(0.7 as double) + x * cast(0.3 as double)), 0), 100), 1) as memory
from fx_metrics
window w as (partition by server_id order by t_us, id rows between 127 preceding and current row)""")
def t8_stream_smooth(fx):
    """Smoothed cpu / memory per server from the metric stream, the
    two smoothed values per server carried across micro-batches."""
    spark = fx.spark
    m = fx.fx_metrics.select("id", "server_id", "t_us", "cpu_usage", "memory_usage")
    base = _folder(spark)
    _stage(m, f"{base}/in", "t_us")
    _finish(T.stream_smooth(_stream(spark, f"{base}/in", m.schema), f"{base}/out", f"{base}/ckpt"))
    return epochs.rows(spark, f"{base}/out").select("id", "server_id", "t_us", "cpu", "memory")
