"""Streaming jobs against their batch operators: the fixture views are
written once as several Parquet files in time order and drained with
``availableNow``; windowed jobs get a sentinel row far in the future, in a
later file, so the watermark closes every real window."""

import datetime

import pytest
from pyspark.sql import functions as F

from reqlens.operators import aggs as A
from reqlens.operators import series as S
from reqlens.streaming import epochs
from reqlens.streaming import jobs as T


def write_chunks(df, path, order, n=4):
    """Split ``df`` into ``n`` files by time rank (file i holds the i-th slice)."""
    pdf = df.toPandas().sort_values(order).reset_index(drop=True)
    size = -(-len(pdf) // n)
    spark = df.sparkSession
    for i in range(n):
        part = pdf.iloc[i * size:(i + 1) * size]
        if len(part):
            spark.createDataFrame(part, df.schema).coalesce(1).write.mode("append").parquet(path)
    return df.schema


def drain(sdf, scratch, name, mode="append"):
    rows = []

    def collect(batch, epoch):
        rows.extend(batch.collect())

    q = (sdf.writeStream.outputMode(mode).foreachBatch(collect)
         .option("checkpointLocation", f"{scratch}/ckpt_{name}").trigger(availableNow=True).start())
    q.awaitTermination(300)
    return rows


def stream_of(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_t1_rollup_equals_batch(spark, fx, scratch):
    m = fx.fx_metrics.select("id", "server_id", "cpu_usage", "memory_usage", "request_count", "success_rate",
                             "created_at")
    path = f"{scratch}/metrics"
    schema = write_chunks(m, path, ["created_at"])
    sentinel = spark.createDataFrame([(10**12, 1, 0.0, 0.0, 0, 1.0, datetime.datetime(2030, 1, 1))], schema)
    sentinel.coalesce(1).write.mode("append").parquet(path)
    got = drain(T.stream_rollup_1m(stream_of(spark, path, schema)), scratch, "t1")
    want = A.rollup_1m(m).collect()
    key = lambda r: (r["server_id"], r["bucket"])
    g = {key(r): (r["total_requests"], round(r["avg_cpu"], 6)) for r in got}
    w = {key(r): (r["total_requests"], round(r["avg_cpu"], 6)) for r in want}
    assert g == w


def test_t3_transitions_equal_batch(spark, fx, scratch):
    o = S.probe_outcomes(fx.fx_probes)
    path = f"{scratch}/outcomes"
    schema = write_chunks(o, path, ["t_us", "seq"])
    T.stream_health_transitions(stream_of(spark, path, schema), f"{scratch}/out3", f"{scratch}/ckpt3").awaitTermination(300)
    got = epochs.rows(spark, f"{scratch}/out3").collect()
    assert len(epochs.committed(spark, f"{scratch}/out3/rows")) == 4
    want = S.health_transitions(o).collect()
    assert sorted((r["server_id"], r["seq"], r["alive"]) for r in got) == \
        sorted((r["server_id"], r["seq"], r["alive"]) for r in want)


def test_t4_dedup(spark, fx, scratch):
    r = fx.fx_requests.select("id", "server_id", "status", "created_at")
    path = f"{scratch}/req"
    schema = write_chunks(r.unionAll(r), path, ["created_at", "id"])
    got = drain(T.stream_dedup(stream_of(spark, path, schema)), scratch, "t4")
    assert sorted(x["id"] for x in got) == sorted(x["id"] for x in r.collect())


def test_t5_logs_equal_batch(spark, fx, scratch):
    from reqlens.sources.logs import filter_logs, parse_logs
    lines = fx.fx_log_lines.select("line")
    path = f"{scratch}/lines"
    for i, chunk in enumerate(lines.randomSplit([0.5, 0.5], seed=1)):
        chunk.coalesce(1).write.mode("append").text(path)
    s = spark.readStream.text(path)
    got = drain(T.stream_logs(s, min_status=500), scratch, "t5")
    want = filter_logs(parse_logs(lines), min_status=500).count()
    assert len(got) == want and all(r["status"] >= 500 for r in got)


def test_t6_upsert_idempotent(spark, fx, scratch):
    reg = f"{scratch}/registry"
    fx.fx_servers.withColumn("created_at", F.lit(None).cast("timestamp_ntz")) \
        .withColumn("updated_at", F.lit(None).cast("timestamp_ntz")).write.parquet(reg)
    urls = fx.fx_config_urls.withColumn("now", F.lit("2024-01-01 12:00:00"))
    src = f"{scratch}/urls"
    urls.coalesce(2).write.parquet(src)
    for run in range(2):  # two queries: the second goes on from the first one's version
        q = T.stream_upsert_servers(spark.readStream.schema(urls.schema).parquet(src), reg, f"{scratch}/ck{run}")
        q.awaitTermination(300)
        n = T.read_registry(spark, reg).count()
    from reqlens.sources.registry import upsert_servers
    assert n == upsert_servers(fx.fx_servers, fx.fx_config_urls, "2024-01-01 12:00:00").count()


def test_t7_join_equals_batch(spark, fx, scratch):
    from reqlens.operators.joins import join_servers
    r = fx.fx_requests.select("id", "server_id", "status", "created_at")
    path = f"{scratch}/req7"
    schema = write_chunks(r, path, ["created_at"])
    got = drain(T.stream_join_servers(stream_of(spark, path, schema), fx.fx_servers), scratch, "t7")
    assert len(got) == join_servers(r, fx.fx_servers).count()


def test_t8_smooth_equals_batch(spark, fx, scratch):
    m = fx.fx_metrics.select("id", "server_id", "t_us", "cpu_usage", "memory_usage")
    path = f"{scratch}/samples"
    schema = write_chunks(m, path, ["t_us", "id"])
    T.stream_smooth(stream_of(spark, path, schema), f"{scratch}/out8", f"{scratch}/ckpt8").awaitTermination(300)
    got = {r["id"]: r["cpu"] for r in epochs.rows(spark, f"{scratch}/out8").collect()}
    want = {r["id"]: r["smoothed"] for r in S.smooth(m, "cpu_usage", ["server_id"], "t_us", "id").collect()}
    assert got.keys() == want.keys()
    assert max(abs(got[k] - want[k]) for k in got) <= 0.1 + 1e-9


@pytest.mark.parametrize("width", ["5 minutes"])
def test_t2_sliding_success_rate(spark, fx, scratch, width):
    r = fx.fx_requests.select("id", "server_id", "status", "created_at")
    path = f"{scratch}/req2"
    schema = write_chunks(r, path, ["created_at"])
    spark.createDataFrame([(10**12, 1, True, datetime.datetime(2030, 1, 1))], schema) \
        .coalesce(1).write.mode("append").parquet(path)
    got = drain(T.stream_success_rate(stream_of(spark, path, schema), width=width), scratch, "t2")
    want = r.groupBy("server_id", F.window("created_at", width, "10 seconds")).count().count()
    assert len(got) == want


def test_a_backlog_of_one_server_is_spread_and_replays(spark):
    """One server's micro-batch is cut like any table, and the same batch after
    the same state gives the same rows and state."""
    n = 20_000
    b = spark.range(n).selectExpr("1 as server_id", "id as seq", "id div 50 as t_us", "(id div 7) % 3 > 0 as alive")
    state = spark.createDataFrame([(1, False), (2, True)], "server_id int, alive boolean")
    rows, after = T.transitions_step(b, state)
    before, want = False, []
    for k in range(n):
        alive = (k // 7) % 3 > 0
        if alive != before:
            want.append((1, k, k // 50, alive))
        before = alive
    assert sorted(tuple(r) for r in rows.collect()) == want
    assert {tuple(r) for r in after.collect()} == {(1, before), (2, True)}
    assert sorted(tuple(r) for r in T.transitions_step(b, state)[0].collect()) == want
    m = spark.range(n).selectExpr("1 as server_id", "id", "id div 50 as t_us", "cast(id % 90 as double) as cpu_usage",
                                  "cast(id % 70 as double) as memory_usage")
    had = spark.createDataFrame([(1, 50.0, 10.0)], "server_id int, s_cpu double, s_memory double")
    told, after = T.smooth_step(0.3)(m, had)
    cpu, mem, want = 50.0, 10.0, {}
    for k in range(n):
        cpu, mem = 0.7 * cpu + 0.3 * (k % 90), 0.7 * mem + 0.3 * (k % 70)
        want[k] = (cpu, mem)
    got = {r["id"]: (r["cpu"], r["memory"]) for r in told.collect()}
    assert got.keys() == want.keys() and all(abs(got[k][j] - want[k][j]) <= 0.0501 for k in want for j in (0, 1))
    last = after.collect()[0]
    assert abs(last.s_cpu - cpu) < 1e-9 and abs(last.s_memory - mem) < 1e-9


def test_a_registry_version_is_whole_or_absent(spark, fx, scratch, monkeypatch):
    """A job that dies between writing a version and committing it leaves the
    old registry; running the batch again gives the new one."""
    reg = f"{scratch}/reg"
    fx.fx_servers.withColumn("created_at", F.lit(None).cast("timestamp_ntz")) \
        .withColumn("updated_at", F.lit(None).cast("timestamp_ntz")).write.parquet(reg)
    old = sorted(map(str, T.read_registry(spark, reg).collect()))
    urls = fx.fx_config_urls.withColumn("now", F.lit("2024-01-01 12:00:00"))
    urls.coalesce(1).write.parquet(f"{scratch}/in")
    src = spark.readStream.schema(urls.schema).parquet(f"{scratch}/in")

    def dies(df, base, version, batch):
        df.write.mode("overwrite").parquet(f"{base}/version={version:010d}")
        raise RuntimeError("lost the driver")

    with monkeypatch.context() as m:
        m.setattr(epochs, "write", dies)
        q = T.stream_upsert_servers(src, reg, f"{scratch}/ck")
        with pytest.raises(Exception, match="lost the driver"):
            q.awaitTermination(300)
    assert sorted(map(str, T.read_registry(spark, reg).collect())) == old
    for _ in range(2):  # the batch that died, then nothing new
        T.stream_upsert_servers(src, reg, f"{scratch}/ck").awaitTermination(300)
    assert list(epochs.committed(spark, f"{reg}/_versions")) == [0]
    from reqlens.sources.registry import upsert_servers
    want = upsert_servers(fx.fx_servers, fx.fx_config_urls, "2024-01-01 12:00:00").count()
    assert T.read_registry(spark, reg).count() == want > len(old)


def test_a_batch_that_runs_again_counts_once(spark, scratch, monkeypatch):
    """A job that dies between the rows and the state of a batch, and one that
    dies after both: running on gives the rows of one pass."""
    schema = "server_id int, seq long, t_us long, alive boolean"
    parts = [[(1, 1, 10, False), (2, 2, 11, True)], [(1, 3, 20, False), (2, 4, 21, False)], [(1, 5, 30, True)]]
    real, calls = epochs.write, []

    def dies(df, base, version, batch):
        calls.append(base)
        if len(calls) == 4:
            raise RuntimeError("before the state")
        real(df, base, version, batch)
        if len(calls) == 7:
            raise RuntimeError("after the state")

    monkeypatch.setattr(epochs, "write", dies)
    for k, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{scratch}/in")
        for _ in range(3):
            q = T.stream_health_transitions(spark.readStream.schema(schema).parquet(f"{scratch}/in"), f"{scratch}/out", f"{scratch}/ck")
            try:
                q.awaitTermination(300)
            except Exception as e:  # noqa: BLE001
                assert "the state" in str(e)
    assert len(calls) >= 7
    assert sorted(tuple(r) for r in epochs.rows(spark, f"{scratch}/out").collect()) == [
        (1, 1, 10, False), (1, 5, 30, True), (2, 4, 21, False)]
