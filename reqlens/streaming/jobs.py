"""Structured Streaming jobs T1-T8.

Inputs are streaming DataFrames (file or message sources) with the batch
schemas.  Stateless and windowed jobs return the transformed streaming
DataFrame.  Jobs that carry state from one micro-batch to the next (T3, T6,
T8) start a ``foreachBatch`` query over versioned tables (:mod:`epochs`): a
batch is worked on by the batch operators, so a backlog of one server is
spread like any other table.  Watermarks are ours: the source stamps rows at
insert time, so 2 minutes of disorder is allowed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from reqlens.functions.scalars import clamp
from reqlens.operators import series as S
from reqlens.operators.sizing import broadcast_if_small, materialize
from reqlens.sources.logs import filter_logs, parse_logs
from reqlens.sources.registry import upsert_servers
from reqlens.streaming import epochs


def _event_time(df: DataFrame, ts: str, watermark: str) -> DataFrame:
    """Watermarks need TIMESTAMP; the tables carry TIMESTAMP_NTZ in UTC."""
    return df.withColumn("_et", F.col(ts).cast("timestamp")).withWatermark("_et", watermark)


def stream_rollup_1m(metrics: DataFrame, watermark: str = "2 minutes", ts: str = "created_at") -> DataFrame:
    """1-minute roll-up (A3) maintained incrementally; a window is
    emitted once the watermark passes its end (append mode)."""
    g = _event_time(metrics, ts, watermark).groupBy("server_id", F.window("_et", "1 minute").alias("w")).agg(
        F.avg("cpu_usage").alias("avg_cpu"), F.avg("memory_usage").alias("avg_memory"),
        F.sum("request_count").cast("bigint").alias("total_requests"),
        F.avg("success_rate").alias("avg_success_rate"))
    return g.select("server_id", F.col("w.start").cast("timestamp_ntz").alias("bucket"), "avg_cpu", "avg_memory",
                    "total_requests", "avg_success_rate")


def stream_success_rate(requests: DataFrame, width: str = "5 minutes", slide: str = "10 seconds",
                        watermark: str = "2 minutes", ts: str = "created_at") -> DataFrame:
    """Per-server success rate over sliding windows.  Rows are counted once
    per pane of the slide; only the panes, one row per server and slide, go to
    the windows that hold them."""
    panes = _event_time(requests, ts, watermark).groupBy("server_id", F.window("_et", slide).alias("p")).agg(
        F.count(F.lit(1)).alias("requests"), F.count_if("status").alias("successes"))
    g = panes.groupBy("server_id", F.window(F.window_time("p"), width, slide).alias("w")).agg(
        F.sum("requests").alias("requests"), F.sum("successes").alias("successes"))
    return g.select("server_id", F.col("w.start").cast("timestamp_ntz").alias("window_start"), "requests", "successes",
                    (F.col("successes") / F.col("requests")).alias("success_rate"))


def _stateful(stream: DataFrame, path: str, checkpoint: str, step: Callable, trigger: dict | None) -> StreamingQuery:
    """Runs ``step(batch, state) -> (rows, state)`` for every micro-batch; the
    state is the newest version of ``path/state``, None at first.  A batch that
    is run again either finds its own state and is done, or begins with the same
    state as before and writes the same versions over."""
    def batch(df: DataFrame, epoch: int) -> None:
        spark = df.sparkSession
        name, states = epochs.batch_name(spark, checkpoint, epoch), epochs.committed(spark, f"{path}/state")
        if name in states.values():
            return
        at = max(states, default=-1)
        rows, after = step(df, epochs.read(spark, f"{path}/state", at) if states else None)
        epochs.write(rows, f"{path}/rows", at + 1, name)
        epochs.write(after, f"{path}/state", at + 1, name)
        epochs.forget(spark, f"{path}/state", before=at)

    w = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return w.trigger(**(trigger or {"availableNow": True})).start()


def transitions_step(batch: DataFrame, state: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """T3 for one micro-batch.  The last state of each server (``server_id,
    alive``) goes before its rows, whatever their times, and a row is kept
    where it differs from the one before (W7)."""
    cols = ["server_id", "seq", "t_us", "alive"]
    rows = batch.select(*cols, F.struct(F.lit(1).alias("batch"), F.col("t_us")).alias("_at"))
    if state is not None:
        rows = rows.unionByName(state.select("server_id", F.lit(None).cast("bigint").alias("seq"), F.lit(None).cast(
            "bigint").alias("t_us"), "alive", F.struct(F.lit(0).alias("batch"), F.lit(None).cast("bigint").alias("t_us")).alias("_at")))
    rows = materialize(S.neighbor(rows, ["server_id"], "_at", "seq", ["alive"], "prev"))
    changed = rows.filter((F.col("_at.batch") == 1) & (F.col("alive") != F.coalesce("prev.alive", F.lit(True))))
    after = rows.groupBy("server_id").agg(F.max_by("alive", F.struct("_at", "seq")).alias("alive"))
    return changed.select(*cols), after


def stream_health_transitions(outcomes: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Health state changes per server (servers start alive), appended as
    versions below ``path`` (read them with ``epochs.rows(spark, path)``).  Rows are one
    per probe (``server_id, seq, t_us, alive``) and taken in order of time
    inside each micro-batch; the state is one row per server."""
    return _stateful(outcomes, path, checkpoint, transitions_step, trigger)


def stream_dedup(requests: DataFrame, key: str = "id", watermark: str = "2 minutes",
                 ts: str = "created_at") -> DataFrame:
    """T4: drop re-inserted request rows (same id within the watermark)."""
    return _event_time(requests, ts, watermark).dropDuplicatesWithinWatermark([key]).drop("_et")


def stream_logs(lines: DataFrame, line: str = "value", **filters) -> DataFrame:
    """T5: text lines -> parsed logs (S5) -> filters (P12); stateless."""
    if line != "line":
        lines = lines.withColumnRenamed(line, "line")
    return filter_logs(parse_logs(lines), **filters)


def stream_upsert_servers(incoming: DataFrame, registry_path: str, checkpoint: str, now_col: str = "now",
                          trigger: dict | None = None) -> StreamingQuery:
    """Each micro-batch of URLs is upserted (S9) into the registry, a
    table of versions: the newest version with the batch merged in is written
    beside it as the next one.  It counts once its mark is there, so a reader
    (:func:`read_registry`) sees the old table or the new one, also when the job
    dies between the two; a batch that is run again is known by its mark or
    written over.  A plain table at ``registry_path`` is the version before all."""
    def batch(df: DataFrame, epoch: int) -> None:
        spark, versions = df.sparkSession, f"{registry_path}/_versions"
        made = epochs.committed(spark, versions)
        name = epochs.batch_name(spark, checkpoint, epoch)
        if name in made.values() or df.isEmpty():
            return
        now = df.agg(F.max(now_col)).first()[0]
        merged = upsert_servers(read_registry(spark, registry_path), df, str(now))
        epochs.write(merged, versions, max(made, default=-1) + 1, name)

    w = incoming.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    w = w.trigger(**(trigger or {"availableNow": True}))
    return w.start()


def read_registry(spark, registry_path: str) -> DataFrame:
    """The registry's newest version."""
    at = epochs.latest(spark, f"{registry_path}/_versions")
    return spark.read.parquet(registry_path) if at < 0 else epochs.read(spark, f"{registry_path}/_versions", at)


def stream_join_servers(requests: DataFrame, servers: DataFrame) -> DataFrame:
    """Stream-static enrichment with the registry (size-checked
    broadcast)."""
    s = servers.select(F.col("id").alias("server_id"), "name", "weight", "capacity")
    return requests.join(broadcast_if_small(s), "server_id", "inner")


def _one_decimal(x):
    """P8 as the sampler computes it: the tenth nearest to ten times the double,
    which a value a last bit below .x5 reaches too."""
    return F.signum(x) * F.floor(F.abs(x) * 10 + 0.5) / 10


def smooth_step(alpha: float = 0.3) -> Callable:
    """T8 for one micro-batch: the smoothed values so far (``server_id, s_cpu,
    s_memory``) are the first row of each server, and the batch goes on from
    there by the scan of W1."""
    def step(batch: DataFrame, state: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        rows = batch.select("server_id", "id", "t_us", F.col("cpu_usage").cast("double").alias("cpu"),
                            F.col("memory_usage").cast("double").alias("memory"),
                            F.struct(F.lit(1).alias("batch"), F.col("t_us")).alias("_at"))
        if state is not None:
            none = F.lit(None).cast("bigint")
            rows = rows.unionByName(state.select("server_id", none.alias("id"), none.alias("t_us"), F.col("s_cpu").alias("cpu"),
                                                 F.col("s_memory").alias("memory"),
                                                 F.struct(F.lit(0).alias("batch"), none.alias("t_us")).alias("_at")))
        out = materialize(S.recurrence(rows, {"s_cpu": "cpu", "s_memory": "memory"}, ["server_id"], "_at", "id", alpha))
        told = out.filter("_at.batch = 1").select("server_id", "id", "t_us", *[
            _one_decimal(clamp(F.col("s_" + c))).alias(c) for c in ("cpu", "memory")])
        last = F.struct("_at", "id")
        return told, out.groupBy("server_id").agg(F.max_by("s_cpu", last).alias("s_cpu"),
                                                  F.max_by("s_memory", last).alias("s_memory"))
    return step


def stream_smooth(samples: DataFrame, path: str, checkpoint: str, alpha: float = 0.3,
                  trigger: dict | None = None) -> StreamingQuery:
    """Exponentially smoothed cpu / memory per server (W1) carried across
    micro-batches, appended as versions below ``path`` (read them with
    ``epochs.rows(spark, path)``).  The state is one row per server: two doubles."""
    return _stateful(samples, path, checkpoint, smooth_step(alpha), trigger)
