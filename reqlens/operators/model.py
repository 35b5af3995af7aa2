"""Model features, training and scoring (M1, M3-M10) on Spark ML.

The scoring model is re-aimed from a small feed-forward network to Spark
ML regressors (gradient-boosted trees with early stopping on a validation
column, or linear regression); the network itself, ONNX export and the
scoring HTTP server are not built.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reqlens.functions.scalars import stable_hash
from reqlens.operators.aggs import FEATURES, sliding
from reqlens.operators.scaler import PopulationScaler, population_std
from reqlens.operators.sizing import broadcast_if_small, materialize
from reqlens.operators.timebucket import floor_div, inflight, interval_lookup, micros_ts, running_sum


# --- M1 -----------------------------------------------------------------------

def check_manifest(columns: Sequence[str], features: Sequence[str] = FEATURES) -> list[str]:
    """M1: the feature list must have exactly six names, no duplicates, the
    training order and the training set.  Raises ValueError otherwise."""
    cols = list(columns)
    if len(cols) != len(FEATURES):
        raise ValueError(f"expected {len(FEATURES)} features, got {len(cols)}")
    if len(set(cols)) != len(cols):
        raise ValueError("duplicate feature names")
    if set(cols) != set(features):
        raise ValueError(f"feature set differs: {sorted(set(cols) ^ set(features))}")
    if cols != list(features):
        raise ValueError("feature order differs from training order")
    return cols


# --- M3 / M4 / M5 / M9 -------------------------------------------------------------

def split(df: DataFrame, key: str, train_pct: int = 80, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """M3: deterministic split by a hash of the key (stable under
    repartitioning and re-execution)."""
    h = F.pmod(stable_hash(key, seed), F.lit(100))
    return df.filter(h < train_pct), df.filter(h >= train_pct)


def fit_scaler(train: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """M4: one-row scaler: per-feature mean and population std (the
    standard-scaler definition; Spark ML's StandardScaler uses the sample
    std)."""
    return train.agg(
        F.array(*[F.avg(F.col(c).cast("double")) for c in features]).alias("mean"),
        F.array(*[population_std(F.col(c).cast("double")) for c in features]).alias("scale"))


def apply_scaler(df: DataFrame, scaler, features: Sequence[str] = FEATURES, suffix: str = "_scaled") -> DataFrame:
    """M5: ``(x - mean) / scale``, 0 where the scale is 0.  ``scaler`` is
    the one-row frame of :func:`fit_scaler` (12 numbers, read once) or a
    dict with ``mean`` / ``scale`` lists."""
    if isinstance(scaler, DataFrame):
        row = scaler.first()
        scaler = {"mean": list(row["mean"]), "scale": list(row["scale"])}
    out = df
    for c, m, s in zip(features, scaler["mean"], scaler["scale"]):
        x = (F.col(c).cast("double") - F.lit(float(m or 0.0)))
        out = out.withColumn(c + suffix, F.lit(0.0) if not s else x / F.lit(float(s)))
    return out


def mae(df: DataFrame, y: str, pred: str = "prediction") -> DataFrame:
    """M9: mean absolute error."""
    return df.agg(F.avg(F.abs(F.col(y) - F.col(pred))).alias("mae"), F.count(F.lit(1)).alias("rows"))


# --- M6 / M7 ------------------------------------------------------------------

def fit_score_model(train: DataFrame, features: Sequence[str] = FEATURES, target: str = "target",
                    kind: str = "gbt", validation_col: str | None = None, seed: int = 42) -> PipelineModel:
    """M6: regression of the composite target on the standard-scaled features
    (M4 + M5, fitted on these rows and kept in the pipeline).  ``gbt`` stops
    early on the validation rows when ``validation_col`` is given.  Rows with a
    null target are left out of the fit."""
    check_manifest(features)
    scaled = [c + "_scaled" for c in features]
    scaler = PopulationScaler(inputCols=list(features), outputCols=scaled)
    va = VectorAssembler(inputCols=scaled, outputCol="features", handleInvalid="keep")
    if kind == "gbt":
        est = GBTRegressor(featuresCol="features", labelCol=target, maxIter=50, maxDepth=4, seed=seed,
                           lossType="squared")
        if validation_col:
            est = est.setValidationIndicatorCol(validation_col)
    elif kind == "linear":
        est = LinearRegression(featuresCol="features", labelCol=target, regParam=0.01)
    else:
        raise ValueError(f"unknown model kind: {kind}")
    # Rows without a label (no metric sample in any of their requests) cannot train.
    return Pipeline(stages=[scaler, va, est]).fit(train.filter(F.col(target).isNotNull() & ~F.isnan(target)))


def score(df: DataFrame, model: PipelineModel, features: Sequence[str] = FEATURES) -> DataFrame:
    """M7: batch scoring; one prediction per input row.  An empty input is
    an error, as in the scoring service."""
    check_manifest(features)
    if df.isEmpty():
        raise ValueError("empty scoring input")
    out = model.transform(df)
    return out.drop("features", *[c + "_scaled" for c in features]).withColumnRenamed("prediction", "score")


# --- M8 -----------------------------------------------------------------------

def memo_key(snapshots: DataFrame, decision: str = "tick") -> DataFrame:
    """M8: memo key per decision: ``id|cpu(2dp)|mem(2dp)|`` of every healthy
    server of the pool, concatenated in pool order (all of them when the
    snapshots have no ``alive`` flag).  A decision has one row per pool server,
    so each group is bounded by the pool size."""
    if "alive" in snapshots.columns:
        snapshots = snapshots.filter("alive")
    piece = F.format_string("%d|%.2f|%.2f|", F.col("server_id"), F.col("cpu_usage"), F.col("memory_usage"))
    g = snapshots.groupBy(decision).agg(F.array_sort(F.collect_list(F.struct("pos", piece.alias("p")))).alias("_k"))
    return g.select(decision, F.array_join(F.transform("_k", lambda x: x["p"]), "").alias("memo_key"))


def memo_hits(keys: DataFrame, decision: str = "tick") -> DataFrame:
    """M8: a decision is a memo hit when its key was first seen at an
    earlier decision (unbounded memo: LRU eviction not modelled)."""
    first = keys.groupBy("memo_key").agg(F.min(decision).alias("_first"))
    j = keys.join(first, "memo_key", "inner")
    return j.select(decision, "memo_key", (F.col(decision) > F.col("_first")).alias("hit"))


def score_memoised(snapshots: DataFrame, model: PipelineModel, decision: str = "tick_us",
                   features=FEATURES) -> DataFrame:
    """M8: score each distinct memo key once, with the features of the
    decision that first produced it, and give every decision with that key
    the cached scores (per pool position).  Rows: (decision, server_id,
    pos, score, memo_hit)."""
    keys = memo_key(snapshots, decision)
    hits = memo_hits(keys, decision)
    first = hits.filter(~F.col("hit")).select(decision, "memo_key")
    scored = score(snapshots.join(first, decision, "inner"), model, features) \
        .select("memo_key", "pos", "server_id", "score")
    out = hits.join(scored, "memo_key", "inner")
    return out.select(decision, "server_id", "pos", "score", F.col("hit").alias("memo_hit"))


# --- M10 ----------------------------------------------------------------------

def decision_snapshots(metrics: DataFrame, intervals: DataFrame, requests: DataFrame,
                       health_runs: DataFrame, pool: DataFrame, step_s: int = 15,
                       lookback_s: int = 300, p95_window_s: int = 300, slide_s: int = 60) -> DataFrame:
    """What the model strategy sees per pool server at each 15-s tick:
    cpu / memory (latest sample within the look-back, W6, else 0), active
    connections (requests in flight at the tick, W5), blended error rate
    (failures so far, W2), p95 latency of the last complete 5-minute window
    (sliding by 1 minute), alive flag (outside the W7 down runs), weight and
    capacity.

    Rows are (server, tick): the table grows with time x servers, not with
    requests."""
    from reqlens.operators.series import gauge_at_ticks

    step = int(step_s) * 1_000_000
    m = metrics.withColumn("cm", F.struct("cpu_usage", "memory_usage"))
    g = gauge_at_ticks(m, ["server_id"], "t_us", "cm", "id", step_s, lookback_s)
    seen = g.select("server_id", F.unix_micros(F.col("tick").cast("timestamp")).alias("tick_us"),
                    F.col("cm.cpu_usage").alias("cpu_usage"), F.col("cm.memory_usage").alias("memory_usage"))
    # every pool server at every tick, sampled or not
    lo, hi = metrics.agg(F.min("t_us"), F.max("t_us")).first()
    ticks = F.sequence(F.lit(-(-lo // step)), F.lit((hi + lookback_s * 1_000_000) // step)) if lo is not None \
        else F.array().cast("array<bigint>")
    grid = pool.select("server_id", "pos", "weight", "capacity", F.explode(ticks).alias("_k")) \
        .withColumn("tick_us", F.col("_k").cast("bigint") * F.lit(step)).drop("_k") \
        .withColumn("tick", micros_ts("tick_us"))
    # alive flag: not inside a down run of the W7 health runs (servers start
    # alive); runs of one server never overlap, so a point lookup suffices.
    down = health_runs.filter(~F.col("alive")).select("server_id", "start_us", "end_us")
    grid = interval_lookup(grid, down, ["server_id"], "tick_us", name="_down")
    grid = grid.withColumn("alive", F.col("_down").isNull()).drop("_down")
    snap = grid.join(seen, ["server_id", "tick_us"], "left").fillna(0.0, ["cpu_usage", "memory_usage"])
    # active connections at the tick
    snap = materialize(inflight(intervals, ["server_id"], "start_us", "end_us", points=snap, point_us="tick_us",
                                name="conns"))  # read twice below (points of the error-rate running sum)
    # failures so far -> blended error rate
    fails = requests.filter(~F.col("status")).select("server_id", F.col("t_us").alias("_t"), F.lit(1).alias("_v"),
                                                     F.lit(0).alias("_side"), F.lit(None).cast("bigint").alias("tick_us"))
    pts = snap.select("server_id", F.col("tick_us").alias("_t"), F.lit(0).alias("_v"), F.lit(1).alias("_side"),
                      "tick_us")
    k = running_sum(fails.unionByName(pts), F.col("_v"), ["server_id"], "_t", "_side", name="_k") \
        .filter(F.col("_side") == 1).select("server_id", "tick_us", "_k")
    snap = snap.join(k, ["server_id", "tick_us"], "left") \
               .withColumn("error_rate", 1 - F.pow(F.lit(0.9), F.coalesce(F.col("_k"), F.lit(0)))).drop("_k")
    # p95 of the last complete sliding window, from counts per latency and slide
    W, S = int(p95_window_s) * 1_000_000, int(slide_s) * 1_000_000
    times = sliding(requests.filter(F.col("response_time_ms").isNotNull()), ["server_id", "response_time_ms"], "created_at",
                    f"{p95_window_s} seconds", f"{slide_s} seconds", {"_n": F.count(F.lit(1))}, {"_n": F.sum("_n")})
    pw = times.groupBy("server_id", "window_start").agg(
        F.percentile(F.col("response_time_ms").cast("double"), F.lit(0.95), F.col("_n")).alias("response_p95"))
    pw = pw.select("server_id", (F.unix_micros(F.col("window_start").cast("timestamp")) + W).alias("_end"), "response_p95")
    snap = snap.withColumn("_end", floor_div(F.col("tick_us"), S) * S)
    snap = snap.join(pw, ["server_id", "_end"], "left").drop("_end") \
               .withColumn("response_p95", F.coalesce("response_p95", F.lit(0.0)))
    return snap.select("server_id", "tick", "tick_us", "pos", "cpu_usage", "memory_usage",
                       F.col("conns").cast("bigint").alias("active_conns"), "error_rate", "response_p95",
                       "weight", "capacity", "alive")


def pick_per_tick(snapshots: DataFrame, score_col: str = "score") -> DataFrame:
    """R5 per decision tick: lowest score among alive servers with
    ``active_conns < capacity``; first in pool order on equal scores."""
    ok = snapshots.filter(F.col("alive") & (F.col("active_conns") < F.col("capacity")))
    return ok.groupBy("tick_us").agg(F.min_by("server_id", F.struct(score_col, "pos")).alias("model_choice"))


def route_by_model(requests: DataFrame, picks: DataFrame, fallback: DataFrame, step_s: int = 15,
                   arrival_us: str = "arrival_us") -> DataFrame:
    """Each request takes the model choice of the latest tick at or
    before its arrival; without one (no eligible server or no snapshot) the
    fallback assignment (weighted round robin) applies."""
    step = int(step_s) * 1_000_000
    r = requests.withColumn("tick_us", floor_div(F.col(arrival_us), step) * step)
    # one row per tick: broadcast when small, so a busy tick is not one task;
    # beyond the bound a shuffle join (AQE splits skewed partitions)
    r = r.join(broadcast_if_small(picks), "tick_us", "left")
    fb = fallback.select("id", F.col("assigned").alias("_fb"))
    r = r.join(fb, "id", "left")
    return r.select(*requests.columns, F.coalesce("model_choice", "_fb").alias("assigned"),
                    F.when(F.col("model_choice").isNotNull(), "model").otherwise("fallback").alias("source"))


__all__ = ["check_manifest", "split", "fit_scaler", "apply_scaler", "mae", "fit_score_model", "score",
           "memo_key", "memo_hits", "decision_snapshots", "pick_per_tick", "route_by_model", "micros_ts"]
