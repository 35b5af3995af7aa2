"""Hand-built cases: the reference's own test values and the boundary rows
listed for each operator."""

import pytest
from pyspark.sql import functions as F

from reqlens.functions import scalars as P
from reqlens.operators import aggs as A
from reqlens.operators import joins as J
from reqlens.operators import model as M
from reqlens.operators import routing as R
from reqlens.operators import series as S
from reqlens.operators.timebucket import asof_left, inflight, ordered_index, running_count
from reqlens.sources import logs as L
from reqlens.sources import readers as IO
from reqlens.sources import registry as REG

SEC = 1_000_000


def pool_df(spark, n, weights=None, capacity=100):
    rows = [(i, f"http://backend-{i}:800{i}", f"backend-{i}", 8000 + i, "active", True,
             (weights[i - 1] if weights else 1), capacity) for i in range(1, n + 1)]
    servers = spark.createDataFrame(rows, "id int, name string, ip_address string, port int, status string, "
                                          "is_active boolean, weight int, capacity int")
    return R.make_pool(servers)


def requests_df(spark, n):
    return spark.createDataFrame([(i, 1, i * SEC, i * SEC + 1) for i in range(n)],
                                 "id long, server_id int, arrival_us long, end_us long")


# --- routing -------------------------------------------------------------------

def test_round_robin_exact(spark):
    out = R.round_robin(requests_df(spark, 300), pool_df(spark, 3))
    counts = {r["assigned"]: r["count"] for r in out.groupBy("assigned").count().collect()}
    assert counts == {1: 100, 2: 100, 3: 100}


def test_round_robin_empty_pool(spark):
    empty = pool_df(spark, 1).limit(0)
    out = R.round_robin(requests_df(spark, 5), empty)
    assert [r["assigned"] for r in out.collect()] == [None] * 5


def test_weighted_round_robin_ratio(spark):
    out = R.weighted_round_robin(requests_df(spark, 400), pool_df(spark, 2, weights=[3, 1]))
    counts = {r["assigned"]: r["count"] for r in out.groupBy("assigned").count().collect()}
    assert counts == {1: 300, 2: 100}
    assert 2.5 <= counts[1] / counts[2] <= 3.5


def test_random_spreads(spark):
    out = R.random_pick(requests_df(spark, 1000), pool_df(spark, 10))
    assert out.select("assigned").distinct().count() >= 8


def test_least_connections_lowest(spark):
    # servers 1, 2, 3 carry 10, 2 and 7 open requests at t = 500 s
    rows, i = [], 0
    for sid, n in ((1, 10), (2, 2), (3, 7)):
        for _ in range(n):
            rows.append((i, sid, 0, 1000 * SEC))
            i += 1
    rows.append((999, 1, 500 * SEC, 600 * SEC))  # the arriving request itself
    req = spark.createDataFrame(rows, "id long, server_id int, arrival_us long, end_us long")
    out = R.least_connections(req, pool_df(spark, 3), bucket_us=60 * SEC)
    r = out.filter("id = 999").collect()[0]
    assert r["assigned"] == 2 and r["assigned_conns"] == 2


def test_weights_default_to_one(spark):
    servers = spark.createDataFrame(
        [(1, "a", True, 0, None), (2, "b", True, -1, None), (3, "c", True, None, None)],
        "id int, name string, is_active boolean, weight int, capacity int")
    p = R.make_pool(servers).collect()
    assert {r["weight"] for r in p} == {1} and {r["capacity"] for r in p} == {10}


def test_unknown_policy(spark):
    with pytest.raises(ValueError):
        R.assign(requests_df(spark, 1), pool_df(spark, 1), "fastest")


# --- aggregations ----------------------------------------------------------------

def test_readiness_no_servers(spark):
    inv = spark.createDataFrame([], "server_id int, alive boolean")
    r = A.readiness(inv).collect()[0]
    assert (r["status"], r["total"], r["healthy"]) == ("not ready", 0, 0)


def test_histogram_demo_counts(spark):
    d = spark.createDataFrame([(0.040,)] * 42 + [(0.080,)] * 8, "d double")
    h = {r["le"]: r["bucket_count"] for r in A.latency_histogram(d, "d", [], A.REQUEST_DURATION_EDGES).collect()}
    assert h["0.05"] == 42 and h["0.1"] == 50 and h["+Inf"] == 50


def test_histogram_quantile_rules(spark):
    d = spark.createDataFrame([(0.040,)] * 42 + [(0.080,)] * 8, "d double")
    h = A.latency_histogram(d, "d", [], A.REQUEST_DURATION_EDGES)
    v = A.histogram_quantile(h, 0.5, []).collect()[0]["quantile_value"]
    assert v == pytest.approx(0.025 + 0.025 * 25 / 42)
    big = spark.createDataFrame([(10.0,)] * 5, "d double")
    hb = A.latency_histogram(big, "d", [], A.REQUEST_DURATION_EDGES)
    assert A.histogram_quantile(hb, 0.95, []).collect()[0]["quantile_value"] == 5.0


def test_success_rate_edges(spark):
    servers = spark.createDataFrame([(1,), (2,)], "id int")
    req = spark.createDataFrame([
        (1, True, "2024-01-01 00:55:00"),   # exactly as_of - window: excluded
        (1, False, "2024-01-01 00:57:00"),
        (1, True, "2024-01-01 00:58:00")], "server_id int, status boolean, created_at string") \
        .withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))
    out = {r["server_id"]: r["success_rate"] for r in
           A.success_rate(req, servers, "2024-01-01 01:00:00", 300).collect()}
    assert out == {1: 0.5, 2: 1.0}


# --- as-of and time series -------------------------------------------------------

def test_asof_edges(spark):
    tol = 120 * SEC
    r = spark.createDataFrame([(1, 1, 1000 * SEC), (2, 2, 1000 * SEC), (3, 3, 1000 * SEC), (4, 4, 1000 * SEC)],
                              "rid long, server_id int, t long")
    m = spark.createDataFrame([
        (10, 1, 1000 * SEC - tol, 1.0),        # exactly t - 2 min: match
        (11, 2, 1000 * SEC, 2.0),              # exactly t: match
        (12, 3, 1000 * SEC - tol - 1, 3.0),    # 1 us too old: no match
        (13, 4, 990 * SEC, 4.0), (14, 4, 990 * SEC, 5.0)],  # tie on time: higher id
        "id long, server_id int, t long, v double")
    for bucket in (None, tol // 4, tol * 3):
        out = {x["rid"]: x["v"] for x in asof_left(r, m, ["server_id"], "t", "t", tol, ["v"], tie="id",
                                                   bucket_us=bucket).collect()}
        assert out == {1: 1.0, 2: 2.0, 3: None, 4: 5.0}


def test_breaker_intervals(spark):
    calls = spark.createDataFrame([(1, "error", 0), (2, "error", 10 * SEC), (3, "ok", 20 * SEC),
                                   (4, "error", 60 * SEC)], "id long, outcome string, t_us long")
    out = sorted((r["open_us"], r["close_us"]) for r in S.breaker_intervals(calls).collect())
    assert out == [(0, 20 * SEC), (60 * SEC, 90 * SEC)]


def test_error_blend(spark):
    req = spark.createDataFrame([(1, 1, False, 1), (2, 1, True, 2), (3, 1, False, 3)],
                                "id long, server_id int, status boolean, t_us long")
    out = [round(r["error_rate"], 10) for r in S.error_blend(req).orderBy("t_us").collect()]
    assert out == [0.1, 0.1, 0.19]


def test_smoothing(spark):
    d = spark.createDataFrame([(1, 1, 1, 10.0), (2, 1, 2, 20.0), (3, 1, 3, 20.0)],
                              "id long, server_id int, t_us long, cpu double")
    out = [r["smoothed"] for r in S.smooth(d, "cpu", ["server_id"], "t_us", "id").orderBy("t_us").collect()]
    assert out == [10.0, 13.0, 15.1]


def test_smoothing_chunk_boundary(spark):
    vals = [(i, 1, i, float((i * 37) % 100)) for i in range(400)]
    d = spark.createDataFrame(vals, "id long, server_id int, t_us long, cpu double")
    a = [r["smoothed"] for r in S.smooth(d, "cpu", ["server_id"], "t_us", "id").orderBy("t_us").collect()]
    b = [r["smoothed"] for r in S.smooth(d, "cpu", ["server_id"], "t_us", "id", chunk=150).orderBy("t_us").collect()]
    s, exact = None, []
    for _, _, _, x in vals:
        s = x if s is None else 0.7 * s + 0.3 * x
        exact.append(round(min(max(s, 0), 100), 1))
    assert a == b
    assert max(abs(x - y) for x, y in zip(a, exact)) <= 0.1


def test_probe_transitions(spark):
    probes = spark.createDataFrame([
        (1, 0, 1, 503, 1), (1, 1, 1, 503, 2), (1, 2, 1, 200, 3),
        (2, 0, 1, 503, 10), (2, 1, 1, 503, 11), (2, 2, 1, 503, 12)],
        "probe_id long, attempt int, server_id int, status_code int, t_us long")
    tr = S.health_transitions(S.probe_outcomes(probes)).collect()
    assert [(r["seq"], r["alive"]) for r in tr] == [(2, False)]


def test_inflight_matches_bruteforce_with_small_buckets(spark):
    iv = spark.createDataFrame([(i, 1 + i % 2, i * 7 * SEC, i * 7 * SEC + (i % 9) * 11 * SEC) for i in range(60)],
                               "id long, server_id int, start_us long, end_us long")
    rows = iv.collect()
    brute = {r["id"]: sum(1 for o in rows if o["server_id"] == r["server_id"] and (
        o["start_us"] <= r["start_us"] < o["end_us"] or o["id"] == r["id"])) for r in rows}
    for b in (5 * SEC, 60 * SEC):
        got = {r["id"]: r["inflight"] for r in inflight(iv, ["server_id"], "start_us", "end_us", bucket_us=b).collect()}
        assert got == brute


def test_ordered_index_partition_invariance(spark, fx):
    base = None
    for parts in ("1", "64"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got = {r["id"]: r["idx"] for r in ordered_index(fx.fx_requests, "t_us", "id", bucket_us=600 * SEC).collect()}
        base = base or got
        assert got == base
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    want = {r["id"]: i for i, r in enumerate(sorted(fx.fx_requests.select("id", "t_us").collect(),
                                                     key=lambda r: (r["t_us"], r["id"])))}
    assert base == want


def test_running_count_global(spark):
    d = spark.createDataFrame([(i, i * 3 * SEC, i % 3 == 0) for i in range(50)], "id long, t long, f boolean")
    out = {r["id"]: r["running_count"] for r in running_count(d, F.col("f"), [], "t", "id", bucket_us=10 * SEC).collect()}
    assert out[0] == 1 and out[3] == 2 and out[49] == 17


# --- scalars, ingest, registry ---------------------------------------------------

def test_url_port_rules(spark):
    d = spark.createDataFrame([("http://backend-1",), ("http://backend-1:abc",), ("http://backend-1:8001",)], "u string")
    out = [(r["h"], r["p"]) for r in d.select(P.url_host("u").alias("h"), P.url_port("u").alias("p")).collect()]
    assert out == [("backend-1", 80), ("backend-1", None), ("backend-1", 8001)]


def test_sample_validation(spark):
    rows = [(1, 200, '{"cpu_usage":-1,"memory_usage":5}'), (2, 200, '{"cpu_usage":0,"memory_usage":5}'),
            (3, 200, '{"cpu_usage":100,"memory_usage":5}'), (4, 200, '{"cpu_usage":101,"memory_usage":5}'),
            (5, 200, '{"cpu_usage":5,"memory_usage":-1}'), (6, 200, '{"cpu_usage":5,"memory_usage":101}'),
            (7, 500, '{"cpu_usage":5,"memory_usage":5}'), (8, 200, 'not json')]
    d = spark.createDataFrame(rows, "id long, http_status int, body string")
    out = {r["id"]: r["reject_reason"] for r in L.parse_samples(d).collect()}
    assert out == {1: "cpu", 2: None, 3: None, 4: "cpu", 5: "memory", 6: "memory", 7: "status", 8: "decode"}
    ok, bad = L.split_samples(d)
    assert ok.count() == 2 and bad.count() == 6


def test_weight_override_last_wins(spark):
    kv = spark.createDataFrame([(1, "SERVER_WEIGHT_backend-1_8001", "3"), (2, "SERVER_WEIGHT_backend-1_8001", "5"),
                                (3, "SERVER_WEIGHT_backend-2_8002", "0"), (4, "OTHER", "9"),
                                (5, "SERVER_WEIGHT_backend-3_8003", "x")], "pos long, key string, value string")
    out = {r["host_port"]: r["weight"] for r in J.weight_overrides(kv).collect()}
    assert out == {"backend-1:8001": 5}


def test_server_list_positions(spark):
    d = spark.createDataFrame([(1, " a , ,b,,c ")], "list_id long, raw string")
    assert [(r["pos"], r["url"]) for r in REG.server_list_to_rows(d).collect()] == [(0, "a"), (1, "b"), (2, "c")]


def test_registry_upsert_idempotent(spark):
    empty = spark.createDataFrame([], "id int, name string, ip_address string, port int, status string, "
                                      "is_active boolean, weight int, capacity int")
    urls = spark.createDataFrame([(i, f"http://backend-{i}:800{i}") for i in (1, 2, 3)], "pos long, url string")
    once = REG.upsert_servers(empty, urls, "2024-01-01 00:00:00")
    twice = REG.upsert_servers(once, urls, "2024-01-01 00:05:00")
    key = lambda df: sorted((r["id"], r["ip_address"], r["port"]) for r in df.collect())
    assert key(once) == key(twice) == [(1, "backend-1", 8001), (2, "backend-2", 8002), (3, "backend-3", 8003)]


def test_orphans(spark):
    servers = spark.createDataFrame([(1,)], "id int")
    req = spark.createDataFrame([(1, 1), (2, 9)], "id long, server_id int")
    assert [r["id"] for r in J.orphans(req, servers).collect()] == [2]
    assert [r["id"] for r in J.drop_orphans(req, servers).collect()] == [1]


def test_severity_and_success(spark):
    d = spark.createDataFrame([(200, False), (404, False), (503, False), (None, True)], "s int, e boolean")
    out = d.select(P.effective_status("s", "e").alias("st"), P.is_success("s", "e").alias("ok"),
                   P.severity(P.effective_status("s", "e")).alias("lvl")).collect()
    assert [(r["st"], r["ok"], r["lvl"]) for r in out] == [(200, True, "info"), (404, True, "warn"),
                                                         (503, False, "error"), (502, False, "error")]


def test_fill_request_id(spark):
    d = spark.createDataFrame([("abc",), ("",), (None,)], "h string")
    out = [r["rid"] for r in d.select(P.fill_request_id("h").alias("rid")).collect()]
    assert out[0] == "abc" and len(out[1]) == 36 and len(out[2]) == 36


# --- model -------------------------------------------------------------------------

def test_manifest_checks():
    assert M.check_manifest(A.FEATURES) == A.FEATURES
    with pytest.raises(ValueError):
        M.check_manifest(A.FEATURES[:5])
    with pytest.raises(ValueError):
        M.check_manifest(A.FEATURES[:5] + ["cpu_usage"])
    with pytest.raises(ValueError):
        M.check_manifest(list(reversed(A.FEATURES)))


def test_scaler_zero_scale(spark):
    d = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    sc = M.fit_scaler(d, ["a", "b"])
    out = M.apply_scaler(d, sc, ["a", "b"]).orderBy("a").collect()
    assert [r["a_scaled"] for r in out] == [-1.0, 1.0] and [r["b_scaled"] for r in out] == [0.0, 0.0]


def test_memo_keys_distinct(spark):
    snap = spark.createDataFrame([(1, 12, 0, 1.0, 2.0), (2, 1, 0, 1.0, 2.0), (2, 2, 1, 1.0, 2.0)],
                                 "tick long, server_id int, pos int, cpu_usage double, memory_usage double")
    keys = {r["tick"]: r["memo_key"] for r in M.memo_key(snap).collect()}
    assert keys[1] == "12|1.00|2.00|" and keys[2] == "1|1.00|2.00|2|1.00|2.00|"


def test_split_is_stable(spark, fx):
    a, b = M.split(fx.fx_requests, "id")
    n, na, nb = fx.fx_requests.count(), a.count(), b.count()
    assert na + nb == n and 0.7 < na / n < 0.9


def test_model_pick_ties_and_fallback(spark):
    cand = spark.createDataFrame([
        (1, 1, 0, 0.5, True, 0, 10), (1, 2, 1, 0.5, True, 0, 10),      # tie: first in pool order
        (2, 1, 0, 0.1, False, 0, 10), (2, 2, 1, 0.2, True, 10, 10)],    # nobody eligible
        "decision_id long, server_id int, pos int, score double, alive boolean, conns int, capacity int")
    fb = spark.createDataFrame([(1, 9), (2, 9)], "decision_id long, assigned int")
    out = {r["decision_id"]: (r["assigned"], r["source"]) for r in R.model_pick(cand, fb).collect()}
    assert out == {1: (1, "model"), 2: (9, "fallback")}


# --- sources / sinks -----------------------------------------------------------------

def test_append_and_prune(spark, fx, scratch):
    path = f"{scratch}/requests"
    req = fx.fx_requests.select("id", "server_id", "status", "response_time_ms", "created_at")
    IO.append_requests(req, path)
    IO.append_requests(req.limit(0), path)
    back = IO.read_requests(spark, path, as_of="2024-01-01 12:00:00", lookback_s=6 * 3600)
    want = P.lookback(req, "created_at", "2024-01-01 12:00:00", seconds=6 * 3600)
    assert back.count() == want.count()


def test_scaler_manifest_model_roundtrip(spark, fx, scratch):
    from reqlens.plans.catalog import AS_OF
    from reqlens.plans.training import training_set
    tr = training_set(fx.fx_requests, fx.fx_servers, fx.fx_metrics, AS_OF, bucket="hour")
    sc = M.fit_scaler(tr)
    IO.save_scaler(spark, sc, f"{scratch}/scaler")
    IO.save_manifest(spark, A.FEATURES, f"{scratch}/manifest")
    assert IO.load_manifest(spark, f"{scratch}/manifest") == A.FEATURES
    assert IO.load_scaler(spark, f"{scratch}/scaler")["mean"] == pytest.approx(list(sc.first()["mean"]))
    model = M.fit_score_model(tr, kind="linear")
    IO.save_model(model, f"{scratch}/model")
    again = IO.load_model(f"{scratch}/model")
    a = [r["score"] for r in M.score(tr, model).orderBy("server_id", "hour").collect()]
    b = [r["score"] for r in M.score(tr, again).orderBy("server_id", "hour").collect()]
    assert a == pytest.approx(b)
    with pytest.raises(ValueError):
        M.score(tr.limit(0), model)


def test_least_connections_bucket_invariance(spark, fx):
    req = fx.fx_intervals.select("id", "server_id", F.col("start_us").alias("arrival_us"), "end_us")
    pool = R.make_pool(fx.fx_servers)
    a = {r["id"]: r["assigned"] for r in R.least_connections(req, pool, bucket_us=5 * SEC).collect()}
    b = {r["id"]: r["assigned"] for r in R.least_connections(req, pool, bucket_us=600 * SEC).collect()}
    assert a == b and len(a) == req.count()


def test_quantile_summary_rank_error(spark, fx):
    """Each approximate quantile's rank is within its objective's error."""
    log = fx.fx_request_log.withColumn("ts", F.lit("2024-01-01 00:02:30").cast("timestamp_ntz"))
    out = A.quantile_summary(log, "duration_s", ["server_id"], "ts", width="5 minutes", slide="5 minutes").collect()
    vals = {}
    for r in fx.fx_request_log.select("server_id", "duration_s").collect():
        vals.setdefault(r["server_id"], []).append(r["duration_s"])
    for r in out:
        xs = sorted(vals[r["server_id"]])
        n = len(xs)
        rank = sum(1 for x in xs if x <= r["value"]) / n
        assert abs(rank - r["quantile"]) <= A.SUMMARY_OBJECTIVES[r["quantile"]] + 1.0 / n


def test_wrr_epochs_membership_vs_legacy(spark):
    members = "array<struct<pos:int,server_id:int,weight:int>>"
    versions = spark.createDataFrame([
        (0, 100 * SEC, [(0, 1, 1), (1, 2, 1)]),
        (100 * SEC, 200 * SEC, [(0, 1, 1), (2, 3, 1)])], f"start_us long, end_us long, members {members}")
    req = spark.createDataFrame([(i, 1, t * SEC, t * SEC + 1) for i, t in enumerate([10, 20, 30, 110, 120, 130])],
                                "id long, server_id int, arrival_us long, end_us long")
    get = lambda df: [r["assigned"] for r in df.orderBy("arrival_us").collect()]
    assert get(R.weighted_round_robin_live(req, versions)) == [1, 2, 1, 1, 3, 1]
    assert get(R.weighted_round_robin_live(req, versions, legacy=True)) == [1, 2, 1, 3, 1, 3]
    assert get(R.round_robin_live(req, versions)) == [1, 2, 1, 3, 1, 3]


def test_forward_fill_across_buckets(spark):
    from reqlens.operators.timebucket import forward_fill
    d = spark.createDataFrame([(i, i * 10 * SEC, (i if i in (0, 4) else None)) for i in range(12)],
                              "id long, t long, v long")
    out = {r["id"]: r["f"] for r in forward_fill(d, "v", [], "t", "id", bucket_us=15 * SEC, name="f").collect()}
    assert out == {i: (0 if i < 4 else 4) for i in range(12)}


def test_score_memoised_and_ml_policy(spark, fx):
    from reqlens.plans.catalog import AS_OF
    from reqlens.plans.queries_model import snapshots
    from reqlens.plans.training import training_set
    tr = training_set(fx.fx_requests, fx.fx_servers, fx.fx_metrics, AS_OF, bucket="hour")
    model = M.fit_score_model(tr, kind="linear")
    snap = snapshots(fx)
    sm = M.score_memoised(snap, model)
    n_pairs = snap.count()
    assert sm.count() == n_pairs
    # a memo hit carries exactly the scores of the decision that first produced its key
    keys = M.memo_key(snap, "tick_us")
    j = sm.join(keys, "tick_us")
    per_key = j.groupBy("memo_key", "pos").agg(F.countDistinct("score").alias("n"))
    assert per_key.filter("n > 1").count() == 0
    scored = snap.join(sm.select("tick_us", "server_id", "score"), ["tick_us", "server_id"])
    req = fx.fx_intervals.select("id", "server_id", F.col("start_us").alias("arrival_us"), "end_us")
    out = R.assign(req, R.make_pool(fx.fx_servers), "ml", snapshots=scored)
    assert out.count() == req.count() and out.filter("assigned is null").count() == 0


def test_a_burst_is_cut_like_any_other_range(spark):
    """All rows in one second, nine tenths of them at one instant: slices
    hold about equal numbers of rows and the results stay."""
    from reqlens.operators.timebucket import SLICE, cut_in_order, forward_fill
    n = 40_000
    d = spark.range(n).selectExpr("id", "if(id % 10 < 9, 500000, id % 1000000) as t_us", "id % 7 = 0 as hit", "1 as k")
    cut = cut_in_order(d, [], "t_us", "id", slices=16)
    sizes = sorted(r["count"] for r in cut.groupBy(SLICE).count().collect())
    assert len(sizes) == 16 and sizes[-1] <= 2 * sizes[8]
    rows = sorted((r["t_us"], r["id"], r["hit"]) for r in d.collect())
    got = {r["id"]: (r["idx"], r["hits"]) for r in running_count(
        ordered_index(cut, "t_us", "id"), F.col("hit"), [], "t_us", "id", name="hits").collect()}
    hits, last, want, fill = 0, None, {}, {}
    for i, (t, k, hit) in enumerate(rows):
        hits += hit
        last = k if hit else last
        want[k], fill[k] = (i, hits), last
    assert got == want
    assert {r["id"]: r["filled"] for r in forward_fill(cut, F.when(F.col("hit"), F.col("id")), [], "t_us", "id").collect()} == fill
    prev = {r["id"]: r["prev"] and r["prev"]["id"] for r in S.neighbor(cut, [], "t_us", "id", ["id"]).collect()}
    assert prev == {b[1]: a[1] for a, b in zip(rows, rows[1:])} | {rows[0][1]: None}


@pytest.mark.parametrize("rows", [1, 2, 1122, 5000, 100_000])
@pytest.mark.parametrize("alpha", [0.01, 0.3, 0.5, 0.999])
def test_smoothing_of_any_length(spark, rows, alpha):
    if rows == 100_000 and alpha in (0.01, 0.5):
        pytest.skip("two alphas of this length are enough")
    d = spark.range(rows).selectExpr("id", "cast(id % 2 as int) as k", "id div 2 as t_us",
                                     "cast((id * 37) % 100 + 50 * (id % 3) as double) as cpu")
    got = {r["id"]: r["smoothed"] for r in S.smooth(d, "cpu", ["k"], "t_us", "id", alpha=alpha, chunk=1000).collect()}
    state = {}
    for i in range(rows):
        x, k = float((i * 37) % 100 + 50 * (i % 3)), i % 2
        state[k] = x if k not in state else (1 - alpha) * state[k] + alpha * x
        assert abs(got[i] - min(100.0, state[k])) <= 0.0501


def test_request_failure_marks_down(spark):
    probes = spark.createDataFrame([
        (1, 0, 1, 200, 1 * SEC), (2, 0, 1, 200, 10 * SEC), (3, 0, 1, 200, 20 * SEC)],
        "probe_id long, attempt int, server_id int, status_code int, t_us long")
    failures = spark.createDataFrame([(1, 1000, 15 * SEC)], "server_id int, seq long, t_us long")
    tr = S.health_transitions(S.probe_outcomes(probes), request_failures=failures).orderBy("t_us").collect()
    assert [(r["t_us"], r["alive"]) for r in tr] == [(15 * SEC, False), (20 * SEC, True)]


def test_least_connections_live_pool(spark):
    rows, i = [], 0
    for sid, n in ((1, 10), (2, 2), (3, 7)):
        for _ in range(n):
            rows.append((i, sid, 0, 1000 * SEC))
            i += 1
    rows += [(998, 1, 500 * SEC, 600 * SEC), (999, 1, 700 * SEC, 800 * SEC)]
    req = spark.createDataFrame(rows, "id long, server_id int, arrival_us long, end_us long")
    members = "array<struct<pos:int,server_id:int,weight:int>>"
    versions = spark.createDataFrame([
        (0, 650 * SEC, [(0, 1, 1), (2, 3, 1)]),          # server 2 down: pick 3 (7 < 10)
        (650 * SEC, 2000 * SEC, [])], f"start_us long, end_us long, members {members}")  # nobody alive
    out = {r["id"]: (r["assigned"], r["assigned_conns"]) for r in
           R.least_connections(req, pool_df(spark, 3), bucket_us=60 * SEC, versions=versions)
           .filter("id >= 998").collect()}
    assert out == {998: (3, 7), 999: (None, None)}


# -- no cut in the operators ------------------------------------------------

@pytest.mark.parametrize("alpha,chunk", [(0.01, 7), (0.001, 65536), (0.5, 3), (1.0, 5)])
def test_smoothing_keeps_the_whole_history(spark, alpha, chunk):
    vals = [(i, i % 2, i, float((i * 37) % 100)) for i in range(600)]
    d = spark.createDataFrame(vals, "id long, server_id int, t_us long, cpu double")
    got = {r["id"]: r["smoothed"] for r in
           S.smooth(d, "cpu", ["server_id"], "t_us", "id", alpha=alpha, chunk=chunk).collect()}
    state = {}
    for i, k, _, x in vals:
        state[k] = x if k not in state else (1 - alpha) * state[k] + alpha * x
        assert abs(got[i] - state[k]) <= 0.0501


def test_inflight_counts_empty_arrivals(spark):
    iv = spark.createDataFrame([(1, 1, 0, 10), (2, 1, 5, 5), (3, 1, 6, 9)], "id long, server_id int, s long, e long")
    got = {r["id"]: r["inflight"] for r in inflight(iv, ["server_id"], "s", "e").collect()}
    assert got == {1: 1, 2: 2, 3: 2}


def test_counter_rate_breaks_ties(spark):
    rows = [(1, 1, 0, 5.0), (2, 1, 10, 7.0), (3, 1, 10, 6.0)]
    schema = "id long, server_id int, t_us long, value double"
    for order in (rows, rows[::-1]):
        got = S.counter_rate(spark.createDataFrame(order, schema), ["server_id"], "t_us", "value", 60, tie="id").first()
        assert got["increase"] == 2.0 + 6.0


def test_exact_percentiles_in_slices(spark):
    import numpy as np
    rng = np.random.default_rng(2)
    rows = [(k % 3, float(v)) for k, v in enumerate(rng.exponential(1.0, 4000).round(2))] + [(None, 1.0), (7, None), (8, 2.0)]
    got = {r["k"]: tuple(r)[1:] for r in A.latency_percentiles(
        spark.createDataFrame(rows, "k int, v double"), "v", ["k"]).collect()}
    want = {}
    for key in {k for k, _ in rows}:
        vs = [v for k, v in rows if k == key and v is not None]
        if vs:
            want[key] = tuple(np.percentile(vs, [50, 90, 95, 99]))
    assert got.keys() == want.keys()
    assert all(np.allclose(got[k], want[k]) for k in want)


def test_long_numbers_and_blanks_in_configuration(spark):
    kv = spark.createDataFrame([(1, "SERVER_WEIGHT_a_1", "12345678901"), (2, "SERVER_WEIGHT_b_1", " 5"),
                                (3, "SERVER_WEIGHT_c_1", "99999999999999999999999")], "pos long, key string, value string")
    assert {r["host_port"]: r["weight"] for r in J.weight_overrides(kv).collect()} == {"a:1": 12345678901}
    u = spark.createDataFrame([("http://h:0000080/x",), ("http://h:99999999999",)], "url string")
    assert [r["port"] for r in P.with_host_port(u).collect()] == [80, None]


def test_durations_truncate(spark):
    d = spark.createDataFrame([(-1500,), (1999,), ((1 << 60) + 999,)], "us long")
    assert [r[0] for r in d.select(P.to_millis("us")).collect()] == [-1, 1, ((1 << 60) + 999) // 1000]


def test_missing_columns_are_an_error(spark, scratch):
    spark.createDataFrame([(1, 2)], "id long, wrong int").write.parquet(f"{scratch}/bad")
    with pytest.raises(ValueError, match="server_id"):
        IO.read_requests(spark, f"{scratch}/bad")


def test_older_schema_reads(spark, scratch):
    spark.sql("select 1L as id, 2 as server_id, true as status, cast(12.6 as float) as response_time, "
              "timestamp_ntz'2024-01-01 00:00:00' as timestamp").write.parquet(f"{scratch}/old")
    assert IO.read_requests(spark, f"{scratch}/old").first()["response_time_ms"] == 13


def test_a_large_day_is_written_by_many_tasks(spark, scratch):
    import glob
    rows = spark.range(2000).selectExpr("id", "cast(id % 2 as int) as server_id", "true as status",
                                        "id as response_time_ms", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id) as created_at")
    IO.append_requests(rows, f"{scratch}/req", rows_per_file=500)
    assert len(glob.glob(f"{scratch}/req/dt=2024-01-01/*.parquet")) > 1
    assert IO.read_requests(spark, f"{scratch}/req").count() == 2000


def test_memo_key_leaves_out_dead_servers(spark):
    snap = spark.createDataFrame([(1, 1, 0, 1.0, 2.0, True), (1, 2, 1, 3.0, 4.0, False)],
                                 "tick int, server_id int, pos int, cpu_usage double, memory_usage double, alive boolean")
    assert M.memo_key(snap).first()["memo_key"] == "1|1.00|2.00|"


# --- windows over panes, sketches, policies, memo, pipelines ------------------

def test_windows_over_panes_copy_no_rows(spark):
    """Same windows as Spark's own sliding ones; the plan copies panes, not rows."""
    d = spark.range(500).selectExpr("id % 3 as k", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id * id % 900) as ts",
                                    "id")
    out = A.sliding(d, ["k"], "ts", "1 minute", "15 seconds", {"n": F.count(F.lit(1)), "s": F.sum("id")},
                    {"n": F.sum("n"), "s": F.sum("s")})
    want = d.groupBy("k", F.window("ts", "1 minute", "15 seconds").alias("w")).agg(F.count(F.lit(1)), F.sum("id"))
    assert sorted(tuple(r) for r in out.collect()) == sorted((r.k, r.w.start, r[2], r[3]) for r in want.collect())
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan and plan.index("Generate") < plan.rindex("HashAggregate")


def test_summary_of_many_values_keeps_each_objective(spark):
    """Far more values than a sketch holds: every quantile within its own error."""
    d = spark.range(300_000).selectExpr("id % 2 as k", "pmod(xxhash64(id), 1000003) / 10.0 as v", "id",
                                        "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id % 600) as ts")
    d = d.withColumn("v", F.when(F.col("id") % 100 < 97, F.col("v")))
    found = A.quantile_summary(d, "v", ["k"], "ts")
    told = A.summary_rank_errors(found, d, "v", ["k"], "ts").collect()
    assert len(told) == 2 * 14 * 4 and all(r.within for r in told)
    assert max(r.observations for r in told) > 4 * A.kll_size(0.05)
    assert A.kll_size(0.001) > A.kll_size(0.05) >= 8


def test_least_connections_over_a_large_pool(spark):
    """1,000 servers: the tournament gives what a scan of all of them gives."""
    n, servers = 3000, 1000
    rows = [(i, (i * 7) % servers + 1, (i * 31) % 500, (i * 31) % 500 + (i * 13) % 90) for i in range(n)]
    req = spark.createDataFrame(rows, "id long, server_id int, arrival_us long, end_us long")
    pool = spark.range(servers).selectExpr("cast(id + 1 as int) as server_id", f"cast({servers} - id - 1 as int) as pos",
                                           "1 as weight", "10 as capacity")
    got = {r["id"]: (r["assigned"], r["assigned_conns"]) for r in R.least_connections(req, pool, bucket_us=100).collect()}
    for i, used, t, _ in rows[::37]:
        conns = {s: 0 for s in range(1, servers + 1)}
        for j, s, a, e in rows:
            if j != i and a <= t < e:
                conns[s] += 1
        best = min(conns, key=lambda s: (conns[s], servers - s))
        assert got[i] == (best, conns[best])
    assert len(got) == n


def test_heavy_weights_are_searched_not_spread(spark):
    """Weights of 10,000: the slot's member is found by bisection, and no plan
    holds an array of slots."""
    pool = spark.createDataFrame([(1, 0, 10_000, 5), (2, 1, 1, 5), (3, 2, 20_000, 5)], "server_id int, pos int, weight int, capacity int")
    runs = spark.createDataFrame([(s, True, 0, 10**9) for s in (1, 2, 3)], "server_id int, alive boolean, start_us long, end_us long")
    versions = R.pool_versions(pool, runs, 10**9)
    req = spark.range(40_000).selectExpr("id", "1 as server_id", "id as arrival_us", "id + 1 as end_us")
    out = R.weighted_round_robin_live(req, versions)
    got = [r["assigned"] for r in out.orderBy("id").collect()]
    want = [1] * 10_000 + [2] + [3] * 20_000
    assert got == (want * 2)[:40_000]
    assert "array_repeat" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_decision_source_follows_from_keys(spark):
    """Breaker, failure, fill and hit by hand; labels other than 'error' do not matter."""
    rows = [(1, "a", "error", 10), (2, "a", "ok", 20), (3, "a", "error", 30), (4, "b", "hit", 40), (5, "b", "ok", 50),
            (6, "c", "ok", 105), (7, "a", "ok", 110), (8, "c", "ok", 130), (9, "c", "ok", 130), (10, None, "ok", 140),
            (11, None, "error", 150), (12, None, "ok", 160)]
    calls = spark.createDataFrame(rows, "id long, memo_key string, outcome string, t_us long")
    open_ = spark.createDataFrame([(100, 120)], "open_us long, close_us long")
    got = {r["id"]: r["source"] for r in R.decision_source(calls, open_).collect()}
    assert got == {1: "fallback_error", 2: "model", 3: "memo", 4: "model", 5: "memo", 6: "fallback_breaker",
                   7: "fallback_breaker", 8: "model", 9: "memo", 10: "model", 11: "fallback_error", 12: "model"}


def test_policy_p95_is_that_of_the_mixture(spark):
    req = spark.range(300).selectExpr("id", "cast(id % 2 + 1 as int) as server_id", "id * 10 as arrival_us", "id * 10 + 5 as end_us")
    pool = spark.createDataFrame([(1, 0, 3, 5), (2, 1, 1, 5)], "server_id int, pos int, weight int, capacity int")
    times = {1: [10, 20, 30, 40], 2: [15, 15, 500, 900, 1000]}
    lat = R.latency_counts(spark.createDataFrame([(s, v) for s, vs in times.items() for v in vs] + [(1, None)],
                                                 "server_id int, response_time_ms long"))
    got = {r["policy"]: r for r in R.compare_policies(req, pool, lat, ["weighted_round_robin"]).collect()}["weighted_round_robin"]
    whole = sorted(v for s, w in ((1, 225), (2, 75)) for v in times[s] for _ in range(w * 20 // len(times[s])))
    assert got["p95_chosen_latency_ms"] == whole[-(-95 * len(whole) // 100) - 1]
    assert abs(got["mean_chosen_latency_ms"] - sum(whole) / len(whole)) < 1e-6


def test_scaler_is_a_stage_of_the_saved_pipeline(spark, scratch):
    import numpy as np
    rng = np.random.default_rng(5)
    rows = [(i, *map(float, rng.normal(50, 9, 4)), 7.0, float(rng.normal())) for i in range(200)]
    d = spark.createDataFrame(rows, f"key long, {A.FEATURES[0]} double, {A.FEATURES[1]} double, {A.FEATURES[2]} double, "
                                    f"{A.FEATURES[3]} double, {A.FEATURES[4]} double, target double").withColumn(A.FEATURES[5], F.lit(3))
    train, test = M.split(d, "key")
    IO.save_model(M.fit_score_model(train, kind="linear"), f"{scratch}/model")
    model = IO.load_model(f"{scratch}/model")
    seen = np.array([[r[c] for c in A.FEATURES] for r in train.collect()], float)
    scaler = model.stages[0]
    assert np.allclose(scaler.getOrDefault("mean"), seen.mean(axis=0)) and np.allclose(scaler.getOrDefault("scale"), seen.std(axis=0))
    assert scaler.getOrDefault("scale")[4:] == [0.0, 0.0]
    scored = M.score(test, model)
    assert scored.columns == [*test.columns, "score"] and scored.filter("score is null").count() == 0


def test_logs_and_spans_of_a_hot_trace(spark):
    """One trace id over many hours: the pairs of a nested loop, met by bucket."""
    h = 3_600_000_000
    logs = spark.range(400).selectExpr("'t' as trace_id", f"id * {h} div 40 as ts_us", "id as log")
    spans = spark.range(400).selectExpr("'t' as trace_id", f"id * {h} div 37 as start_us", f"id * {h} div 37 + id * 1000000 as end_us", "id as span")
    got = J.correlate_logs_spans(logs, spans)
    assert got.columns == [*logs.columns, *spans.columns]
    want = {(a.log, b.span) for a in logs.collect() for b in spans.collect()
            if b.start_us - 60_000_000 <= a.ts_us <= b.end_us + 60_000_000}
    pairs = [(r.log, r.span) for r in got.select("l.log", "s.span").collect()]
    assert set(pairs) == want and len(pairs) == len(want)
    keys = got._jdf.queryExecution().executedPlan().toString()
    assert "_bucket" in keys


def test_logs_and_spans_are_both_shuffled(spark):
    """Sides that look small to the planner are not collected for a broadcast."""
    logs = spark.range(400).selectExpr("concat('t', id % 20) as trace_id", "id as ts_us", "id as log")
    spans = spark.range(400).selectExpr("concat('t', id % 20) as trace_id", "id as start_us", "id + 5 as end_us", "id as span")
    got = J.correlate_logs_spans(logs, spans)
    assert got.count() == 400 * 20
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_least_connections_reads_a_bucket_as_a_stream(spark):
    """One instant with most of all arrivals: a worker answers a batch before it
    reads the next one, and batches that cut a bucket change nothing."""
    n = 500
    rows = [(i, i % 4, 1000 if i < 400 else i, 1000 + i if i % 7 else 1000) for i in range(n)]
    req = spark.createDataFrame(rows, "id long, server_id int, arrival_us long, end_us long")
    picked = R.least_connections(req, pool_df(spark, 3))
    plan = picked._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "InPandas" not in plan
    key, size = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set(key, "7")
    try:
        got = {r["id"]: (r["assigned"], r["assigned_conns"]) for r in picked.collect()}
    finally:
        spark.conf.set(key, size)
    assert len(got) == n
    for i, _, t, _ in rows[::23]:
        conns = {s: sum(1 for j, k, a, e in rows if k == s and j != i and a <= t < e) for s in (1, 2, 3)}
        best = min(conns, key=lambda s: (conns[s], s))
        assert got[i] == (best, conns[best])

    import numpy as np
    import pyarrow as pa
    read = []

    def batches():
        for k in range(5):
            read.append(k)
            yield pa.record_batch({"_b": [0] * 3, "kind": [3] * 3, "server_id": [1] * 3, "t": [0] * 3,
                                   "id": [3 * k, 3 * k + 1, 3 * k + 2], "n": [1] * 3})
    for k, out in enumerate(R._lc_sweep(np.array([1]), np.array([0]), False)(batches())):
        assert out.num_rows == 3 and len(read) == k + 1
