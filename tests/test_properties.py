"""Property tests: the bucketed operators against brute force on random
rows (random times with ties, random bucket widths)."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from reqlens.operators.timebucket import asof_left, inflight, interval_lookup

SETTINGS = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))

times = st.lists(st.integers(min_value=0, max_value=400), min_size=1, max_size=40)


@SETTINGS
@given(left=times, right=times, tol=st.integers(1, 60), bucket=st.integers(1, 90))
def test_asof_matches_bruteforce(spark, left, right, tol, bucket):
    L = [(i, i % 2, t) for i, t in enumerate(left)]
    R = [(100 + j, j % 2, t, float(j)) for j, t in enumerate(right)]
    ldf = spark.createDataFrame(L, "lid long, k int, t long")
    rdf = spark.createDataFrame(R, "rid long, k int, t long, v double")
    got = {r["lid"]: r["v"] for r in asof_left(ldf, rdf, ["k"], "t", "t", tol, ["v"], tie="rid",
                                               bucket_us=bucket).collect()}
    want = {}
    for lid, k, t in L:
        c = [(rt, rid, v) for rid, rk, rt, v in R if rk == k and t - tol <= rt <= t]
        want[lid] = max(c)[2] if c else None
    assert got == want


@SETTINGS
@given(starts=times, lens=st.lists(st.integers(0, 80), min_size=40, max_size=40), bucket=st.integers(1, 100))
def test_inflight_matches_bruteforce(spark, starts, lens, bucket):
    rows = [(i, i % 2, s, s + lens[i]) for i, s in enumerate(starts)]
    df = spark.createDataFrame(rows, "id long, k int, s long, e long")
    got = {r["id"]: r["inflight"] for r in inflight(df, ["k"], "s", "e", bucket_us=bucket).collect()}
    # open intervals at the arrival, itself included; an empty one counts for itself only
    want = {i: sum(1 for i2, k2, s2, e2 in rows if k2 == k and (s2 <= s < e2 or i2 == i)) for i, k, s, e in rows}
    assert got == want


@SETTINGS
@given(cuts=st.lists(st.integers(1, 30), min_size=1, max_size=12), pts=times, bucket=st.integers(1, 120))
def test_interval_lookup_matches_bruteforce(spark, cuts, pts, bucket):
    # non-overlapping intervals with gaps: [a, a + len) then a gap of len // 2
    iv, a = [], 0
    for i, c in enumerate(cuts):
        iv.append((a, a + c, i))
        a += c + c // 2
    idf = spark.createDataFrame(iv, "start_us long, end_us long, tag int")
    pdf = spark.createDataFrame([(j, t) for j, t in enumerate(pts)], "pid long, t long")
    got = {r["pid"]: (r["hit"]["tag"] if r["hit"] else None)
           for r in interval_lookup(pdf, idf, [], "t", cols=["tag"], bucket_us=bucket, name="hit").collect()}
    want = {j: next((tag for s, e, tag in iv if s <= t < e), None) for j, t in enumerate(pts)}
    assert got == want
