"""Golden values and properties of the analytics operators."""

import itertools
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from massflow.functions import distributions as D
from massflow.operators import evaluate, geometry, hmm, ingest, lloyd, medoids, resample, risk, splits, windows
from massflow.sources import calendar, synthetic


def values(spark, expr_of, *arrays):
    cols = "abcdef"[: len(arrays)]
    df = spark.createDataFrame([tuple(list(map(float, a)) for a in arrays)], ", ".join(f"{c} array<double>" for c in cols))
    return df.select(expr_of(*[F.col(c) for c in cols]).alias("v")).first()["v"]


finite = st.floats(-100, 100, allow_nan=False).map(lambda x: round(x, 3))


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.lists(finite, min_size=5, max_size=5), st.lists(finite, min_size=5, max_size=5)), min_size=1, max_size=8), st.sampled_from([1, 2]))
def test_wasserstein_is_the_best_matching(spark, pairs, p):
    df = spark.createDataFrame([(i, *xy) for i, xy in enumerate(pairs)], "i int, x array<double>, y array<double>")
    got = {r["i"]: r for r in df.select("i", D.wasserstein(F.col("x"), F.col("y"), p).alias("d"), D.wasserstein(F.col("y"), F.col("x"), p).alias("e"), D.w2_parts(F.col("x"), F.col("y")).alias("w")).collect()}
    for i, (x, y) in enumerate(pairs):
        best = min(sum(abs(a - b) ** p for a, b in zip(x, q, strict=True)) / 5 for q in itertools.permutations(y))
        assert math.isclose(got[i]["d"], best ** (1 / p), abs_tol=1e-9) and got[i]["d"] == pytest.approx(got[i]["e"])
        if p == 2:
            w = got[i]["w"]
            assert w["total"] == pytest.approx(best, abs=1e-6) and min(w["location"], w["scale"], w["shape"]) >= 0


def test_distance_golden(spark):
    df = spark.createDataFrame([(0, [0.0, 2.0]), (1, [4.0, 0.0]), (2, [-1.0, 3.0])], "i int, sample array<double>")
    c = np.array([[1.0, 3.0], [2.0, 0.0]])
    d = lambda p: [r["distance"] for r in geometry.distances(df, c, p).orderBy("i").collect()]
    assert d(1) == [[1, 0], [1, 1], [1, 1]]
    assert np.allclose(d(2), [[1, 0], [1, math.sqrt(2)], [math.sqrt(2), 1]])
    x, y = np.sort(np.random.default_rng(0).standard_normal((2, 50, 9)), axis=2)
    assert np.allclose(geometry.blas_cost(x, y[:3]), geometry.power_cost(x, y[:3], 2))


def test_parts_golden(spark):
    w = lambda a, b: values(spark, D.w2_parts, a, b)
    assert w([0, 2], [2, 4])["location"] == 4 and w([-1, 1], [-2, 2])["scale"] == 1
    for v in (0.1, 0.01):
        got = w([v] * 63, [v + 0.2] * 63)
        assert got["total"] == pytest.approx(0.04) and got["scale"] == got["shape"] == 0
    a, b = synthetic.exact_moment_laws()
    assert len(a) == len(b) == 300 and values(spark, D.wasserstein, a, b) == pytest.approx(0.565685, abs=1e-6)
    assert all(np.mean(a**k) == pytest.approx(np.mean(b**k)) for k in range(1, 5))


def test_features_golden(spark):
    assert np.allclose(values(spark, D.standardize, [3, 1, 2]), [math.sqrt(1.5), -math.sqrt(1.5), 0])
    assert values(spark, D.standardize, [7, 7, 7]) == [0, 0, 0]
    assert values(spark, D.moments, [2, 2, 2]) == [2, 0, 0, 0]
    assert np.allclose(values(spark, D.moments, [0, 1, 2]), [1, math.sqrt(2 / 3), 0, -1.5])
    assert values(spark, D.drawdown, [0.1, -0.15, 0.1, -0.15]) == pytest.approx(1 - math.exp(-0.2))
    assert values(spark, D.drawdown, [0.1, 0.1, -0.15, -0.15]) == pytest.approx(1 - math.exp(-0.3))
    x = np.random.default_rng(1).standard_normal(21)
    assert np.allclose(values(spark, lambda a: D.features(a, "rich"), x)[4:13], np.quantile(x, D.QUANTILES))
    a, b = np.array([[[-1, -1], [1, 1]]]), np.array([[[-1, 1], [1, -1]]])
    assert np.allclose(geometry.panel_features(a, "covariance"), [[1, 1, 1]]) and np.allclose(geometry.panel_features(b, "covariance"), [[1, -1, 1]])
    assert geometry.panel_features(a, "correlation") == 1 and geometry.panel_features(b, "correlation") == -1
    assert np.allclose(geometry.panel_features(a, "marginal"), geometry.panel_features(b, "marginal"))


def test_barycenters(spark):
    df = spark.createDataFrame([(0, [0.0, 1.0]), (0, [1.0, 0.0]), (0, [9.0, 10.0])], "label int, sample array<double>")
    assert geometry.barycenters(df, 1).first()["center"] == [0, 1]
    assert np.allclose(geometry.barycenters(df, 2).first()["center"], [3, 4])


def test_sliced_control():
    """Equal marginals, other dependence: marginal distance 0, sliced root 2."""
    a, b = np.array([[-1.0, -1], [1, 1]]), np.array([[-1.0, 1], [1, -1]])
    u = np.array([[1, 1], [1, -1]]) / math.sqrt(2)
    z = geometry.project(np.stack([a, b]).reshape(2, -1), u, np.ones(2))
    assert math.sqrt(geometry.power_cost(z[:1], z[1:], 2)[0, 0]) == pytest.approx(math.sqrt(2))
    with pytest.raises(ValueError):
        geometry.project(np.zeros((1, 4)), np.array([[1.0, 1.0]]), np.ones(2))


def prices(spark, rows, symbol="s"):
    return spark.createDataFrame([(symbol, d, p) for d, p in rows], "symbol string, session_date string, price double").withColumn("session_date", F.col("session_date").cast("date"))


def test_gap_and_holiday(spark):
    cal = calendar.new_york(spark, "2024-06-28", "2024-07-12")
    p = prices(spark, [("2024-07-01", 100.0), ("2024-07-03", 121.0), ("2024-07-05", 133.1)])
    got = ingest.log_returns(p, cal).orderBy("idx").collect()
    assert [r["log_return"] and round(r["log_return"], 9) for r in got] == [None, None, round(math.log(1.1), 9)] and [r["idx"] for r in got] == [0, 1, 2]
    s = ingest.quality_summary(p, cal).first()
    assert (s["missing_sessions"], s["invalid_returns"], s["observed_sessions"], s["expected_sessions"]) == (1, 2, 3, 4)


def test_calendar_closes(spark):
    at = {str(r["session_date"]): str(r["close_utc"]) for r in calendar.new_york(spark, "2024-01-01", "2024-12-31").collect()}
    assert at["2024-03-08"].endswith("21:00:00") and at["2024-03-11"].endswith("20:00:00") and at["2024-07-03"].endswith("17:00:00") and at["2024-11-29"].endswith("18:00:00")
    assert len(at) == 252 and "2024-07-04" not in at and "2024-03-29" not in at and "2024-06-19" not in at


def test_validation(spark):
    cal = calendar.regular(spark, "2024-01-01", "2024-01-31")
    ingest.validate(prices(spark, [("2024-01-02", 1.0)]), cal)
    for rows in ([("2024-01-02", 1.0), ("2024-01-02", 2.0)], [("2024-01-02", 0.0)], [("2024-01-02", float("inf"))], [("2024-02-02", 1.0)], [("2024-01-02", None)]):
        with pytest.raises(ValueError):
            ingest.validate(prices(spark, rows), cal)


def series(spark, xs, symbol="s", start=0):
    rows = [(symbol, i, None if x is None else float(x)) for i, x in enumerate(xs)]
    df = spark.createDataFrame(rows, "symbol string, idx long, log_return double")
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.col("idx").cast("int"))
    return df.withColumns({"session_date": F.date_add(day, 1), "price_end": F.date_add(day, 1), "price_start": day, "available_at": F.date_add(day, 1).cast("timestamp") + F.expr("INTERVAL 21 HOUR")})


@pytest.mark.parametrize("block", [3, 5, 8192])
def test_windows_and_blocks(spark, block):
    s = series(spark, [1.0, 2, 3, 4, 5, 6, 7, 8])
    ends = lambda **k: [r["endpoint"] for r in windows.windows(s, 3, block=block, **k).orderBy("endpoint").collect()]
    assert ends(stride=2) == [2, 4, 6] and ends() == [2, 3, 4, 5, 6, 7]
    gap = series(spark, [1.0, 2, None, 4, 5, float("nan"), 7, 8, 9])
    got = windows.windows(gap, 2, block=block).orderBy("endpoint").collect()
    assert [r["endpoint"] for r in got] == [1, 4, 7, 8] and got[1]["sample"] == [4, 5]
    f = {r["idx"]: r for r in windows.future(series(spark, [9.0, 0.1, -0.2, 0.3]), 2, block=block).collect()}
    assert f[0]["future_return"] == pytest.approx(-0.1) and f[1]["future_return"] == pytest.approx(0.1) and f[2]["future_return"] is None
    assert f[0]["future_drawdown"] == pytest.approx(1 - math.exp(-0.2))


@pytest.mark.parametrize("block", [4, 8192])
def test_joint_windows(spark, block):
    a = series(spark, [float(i) for i in range(8)], "A")
    b = series(spark, [float(i) if i != 3 else None for i in range(8)], "B").withColumn("available_at", F.col("available_at") + F.expr("INTERVAL 10 MINUTE"))
    b = b.withColumn("available_at", F.when(F.col("idx") == 0, F.lit("2030-01-01").cast("timestamp")).otherwise(F.col("available_at")))
    panel = windows.joint_panel(a.unionByName(b), ["B", "A"])
    got = windows.joint_windows(panel, 3, block=block).orderBy("endpoint").collect()
    assert [r["endpoint"] for r in got] == [2, 6, 7] and got[1]["sample"][0] == [4, 4]
    assert got[0]["available_at"].year == 2030 and got[1]["available_at"].year == 2024  # the late atom delays its windows only
    broken = panel.filter("idx < 5 AND idx >= 0").withColumn("x", F.array(F.lit(1.0))).withColumn("price_start", F.when(F.col("idx") == 2, F.date_add("price_start", -1)).otherwise(F.col("price_start")))
    assert [r["endpoint"] for r in windows.joint_windows(broken, 3, block=block).collect()] == [4]
    with pytest.raises(Exception, match="share"):
        windows.joint_panel(a.unionByName(b.filter("idx < 7")), ["A", "B"]).collect()


def test_causality(spark):
    """Rows after t, times 20, change nothing at or before t."""
    xs = np.random.default_rng(3).standard_normal(80).tolist()
    far = [x * (20 if i > 50 else 1) for i, x in enumerate(xs)]

    def past(v):
        s = series(spark, v).withColumn("series", F.lit("s")).withColumn("q", F.col("log_return") * F.col("log_return")).withColumn("state", F.pmod(F.col("idx"), F.lit(3)).cast("int"))
        w = [tuple(r) for r in windows.windows(s, 7).filter("endpoint <= 50").orderBy("endpoint").collect()]
        f = [tuple(r) for r in risk.forecasts(s, ["state"], 3, 4, 2, 5, 2.0, 0.9).filter("idx <= 50").select("idx", "expanding", "rolling", "ewma", "state_mean", "state_matured").orderBy("idx").collect()]
        h = [tuple(r) for r in hmm.causal_filter(s, hmm.Hmm(np.array([0.6, 0.4]), np.array([[0.7, 0.3], [0.2, 0.8]]), np.array([[-1.0], [1.0]]), np.ones((2, 1, 1)), np.zeros(1), np.ones(1)), ["symbol"], "log_return").filter("idx <= 50").orderBy("idx").collect()]
        return str((w, f, h))

    assert past(xs) == past(far)


def test_strict_purge(spark):
    w = windows.windows(series(spark, [1.0, 2, 3, 4, 5, 6, 7, 8]), 2)
    got = splits.split(w, "2024-01-04", "2024-01-05", "2024-12-31")
    assert sorted(r["endpoint"] for r in got.filter("split = 'train'").collect()) == [1, 2]
    assert sorted(r["endpoint"] for r in got.filter("split = 'test'").collect()) == [6, 7]
    w3 = windows.windows(series(spark, range(12)), 3)
    for strict, test in ((True, [11]), (False, [8, 9, 10, 11])):
        got = splits.split(w3, "2024-01-05", "2024-01-09", "2024-12-31", strict)
        ends = lambda k: sorted(r["endpoint"] for r in got.filter(F.col("split") == k).collect())  # noqa: B023, E731
        assert ends("train") == [2, 3] and ends("test") == test and ends("validation") == ([7] if strict else [4, 5, 6, 7])
    with pytest.raises(ValueError):
        splits.split(w, "2024-01-05", "2024-01-04", "2024-12-31")
    assert splits.fold(2000, 2) == ("1997-12-31", "1999-12-31", "2000-12-31")


def test_risk_golden(spark):
    s = series(spark, [0.0] * 10).withColumn("series", F.lit("s")).withColumn("q", F.col("idx") + F.lit(1.0))
    s = s.withColumn("st", F.when(F.col("idx") < 2, -1).when(F.col("idx") == 5, 1).otherwise(0))
    got = {r["idx"]: r for r in risk.forecasts(s, ["st"], 2, 3, 2, 3, 2.0, 0.5).collect()}
    assert [got[i]["st_mean"] for i in (3, 4, 5)] == [2.5, 3.5, 3.5] and [got[i]["ewma"] for i in (2, 3, 4)] == [2, 3, 4]
    assert got[4]["rolling"] == 4 and got[7]["st_matured"] == 3 and got[1]["expanding"] is None
    y = spark.createDataFrame([("s", i, "2024-01-01", t, 2.0) for i, t in enumerate((0.0, 2.0, 4.0))], "series string, idx long, session_date string, target double, m double")
    assert [r["qlike"] for r in risk.losses(y, ["m"]).orderBy("idx").collect()] == pytest.approx([math.log(2) + t / 2 for t in (0, 2, 4)])


def test_paired_interval_of_constant_differences(spark):
    rows = [(t, m, n, float(t % 7) + (s if m == "a" else 0)) for t in range(30) for n, s in (("qlike", -2), ("mse", -4)) for m in ("a", "b")]
    df = spark.createDataFrame(rows, "t long, method string, loss_name string, value double")
    for r in resample.paired_interval(df, "a", 5, 30, 1).collect():
        want = {"qlike": -2, "mse": -4}[r["loss_name"]]
        assert (r["mean_delta"], r["lo"], r["hi"]) == pytest.approx((want,) * 3)


def test_paired_interval_ways_agree(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(t, m, "mse", float(rng.random())) for t in range(40) for m in ("a", "b", "c")]
    df = spark.createDataFrame(rows, "t long, method string, loss_name string, value double")
    key = lambda: sorted((r["method"], round(r["mean_delta"], 9), round(r["lo"], 9), round(r["hi"], 9)) for r in resample.paired_interval(df, "a", 5, 40, 3).collect())
    small = key()
    monkeypatch.setattr(resample, "LOCAL_NUMBERS", 0)
    assert key() == small


def test_evaluation_golden(spark):
    df = spark.createDataFrame([([0.0], [1.0]), ([1.0, 2.0], [2.0, 1.0])], "a array<double>, b array<double>")
    assert [r["mmd2"] for r in evaluate.with_mmd(df, "a", "b", 1.0).collect()] == pytest.approx([2 * (1 - math.exp(-0.5)), 0], abs=1e-12)
    d = spark.createDataFrame([([1.5, 3.0],), ([10.0, 9.0],), ([2.0],)], "d array<double>").select(D.novelty(F.col("d"), [1, 2, 3], 0.95).alias("v")).select("v.*").collect()
    assert [round(r["percentile"], 6) for r in d[:2]] == [0.333333, 1] and [r["ood"] for r in d[:2]] == [False, True] and [r["margin"] for r in d] == pytest.approx([0.5, 0.1, None])
    lab = spark.createDataFrame([("k", p, v) for p, v in ((1, 0), (2, 0), (10, 1), (11, 1))], "k string, position long, label int")
    s = evaluate.temporal_summary(lab, ["k"]).first()
    assert s["switch_frequency"] == 0 and s["mean_dwell"] == 2
    t = spark.createDataFrame([(0, 1), (0, 1), (1, 0), (1, 0)], "t int, p int")
    assert evaluate.label_mapping(t, "t", "p", 2) == [1, 0] and evaluate.agreement(t, "t", "p").first()["ari"] == 1
    one = spark.createDataFrame([(0, 0), (0, 0)], "t int, p int")
    assert evaluate.agreement(one, "t", "p").first()["ari"] == 1 and evaluate.agreement(one, "t", "p").first()["nmi"] is None
    x = np.random.default_rng(0).random((9, 9))
    big = evaluate.assignment(x)
    assert sorted(big) == list(range(9)) and sum(x[i, j] for i, j in enumerate(big)) <= min(sum(x[i, p[i]] for i in range(9)) for p in itertools.islice(itertools.permutations(range(9)), 0, 362880, 7)) + 1e-12
    parts = spark.createDataFrame([(1.0, 0.0, 0.0, 1.0), (0.0, 9.0, 0.0, 9.0)], "location double, scale double, shape double, total double")
    assert tuple(evaluate.component_fractions(parts).first()) == pytest.approx((0.1, 0.9, 0))


def clusters(spark):
    rng = np.random.default_rng(10)
    x = np.r_[rng.normal(-2, 0.1, (30, 15)), rng.normal(2, 0.1, (30, 15))]
    return x, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, sample array<double>")


@pytest.mark.parametrize(("p", "init"), [(2, "k-means++"), (2, "random"), (1, "k-means++")])
def test_lloyd_separates(spark, p, init):
    x, df = clusters(spark)
    got = lloyd.fit(lloyd.coordinates(df, "id").cache(), 2, p, init=init, n_init=2)
    lab = [r["label"] for r in got.transform(df).orderBy("id").collect()]
    assert got.converged and len(set(lab[:30])) == len(set(lab[30:])) == 1 and lab[0] != lab[-1]
    q = np.sort(x, axis=1)
    if p == 2:  # the Euclidean inertia over L
        want = sum(((q[a] - q[a].mean(0)) ** 2).sum() for a in (slice(0, 30), slice(30, 60))) / 15
        assert got.objective == pytest.approx(want)
    assert all(b <= a + 1e-9 for a, b in zip(got.history, got.history[1:], strict=False))


def test_lloyd_rejects_and_reseeds(spark):
    _, df = clusters(spark)
    q = lloyd.coordinates(df, "id").cache()
    with pytest.raises(ValueError):
        lloyd.fit(q, 2, init=np.zeros((2, 15)))
    far = np.stack([np.full(15, -2.0), np.full(15, 500.0), np.full(15, 600.0)])
    got = lloyd.fit(q, 3, init=far)
    assert {r["label"] for r in got.transform(df).collect()} == {0, 1, 2}
    with pytest.raises(ValueError):
        lloyd.fit(lloyd.coordinates(df.limit(1), "id"), 2)


@pytest.mark.parametrize("kind", ["correlation", "parity"])
def test_medoids_recover_dependence(spark, kind, tmp_path):
    from massflow.sources import files

    x, label = synthetic.joint_control(kind, 60, 63, 4)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "endpoint long, sample array<array<double>>").cache()
    got = medoids.fit(df, 2, geometry.unit_directions(48, x.shape[2], 1), np.ones(x.shape[2]), 40, 2, 0)
    lab = [r["label"] for r in got.transform(df).orderBy("endpoint").collect()]
    truth = spark.createDataFrame(list(zip(label.tolist(), lab, strict=True)), "a int, b int")
    assert evaluate.agreement(truth, "a", "b").first()["ari"] == 1
    files.save_model(tmp_path / "m.json", "medoids", got)
    back = files.load_model(tmp_path / "m.json")
    assert [r["label"] for r in back.transform(df).orderBy("endpoint").collect()] == lab
    (tmp_path / "m.json").write_text((tmp_path / "m.json").read_text().replace('"kind"', '"kinds"'))
    with pytest.raises(ValueError):
        files.load_model(tmp_path / "m.json")


def test_hmm_golden(spark):
    m = hmm.Hmm(np.array([0.6, 0.4]), np.array([[0.7, 0.3], [0.2, 0.8]]), np.array([[-1.0], [1.0]]), np.ones((2, 1, 1)), np.zeros(1), np.ones(1))
    post = m.filter(np.array([[0.0], [1.0]]))
    assert np.allclose(post, [[0.6, 0.4], [0.1192, 0.8808]], atol=1e-4)
    assert np.allclose(m.filter(np.array([[1.0]]), post[0]), post[1:])
    rng = np.random.default_rng(2)
    x = np.r_[rng.normal(0, 0.3, (150, 2)), rng.normal(0, 3, (150, 2)), rng.normal(0, 0.3, (150, 2))]
    got = hmm.fit(spark, x, 2, n_init=2, max_iter=40)
    state = got.filter(x).argmax(1)
    assert (state[10:140] == 0).mean() > 0.95 and (state[160:290] == 1).mean() > 0.9 and got.converged
    with pytest.raises(ValueError):
        hmm.baum_welch(np.ones((50, 1)), 2, 0)


def test_index_tables(spark):
    idx = resample.moving_block(50, 7, 3)
    assert len(idx) == 50 and (np.diff(idx[:7]) == 1).all() and idx.min() >= 0 and idx.max() < 50
    idx, seam = resample.stationary(1000, 50, 7)
    assert seam[0] and 5 < seam.sum() < 60 and idx.min() >= 0 and idx.max() < 1000
    assert (np.diff(idx)[~seam[1:]] == 1).all() and (idx == resample.stationary(1000, 50, 7)[0]).all()
    assert (idx != resample.stationary(1000, 50, 7, 1)[0]).any() and (idx != resample.stationary(1000, 50, 8)[0]).any()
    assert resample.stationary(100, 1, 3)[1].all()
    for n, block in ((0, 3), (10, 0), (10, math.nan), (True, 3), (10, math.inf)):
        with pytest.raises(ValueError):
            resample.stationary(n, block, 0)
    a = sorted(map(tuple, resample.draws(spark, 20, 3, 1, "stationary", 5).collect()))
    b = sorted(map(tuple, resample.draws(spark, 20, 3, 1, "stationary", 5).repartition(7).collect()))
    assert a == b and len(a) == 60
    both = spark.createDataFrame([("a", 4), ("b", 6)], "symbol string, n long")
    assert resample.draws(spark, both, 3, 1, "iid").groupBy("symbol").count().orderBy("symbol").collect() == [("a", 12), ("b", 18)]


def test_draws_are_even():
    """Indices are uniform, block lengths geometric, repetitions unrelated."""
    free = np.concatenate([resample.index_table(40, 11, r, "iid", 1)[0] for r in range(500)])
    n = np.bincount(free, minlength=40)
    assert ((n - 500) ** 2 / 500).sum() < 85  # chi-squared of 39 degrees: 1 in 30,000
    share = np.mean([resample.stationary(400, 20, 5, r)[1][1:].mean() for r in range(300)])
    assert abs(share - (1 / 20 + 19 / 20 / 400)) < 0.003
    u = np.array([resample.bits(1, r, np.arange(200), 0) for r in range(200)]) / 2**32
    assert abs(np.corrcoef(u[:-1].ravel(), u[1:].ravel())[0, 1]) < 0.02 and abs(np.corrcoef(u[:, :-1].ravel(), u[:, 1:].ravel())[0, 1]) < 0.02


@pytest.mark.parametrize(("kind", "block"), [("moving", 4), ("stationary", 3.5), ("iid", 1)])
def test_draws_in_sql(spark, kind, block):
    import duckdb

    lengths = "(SELECT * FROM (VALUES ('a', 9), ('b', 30)) t(symbol, n))"
    want = duckdb.sql(f"SELECT symbol, rep, pos, idx FROM {resample.draws_sql(lengths, 4, 2**40 + 9, kind, block, ['symbol'])}").fetchall()
    both = spark.createDataFrame([("a", 9), ("b", 30)], "symbol string, n long")
    got = resample.draws(spark, both, 4, 2**40 + 9, kind, block).select("symbol", "rep", "pos", "idx").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_contamination(spark):
    x = np.random.default_rng(4).standard_normal((100, 3))
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "idx long, a double, b double, c double").repartition(3)
    got = resample.contaminate(df, 0.02, 10, 1, ["a", "b", "c"]).orderBy("idx").collect()
    y, hit = np.array([[r["a"], r["b"], r["c"]] for r in got]), np.array([r["hit"] for r in got])
    assert hit.sum() == 2 and (y[~hit] == x[~hit]).all()
    assert np.allclose(np.abs(y[hit] - x[hit]), np.tile(10 * x.std(0), (2, 1)))
    signs = resample.contaminate(df, 1, 10, 1, ["a", "b", "c"]).orderBy("idx").collect()
    up = np.array([[r["a"], r["b"], r["c"]] for r in signs]) > x
    assert (np.abs(up.mean(0) - 0.5) < 0.2).all() and 10 < (up[:, 0] != up[:, 1]).sum() < 90
    for share, size in ((-0.1, 1), (1.1, 1), (math.nan, 1), (True, 1), (0.1, 0), (0.1, math.inf)):
        with pytest.raises(ValueError):
            resample.contaminate(df, share, size, 1, ["a"])


def test_synthetic_streams(spark):
    seen = set()
    for kind in ("variance", "normal_t5", "signed_exponential", "equal_four_moments"):
        for seed in range(6):
            x, t = synthetic.recovery_stream(kind, seed)
            assert len(x) == len(t) == 4 * 756 and abs(x.mean()) < 0.01 and (np.diff(t) != 0).sum() == 3
            seen.add(int(t[0]))
    assert seen == {0, 1}
    x, t = synthetic.recovery_stream("variance", 1)
    assert x[t == 1].std() / x[t == 0].std() == pytest.approx(3, rel=0.1)
    blocks, truth = synthetic.exact_moment_blocks(7, 6)
    power = np.array([[(b**k).mean() for k in range(1, 5)] for b in blocks])
    assert blocks.shape == (6, 300) and set(truth) == {0, 1} and np.abs(power - power[0]).max() < 1e-9
    assert (np.sort(blocks[0]) != np.sort(blocks[1])).any()


@pytest.mark.parametrize("kind", ["gaussian_null", "student_null", "rare", "gradual"])
def test_control_streams(kind):
    x, rho = synthetic.control_stream(kind, 17)
    again = synthetic.control_stream(kind, 17)
    assert x.shape == (3000, 5) and np.isfinite(x).all() and (x == again[0]).all() and (rho == again[1]).all()
    truth = synthetic.pure_truth(rho[2250:], 63)
    if kind.endswith("null"):
        assert (rho == 0.45).all()
        assert np.corrcoef(x[:, 0], x[:, 1])[0, 1] == pytest.approx(0.45, abs=0.1) and np.corrcoef(x[1:, 0], x[:-1, 0])[0, 1] == pytest.approx(0.25, abs=0.08)
    elif kind == "rare":
        assert (rho == 0.8).sum() == 3 * 126 and (truth == 1).sum() == 64 and (truth == -1).sum() == 124
    else:
        assert set(truth) == {-1, 0, 1} and (truth == -1).sum() == 312
    with pytest.raises(ValueError):
        synthetic.control_stream("none", 1)
