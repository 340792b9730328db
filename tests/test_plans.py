"""Artifacts, jobs, studies, files and streams."""

import datetime as dt
import json
import os
import time
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from massflow import cli
from massflow.functions import distributions as D
from massflow.functions import local
from massflow.operators import evaluate, geometry, hmm, ingest, lloyd, medoids, mixture, risk, windows
from massflow.plans import artifacts, config, frozen, inputs, jobs, joint, panels, studies, synthetic_suite, univariate, validation
from massflow.sources import files

SF = "/root/testdata/sf0.01"


def test_seal(tmp_path):
    with artifacts.publish(tmp_path / "a") as t:
        files.write_json(t / "x.json", {"b": np.float64("nan"), "a": np.arange(2)})
    assert json.loads((tmp_path / "a/x.json").read_text()) == {"a": [0, 1], "b": None}
    one = artifacts.verify(tmp_path / "a")
    (tmp_path / "a/extra").write_text("x")
    with pytest.raises(ValueError):
        artifacts.verify(tmp_path / "a")
    artifacts.verify_subset(tmp_path / "a")
    (tmp_path / "a/extra").unlink()
    assert artifacts.verify(tmp_path / "a") == one
    (tmp_path / "a/link").symlink_to("x.json")
    with pytest.raises(ValueError):
        artifacts.verify(tmp_path / "a")
    with pytest.raises(FileExistsError), artifacts.publish(tmp_path / "a"):
        pass
    assert artifacts.identity({"a": 1, "b": 2}) == artifacts.identity({"b": 2, "a": 1}) and len(artifacts.artifact_id(1)) == 20


@pytest.fixture(scope="session")
def snapshots(tmp_path_factory):
    """Weekly prices of three symbols whose dependence and scale change every year."""
    home, rng, day = tmp_path_factory.mktemp("snapshots"), np.random.default_rng(5), dt.date(1994, 1, 3)
    weeks = 364
    calm = (np.arange(weeks) // 40) % 2 == 0
    common = rng.standard_normal(weeks)
    out = []
    for i, symbol in enumerate(("AAA", "BBB", "CCC")):
        own = rng.standard_normal(weeks)
        x = np.where(calm, 0.01 * own, 0.04 * (0.9 * common + 0.44 * own)) * (1 + 0.2 * i)
        path = home / f"{symbol}.csv"
        path.write_text("Date,Adj Close,Volume\n" + "".join(f"{day + dt.timedelta(7 * t)},{100 * np.exp(v)!r},1\n" for t, v in enumerate(x.cumsum().tolist())).replace("np.float64(", "").replace(")", ""))
        digest = artifacts.sha256(path)
        (home / f"{symbol}.csv.json").write_text(json.dumps({"symbol": symbol, "sha256": digest}))
        out.append({"symbol": symbol, "dataset": str(path), "sha256": digest})
    return out


@pytest.fixture(scope="session")
def market(snapshots):
    return {
        "version": 1, "assets": snapshots, "provider": "made up", "price_column": "Adj Close", "calendar": "weekly", "train_end": "1997-12-31", "validation_end": "1999-06-30", "assessment_end": "2000-12-31", "length": 13, "fit_stride": 2, "ks": [2, 3], "seed": 3,
        "projections": 8, "candidates": 24, "n_init": 1, "selection_sample": 60, "baseline_n_init": 1, "hmm_n_init": 1, "hmm_max_iter": 40, "projection_counts": [4], "projection_seeds": [1], "bootstrap_repeats": 1, "bootstrap_block_windows": 5, "exposure": "exploratory",
    }


@pytest.fixture(scope="session")
def development(spark, market, tmp_path_factory):
    return joint.develop(spark, market, tmp_path_factory.mktemp("studies"))


@pytest.mark.parametrize("change", [{"length": True}, {"length": "3"}, {"extra": 1}, {"train_end": "1997-1-1"}, {"train_end": "2001-01-01"}, {"ks": [2, 2]}, {"candidates": 2}, {"assets": []}, {"exposure": "fresh"}, {"version": True}])
def test_joint_config(market, change):
    joint.validated(market)
    with pytest.raises(ValueError):
        joint.validated({**market, **change})


def test_joint_study(spark, market, development, tmp_path):
    assert joint.develop(spark, market, development.parents[1]) == development
    c, manifest, metrics, _ = joint.parent(development, market)
    assert c == market and manifest["symbol_order"] == ["AAA", "BBB", "CCC"] and set(metrics["models"]) == set(joint.MODELS)
    for row in metrics["models"].values():
        assert sum(row["counts"]) == row["n"] == metrics["models"]["hmm"]["n"] and -1 <= row["ari"] <= 1
    assert metrics["models"]["scaled_joint"]["ari"] == 1 and len(metrics["sensitivity"]["projections"]) == len(metrics["sensitivity"]["window_block_bootstrap"]) == 1
    assert "scaled_joint" in (development / "report.html").read_text()
    out = joint.assess(spark, market, development)
    assert json.loads((out / "manifest.json").read_text())["development"] == artifacts.verify(development)
    assert spark.read.parquet(str(out / "assignments.parquet")).filter("session_date <= '1999-06-30'").isEmpty()
    with pytest.raises(ValueError):
        joint.assess(spark, {**market, "seed": 4}, development)


def test_development_does_not_see_the_future(spark, market, development, tmp_path):
    """Prices after validation_end, times 20, change no number."""
    far = []
    for a in market["assets"]:
        path = tmp_path / f"{a['symbol']}.csv"
        rows = open(a["dataset"]).read().splitlines()
        path.write_text("\n".join([rows[0], *(f"{d},{float(p) * (20 if d > '1999-06-30' else 1)!r},{v}" for d, p, v in (r.split(",") for r in rows[1:]))]) + "\n")
        far.append({**a, "dataset": str(path), "sha256": artifacts.sha256(path)})
        (tmp_path / f"{a['symbol']}.csv.json").write_text(json.dumps({"symbol": a["symbol"], "sha256": far[-1]["sha256"]}))
    panels_ = [inputs.panel(spark, assets, "Adj Close", "weekly", "1999-06-30") for assets in (market["assets"], far)]
    near, other = (sorted(map(str, p.collect())) for p in panels_)
    assert near == other
    (tmp_path / "AAA.csv").write_text("changed")
    with pytest.raises(ValueError):
        inputs.prices(spark, far, "Adj Close")


def test_freeze_and_score(spark, market, development, tmp_path, monkeypatch):
    bundle = frozen.freeze(development, tmp_path / "bundles")
    assert frozen.freeze(development, tmp_path / "bundles") == bundle
    contract, model = frozen.load(bundle)
    assert len(contract) == 14 and contract["calibration_end"] == market["validation_end"]
    monkeypatch.setattr(medoids, "fit", None)  # scoring never fits
    ask = {"version": 1, "assets": market["assets"], "provider": "made up", "price_column": "Adj Close", "start": "1998-01-01", "end": "2000-06-30", "as_of": "2000-03-01T00:00:00+01:00"}
    made, summary = frozen.score_snapshots(spark, bundle, ask)
    rows = made.orderBy("endpoint").collect()
    assert len(rows) == summary["windows"] == sum(summary["counts"]) > 50 and summary["excluded_training_overlap"] > 0 and summary["excluded_unavailable"] > 0
    assert all(r["price_start"] > dt.date(1997, 12, 31) and r["available_at"] <= dt.datetime(2000, 2, 29, 23) for r in rows)
    assert {r["calibration_reuse"] for r in rows} == {True, False} and all(r["calibration_reuse"] == (r["session_date"] <= dt.date(1999, 6, 30)) for r in rows)
    assert all(r["novelty"] == (r["nearest_distance"] > contract["novelty_threshold"]) for r in rows)
    later = {r["endpoint"]: r["scaled_joint"] for r in spark.read.parquet(str(joint.assess(spark, market, development) / "assignments.parquet")).collect()}
    assert all(later.get(r["endpoint"], r["state"]) == r["state"] for r in rows)
    for change in ({"as_of": "2000-03-01T00:00:00"}, {"start": "2000-07-01"}, {"provider": "other"}, {"assets": market["assets"][::-1]}, {"as_of": "1997-01-01T00:00:00Z"}, {"more": 1}):
        with pytest.raises(ValueError):
            frozen.score_snapshots(spark, bundle, {**ask, **change})
    with pytest.raises(ValueError):
        frozen.check({**contract, "numerical_sources": {"x": "y"}})
    (bundle / "model.json").write_text("{}")
    with pytest.raises(ValueError):
        frozen.load(bundle)


def test_joint_validation(spark, market, development, tmp_path, monkeypatch):
    monkeypatch.setattr(validation, "CONTROLS", ("gaussian_null", "rare"))
    monkeypatch.setitem(validation.CONTROL, "n_init", 1)
    monkeypatch.setitem(validation.CONTROL, "null_candidates", 32)
    cfg = {"version": 1, "market_config": "market.json", "block_lengths": [6], "bootstrap_repeats": 2, "chronological_ends": ["1996-12-31", "1997-12-31"], "candidate_sizes": [24], "optimizer_seeds": [3], "synthetic_seeds": [7], "outlier_fractions": [0.02], "outlier_magnitude": 10, "seed": 9}
    out = validation.run(spark, cfg, market, development, tmp_path)
    assert validation.run(spark, cfg, market, development, tmp_path) == out
    found = json.loads((out / "metrics.json").read_text())
    by = {r["kind"]: r for r in found["market"]}
    assert [r["kind"] for r in found["market"]].count("return_bootstrap") == 2 and set(by) == {"return_bootstrap", "chronological", "candidate_budget", "training_outliers"}
    assert by["candidate_budget"]["is_reference"] and by["candidate_budget"]["ari"] == 1  # the same search on the same windows
    assert by["training_outliers"]["contaminated_returns"] == int(np.ceil(0.02 * by["chronological"]["training_returns"]))
    assert 0 < by["return_bootstrap"]["windows_crossing_seams"] <= by["return_bootstrap"]["training_windows"]
    rare = [r for r in found["synthetic"] if r["control"] == "rare"]
    assert {r["method"] for r in rare} == {"joint", "covariance"} and all(r["recovery"]["mixed_windows"] == 124 for r in rare)
    assert all("novelty_fraction" in r for r in found["synthetic"] if r["control"] == "gaussian_null")
    with pytest.raises(ValueError):
        validation.run(spark, {**cfg, "chronological_ends": ["1998-12-31"]}, market, development, tmp_path)


def test_recovery_maps_from_training_alone():
    got = validation.recovery((np.array([0, 0, 1, 1]), np.array([1, 1, 0, 0])), (np.array([0, 1, -1]), np.array([0, 1, 0])))
    assert got["recall"] == [0, 0] and got["balanced_accuracy"] == 0 and got["mixed_windows"] == 1 and got["mapping"] == [1, 0]


def test_episode_delay_is_censored(spark):
    labels = lambda on: spark.createDataFrame([(i, int(on and 2560 <= i < 2676)) for i in range(2500, 2700)], "endpoint long, label int")
    assert evaluate.episode_delay(labels(False), 1, 2550, 2676).first()["censored"]
    assert tuple(evaluate.episode_delay(labels(True), 1, 2550, 2676).first()) == (10, 14, False)


def test_diagnostics_flag_collapsed_agreement(spark):
    at = lambda v: spark.createDataFrame([(i, v) for i in range(20)], "endpoint long, label int")
    got = evaluate.partition_diagnostics(at(1), 3, at(0))
    assert got["counts"] == [0, 20, 0] and got["ari"] == 1 and got["both_single_state"] and got["single_state"] and got["reference_counts"] == [20, 0, 0] and got["temporal"]["switch_frequency"] == 0
    with pytest.raises(ValueError):
        evaluate.partition_diagnostics(at(1), 3, at(0).limit(5))


def study(snapshots, symbol=0):
    return {
        "version": 1, **snapshots[symbol], "provider": "made up", "price_column": "Adj Close", "calendar": "weekly", "length": 10, "fit_stride": 2, "score_stride": 1, "fit_strides": [2], "horizon": 2, "ks": [2], "seed": 2, "n_init": 1, "models": ["w2", "shape_w2"],
        "years": [1997, 1998], "holdout_start": "1999-01-01", "data_cutoff": "2000-06-30", "validation_years": 1, "novelty": 0.95, "seed_repeats": 1, "bootstrap_repeats": 1, "bootstrap_block": 12, "null_repeats": 1,
    }


def test_cross_asset_study(spark, snapshots, tmp_path, monkeypatch):
    configs = {"AAA": study(snapshots)}
    with pytest.raises(ValueError):
        univariate.cross_asset(spark, {**configs, "BBB": study(snapshots, 1) | {"length": 11}}, tmp_path)
    with pytest.raises(ValueError):  # the holdout is closed before all developments are done
        univariate.cross_asset(spark, configs, tmp_path, "holdout")
    out = univariate.cross_asset(spark, configs, tmp_path)
    rows = json.loads((out / "summary.json").read_text())
    assert [r["symbol"] for r in rows] == ["AAA"] and len(rows[0]["refits"]) == 4 and (out / "comparison.png").read_bytes()[:4] == b"\x89PNG" and "AAA" in (out / "comparison.csv").read_text()
    runs = json.loads((tmp_path / "cross_asset_runs.json").read_text())
    dev, hold = (univariate._read(Path(runs["AAA"][s]), "metrics") for s in ("development", "holdout"))
    assert [f["year"] for f in dev["folds"]] == [1997, 1998] and dev["folds"][1]["refit"]["mapping"] is not None and [f["year"] for f in hold["folds"]] == [1999]
    scores = spark.read.parquet(f"{runs['AAA']['development']}/assignments.parquet")
    assert scores.agg(F.max("session_date").alias("d")).first()["d"] < dt.date(1999, 1, 1) and {r[0] for r in scores.select("policy").distinct().collect()} == {"strict", "operational"}
    strict = dev["folds"][0]["models"]["w2"]["strict"]
    assert strict["n"] < dev["folds"][0]["models"]["w2"]["operational"]["n"] and sum(strict["counts"]) == strict["n"] and 0 <= strict["ood_rate"] <= 1
    assert sum(strict["center_decomposition"].values()) == pytest.approx(1) and {r["label"] for r in strict["conditional_outcomes"]["future_volatility"]} <= {0, 1}
    assert set(dev["stability"]["models"]) == {"w2", "shape_w2"} and len(dev["overlap"]["rows"]) == 1
    monkeypatch.setattr(univariate, "fold", None)
    assert univariate.run(spark, configs["AAA"], tmp_path) == Path(runs["AAA"]["development"])


def test_synthetic_suite(spark):
    got = synthetic_suite.run(spark, {"repeats": 2, "lengths": [21], "seed": 9, "n_init": 1})
    json.dumps(files.json_safe(got), allow_nan=False)
    w2 = got["recovery"]["variance"]["21"]["w2"]
    assert w2["pure"]["ari"]["n"] == 2 and w2["pure"]["ari"]["mean"] > 0.9 and w2["delay"]["events"] == w2["delay"]["detected"] + w2["delay"]["censored"] == 2
    assert set(got["recovery"]["normal_t5"]["21"]) == set(synthetic_suite.METHODS) and got["stationary"]["21"]["gmm"]["null"]["seed_ari"]["n"] == 2
    exact = got["exact_moments"]
    assert exact["max_first_four_moment_gap"] < 1e-10 and exact["w2_between_laws"] > 0
    assert {n: (m["test_ari"], m["effective_clusters"]) for n, m in exact["methods"].items()} == {"w2": (1, 2), "w1": (1, 2), "volatility": (0, 1), "moments": (0, 1)}


def test_delays_count_from_the_switch():
    ends, truth = np.array([2268, 2272, 2276, 2280]), np.ones(4, int)
    assert synthetic_suite.delays(ends, truth, np.array([0, 1, 1, 1]), 1512) == [4]
    assert synthetic_suite.delays(ends, truth, np.zeros(4, int), 1512) == [None]
    assert synthetic_suite.scores(np.ones(5, int), np.array([0, 0, 1, 1, 1])) == {"ari": None, "nmi": None, "balanced_accuracy": 0.6, "windows": 5}


@pytest.mark.parametrize("kind", ["volatility", "moments", "rich"])
def test_local_forms_equal_distributed_ones(spark, kind):
    x = np.r_[np.random.default_rng(1).standard_normal((30, 12)), np.full((1, 12), 0.5)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "endpoint long, sample array<double>")
    want = np.array([r[0] for r in df.orderBy("endpoint").select(D.features(F.col("sample"), kind)).collect()])
    assert np.allclose(local.features(x, kind), want)


def test_feature_models(spark, tmp_path):
    """Saved models predict the same; near-equal rows are one; k may be 1."""
    rng = np.random.default_rng(6)
    x = np.r_[rng.normal(0, 1, (40, 20)), rng.normal(0, 5, (40, 20))]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "endpoint long, sample array<double>").withColumn("features", D.features(F.col("sample"), "volatility")).cache()
    for kind, model in (("feature_kmeans", lloyd.FeatureKMeans(2, 2)), ("feature_gmm", mixture.FeatureGmm(2, 2))):
        labels = [r["label"] for r in model.fit(df, "endpoint").predict(df, "endpoint").orderBy("id").collect()]
        assert local.ari(np.repeat([0, 1], 40), np.array(labels)) > 0.9
        files.save_model(tmp_path / kind, kind, model)
        assert [r["label"] for r in files.load_model(tmp_path / kind).predict(df, "endpoint").orderBy("id").collect()] == labels
        (tmp_path / kind).write_text((tmp_path / kind).read_text().replace('"scale": [', '"scale": [-1.0, '))
        with pytest.raises(ValueError):
            files.load_model(tmp_path / kind)
    flat = df.withColumn("features", F.array(F.lit(1.0) + F.col("endpoint") * 1e-15, F.lit(2.0)))
    assert lloyd.distinct_rows(flat, "endpoint", "features", 3) == 1
    one = mixture.FeatureGmm(3).fit(flat, "endpoint")
    assert len(one.weights) == 1 and one.predict(flat, "endpoint").filter("label <> 0 OR distance[0] > 1e-9").isEmpty()
    with pytest.raises(ValueError):
        lloyd.FeatureKMeans(3).fit(df.limit(2), "endpoint")


def test_mixture_equals_the_local_form(spark):
    rng = np.random.default_rng(7)
    x = np.r_[rng.normal(0, 1, (60, 2)), rng.normal(6, 2, (60, 2))]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "endpoint long, sample array<double>").withColumn("features", F.col("sample"))
    model = mixture.FeatureGmm(2, 1).fit(df, "endpoint")
    z = (x - model.mean) / model.scale
    weights, means, covs = local.mixture(z, 2, 0, 1)
    a, b = np.argsort(model.means[:, 0]), np.argsort(means[:, 0])
    assert np.allclose(model.weights[a], weights[b], atol=1e-3) and np.allclose(model.means[a], means[b], atol=1e-2) and np.allclose(model.covs[a], covs[b], atol=1e-2)


@pytest.mark.parametrize("kind", ["marginal", "covariance", "correlation"])
def test_panel_kmeans(spark, tmp_path, kind):
    rng = np.random.default_rng(8)
    rho = np.repeat([0.0, 0.95], 30)
    a, b = rng.standard_normal((2, 60, 40))
    x = np.stack([a, rho[:, None] * a + np.sqrt(1 - rho**2)[:, None] * b], 2)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "endpoint long, sample array<array<double>>").cache()
    model = lloyd.PanelKMeans(kind, 2, [1.0, 2.0], n_init=2).fit(df)
    if kind == "marginal":
        assert (model.mean == 0).all() and (model.scale == 1).all()
    labels = np.array([r["label"] for r in model.predict(df).orderBy("id").collect()])
    assert kind != "correlation" or local.ari((rho > 0).astype(int), labels) == 1
    files.save_model(tmp_path / "m", "panel_kmeans", model)
    assert [r["label"] for r in files.load_model(tmp_path / "m").predict(df).orderBy("id").collect()] == labels.tolist()
    with pytest.raises(ValueError):
        lloyd.PanelKMeans(kind, 2, [1.0, 0.0]).fit(df)


@pytest.mark.parametrize("settle", [0, 7, 10**6])
def test_medians_are_exact(spark, settle):
    rng = np.random.default_rng(9)
    q = np.round(rng.standard_normal((101, 4)), 1) * 10.0 ** rng.integers(-3, 3, (101, 4))
    g = rng.integers(0, 3, 101)
    g[:2] = 3  # a group of two; group 4 is empty
    df = spark.createDataFrame([(int(a), v.tolist()) for a, v in zip(g, q, strict=True)], "g int, q array<double>").repartition(3)
    got = geometry.medians(df, 5, settle)
    for j in range(4):
        assert (got[j] == np.median(q[g == j], axis=0)).all()
    assert np.isnan(got[4]).all()


def test_risk_study(spark):
    from massflow.plans.queries import basket_rows

    cfg = {"window": 10, "horizon": 3, "min_history": 12, "prior": 5.0, "decay": 0.9, "training_end": 150, "blocks": [5, 13], "reps": 20, "seed": 1}
    scored, intervals = studies.risk_study(basket_rows(spark, SF), [], 3, cfg)
    assert scored.select("method").distinct().count() == 4
    rows = intervals.collect()
    assert len(rows) == 2 * 3 * 2 and all(r["lo"] <= r["hi"] for r in rows)


@pytest.mark.parametrize("block", [7, 16, 8192])
def test_forecasts_in_blocks(spark, block):
    """Blocks of any length give what a plain loop over the series gives."""
    rng = np.random.default_rng(3)
    q, st = rng.random(60), rng.integers(-1, 2, 60)
    q[[4, 5, 30, 44]] = np.nan
    df = spark.createDataFrame([("s", i, None if np.isnan(v) else float(v), int(s), f"d{i}") for i, (v, s) in enumerate(zip(q, st, strict=True))], "series string, idx long, q double, st int, note string")
    window, horizon, least, prior, decay = 3, 2, 6, 2.0, 0.8
    got = {r["idx"]: r for r in risk.forecasts(df, ["st"], 2, window, horizon, least, prior, decay, block).collect()}
    e, matured = None, {0: [], 1: []}
    assert len(got) == 60 and got[9]["note"] == "d9"
    for t in range(60):
        seen = q[: t + 1][np.isfinite(q[: t + 1])]
        if np.isfinite(q[t]) and len(seen) >= least:
            e = seen.mean() if len(seen) == least else decay * e + (1 - decay) * q[t]
        ripe, origin = q[t - horizon + 1 : t + 1], t - horizon
        if origin >= window - 1 and np.isfinite(ripe).all() and st[origin] >= 0:
            matured[int(st[origin])].append(ripe.mean())
        own = matured.get(int(st[t]), [])
        want = {"expanding": seen.mean(), "rolling": q[t - 2 : t + 1].mean(), "st_mean": (sum(own) + prior * seen.mean()) / (len(own) + prior), "st_matured": len(own)} if t >= least - 1 else {}
        want["ewma"] = e if np.isfinite(q[t]) and e is not None else None
        for k in ("expanding", "rolling", "st_mean", "st_matured", "ewma"):
            v = want.get(k)
            assert got[t][k] == (None if v is None or np.isnan(v) else pytest.approx(v)), (t, k)
    for change in ({"k": True}, {"window": 0}, {"min_history": 2}, {"prior": 0}, {"decay": 1}):
        with pytest.raises(ValueError):
            risk.forecasts(df, ["st"], **{**dict(k=2, window=3, horizon=2, min_history=6, prior=2.0, decay=0.8), **change})


JOB = {"name": "b", "type": "benchmark", "n_windows": 32, "length": 5, "dimensions": 2, "k": 2, "projections": 4, "candidates": 8, "n_init": 1, "seed": 0}


def test_jobs(tmp_path, monkeypatch):
    for wrong in ({**JOB, "k": True}, {**JOB, "type": "none"}, {**JOB, "more": 1}, {**JOB, "name": ""}):
        with pytest.raises(ValueError):
            jobs.prepare(wrong)
    for how in ({"workers": 9}, {"workers": True}, {"threads": 0}, {"timeout": 0}, {"timeout": float("inf")}):
        with pytest.raises(ValueError):
            jobs.run([JOB], tmp_path, **how)
    with pytest.raises(ValueError):
        jobs.run([JOB, {**JOB, "name": "c"}], tmp_path)  # the same work under two names
    bad = {**JOB, "k": 20, "name": "bad"}
    first = jobs.run([JOB, bad], tmp_path, master="local[1]")
    assert [r["status"] for r in first["jobs"]] == ["completed", "failed"] and not first["success"]
    home = tmp_path / first["jobs"][0]["id"]
    notes = json.loads((tmp_path / first["jobs"][0]["id"] / "attempts" / os.path.basename(first["jobs"][0]["output"]) / "execution.json").read_text())
    assert notes["pid"] != os.getpid() and notes["peak_memory"]["driver_kb"] > 0
    assert "ValueError" in next((tmp_path / first["jobs"][1]["id"] / "attempts").glob("*/failure.txt")).read_text()
    stale = home / "attempts" / "old"
    stale.mkdir()
    files.write_json(stale / "status.json", {"status": "running"})
    again = jobs.run([{**JOB, "name": "new name"}], tmp_path, master="local[1]")
    assert again["success"] and again["jobs"][0]["status"] == "cached" and again["jobs"][0]["output"] == first["jobs"][0]["output"]
    assert jobs.prepare(JOB)["id"] != jobs.prepare(JOB, 2)["id"]
    here = jobs.prepare(JOB)
    monkeypatch.setattr(artifacts, "sources", lambda: {"x": "y"})  # other code is another job
    assert jobs.prepare(JOB)["id"] != here["id"]
    with pytest.raises(ValueError, match="sources"):
        jobs.verify(here)
    monkeypatch.undo()
    with open(os.path.join(first["jobs"][0]["output"], "task.json"), "a") as f:
        f.write(" ")
    with pytest.raises(ValueError):
        jobs.result(home, json.loads((home / "request.json").read_text()))


def test_a_late_job_is_killed_with_its_children(tmp_path):
    began = time.time()
    got = jobs.run([{**JOB, "n_windows": 10_000_000, "name": "long"}], tmp_path, timeout=6, master="local[1]")
    assert got["jobs"][0]["timed_out"] and got["jobs"][0]["status"] == "failed" and time.time() - began < 40
    home = str(tmp_path / got["jobs"][0]["id"])
    left = [p for p in os.listdir("/proc") if p.isdigit() and home in _command(p)]
    assert not left


def _command(pid):
    try:
        return open(f"/proc/{pid}/cmdline").read()
    except OSError:
        return ""


def test_jobs_of_a_bundle(spark, market, development, tmp_path):
    """Scoring, risk and refit in workers, and the command line."""
    bundle = frozen.freeze(development, tmp_path / "bundles")
    ask = {"version": 1, "assets": market["assets"], "provider": "made up", "price_column": "Adj Close", "start": "1999-07-01", "end": "2000-12-31", "as_of": "2001-03-01T00:00:00Z"}
    (tmp_path / "score.json").write_text(json.dumps(ask))
    (tmp_path / "risk.json").write_text(json.dumps(ask | {"horizon": 3, "min_history": 20, "prior": 5.0, "decay": 0.9, "blocks": [4], "reps": 20, "seed": 1}))
    (tmp_path / "market.json").write_text(json.dumps(market))
    todo = [
        {"name": "score", "type": "score", "bundle": str(bundle), "config": str(tmp_path / "score.json")}, {"name": "risk", "type": "risk", "bundle": str(bundle), "config": str(tmp_path / "risk.json")},
        {"name": "refit", "type": "refit", "development": str(development), "market_config": str(tmp_path / "market.json"), "train_end": "1996-12-31", "seed": 1, "candidates": 16},
    ]
    (tmp_path / "jobs.json").write_text(json.dumps(todo))
    assert cli.main(["run-jobs", "--config", str(tmp_path / "jobs.json"), "--output-root", str(tmp_path / "jobs"), "--workers", "3"]) == 0
    done = jobs.run(todo, tmp_path / "jobs")
    assert [r["status"] for r in done["jobs"]] == ["cached"] * 3
    scored, forecast, again = (json.loads(open(f"{r['output']}/task.json").read()) for r in done["jobs"])
    assert scored["windows"] == sum(scored["counts"]) and again["parent"] == artifacts.verify(development)
    assert forecast["scored"] + forecast["pending"] == forecast["origins"] and len(forecast["metrics"]) == 5 and len(forecast["intervals"]) == 2 * 4 and all(r["lo"] <= r["hi"] for r in forecast["intervals"])
    late = spark.read.parquet(f"{done['jobs'][1]['output']}/forecasts.parquet")
    assert late.filter("session_date <= '1999-06-30' OR price_start <= '1999-06-30'").isEmpty()
    rows = open(market["assets"][0]["dataset"]).read()
    try:
        open(market["assets"][0]["dataset"], "a").write("2001-01-01,1,1\n")
        with pytest.raises(ValueError):
            jobs.prepare(todo[0])
    finally:
        open(market["assets"][0]["dataset"], "w").write(rows)


def test_command_line(tmp_path, capsys):
    assert {a for a in ("run", "report", "synthetic", "cross-asset", "joint-study", "joint-validate", "freeze-joint", "score-joint", "run-jobs")} == set(cli.parser()._subparsers._group_actions[0].choices)
    with pytest.raises(SystemExit):
        cli.main(["run"])
    capsys.readouterr()


def test_provenance_sees_loose_files(tmp_path):
    import subprocess

    for args in (["init", "-q"], ["-c", "user.name=a", "-c", "user.email=a@b", "commit", "-q", "--allow-empty", "-m", "x"]):
        subprocess.run(["git", "-C", str(tmp_path), *args], check=True)
    one = artifacts.provenance(tmp_path)
    (tmp_path / "loose.py").write_text("x = 1")
    two = artifacts.provenance(tmp_path)
    assert one["commit"] == two["commit"] and one["changes"] != two["changes"]


def test_files(spark, tmp_path):
    path = tmp_path / "p.csv"
    path.write_text("Date,Close,Adj Close\n2024-01-05,1,4\n2024-01-02,1,2\n")
    got = files.price_csv(spark, str(path), "S").orderBy("session_date").collect()
    assert [r["price"] for r in got] == [2, 4]
    digest = files.file_sha256(spark, str(path))
    (tmp_path / "p.csv.json").write_text(json.dumps({"symbol": "S", "sha256": digest}))
    assert files.check_sidecar(spark, str(path), "S") == digest
    with pytest.raises(ValueError):
        files.check_sidecar(spark, str(path), "T")
    with pytest.raises(ValueError):
        files.price_csv(spark, str(path), "S", price_column="none")
    files.report("<b>", {"t": spark.createDataFrame([("<x>", 1.0)], "k string, v double")}, tmp_path / "r.html")
    page = (tmp_path / "r.html").read_text()
    assert "&lt;b&gt;" in page and "&lt;x&gt;" in page and "<svg" in page


@pytest.fixture
def stream(spark, tmp_path):
    """Runs a streaming operator over rows in three micro-batches."""
    def go(rows, op, name):
        for i, part in enumerate((rows.filter("idx < 10"), rows.filter("idx >= 10 AND idx < 17"), rows.filter("idx >= 17"))):
            part.coalesce(1).write.mode("append").parquet(str(tmp_path / name / f"b={i}"))
        src = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name) + "/b=*")
        q = op(src).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"{name}-c")).start()
        q.processAllAvailable()
        q.stop()
        return spark.table(name)

    return go


def test_streams_equal_batch(spark, stream):
    x = np.random.default_rng(5).standard_normal(30).tolist()
    rows = spark.createDataFrame([(s, i, v * k, v * v, (i % 3) - 1) for s, k in (("a", 1.0), ("b", 2.0)) for i, v in enumerate(x)], "symbol string, idx long, log_return double, q double, state int")
    rows = rows.withColumn("log_return", F.when((F.col("symbol") == "b") & (F.col("idx") == 12), None).otherwise(F.col("log_return"))).cache()
    from massflow.streaming import state as S

    key = lambda df: sorted(map(str, df.collect()))
    want = windows.windows(rows.select("symbol", "idx", "log_return"), 5).select("symbol", "endpoint", "sample")
    assert key(stream(rows, lambda s: S.stream_windows(s, 5), "w")) == key(want)
    m = hmm.Hmm(np.array([0.6, 0.4]), np.array([[0.7, 0.3], [0.2, 0.8]]), np.array([[-1.0], [1.0]]), np.ones((2, 1, 1)), np.zeros(1), np.ones(1))
    want = hmm.causal_filter(rows.filter("log_return IS NOT NULL"), m, ["symbol"], "log_return").select("symbol", "idx", "state")
    assert key(stream(rows, lambda s: S.stream_filter(s, m), "h").select("symbol", "idx", "state")) == key(want)
    batch = risk.forecasts(rows.withColumn("series", F.col("symbol")), ["state"], 2, 4, 2, 5, 2.0, 0.9).filter("expanding IS NOT NULL")
    got = stream(rows, lambda s: S.stream_ewma(s, 0.9, 5), "e").select("symbol", "idx", F.round("ewma", 9).alias("ewma"))
    assert key(got) == key(batch.select("symbol", "idx", F.round("ewma", 9).alias("ewma")))
    got = stream(rows, lambda s: S.stream_matured(s, 2, 4, 2, 2.0, 5), "m").select("symbol", "idx", "matured", F.round("forecast", 9).alias("f"))
    assert key(got) == key(batch.select("symbol", "idx", F.col("state_matured").alias("matured"), F.round("state_mean", 9).alias("f")))


def test_sessions_by_event_time(spark, tmp_path):
    """Ticks out of order count, ticks behind the watermark do not."""
    from massflow.streaming.state import stream_sessions

    at = lambda day, hour: dt.datetime(2024, 1, day, hour)
    batches = [[("a", at(1, 9), 1.0), ("a", at(1, 17), 3.0), ("a", at(1, 12), 2.0), ("b", at(1, 10), 9.0)], [("a", at(2, 9), 4.0), ("a", at(1, 20), 5.0)], [("a", at(3, 9), 6.0)], [("a", at(1, 23), 7.0), ("a", at(3, 8), 8.0), ("a", at(5, 1), 0.0)], [("a", at(9, 1), 0.0)]]
    schema = "symbol string, ts timestamp, price double"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in/b={i}"))
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in") + "/b=*")
    q = stream_sessions(src).writeStream.format("memory").queryName("sessions").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = {(r["symbol"], r["session_start"].day): (r["price"], r["n"], r["available_at"]) for r in spark.table("sessions").collect()}
    assert got == {("a", 1): (5.0, 4, at(2, 2)), ("b", 1): (9.0, 1, at(2, 2)), ("a", 2): (4.0, 1, at(3, 2)), ("a", 3): (6.0, 2, at(4, 2)), ("a", 5): (0.0, 1, at(6, 2))}


def test_fingerprint_is_of_the_rows(spark):
    rows = [(1, "x", 1.5), (2, "y", None), (3, "x", 1.5)]
    of = lambda data, n=1: [r["fingerprint"] for r in ingest.fingerprint(spark.createDataFrame(data, "k int, s string, v double").repartition(n), [], [F.col("s"), F.col("v")]).collect()]
    assert of(rows) == of(rows[::-1], 3) and len(of(rows)[0]) == 26
    assert of(rows) != of(rows[:2]) and of(rows) != of([(1, "x", 1.5), (2, "y", 0.0), (3, "x", 1.5)])
