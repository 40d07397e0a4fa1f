"""Model operators: brute-force ridge, planted signal beats the majority baseline,
same seed gives the same result, OOF covers every train row exactly once."""

import math
import random

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tabforge.operators.infer import BINARY, MULTICLASS
from tabforge.plans import models as M


def test_meta_ridge_equals_closed_form(spark):
    rng = np.random.default_rng(1)
    n, m, k = 200, 3, 5
    X = rng.normal(size=(n, m)) * [1.0, 5.0, 0.1] + [0.0, 2.0, -1.0]
    y = X @ [1.0, -0.5, 3.0] + rng.normal(size=n) * 0.1
    fold = np.arange(n) % k
    rows = [(int(i), int(fold[i]), float(y[i]), *map(float, X[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, fold int, label double, a double, b double, c double")
    oof, _ = M.meta_ridge(df, None, ["a", "b", "c"], k, alpha=1.0)
    got = {r["id"]: r["pred"] for r in oof.collect()}
    for f in range(k):
        tr, va = fold != f, fold == f
        mu, sd = X[tr].mean(0), X[tr].std(0)
        Z = (X[tr] - mu) / sd
        yc = y[tr] - y[tr].mean()
        w = np.linalg.solve(Z.T @ Z + np.eye(m), Z.T @ yc)
        pred = ((X[va] - mu) / sd) @ w + y[tr].mean()
        for i, p in zip(np.where(va)[0], pred):
            assert math.isclose(got[int(i)], p, rel_tol=1e-9, abs_tol=1e-9)


def _planted(spark, n=400, seed=7):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        x1, x2 = rng.random(), rng.random()
        y = 1.0 if x1 + 0.2 * rng.random() > 0.6 else 0.0
        rows.append((i, i % 5, y, [x1, x2]))
    df = spark.createDataFrame(rows, "id long, fold int, label double, f array<double>")
    tr = df.select("id", "fold", "label", array_to_vector("f").alias("features")).cache()
    te = df.where("id < 50").select("id", array_to_vector("f").alias("features")).cache()
    return M.ModelData(tr, te, BINARY, 2), df


@pytest.mark.parametrize("family", ["gbt", "forest", "logistic"])
def test_planted_signal_beats_majority(spark, family):
    data, df = _planted(spark)
    params = {"n_estimators": 10, "max_depth": 3}
    scores = M.cross_validate(lambda: M.make_estimator(family, BINARY, params), data, 5)
    majority = max(df.agg(F.avg("label")).first()[0], 1 - df.agg(F.avg("label")).first()[0])
    assert sum(scores) / len(scores) > majority + 0.05


def test_oof_covers_each_row_once_and_is_deterministic(spark):
    data, _ = _planted(spark)
    fac = lambda: M.make_estimator("forest", BINARY, {"n_estimators": 8, "max_depth": 3})
    oof1, te1 = M.oof_predict("rf", fac, data, 5)
    oof2, _ = M.oof_predict("rf", fac, data, 5)
    a = {r["id"]: (r["fold"], r["score"]) for r in oof1.collect()}
    b = {r["id"]: (r["fold"], r["score"]) for r in oof2.collect()}
    assert len(a) == 400 and a == b
    assert te1.count() == 50


def test_tournament_keeps_failures(spark):
    data, _ = _planted(spark)

    def broken():
        raise RuntimeError("boom")

    res = M.model_tournament([("bad", broken), ("lr", lambda: M.make_estimator("logistic", BINARY))], data, 5).collect()
    r = {x["model"]: x for x in res}
    assert r["bad"]["error"].startswith("RuntimeError") and r["bad"]["is_best"] == 0
    assert r["lr"]["is_best"] == 1 and r["lr"]["cv_mean"] > 0.5


def test_param_map():
    p = M.to_mllib({"n_estimators": 300, "max_depth": 30, "learning_rate": 0.1, "colsample": 0.7, "min_child_samples": 20}, "gbt")
    assert p == {"maxIter": 300, "maxDepth": 30, "stepSize": 0.1, "featureSubsetStrategy": "0.7", "minInstancesPerNode": 20}
    assert M.to_mllib({"n_estimators": 100, "learning_rate": 0.1}, "forest") == {"numTrees": 100}


def test_fit_final_and_threshold_solve_follow_the_signal(spark):
    data, df = _planted(spark)
    labels = spark.createDataFrame([("false", 0, "False"), ("true", 1, "True")], "label string, code int, original string")
    truth = {r["id"]: r["label"] for r in df.collect()}
    final = {r["id"]: r["code"] for r in M.fit_final("forest", {"n_estimators": 8, "max_depth": 3}, data).collect()}
    assert len(final) == 50 and sum(final[i] == truth[i] for i in final) >= 40
    pred, threshold, accuracy = M.threshold_solve("logistic", {}, data, 5, labels)
    got = {r["id"]: r["prediction"] for r in pred.collect()}
    assert set(got.values()) <= {"True", "False"} and len(got) == 50
    assert 0 < threshold < 1 and accuracy >= 0.8
    assert sum((got[i] == "True") == (truth[i] == 1.0) for i in got) >= 40


def test_stack_binary_skips_a_failing_model(spark):
    data, df = _planted(spark)

    def broken():
        raise RuntimeError("boom")

    models = [("lr", lambda: M.make_estimator("logistic", BINARY)), ("bad", broken), ("rf", lambda: M.make_estimator("forest", BINARY, {"n_estimators": 8, "max_depth": 3}))]
    res = M.stack(data, 5, models=models)
    truth = {r["id"]: r["label"] for r in df.collect()}
    got = {r["id"]: int(r["prediction"]) for r in res.predictions.collect()}
    assert res.base_models == ["lr", "rf"] and list(res.failed) == ["bad"] and "boom" in res.failed["bad"]
    assert len(got) == 50 and sum(got[i] == truth[i] for i in got) >= 40
    assert res.oof_meta.count() == 400


def test_oof_multiclass_probabilities(spark):
    rng = np.random.default_rng(3)
    rows = [(i, i % 5, float(i % 3), [float(x) for x in rng.normal(size=3) + 4 * np.eye(3)[i % 3]]) for i in range(150)]
    df = spark.createDataFrame(rows, "id long, fold int, label double, f array<double>")
    tr = df.select("id", "fold", "label", array_to_vector("f").alias("features")).cache()
    data = M.ModelData(tr, tr.where("id < 30").select("id", "features"), MULTICLASS, 3)
    oof, te = M.oof_predict("lr", lambda: M.make_estimator("logistic", MULTICLASS), data, 5)
    scored = {r["id"]: r["score"] for r in oof.collect()}
    assert len(scored) == 150 and all(abs(sum(p) - 1) < 1e-9 for p in scored.values())
    assert sum(int(np.argmax(p)) == i % 3 for i, p in scored.items()) >= 140
    assert all(len(r["score"]) == 3 and abs(sum(r["score"]) - 1) < 1e-9 for r in te.collect())


def test_tune_reports_a_sampled_set(spark):
    data, _ = _planted(spark, n=120)
    row = M.tune("forest", data, 5, n_trials=2, scale=0.02).first()
    assert row["n_trials"] == 2 and 0.5 < row["best_cv_score"] <= 1.0 and set(row["params"]) == set(M.SEARCH_SPACE["forest"])
