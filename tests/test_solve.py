"""Fitted plans, learners with shared fold aggregates, boosters against a plain version, tuning."""

import random

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tabforge.operators.infer import BINARY, MULTICLASS, REGRESSION
from tabforge.plans import boost as B
from tabforge.plans import learners as L
from tabforge.plans import models as M
from tabforge.plans import solve as S
from tabforge.plans import tuning as T

ROWS = "id long, fold int, label double, features array<double>"


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(1)
    n = 400
    x = rng.normal(size=(n, 3)).round(2)
    return {
        "x": x, "fold": rng.integers(0, 3, n),
        REGRESSION: 2 * x[:, 0] + x[:, 2], BINARY: (x[:, 0] + x[:, 1] ** 2 + 0.3 * rng.normal(size=n) > 0.6).astype(float),
        MULTICLASS: (x[:, 0] > 0).astype(float) + (x[:, 1] > 0.5),
    }


def frame(spark, data, task, parts=3):
    rows = [(i, int(f), float(y), [float(v) for v in x]) for i, (f, y, x) in enumerate(zip(data["fold"], data[task], data["x"], strict=True))]
    return spark.createDataFrame(rows, ROWS).repartition(parts).cache()


def scores(df):
    return np.array([r["score"] for r in df.orderBy("id").collect()])


# ---- boosters -----------------------------------------------------------------------------------


def plain_booster(cfg, task, x, y, train, classes):
    """One model fitted on the rows of ``train``, scores of all rows, by recursion over nodes."""
    edges = [x[:, i].min() + (x[:, i].max() - x[:, i].min()) * np.arange(1, cfg.bins) / cfg.bins for i in range(x.shape[1])]
    parts = np.stack([np.searchsorted(e, x[:, i], "right") for i, e in enumerate(edges)], 1)
    known = y[train]
    if task == REGRESSION:
        margin = np.full((len(x), 1), known.mean())
    elif task == BINARY:
        margin = np.full((len(x), 1), np.log(known.mean() / (1 - known.mean())))
    else:
        margin = np.tile([np.log(((known == c).sum() + 1) / (len(known) + classes)) for c in range(classes)], (len(x), 1))

    def outcome(m):
        if task == REGRESSION:
            return m
        e = np.exp(m)
        return 1 / (1 + np.exp(-m)) if task == BINARY else e / e.sum(1, keepdims=True)

    for _ in range(cfg.rounds):
        p = outcome(margin)
        g = p - (y[:, None] if task != MULTICLASS else y[:, None] == np.arange(classes))
        h = np.ones_like(p) if task == REGRESSION else p * (1 - p)
        for c in range(margin.shape[1]):
            add = np.zeros(len(x))

            def grow(rows, depth, g=g[:, c], h=h[:, c], add=add):
                own = np.flatnonzero(rows & train)
                score = lambda i: g[i].sum() ** 2 / (h[i].sum() + cfg.l2)
                best, cut = 1e-12, None
                for j in range(x.shape[1]) if depth < cfg.depth else ():
                    for k in range(cfg.bins - 1):
                        low, high = own[parts[own, j] <= k], own[parts[own, j] > k]
                        if min(len(low), len(high)) >= cfg.min_rows and score(low) + score(high) - score(own) > best + 1e-9:
                            best, cut = score(low) + score(high) - score(own), (j, k)
                if cut is None:
                    add[rows] = -cfg.rate * g[own].sum() / (h[own].sum() + cfg.l2)
                    return
                grow(rows & (parts[:, cut[0]] <= cut[1]), depth + 1)
                grow(rows & (parts[:, cut[0]] > cut[1]), depth + 1)

            grow(np.ones(len(x), bool), 0)
            margin[:, c] += add
    out = outcome(margin)
    return out if task == MULTICLASS else out[:, 0]


@pytest.mark.parametrize("task", [REGRESSION, BINARY, MULTICLASS])
def test_boosters_in_lock_step_equal_plain_ones(spark, data, task):
    n = {REGRESSION: 0, BINARY: 2, MULTICLASS: 3}[task]
    rows = frame(spark, data, task)
    configs = [B.HistBoost(3, 3, 0.3, min_rows=5, bins=8, cut="width"), B.HistBoost(2, 2, 0.5, 0.5, bins=8, cut="width")]
    for cfg, models in zip(configs, B.fit_boosters(configs, rows, task, n, 3), strict=True):
        got, want = scores(models.held_out(rows)), np.zeros((400, 3) if n == 3 else 400)
        for f in range(3):
            want[data["fold"] == f] = plain_booster(cfg, task, data["x"], data[task], data["fold"] != f, n)[data["fold"] == f]
        assert np.abs(got - want).max() < 1e-9
        whole = plain_booster(cfg, task, data["x"], data[task], np.ones(400, bool), n)
        assert np.abs(scores(models.refit(rows)) - whole).max() < 1e-9


def test_one_stump_equals_sql(spark, data):
    """One round of depth 1 on one feature: the best cut and both leaf means, stated in SQL."""
    import duckdb
    import pandas as pd

    x, y = data["x"][:, 0], data[REGRESSION]
    rows = spark.createDataFrame([(i, 0, float(b), [float(a)]) for i, (a, b) in enumerate(zip(x, y, strict=True))], ROWS)
    got = scores(B.HistBoost(1, 1, 1.0, l2=0.0, bins=8, cut="width").fit_folds(rows, REGRESSION, 0, 1).refit(rows))
    con = duckdb.connect()
    con.register("t", pd.DataFrame({"id": range(400), "x": x, "y": y}))
    want = con.execute("""
      with e as (select unnest(range(1, 8)) as k, min(x) as lo, max(x) as hi from t), c as (select k, lo + (hi - lo) * k / 8.0 as v from e),
      s as (select k, v, avg(y) filter (where x < v) as a, avg(y) filter (where x >= v) as b,
        sum(y) filter (where x < v) ** 2 / count(*) filter (where x < v) + sum(y) filter (where x >= v) ** 2 / count(*) filter (where x >= v) as gain
        from c cross join t group by k, v),
      best as (select * from s order by gain desc, k limit 1)
      select case when x < v then a else b end from t cross join best order by id""").fetchall()
    assert np.abs(got - np.array(want)[:, 0]).max() < 1e-9


def test_boosters_draw_rows_and_features_equally_on_every_run(spark, data):
    rows = frame(spark, data, BINARY)
    cfg = B.HistBoost(5, 3, 0.3, rows=0.6, cols=0.5)
    a, b = (scores(cfg.fit_folds(rows, BINARY, 2, 3).held_out(rows)) for _ in range(2))
    assert (a == b).all() and 0.75 < ((a >= 0.5) == (data[BINARY] == 1)).mean()


# ---- learners -----------------------------------------------------------------------------------


def test_newton_logistic_equals_mllib(spark, data):
    from pyspark.ml.classification import LogisticRegression

    rows = frame(spark, data, BINARY)
    models = L.NewtonLogistic(1.0).fit_folds(rows, BINARY, 2, 3)
    mine = scores(models.refit(rows))
    x = data["x"]
    z = (x - x.mean(0)) / x.std(0)
    scaled = spark.createDataFrame([(i, float(y), [float(v) for v in r]) for i, (y, r) in enumerate(zip(data[BINARY], z, strict=True))], "id long, label double, f array<double>")
    scaled = scaled.withColumn("features", array_to_vector("f"))
    lr = LogisticRegression(regParam=1.0 / 400, standardization=False, maxIter=500, tol=1e-10).fit(scaled)
    want = L.MllibModels([lr, lr], BINARY).refit(scaled)
    assert np.abs(mine - scores(want)).max() < 1e-5


def test_ridge_leaves_folds_out_by_subtraction(spark, data):
    rows = frame(spark, data, REGRESSION)
    got = scores(L.Ridge(1.0).fit_folds(rows, REGRESSION, 0, 3).held_out(rows))
    x, y, fold = data["x"], data[REGRESSION], data["fold"]
    for f in range(3):
        a, b = x[fold != f], y[fold != f]
        z = (a - a.mean(0)) / a.std(0)
        w = np.linalg.solve(z.T @ z + np.eye(3), z.T @ (b - b.mean()))
        assert np.abs(got[fold == f] - (b.mean() + (x[fold == f] - a.mean(0)) / a.std(0) @ w)).max() < 1e-9


def test_rows_keep_their_columns_and_empty_tables_work(spark, data):
    rows = frame(spark, data, MULTICLASS)
    models = L.CountedBayes(4).fit_folds(rows, MULTICLASS, 3, 3)
    out = models.mean(rows.withColumn("note", F.lit("x")), "s2")
    assert out.columns == ["id", "fold", "label", "features", "note", "s2"]
    assert all(abs(sum(r["s2"]) - 1) < 1e-9 for r in out.collect())
    assert models.mean(rows.limit(0)).count() == 0


# ---- plans --------------------------------------------------------------------------------------


def competition(spark, n=240, seed=3):
    """A small competition: composite code, bool-like text, date text, null measures, a true/false target."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        spend, sleeps = rng.choice([None, 0.0, rng.random() * 100]), rng.choice(["True", "False", None])
        target = "True" if (sleeps == "True" or (spend or 0) > 50) != (rng.random() < 0.05) else "False"
        rows.append((f"{i // 3:04d}_{i % 3 + 1}", f"{rng.choice('ABC')}/{rng.randint(0, 30)}/{rng.choice('PS')}", sleeps, spend, f"2024-0{rng.randint(1, 9)}-1{rng.randint(0, 9)}", f"town {rng.randint(1, 8)}", target))
    df = spark.createDataFrame(rows, "pid string, code string, sleeps string, spend double, day string, town string, target string")
    return df.where("pid < '0060'"), df.where("pid >= '0060'")


def test_solve_writes_predictions_in_the_targets_spelling(spark, tmp_path):
    train, test = competition(spark)
    template = test.select("pid", F.lit("False").alias("target"))
    out = str(tmp_path / "submission")
    learners = [("bayes", L.CountedBayes(8)), ("ridge", L.Ridge()), ("forest", L.MllibLearner(lambda: M.make_estimator("forest", BINARY, {"n_estimators": 8, "max_depth": 4})))]
    solved = S.solve(train, test.drop("target"), template, out, learners=[*learners, ("bad", None)], k=4)
    assert solved.plan.names == ["bayes", "ridge", "forest"] and list(solved.plan.failed) == ["bad"]
    read = spark.read.option("header", True).csv(out)
    assert read.columns == ["pid", "target"] and {r["target"] for r in read.collect()} == {"True", "False"}
    truth = {r["pid"]: r["target"] for r in test.collect()}
    got = {r["pid"]: r["target"] for r in read.collect()}
    assert set(got) == set(truth) and sum(got[i] == truth[i] for i in truth) >= 0.8 * len(truth)
    assert solved.plan.quality().first()["accuracy"] >= 0.8
    # the plan goes on to further tables
    assert solved.plan.apply(test.limit(0)).count() == 0 and solved.plan.apply(train).count() == train.count()


def test_solve_with_domain_features_and_boosters(spark):
    from tabforge.operators.features import DomainSpec

    train, test = competition(spark)
    spec = DomainSpec(composite_col="code", measure_cols=("spend",), flag_col="sleeps")
    plan = S.fit_plan(train, "pid", "target", ["code", "sleeps", "spend", "town"], [("a", B.HistBoost(8, 3, 0.3)), ("b", B.HistBoost(5, 2, 0.3))], k=3, engineer=S.Engineer.domain(spec))
    truth = {r["pid"]: r["target"] for r in test.collect()}
    got = {r["id"]: r["prediction"] for r in plan.apply(test).collect()}
    assert sum(got[i] == truth[i] for i in truth) >= 0.85 * len(truth)


def test_multiclass_plan_with_softmax_meta(spark):
    rng = np.random.default_rng(5)
    rows = [(i, float(a), float(b), "low" if a < -0.5 else "High" if a > 0.5 else "mid") for i, (a, b) in enumerate(rng.normal(size=(300, 2)))]
    df = spark.createDataFrame(rows, "id long, a double, b double, level string")
    plan = S.fit_plan(df.where("id < 200"), "id", "level", ["a", "b"], [("fine", L.CountedBayes(16)), ("rough", L.CountedBayes(4))], k=4)
    got = {r["id"]: r["prediction"] for r in plan.apply(df.where("id >= 200")).collect()}
    assert plan.task.kind == MULTICLASS and sum(got[r[0]] == r[3] for r in rows[200:]) >= 85


def test_all_learners_failing_is_an_error(spark):
    train, _ = competition(spark, 60)
    with pytest.raises(RuntimeError, match="all base learners failed"):
        S.fit_plan(train, "pid", "target", ["spend"], [("bad", None)], k=3)


# ---- tuning -------------------------------------------------------------------------------------


def test_sampler_is_no_worse_than_random_draws():
    space = {"a": (0.0, 1.0, "float"), "b": (1, 64, "int"), "c": (0.01, 10.0, "log")}
    quality = lambda p: -((p["a"] - 0.7) ** 2) - ((p["b"] - 40) / 64) ** 2 - 0.05 * (np.log(p["c"])) ** 2
    for seed in range(5):
        sampler = T.ParzenSampler(space, seed)
        while len(sampler.points) < 100:
            points = sampler.ask(10)
            sampler.tell(points, [quality(sampler.params(p)) for p in points])
        draws = np.random.default_rng(seed).random((100, 3))
        assert max(sampler.scores) >= max(quality(sampler.params(p)) for p in draws)
        assert all(1 <= sampler.params(p)["b"] <= 64 and 0.01 <= sampler.params(p)["c"] <= 10 for p in sampler.points)


def test_tuning_keeps_every_trial_and_its_score(spark, data):
    rows = frame(spark, data, BINARY)
    make = lambda p: L.CountedBayes(int(p["bins"]), p["add"]) if p["bins"] > 3 else None  # noqa: E731  a failing learner
    table = T.tune(make, {"bins": (2, 40, "int"), "add": (0.1, 5.0, "log")}, rows, BINARY, 2, 3, n_trials=24, batch=8).collect()
    assert [r["trial"] for r in table] == list(range(24)) and sum(r["is_best"] for r in table) == 1
    best = next(r for r in table if r["is_best"])
    assert best["cv_mean"] == max(r["cv_mean"] for r in table if r["cv_mean"] is not None)
    assert all((r["cv_mean"] is None) == (r["params"]["bins"] <= 3) == (r["error"] is not None) for r in table)
    again, _ = T.cv_scores([("x", L.CountedBayes(int(best["params"]["bins"]), best["params"]["add"]))], rows, BINARY, 2, 3)
    assert abs(np.mean(again["x"]) - best["cv_mean"]) < 1e-12
