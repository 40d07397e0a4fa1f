"""What was mended after the findings of round 3."""

from pyspark.sql import functions as F


def _order_like(spark):
    """Regression rows with repeated and null ids (the reader's folds and labels with them)."""
    rows = [(i % 110, i % 110 % 4, float(i % 110), [float(i % 110 % 7), float(i % 110 % 11)]) for i in range(120)]
    rows.append((None, None, 5.0, [1.0, 2.0]))
    return spark.createDataFrame(rows, "id long, fold int, label double, features array<double>")


def test_stacked_scores_meet_without_a_shuffle(spark):
    from pyspark.ml.functions import array_to_vector

    from tabforge.operators.infer import REGRESSION
    from tabforge.plans import models as M
    from tabforge.plans.q_closed import linear_on

    rows = _order_like(spark).withColumn("features", array_to_vector("features")).cache()
    data = M.ModelData(rows, rows.select("id", "features"), REGRESSION, 0, ["a", "b"])
    made = [(c, linear_on(i)) for i, c in enumerate("ab")]
    train, test, cols = M.stack_rows(data, [(c, [M.fit_score(make, data, f)[0] for f in range(4)]) for c, make in made], 4)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert cols == ["a", "b"] and "Exchange" not in plan(train) and "Join" not in plan(test)
    # as pivoted from the long table of scores
    longs = [M.oof_predict(c, make, data, 4) for c, make in made]
    oof, mean = (longs[0][i].unionByName(longs[1][i]) for i in (0, 1))
    old = M.stack_wide(oof, cols, True).join(rows.select("id", "label"), "id")
    places = lambda df, *by: sorted((*(r[c] if r[c] is not None else -1 for c in by), *(round(r[c], 9) for c in cols)) for r in df.collect())
    assert places(train, "id", "fold", "label") == places(old, "id", "fold", "label")
    assert places(test, "id") == places(M.stack_wide(mean, cols, False), "id")
    assert test.where(F.col("id").isNull()).count() == 1


def _two_classes(spark):
    import numpy as np

    x = np.random.default_rng(3).normal(size=(300, 3))
    rows = [(i, i % 3, float(x[i, 0] > 0.2 * x[i, 1]), x[i].tolist()) for i in range(300)]
    return spark.createDataFrame(rows, "id long, fold int, label double, features array<double>").repartition(6, "id").cache()


def test_a_tournament_fits_no_model_of_all_rows_and_scores_alike(spark, monkeypatch):
    from tabforge.operators.infer import BINARY
    from tabforge.plans import learners as L
    from tabforge.plans import models as M
    from tabforge.plans import tuning as T
    from tabforge.plans.boost import HistBoost, fit_boosters

    rows, fits = _two_classes(spark), []

    def forest():
        fits.append(1)
        return M.make_estimator("forest", BINARY, {"n_estimators": 5, "max_depth": 4})

    small = HistBoost(6, 3, 0.3, rows=0.8, min_rows=2)
    scores, failed = T.cv_scores([("b", small), ("f", L.MllibLearner(forest))], rows, BINARY, 2, 3)
    assert not failed and len(fits) == 3  # formerly 4
    held = [fit_boosters([small], rows, BINARY, 2, 3, refit)[0] for refit in (True, False)]
    assert held[0].k == held[1].k == 3 and held[1].params[-1] is None
    got = [{r["id"]: r["score"] for r in m.held_out(rows).collect()} for m in held]
    assert got[0] == got[1]
    hits = held[0].held_out(rows).groupBy("fold").agg(F.avg(((F.col("score") >= 0.5).cast("int") == F.col("label")).cast("double")).alias("a"))
    assert scores["b"] == [r["a"] for r in hits.orderBy("fold").collect()]
