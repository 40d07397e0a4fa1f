"""Cross-validation, model selection, tuning and stacking on MLlib.

Design:
* the feature table is prepared once (E9), assembled into a vector and persisted
  (MEMORY_AND_DISK, so a lost executor recomputes from lineage instead of failing);
* the k fold fits of one model are independent Spark jobs submitted from a driver
  thread pool, so a cluster runs them side by side;
* out-of-fold scores are a long table ``(id, fold, model, score)``; test scores
  are the mean over the k fold models (one aggregate on id);
* base-model scores are pivoted to one column per model with a fixed model list
  and the lineage is cut with a reliable checkpoint before the meta level.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

from pyspark import StorageLevel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabforge.operators import encode as E
from tabforge.operators.decide import GRID, best_threshold, threshold_sweep
from tabforge.operators.infer import BINARY, MULTICLASS, REGRESSION
from tabforge.session import cut_lineage

SEED = 42

# ----------------------------------------------------------------------------- M9 / param map

# reference parameter name -> MLlib parameter (arguments of M9/M14)
PARAM_MAP = {
    "n_estimators": "maxIter",
    "max_depth": "maxDepth",
    "learning_rate": "stepSize",
    "subsample": "subsamplingRate",
    "colsample": "featureSubsetStrategy",
    "colsample_bytree": "featureSubsetStrategy",
    "min_child_samples": "minInstancesPerNode",
    "min_samples_leaf": "minInstancesPerNode",
    "min_child_weight": "minInstancesPerNode",
    "max_features": "featureSubsetStrategy",
}
KNOWN = {*PARAM_MAP.values(), "numTrees", "regParam"}
#: MLlib trees go no deeper.
DEPTH_LIMIT = 30

# fixed default parameter sets of the four base learners (rounds, depth, rate, rows, cols)
BASE_PARAMS = {
    "gbt_a": {"n_estimators": 500, "max_depth": 6, "learning_rate": 0.05, "subsample": 0.8, "colsample": 0.7},
    "gbt_b": {"n_estimators": 500, "max_depth": 6, "learning_rate": 0.05, "subsample": 0.8, "colsample": 0.7, "min_child_samples": 20},
    "gbm": {"n_estimators": 300, "max_depth": 5, "learning_rate": 0.05, "subsample": 0.8},
    "forest": {"n_estimators": 500, "max_depth": 6},
}


#: The same four as histogram boosters (penalties and least rows as the reference sets them), and
#: the three boosters of the tournament.
BASE_BOOST = {
    "gbt_a": {"rounds": 500, "depth": 6, "rate": 0.05, "l2": 1.0, "rows": 0.8, "cols": 0.7, "min_rows": 3, "min_gain": 0.1},
    "gbt_b": {"rounds": 500, "depth": 6, "rate": 0.05, "l2": 0.5, "rows": 0.8, "cols": 0.7, "min_rows": 20},
    "gbm": {"rounds": 300, "depth": 5, "rate": 0.05, "l2": 0.0, "rows": 0.8},
    "cat": {"rounds": 500, "depth": 6, "rate": 0.05, "l2": 3.0},
}
TOURNAMENT_BOOST = {
    "gbt_a": {"rounds": 400, "depth": 6, "rate": 0.05, "rows": 0.8, "cols": 0.8, "min_rows": 3, "min_gain": 0.1},
    "gbt_b": {"rounds": 400, "depth": 6, "rate": 0.05, "rows": 0.8, "cols": 0.8, "min_rows": 20},
    "gbm": {"rounds": 300, "depth": 5, "rate": 0.05, "l2": 0.0, "rows": 0.8},
}
TOURNAMENT_FOREST = {"n_estimators": 300, "max_depth": None}


def to_mllib(params: dict, family: str) -> dict:
    """Common booster parameter names to MLlib ones for a model family. Unknown names and depths
    beyond MLlib's limit raise; ``max_depth=None`` is that limit."""
    out = {}
    for k, v in params.items():
        name = PARAM_MAP.get(k, k)
        if name not in KNOWN:
            raise ValueError(f"unknown model parameter: {k}")
        if name == "maxDepth":
            v = DEPTH_LIMIT if v is None else int(v)
            if v > DEPTH_LIMIT:
                raise ValueError(f"max_depth {v} is beyond the limit of {DEPTH_LIMIT}")
        if name == "maxIter" and family == "forest":
            name = "numTrees"
        if family == "forest" and name == "stepSize":
            continue
        if name == "featureSubsetStrategy":
            v = v if isinstance(v, str) else str(min(1.0, float(v)))
        if name in ("maxIter", "numTrees", "maxDepth", "minInstancesPerNode"):
            v = int(v)
        out[name] = v
    return out


def make_estimator(family: str, task: str, params: dict | None = None, features: str = "features", label: str = "label"):
    """Model name -> MLlib estimator; unknown names fall back to a random forest.
    Multi-class boosting is not available in MLlib, so it maps to the forest."""
    p = to_mllib(params or {}, "gbt" if family.startswith("gbt") or family == "gbm" else family)
    common = {"featuresCol": features, "labelCol": label, "seed": SEED}
    if family in ("logistic", "linear"):
        if task == REGRESSION:
            return LinearRegression(featuresCol=features, labelCol=label, regParam=p.get("regParam", 0.0))
        return LogisticRegression(featuresCol=features, labelCol=label, maxIter=100, regParam=p.get("regParam", 0.0))
    if (family.startswith("gbt") or family == "gbm") and task != MULTICLASS:
        keep = {k: v for k, v in p.items() if k in ("maxIter", "maxDepth", "stepSize", "subsamplingRate", "featureSubsetStrategy", "minInstancesPerNode")}
        cls = GBTRegressor if task == REGRESSION else GBTClassifier
        return cls(**common, **keep)
    keep = {k: v for k, v in p.items() if k in ("numTrees", "maxDepth", "subsamplingRate", "featureSubsetStrategy", "minInstancesPerNode")}
    if "maxIter" in p and "numTrees" not in keep:
        keep["numTrees"] = int(p["maxIter"])
    cls = RandomForestRegressor if task == REGRESSION else RandomForestClassifier
    return cls(**common, **keep)


def base_models(task: str, scale: float = 1.0) -> list[tuple[str, Callable[[], object]]]:
    """M9: the four base learners; ``scale`` multiplies the number of rounds/trees."""
    out = []
    for name, params in BASE_PARAMS.items():
        p = dict(params)
        p["n_estimators"] = max(1, int(round(p["n_estimators"] * scale)))
        fam = "forest" if name == "forest" else name
        out.append((name, (lambda fam=fam, p=p: make_estimator(fam, task, p))))
    return out


# ----------------------------------------------------------------------------- data prep


@dataclass
class ModelData:
    """Assembled, persisted vectors of train (with fold and label) and test."""

    train: DataFrame  # id, fold, label, features
    test: DataFrame | None  # id, features
    task: str
    n_classes: int
    feature_cols: list[str] = field(default_factory=list)

    def release(self):
        self.train.unpersist()
        if self.test is not None:
            self.test.unpersist()


def prepare_model_data(
    train: DataFrame, test: DataFrame | None, id_col: str, label_col: str, fold_col: str, feature_cols: list[str], task: str,
    encoded_cols: list[str] = (),
) -> ModelData:
    """E9 + E8: fit imputer/encoder on train (all rows, no target involved), apply to
    both, assemble and persist once."""
    # several fit aggregates read train: keep it (and test) materialised meanwhile
    train = train.persist(StorageLevel.MEMORY_AND_DISK)
    if test is not None:
        test = test.persist(StorageLevel.MEMORY_AND_DISK)
    prep = E.fit_prepare(train, feature_cols, list(encoded_cols))
    tr = E.apply_prepare(train, prep, keep=[id_col, fold_col, label_col])
    tr = E.assemble(tr, prep.feature_cols).select(
        F.col(id_col).alias("id"), F.col(fold_col).alias("fold"), F.col(label_col).cast("double").alias("label"), "features"
    )
    # Cut the lineage here (reliable checkpoint in spark.checkpoint.dir): every fold
    # fit, transform and union below then plans against a short scan instead of
    # the whole feature pipeline, which also keeps plan descriptions small. The
    # checkpointed copy is persisted for the many passes of the fits.
    tr = cut_lineage(tr).persist(StorageLevel.MEMORY_AND_DISK)
    te = None
    if test is not None:
        te = E.apply_prepare(test, prep, keep=[id_col])
        te = E.assemble(te, prep.feature_cols).select(F.col(id_col).alias("id"), "features")
        te = cut_lineage(te).persist(StorageLevel.MEMORY_AND_DISK)
    n_classes = 0
    if task != REGRESSION:
        n_classes = int(tr.agg(F.max("label")).first()[0]) + 1
    if te is not None:
        te.count()
        test.unpersist()
    train.unpersist()
    return ModelData(tr, te, task, n_classes, prep.feature_cols)


# ----------------------------------------------------------------------------- M3/M4


def _score_col(task: str) -> F.Column:
    if task == REGRESSION:
        return F.col("prediction")
    if task == BINARY:
        return vector_to_array("probability")[1]
    return vector_to_array("probability")


def fit_score(factory, data: ModelData, fold: int) -> tuple[object, DataFrame]:
    """M3: fit on all folds but ``fold``, score the held-out fold."""
    model = factory().fit(data.train.where(F.col("fold") != fold))
    scored = model.transform(data.train.where(F.col("fold") == fold))
    return model, scored


def _fold_metric(scored: DataFrame, task: str) -> float:
    if task == REGRESSION:
        return -scored.agg(F.avg(F.pow(F.col("prediction") - F.col("label"), 2))).first()[0]
    return scored.agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]


def _pool(n: int) -> ThreadPoolExecutor:
    return ThreadPoolExecutor(max_workers=max(1, min(n, 8)))


def cross_validate(factory, data: ModelData, k: int) -> list[float]:
    """M4: fold scores (accuracy, or negative MSE for regression), folds fitted concurrently."""
    def one(f):
        _, scored = fit_score(factory, data, f)
        return _fold_metric(scored, data.task)

    with _pool(k) as ex:
        return list(ex.map(one, range(k)))


def model_tournament(candidates: list[tuple[str, Callable]], data: ModelData, k: int) -> DataFrame:
    """M6: CV every candidate; failures are kept with their error; the best mean wins
    (first listed on ties). Result: one row per candidate."""
    rows = []
    for rank, (name, factory) in enumerate(candidates):
        try:
            sc = cross_validate(factory, data, k)
            mean = sum(sc) / len(sc)
            std = math.sqrt(sum((s - mean) ** 2 for s in sc) / len(sc))
            rows.append((name, rank, round(mean, 5), round(std, 5), ",".join(f"{s:.5f}" for s in sc), None))
        except Exception as e:  # noqa: BLE001 - failure isolation per candidate
            rows.append((name, rank, None, None, None, f"{type(e).__name__}: {e}"))
    spark = data.train.sparkSession
    res = spark.createDataFrame(rows, "model string, candidate_rank int, cv_mean double, cv_std double, cv_scores string, error string")
    ok = [r for r in rows if r[2] is not None]
    best = sorted(ok, key=lambda r: (-r[2], r[1]))[0][0] if ok else None
    return res.withColumn("is_best", (F.col("model") == F.lit(best)).cast("int") if best else F.lit(0))


def learner_tournament(candidates: list[tuple[str, object]], data: ModelData, k: int) -> DataFrame:
    """M6 for learners of the shared protocol (boosters in lock-step): one row per candidate as in
    ``model_tournament``; if all fail, no row is best."""
    from tabforge.plans.tuning import cv_scores

    scores, failed = cv_scores(candidates, data.train, data.task, data.n_classes, k)
    rows = []
    for rank, (name, _) in enumerate(candidates):
        sc = scores.get(name)
        if sc is None:
            rows.append((name, rank, None, None, None, failed[name], 0))
            continue
        mean = sum(sc) / len(sc)
        std = math.sqrt(sum((s - mean) ** 2 for s in sc) / len(sc))
        rows.append((name, rank, round(mean, 5), round(std, 5), ",".join(f"{s:.5f}" for s in sc), None, 0))
    ok = [r for r in rows if r[2] is not None]
    best = sorted(ok, key=lambda r: (-r[2], r[1]))[0][0] if ok else None
    out = [(*r[:6], int(r[0] == best)) for r in rows]
    return data.train.sparkSession.createDataFrame(out, "model string, candidate_rank int, cv_mean double, cv_std double, cv_scores string, error string, is_best int")


def quick_cv(data: ModelData, k: int = 3, rounds: int = 100, depth: int = 5) -> tuple[float | None, str | None]:
    """M5: (k-fold score of a small booster, error) to compare feature sets, on folds of its own. A
    failed run gives no score (ranked last), never 0, and its whole error text."""
    from tabforge.operators.folds import assign_folds, assign_stratified_folds
    from tabforge.plans.boost import HistBoost
    from tabforge.plans.tuning import cv_scores

    rows = data.train.drop("fold")
    rows = cut_lineage(assign_folds(rows, k, "id") if data.task == REGRESSION else assign_stratified_folds(rows, k, "id", "label"))
    scores, failed = cv_scores([("small", HistBoost(rounds=rounds, depth=depth, rate=0.1))], rows, data.task, data.n_classes, k)
    return (sum(scores["small"]) / len(scores["small"]), None) if "small" in scores else (None, failed["small"])


# ----------------------------------------------------------------------------- M7/M8


def oof_predict(name: str, factory, data: ModelData, k: int) -> tuple[DataFrame, DataFrame | None]:
    """M7/M8: OOF scores for train rows (each by the model that did not see its fold)
    and test scores averaged over the k fold models (element-wise for class
    probabilities)."""
    sc = _score_col(data.task)

    def one(f):
        model, scored = fit_score(factory, data, f)
        oof = scored.select("id", "fold", F.lit(name).alias("model"), sc.alias("score"))
        te = model.transform(data.test).select("id", sc.alias("score")) if data.test is not None else None
        return oof, te

    with _pool(k) as ex:
        parts = list(ex.map(one, range(k)))
    oof = reduce(lambda a, b: a.unionByName(b), [p[0] for p in parts])
    test = None
    if data.test is not None:
        allte = reduce(lambda a, b: a.unionByName(b), [p[1] for p in parts])
        if data.task == MULTICLASS:
            ex = allte.select("id", F.posexplode("score").alias("c", "s"))
            test = (
                ex.groupBy("id", "c").agg(F.avg("s").alias("s"))
                .groupBy("id").agg(F.array_sort(F.collect_list(F.struct("c", "s"))).alias("cs"))
                .select("id", F.lit(name).alias("model"), F.transform("cs", lambda x: x["s"]).alias("score"))
            )
        else:
            test = allte.groupBy("id").agg(F.avg("score").alias("score")).select("id", F.lit(name).alias("model"), "score")
    return oof, test


# ----------------------------------------------------------------------------- J6 / M10 / M11


def stack_wide(long: DataFrame, models: list[str], has_fold: bool) -> DataFrame:
    """One column per base model (fixed list, so no pivot discovery job)."""
    keys = ["id", "fold"] if has_fold else ["id"]
    return long.groupBy(*keys).pivot("model", models).agg(F.first("score"))


def stack_rows(data: ModelData, fitted: list[tuple[str, list]], k: int) -> tuple[DataFrame, DataFrame, list[str]]:
    """J6 without a shuffle of scores: each row gets the scores of all base models (name, its k fold
    models) as columns where it lies. Train rows (id, fold, label, scores; a null id takes no part)
    by the models that left their fold out; test rows (id, scores) by the mean over the k models, one
    row an id."""
    sc, many = _score_col(data.task), data.task == MULTICLASS
    cols = [f"{name}_p{c}" for name, _ in fitted for c in range(data.n_classes)] if many else [name for name, _ in fitted]

    def scored(rows, asked):
        for out, model in asked:
            rows = model.transform(rows).select(*rows.columns, sc.alias(out))
        return rows

    def spread(values):
        """The columns of each model: one, or one a class."""
        wide = [v(c) for v in values for c in (range(data.n_classes) if many else [None])]
        return [x.alias(c) for x, c in zip(wide, cols, strict=True)]

    def mean(i):
        return lambda c: reduce(lambda a, b: a + b, [F.col(f"__{i}_{f}") if c is None else F.col(f"__{i}_{f}")[c] for f in range(k)]) / F.lit(float(k))

    own = [lambda c, i=i: F.col(f"__{i}") if c is None else F.col(f"__{i}")[c] for i in range(len(fitted))]
    train = data.train.where(F.col("id").isNotNull())
    parts = [scored(train.where(F.col("fold") == f), [(f"__{i}", m[f]) for i, (_, m) in enumerate(fitted)]).select("id", "fold", "label", *spread(own)) for f in range(k)]
    test = scored(data.test, [(f"__{i}_{f}", m[f]) for i, (_, m) in enumerate(fitted) for f in range(k)])
    test = test.select("id", *spread([mean(i) for i in range(len(fitted))])).groupBy("id").agg(*[F.avg(F.col(f"`{c}`")).alias(c) for c in cols])
    return reduce(DataFrame.unionByName, parts), test, cols


def meta_logistic(train_s: DataFrame, test_s: DataFrame | None, cols: list[str], k: int, c_reg: float = 1.0):
    """K-fold OOF logistic regression on per-fold standardised base scores.
    MLlib minimises mean loss + lambda/2 |w|^2; C * sum(loss) + |w|^2 / 2 gives
    lambda = 1 / (C * n_train)."""
    spark = train_s.sparkSession

    def one(f):
        tr = train_s.where(F.col("fold") != f)
        n = tr.count()
        scale = E.fit_standard_scale(tr, cols)
        ztr = E.assemble(E.apply_standard_scale(tr, scale, "_z"), [c + "_z" for c in cols], "zf")
        lr = LogisticRegression(featuresCol="zf", labelCol="label", regParam=1.0 / (c_reg * n), elasticNetParam=0.0,
                                standardization=False, maxIter=1000, tol=1e-6)
        model = lr.fit(ztr)
        va = E.assemble(E.apply_standard_scale(train_s.where(F.col("fold") == f), scale, "_z"), [c + "_z" for c in cols], "zf")
        oof = model.transform(va).select("id", "fold", "label", vector_to_array("probability").alias("proba"))
        te = None
        if test_s is not None:
            zte = E.assemble(E.apply_standard_scale(test_s, scale, "_z"), [c + "_z" for c in cols], "zf")
            te = model.transform(zte).select("id", vector_to_array("probability").alias("proba"))
        return oof, te

    with _pool(k) as ex:
        parts = list(ex.map(one, range(k)))
    oof = reduce(lambda a, b: a.unionByName(b), [p[0] for p in parts])
    te = None
    if test_s is not None:
        allte = reduce(lambda a, b: a.unionByName(b), [p[1] for p in parts])
        ex_ = allte.select("id", F.posexplode("proba").alias("c", "s")).groupBy("id", "c").agg(F.avg("s").alias("s"))
        te = ex_.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("c", "s"))).alias("cs")).select(
            "id", F.transform("cs", lambda x: x["s"]).alias("proba")
        )
    del spark
    return oof, te


def ridge_gram(train_s: DataFrame, cols: list[str]) -> DataFrame:
    """M11 aggregate: per fold n, sums, cross products and target sums (one groupBy)."""
    aggs = [F.count(F.lit(1)).alias("n"), F.sum("label").alias("sy")]
    for i, a in enumerate(cols):
        aggs += [F.sum(a).alias(f"s_{i}"), F.sum(F.col(a) * F.col("label")).alias(f"sxy_{i}")]
        for j in range(i, len(cols)):
            aggs.append(F.sum(F.col(a) * F.col(cols[j])).alias(f"sxx_{i}_{j}"))
    return train_s.groupBy("fold").agg(*aggs)


def meta_ridge(train_s: DataFrame, test_s: DataFrame | None, cols: list[str], k: int, alpha: float = 1.0):
    """K-fold OOF ridge on per-fold standardised scores with an unpenalised
    intercept, solved from the Gram aggregate (leave-fold-out by subtraction);
    only a (m+1)^2 system per fold is solved on the driver."""
    import numpy as np

    m = len(cols)
    # sums around the column means: raw second moments of large values cancel
    mid = train_s.agg(*[F.avg(c).alias(f"m_{i}") for i, c in enumerate(cols)]).first()
    centre = np.array([mid[f"m_{i}"] or 0.0 for i in range(m)], float)
    shifted = train_s.withColumns({c: F.col(c) - F.lit(float(centre[i])) for i, c in enumerate(cols)})
    g = {r["fold"]: r.asDict() for r in ridge_gram(shifted, cols).collect()}

    def vecs(r):
        s = np.array([r[f"s_{i}"] for i in range(m)], float)
        sxy = np.array([r[f"sxy_{i}"] for i in range(m)], float)
        sxx = np.zeros((m, m))
        for i in range(m):
            for j in range(i, m):
                sxx[i, j] = sxx[j, i] = r[f"sxx_{i}_{j}"]
        return float(r["n"]), float(r["sy"]), s, sxy, sxx

    tot = [vecs(r) for r in g.values()]
    N, SY = sum(t[0] for t in tot), sum(t[1] for t in tot)
    S, SXY, SXX = sum(t[2] for t in tot), sum(t[3] for t in tot), sum(t[4] for t in tot)
    coefs = []
    for f in range(k):
        n_f, sy_f, s_f, sxy_f, sxx_f = vecs(g[f]) if f in g else (0.0, 0.0, np.zeros(m), np.zeros(m), np.zeros((m, m)))
        n, sy, s, sxy, sxx = N - n_f, SY - sy_f, S - s_f, SXY - sxy_f, SXX - sxx_f
        mu, ybar = s / n, sy / n
        cov = sxx - n * np.outer(mu, mu)
        sd = np.sqrt(np.maximum(np.diag(cov) / n, 0.0))
        sd[sd == 0] = 1.0
        zz = cov / np.outer(sd, sd)
        zy = (sxy - n * mu * ybar) / sd
        w = np.linalg.solve(zz + alpha * np.eye(m), zy)
        coefs.append((f, float(ybar), [float(x) for x in mu + centre], [float(x) for x in sd], [float(x) for x in w]))

    def pred_expr(mu, sd, w, b):
        return reduce(lambda a, x: a + x, [F.lit(w[i]) * (F.col(c) - F.lit(mu[i])) / F.lit(sd[i]) for i, c in enumerate(cols)], F.lit(b))

    oof = reduce(
        lambda a, b: a.unionByName(b),
        [train_s.where(F.col("fold") == f).select("id", "fold", "label", pred_expr(mu, sd, w, b).alias("pred")) for f, b, mu, sd, w in coefs],
    )
    te = None
    if test_s is not None:
        avg = reduce(lambda a, x: a + x, [pred_expr(mu, sd, w, b) for f, b, mu, sd, w in coefs]) / F.lit(float(k))
        te = test_s.select("id", avg.alias("pred"))
    return oof, te


# ----------------------------------------------------------------------------- M12


@dataclass
class StackResult:
    predictions: DataFrame  # id, prediction (decoded)
    oof_meta: DataFrame
    threshold: float | None
    base_models: list[str]
    failed: dict[str, str]


def stack(
    data: ModelData, k: int, labels: DataFrame | None = None, scale: float = 1.0, models: list[tuple[str, Callable]] | None = None
) -> StackResult:
    """M12 after preparation: base OOF -> pivot -> checkpoint -> meta OOF ->
    threshold (binary) / argmax (multi-class) / value (regression) -> decode."""
    from tabforge.operators.decide import argmax_class
    from tabforge.operators.infer import decode_predictions

    cands = models or base_models(data.task, scale)
    # every fit and every fold's scores read these rows again
    for rows in (data.train, data.test):
        if rows.storageLevel == StorageLevel.NONE:
            rows.persist(StorageLevel.MEMORY_AND_DISK)
    fitted, failed = [], {}
    for name, factory in cands:
        try:
            with _pool(k) as ex:
                fitted.append((name, list(ex.map(lambda f, make=factory: fit_score(make, data, f)[0], range(k)))))
        except Exception as e:  # noqa: BLE001 - a failing model is skipped
            failed[name] = f"{type(e).__name__}: {e}"
    if not fitted:
        raise RuntimeError(f"all base models failed: {failed}")
    names = [name for name, _ in fitted]
    wide_tr, wide_te, cols = stack_rows(data, fitted, k)
    wide_tr, wide_te = cut_lineage(wide_tr), cut_lineage(wide_te)
    data.release()  # the meta level reads only the checkpointed score tables
    thr = None
    if data.task == REGRESSION:
        oof, te = meta_ridge(wide_tr, wide_te, cols, k)
        pred = te.select("id", F.col("pred").alias("prediction"))
        oof_meta = oof.select("id", "fold", "label", F.col("pred").alias("score"))
    else:
        oof, te = meta_logistic(wide_tr, wide_te, cols, k)
        if data.task == BINARY:
            oof_meta = oof.select("id", "fold", "label", F.col("proba")[1].alias("score"))
            best = best_threshold(threshold_sweep(oof_meta.withColumn("y", F.col("label").cast("int")), "y", "score", GRID)).first()
            thr = best["threshold"]
            pred = te.select("id", (F.col("proba")[1] >= F.lit(thr)).cast("int").alias("code"))
        else:
            oof_meta = oof.select("id", "fold", "label", argmax_class("proba").cast("double").alias("score"))
            pred = te.select("id", argmax_class("proba").alias("code"))
        if labels is not None:
            pred = decode_predictions(pred, "code", labels, "prediction").select("id", "prediction")
        else:
            pred = pred.select("id", F.col("code").cast("string").alias("prediction"))
    return StackResult(pred, oof_meta, thr, names, failed)


# ----------------------------------------------------------------------------- M13/M14


# fixed search ranges per family (low, high, kind)
SEARCH_SPACE = {
    "gbt": {"n_estimators": (200, 800, "int"), "max_depth": (3, 8, "int"), "learning_rate": (0.01, 0.15, "log"),
            "subsample": (0.6, 1.0, "float"), "colsample": (0.5, 1.0, "float")},
    "forest": {"n_estimators": (100, 500, "int"), "max_depth": (5, 20, "int"), "min_samples_leaf": (1, 10, "int"),
               "colsample": (0.3, 1.0, "float")},
}


def sample_params(family: str, n: int, seed: int = SEED, scale: float = 1.0) -> list[dict]:
    rng = random.Random(seed)
    space = SEARCH_SPACE["forest" if family == "forest" else "gbt"]
    out = []
    for _ in range(n):
        p = {}
        for k, (lo, hi, kind) in space.items():
            if kind == "int":
                p[k] = rng.randint(lo, hi)
            elif kind == "log":
                p[k] = math.exp(rng.uniform(math.log(lo), math.log(hi)))
            else:
                p[k] = rng.uniform(lo, hi)
        if "n_estimators" in p:
            p["n_estimators"] = max(1, int(round(p["n_estimators"] * scale)))
        out.append(p)
    return out


def tune(family: str, data: ModelData, k: int, n_trials: int = 100, scale: float = 1.0, parallelism: int = 2) -> DataFrame:
    """Best of ``n_trials`` sampled parameter sets by k-fold CV on the fold
    column (CrossValidator with foldCol, candidates fitted in parallel)."""
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
    from pyspark.ml.tuning import CrossValidator

    base = make_estimator(family, data.task)
    trials = sample_params(family, n_trials, scale=scale)
    fam = "forest" if family == "forest" or data.task == MULTICLASS else "gbt"
    maps = []
    for t in trials:
        mp = {}
        for name, v in to_mllib(t, fam).items():
            if base.hasParam(name):
                mp[base.getParam(name)] = v
        maps.append(mp)
    if data.task == REGRESSION:
        ev = RegressionEvaluator(metricName="mse")
    else:
        ev = MulticlassClassificationEvaluator(metricName="accuracy")
    cv = CrossValidator(estimator=base, estimatorParamMaps=maps, evaluator=ev, numFolds=k, foldCol="fold", parallelism=parallelism, seed=SEED)
    model = cv.fit(data.train.withColumn("fold", F.col("fold").cast("int")))
    metrics = list(model.avgMetrics)
    best_i = (min if data.task == REGRESSION else max)(range(len(metrics)), key=lambda i: metrics[i])
    score = metrics[best_i] if data.task != REGRESSION else -metrics[best_i]
    spark = data.train.sparkSession
    row = [(family, {k2: float(v) for k2, v in trials[best_i].items()}, round(float(score), 5), n_trials)]
    return spark.createDataFrame(row, "model string, params map<string,double>, best_cv_score double, n_trials int")


def fit_final(family: str, params: dict, data: ModelData, threshold: float | None = None) -> DataFrame:
    """Refit on all train rows, predict test (class code, or value)."""
    model = make_estimator(family, data.task, params).fit(data.train)
    scored = model.transform(data.test)
    if data.task == BINARY and threshold is not None:
        return scored.select("id", (vector_to_array("probability")[1] >= F.lit(threshold)).cast("int").alias("code"))
    if data.task == REGRESSION:
        return scored.select("id", F.col("prediction").alias("value"))
    return scored.select("id", F.col("prediction").cast("int").alias("code"))


def threshold_solve(family: str, params: dict, data: ModelData, k: int, labels: DataFrame | None = None):
    """OOF probabilities -> fine sweep -> refit on all rows -> apply -> decode."""
    from tabforge.operators.decide import GRID_FINE
    from tabforge.operators.infer import decode_predictions

    oof, _ = oof_predict(family, lambda: make_estimator(family, data.task, params), ModelData(data.train, None, data.task, data.n_classes), k)
    scored = oof.join(data.train.select("id", F.col("label").cast("int").alias("y")), "id")
    best = best_threshold(threshold_sweep(scored, "y", "score", GRID_FINE)).first()
    pred = fit_final(family, params, data, best["threshold"])
    if labels is not None:
        pred = decode_predictions(pred, "code", labels, "prediction").select("id", "prediction")
    return pred, best["threshold"], best["accuracy"]
