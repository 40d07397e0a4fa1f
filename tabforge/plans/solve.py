"""From two tables to predictions: one fitted plan for any task (M12 end to end, D7).

``fit_plan`` detects the task, encodes the target, engineers features, target-encodes text columns
of many values, imputes and codes the rest, fits the base learners out of fold, the meta learner on
their scores, and for a binary task the threshold. ``Plan.apply`` takes any further table through
the same fitted steps. ``solve`` does both and writes the predictions. ``fit_threshold_plan`` is the
one-learner variant: fine threshold sweep on out-of-fold scores, then the model of all rows.

Rows whose target is null (regression: no number) are not used for fitting. A base learner that
fails is left out and named in ``failed``; if all fail, fitting fails.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabforge.operators import encode as E
from tabforge.operators import features as FE
from tabforge.operators.decide import GRID, GRID_FINE, argmax_class, best_threshold, threshold_sweep
from tabforge.operators.folds import assign_folds, assign_stratified_folds
from tabforge.operators.infer import BINARY, HIGH_CARD, MULTICLASS, REGRESSION, decode_predictions, detect_task, encode_target, high_cardinality_columns, label_table
from tabforge.plans import learners as L
from tabforge.plans import models as M
from tabforge.plans.boost import HistBoost, fit_boosters
from tabforge.roles import align_columns, resolve_roles, string_columns
from tabforge.session import cut_lineage, fitted_table
from tabforge.sources.io import write_predictions

#: Names of the plan's own columns, unlikely in a caller's table.
ID, LABEL, FOLD = "__id", "__label", "__fold"


@dataclass(frozen=True)
class Engineer:
    """Feature engineering as a fit/apply pair (default: the generic features, F21)."""

    fit: Callable[[DataFrame], object] = FE.fit_generic
    apply: Callable[[DataFrame, object], DataFrame] = FE.apply_generic

    @staticmethod
    def domain(spec: FE.DomainSpec) -> Engineer:
        """The domain features (F22) of a table that ``spec`` names the columns of."""
        return Engineer(lambda df: FE.fit_domain(df, spec), lambda df, fit: FE.apply_domain(df, spec, fit))


@dataclass
class Features:
    """Fitted steps from a raw table to (id, features): engineering, target encoding, preparation."""

    id_col: str
    columns: list[str]
    engineer: Engineer
    engineered: object
    encoding: E.TargetEncoding | None
    prepared: E.Prepared

    def rows(self, df: DataFrame) -> DataFrame:
        """id, features of a table without target and folds."""
        out = self.engineer.apply(df.select(F.col(self.id_col).alias(ID), *self.columns), self.engineered)
        if self.encoding:
            out = E.apply_target_encoding_test(out, self.encoding)
        return self.arrays(out, [])

    def arrays(self, df: DataFrame, keep: list[str]) -> DataFrame:
        out = E.apply_prepare(df, self.prepared, keep=[ID, *keep])
        return out.select(F.col(ID).alias("id"), *keep, F.array(*self.prepared.feature_cols).alias("features"))


@dataclass
class Task:
    """A task's kind, its training rows (id, fold, label, features) and the fitted features."""

    kind: str
    labels: DataFrame | None
    n_classes: int
    rows: DataFrame
    features: Features
    target_col: str
    k: int


def fit_task(train: DataFrame, id_col: str, target_col: str, columns: list[str], k: int, engineer: Engineer, encode_above: int = HIGH_CARD, kind: str | None = None) -> Task:
    """Everything before the learners. ``kind`` skips the detection; text columns of more than
    ``encode_above`` values are target-encoded (classification)."""
    kind = kind or detect_task(train, target_col).first()["task"]
    labels, n_classes = None, 0
    coded = encode_target(train.select(F.col(id_col).alias(ID), *columns, F.col(target_col).alias("__y")), "__y", LABEL, kind)
    if kind != REGRESSION:
        labels = fitted_table(label_table(train, target_col))
        n_classes = labels.count()
    coded = coded.drop("__y").where(F.col(LABEL).isNotNull()).withColumn(LABEL, F.col(LABEL).cast("double"))
    coded = assign_folds(coded, k, ID, FOLD) if kind == REGRESSION else assign_stratified_folds(coded, k, ID, LABEL, FOLD)
    own = [ID, LABEL, FOLD]
    coded = cut_lineage(coded)  # read by every fit below
    engineered = engineer.fit(coded.drop(*own))
    made = engineer.apply(coded, engineered)
    encoding = None
    if kind != REGRESSION:
        text = [c for c in string_columns(made) if c not in own]
        many = [r["column"] for r in high_cardinality_columns(made, text, encode_above).collect() if r["high_card"]] if text else []
        if many:
            encoding = E.fit_target_encoding(made, sorted(many), LABEL, FOLD, k)
            made = E.apply_target_encoding_oof(made, encoding, FOLD)
    prepared = E.fit_prepare(made, [c for c in made.columns if c not in own], sorted(many) if encoding else [])
    features = Features(id_col, columns, engineer, engineered, encoding, prepared)
    rows = features.arrays(made, [FOLD, LABEL]).withColumnsRenamed({FOLD: "fold", LABEL: "label"})
    return Task(kind, labels, n_classes, cut_lineage(rows), features, target_col, k)


def default_learners(kind: str) -> list[tuple[str, object]]:
    """The four base learners (M9) at the reference's rounds."""
    return [(name, HistBoost(**params)) for name, params in M.BASE_BOOST.items()]


def fit_learners(
    learners: list[tuple[str, object]], rows: DataFrame, kind: str, n_classes: int, k: int, refit: bool = True
) -> tuple[list[tuple[str, L.FoldModels]], dict[str, str]]:
    """(name, fold models) of the learners that fit, and the errors of the others. Boosters cut
    alike go in lock-step, so that several cost as many jobs as the longest. Without ``refit``
    boosters and MLlib learners fit no model of all rows."""
    done, failed = {}, {}
    groups: dict[object, list[tuple[str, object]]] = {}
    for i, (name, learner) in enumerate(learners):
        groups.setdefault((learner.bins, learner.cut) if isinstance(learner, HistBoost) else i, []).append((name, learner))
    for group in groups.values():
        try:
            if isinstance(group[0][1], HistBoost):
                done |= dict(zip([n for n, _ in group], fit_boosters([x for _, x in group], rows, kind, n_classes, k, refit), strict=True))
            elif isinstance(group[0][1], L.MllibLearner):
                done[group[0][0]] = group[0][1].fit_folds(rows, kind, n_classes, k, refit)
            else:
                done[group[0][0]] = group[0][1].fit_folds(rows, kind, n_classes, k)
        except Exception as e:  # noqa: BLE001 - a failing learner is left out and reported
            failed |= {name: f"{type(e).__name__}: {e}" for name, _ in group}
    return [(name, done[name]) for name, _ in learners if name in done], failed


def default_meta(kind: str, n: int) -> object:
    """Ridge, Newton logistic, or for several classes MLlib's softmax on standardised scores, each
    with unit penalty on the weights."""
    if kind == REGRESSION:
        return L.Ridge(1.0)
    if kind == BINARY:
        return L.NewtonLogistic(1.0)
    scale = StandardScaler(inputCol="features", outputCol="z", withMean=True, withStd=True)
    return L.MllibLearner(lambda: Pipeline(stages=[scale, LogisticRegression(featuresCol="z", regParam=1.0 / max(n, 1), standardization=False, maxIter=1000, tol=1e-6)]))


def _decoded(df: DataFrame, kind: str, score: str, threshold: float | None, labels: DataFrame | None) -> DataFrame:
    """``df`` with prediction: the value, or the label of the class in its original spelling."""
    if kind == REGRESSION:
        return df.withColumn("prediction", F.col(score))
    code: Column = argmax_class(score) if kind == MULTICLASS else (F.col(score) >= F.lit(threshold)).cast("int")
    return decode_predictions(df.withColumn("__code", code), "__code", labels, "prediction").drop("__code")


@dataclass
class Plan:
    """A fitted solution. ``oof``: id, fold, label, score of the meta learner, out of fold."""

    task: Task
    bases: list[tuple[str, L.FoldModels]]
    failed: dict[str, str]
    meta: L.FoldModels
    threshold: float | None
    oof: DataFrame
    names: list[str] = field(default_factory=list)

    def scores(self, df: DataFrame) -> DataFrame:
        """id, score of a table: mean of the k meta models on the mean base scores."""
        return self.meta.mean(_stacked(self.task.features.rows(df), self.bases, self.task.kind, "mean")).select("id", "score")

    def apply(self, df: DataFrame) -> DataFrame:
        """id, score, prediction of a table."""
        t = self.task
        return _decoded(self.scores(df), t.kind, "score", self.threshold, t.labels).select("id", "score", "prediction")

    def quality(self) -> DataFrame:
        """One row: out-of-fold accuracy, or root mean squared error for a regression."""
        if self.task.kind == REGRESSION:
            return self.oof.agg(F.sqrt(F.avg(F.pow(F.col("score") - F.col("label"), 2))).alias("rmse"))
        hit = argmax_class("score") if self.task.kind == MULTICLASS else (F.col("score") >= F.lit(self.threshold)).cast("int")
        return self.oof.agg(F.avg((hit == F.col("label")).cast("double")).alias("accuracy"))


def _stacked(rows: DataFrame, bases: list, kind: str, how: str) -> DataFrame:
    """``rows`` with the base learners' scores side by side as features (J6: no join, no pivot)."""
    keep = [c for c in rows.columns if c != "features"]
    rows = L.score_all(rows, [(f"__s{i}", models, how) for i, (_, models) in enumerate(bases)])
    scores = [F.col(f"__s{i}") for i in range(len(bases))]
    stack = F.concat(*scores) if kind == MULTICLASS else F.array(*scores)
    return rows.select(*keep, stack.alias("features"))


def fit_plan(
    train: DataFrame, id_col: str, target_col: str, columns: list[str] | None = None, learners: list[tuple[str, object]] | None = None,
    meta: object | None = None, k: int = 5, engineer: Engineer | None = None, encode_above: int = HIGH_CARD, kind: str | None = None,
) -> Plan:
    """Fit the whole stack on a training table."""
    columns = columns if columns is not None else [c for c in train.columns if c not in (id_col, target_col)]
    task = fit_task(train, id_col, target_col, columns, k, engineer or Engineer(), encode_above, kind)
    bases, failed = fit_learners(learners or default_learners(task.kind), task.rows, task.kind, task.n_classes, k)
    if not bases:
        raise RuntimeError(f"all base learners failed: {failed}")
    stacked = cut_lineage(_stacked(task.rows, bases, task.kind, "held_out"))
    fitted = (meta or default_meta(task.kind, stacked.count())).fit_folds(stacked, task.kind, task.n_classes, k)
    oof = cut_lineage(fitted.held_out(stacked).select("id", "fold", "label", "score"))
    threshold = None
    if task.kind == BINARY:
        threshold = best_threshold(threshold_sweep(oof, "label", "score", GRID)).first()["threshold"]
    return Plan(task, bases, failed, fitted, threshold, oof, [n for n, _ in bases])


@dataclass
class ThresholdPlan:
    """One learner, refitted on all rows, with a threshold from its out-of-fold scores."""

    task: Task
    models: L.FoldModels
    threshold: float
    accuracy: float

    def apply(self, df: DataFrame) -> DataFrame:
        """id, score, prediction of a table."""
        scored = self.models.refit(self.task.features.rows(df)).select("id", "score")
        return _decoded(scored, BINARY, "score", self.threshold, self.task.labels)


def fit_threshold_plan(
    train: DataFrame, id_col: str, target_col: str, learner: object, columns: list[str] | None = None, k: int = 5,
    engineer: Engineer | None = None, encode_above: int = HIGH_CARD, grid: tuple = GRID_FINE,
) -> ThresholdPlan:
    """Out-of-fold scores, sweep over the fine grid, model of all rows."""
    columns = columns if columns is not None else [c for c in train.columns if c not in (id_col, target_col)]
    task = fit_task(train, id_col, target_col, columns, k, engineer or Engineer(), encode_above)
    if task.kind != BINARY:
        raise ValueError(f"a threshold needs a binary target, not {task.kind}")
    models = learner.fit_folds(task.rows, BINARY, task.n_classes, k)
    best = best_threshold(threshold_sweep(models.held_out(task.rows), "label", "score", grid)).first()
    return ThresholdPlan(task, models, best["threshold"], best["accuracy"])


@dataclass
class Solution:
    plan: Plan
    predictions: DataFrame  # the template's id and target columns


def solve(train: DataFrame, test: DataFrame, template: DataFrame | None = None, out_path: str | None = None, fmt: str = "csv", **options) -> Solution:
    """Roles from the template (or the first and last column), columns that both tables have, a
    fitted plan, predictions of ``test`` under the template's names, written if a path is given."""
    roles = resolve_roles(train, template)
    shared = align_columns(train.select(*roles.feature_cols), test)[0].columns
    plan = fit_plan(train, roles.id_col, roles.target_col, shared, **options)
    out = plan.apply(test).select(F.col("id").alias(roles.id_col), F.col("prediction").alias(roles.target_col))
    if out_path:
        write_predictions(out, out_path, roles.id_col, roles.target_col, fmt)
    return Solution(plan, out)
