"""Learners that fit all folds from shared aggregates.

A learner's statistics are sums over rows. One pass adds them up per fold; the model that leaves
fold f out uses the total without f's sums, and the model of all rows the total itself. So k
out-of-fold models and the refit cost one pass (Newton steps: one pass a step for all of them),
not k + 1 fits.

Protocol: ``fit_folds(train, task, n_classes, k)`` takes rows (id, fold, label, features) and gives
``FoldModels``: ``held_out(rows)`` scores each row by the model that left its fold out,
``mean(rows)`` by the mean over the k models, ``refit(rows)`` by the model of all rows. Each adds one
column to the rows as they are, so that scores of several learners meet without a join. A score is
a number (regression: the value, binary: the probability of class 1) or an array of class
probabilities. ``MllibLearner`` gives any MLlib estimator the same protocol. Features are an array
of doubles or an MLlib vector.

Statistics have a size fixed by features, bins, classes and folds; each task sends one array, and
with many tasks a second pass adds them up before the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from tabforge.operators.infer import BINARY, MULTICLASS, REGRESSION

#: Arrays of statistics that reach the driver at once.
AT_ONCE = 64
#: Rows scored at once: learners score many cheaper than few.
SCORED_AT_ONCE = 1 << 15


def _plain(rows: DataFrame) -> DataFrame:
    """``rows`` with features as an array of doubles."""
    if isinstance(rows.schema["features"].dataType, ArrayType):
        return rows
    return rows.withColumn("features", vector_to_array("features"))


def _matrix(col) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    n = len(col)
    return col.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, -1) if n else np.zeros((0, 0))


def fold_sums(train: DataFrame, k: int, shape: tuple, of: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """(k, *shape): per fold the sum of ``of(x, y, fold)`` over the fold's rows. ``of`` gets the rows
    of one fold of one batch."""

    def part(batches):
        total = np.zeros((k, *shape))
        for b in batches:
            fold, y, x = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False), _matrix(b.column(2))
            for f in np.unique(fold):
                total[f] += of(x[fold == f], y[fold == f], int(f))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["m"])

    def add(batches):
        total = np.zeros((k, *shape))
        for b in batches:
            for m in b.column(0):
                total += np.frombuffer(m.as_py()).reshape(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["m"])

    rows = _plain(train).select(F.col("fold").cast("int").alias("fold"), F.col("label").cast("double").alias("label"), "features")
    parts = rows.mapInArrow(part, "m binary")
    if rows.rdd.getNumPartitions() > AT_ONCE:
        parts = parts.repartition(AT_ONCE).mapInArrow(add, "m binary")
    return sum((np.frombuffer(r["m"]).reshape(k, *shape) for r in parts.collect()), np.zeros((k, *shape)))


def without_fold(sums: np.ndarray) -> np.ndarray:
    """(k + 1, ...): sums of all rows but fold f's, and of all rows last."""
    total = sums.sum(0)
    return np.concatenate([total - sums, total[None]])


class FoldModels:
    """k models and the refit, as parameters and one vectorised ``predict(params, x)``."""

    def __init__(self, params: list, predict: Callable[[object, np.ndarray], np.ndarray], n_classes: int):
        self.params, self.predict, self.n_classes = params, predict, n_classes
        self.k = len(params) - 1

    def scorer(self, how: str, columns: list[str]) -> Callable:
        """``how`` (held_out, mean or refit) on a batch of rows with ``columns`` and its features."""
        params, predict, k = self.params, self.predict, self.k
        if how == "mean":
            return lambda b, x: sum(predict(p, x) for p in params[:k]) / k
        if how == "refit":
            return lambda b, x: predict(params[-1], x)
        at = columns.index("fold")

        def held_out(b, x):
            fold = b.column(at).to_numpy(zero_copy_only=False)
            done = None
            for f in np.unique(fold):
                s = predict(params[int(f)], x[fold == f])
                done = np.zeros((len(x), *s.shape[1:])) if done is None else done
                done[fold == f] = s
            return done

        return held_out

    def held_out(self, rows: DataFrame, out: str = "score") -> DataFrame:
        """``rows`` with the score of the model that left the row's fold out."""
        return score_all(rows, [(out, self, "held_out")])

    def mean(self, rows: DataFrame, out: str = "score") -> DataFrame:
        """``rows`` with the mean score of the k models."""
        return score_all(rows, [(out, self, "mean")])

    def refit(self, rows: DataFrame, out: str = "score") -> DataFrame:
        """``rows`` with the score of the model of all rows."""
        return score_all(rows, [(out, self, "refit")])


def _larger(batches, rows: int):
    """Batches that follow each other as one, as soon as it has ``rows`` rows."""
    some, n = [], 0
    for b in batches:
        some, n = [*some, b], n + b.num_rows
        if n >= rows:
            yield from pa.Table.from_batches(some).combine_chunks().to_batches()
            some, n = [], 0
    if some:
        yield from pa.Table.from_batches(some).combine_chunks().to_batches()


def score_all(rows: DataFrame, asked: list[tuple[str, FoldModels | MllibModels, str]]) -> DataFrame:
    """``rows`` with a column for every (name, models, how). All ``FoldModels`` score in one pass: a
    pass each would hold as many Python processes a task."""
    own = [(out, m, how) for out, m, how in asked if isinstance(m, FoldModels)]
    before = rows.columns
    for out, m, how in asked:
        if not isinstance(m, FoldModels):
            rows = getattr(m, how)(rows, out)
    if not own:
        return rows
    rows = _plain(rows)
    names = [*rows.columns, *(out for out, _, _ in own)]
    at = rows.columns.index("features")
    scorers = [(m.scorer(how, rows.columns), m.n_classes > 2) for _, m, how in own]

    def run(batches):
        for b in _larger(batches, SCORED_AT_ONCE):
            x, made = _matrix(b.column(at)), []
            for score, many in scorers:
                s = score(b, x) if b.num_rows else np.zeros(0)
                made.append(pa.array(list(s), pa.list_(pa.float64())) if many else pa.array(np.asarray(s, float)))
            yield pa.RecordBatch.from_arrays([*b.columns, *made], names)

    ddl = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields]
    ddl += [f"`{out}` {'array<double>' if m.n_classes > 2 else 'double'}" for out, m, _ in own]
    return rows.mapInArrow(run, ", ".join(ddl)).select(*before, *(out for out, _, _ in asked))


# ---- scaling and ridge ---------------------------------------------------------------------------


def _centre(train: DataFrame) -> np.ndarray:
    """Mean of every feature over all rows: sums are taken around it, as raw moments cancel."""
    s = fold_sums(train.withColumn("fold", F.lit(0)), 1, (_width(train) + 1,), lambda x, y, f: np.r_[len(x), x.sum(0)])[0]
    return s[1:] / max(s[0], 1.0)


def _width(rows: DataFrame) -> int:
    first = _plain(rows).select(F.size("features").alias("n")).first()
    return first["n"] if first else 0


def _moments(gram: np.ndarray, d: int) -> tuple[float, np.ndarray, np.ndarray]:
    """n, mean and population deviation (0 -> 1) of the features in a Gram matrix of (1, x, ...)."""
    n = max(gram[0, 0], 1.0)
    mean = gram[0, 1 : d + 1] / n
    var = np.diag(gram)[1 : d + 1] / n - mean**2
    sd = np.sqrt(np.maximum(var, 0.0))
    return n, mean, np.where(sd > 1e-12 * np.maximum(1.0, np.abs(mean)), sd, 1.0)


def _gram(x: np.ndarray, y: np.ndarray, centre: np.ndarray) -> np.ndarray:
    z = np.column_stack([np.ones(len(x)), x - centre, y])
    return z.T @ z


class Ridge:
    """Ridge on standardised features (all, or those ``at`` the given places) with a free intercept
    (M11 as a learner; alpha 0: least squares). For a binary task it scores the fitted value, cut
    to 0..1."""

    def __init__(self, alpha: float = 1.0, at: list[int] | None = None):
        self.alpha, self.at = alpha, at

    def fit_folds(self, train: DataFrame, task: str, n_classes: int, k: int) -> FoldModels:
        if task == MULTICLASS:
            raise ValueError("ridge scores one value, not class probabilities")
        at = self.at if self.at is not None else list(range(_width(train)))
        d, centre = len(at), _centre(train)[at]
        grams = without_fold(fold_sums(train, k, (d + 2, d + 2), lambda x, y, f: _gram(x[:, at], y, centre)))
        params = [(*ridge_from_gram(g, d, self.alpha), centre) for g in grams]
        binary = task == BINARY

        def predict(p, x):
            b, w, mean, sd, c = p
            s = b + ((x[:, at] - c - mean) / sd) @ w
            return np.clip(s, 0.0, 1.0) if binary else s

        return FoldModels(params, predict, 0)


def ridge_from_gram(gram: np.ndarray, d: int, alpha: float) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Intercept, weights (of standardised features), mean and deviation, from a Gram matrix of
    (1, x, y)."""
    n, mean, sd = _moments(gram, d)
    ybar = gram[0, -1] / n
    zz = (gram[1 : d + 1, 1 : d + 1] - n * np.outer(mean, mean)) / np.outer(sd, sd)
    zy = (gram[1 : d + 1, -1] - n * mean * ybar) / sd
    w = np.linalg.lstsq(zz + alpha * np.eye(d), zy, rcond=None)[0] if alpha == 0 else np.linalg.solve(zz + alpha * np.eye(d), zy)
    return ybar, w, mean, sd


# ---- counted naive Bayes -------------------------------------------------------------------------


class CountedBayes:
    """Naive Bayes on features cut into ``bins`` parts of equal width between the train minimum and
    maximum (beyond them: the outer parts), from counts of (fold, feature, part, class) with ``add``
    added to each. For a binary task the score is the probability of class 1."""

    def __init__(self, bins: int = 16, add: float = 1.0):
        self.bins, self.add = bins, add

    def fit_folds(self, train: DataFrame, task: str, n_classes: int, k: int) -> FoldModels:
        if task == REGRESSION:
            raise ValueError("counted naive Bayes needs classes")
        d, classes, bins, add = _width(train), max(2, n_classes), self.bins, self.add
        lo, hi = column_range(train, d)
        parts = np.arange(d) * bins

        def count(x, y, f):
            out = np.zeros((classes, d * bins + 1))
            at = bin_numbers(x, lo, hi, bins) + parts
            for c in np.unique(y).astype(int):
                mine = at[y == c]
                out[c, :-1] = np.bincount(mine.ravel(), minlength=d * bins)
                out[c, -1] = len(mine)
            return out

        params = []
        for n in without_fold(fold_sums(train, k, (classes, d * bins + 1), count)):
            rows = n[:, -1]
            prior = np.log((rows + add) / (rows.sum() + add * classes))
            params.append((prior, np.log((n[:, :-1] + add) / (rows + add * bins)[:, None])))

        def predict(p, x):
            prior, table = p
            at = bin_numbers(x, lo, hi, bins) + parts
            s = prior[None, :] + table[:, at].sum(2).T
            s = np.exp(s - s.max(1, keepdims=True)) if len(s) else s
            s = s / s.sum(1, keepdims=True)
            return s[:, 1] if task == BINARY else s

        return FoldModels(params, predict, n_classes if task == MULTICLASS else 0)


def column_range(train: DataFrame, d: int) -> tuple[np.ndarray, np.ndarray]:
    x = F.col("features")
    aggs = [f(x[i]).alias(f"{n}_{i}") for i in range(d) for n, f in (("lo", F.min), ("hi", F.max))]
    r = _plain(train).agg(*aggs).first() if d else {}
    return np.array([r[f"lo_{i}"] for i in range(d)], float), np.array([r[f"hi_{i}"] for i in range(d)], float)


def bin_numbers(x: np.ndarray, lo: np.ndarray, hi: np.ndarray, bins: int) -> np.ndarray:
    """Part 0..bins - 1 of each value; a constant feature has part 0 alone."""
    width = np.where(hi > lo, hi - lo, 1.0)
    return np.clip(np.floor((x - lo) / width * bins), 0, bins - 1).astype(np.int64)


# ---- logistic regression by Newton steps ----------------------------------------------------------


class NewtonLogistic:
    """Binary logistic regression on standardised features: log loss plus ``l2`` / 2 times the
    squared weights (the intercept is free), the meta learner M10. A Newton step takes one pass for
    all models at once: rows of a fold add their gradient and curvature to every model that does not
    leave the fold out. Stops at ``tol`` or after ``steps``."""

    def __init__(self, l2: float = 1.0, steps: int = 25, tol: float = 1e-9):
        self.l2, self.steps, self.tol = l2, steps, tol

    def fit_folds(self, train: DataFrame, task: str, n_classes: int, k: int) -> FoldModels:
        if task != BINARY:
            raise ValueError("Newton steps fit two classes")
        d, centre = _width(train), _centre(train)
        grams = without_fold(fold_sums(train, k, (d + 2, d + 2), lambda x, y, f: _gram(x, y, centre)))
        scale = [_moments(g, d)[1:] for g in grams]
        w = np.zeros((k + 1, d + 1))
        ridge = self.l2 * np.diag(np.r_[0.0, np.ones(d)])

        def design(x, m):
            return np.column_stack([np.ones(len(x)), (x - centre - scale[m][0]) / scale[m][1]])

        for _ in range(self.steps):

            def slopes(x, y, f, w=w):
                out = np.zeros((k + 1, d + 1, d + 2))
                for m in range(k + 1):
                    if m != f:
                        z = design(x, m)
                        p = 1.0 / (1.0 + np.exp(-np.clip(z @ w[m], -500, 500)))
                        out[m, :, 0] = z.T @ (y - p)
                        out[m, :, 1:] = z.T @ (z * (p * (1 - p))[:, None])
                return out

            s = fold_sums(train, k, (k + 1, d + 1, d + 2), slopes).sum(0)
            grad = s[:, :, 0] - w @ ridge
            w = w + np.stack([np.linalg.lstsq(s[m, :, 1:] + ridge, grad[m], rcond=None)[0] for m in range(k + 1)])
            if np.abs(grad).max() <= self.tol * max(1.0, grams[-1][0, 0]):
                break
        return FoldModels([(m, w[m]) for m in range(k + 1)], lambda p, x: 1.0 / (1.0 + np.exp(-np.clip(design(x, p[0]) @ p[1], -500, 500))), 0)


class MeanScore:
    """Mean over the base models' scores (soft voting); nothing is fitted. Features are the scores
    side by side, for several classes ``n_classes`` of them a model."""

    def fit_folds(self, train: DataFrame, task: str, n_classes: int, k: int) -> FoldModels:
        many = task == MULTICLASS

        def predict(p, x):
            return x.reshape(len(x), -1, n_classes).mean(1) if many else x.mean(1)

        return FoldModels([None] * (k + 1), predict, n_classes if many else 0)


# ---- MLlib ---------------------------------------------------------------------------------------


class MllibLearner:
    """Any MLlib estimator under the protocol; the k + 1 fits run as concurrent jobs."""

    def __init__(self, factory: Callable[[], object]):
        self.factory = factory

    def fit_folds(self, train: DataFrame, task: str, n_classes: int, k: int, refit: bool = True) -> MllibModels:
        train = _vector(train)
        parts = [train.where(F.col("fold") != f) for f in range(k)] + ([train] if refit else [])
        with ThreadPoolExecutor(max_workers=max(1, min(k + 1, 8))) as ex:
            return MllibModels(list(ex.map(lambda part: self.factory().fit(part), parts)) + ([] if refit else [None]), task)


def _vector(rows: DataFrame) -> DataFrame:
    return rows.withColumn("features", array_to_vector("features")) if isinstance(rows.schema["features"].dataType, ArrayType) else rows


class MllibModels:
    def __init__(self, models: list, task: str):
        self.models, self.task = models, task
        self.k = len(models) - 1

    def _by(self, model, rows: DataFrame, out: str) -> DataFrame:
        score = F.col("prediction")
        if self.task != REGRESSION:
            score = vector_to_array("probability")[1] if self.task == BINARY else vector_to_array("probability")
        return model.transform(_vector(rows)).select(*rows.columns, score.alias(out))

    def held_out(self, rows: DataFrame, out: str = "score") -> DataFrame:
        parts = [self._by(self.models[f], rows.where(F.col("fold") == f), out) for f in range(self.k)]
        return reduce(DataFrame.unionByName, parts)

    def mean(self, rows: DataFrame, out: str = "score") -> DataFrame:
        done = rows
        for f, m in enumerate(self.models[: self.k]):
            done = self._by(m, done, f"_{out}_{f}")
        scores = [F.col(f"_{out}_{f}") for f in range(self.k)]
        if self.task == MULTICLASS:
            total = reduce(lambda a, b: F.zip_with(a, b, lambda x, y: x + y), scores)
            return done.select(*rows.columns, F.transform(total, lambda x: x / self.k).alias(out))
        return done.select(*rows.columns, (reduce(lambda a, b: a + b, scores) / self.k).alias(out))

    def refit(self, rows: DataFrame, out: str = "score") -> DataFrame:
        return self._by(self.models[-1], rows, out)
