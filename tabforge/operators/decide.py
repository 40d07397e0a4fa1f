"""Decision rules (D1-D6) and score metrics (A4, A5).

The threshold sweep is one histogram aggregate: every row gets the number of grid
values <= its score (closed form plus an exact one-step correction against the
grid values themselves, all codegen-able arithmetic), counts of positives and
negatives per bucket are aggregated (at most len(grid)+1 rows), and accuracies
for every threshold follow from running sums over that tiny table. Rows are never
multiplied by the grid.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed grids: 0.30..0.70 step 0.01 (41 values) and 0.30..0.695 step 0.005 (80 values)
GRID = (0.30, 0.01, 41)
GRID_FINE = (0.30, 0.005, 80)


def grid_values(grid=GRID) -> list[float]:
    lo, step, n = grid
    return [lo + step * i for i in range(n)]


def _t(i: Column, lo: float, step: float) -> Column:
    return F.lit(lo) + F.lit(step) * i.cast("double")


def grid_bucket(p, grid=GRID) -> Column:
    """Number of grid values t_i = lo + step*i that are <= p (0..n)."""
    lo, step, n = grid
    x = F.col(p) if isinstance(p, str) else p
    k0 = F.least(F.greatest(F.floor((x - F.lit(lo)) / F.lit(step)), F.lit(-1)), F.lit(n - 1)).cast("int")
    # one-step corrections make the count exact against the computed grid values
    k1 = F.when((k0 < n - 1) & (_t(k0 + 1, lo, step) <= x), k0 + 1).otherwise(k0)
    k2 = F.when((k1 >= 0) & (_t(k1, lo, step) > x), k1 - 1).otherwise(k1)
    return F.when(x.isNull(), F.lit(0)).otherwise(k2 + 1)


def threshold_sweep(scores: DataFrame, y: str, p: str, grid=GRID) -> DataFrame:
    """(threshold, accuracy) for every grid value; prediction = p >= t."""
    lo, step, n = grid
    spark = scores.sparkSession
    hist = (
        scores.select(grid_bucket(p, grid).alias("b"), F.col(y).cast("int").alias("y"))
        .groupBy("b")
        .agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    )
    buckets = spark.range(n + 1).select(F.col("id").cast("int").alias("b"))
    full = buckets.join(hist, "b", "left").fillna(0, ["pos", "neg"])
    w_all = Window.partitionBy()  # tiny: n + 1 rows
    w_cum = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    tab = (
        full.withColumn("P", F.sum("pos").over(w_all))
        .withColumn("N", F.sum(F.col("pos") + F.col("neg")).over(w_all))
        .withColumn("cpos", F.sum("pos").over(w_cum))
        .withColumn("cneg", F.sum("neg").over(w_cum))
    )
    # threshold j predicts positive exactly for buckets > j
    return tab.where(F.col("b") < n).select(
        _t(F.col("b"), lo, step).alias("threshold"),
        ((F.col("P") - F.col("cpos") + F.col("cneg")) / F.col("N")).alias("accuracy"),
    )


def best_threshold(sweep: DataFrame, default: float = 0.5) -> DataFrame:
    """D3: first threshold with the strictly highest accuracy; ``default`` when no
    threshold beats 0."""
    top = sweep.orderBy(F.col("accuracy").desc(), F.col("threshold")).limit(1)
    return top.select(
        F.when(F.col("accuracy") > 0, F.col("threshold")).otherwise(F.lit(default)).alias("threshold"),
        F.col("accuracy"),
    )


def threshold_gain(scores: DataFrame, y: str, p: str, grid=GRID_FINE) -> DataFrame:
    """Best accuracy on the grid against the accuracy at 0.5."""
    best = best_threshold(threshold_sweep(scores, y, p, grid))
    base = scores.agg(F.avg(((F.col(p) >= 0.5).cast("int") == F.col(y)).cast("double")).alias("acc_at_half"))
    b = best.first()
    return base.select(
        F.lit(b["threshold"]).alias("threshold"),
        F.lit(b["accuracy"]).alias("best_accuracy"),
        "acc_at_half",
        (F.lit(b["accuracy"]) - F.col("acc_at_half")).alias("gain"),
    )


def apply_threshold(p, t: float) -> Column:
    """D5."""
    x = F.col(p) if isinstance(p, str) else p
    return (x >= F.lit(float(t))).cast("int")


def argmax_class(proba) -> Column:
    """Index of the highest probability, first on ties."""
    a = F.col(proba) if isinstance(proba, str) else proba
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def accuracy(df: DataFrame, pred: str, y: str, by: list[str] | None = None) -> DataFrame:
    """A4: share of rows with pred == y."""
    acc = F.avg((F.col(pred) == F.col(y)).cast("double")).alias("accuracy")
    return df.groupBy(*(by or [])).agg(acc)


def rmse(df: DataFrame, pred: str, y: str) -> DataFrame:
    """A5: root mean squared error and negative MSE."""
    mse = F.avg(F.pow(F.col(pred) - F.col(y), 2))
    return df.agg(F.sqrt(mse).alias("rmse"), (-mse).alias("neg_mse"))
