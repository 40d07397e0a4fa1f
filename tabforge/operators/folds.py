"""Deterministic folds (M1, M2), CV summaries (A6) and fold scatter.

Row order does not exist in Spark, so folds come from a hash of the id column.
M1: ``fold = md5-prefix(id) mod k``.
M2 (stratified, exact balance): within each class, rows are ranked by
``(md5(id), id)`` and dealt round-robin: ``fold = (rank - 1) mod k``. The global
rank inside a class is computed without a class-wide window (one task per class
would hold a third of the data for a hot class): rows are split into
``16^digits`` hash buckets per class, bucket sizes are counted (small table), a
running offset per class is taken over that small table, and the final
``row_number`` runs within (class, bucket) - many small windows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabforge.functions.scalar import hash_bucket
from tabforge.session import fitted_table, ranked

#: Rows of one (class, bucket) that one task ranks.
SPLIT_ROWS = 2_000_000


def assign_folds(df: DataFrame, k: int, id_col: str, fold_col: str = "fold") -> DataFrame:
    """M1: k near-equal disjoint folds from md5(id)."""
    return df.withColumn(fold_col, F.pmod(hash_bucket(id_col), F.lit(k)).cast("int"))


def assign_stratified_folds(
    df: DataFrame, k: int, id_col: str, y_col: str, fold_col: str = "fold", digits: int = 4, split_rows: int = SPLIT_ROWS
) -> DataFrame:
    """M2: per-class balanced folds; class counts per fold differ by at most one. If some (class,
    bucket) has more than ``split_rows`` rows (an id repeated very often), the rows are ranked over
    range slices instead, which also split the copies of one id; ranks are the same."""
    h = F.md5(F.col(id_col).cast("string"))
    # null-safe class key so a null target is a class of its own and joins back
    keyed = (
        df.withColumn("_y", F.coalesce(F.col(y_col).cast("string"), F.lit("\u0000")))
        .withColumn("_h", h)
        .withColumn("_b", F.substring("_h", 1, digits))
    )
    sizes = fitted_table(keyed.groupBy("_y", "_b").agg(F.count(F.lit(1)).alias("_n")))
    if (sizes.agg(F.max("_n")).first()[0] or 0) > split_rows:
        tie = F.struct("_h", id_col, F.monotonically_increasing_id().alias("t")).alias("_v")
        placed = ranked(keyed.select("*", tie), ["_y"], "_v", "_rank")
        return placed.withColumn(fold_col, F.pmod("_rank", F.lit(k)).cast("int")).drop("_y", "_h", "_b", "_v", "_rank")
    w_off = Window.partitionBy("_y").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_y", "_b", F.coalesce(F.sum("_n").over(w_off), F.lit(0)).alias("_off"))
    joined = keyed.join(offsets, ["_y", "_b"], "inner")
    w_rn = Window.partitionBy("_y", "_b").orderBy("_h", id_col)
    return joined.withColumn(fold_col, F.pmod(F.col("_off") + F.row_number().over(w_rn) - 1, F.lit(k)).cast("int")).drop(
        "_y", "_h", "_b", "_off"
    )


def cv_summary(scores: DataFrame, model_col: str = "model", fold_col: str = "fold", score_col: str = "score") -> DataFrame:
    """Per model mean, population std and 5-place fold scores, one row per fold."""
    g = scores.groupBy(model_col).agg(
        F.round(F.avg(score_col), 5).alias("cv_mean"), F.round(F.stddev_pop(score_col), 5).alias("cv_std")
    )
    return scores.select(model_col, fold_col, F.round(score_col, 5).alias("cv_score")).join(g, model_col)


def fold_scatter(
    df: DataFrame, stats_by_fold: DataFrame, keys: list[str], fold_col: str = "fold"
) -> DataFrame:
    """Attach per-fold results (fitted without that fold) to the held-out rows."""
    return df.join(fitted_table(stats_by_fold), keys + [fold_col], "left")
