"""Validation and grading of a prediction table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: medal cutoffs of the published leaderboard
CUTOFFS = (("gold", 0.82066), ("silver", 0.81388), ("bronze", 0.80967))


def match_ids(pred: DataFrame, expected: DataFrame, id_col: str) -> DataFrame:
    """Ids missing from the prediction table and ids not expected (anti joins)."""
    p = pred.select(F.col(id_col).alias("id")).distinct()
    e = expected.select(F.col(id_col).alias("id")).distinct()
    missing = e.join(p, "id", "left_anti").withColumn("status", F.lit("missing"))
    extra = p.join(e, "id", "left_anti").withColumn("status", F.lit("extra"))
    return missing.unionByName(extra)


def validate_predictions(pred: DataFrame, expected: DataFrame, id_col: str, target_col: str) -> DataFrame:
    """V1: one report row: columns, row counts, id set, nulls and duplicates."""
    cols_ok = int(list(pred.columns) == [id_col, target_col])
    mm = match_ids(pred, expected, id_col).groupBy().agg(
        F.count_if(F.col("status") == "missing").alias("n_missing"), F.count_if(F.col("status") == "extra").alias("n_extra")
    )
    stats = pred.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col(target_col).isNull()).alias("n_null"),
        (F.count(F.lit(1)) - F.count_distinct(id_col)).alias("n_duplicate"),
    )
    exp_n = expected.agg(F.count(F.lit(1)).alias("n_expected"))
    r = {**stats.first().asDict(), **mm.first().asDict(), **exp_n.first().asDict()}
    valid = int(
        cols_ok == 1 and r["n_rows"] == r["n_expected"] and r["n_missing"] == 0 and r["n_extra"] == 0 and r["n_null"] == 0 and r["n_duplicate"] == 0
    )
    row = [(cols_ok, r["n_rows"], r["n_expected"], r["n_missing"], r["n_extra"], r["n_null"], r["n_duplicate"], valid)]
    return pred.sparkSession.createDataFrame(
        row,
        "columns_ok int, n_rows long, n_expected long, n_missing long, n_extra long, n_null long, n_duplicate long, valid int",
    )


def medal(score, cutoffs=CUTOFFS) -> F.Column:
    c = F.col(score) if isinstance(score, str) else score
    expr = F.lit("none")
    for name, cut in reversed(cutoffs):
        expr = F.when(c >= F.lit(cut), F.lit(name)).otherwise(expr)
    return expr


def grade(pred: DataFrame, answers: DataFrame, id_col: str, pred_col: str, answer_col: str, cutoffs=CUTOFFS) -> DataFrame:
    """V2: accuracy against held-back labels, medal band. Every answer counts: one without a
    prediction, or whose id is predicted more than once with different values, is wrong. Values
    are equal as text or as numbers (``1`` and ``1.0``)."""
    p = pred.groupBy(F.col(id_col).alias("_id")).agg(
        F.min(F.col(pred_col).cast("string")).alias("_p"), F.max(F.col(pred_col).cast("string")).alias("_p2")
    )
    y = answers.select(F.col(id_col).alias("_id"), F.col(answer_col).cast("string").alias("_y"))
    j = y.join(p, "_id", "left")
    same = (F.col("_p") == F.col("_y")) | (F.col("_p").try_cast("double") == F.col("_y").try_cast("double"))
    right = F.coalesce((F.col("_p") == F.col("_p2")) & same, F.lit(False))
    s = j.agg(F.avg(right.cast("double")).alias("score"), F.count(F.lit(1)).alias("n_graded"))
    band = medal("score", cutoffs)
    return s.select("score", "n_graded", band.alias("medal"), (band != "none").cast("int").alias("any_medal"))
