"""Encoding and imputation, fitted on train only (E1-E9), plus category statistics
(A1, A2) and the fitted-table lookup (J1).

Fitted objects are small DataFrames or dataclasses of scalars; the apply side is a
``select`` with literals or a join with a fitted table, so it runs unchanged on a
streaming DataFrame.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabforge.functions.scalar import NA_TOKEN
from tabforge.operators.quantile import exact_medians
from tabforge.roles import categorical_columns, numeric_columns
from tabforge.session import fitted_table, ranked

SMOOTHING = 30.0  # fixed value: smoothing weight of the target encoding
NULL_KEY = "\u0000"  # join key standing for a null category


def _key(c) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.coalesce(col.cast("string"), F.lit(NULL_KEY))


# ----------------------------------------------------------------------------- A1/A2/J1


def category_target_stats(df: DataFrame, cat: str, y: str, fold_col: str | None = None) -> DataFrame:
    """A1: sum and count of the target per category (and fold)."""
    keys = [F.col(cat).alias("category")] + ([F.col(fold_col)] if fold_col else [])
    return df.where(F.col(y).isNotNull()).groupBy(*keys).agg(
        F.sum(F.col(y).cast("double")).alias("y_sum"), F.count(F.lit(1)).alias("n")
    )


def global_mean(df: DataFrame, y: str) -> float:
    return df.agg(F.avg(F.col(y).cast("double"))).first()[0]


def smoothed_mean(df: DataFrame, cat: str, y: str, smoothing: float = SMOOTHING) -> DataFrame:
    """A2: ``(S + m*g) / (n + m)`` per category, ``g`` the global mean."""
    g = global_mean(df, y)
    st = category_target_stats(df, cat, y)
    return st.select(
        "category", "n", ((F.col("y_sum") + F.lit(smoothing * g)) / (F.col("n") + F.lit(smoothing))).alias("smoothed")
    )


def lookup_join(df: DataFrame, col: str, table: DataFrame, key: str, value: str, out: str, default) -> DataFrame:
    """Map ``col`` through a small fitted table; missing keys get ``default``."""
    t = table.select(_key(key).alias("_lk"), F.col(value).alias("_lv"))
    return (
        df.withColumn("_lk", _key(col))
        .join(fitted_table(t), "_lk", "left")
        .withColumn(out, F.coalesce(F.col("_lv"), F.lit(default)))
        .drop("_lk", "_lv")
    )


# ----------------------------------------------------------------------------- E5/E6


@dataclass
class TargetEncoding:
    stats: DataFrame  # column, value, fold, s, n  (value = null-safe key)
    global_mean: float
    k: int
    smoothing: float
    columns: list[str] = field(default_factory=list)

    def release(self):
        self.stats.unpersist()


def fit_target_encoding(
    train: DataFrame, cat_cols: list[str], y: str, fold_col: str = "fold", k: int = 5, smoothing: float = SMOOTHING
) -> TargetEncoding:
    """One aggregate over (column, value, fold) for all columns at once."""
    labelled = train.where(F.col(y).isNotNull())
    kv = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), _key(c).alias("value")) for c in cat_cols])).alias("kv")
    stats = (
        labelled.select(kv, F.col(fold_col).alias("fold"), F.col(y).cast("double").alias("_y"))
        .groupBy("kv.column", "kv.value", "fold")
        .agg(F.sum("_y").alias("s"), F.count(F.lit(1)).alias("n"))
    )
    # the fitted table is small (values x folds); keep it materialised so the size
    # check and every apply reuse it instead of rescanning train
    stats = stats.persist(StorageLevel.MEMORY_AND_DISK)
    # every row lands once per column, so one column's sums give the global mean
    r = stats.where(F.col("column") == cat_cols[0]).agg(F.sum("s").alias("s"), F.sum("n").alias("n")).first()
    g = (r["s"] / r["n"]) if r["n"] else None
    return TargetEncoding(stats, g, k, smoothing, list(cat_cols))


def _leave_fold_out(te: TargetEncoding) -> DataFrame:
    """Per (column, value, fold): smoothed mean of all *other* folds."""
    tot = te.stats.groupBy("column", "value").agg(F.sum("s").alias("ts"), F.sum("n").alias("tn"))
    m, g = te.smoothing, te.global_mean
    return te.stats.join(tot, ["column", "value"]).select(
        "column",
        "value",
        "fold",
        ((F.col("ts") - F.col("s") + F.lit(m * g)) / (F.col("tn") - F.col("n") + F.lit(m))).alias("enc"),
    )


def apply_target_encoding_oof(df: DataFrame, te: TargetEncoding, fold_col: str = "fold", suffix: str = "") -> DataFrame:
    """E5: train rows get the encoding fitted without their own fold."""
    lfo = fitted_table(_leave_fold_out(te))  # staged once for all columns
    out = df
    for c in te.columns:
        t = lfo.where(F.col("column") == c).select(
            F.col("value").alias("_tv"), F.col("fold").alias("_tf"), F.col("enc").alias("_te")
        )
        out = (
            out.join(t, (_key(c) == F.col("_tv")) & (F.col(fold_col) == F.col("_tf")), "left")
            .withColumn(c + suffix, F.coalesce(F.col("_te"), F.lit(te.global_mean)))
            .drop("_tv", "_tf", "_te")
        )
    return out


def target_encoding_test_table(te: TargetEncoding) -> DataFrame:
    """E6 table: per (column, value) the mean over the k fold encodings; a fold in
    which the value is absent from the training part contributes the global mean."""
    m, g = te.smoothing, te.global_mean
    tot = te.stats.groupBy("column", "value").agg(F.sum("s").alias("ts"), F.sum("n").alias("tn"))
    all_folds = tot.select("column", "value", "ts", "tn", F.explode(F.sequence(F.lit(0), F.lit(te.k - 1))).alias("fold"))
    per = all_folds.join(te.stats, ["column", "value", "fold"], "left").select(
        "column",
        "value",
        (
            (F.col("ts") - F.coalesce("s", F.lit(0.0)) + F.lit(m * g))
            / (F.col("tn") - F.coalesce("n", F.lit(0)) + F.lit(m))
        ).alias("enc"),
    )
    return per.groupBy("column", "value").agg(F.avg("enc").alias("enc"))


def apply_target_encoding_test(df: DataFrame, te: TargetEncoding, suffix: str = "") -> DataFrame:
    """Test rows get the mean fold encoding; unseen values the global mean."""
    tbl = fitted_table(target_encoding_test_table(te))
    out = df
    for c in te.columns:
        t = tbl.where(F.col("column") == c).select(F.col("value").alias("_tv"), F.col("enc").alias("_te"))
        out = (
            out.join(t, _key(c) == F.col("_tv"), "left")
            .withColumn(c + suffix, F.coalesce(F.col("_te"), F.lit(te.global_mean)))
            .drop("_tv", "_te")
        )
    return out


# ----------------------------------------------------------------------------- E1-E4, E7


def fit_medians(train: DataFrame, cols: list[str], approximate: bool = False, accuracy: int = 10_000) -> dict[str, float | None]:
    """E1 fit: exact medians (a few column scans, see quantile.py), or with
    ``approximate=True`` one scan of mergeable quantile sketches
    (``percentile_approx``; rank error at most n / accuracy)."""
    if approximate:
        if not cols:
            return {}
        r = train.agg(*[F.percentile_approx(F.col(c).cast("double"), 0.5, accuracy).alias(c) for c in cols]).first()
        return {c: r[c] for c in cols}
    return exact_medians(train, cols)


def apply_impute_median(df: DataFrame, medians: dict[str, float | None]) -> DataFrame:
    """E1 apply: null/NaN -> fitted median; a column with no fitted median
    (all null in train) is dropped, as the reference's imputer does."""
    out = df
    for c, m in medians.items():
        if m is None:
            out = out.drop(c)
        else:
            x = F.col(c).cast("double")
            out = out.withColumn(c, F.when(x.isNull() | F.isnan(x), F.lit(float(m))).otherwise(x))
    return out


def impute_constant(df: DataFrame, cols: list[str], fill: str = NA_TOKEN) -> DataFrame:
    """Categorical null -> ``__NA__`` (after casting to text)."""
    return df.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit(fill)) for c in cols})


def fit_ordinal(train: DataFrame, cols: list[str], partitions: int | None = None) -> DataFrame:
    """E3 fit: (column, value, code) with codes 0.. in sorted text order, ranked over
    range partitions of the distinct values (see ``session.ranked``)."""
    kv = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols]))
    distinct = train.select(kv.alias("kv")).select("kv.column", "kv.value").where(F.col("value").isNotNull()).distinct()
    return ranked(distinct, ["column"], "value", "code", partitions)


def apply_ordinal(df: DataFrame, codes: DataFrame, cols: list[str], suffix: str = "") -> DataFrame:
    """E3 apply: unseen (or null) -> -1."""
    if not cols:
        return df
    tbl, out = fitted_table(codes), df  # staged once for all columns
    for c in cols:
        t = tbl.where(F.col("column") == c).select(F.col("value").alias("_ov"), F.col("code").alias("_oc"))
        out = (
            out.join(t, F.col(c).cast("string") == F.col("_ov"), "left")
            .withColumn(c + suffix, F.coalesce(F.col("_oc"), F.lit(-1)))
            .drop("_ov", "_oc")
        )
    return out


def fit_standard_scale(train: DataFrame, cols: list[str]) -> dict[str, tuple[float, float]]:
    """E4 fit: mean and population std per column in one aggregate; std 0 -> 1."""
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}")]
    r = train.agg(*aggs).first()
    out = {}
    for c in cols:
        s = r[f"s_{c}"]
        out[c] = (r[f"m_{c}"], 1.0 if (s is None or s == 0) else s)
    return out


def apply_standard_scale(df: DataFrame, fitted: dict[str, tuple[float, float]], suffix: str = "") -> DataFrame:
    return df.withColumns({c + suffix: (F.col(c) - F.lit(m)) / F.lit(s) for c, (m, s) in fitted.items()})


def cast_categoricals(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """All categorical (non-numeric) columns to text."""
    cols = categorical_columns(df) if cols is None else cols
    return df.withColumns({c: F.col(c).cast("string") for c in cols})


# ----------------------------------------------------------------------------- E8/E9


@dataclass
class Prepared:
    num_cols: list[str]
    cat_cols: list[str]
    medians: dict[str, float | None]
    codes: DataFrame

    @property
    def feature_cols(self) -> list[str]:
        return [c for c in self.num_cols if self.medians.get(c) is not None] + [c + "_code" for c in self.cat_cols]


def fit_prepare(train: DataFrame, feature_cols: list[str], encoded_cols: list[str] = ()) -> Prepared:
    """E9 fit: medians for numeric (incl. already target-encoded) columns, sorted
    codes for the categorical ones (nulls as ``__NA__``)."""
    num = numeric_columns(train, feature_cols)
    num += [c for c in encoded_cols if c not in num and c in feature_cols]
    cat = [c for c in feature_cols if c not in num]
    med = fit_medians(train, num)
    base = impute_constant(train, cat)
    codes = fit_ordinal(base, cat) if cat else train.sparkSession.createDataFrame([], "column string, value string, code int")
    return Prepared(num, cat, med, codes)


def apply_prepare(df: DataFrame, prep: Prepared, keep: list[str] = ()) -> DataFrame:
    """E9 apply: impute, encode, return ``keep`` columns plus numeric features."""
    out = apply_impute_median(df, prep.medians)
    out = impute_constant(out, prep.cat_cols)
    out = apply_ordinal(out, prep.codes, prep.cat_cols, suffix="_code")
    return out.select(*keep, *[F.col(c).cast("double").alias(c) for c in prep.feature_cols])


def assemble(df: DataFrame, cols: list[str], out: str = "features") -> DataFrame:
    """Feature vector; invalid (null) values raise, as after E1-E3 none remain."""
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=list(cols), outputCol=out, handleInvalid="error").transform(df)
