"""Profiling aggregates.

Numeric statistics for all columns come from one aggregate (partial aggregation on
the map side, a single tiny final stage). Categorical statistics for all columns come
from one ``unpivot`` to ``(column, value)`` and one ``groupBy(column, value).count()``;
distinct counts, nulls and top-k are derived from that counted table, never with
one ``count(distinct)`` per column (which makes Catalyst expand every row per column).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabforge.operators.infer import encode_target
from tabforge.session import fitted_table


def unpivot_text(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, value) with every listed column as text; nulls kept."""
    return df.select(*[F.col(c).cast("string").alias(c) for c in cols]).unpivot([], cols, "column", "value")


def value_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, value, n) for all listed columns in one shuffle; value null = nulls."""
    return unpivot_text(df, cols).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def top_k_per_column(counts: DataFrame, k: int) -> DataFrame:
    """K most frequent non-null values per column, ties by value.
    ``row_number() <= k`` lets Spark apply a per-partition group limit before the
    window's shuffle (WindowGroupLimit)."""
    w = Window.partitionBy("column").orderBy(F.col("n").desc(), F.col("value"))
    return (
        counts.where(F.col("value").isNotNull())
        .withColumn("rank", F.row_number().over(w))
        .where(F.col("rank") <= k)
        .withColumn("rank", F.col("rank").cast("long"))
    )


# ----------------------------------------------------------------------------- P1-P4


def profile_shape(df: DataFrame) -> DataFrame:
    """Rows x columns."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_cols", F.lit(len(df.columns)).cast("long"))


def profile_target(df: DataFrame, y: str) -> DataFrame:
    """Count and share per target value (nulls excluded), exact counts."""
    c = df.where(F.col(y).isNotNull()).groupBy(F.col(y).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(y)).scalar()  # one value; a window would gather all values in one task
    return c.withColumn("share", F.col("n") / total)


def profile_imbalance(df: DataFrame, y: str, limit: float = 0.65) -> DataFrame:
    """Majority share and flag when above ``limit``."""
    t = profile_target(df, y)
    return t.agg(F.max("share").alias("majority_share")).withColumn(
        "imbalanced", (F.col("majority_share") > limit).cast("int")
    )


def profile_nulls(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Null percentage per column, only those above 0 (one aggregate)."""
    cols = cols or df.columns
    r = df.agg(*[(F.avg(F.col(c).isNull().cast("double")) * 100).alias(c) for c in cols])
    return r.unpivot([], cols, "column", "null_pct").where(F.col("null_pct") > 0)


# ----------------------------------------------------------------------------- P5/P6


def profile_numeric(df: DataFrame, cols: list[str]) -> DataFrame:
    """P5+P6: mean, sample std, min, max, null count and bias-adjusted skew
    (pandas ``.skew()``; constant column -> 0) per numeric column, one aggregate."""
    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        aggs += [
            F.avg(x).alias(f"{c}|mean"),
            F.stddev_samp(x).alias(f"{c}|std"),
            F.min(x).alias(f"{c}|min"),
            F.max(x).alias(f"{c}|max"),
            F.count_if(x.isNull()).alias(f"{c}|n_null"),
            F.count(x).alias(f"{c}|n"),
            F.skewness(x).alias(f"{c}|g1"),
            F.stddev_pop(x).alias(f"{c}|sp"),
        ]
    wide = df.agg(*aggs)
    rows = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(c).alias("column"),
                    F.col(f"`{c}|mean`").alias("mean"),
                    F.col(f"`{c}|std`").alias("std"),
                    F.col(f"`{c}|min`").alias("min"),
                    F.col(f"`{c}|max`").alias("max"),
                    F.col(f"`{c}|n_null`").alias("n_null"),
                    F.col(f"`{c}|n`").alias("n"),
                    F.col(f"`{c}|g1`").alias("g1"),
                    F.col(f"`{c}|sp`").alias("sp"),
                )
                for c in cols
            ]
        )
    ).alias("r")
    n = F.col("r.n").cast("double")
    skew = (
        F.when(n < 3, F.lit(None).cast("double"))
        .when(F.col("r.sp") == 0, F.lit(0.0))
        .otherwise(F.col("r.g1") * F.sqrt(n * (n - 1)) / (n - 2))
    )
    return wide.select(rows).select("r.column", "r.mean", "r.std", "r.min", "r.max", "r.n_null", skew.alias("skew"))


# ----------------------------------------------------------------------------- P7


def profile_categorical(df: DataFrame, cols: list[str], k: int = 4) -> DataFrame:
    """Per column distinct count, null count and the top-k values with counts
    (one row per (column, rank))."""
    counts = value_counts(df, cols)
    per_col = counts.groupBy("column").agg(
        F.count_if(F.col("value").isNotNull()).alias("n_distinct"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("n_null"),
    )
    return top_k_per_column(counts, k).join(per_col, "column")


# ----------------------------------------------------------------------------- P8-P10


def _pearson_abs(x, y):
    """|r| pairwise complete; constant side -> null (try_divide)."""
    both = x.isNotNull() & y.isNotNull() & ~F.isnan(x) & ~F.isnan(y)
    xm, ym = F.when(both, x), F.when(both, y)
    return F.abs(F.try_divide(F.covar_pop(xm, ym), F.stddev_pop(xm) * F.stddev_pop(ym)))


def corr_numeric(df: DataFrame, cols: list[str], y_code: str) -> DataFrame:
    """(feature, abs_r) of each numeric column with the coded target."""
    y = F.col(y_code).cast("double")
    wide = df.agg(*[_pearson_abs(F.col(c).cast("double"), y).alias(c) for c in cols])
    return wide.unpivot([], cols, "feature", "abs_r").where(F.col("abs_r").isNotNull())


def corr_onehot(df: DataFrame, cat_cols: list[str], y_code: str, top: int = 2, max_cols: int | None = None) -> DataFrame:
    """|r| of an indicator ``col == v`` for the ``top`` most frequent values of
    the first ``max_cols`` categorical columns (default: all). Only n, sums and cross sums per
    (column, value) are needed, so it is one counted aggregate, not one pass per
    indicator: with x in {0,1}, cov = Sxy/n - (Sx/n)(Sy/n), var x = p(1-p)."""
    cols = cat_cols[:max_cols]
    if not cols:
        return df.sparkSession.createDataFrame([], "feature string, abs_r double")
    y = F.col(y_code).cast("double")
    base = df.where(y.isNotNull()).select(*[F.col(c).cast("string").alias(c) for c in cols], y.alias("_y"))
    long = base.unpivot(["_y"], cols, "column", "value")
    per = long.groupBy("column", "value").agg(
        F.count(F.lit(1)).alias("n"), F.sum("_y").alias("sxy"), F.sum(F.col("_y") * F.col("_y")).alias("syy")
    )
    # totals per column from the small counted table (every row lands in one value)
    totals = per.groupBy("column").agg(F.sum("n").alias("_tn"), F.sum("sxy").alias("_ty"), F.sum("syy").alias("_tyy"))
    j = top_k_per_column(per, top).join(F.broadcast(totals), "column")  # one row per column
    N = F.col("_tn").cast("double")
    p = F.col("n") / N
    cov = F.col("sxy") / N - p * (F.col("_ty") / N)
    vy = F.col("_tyy") / N - (F.col("_ty") / N) * (F.col("_ty") / N)
    r = F.abs(F.try_divide(cov, F.sqrt(p * (1 - p)) * F.sqrt(vy)))
    return j.select(F.concat(F.col("column"), F.lit("=="), F.col("value")).alias("feature"), r.alias("abs_r")).where(
        F.col("abs_r").isNotNull()
    )


def corr_top(corrs: DataFrame, n: int = 20) -> DataFrame:
    """The n strongest features (a top-k report; the limit is the feature)."""
    return corrs.orderBy(F.col("abs_r").desc(), F.col("feature")).limit(n)


def numeric_or_coded(df: DataFrame, y: str, out: str) -> DataFrame:
    """The target as a number; label codes only where no value parses."""
    number = F.col(y).cast("string").try_cast("double")
    if df.agg(F.count(number)).first()[0]:
        return df.withColumn(out, number)
    return encode_target(df, y, out)


def target_correlations(df: DataFrame, y: str, num_cols: list[str], cat_cols: list[str]) -> DataFrame:
    coded = numeric_or_coded(df, y, "y_code")
    return corr_numeric(coded, num_cols, "y_code").unionByName(corr_onehot(coded, cat_cols, "y_code"))


# ----------------------------------------------------------------------------- P12-P18


def zero_rates(df: DataFrame, cols: list[str]) -> DataFrame:
    """Share of rows equal to zero (null counts as not zero)."""
    r = df.agg(*[F.avg(F.coalesce((F.col(c) == 0).cast("double"), F.lit(0.0))).alias(c) for c in cols])
    return r.unpivot([], cols, "column", "zero_rate")


def conditional_mean(df: DataFrame, cols: list[str]) -> DataFrame:
    """Mean over strictly positive values."""
    r = df.agg(*[F.avg(F.when(F.col(c) > 0, F.col(c).cast("double"))).alias(c) for c in cols])
    return r.unpivot([], cols, "column", "positive_mean")


def group_sizes(df: DataFrame, key) -> DataFrame:
    """A3: rows per group (map-side partial counts, so a hot key is pre-aggregated)."""
    k = F.col(key) if isinstance(key, str) else key
    return df.groupBy(k.alias("group_key")).agg(F.count(F.lit(1)).alias("group_size"))


def group_size_stats(df: DataFrame, key) -> DataFrame:
    """Mean and max of the group size seen per row, and the share of rows in
    groups of one, from the sizes table (sum n^2 / sum n), no row-level window."""
    s = group_sizes(df, key)
    return s.agg(
        (F.sum(F.col("group_size") * F.col("group_size")) / F.sum("group_size")).alias("mean_size"),
        F.max("group_size").alias("max_size"),
        (F.sum(F.when(F.col("group_size") == 1, 1).otherwise(0)) / F.sum("group_size")).alias("solo_share"),
    )


def group_rate(df: DataFrame, key, flag) -> DataFrame:
    """Per-group mean of a 0/1 column averaged over rows. A group counts as often as it has
    rows, so its mean's denominator cancels: for any ``key`` it is the sum over all rows by their
    number, and no row is shuffled."""
    f = (F.col(flag) if isinstance(flag, str) else flag).cast("double")
    return df.agg(F.avg(F.coalesce(f, F.lit(0.0))).alias("group_rate"))


def activity_stats(df: DataFrame, cols: list[str]) -> DataFrame:
    """Share of rows with a positive total, mean and max of the total."""
    from tabforge.functions.scalar import row_total

    t = row_total(cols)
    return df.select(t.alias("t")).agg(
        F.avg((F.col("t") > 0).cast("double")).alias("active_share"),
        F.avg("t").alias("total_mean"),
        F.max("t").alias("total_max"),
    )


def part_distribution(df: DataFrame, col: str, sep: str) -> DataFrame:
    """Counts of the first part of a composite code, range of the numeric second part."""
    from tabforge.functions.scalar import split_part_or_null

    first = split_part_or_null(col, sep, 0)
    num = split_part_or_null(col, sep, 1).try_cast("double")
    return (
        df.select(first.alias("first_part"), num.alias("num"))
        .groupBy("first_part")
        .agg(F.count(F.lit(1)).alias("n"), F.min("num").alias("num_min"), F.max("num").alias("num_max"))
    )


def inconsistency_rate(df: DataFrame, measure, flag) -> DataFrame:
    """Share of rows with measure > 0 while flag = 1."""
    m = F.col(measure) if isinstance(measure, str) else measure
    f = F.col(flag) if isinstance(flag, str) else flag
    return df.agg(F.avg(F.coalesce(((m > 0) & (f == 1)).cast("double"), F.lit(0.0))).alias("inconsistency_rate"))


def data_summary(df: DataFrame, y: str, cols: list[str], num_cols: list[str], medians: dict) -> DataFrame:
    """Per column dtype, missing share, signed r (numeric), min/median/max or
    distinct count and the 5 smallest distinct values."""
    coded = numeric_or_coded(df, y, "y_code")
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    aggs = [F.count(F.lit(1)).alias("_n")]
    for c in cols:
        aggs.append(F.avg(F.col(c).isNull().cast("double")).alias(f"{c}|miss"))
        if c in num_cols:
            x, yv = F.col(c).cast("double"), F.col("y_code").cast("double")
            both = x.isNotNull() & yv.isNotNull()
            xm, ym = F.when(both, x), F.when(both, yv)
            aggs += [
                F.try_divide(F.covar_pop(xm, ym), F.stddev_pop(xm) * F.stddev_pop(ym)).alias(f"{c}|r"),
                F.min(x).alias(f"{c}|min"),
                F.max(x).alias(f"{c}|max"),
            ]
    wide = coded.agg(*aggs)
    cat = [c for c in cols if c not in num_cols]
    structs = []
    for c in cols:
        isnum = c in num_cols
        structs.append(
            F.struct(
                F.lit(c).alias("column"),
                F.lit(types[c]).alias("dtype"),
                F.col(f"`{c}|miss`").alias("missing_share"),
                (F.col(f"`{c}|r`") if isnum else F.lit(None).cast("double")).alias("corr"),
                (F.col(f"`{c}|min`") if isnum else F.lit(None).cast("double")).alias("min"),
                F.lit(medians.get(c) if isnum else None).cast("double").alias("median"),
                (F.col(f"`{c}|max`") if isnum else F.lit(None).cast("double")).alias("max"),
            )
        )
    base = wide.select(F.explode(F.array(*structs)).alias("r")).select("r.*")
    if not cat:
        return base.withColumn("n_distinct", F.lit(None).cast("long")).withColumn("examples", F.lit(None).cast("string"))
    counts = value_counts(df, cat).where(F.col("value").isNotNull())
    n_distinct = counts.groupBy("column").agg(F.count(F.lit(1)).alias("n_distinct"))
    # rank <= 5 right on the window lets Spark keep 5 rows per partition before the shuffle
    w = Window.partitionBy("column").orderBy("value")
    smallest = counts.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= 5)
    ex = (
        smallest.groupBy("column")
        .agg(F.array_join(F.array_sort(F.collect_list("value")), "|").alias("examples"))
        .join(n_distinct, "column")
    )
    return base.join(fitted_table(ex), "column", "left")
