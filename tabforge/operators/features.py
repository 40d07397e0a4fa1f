"""Feature operators that need a fit or a join (F3, F13, F14, F17, F18, F19, F21-F24,
J2, J3, A3, W1). The per-row expressions live in ``tabforge.functions.scalar``.

Group statistics are an aggregate plus a join, never ``Window.partitionBy(group)``:
the aggregate pre-combines on the map side, so a group holding a third of all rows
costs one partial count per task, and the join back is a bounded broadcast or an
AQE-managed (skew-splitting) shuffle join.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

from tabforge.functions import scalar as S
from tabforge.operators.encode import fit_medians
from tabforge.operators.distinct import EXACT, distinct_counts, distinct_state
from tabforge.operators.infer import DATETIME_SHARE, ID_LIKE_MIN, ID_LIKE_SHARE, is_id_like
from tabforge.session import fitted_table

MISS_LOW, MISS_HIGH = 0.01, 0.99  # fixed: missing-indicator band


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ----------------------------------------------------------------------------- F3


def fit_equal_width(train: DataFrame, col) -> tuple[float | None, float | None]:
    """F3 fit: (min, max) over train, one aggregate."""
    r = train.agg(F.min(_c(col).cast("double")).alias("lo"), F.max(_c(col).cast("double")).alias("hi")).first()
    return r["lo"], r["hi"]


# ----------------------------------------------------------------------------- J2/J3/A3/W1


def group_size_table(train: DataFrame, key) -> DataFrame:
    """A3 / J3 fit: (group_key, group_size)."""
    return train.groupBy(_c(key).cast("string").alias("_gk")).agg(F.count(F.lit(1)).alias("_gs"))


def apply_group_sizes(
    df: DataFrame, sizes: DataFrame, key, size_col: str = "group_size", solo_col: str | None = "is_solo", default: int = 1
) -> DataFrame:
    """J2/J3 apply: size of the row's group from a fitted table; unseen -> default."""
    out = (
        df.withColumn("_gk", _c(key).cast("string"))
        .join(fitted_table(sizes), "_gk", "left")
        .withColumn(size_col, F.coalesce(F.col("_gs"), F.lit(default)).cast("long"))
        .drop("_gk", "_gs")
    )
    if solo_col:
        out = out.withColumn(solo_col, (F.col(size_col) == 1).cast("int"))
    return out


def group_size_join(df: DataFrame, key, size_col: str = "group_size", solo_col: str = "is_solo") -> DataFrame:
    """Group size computed on the same frame."""
    return apply_group_sizes(df, group_size_table(df, key), key, size_col, solo_col)


def group_transform(df: DataFrame, key, value, prefix: str = "grp") -> DataFrame:
    """Group count and mean repeated on every row (aggregate + join)."""
    g = df.groupBy(_c(key).alias("_wk")).agg(
        F.count(F.lit(1)).alias(f"{prefix}_count"), F.avg(_c(value).cast("double")).alias(f"{prefix}_mean")
    )
    return df.withColumn("_wk", _c(key)).join(fitted_table(g), "_wk", "left").drop("_wk")


# ----------------------------------------------------------------------------- F17-F19


def fit_missing_indicators(train: DataFrame, cols: list[str]) -> list[str]:
    """F17 fit: columns whose train null share lies strictly inside (0.01, 0.99)."""
    if not cols:
        return []
    r = train.agg(*[F.avg(_c(c).isNull().cast("double")).alias(c) for c in cols]).first()
    return [c for c in cols if r[c] is not None and MISS_LOW < r[c] < MISS_HIGH]


def apply_missing_indicators(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.withColumns({f"{c}__miss": F.col(c).isNull().cast("int") for c in cols})


def drop_id_like(df: DataFrame, id_like: list[str]) -> DataFrame:
    """F18."""
    return df.drop(*id_like)


def carry_columns(df: DataFrame, new_cols: dict[str, Column], skip: set[str]) -> DataFrame:
    """new columns first, then every raw column not skipped and not already made."""
    keep = [c for c in df.columns if c not in skip and c not in new_cols]
    return df.select(*[col.alias(name) for name, col in new_cols.items()], *keep)


# ----------------------------------------------------------------------------- F21


@dataclass
class GenericPlan:
    """Decisions fitted on train for the generic feature set."""

    dropped: list[str] = field(default_factory=list)
    datetime: list[str] = field(default_factory=list)
    boolish: list[str] = field(default_factory=list)
    missing: list[str] = field(default_factory=list)


def fit_generic(train: DataFrame) -> GenericPlan:
    """One aggregate decides id-like candidates, datetime and bool-like text columns
    and null shares; columns near the id-like share beyond the bounded distinct states are counted
    exactly in one more job."""
    types = {f.name: f.dataType for f in train.schema.fields}
    text = [c for c in train.columns if isinstance(types[c], StringType)]
    aggs = [F.count(F.lit(1)).alias("_n")]
    for c in train.columns:
        aggs.append(F.avg(F.col(c).isNull().cast("double")).alias(f"{c}|null"))
    for c in text:
        v = S.norm_text(c)
        aggs += [
            F.avg(F.try_to_timestamp(F.col(c)).isNotNull().cast("double")).alias(f"{c}|dt"),
            F.count_if(v.isNotNull() & ~v.isin(*S.BOOLISH_MAP)).alias(f"{c}|nb"),
        ]
    states = [distinct_state(F.col(c)).alias(f"{c}|distinct") for c in text]
    r = train.agg(*aggs, *states).first()
    n = r["_n"]
    near = [c for c in text if (r[f"{c}|distinct"] or 0) >= 0.85 * ID_LIKE_SHARE * n and r[f"{c}|distinct"] > 0.85 * ID_LIKE_MIN]
    sure = {c: int(r[f"{c}|distinct"]) for c in near if r[f"{c}|distinct"] < EXACT}
    rest = [c for c in near if c not in sure]
    exact = sure | (distinct_counts(train, {c: F.col(c) for c in rest})[0] if rest else {})
    plan = GenericPlan()
    plan.dropped = [c for c in near if is_id_like(exact[c], n)]
    rest = [c for c in text if c not in plan.dropped]
    plan.datetime = [c for c in rest if r[f"{c}|dt"] > DATETIME_SHARE]
    plan.boolish = [c for c in rest if c not in plan.datetime and r[f"{c}|nb"] == 0]
    # null shares after the transforms: bool-like columns have none (-1 for missing),
    # datetime parts are null exactly where parsing fails
    shares = {}
    for c in train.columns:
        if c in plan.dropped or c in plan.boolish:
            continue
        if c in plan.datetime:
            for p in ("year", "month", "day", "hour", "weekday"):
                shares[f"{c}_{p}"] = 1.0 - r[f"{c}|dt"]
        else:
            shares[c] = r[f"{c}|null"]
    plan.missing = [c for c, s in shares.items() if s is not None and MISS_LOW < s < MISS_HIGH]
    return plan


def apply_generic(df: DataFrame, plan: GenericPlan) -> DataFrame:
    out = df.drop(*plan.dropped)
    for c in plan.datetime:
        out = out.select("*", *S.datetime_parts(c, c)).drop(c)
    out = out.withColumns({c: S.boolish_to_int(c) for c in plan.boolish})
    return apply_missing_indicators(out, [c for c in plan.missing if c in out.columns])


def generic_features(train: DataFrame, test: DataFrame) -> tuple[DataFrame, DataFrame, GenericPlan]:
    """fit on train, apply the same plan to both."""
    plan = fit_generic(train)
    return apply_generic(train, plan), apply_generic(test, plan), plan


# ----------------------------------------------------------------------------- F22


@dataclass(frozen=True)
class DomainSpec:
    """Column names driving the domain feature set."""

    id_col: str | None = None  # '<group><sep><n>' id
    group_sep: str = "_"
    composite_col: str | None = None  # 'a/b/c' code
    composite_sep: str = "/"
    composite_names: tuple[str, ...] = ("Cabin_Deck", "Cabin_Num", "Cabin_Side")
    measure_cols: tuple[str, ...] = ()
    flag_col: str | None = None  # true/false text (any case) or boolean
    numeric_col: str | None = None  # age-like
    cross_a: str | None = None
    cross_b: str | None = None
    skip: tuple[str, ...] = ()
    bins: int = 10
    inconsistency_name: str = "CryoSpend_flag"  # flag set although the measures add up to more than 0


@dataclass
class DomainFit:
    num_lo: float | None
    num_hi: float | None
    group_sizes: DataFrame | None
    numeric_median: float | None
    true_false: list[str] = field(default_factory=list)  # columns of true/false alone (any case), or of nulls


def fit_domain(train: DataFrame, spec: DomainSpec) -> DomainFit:
    lo = hi = None
    if spec.composite_col:
        lo, hi = fit_equal_width(train, S.split_part_or_null(spec.composite_col, spec.composite_sep, 1).try_cast("double"))
    sizes = group_size_table(train, S.group_key(spec.id_col, spec.group_sep)[0]) if spec.id_col else None
    med = fit_medians(train, [spec.numeric_col])[spec.numeric_col] if spec.numeric_col else None
    flags = [f.name for f in train.schema.fields if isinstance(f.dataType, (StringType, BooleanType)) and f.name not in (spec.id_col, spec.composite_col)]
    r = train.agg(*[F.count_if(F.col(c).isNotNull() & ~S.norm_text(c).isin(*S.BOOL_TF)).alias(c) for c in flags]).first() if flags else {}
    return DomainFit(lo, hi, sizes, med, [c for c in flags if r[c] == 0])


def apply_domain(df: DataFrame, spec: DomainSpec, fit: DomainFit) -> DataFrame:
    """F1-F15 composed in one select (plus the group-size lookup)."""
    base = df
    if spec.id_col:
        gtxt, _ = S.group_key(spec.id_col, spec.group_sep)
        base = apply_group_sizes(base.withColumn("_grp", gtxt), fit.group_sizes, "_grp", "GroupSize", "IsSolo").drop("_grp")
    new: dict[str, Column] = {}
    names = list(spec.composite_names)
    deck = None
    if spec.composite_col:
        deck = F.coalesce(S.split_part_or_null(spec.composite_col, spec.composite_sep, 0), F.lit(S.NA_TOKEN))
        num = S.split_part_or_null(spec.composite_col, spec.composite_sep, 1).try_cast("double")
        side = F.coalesce(S.split_part_or_null(spec.composite_col, spec.composite_sep, 2), F.lit(S.NA_TOKEN))
        new[names[0]] = deck
        new[names[1]] = num
        new[names[1].replace("_", "") + "_bin"] = S.bin_equal_width(num, fit.num_lo, fit.num_hi, spec.bins).cast("double")
        new[names[2]] = side
    if spec.id_col:
        new["Group"] = S.group_key(spec.id_col, spec.group_sep)[1]
        new["GroupSize"] = F.col("GroupSize")
        new["IsSolo"] = F.col("IsSolo")
    total = None
    if spec.measure_cols:
        total = S.row_total(spec.measure_cols)
        size = F.col("GroupSize") if spec.id_col else None
        new["TotalSpend"] = total
        new["AnySpend"] = S.any_flag(total)
        new["LogTotalSpend"] = F.log1p(total)
        new["SpendPerPerson"] = S.per_capita(total, size)
        for m in spec.measure_cols:
            v = F.coalesce(F.col(m).cast("string").try_cast("double"), F.lit(0.0))
            new[m] = v
            new[f"Log{m}"] = F.log1p(v)
    flag01 = None
    if spec.flag_col:
        new[f"{spec.flag_col}_int"] = S.bool_to_int(spec.flag_col)
        flag01 = F.greatest(S.bool_to_int(spec.flag_col), F.lit(0))
        if total is not None:
            new[spec.inconsistency_name] = S.inconsistency_flag(flag01, total)
    for c in fit.true_false:
        new.setdefault(f"{c}_int", S.bool_to_int(c))
    if spec.numeric_col:
        a = F.col(spec.numeric_col).cast("string").try_cast("double")
        new[f"{spec.numeric_col}_bin"] = S.bin_edges(a).cast("double")
        med = fit.numeric_median if fit.numeric_median is not None else 0.0
        if flag01 is not None:
            new[f"{spec.numeric_col}_x_Flag"] = S.interact(a, flag01, med)
        if total is not None:
            new[f"{spec.numeric_col}_x_Spend"] = S.interact_log(a, total, med)
    if spec.cross_b:
        if deck is not None:
            new[f"Deck_x_{spec.cross_b}"] = S.cross_categories(deck, spec.cross_b)
        if spec.cross_a:
            new[f"{spec.cross_a}_x_{spec.cross_b}"] = S.cross_categories(spec.cross_a, spec.cross_b)
    skip = set(spec.skip) | {c for c in (spec.id_col, spec.composite_col) if c} | {"GroupSize", "IsSolo"}
    return carry_columns(base, new, skip)


# ----------------------------------------------------------------------------- F23/F24


class PluginRejected(ValueError):
    pass


def apply_plugin(
    fn: Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]], train: DataFrame, test: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """run a caller's ``fe(train, test)``; reject non-DataFrame results or a
    changed row count; keep the columns present in both, in train order."""
    res = fn(train, test)
    if not (isinstance(res, tuple) and len(res) == 2 and all(isinstance(x, DataFrame) for x in res)):
        raise PluginRejected("fe() must return two DataFrames")
    tr, te = res
    counts = train.agg(F.count(F.lit(1))).first()[0], test.agg(F.count(F.lit(1))).first()[0]
    new_counts = tr.agg(F.count(F.lit(1))).first()[0], te.agg(F.count(F.lit(1))).first()[0]
    if counts != new_counts:
        raise PluginRejected(f"row count changed: {counts} -> {new_counts}")
    shared = [c for c in tr.columns if c in te.columns]
    return tr.select(*shared), te.select(*shared)


def keep_if_better(candidates: DataFrame) -> DataFrame:
    """from (name, score, is_baseline) pick the highest score; the baseline
    wins ties; a null score (failed run) never wins."""
    ranked = candidates.where(F.col("score").isNotNull())
    best = ranked.agg(F.max_by(F.col("name"), F.struct(F.col("score"), F.col("is_baseline").cast("int"))).alias("c")).first()
    chosen = best["c"] if best else None
    return candidates.withColumn("chosen", F.coalesce((F.col("name") == F.lit(chosen)).cast("int"), F.lit(0)))
