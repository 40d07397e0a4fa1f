"""Cross-validation, tournament, out-of-fold, refit and stacking queries (M3, M4, M6, M7, M11,
M12, M14, F24) with learners that have a closed form: one-feature least squares and a ridge on
three columns. DuckDB therefore checks every predicted row; the boosters run in ``q_models``.

Task: the order total (in 100,000s) from the orders' line count, quantity and mean price. A hashed
fifth of the orders is the test part; the rest is train with hashed folds.
"""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorSlicer
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from tabforge.functions.scalar import hash_bucket
from tabforge.operators import encode as E
from tabforge.operators.features import keep_if_better
from tabforge.operators.folds import assign_folds
from tabforge.operators.infer import REGRESSION
from tabforge.plans import fixtures as X
from tabforge.plans import models as M
from tabforge.plans.catalog import register
from tabforge.session import cut_lineage

K = X.K
COLS = ["n_lines", "sum_qty", "avg_price"]


def order_rows(spark, d):
    """id, fold, part (0 is test), label and the three measures of every order."""
    li = X.table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.count(F.lit(1)).cast("double").alias("n_lines"), F.sum("l_quantity").alias("sum_qty"), F.avg("l_extendedprice").alias("avg_price")
    )
    o = X.table(spark, d, "orders").join(li, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    o = o.select(F.col("o_orderkey").alias("id"), (F.col("o_totalprice") / 100000.0).alias("label"), *[F.coalesce(c, F.lit(0.0)).cast("double").alias(c) for c in COLS])
    return assign_folds(o, K, "id").withColumn("part", F.pmod(hash_bucket("id", "part"), F.lit(5)).cast("int"))


SQL_ORDER_ROWS = f"""select o_orderkey as id, cast({X.sql_hash8("o_orderkey")} % {K} as int) as fold, cast({X.sql_hash8("o_orderkey", "part")} % 5 as int) as part,
  o_totalprice / 100000.0 as label, coalesce(n_lines, 0.0) as n_lines, coalesce(sum_qty, 0.0) as sum_qty, coalesce(avg_price, 0.0) as avg_price
from orders left join (select l_orderkey, count(*)::double as n_lines, sum(l_quantity)::double as sum_qty, avg(l_extendedprice)::double as avg_price
  from lineitem group by l_orderkey) l on o_orderkey = l_orderkey"""


def order_data(spark, d, cols) -> M.ModelData:
    """The same rows as assembled vectors; checkpointed, as every fold fit reads them again."""
    rows = cut_lineage(order_rows(spark, d))
    v = E.assemble(rows, cols)
    train = v.where("part <> 0").select("id", "fold", "label", "features")
    return M.ModelData(train, v.where("part = 0").select("id", "features"), REGRESSION, 0, list(cols))


def linear():
    return M.make_estimator("linear", REGRESSION)


def linear_on(i: int):
    """Factory of a least-squares learner on the ``i``-th feature alone."""
    return lambda: Pipeline(stages=[VectorSlicer(inputCol="features", outputCol="x", indices=[i]), LinearRegression(featuresCol="x", labelCol="label")])


def _broken():
    raise RuntimeError("no such learner")


# ---- SQL twins ----------------------------------------------------------------------------------

_SQL_ROWS = f"with b as materialized ({SQL_ORDER_ROWS}), tr as (select * from b where part <> 0), te as (select * from b where part = 0), folds as (select cast(unnest(range({K})) as int) as f)"


def _sql_fits(cols) -> str:
    """CTE m: per left-out fold slope and intercept of every one-feature regression."""
    fits = ", ".join(f"regr_slope(label, {c}) as s_{c}, regr_intercept(label, {c}) as i_{c}" for c in cols)
    return f"m as (select f, {fits} from folds join tr on tr.fold <> f group by f)"


def _sql_line(c: str) -> str:
    return f"(i_{c} + s_{c} * {c})"


def _sql_cv(cols) -> str:
    """CTE cv: model, rank, fold, score (negative mean squared error of the held-out fold)."""
    one = " union all ".join(
        f"select '{c}' as model, {r} as rank, fold, -avg(power({_sql_line(c)} - label, 2)) as score from tr join m on tr.fold = m.f group by fold" for r, c in enumerate(cols)
    )
    return f"cv as ({one})"


def _sql_ridge(rows: str, cols) -> str:
    """CTE g: per left-out fold mean, deviation and weight of a ridge (alpha 1) on three
    standardised columns, by Cramer's rule."""
    a, b, c = cols
    stats = ", ".join(f"avg({x}) as mu_{x}, stddev_pop({x}) as sd_{x}, covar_pop({x}, label) as cy_{x}" for x in cols)
    pairs = ", ".join(f"covar_pop({x}, {y}) as c_{x}_{y}" for x, y in ((a, b), (a, c), (b, c)))
    return f"""g0 as (select f, count(*) as n, avg(label) as ybar, {stats}, {pairs} from folds join {rows} r on r.fold <> f group by f),
g1 as (select *, n + 1.0 as p, n * c_{a}_{b} / (sd_{a} * sd_{b}) as q, n * c_{a}_{c} / (sd_{a} * sd_{c}) as r, n * c_{b}_{c} / (sd_{b} * sd_{c}) as s,
  n * cy_{a} / sd_{a} as u, n * cy_{b} / sd_{b} as v, n * cy_{c} / sd_{c} as w from g0),
g2 as (select *, p * (p * p - s * s) - q * (q * p - s * r) + r * (q * s - p * r) as det from g1),
g as (select *, (u * (p * p - s * s) - q * (v * p - s * w) + r * (v * s - p * w)) / det as w_{a},
  (p * (v * p - s * w) - u * (q * p - s * r) + r * (q * w - v * r)) / det as w_{b},
  (p * (p * w - v * s) - q * (q * w - v * r) + u * (q * s - p * r)) / det as w_{c} from g2)"""


def _sql_ridge_value(cols) -> str:
    return "ybar + " + " + ".join(f"w_{x} * ({x} - mu_{x}) / sd_{x}" for x in cols)


# ---- queries ------------------------------------------------------------------------------------


@register(
    "fit_score_linear",
    "M3",
    f"{_SQL_ROWS}, {_sql_fits(['sum_qty'])} select id, fold, round({_sql_line('sum_qty')}, 6) as prediction from tr join m on tr.fold = m.f where fold = 2",
)
def q_fit_score_linear(spark, d):
    _, scored = M.fit_score(linear, order_data(spark, d, ["sum_qty"]), 2)
    return scored.select("id", "fold", F.round("prediction", 6).alias("prediction"))


@register(
    "cross_validate_linear",
    "M4",
    f"{_SQL_ROWS}, {_sql_fits(['sum_qty'])}, {_sql_cv(['sum_qty'])} select model, fold, round(score, 6) as score from cv",
)
def q_cross_validate_linear(spark, d):
    scores = M.cross_validate(linear, order_data(spark, d, ["sum_qty"]), K)
    out = spark.createDataFrame([("sum_qty", i, float(s)) for i, s in enumerate(scores)], "model string, fold int, score double")
    return out.withColumn("score", F.round("score", 6))


@register(
    "model_tournament_linear",
    "M6 M4",
    f"""{_SQL_ROWS}, {_sql_fits(COLS)}, {_sql_cv(COLS)},
t as (select model, rank, avg(score) as mean, stddev_pop(score) as std, string_agg(format('{{:.5f}}', score), ',' order by fold) as cv_scores from cv group by model, rank)
select model, cast(rank as int) as candidate_rank, round(mean, 5) as cv_mean, round(std, 5) as cv_std, cv_scores, cast(null as varchar) as error,
  cast(row_number() over (order by round(mean, 5) desc, rank) = 1 as int) as is_best from t
union all select 'broken', 3, null, null, null, 'RuntimeError: no such learner', 0""",
)
def q_model_tournament_linear(spark, d):
    cands = [(c, linear_on(i)) for i, c in enumerate(COLS)] + [("broken", _broken)]
    return M.model_tournament(cands, order_data(spark, d, COLS), K)


@register(
    "oof_predict_linear",
    "M7",
    f"""{_SQL_ROWS}, {_sql_fits(['sum_qty'])}
select id, fold, 'train' as split, round({_sql_line('sum_qty')}, 6) as score from tr join m on tr.fold = m.f
union all select id, null, 'test', round(avg({_sql_line('sum_qty')}), 6) from te cross join m group by id""",
)
def q_oof_predict_linear(spark, d):
    oof, te = M.oof_predict("sum_qty", linear, order_data(spark, d, ["sum_qty"]), K)
    both = oof.withColumn("split", F.lit("train")).unionByName(te.withColumns({"fold": F.lit(None).cast("int"), "split": F.lit("test")}))
    return both.select("id", "fold", "split", F.round("score", 6).alias("score"))


@register(
    "fit_final_linear",
    "M14",
    f"{_SQL_ROWS}, m as (select regr_slope(label, sum_qty) as s_sum_qty, regr_intercept(label, sum_qty) as i_sum_qty from tr) select id, round({_sql_line('sum_qty')}, 6) as value from te cross join m",
)
def q_fit_final_linear(spark, d):
    return M.fit_final("linear", {}, order_data(spark, d, ["sum_qty"])).select("id", F.round("value", 6).alias("value"))


@register(
    "keep_if_better_linear",
    "F24 M4",
    f"""{_SQL_ROWS}, {_sql_fits(COLS)}, {_sql_cv(COLS)}, t as (select model as name, avg(score) as score, model = 'n_lines' as is_baseline from cv group by model)
select name, round(score, 6) as score, is_baseline, cast(row_number() over (order by score desc, is_baseline desc) = 1 as int) as chosen from t
union all select 'broken', null, false, 0""",
)
def q_keep_if_better_linear(spark, d):
    data = order_data(spark, d, COLS)
    means = {c: sum(s) / K for i, c in enumerate(COLS) if (s := M.cross_validate(linear_on(i), data, K))}
    rows = [(c, means[c], c == "n_lines") for c in COLS] + [("broken", None, False)]
    out = keep_if_better(spark.createDataFrame(rows, "name string, score double, is_baseline boolean"))
    return out.withColumn("score", F.round("score", 6))


@register(
    "meta_ridge",
    "M11",
    f"""{_SQL_ROWS.replace("where part <> 0", "")}, {_sql_ridge("tr", COLS)}
select id, fold, label, round({_sql_ridge_value(COLS)}, 6) as pred from tr join g on tr.fold = g.f""",
)
def q_meta_ridge(spark, d):
    oof, _ = M.meta_ridge(order_rows(spark, d), None, COLS, K)
    return oof.select("id", "fold", "label", F.round("pred", 6).alias("pred"))


@register(
    "stacking_linear",
    "M12 M7 J6 M11",
    f"""{_SQL_ROWS}, {_sql_fits(COLS)},
o as (select id, fold, label, {", ".join(f"{_sql_line(c)} as p_{c}" for c in COLS)} from tr join m on tr.fold = m.f),
e as (select id, {", ".join(f"avg({_sql_line(c)}) as p_{c}" for c in COLS)} from te cross join m group by id),
{_sql_ridge("o", ["p_" + c for c in COLS])}
select id, round(avg({_sql_ridge_value(["p_" + c for c in COLS])}), 6) as prediction from e cross join g group by id""",
)
def q_stacking_linear(spark, d):
    models = [(c, linear_on(i)) for i, c in enumerate(COLS)]
    res = M.stack(order_data(spark, d, COLS), K, models=models)
    return res.predictions.select("id", F.round("prediction", 6).alias("prediction"))
