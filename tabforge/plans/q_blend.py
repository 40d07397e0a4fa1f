"""Queries for decisions and thresholds (D1-D6, A4, A5, A6), blending (B1-B6, W5,
W6, J5, J6, A7) and grading (V1, V2, J7)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from tabforge.operators import blend as B
from tabforge.operators import decide as D
from tabforge.operators import grade as G
from tabforge.operators.folds import assign_folds, cv_summary
from tabforge.plans import fixtures as X
from tabforge.plans.catalog import register

_SC = X.sql_scores("p")


def _sql_sweep(lo, step, n, rounded=True):
    acc = "avg(case when cast(p >= t as int) = y then 1.0 else 0.0 end)"
    sel = f"round(t, 9) as threshold, round({acc}, 9) as accuracy" if rounded else f"t as threshold, {acc} as accuracy"
    return f"""select {sel}
from ({_SC}) s, (select {lo}e0 + {step}e0 * cast(i as double) as t from range({n}) r(i)) g group by t"""


def _spark_sweep(spark, d, grid):
    s = D.threshold_sweep(X.scores(spark, d), "y", "p", grid)
    return s.select(F.round("threshold", 9).alias("threshold"), F.round("accuracy", 9).alias("accuracy"))


@register("threshold_sweep", "D1", _sql_sweep(*D.GRID))
def q_threshold_sweep(spark, d):
    return _spark_sweep(spark, d, D.GRID)


@register("threshold_sweep_fine", "D2", _sql_sweep(*D.GRID_FINE))
def q_threshold_sweep_fine(spark, d):
    return _spark_sweep(spark, d, D.GRID_FINE)


@register(
    "best_threshold",
    "D3",
    f"""select round(case when accuracy > 0 then threshold else 0.5 end, 9) as threshold, round(accuracy, 9) as accuracy
from ({_sql_sweep(*D.GRID, rounded=False)}) order by accuracy desc, threshold limit 1""",
)
def q_best_threshold(spark, d):
    s = D.threshold_sweep(X.scores(spark, d), "y", "p", D.GRID)
    b = D.best_threshold(s)
    return b.select(F.round("threshold", 9).alias("threshold"), F.round("accuracy", 9).alias("accuracy"))


@register(
    "threshold_gain",
    "D4",
    f"""with b as (select case when accuracy > 0 then threshold else 0.5 end as threshold, accuracy from ({_sql_sweep(*D.GRID_FINE, rounded=False)})
               order by accuracy desc, threshold limit 1),
h as (select avg(case when cast(p >= 0.5 as int) = y then 1.0 else 0.0 end) as acc_at_half from ({_SC}))
select round(b.threshold, 9) as threshold, round(b.accuracy, 9) as best_accuracy, round(h.acc_at_half, 9) as acc_at_half,
  round(b.accuracy - h.acc_at_half, 9) as gain from b, h""",
)
def q_threshold_gain(spark, d):
    r = D.threshold_gain(X.scores(spark, d), "y", "p", D.GRID_FINE)
    return r.select(*[F.round(c, 9).alias(c) for c in r.columns])


@register(
    "apply_threshold",
    "D5",
    f"""with b as (select case when accuracy > 0 then threshold else 0.5 end as t from ({_sql_sweep(*D.GRID, rounded=False)})
               order by accuracy desc, threshold limit 1)
select s.doc_id, cast(s.p >= b.t as int) as prediction from ({_SC}) s, b""",
)
def q_apply_threshold(spark, d):
    sc = X.scores(spark, d)
    t = D.best_threshold(D.threshold_sweep(sc, "y", "p", D.GRID)).first()["threshold"]
    return sc.select("doc_id", D.apply_threshold("p", t).alias("prediction"))


@register(
    "argmax_class",
    "D6",
    "select vec_id, cast(list_position(embedding, list_max(embedding)) - 1 as int) as predicted from embeddings",
)
def q_argmax_class(spark, d):
    e = X.table(spark, d, "embeddings")
    return e.select("vec_id", D.argmax_class("embedding").alias("predicted"))


def _sql_norm_vote(v="prediction"):
    return f"case when lower(trim(cast({v} as varchar))) in ('true', '1') or try_cast(cast({v} as varchar) as double) = 1.0 then 1 else 0 end"


@register(
    "accuracy",
    "A4 B1",
    "\nunion all\n".join(
        f"select '{m}' as model, round(avg(case when {_sql_norm_vote()} = l.quality then 1.0 else 0.0 end), 9) as accuracy "
        f"from ({sql}) v join labels l on v.doc_id = l.doc_id"
        for m, sql in X.SQL_VOTES.items()
    ),
)
def q_accuracy(spark, d):
    lab = X.table(spark, d, "labels")
    parts = []
    for name, df, _ in X.vote_tables(spark, d):
        j = df.select("doc_id", B.normalise_vote("prediction").alias("v")).join(lab, "doc_id")
        parts.append(D.accuracy(j, "v", "quality").select(F.lit(name).alias("model"), F.round("accuracy", 9).alias("accuracy")))
    return reduce(lambda a, b: a.unionByName(b), parts)


@register(
    "rmse",
    "A5 J4",
    f"""with o as (select *, {X.sql_hash8('o_orderkey')} % 5 as fold from orders),
k as (select o_orderpriority, unnest(range(5)) as fold from (select distinct o_orderpriority from o)),
m as (select k.o_orderpriority, k.fold, sum(o.o_totalprice::decimal(18, 2))::double / count(*) as pred
  from k join o on o.o_orderpriority = k.o_orderpriority and o.fold <> k.fold group by 1, 2)
select round(sqrt(avg(pow(m.pred - o.o_totalprice, 2))), 6) as rmse, round(-avg(pow(m.pred - o.o_totalprice, 2)), 3) as neg_mse
from o join m on o.o_orderpriority = m.o_orderpriority and o.fold = m.fold""",
)
def q_rmse(spark, d):
    from tabforge.operators.folds import fold_scatter

    # every row is scored by the mean of its priority over the other four folds
    o = assign_folds(X.table(spark, d, "orders"), 5, "o_orderkey")
    per = o.groupBy("o_orderpriority", "fold").agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("s"), F.count(F.lit(1)).alias("n"))
    total = per.groupBy("o_orderpriority").agg(F.sum("s").alias("ts"), F.sum("n").alias("tn"))
    pred = F.try_divide((F.col("ts") - F.col("s")).cast("double"), F.col("tn") - F.col("n"))
    m = per.join(total, "o_orderpriority").select("o_orderpriority", "fold", pred.alias("pred"))
    j = fold_scatter(o, m, ["o_orderpriority"])
    r = D.rmse(j, "pred", "o_totalprice")
    return r.select(F.round("rmse", 6).alias("rmse"), F.round("neg_mse", 3).alias("neg_mse"))


@register(
    "cv_summary",
    "A6 A4 M2",
    f"""with f as ({X.SQL_TRAIN_DOCS_FOLDED}),
v as ({" union all ".join(f"select '{m}' as model, doc_id, {_sql_norm_vote()} as v from ({sql})" for m, sql in X.SQL_VOTES.items())}),
s as (select model, fold, avg(case when v.v = f.quality then 1.0 else 0.0 end) as score from v join f on v.doc_id = f.doc_id group by all)
select model, fold, round(score, 5) as cv_score, round(avg(score) over (partition by model), 5) as cv_mean,
  round(stddev_pop(score) over (partition by model), 5) as cv_std from s""",
)
def q_cv_summary(spark, d):
    f = X.train_docs_folded(spark, d)
    parts = []
    for name, df, _ in X.vote_tables(spark, d):
        j = df.select("doc_id", B.normalise_vote("prediction").alias("v")).join(f, "doc_id")
        parts.append(D.accuracy(j, "v", "quality", ["fold"]).select(F.lit(name).alias("model"), "fold", F.col("accuracy").alias("score")))
    return cv_summary(reduce(lambda a, b: a.unionByName(b), parts))


_SQL_LONG = " union all ".join(
    f"select doc_id as id, '{m}' as model, {X.VOTE_WEIGHTS[m]} as weight, {i} as pos, prediction as value from ({sql})"
    for i, (m, sql) in enumerate(X.SQL_VOTES.items())
)


def _long_votes(spark, d):
    return B.stack_predictions(X.vote_tables(spark, d), "doc_id", "prediction")


@register("stack_predictions", "W6", f"select id, model, cast(weight as double) as weight, cast(pos as int) as pos, value from ({_SQL_LONG})")
def q_stack_predictions(spark, d):
    return _long_votes(spark, d)


@register("normalise_votes", "B1", f"select id, model, {_sql_norm_vote('value')} as vote from ({_SQL_LONG})")
def q_normalise_votes(spark, d):
    return _long_votes(spark, d).select("id", "model", B.normalise_vote("value").alias("vote"))


@register(
    "value_set_subset",
    "W5",
    f"""select model, cast(count(*) filter (where lower(trim(value)) not in ('true', 'false', '1', '0') or value is null) = 0 as int) as is_subset,
  count(distinct lower(trim(value))) as n_values from ({_SQL_LONG}) group by model""",
)
def q_value_set_subset(spark, d):
    return B.value_set_subset(_long_votes(spark, d), by=["model"])


_VOTE_SQL = f"""with l as ({_SQL_LONG}),
per as (select id, sum(weight * {_sql_norm_vote('value')}) as ws, count(distinct pos) as k from l group by id),
ref as (select distinct id from l where pos = 0)
select ref.id, case when coalesce(per.k, 0) < 3 then 'False' when per.ws / 4.5 >= 0.5 then 'True' else 'False' end as prediction
from ref left join per on ref.id = per.id"""


@register("weighted_vote", "B2 B5", _VOTE_SQL)
def q_weighted_vote(spark, d):
    return B.weighted_vote(_long_votes(spark, d))


@register("blend_selected", "B6 B4", _VOTE_SQL)
def q_blend_selected(spark, d):
    # sources a/b/c stand for the stacked, threshold and generated predictions; an empty one is absent
    a, b, c = (df if df.limit(1).count() else None for _, df, _ in X.vote_tables(spark, d))
    out, _ = B.final_predictions({"stacked": a, "threshold": b, "plain": b, "generated": c}, "doc_id", "prediction")
    return out


def _score_tables(spark, d):
    docs = X.table(spark, d, "documents").select("doc_id")
    lab = X.table(spark, d, "labels").select("doc_id")
    from tabforge.functions.scalar import hash_bucket

    def sc(df, salt):
        return df.select("doc_id", (hash_bucket("doc_id", salt) / F.lit(4294967296.0)).alias("prediction"))

    return [("s1", sc(docs, "p"), 2.0), ("s2", sc(docs, "q"), 1.5), ("s3", sc(docs.join(lab, "doc_id", "left_semi"), "r"), 1.0)]


_SQL_SCORES_LONG = f"""select doc_id as id, 0 as pos, 2.0 as weight, {X.sql_hash8('doc_id', 'p')} / 4294967296.0 as x from documents
union all select doc_id, 1, 1.5, {X.sql_hash8('doc_id', 'q')} / 4294967296.0 from documents
union all select doc_id, 2, 1.0, {X.sql_hash8('doc_id', 'r')} / 4294967296.0 from documents d where exists (select 1 from labels l where l.doc_id = d.doc_id)"""


@register(
    "weighted_average",
    "B3",
    f"""with l as ({_SQL_SCORES_LONG}), ref as (select distinct id from l where pos = 0),
per as (select id, sum(weight * x) as ws, count(distinct pos) as k from l group by id)
select ref.id, round(case when coalesce(per.k, 0) < 3 then null else per.ws / 4.5 end, 9) as prediction from ref left join per on ref.id = per.id""",
)
def q_weighted_average(spark, d):
    r = B.blend(_score_tables(spark, d), "doc_id", "prediction")
    return r.select("id", F.round("prediction", 9).alias("prediction"))


@register(
    "blend_mode",
    "B4 B5 W5",
    f"""select 'votes' as table_set, case when count(*) filter (where lower(trim(value)) not in ('true','false','1','0') or value is null) = 0
  and count(distinct lower(trim(value))) <= 4 then 'vote' else 'average' end as mode,
  cast(count(*) filter (where pos = 0 and lower(trim(value)) not in ('true','false')) = 0 as int) as as_bool from ({_SQL_LONG})
union all
select 'scores', case when count(*) filter (where lower(trim(cast(x as varchar))) not in ('true','false','1','0')) = 0 then 'vote' else 'average' end,
  cast(count(*) filter (where pos = 0 and lower(trim(cast(x as varchar))) not in ('true','false')) = 0 as int) from ({_SQL_SCORES_LONG})""",
)
def q_blend_mode(spark, d):
    rows = []
    for name, tables in (("votes", X.vote_tables(spark, d)), ("scores", _score_tables(spark, d))):
        long = B.stack_predictions(tables, "doc_id", "prediction")
        rows.append((name, B.blend_mode(long), int(B.output_as_bool(long))))
    # summary rows come from aggregates over the whole tables above
    return spark.createDataFrame(rows, "table_set string, mode string, as_bool int")


@register(
    "restore_label_format",
    "B5",
    f"""with w as ({_VOTE_SQL}) select id, case when prediction = 'True' then 1 else 0 end as prediction_01, prediction as prediction_bool from w""",
)
def q_restore_label_format(spark, d):
    long = _long_votes(spark, d)
    majority = B.weighted_majority(long)  # one blend, written in both formats
    return majority.select("id", B.vote_format("majority", False).cast("int").alias("prediction_01"), B.vote_format("majority", True).alias("prediction_bool"))


@register(
    "align_predictions",
    "J5",
    f"""with l as ({_SQL_LONG}), ref as (select distinct id from l where pos = 0)
select ref.id, a.value as a, b.value as b, c.value as c from ref
left join (select id, value from l where model = 'a') a on ref.id = a.id
left join (select id, value from l where model = 'b') b on ref.id = b.id
left join (select id, value from l where model = 'c') c on ref.id = c.id""",
)
def q_align_predictions(spark, d):
    return B.align_predictions(_long_votes(spark, d))


@register(
    "unanimous_rate",
    "A7",
    f"""with l as ({_SQL_LONG}), ref as (select distinct id from l where pos = 0),
per as (select id, count(distinct {_sql_norm_vote('value')}) as nv from l group by id)
select round(avg(case when per.nv = 1 then 1.0 else 0.0 end), 9) as unanimous_rate from ref left join per on ref.id = per.id""",
)
def q_unanimous_rate(spark, d):
    return B.unanimous_rate(_long_votes(spark, d)).select(F.round("unanimous_rate", 9).alias("unanimous_rate"))


@register(
    "stack_features",
    "J6",
    f"""select doc_id, {", ".join(f"round(max(case when model = 'm{i}' then score end), 9) as m{i}" for i in (1, 2, 3))}
from ({" union all ".join(f"select doc_id, 'm{i}' as model, {X.sql_hash8('doc_id', f'm{i}')} / 4294967296.0 as score from labels" for i in (1, 2, 3))})
group by doc_id""",
)
def q_stack_features(spark, d):
    from tabforge.functions.scalar import hash_bucket
    from tabforge.plans.models import stack_wide

    lab = X.table(spark, d, "labels").select("doc_id")
    long = reduce(
        lambda a, b: a.unionByName(b),
        [lab.select("doc_id", F.lit(f"m{i}").alias("model"), (hash_bucket("doc_id", f"m{i}") / F.lit(4294967296.0)).alias("score")) for i in (1, 2, 3)],
    )
    wide = stack_wide(long.withColumnRenamed("doc_id", "id"), ["m1", "m2", "m3"], has_fold=False)
    return wide.select(F.col("id").alias("doc_id"), *[F.round(f"m{i}", 9).alias(f"m{i}") for i in (1, 2, 3)])


@register(
    "match_submission_ids",
    "J7",
    f"""select doc_id as id, 'missing' as status from documents d where not exists (select 1 from ({X.SQL_VOTES['c']}) c where c.doc_id = d.doc_id)
union all select doc_id, 'extra' from ({X.SQL_VOTES['c']}) c where not exists (select 1 from documents d where d.doc_id = c.doc_id)""",
)
def q_match_ids(spark, d):
    c = X.vote_tables(spark, d)[2][1]
    return G.match_ids(c, X.table(spark, d, "documents"), "doc_id")


@register(
    "validate_predictions",
    "V1 J7",
    f"""with c as ({X.SQL_VOTES['c']})
select 1 as columns_ok, (select count(*) from c) as n_rows, (select count(*) from documents) as n_expected,
  (select count(*) from documents d where not exists (select 1 from c where c.doc_id = d.doc_id)) as n_missing,
  (select count(*) from c where not exists (select 1 from documents d where d.doc_id = c.doc_id)) as n_extra,
  (select count(*) from c where prediction is null) as n_null,
  (select count(*) - count(distinct doc_id) from c) as n_duplicate, 0 as valid""",
)
def q_validate(spark, d):
    c = X.vote_tables(spark, d)[2][1]
    return G.validate_predictions(c, X.table(spark, d, "documents"), "doc_id", "prediction")


@register(
    "grade",
    "V2 A4",
    f"""select round(avg(case when {_sql_norm_vote()} = l.quality then 1.0 else 0.0 end), 9) as score, count(*) as n_graded,
  case when avg(case when {_sql_norm_vote()} = l.quality then 1.0 else 0.0 end) >= 0.82066 then 'gold'
       when avg(case when {_sql_norm_vote()} = l.quality then 1.0 else 0.0 end) >= 0.81388 then 'silver'
       when avg(case when {_sql_norm_vote()} = l.quality then 1.0 else 0.0 end) >= 0.80967 then 'bronze' else 'none' end as medal,
  cast(avg(case when {_sql_norm_vote()} = l.quality then 1.0 else 0.0 end) >= 0.80967 as int) as any_medal
from ({_VOTE_SQL.replace('ref.id,', 'ref.id as doc_id,')}) v join labels l on v.doc_id = l.doc_id""",
)
def q_grade(spark, d):
    blended = B.weighted_vote(_long_votes(spark, d)).select(F.col("id").alias("doc_id"), B.normalise_vote("prediction").alias("p"))
    r = G.grade(blended, X.table(spark, d, "labels"), "doc_id", "p", "quality")
    return r.select(F.round("score", 9).alias("score"), "n_graded", "medal", "any_medal")
