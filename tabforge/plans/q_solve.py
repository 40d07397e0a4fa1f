"""Queries of the end-to-end plan (M12 solve, D7) and of the closed-form learners behind it (M8, M10,
M7, M11), each with a DuckDB twin that fits and scores the same models.

Tasks: ``documents.quality`` (binary; labelled documents train, the others are the test table),
``orders.o_orderstatus`` (three classes) and the order total (regression); of the orders a hashed
fifth is the test table.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tabforge.functions.scalar import hash_bucket
from tabforge.operators.infer import MULTICLASS
from tabforge.plans import fixtures as X
from tabforge.plans import learners as L
from tabforge.plans import solve as S
from tabforge.plans.catalog import register
from tabforge.plans.q_closed import COLS, SQL_ORDER_ROWS, _sql_ridge, _sql_ridge_value, order_rows
from tabforge.plans.q_models import _pseudo_stack

K = X.K
FOLDS = f"folds as (select cast(unnest(range({K})) as int) as f)"


# ---- SQL of the learners: tables tr (id, fold, label, ...) and te (id, ...) ------------------------


def sql_scored_rows(cols: list[str]) -> str:
    """CTE x: every row with the fold model (f) that scores it: its own fold's, or each of all."""
    c = ", ".join(cols)
    return f"x as (select id, fold as f, 'train' as split, {c} from tr union all select id, f, 'test', {c} from te cross join folds)"


def sql_bayes(name: str, cols: list[str], bins: int, add: float, classes: int) -> str:
    """CTEs ending in ``name`` (id, f, split, c, p): class probabilities of counted naive Bayes."""
    part = lambda v: f"least(greatest(floor(({v} - lo_{v}) / (case when hi_{v} > lo_{v} then hi_{v} - lo_{v} else 1 end) * {bins}), 0), {bins - 1})"
    n = name
    ctes = [
        f"{n}_r as (select {', '.join(f'min({v}) as lo_{v}, max({v}) as hi_{v}' for v in cols)} from tr)",
        f"{n}_b as materialized (select id, fold, label, {', '.join(f'{part(v)} as {v}' for v in cols)} from tr cross join {n}_r)",
        f"{n}_n as materialized (select f, label as c, count(*) as n, sum(count(*)) over (partition by f) as total from folds join {n}_b on fold <> f group by f, label)",
    ]
    ctes += [f"{n}_{v} as materialized (select f, label as c, {v} as b, count(*) as n from folds join {n}_b on fold <> f group by all)" for v in cols]
    ctes.append(f"{n}_x as (select id, f, split, {', '.join(f'{part(v)} as {v}' for v in cols)} from x cross join {n}_r)")
    terms = " + ".join(f"ln((coalesce(t_{v}.n, 0) + {add}) / (k.n + {add * bins}))" for v in cols)
    joins = " ".join(f"left join {n}_{v} t_{v} on t_{v}.f = r.f and t_{v}.c = k.c and t_{v}.b = r.{v}" for v in cols)
    ctes.append(
        f"{n}_l as (select r.id, r.f, r.split, k.c, ln((k.n + {add}) / (k.total + {add * classes})) + {terms} as l from {n}_x r join {n}_n k on k.f = r.f {joins})"
    )
    ctes.append(f"{n}_e as (select id, f, split, c, exp(l - max(l) over (partition by id, f)) as e from {n}_l)")
    ctes.append(f"{n} as materialized (select id, f, split, c, e / sum(e) over (partition by id, f) as p from {n}_e)")
    return ", ".join(ctes)


def sql_newton(source: str, cols: list[str], steps: int = 9, l2: float = 1.0) -> str:
    """CTEs ending in nw (f, mean, deviation and weights b0..): logistic regression of ``source``
    (fold, label, cols) without each fold, by ``steps`` Newton steps on one, two or three columns."""
    d = len(cols)
    z = [f"((s.{c} - m_{c}) / d_{c})" for c in cols]
    scale = ", ".join(f"avg({c}) as m_{c}, case when stddev_pop({c}) > 0 then stddev_pop({c}) else 1 end as d_{c}" for c in cols)
    ctes = [f"nw_s as materialized (select f, {scale} from folds join {source} on fold <> f group by f)"]
    ctes.append(f"nw_0 as (select *, {', '.join(f'0.0::double as b{i}' for i in range(d + 1))} from nw_s)")
    keep = ", ".join(f"m_{c}, d_{c}" for c in cols)
    one = ["1.0", *z]
    for t in range(steps):
        lin = " + ".join(f"b{i} * {v}" for i, v in enumerate(one))
        grad = ", ".join(f"sum({v} * (s.label - p)) - {0.0 if i == 0 else l2} * any_value(b{i}) as g{i}" for i, v in enumerate(one))
        hess = ", ".join(
            f"sum({a} * {b} * p * (1 - p)) + {l2 if i == j > 0 else 0.0} as h{i}{j}" for i, a in enumerate(one) for j, b in enumerate(one) if j >= i
        )
        b_any = ", ".join(f"any_value(b{i}) as b{i}" for i in range(d + 1))
        k_any = ", ".join(f"any_value(m_{c}) as m_{c}, any_value(d_{c}) as d_{c}" for c in cols)
        inner = f"select q.*, s.label, {', '.join(f's.{c}' for c in cols)}, 1 / (1 + exp(-({lin}))) as p from nw_{t} q join {source} s on s.fold <> q.f"
        ctes.append(f"nw_g{t} as materialized (select f, {k_any}, {b_any}, {grad}, {hess} from ({inner}) s group by f)")
        ctes.append(f"nw_{t + 1} as materialized (select f, {keep}, {_sql_solve(d + 1)} from nw_g{t})")
    ctes.append(f"nw as (select * from nw_{steps})")
    return ", ".join(ctes)


def _sql_solve(n: int) -> str:
    """b0.. plus the solution of h x = g for a symmetric h, by Cramer's rule (n up to 4)."""
    h = [[f"h{min(i, j)}{max(i, j)}" for j in range(n)] for i in range(n)]

    def det(m):
        if len(m) == 1:
            return m[0][0]
        minors = [f"{'-' if j % 2 else '+'} {m[0][j]} * ({det([r[:j] + r[j + 1:] for r in m[1:]])})" for j in range(len(m))]
        return " ".join(minors)

    swapped = lambda c: [[f"g{i}" if j == c else h[i][j] for j in range(n)] for i in range(n)]
    return ", ".join(f"b{c} + ({det(swapped(c))}) / ({det(h)}) as b{c}" for c in range(n))


def sql_newton_value(cols: list[str], row: str) -> str:
    lin = " + ".join([*[f"b{i + 1} * ({row}.{c} - m_{c}) / d_{c}" for i, c in enumerate(cols)], "b0"])
    return f"1 / (1 + exp(-({lin})))"


def sql_sweep(scores: str, step: float, n: int) -> str:
    """CTE th (t): first threshold from 0.3 with the highest accuracy of ``scores`` (label, s)."""
    return f"""th as (select case when acc > 0 then t else 0.5 end as t, acc from (
  select t, avg(case when cast(s >= t as int) = label then 1.0 else 0.0 end) as acc
  from {scores} cross join (select 0.3e0 + {step}e0 * cast(i as double) as t from range({n}) r(i)) group by t) order by acc desc, t limit 1)"""


# ---- binary: document quality ----------------------------------------------------------------------

DOC_COLS = ["lang", "source", "n_chars"]
DOC_FEATURES = ["source_te", "n_chars", "lang_code"]

#: tr and te of the documents: the target-encoded source, the length and the coded language.
SQL_DOCS = f"""f as ({X.SQL_TRAIN_DOCS_FOLDED}),
g as (select avg(quality::double) as gm from f),
s as (select source, fold, sum(quality::double) as s, count(*) as n from f group by source, fold),
tot as (select source, sum(s) as ts, sum(n) as tn from s group by source),
per as (select a.source, (a.ts - coalesce(s.s, 0) + 30.0 * gm) / (a.tn - coalesce(s.n, 0) + 30.0) as enc
  from (select *, unnest(range({K})) as fold from tot) a left join s on a.source = s.source and a.fold = s.fold cross join g),
tab as (select source, avg(enc) as enc from per group by source),
code as (select lang, row_number() over (order by lang) - 1 as code from (select distinct coalesce(lang, '__NA__') as lang from f)),
tr as materialized (select f.doc_id as id, f.fold, f.quality::double as label, (tot.ts - s.s + 30.0 * gm) / (tot.tn - s.n + 30.0) as source_te,
    f.n_chars::double as n_chars, code.code::double as lang_code
  from f join s on f.source = s.source and f.fold = s.fold join tot on f.source = tot.source cross join g join code on coalesce(f.lang, '__NA__') = code.lang),
te as materialized (select t.doc_id as id, coalesce(tab.enc, gm) as source_te, t.n_chars::double as n_chars, coalesce(code.code, -1)::double as lang_code
  from ({X.SQL_TEST_DOCS}) t left join tab on t.source = tab.source left join code on coalesce(t.lang, '__NA__') = code.lang cross join g)"""


def doc_tables(spark, d):
    train = X.train_docs(spark, d).select("doc_id", *DOC_COLS, "quality")
    return train, X.test_docs(spark, d)


_RIDGE_DOCS = f"""{_sql_ridge("tr", DOC_FEATURES)},
ridge as (select x.id, x.f, x.split, least(greatest({_sql_ridge_value(DOC_FEATURES)}, 0.0), 1.0) as p from x join g on x.f = g.f)"""


@register(
    "solve_binary",
    "M12 M7 M10 J6 D1 D3 D5 E5 E6 E9 I1 I2 I3 M2 F21 S5 S6",
    f"""with {SQL_DOCS.replace("g as (", "gmean as (").replace("cross join g", "cross join gmean")}, {FOLDS}, {sql_scored_rows(DOC_FEATURES)},
{sql_bayes("bayes", DOC_FEATURES, 16, 1.0, 2)}, {_RIDGE_DOCS},
both_scores as materialized (select b.id, b.split, b.bayes, r.ridge from (select id, split, avg(p) as bayes from bayes where c = 1 group by id, split) b
  join (select id, split, avg(p) as ridge from ridge group by id, split) r on b.id = r.id and b.split = r.split),
st as materialized (select b.*, tr.fold, tr.label from both_scores b join tr on b.id = tr.id where split = 'train'),
{sql_newton("st", ["bayes", "ridge"])},
oof as materialized (select st.id, st.label, {sql_newton_value(["bayes", "ridge"], "st")} as s from st join nw on st.fold = nw.f),
{sql_sweep("oof", 0.01, 41)},
scored as (select id, 'train' as split, s from oof union all
  select b.id, 'test', avg({sql_newton_value(["bayes", "ridge"], "b")}) from both_scores b cross join nw where b.split = 'test' group by b.id)
select id, split, round(s, 5) as score, case when split = 'test' then cast(cast(s >= t as int) as varchar) end as prediction, round(t, 6) as threshold
from scored cross join th""",
)
def q_solve_binary(spark, d):
    train, test = doc_tables(spark, d)
    learners = [("bayes", L.CountedBayes(16)), ("ridge", L.Ridge(1.0)), ("broken", None)]
    plan = S.fit_plan(train, "doc_id", "quality", DOC_COLS, learners, k=K)
    a = plan.oof.select("id", F.lit("train").alias("split"), F.round("score", 5).alias("score"), F.lit(None).cast("string").alias("prediction"))
    b = plan.apply(test).select("id", F.lit("test").alias("split"), F.round("score", 5).alias("score"), "prediction")
    return a.unionByName(b).withColumn("threshold", F.lit(round(plan.threshold, 6)))


#: The model of all rows leaves out a fold that no row has.
_WHOLE = sql_bayes("whole", DOC_FEATURES, 16, 1.0, 2).replace("from folds join", "from whole_f join").replace("from x cross", "from whole_rows cross")


@register(
    "threshold_pipeline",
    "D7 D2 D3 D5 M7 M14 I3 S4",
    f"""with {SQL_DOCS}, {FOLDS}, {sql_scored_rows(DOC_FEATURES)}, {sql_bayes("bayes", DOC_FEATURES, 16, 1.0, 2)},
whole_f as (select {K} as f), whole_rows as (select id, {K} as f, 'test' as split, {", ".join(DOC_FEATURES)} from te), {_WHOLE},
oof as materialized (select b.id, tr.label, b.p as s from bayes b join tr on b.id = tr.id where b.split = 'train' and c = 1),
{sql_sweep("oof", 0.005, 80)}
select id, round(p, 6) as score, cast(cast(p >= t as int) as varchar) as prediction, round(t, 6) as threshold, round(acc, 9) as oof_accuracy
from whole cross join th where c = 1""",
)
def q_threshold_pipeline(spark, d):
    """The scored test table is written as the predictions file (S4) and read back."""
    from tabforge.session import staged

    train, test = doc_tables(spark, d)
    plan = S.fit_threshold_plan(train, "doc_id", "quality", L.CountedBayes(16), DOC_COLS, K)
    out = staged(plan.apply(test).select("id", F.round("score", 6).alias("score"), "prediction"), "predictions")
    return out.withColumns({"threshold": F.lit(round(plan.threshold, 6)), "oof_accuracy": F.lit(round(plan.accuracy, 9))})


# ---- several classes: order status -----------------------------------------------------------------

ORDER_COLS = ["o_totalprice", "o_orderpriority", "o_custkey"]
ORDER_FEATURES = ["o_totalprice", "o_custkey", "prio"]
_PART = f"cast({X.sql_hash8('o_orderkey', 'part')} % 5 as int)"

SQL_ORDERS = f"""o as (select o_orderkey as id, o_orderstatus, o_totalprice::double as o_totalprice, o_custkey::double as o_custkey, o_orderpriority, {_PART} as part from orders),
cls as (select s, row_number() over (order by s) - 1 as c, original from (select lower(trim(o_orderstatus)) as s, min(o_orderstatus) as original from o where part <> 0 group by 1)),
code as (select v, row_number() over (order by v) - 1 as code from (select distinct o_orderpriority as v from o where part <> 0)),
tr as materialized (select id, cast((row_number() over (partition by cls.c order by md5(cast(id as varchar)), id) - 1) % {K} as int) as fold, cls.c::double as label,
    o_totalprice, o_custkey, code.code::double as prio
  from o join cls on lower(trim(o_orderstatus)) = cls.s join code on o_orderpriority = code.v where part <> 0),
te as materialized (select id, o_totalprice, o_custkey, coalesce(code.code, -1)::double as prio from o left join code on o_orderpriority = code.v where part = 0)"""


def order_tables(spark, d):
    o = X.table(spark, d, "orders").withColumn("part", F.pmod(hash_bucket("o_orderkey", "part"), F.lit(5)))
    cols = ["o_orderkey", *ORDER_COLS, "o_orderstatus"]
    return o.where("part <> 0").select(*cols), o.where("part = 0").select(*cols[:-1])


@register(
    "solve_multiclass",
    "M12 M8 D6 I1 I2 I3 M2 F21 S5 S6",
    f"""with {SQL_ORDERS}, {FOLDS}, {sql_scored_rows(ORDER_FEATURES)}, {sql_bayes("fine", ORDER_FEATURES, 16, 1.0, 3)}, {sql_bayes("rough", ORDER_FEATURES, 4, 0.5, 3)},
p as (select id, split, c, avg(p) as p from (select id, split, c, avg(p) as p from fine group by all union all select id, split, c, avg(p) from rough group by all) group by id, split, c)
select id, p.split, round(list(p.p order by p.c)[1], 6) as p0, round(list(p.p order by p.c)[2], 6) as p1, round(list(p.p order by p.c)[3], 6) as p2,
  case when p.split = 'test' then arg_max(cls.original, p.p) end as prediction
from p join cls on p.c = cls.c group by id, p.split""",
)
def q_solve_multiclass(spark, d):
    train, test = order_tables(spark, d)
    learners = [("fine", L.CountedBayes(16)), ("rough", L.CountedBayes(4, 0.5)), ("value", L.Ridge(1.0))]  # ridge fails: not a class learner
    plan = S.fit_plan(train, "o_orderkey", "o_orderstatus", ORDER_COLS, learners, L.MeanScore(), K)
    a = plan.oof.select("id", F.lit("train").alias("split"), "score", F.lit(None).cast("string").alias("prediction"))
    b = plan.apply(test).select("id", F.lit("test").alias("split"), "score", "prediction")
    return a.unionByName(b).select("id", "split", *[F.round(F.col("score")[i], 6).alias(f"p{i}") for i in range(3)], "prediction")


@register(
    "oof_multiclass_counted",
    "M8",
    f"""with {SQL_ORDERS}, {FOLDS}, {sql_scored_rows(ORDER_FEATURES)}, {sql_bayes("fine", ORDER_FEATURES, 16, 1.0, 3)}
select id, split, cast(c as int) as class, round(avg(p), 6) as probability from fine group by id, split, c""",
)
def q_oof_multiclass_counted(spark, d):
    """Per row and class the probability: train rows out of fold, test rows by the mean model."""
    train, test = order_tables(spark, d)
    task = S.fit_task(train, "o_orderkey", "o_orderstatus", ORDER_COLS, K, S.Engineer())
    models = L.CountedBayes(16).fit_folds(task.rows, MULTICLASS, task.n_classes, K)
    oof = models.held_out(task.rows).select("id", F.lit("train").alias("split"), "score")
    te = models.mean(task.features.rows(test)).select("id", F.lit("test").alias("split"), "score")
    return oof.unionByName(te).select("id", "split", F.posexplode("score").alias("class", "p")).select("id", "split", "class", F.round("p", 6).alias("probability"))


# ---- regression: order total -----------------------------------------------------------------------

def _sql_ridge_one(rows: str, c: str, tag: str) -> str:
    """CTE ``tag``: per left-out fold the ridge (alpha 1) of one standardised column."""
    return f"""{tag} as (select f, avg(label) as ybar, avg({c}) as mu, stddev_pop({c}) as sd,
  count(*) * covar_pop({c}, label) / stddev_pop({c}) / (count(*) + 1.0) as w from folds join {rows} r on r.fold <> f group by f)"""


@register(
    "solve_regression",
    "M12 M7 M11 I1 S5 S6 M1 F21",
    f"""with b as materialized ({SQL_ORDER_ROWS}), tr as (select * from b where part <> 0), te as (select * from b where part = 0), {FOLDS}, {sql_scored_rows(COLS)},
{_sql_ridge("tr", COLS)}, {_sql_ridge_one("tr", "sum_qty", "h")},
sc as materialized (select x.id, x.split, avg({_sql_ridge_value(COLS).replace("ybar", "g.ybar")}) as r3, avg(h.ybar + h.w * (x.sum_qty - h.mu) / h.sd) as r1
  from x join g on x.f = g.f join h on x.f = h.f group by x.id, x.split),
st as materialized (select sc.*, tr.fold, tr.label from sc join tr on sc.id = tr.id where split = 'train'),
m0 as (select f, count(*) as n, avg(label) as ybar, avg(r3) as mu3, stddev_pop(r3) as sd3, avg(r1) as mu1, stddev_pop(r1) as sd1,
  covar_pop(r3, label) as c3, covar_pop(r1, label) as c1, covar_pop(r3, r1) as c31 from folds join st on st.fold <> f group by f),
m1 as (select *, n + 1.0 as a, n * c31 / (sd3 * sd1) as q, n * c3 / sd3 as u, n * c1 / sd1 as v from m0),
m as (select *, (u * a - q * v) / (a * a - q * q) as w3, (a * v - q * u) / (a * a - q * q) as w1 from m1)
select st.id, 'train' as split, round(ybar + w3 * (r3 - mu3) / sd3 + w1 * (r1 - mu1) / sd1, 5) as prediction from st join m on st.fold = m.f
union all select sc.id, 'test', round(avg(ybar + w3 * (r3 - mu3) / sd3 + w1 * (r1 - mu1) / sd1), 5) from sc cross join m where sc.split = 'test' group by sc.id""",
)
def q_solve_regression(spark, d):
    rows = order_rows(spark, d)
    train = rows.where("part <> 0").select("id", *COLS, "label")
    test = rows.where("part = 0").select("id", *COLS)
    learners = [("r3", L.Ridge(1.0)), ("r1", L.Ridge(1.0, [COLS.index("sum_qty")])), ("classes", L.CountedBayes())]  # the last fails: no classes
    plan = S.fit_plan(train, "id", "label", COLS, learners, k=K)
    a = plan.oof.select("id", F.lit("train").alias("split"), F.round("score", 5).alias("prediction"))
    return a.unionByName(plan.apply(test).select("id", F.lit("test").alias("split"), F.round("prediction", 5).alias("prediction")))


# ---- the meta learner alone ------------------------------------------------------------------------

_M = ["m1", "m2", "m3"]
_STACK_COLS = ", ".join([*[f"{X.sql_hash8('doc_id', c)} / 4294967296.0 as {c}" for c in _M[:2]], "n_chars / 1000.0 as m3"])


@register(
    "meta_logistic_newton",
    "M10 E4 A1",
    f"""with tr as materialized (select doc_id as id, fold, quality::double as label, {_STACK_COLS} from ({X.SQL_TRAIN_DOCS_FOLDED})),
te as (select doc_id as id, {_STACK_COLS} from ({X.SQL_TEST_DOCS})), {FOLDS}, {sql_newton("tr", _M)}
select tr.id, 'train' as split, round({sql_newton_value(_M, "tr")}, 6) as p from tr join nw on tr.fold = nw.f
union all select te.id, 'test', round(avg({sql_newton_value(_M, "te")}), 6) from te cross join nw group by te.id""",
)
def q_meta_logistic_newton(spark, d):
    from tabforge.session import cut_lineage

    tr, te, cols = _pseudo_stack(spark, d)
    rows = cut_lineage(tr.select("id", "fold", "label", F.array(*cols).alias("features")))
    models = L.NewtonLogistic(1.0).fit_folds(rows, "BINARY", 2, K)
    a = models.held_out(rows).select("id", F.lit("train").alias("split"), F.round("score", 6).alias("p"))
    b = models.mean(te.select("id", F.array(*cols).alias("features"))).select("id", F.lit("test").alias("split"), F.round("score", 6).alias("p"))
    return a.unionByName(b)
