"""Queries for CV, models, tuning and stacking.

The boosters run at the reference's rounds (``models.BASE_BOOST``, ``models.TOURNAMENT_BOOST``, the
small booster of ``quick_cv``), all folds and learners in lock-step. Boosters and forests have no
SQL twin: ``tests/test_boost.py`` holds them against a plain version, and ``q_closed`` and
``q_solve`` check the same paths with learners that SQL can state. Rows are never reduced.
"""

from __future__ import annotations

from functools import reduce

from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from tabforge.operators import encode as E
from tabforge.operators.features import keep_if_better
from tabforge.operators.folds import assign_folds, assign_stratified_folds
from tabforge.operators.infer import BINARY, MULTICLASS, REGRESSION, label_table
from tabforge.plans import fixtures as X
from tabforge.plans import learners as L
from tabforge.plans import models as M
from tabforge.plans import solve as S
from tabforge.plans import tuning as T
from tabforge.plans.boost import HistBoost, fit_boosters
from tabforge.plans.catalog import register

K = X.K
FOREST = M.BASE_PARAMS["forest"]
#: The small booster of feature comparisons (M5).
SMALL = HistBoost(rounds=100, depth=5, rate=0.1)


def doc_frame(spark, d):
    """documents with text-derived counts over the whole text (JVM-side regex)."""
    docs = X.table(spark, d, "documents")
    return docs.select(
        "doc_id",
        "lang",
        "source",
        "n_chars",
        F.regexp_count("text", F.lit(r"\S+")).cast("double").alias("n_words"),
        (F.regexp_count("text", F.lit("\n")) + 1).cast("double").alias("n_lines"),
    )


def doc_data(spark, d, feats=("lang", "source", "n_chars", "n_words", "n_lines"), target_encode=True):
    """Binary task: labelled docs are train (stratified folds), the rest test;
    ``source`` (20 values) is target-encoded out of fold, as the reference does
    for categorical columns with more than 5 values."""
    base = doc_frame(spark, d)
    lab = X.table(spark, d, "labels")
    train = assign_stratified_folds(base.join(lab, "doc_id"), K, "doc_id", "quality").persist(StorageLevel.MEMORY_AND_DISK)
    test = base.join(lab, "doc_id", "left_anti")
    enc, te = [], None
    if target_encode and "source" in feats:
        te = E.fit_target_encoding(train, ["source"], "quality", "fold", K)
        train = E.apply_target_encoding_oof(train, te, "fold")
        test = E.apply_target_encoding_test(test, te)
        enc = ["source"]
    data = M.prepare_model_data(train, test, "doc_id", "quality", "fold", list(feats), BINARY, enc)
    if te is not None:
        te.release()  # the persisted vectors are materialised; lineage still recomputes if needed
    return data


def _finish(df, *datas):
    """Materialise a model query's (small) result in the checkpoint folder and
    release the persisted vectors it was computed from."""
    from tabforge.session import cut_lineage

    out = cut_lineage(df)
    for d_ in datas:
        d_.release()
    return out


@register("fit_score", "M3")
def q_fit_score(spark, d):
    data = doc_data(spark, d)
    models = SMALL.fit_folds(data.train, BINARY, 2, K)
    scored = models.held_out(data.train.where("fold = 0"))
    return _finish(scored.select("id", "fold", "score", (F.col("score") >= 0.5).cast("double").alias("prediction")), data)


@register("cross_validate", "M4 A6")
def q_cross_validate(spark, d):
    data = doc_data(spark, d)
    scores, _ = T.cv_scores([("gbt", SMALL)], data.train, BINARY, 2, K)
    data.release()
    return spark.createDataFrame([("gbt", i, float(s)) for i, s in enumerate(scores["gbt"])], "model string, fold int, score double")


@register("quick_cv", "M5")
def q_quick_cv(spark, d):
    data = doc_data(spark, d)
    s, error = M.quick_cv(data)
    data.release()
    return spark.createDataFrame([(data.task, s, error)], "task string, score double, error string")


@register("model_tournament", "M6")
def q_model_tournament(spark, d):
    """The reference's four candidates: three boosters in lock-step and a deep forest."""
    data = doc_data(spark, d)
    boosters = [(name, HistBoost(**p)) for name, p in M.TOURNAMENT_BOOST.items()]
    forest = L.MllibLearner(lambda: M.make_estimator("forest", BINARY, M.TOURNAMENT_FOREST))
    return _finish(M.learner_tournament([*boosters, ("forest", forest)], data, K), data)


@register("oof_predict", "M7")
def q_oof_predict(spark, d):
    data = doc_data(spark, d)
    models = SMALL.fit_folds(data.train, BINARY, 2, K)
    oof = models.held_out(data.train).select("id", "fold", F.lit("gbt").alias("model"), "score", F.lit("train").alias("split"))
    te = models.mean(data.test).select("id", F.lit(None).cast("int").alias("fold"), F.lit("gbt").alias("model"), "score", F.lit("test").alias("split"))
    return _finish(oof.unionByName(te), data)


def emb_data(spark, d):
    """Multi-class task: embeddings (10 classes); rows with a hashed fold 0 are
    the test part, the rest train with stratified folds."""
    e = X.table(spark, d, "embeddings").select("vec_id", array_to_vector("embedding").alias("features"), F.col("label").cast("double").alias("label"))
    e = assign_folds(e, 5, "vec_id", "part")
    train = assign_stratified_folds(e.where("part <> 0"), K, "vec_id", "label")
    tr = train.select(F.col("vec_id").alias("id"), "fold", "label", "features").cache()
    te = e.where("part = 0").select(F.col("vec_id").alias("id"), "features").cache()
    return M.ModelData(tr, te, MULTICLASS, 10, ["embedding"])


@register("oof_predict_multiclass", "M8 D6")
def q_oof_multiclass(spark, d):
    from tabforge.operators.decide import argmax_class

    data = emb_data(spark, d)
    oof, te = M.oof_predict("logistic", lambda: M.make_estimator("logistic", MULTICLASS), data, K)
    both = oof.withColumn("split", F.lit("train")).unionByName(te.withColumn("fold", F.lit(None).cast("int")).withColumn("split", F.lit("test")))
    return _finish(both.select("id", "fold", "split", argmax_class("score").alias("predicted"), F.array_max("score").alias("max_proba")), data)


@register("base_models", "M9")
def q_base_models(spark, d):
    """Accuracy on the training rows (model of all rows) and out of fold of the four base learners."""
    data = doc_data(spark, d)
    learners = S.default_learners(BINARY)
    models = fit_boosters([x for _, x in learners], data.train, BINARY, 2, K)
    asked = [(f"{name}_{out}", m, how) for (name, _), m in zip(learners, models, strict=True) for out, how in (("oof", "held_out"), ("fit", "refit"))]
    scored = L.score_all(data.train, asked)
    hit = lambda c: F.avg(((F.col(c) >= 0.5).cast("int") == F.col("label")).cast("double"))
    r = scored.agg(*[hit(f"{name}_{how}").alias(f"{name}_{how}") for name, _ in learners for how in ("fit", "oof")]).first()
    data.release()
    rows = [(name, x.rounds, r[f"{name}_fit"], r[f"{name}_oof"]) for name, x in learners]
    return spark.createDataFrame(rows, "model string, rounds int, train_accuracy double, oof_accuracy double")


def _pseudo_stack(spark, d):
    """Stacked base scores: three md5-derived scores per labelled doc plus the
    doc's length rank, with the stratified folds of the train docs."""
    from tabforge.functions.scalar import hash_bucket

    f = X.train_docs_folded(spark, d)
    cols = ["m1", "m2", "m3"]
    tr = f.select(
        F.col("doc_id").alias("id"), "fold", F.col("quality").cast("double").alias("label"),
        *[(hash_bucket("doc_id", c) / F.lit(4294967296.0)).alias(c) for c in cols[:2]],
        (F.col("n_chars") / F.lit(1000.0)).alias("m3"),
    )
    te = X.test_docs(spark, d).select(
        F.col("doc_id").alias("id"), *[(hash_bucket("doc_id", c) / F.lit(4294967296.0)).alias(c) for c in cols[:2]],
        (F.col("n_chars") / F.lit(1000.0)).alias("m3"),
    )
    return tr, te, cols


@register("meta_logistic", "M10 E4")
def q_meta_logistic(spark, d):
    tr, te, cols = _pseudo_stack(spark, d)
    oof, tst = M.meta_logistic(tr, te, cols, K)
    a = oof.select("id", F.col("proba")[1].alias("p"), F.lit("train").alias("split"))
    b = tst.select("id", F.col("proba")[1].alias("p"), F.lit("test").alias("split"))
    return _finish(a.unionByName(b))


def order_reg(spark, d):
    """Regression task: order total from line counts and quantities."""
    li = X.table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.count(F.lit(1)).cast("double").alias("n_lines"), F.sum("l_quantity").alias("sum_qty"), F.avg("l_extendedprice").alias("avg_price")
    )
    o = X.table(spark, d, "orders").join(li, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return assign_folds(o, K, "o_orderkey")


@register("stacking", "M12 J6 M7 M9 M10 D1 D3 D5 I2 I3")
def q_stacking(spark, d):
    """The whole plan with the four default learners on all documents' features."""
    base, lab = doc_frame(spark, d), X.table(spark, d, "labels").select("doc_id", "quality")
    plan = S.fit_plan(base.join(lab, "doc_id"), "doc_id", "quality", ["lang", "source", "n_chars", "n_words", "n_lines"], k=K)
    return _finish(plan.apply(base.join(lab, "doc_id", "left_anti")).select("id", "prediction"))


@register("stacking_regression", "M12 M11 M9")
def q_stacking_regression(spark, d):
    o = order_reg(spark, d)
    feats = ["n_lines", "sum_qty", "avg_price", "o_orderpriority", "o_orderstatus"]
    train, test = o.where("fold <> 0"), o.where("fold = 0")
    plan = S.fit_plan(train, "o_orderkey", "o_totalprice", feats, k=K, kind=REGRESSION)
    return _finish(plan.apply(test).select("id", "prediction"))


@register("tune", "M13")
def q_tune(spark, d):
    """100 trials of the counted learner; the trial table, stored (checkpointed)."""
    train = X.train_docs(spark, d).select("doc_id", "lang", "source", "n_chars", "quality")
    task = S.fit_task(train, "doc_id", "quality", ["lang", "source", "n_chars"], K, S.Engineer())
    space = {"bins": (2, 64, "int"), "add": (0.01, 30.0, "log")}
    return _finish(T.tune(lambda p: L.CountedBayes(int(p["bins"]), p["add"]), space, task.rows, BINARY, 2, K, n_trials=100))


@register("fit_final", "M14 I3")
def q_fit_final(spark, d):
    from tabforge.operators.infer import decode_predictions

    data = doc_data(spark, d)
    pred = M.fit_final("forest", FOREST, data)
    labels = label_table(X.table(spark, d, "labels"), "quality")
    return _finish(decode_predictions(pred, "code", labels, "prediction").select("id", "prediction"), data)


@register("threshold_solve", "D7 D2 M14")
def q_threshold_solve(spark, d):
    data = doc_data(spark, d)
    labels = label_table(X.table(spark, d, "labels"), "quality")
    pred, t, acc = M.threshold_solve("forest", FOREST, data, K, labels)
    return _finish(pred.withColumn("threshold", F.lit(t)).withColumn("oof_accuracy", F.lit(acc)), data)


@register("keep_if_better", "F24 M5")
def q_keep_if_better(spark, d):
    base = doc_data(spark, d, feats=("lang", "n_chars"), target_encode=False)
    rich = doc_data(spark, d)
    rows = [("baseline", M.quick_cv(base)[0], True), ("text_counts", M.quick_cv(rich)[0], False)]
    base.release()
    rich.release()
    return keep_if_better(spark.createDataFrame(rows, "name string, score double, is_baseline boolean"))


_SQL_COUNTS = r"""select doc_id, lang, source, n_chars, cast(len(regexp_extract_all(text, '[^ \t\n\x0B\f\r]+')) as double) as n_words,
  cast(length(text) - length(replace(text, chr(10), '')) + 1 as double) as n_lines from documents"""
_SQL_NUM = ["n_chars", "n_words", "n_lines"]


@register(
    "prepare_features",
    "E9 E8 E1 E2 E3 E7 E5 E6",
    f"""with f as ({X.SQL_TRAIN_DOCS_FOLDED}), w as ({_SQL_COUNTS}),
g as (select avg(quality::double) as gm from f),
s as (select source, fold, sum(quality::double) as s, count(*) as n from f group by source, fold),
tot as (select source, sum(s) as ts, sum(n) as tn from s group by source),
per as (select x.source, (x.ts - coalesce(s.s, 0) + 30.0 * gm) / (x.tn - coalesce(s.n, 0) + 30.0) as enc
  from (select *, unnest(range({K})) as fold from tot) x left join s on x.source = s.source and x.fold = s.fold cross join g),
tab as (select source, avg(enc) as enc from per group by source),
code as (select lang, row_number() over (order by lang) - 1 as code from (select distinct coalesce(lang, '__NA__') as lang from f)),
med as (select {", ".join(f"median(w.{c}::double) as m_{c}" for c in _SQL_NUM)} from f join w using (doc_id)),
rows as (
  select f.doc_id, f.fold, f.quality::double as label, 'train' as split, (tot.ts - s.s + 30.0 * gm) / (tot.tn - s.n + 30.0) as te
  from f join s on f.source = s.source and f.fold = s.fold join tot on f.source = tot.source cross join g
  union all
  select t.doc_id, null, null, 'test', coalesce(tab.enc, gm) from ({X.SQL_TEST_DOCS}) t left join tab on t.source = tab.source cross join g)
select rows.doc_id as id, fold, label, split, round(te, 9) as source, {", ".join(f"coalesce(w.{c}::double, m_{c}) as {c}" for c in _SQL_NUM)},
  coalesce(code.code, -1)::double as lang_code
from rows join w using (doc_id) cross join med left join code on coalesce(w.lang, '__NA__') = code.lang""",
)
def q_prepare_features(spark, d):
    """Impute, encode and assemble train and test once (the vector table every model query
    starts from), read back from the assembled vectors."""
    data = doc_data(spark, d)
    v = vector_to_array("features")
    cols = [F.round(v[i], 9).alias(c) for i, c in enumerate(data.feature_cols)]
    a = data.train.select("id", "fold", "label", F.lit("train").alias("split"), *cols)
    b = data.test.select("id", F.lit(None).cast("int").alias("fold"), F.lit(None).cast("double").alias("label"), F.lit("test").alias("split"), *cols)
    return _finish(a.unionByName(b), data)
