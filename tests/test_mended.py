"""Distinct states, split folds, final blends, true/false columns, hints, declared records, staged fits."""

import random

import pytest
from pyspark.sql import functions as F

from tabforge.operators import blend as B
from tabforge.operators import encode as E
from tabforge.operators import features as FE
from tabforge.operators import infer as I
from tabforge.operators import textops as TO
from tabforge.operators.distinct import EXACT, distinct_counts
from tabforge.operators.folds import assign_stratified_folds


def test_distinct_counts_are_exact_below_and_beyond_the_state(spark):
    n = 3 * EXACT
    df = spark.range(n).select(
        F.col("id").cast("string").alias("unique"), (F.col("id") % 7).alias("few"), F.when(F.col("id") % 2 == 0, F.lit("")).alias("empty"),
        F.lit(None).cast("string").alias("none"), (F.col("id") % (EXACT + 5)).alias("just_over"),
    )
    counts, r = distinct_counts(df, {c: F.col(c) for c in df.columns}, [F.count(F.lit(1)).alias("rows")])
    assert counts == {"unique": n, "few": 7, "empty": 1, "none": 0, "just_over": EXACT + 5} and r["rows"] == n
    estimates, _ = distinct_counts(df, {"unique": F.col("unique")}, exact_from=10 * n)
    assert abs(estimates["unique"] - n) < 0.1 * n


def test_distinct_states_expand_no_rows_and_shuffle_no_values(spark):
    df = spark.createDataFrame([("a" * 1000, "b")], "x string, y string")
    states = df.agg(*[F.theta_sketch_estimate(F.theta_sketch_agg(F.xxhash64(c), 12)).alias(c) for c in df.columns])
    plan = states._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan and plan.count("Exchange") == 1 and "hashpartitioning" not in plan
    tasks = I.detect_tasks(spark.range(40).select((F.col("id") % 2).alias("a"), F.col("id").alias("b"), (F.col("id") % 5).cast("string").alias("c")), {c: F.col(c) for c in "abc"})
    assert [(r["target"], r["task"], r["n_distinct"]) for r in tasks.collect()] == [("a", "BINARY", 2), ("b", "REGRESSION", 40), ("c", "MULTICLASS", 5)]


def test_split_folds_equal_the_window_and_balance_a_repeated_id(spark):
    df = spark.range(500).select("id", (F.col("id") % 3).alias("y"))
    want = {r["id"]: r["fold"] for r in assign_stratified_folds(df, 5, "id", "y").collect()}
    assert {r["id"]: r["fold"] for r in assign_stratified_folds(df, 5, "id", "y", split_rows=1).collect()} == want
    hot = spark.range(3000).select(F.when(F.col("id") < 1000, F.lit(7)).otherwise(F.col("id")).alias("id"), (F.col("id") % 2).alias("y"))
    folds = assign_stratified_folds(hot, 5, "id", "y", split_rows=100)
    assert folds.columns == ["id", "y", "fold"]
    sizes = [r["count"] for r in folds.groupBy("y", "fold").count().collect()]
    assert len(sizes) == 10 and max(sizes) - min(sizes) <= 1


def test_final_predictions_fall_back(spark):
    table = lambda v: spark.createDataFrame([(1, v), (2, v)], "id long, p string")
    out, how = B.final_predictions({"stacked": table("True"), "threshold": table("False"), "generated": table("False")}, "id", "p")
    assert how == "blend" and {r["prediction"] for r in out.collect()} == {"False"}  # 2.0 of 4.5
    out, how = B.final_predictions({"stacked": None, "plain": table("1")}, "id", "p")
    assert how == "plain" and out.count() == 2
    broken = table("True").select("id", F.raise_error(F.lit("gone")).cast("string").alias("p"))
    out, how = B.final_predictions({"stacked": table("True"), "generated": broken}, "id", "p")
    assert how.startswith("stacked: the blend failed") and {r["prediction"] for r in out.collect()} == {"True"}
    assert B.final_predictions({}, "id", "p", table("0"))[1] == "last resort"
    assert B.final_predictions({}, "id", "p") == (None, "none")


def test_weights_of_the_caller_save_the_job_and_change_nothing(spark):
    tables = [(m, spark.createDataFrame([(i, str(v)) for i, v in enumerate(vs)], "id long, p string"), w) for m, vs, w in (("a", [1, 0, 1], 2.0), ("b", [0, 0, 1], 1.5), ("c", [0, 1], 1.0))]
    long = B.stack_predictions(tables, "id", "p")
    assert sorted(map(tuple, B.weighted_vote(long).collect())) == sorted(map(tuple, B.weighted_vote(long, None, [2.0, 1.5, 1.0]).collect()))


def test_domain_features_flag_every_true_false_column(spark):
    rows = [("1_1", "True", None, True, "yes", 3.0), ("1_2", "false", None, None, "True", 0.0)]
    df = spark.createDataFrame(rows, "pid string, a string, b string, c boolean, d string, m double")
    spec = FE.DomainSpec(id_col="pid", measure_cols=("m",), flag_col="a", inconsistency_name="a_spends")
    out = FE.apply_domain(df, spec, FE.fit_domain(df, spec)).collect()
    assert [(r["a_int"], r["b_int"], r["c_int"], r["a_spends"]) for r in out] == [(1, -1, 1, 1), (0, -1, -1, 0)]
    assert "d_int" not in out[0].asDict()


def test_hint_of_a_group_prefix(spark):
    df = spark.createDataFrame([("0001_01", "x")], "pid string, t string")
    hints = {r["column"]: r["hint"] for r in I.feature_hints(df, ["t"], [], "pid").collect()}
    assert hints["pid"] == "group prefix before _ of 0001_01"
    assert not I.feature_hints(df.withColumn("pid", F.lit("7")), ["t"], [], "pid").collect()


RULES = [
    TO.FieldRule("kind", ("text",), among=("task", "message")), TO.FieldRule("size", ("integer",), low=1, high=9), TO.FieldRule("share", ("number",), required=False),
    TO.FieldRule("status.state", ("text",), required=False), TO.FieldRule("parts", ("array",), required=False, min_items=1), TO.FieldRule("ok", ("boolean",), required=False),
]


@pytest.mark.parametrize(("text", "errors"), [
    ('{"kind": "task", "size": 3, "share": 0.5, "status": {"state": "on"}, "parts": [1], "ok": true}', []),
    ('{"kind": "other", "size": 12}', ["kind: not one of task, message", "size: above 9"]),
    ('{"kind": 5, "size": 0.5, "share": "x", "parts": [], "ok": "true"}', ["kind: not text", "kind: not one of task, message", "size: not integer", "size: below 1", "share: not number", "parts: fewer than 1 items", "ok: not boolean"]),
    ('{"kind": "task", "size": null}', ["size: missing"]),
    ("[1, 2]", ["not a JSON object"]), ("no json", ["not a JSON object"]), (None, ["not a JSON object"]),
])
def test_declared_records(spark, text, errors):
    r = TO.check_records(spark.createDataFrame([(text,)], "j string"), "j", RULES).first()
    assert r["errors"] == errors and r["n_errors"] == len(errors) and r["valid"] == int(not errors)


def test_fits_are_staged_once_for_all_columns(spark, monkeypatch):
    rng = random.Random(2)
    df = spark.createDataFrame([(i, i % 4, i % 2, *(rng.choice("xyz") for _ in range(6))) for i in range(80)], "id long, fold int, y int, a string, b string, c string, d string, e string, f string")
    made = []
    real = E.fitted_table
    monkeypatch.setattr(E, "fitted_table", lambda t: made.append(1) or real(t))
    cols = list("abcdef")
    te = E.fit_target_encoding(df, cols, "y", "fold", 4)
    oof, test = E.apply_target_encoding_oof(df, te, suffix="_t"), E.apply_target_encoding_test(df, te, suffix="_t")
    coded = E.apply_ordinal(df, E.fit_ordinal(df, cols), cols, "_code")
    assert len(made) == 3 and oof.count() == test.count() == coded.count() == 80
    assert {r["a_code"] for r in coded.collect()} == {0, 1, 2}
