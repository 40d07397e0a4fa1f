"""Edge cases and properties of the operators on hand-made frames (values worked out
from the rules), brute-force comparisons, and plan checks."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabforge.functions import scalar as S
from tabforge.functions import text as T
from tabforge.operators import blend as B
from tabforge.operators import decide as D
from tabforge.operators import encode as E
from tabforge.operators import features as FE
from tabforge.operators import folds as FO
from tabforge.operators import grade as G
from tabforge.operators import infer as I
from tabforge.operators import profile as P
from tabforge.operators import quantile as Q
from tabforge.operators import textops as TO


def col(df, c):
    return [r[c] for r in df.collect()]


# ----------------------------------------------------------------------------- bins


def test_equal_width_bins_match_pandas_rule(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,), (11.0,), (None,)], "x double")
    lo, hi = FE.fit_equal_width(df, "x")
    out = col(df.select(S.bin_equal_width("x", lo, hi, 10).alias("b")), "b")
    assert out == [0, 0, 1, 2, 9, None]
    ref = pd.cut(pd.Series([1.0, 2.0, 3.0, 4.0, 11.0]), bins=10, labels=False).tolist()
    assert out[:5] == ref


def test_equal_width_constant_column_is_middle_bin(spark):
    df = spark.createDataFrame([(5.0,), (5.0,)], "x double")
    lo, hi = FE.fit_equal_width(df, "x")
    assert col(df.select(S.bin_equal_width("x", lo, hi, 10).alias("b")), "b") == [4, 4]
    assert pd.cut(pd.Series([5.0, 5.0]), bins=10, labels=False).tolist() == [4, 4]


def test_explicit_edges_right_closed(spark):
    df = spark.createDataFrame([(0.0,), (12.0,), (12.5,), (200.0,), (201.0,), (None,)], "x double")
    assert col(df.select(S.bin_edges("x").alias("b")), "b") == [None, 0, 1, 4, None, None]


# ----------------------------------------------------------------------------- profile


def test_skew_matches_pandas_and_constant_is_zero(spark):
    vals = [1.0, 2.0, 2.0, 3.0, 10.0, None]
    df = spark.createDataFrame([(v, 7.0) for v in vals], "x double, c double")
    r = {row["column"]: row for row in P.profile_numeric(df, ["x", "c"]).collect()}
    assert math.isclose(r["x"]["skew"], pd.Series(vals).skew(), rel_tol=1e-12)
    assert r["c"]["skew"] == 0.0
    assert r["x"]["n_null"] == 1
    assert math.isclose(r["x"]["std"], pd.Series(vals).std(), rel_tol=1e-12)


def test_corr_of_constant_is_null_not_error(spark):
    df = spark.createDataFrame([(1.0, 0), (1.0, 1), (1.0, 1)], "x double, y int")
    assert P.corr_numeric(df, ["x"], "y").count() == 0


def test_onehot_corr_matches_pandas(spark):
    rows = [("a", 1), ("b", 0), ("a", 1), ("c", 0), ("a", 0), ("b", 1), (None, 1)]
    df = spark.createDataFrame(rows, "c string, y int")
    got = {r["feature"]: r["abs_r"] for r in P.corr_onehot(df, ["c"], "y").collect()}
    pdf = pd.DataFrame(rows, columns=["c", "y"])
    for v in ("a", "b"):
        ref = abs((pdf["c"] == v).astype(float).corr(pdf["y"].astype(float)))
        assert math.isclose(got[f"c=={v}"], ref, rel_tol=1e-9)


def test_top_k_ties_by_value(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("c",), (None,)], "v string")
    r = P.profile_categorical(df, ["v"], 2).orderBy("rank").collect()
    assert [(x["value"], x["n"]) for x in r] == [("c", 2), ("a", 1)]
    assert r[0]["n_distinct"] == 3 and r[0]["n_null"] == 1


def test_group_size_stats(spark):
    df = spark.createDataFrame([(1,), (1,), (2,), (3,), (3,), (3,)], "g int")
    r = P.group_size_stats(df, "g").first()
    assert math.isclose(r["mean_size"], (2 * 2 + 1 + 3 * 3) / 6)
    assert r["max_size"] == 3 and math.isclose(r["solo_share"], 1 / 6)


# ----------------------------------------------------------------------------- medians


@pytest.mark.parametrize("n", [1, 2, 7, 10, 501])
def test_exact_median_matches_numpy(spark, n):
    rng = random.Random(n)
    xs = [float(rng.randint(0, 50)) for _ in range(n)]
    df = spark.createDataFrame([(x, None if i % 3 == 0 else x * 2, float("nan") if i == 1 else x) for i, x in enumerate(xs)], "a double, b double, c double")
    med = Q.exact_medians(df, ["a", "b", "c"])
    assert med["a"] == float(np.median(xs))
    bs = [x * 2 for i, x in enumerate(xs) if i % 3 != 0]
    assert med["b"] == (float(np.median(bs)) if bs else None)
    cs = [x for i, x in enumerate(xs) if i != 1]
    assert med["c"] == (float(np.median(cs)) if cs else None)


def test_impute_median_drops_all_null_column(spark):
    df = spark.createDataFrame([(1.0, None), (None, None), (3.0, None)], "a double, z double")
    med = E.fit_medians(df, ["a", "z"])
    out = E.apply_impute_median(df, med)
    assert out.columns == ["a"] and col(out, "a") == [1.0, 2.0, 3.0]


# ----------------------------------------------------------------------------- inference


@pytest.mark.parametrize(
    "values,task",
    [
        (["True", "False", "True"], I.BINARY),
        (["yes", "no", "yes"], I.BINARY),
        ([" A ", "b", "c"], I.MULTICLASS),
        ([str(i) for i in range(26)], I.REGRESSION),
        (["1", "2", "3"] * 32 + ["x", "y", "z", "w"], I.MULTICLASS),
        (["true", "false", None], I.MULTICLASS),
    ],
)
def test_detect_task(spark, values, task):
    df = spark.createDataFrame([(v,) for v in values], "y string")
    assert I.detect_task(df, "y").first()["task"] == task


def test_encode_decode_round_trip(spark):
    df = spark.createDataFrame([("Yes",), ("no",), ("YES",), ("No",)], "y string")
    lt = I.label_table(df, "y")
    assert {r["label"]: r["code"] for r in lt.collect()} == {"no": 0, "yes": 1}
    pred = spark.createDataFrame([(0,), (1,), (7,)], "code int")
    out = col(I.decode_predictions(pred, "code", lt, "label").orderBy("code"), "label")
    assert out == ["No", "YES", "7"]


# ----------------------------------------------------------------------------- folds


def test_stratified_folds_balanced_disjoint_and_equal_to_global_rank(spark):
    rows = [(i, "a" if i % 3 else "b") for i in range(1, 400)]
    df = spark.createDataFrame(rows, "id long, y string")
    got = FO.assign_stratified_folds(df, 5, "id", "y", digits=1).toPandas()
    assert len(got) == len(rows) and got["id"].is_unique
    counts = got.groupby(["y", "fold"]).size().unstack()
    assert (counts.max(axis=1) - counts.min(axis=1)).max() <= 1
    import hashlib

    pdf = pd.DataFrame(rows, columns=["id", "y"])
    pdf["h"] = pdf["id"].map(lambda i: hashlib.md5(str(i).encode()).hexdigest())
    pdf = pdf.sort_values(["y", "h", "id"])
    pdf["fold"] = pdf.groupby("y").cumcount() % 5
    assert dict(zip(pdf["id"], pdf["fold"])) == dict(zip(got["id"], got["fold"]))


def test_plain_folds_disjoint_near_equal(spark):
    df = spark.range(5000).withColumnRenamed("id", "k")
    f = FO.assign_folds(df, 5, "k").groupBy("fold").count().toPandas()
    assert len(f) == 5 and f["count"].sum() == 5000 and f["count"].min() > 900


# ----------------------------------------------------------------------------- target encoding


def test_target_encoding_oof_equals_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice("abcde") if i % 11 else None, rng.randint(0, 1), i % 5) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, c string, y int, fold int")
    te = E.fit_target_encoding(df, ["c"], "y", "fold", 5)
    got = {r["id"]: r["c_te"] for r in E.apply_target_encoding_oof(df, te, "fold", "_te").collect()}
    pdf = pd.DataFrame(rows, columns=["id", "c", "y", "fold"])
    pdf["c"] = pdf["c"].astype(str)
    g = pdf["y"].mean()
    for f in range(5):
        tr, va = pdf[pdf.fold != f], pdf[pdf.fold == f]
        st = tr.groupby("c")["y"].agg(["sum", "count"])
        enc = (st["sum"] + 30 * g) / (st["count"] + 30)
        for i, c in zip(va["id"], va["c"]):
            assert math.isclose(got[i], enc.get(c, g), rel_tol=1e-12)
    # test side: mean of the fold encodings, unseen -> global mean
    test = spark.createDataFrame([(1, "a"), (2, "zz")], "id long, c string")
    tt = {r["id"]: r["c_te"] for r in E.apply_target_encoding_test(test, te, "_te").collect()}
    per = []
    for f in range(5):
        tr = pdf[pdf.fold != f]
        st = tr.groupby("c")["y"].agg(["sum", "count"])
        per.append(((st["sum"] + 30 * g) / (st["count"] + 30)).get("a", g))
    assert math.isclose(tt[1], sum(per) / 5, rel_tol=1e-12) and math.isclose(tt[2], g)


def test_ordinal_unseen_is_minus_one(spark):
    tr = spark.createDataFrame([("b",), ("a",), (None,)], "c string")
    codes = E.fit_ordinal(E.impute_constant(tr, ["c"]), ["c"])
    te = E.impute_constant(spark.createDataFrame([("a",), ("q",), (None,)], "c string"), ["c"])
    assert col(E.apply_ordinal(te, codes, ["c"]), "c") == [1, -1, 0]  # __NA__ < a < b


def test_standard_scale_population_std_and_zero_std(spark):
    df = spark.createDataFrame([(1.0, 3.0), (3.0, 3.0)], "x double, k double")
    fit = E.fit_standard_scale(df, ["x", "k"])
    assert fit["x"] == (2.0, 1.0) and fit["k"] == (3.0, 1.0)


# ----------------------------------------------------------------------------- thresholds


def test_sweep_equals_brute_force(spark):
    rng = random.Random(5)
    ps = [rng.random() for _ in range(300)] + D.grid_values(D.GRID)[:5] + [0.3 + 0.01 * 7, 0.70, 0.2999999]
    rows = [(i, p, int(rng.random() < p)) for i, p in enumerate(ps)]
    df = spark.createDataFrame(rows, "id long, p double, y int")
    for grid in (D.GRID, D.GRID_FINE):
        got = {round(r["threshold"], 9): r["accuracy"] for r in D.threshold_sweep(df, "y", "p", grid).collect()}
        for t in D.grid_values(grid):
            acc = np.mean([(p >= t) == bool(y) for _, p, y in rows])
            assert math.isclose(got[round(t, 9)], acc, abs_tol=1e-12)


def test_best_threshold_first_of_ties_and_default(spark):
    sw = spark.createDataFrame([(0.3, 0.5), (0.4, 0.7), (0.5, 0.7)], "threshold double, accuracy double")
    assert D.best_threshold(sw).first()["threshold"] == 0.4
    zero = spark.createDataFrame([(0.3, 0.0), (0.4, 0.0)], "threshold double, accuracy double")
    assert D.best_threshold(zero).first()["threshold"] == 0.5


def test_argmax_first_on_ties(spark):
    df = spark.createDataFrame([([0.2, 0.4, 0.4],), ([0.9, 0.1, 0.0],)], "p array<double>")
    assert col(df.select(D.argmax_class("p").alias("c")), "c") == [1, 0]


# ----------------------------------------------------------------------------- blending


def _tables(spark):
    a = spark.createDataFrame([(1, "true"), (2, "false"), (3, "true")], "id long, t string")
    b = spark.createDataFrame([(1, "0"), (2, "1"), (3, "1")], "id long, t string")
    c = spark.createDataFrame([(1, "False"), (2, "True")], "id long, t string")
    return a, b, c


def test_weighted_vote_rules(spark):
    a, b, c = _tables(spark)
    out = {r["id"]: r["prediction"] for r in B.blend([("a", a, 2.0), ("b", b, 1.5), ("c", c, 1.0)], "id", "t").collect()}
    # id 1: 2/4.5 < .5 -> False; id 2: 2.5/4.5 >= .5 -> True; id 3 absent from c -> False
    assert out == {1: "False", 2: "True", 3: "False"}
    scaled = {r["id"]: r["prediction"] for r in B.blend([("a", a, 20.0), ("b", b, 15.0), ("c", c, 10.0)], "id", "t").collect()}
    assert scaled == out


def test_vote_tie_is_positive_and_01_format(spark):
    a = spark.createDataFrame([(1, "1")], "id long, t string")
    b = spark.createDataFrame([(1, "0")], "id long, t string")
    assert B.blend([("a", a, 1.0), ("b", b, 1.0)], "id", "t").first()["prediction"] == "1"


def test_weighted_average_and_mode(spark):
    a = spark.createDataFrame([(1, 0.2), (2, 0.4)], "id long, t double")
    b = spark.createDataFrame([(1, 0.6)], "id long, t double")
    long = B.stack_predictions([("a", a, 1.0), ("b", b, 3.0)], "id", "t")
    assert B.blend_mode(long) == "average"
    out = {r["id"]: r["prediction"] for r in B.weighted_average(long).collect()}
    assert math.isclose(out[1], (0.2 + 1.8) / 4) and out[2] is None


def test_select_blend_inputs():
    c = B.select_blend_inputs({"stacked": True, "threshold": False, "plain": True, "generated": True})
    assert c.inputs == (("stacked", 2.0), ("plain", 1.0), ("generated", 1.0)) and c.action == "blend"
    assert B.select_blend_inputs({"plain": True}).action == "single"


# ----------------------------------------------------------------------------- text


@pytest.mark.parametrize(
    "msg,label",
    [
        ("pandas ChainedAssignmentError here", "pandas_copy_on_write"),
        ("KEYERROR: 'x'", "missing_column"),
        ("X has 3 features but LGBM is expecting 4 features", "feature_count_mismatch"),
        ("ValueError: Input contains NaN", "nan_not_imputed"),
        ("all good", "unknown"),
    ],
)
def test_classify(spark, msg, label):
    df = spark.createDataFrame([(msg,)], "m string")
    assert TO.classify_messages(df, "m").first()["label"] == label


@pytest.mark.parametrize(
    "src,expected",
    [
        ("```python\nx = 1\n```", "x = 1"),
        ("```\nplain\n```", "plain"),
        ("```python\nonly head", "only head"),
        ("no fences", "no fences"),
    ],
)
def test_strip_fences(spark, src, expected):
    df = spark.createDataFrame([(src,)], "m string")
    assert df.select(T.strip_fences("m").alias("o")).first()["o"] == expected


def test_code_block_prefers_tagged(spark):
    src = "a\n```\nplain\n```\n```python\n  code  \n```"
    df = spark.createDataFrame([(src,), ("none",)], "m string")
    assert col(df.select(T.extract_code_block("m").alias("o")), "o") == ["code", None]


def test_validate_records(spark):
    recs = ['{"kind": "task", "id": "1", "status": {"state": "x"}}', '{"kind": "message", "role": "user", "parts": []}', '{"id": 1}']
    df = spark.createDataFrame([(r,) for r in recs], "j string")
    out = TO.validate_records(df, "j").collect()
    assert out[0]["errors"] == []
    assert out[1]["errors"] == ["message: empty parts", "message: role is not agent"]
    assert out[2]["errors"] == ["missing kind"]


def test_parse_params_default_on_failure(spark):
    df = spark.createDataFrame([('TUNED_PARAMS:{"model": "RF", "params": {"max_depth": 3}}\nOUTPUT_PATH:/x',), ("TUNED_PARAMS:{bad",), ("nothing",)], "m string")
    out = TO.parse_params(df, "m").collect()
    assert (out[0]["model"], out[0]["params"]) == ("RF", {"max_depth": "3"})
    assert out[1]["model"] == "XGBoost" and out[2]["model"] == "XGBoost"


# ----------------------------------------------------------------------------- features


def test_split_and_group_key(spark):
    df = spark.createDataFrame([("B/12/P", "0003_01"), (None, "7_2"), ("C", "x_1")], "cabin string, pid string")
    out = df.select(*S.split_composite("cabin", "/", ["d", "n", "s"]), *[c.alias(a) for c, a in zip(S.group_key("pid", "_"), ["g", "gn"])]).collect()
    assert [tuple(r) for r in out] == [("B", "12", "P", "0003", 3.0), ("__NA__", None, None, "7", 7.0), ("C", None, None, "x", None)]


def test_boolish_and_bool_to_int(spark):
    df = spark.createDataFrame([("Yes",), (" 0 ",), ("TRUE",), ("maybe",), (None,)], "v string")
    assert col(df.select(S.boolish_to_int("v").alias("o")), "o") == [1, 0, 1, -1, -1]
    assert col(df.select(S.bool_to_int("v").alias("o")), "o") == [-1, -1, 1, -1, -1]


def test_apply_plugin_rejects_row_change(spark):
    tr = spark.range(3)
    te = spark.range(2)
    with pytest.raises(FE.PluginRejected):
        FE.apply_plugin(lambda a, b: (a.limit(1), b), tr, te)
    a, b = FE.apply_plugin(lambda a, b: (a.withColumn("x", F.lit(1)), b.withColumn("y", F.lit(2))), tr, te)
    assert a.columns == ["id"] and b.columns == ["id"]


def test_group_sizes_fit_on_train_only(spark):
    tr = spark.createDataFrame([("1",), ("1",), ("2",)], "g string")
    te = spark.createDataFrame([("1",), ("9",)], "g string")
    out = FE.apply_group_sizes(te, FE.group_size_table(tr, "g"), "g").collect()
    assert [(r["group_size"], r["is_solo"]) for r in out] == [(2, 0), (1, 1)]


# ----------------------------------------------------------------------------- plans


def test_no_cartesian_or_nested_loop_in_plans(spark):
    import __spark_entry__ as em

    qs = em.queries()
    for name in ["target_encode_oof", "profile_categorical", "profile_corr_onehot", "weighted_vote", "group_transform",
                 "domain_features", "threshold_sweep", "assign_stratified_folds"]:
        plan = qs[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_scan_prunes_columns(spark):
    import __spark_entry__ as em

    plan = em.queries()["target_encode_oof"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,source:string>" in plan or "ReadSchema: struct<doc_id:bigint,lang:string,source:string,n_chars:bigint>" in plan


@pytest.mark.parametrize("xs", [[math.inf, 1.0, 2.0, 3.0], [-math.inf] * 3 + [0.5, 7.0], [1e-300, 1e300, 1.0, -1e300], [math.inf] * 3, [5.0] * 1000 + [6.0]])
def test_exact_median_orders_infinities_and_tails(spark, xs):
    df = spark.createDataFrame([(x,) for x in xs], "a double")
    assert Q.exact_medians(df, ["a"])["a"] == float(np.median(xs))


@pytest.mark.parametrize("accuracy", [10_000, 20])
def test_exact_median_of_many_values(spark, monkeypatch, accuracy):
    monkeypatch.setattr(Q, "ACCURACY", accuracy)  # a coarse sketch leaves a wide bracket over several slices
    df = spark.range(30_011).select((F.xxhash64("id") / 7.0).alias("a"), (F.col("id") % 3).cast("double").alias("b"))
    xs = [r["a"] for r in df.collect()]
    assert Q.exact_medians(df, ["a", "b"]) == {"a": float(np.median(xs)), "b": 1.0}


def test_exact_median_whole_range_when_the_bracket_misses(spark, monkeypatch):
    monkeypatch.setattr(Q.F, "percentile_approx", lambda *a: F.array(F.max("x"), F.max("x")))
    df = spark.createDataFrame([(float(x),) for x in range(10)], "a double")
    assert Q.exact_medians(df, ["a"])["a"] == 4.5


def test_joins_with_fitted_tables_leave_nothing_persisted(spark):
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    df = spark.createDataFrame([(i, f"v{i % 5}", f"L{i % 3}", i % 2) for i in range(60)], "id long, c string, y string, fold int")
    E.apply_ordinal(df, E.fit_ordinal(df, ["c"]), ["c"], "_code").count()
    I.encode_target(df, "y").count()
    FO.assign_stratified_folds(df.drop("fold"), 3, "id", "y").count()
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before


def test_no_column_is_gathered_in_one_window(spark):
    df = spark.range(50).select("id", F.md5(F.col("id").cast("string")).alias("c"), (F.col("id") * 1.0).alias("y"))
    plans = [x._jdf.queryExecution().optimizedPlan().toString() for x in (P.profile_target(df, "y"), P.corr_onehot(df, ["c"], "y"))]
    assert "Window" not in plans[0]
    # P9 keeps only the rank of the top-k report, which has a group limit before its shuffle
    assert "sum(n" not in "".join(x for x in plans[1].splitlines() if "Window [" in x)
    codes = {r["label"]: r["code"] for r in I.label_table(df, "c").collect()}
    assert [codes[k] for k in sorted(codes)] == list(range(50))


def test_ordinal_codes_do_not_depend_on_partitions(spark):
    rng = random.Random(11)
    rows = [(f"v{rng.randint(0, 400):04d}", f"w{rng.randint(0, 50)}") for _ in range(2000)]
    df = spark.createDataFrame(rows, "a string, b string")
    small = {(r["column"], r["value"]): r["code"] for r in E.fit_ordinal(df, ["a", "b"]).collect()}
    big = {(r["column"], r["value"]): r["code"] for r in E.fit_ordinal(df, ["a", "b"], partitions=7).collect()}
    assert small == big
    for c in ("a", "b"):
        vals = sorted({v for (cc, v) in small if cc == c})
        assert [small[(c, v)] for v in vals] == list(range(len(vals)))


def test_hot_key_group_ops_are_aggregate_joins(spark):
    # one key holds a third of the rows
    df = spark.range(3000).select(F.col("id"), F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id")).alias("g"),
                                  (F.col("id") % 7).cast("double").alias("v"))
    out = FE.group_transform(FE.group_size_join(df, "g"), "g", "v")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan
    r = out.where("g = 0").select("group_size", "grp_count").distinct().collect()
    assert [(x["group_size"], x["grp_count"]) for x in r] == [(1000, 1000)]
    assert out.where("g = 1").first()["is_solo"] == 1


def test_approximate_median_close_to_exact(spark):
    df = spark.range(10001).select((F.col("id") * 3.0).alias("x"))
    exact = E.fit_medians(df, ["x"])["x"]
    approx = E.fit_medians(df, ["x"], approximate=True)["x"]
    assert exact == 15000.0 and abs(approx - exact) <= 3.0 * 10001 / 10_000 + 3


# ----------------------------------------------------------------------------- answers off the fixtures


def test_grade_counts_every_answer(spark):
    ans = spark.createDataFrame([(i, "1") for i in range(10)], "id long, y string")
    two = spark.createDataFrame([(0, 1.0), (1, 1.0)], "id long, p double")
    r = G.grade(two, ans, "id", "p", "y").first()
    assert (r["score"], r["n_graded"], r["medal"]) == (0.2, 10, "none")
    assert G.grade(two, ans, "id", "p", "y", cutoffs=(("gold", 0.1),)).first()["medal"] == "gold"
    twice = spark.createDataFrame([(i, "1") for i in range(10)] + [(0, "0")], "id long, p string")
    assert G.grade(twice, ans, "id", "p", "y").first()["score"] == 0.9


def test_blend_counts_a_repeated_id_once(spark):
    rows = [(1, "a", 0, 1.0, "1"), (1, "a", 0, 1.0, "1"), (1, "b", 1, 1.5, "0")]
    long = spark.createDataFrame(rows, "id long, model string, pos int, weight double, value string")
    assert B.weighted_vote(long, as_bool=False).first()["prediction"] == "0"
    rows = [(1, "a", 0, 1.0, "0.2"), (1, "a", 0, 1.0, "0.2"), (1, "b", 1, 1.0, "0.6")]
    long = spark.createDataFrame(rows, "id long, model string, pos int, weight double, value string")
    assert abs(B.weighted_average(long).first()["prediction"] - 0.4) < 1e-12


def test_parse_params_keeps_text_values(spark):
    df = spark.createDataFrame([('TUNED_PARAMS:{"model":"X","params":{"max_features":"sqrt","max_depth":3}}',), ("none",)], "m string")
    a, b = TO.parse_params(df, "m").collect()
    assert a["params"] == {"max_features": "sqrt", "max_depth": "3"} and b["params"] == {}


def test_data_summary_uses_a_numeric_target(spark):
    df = spark.createDataFrame([(float(i), i) for i in range(1, 25)], "x double, y long")
    r = P.data_summary(df, "y", ["x"], ["x"], {"x": 12.5}).first()
    assert abs(r["corr"] - 1.0) < 1e-12
    top = P.target_correlations(df, "y", ["x"], []).first()
    assert abs(top["abs_r"] - 1.0) < 1e-12


def test_find_tables_takes_one_table(spark, tmp_path):
    from tabforge.sources import io

    for sub, v in (("b", 2), ("a", 1)):
        (tmp_path / sub).mkdir()
        (tmp_path / sub / "train.csv").write_text(f"x\n{v}\n")
    assert [r["x"] for r in io.find_tables(spark, str(tmp_path), "train.csv").collect()] == [1]
    spark.range(3).write.parquet(str(tmp_path / "deep" / "t.parquet"))
    assert io.find_tables(spark, str(tmp_path), "t.parquet").count() == 3
    assert io.find_tables(spark, str(tmp_path), "no.csv") is None and io.find_tables(spark, str(tmp_path / "no"), "t.parquet") is None


def test_digest_halves_are_independent(spark):
    row = spark.range(1).select(S.digest128(F.lit("v")).alias("d"), F.xxhash64(F.lit("salt"), F.lit("v")).alias("h")).first()
    assert row["d"][1] == row["h"] and row["d"][0] != row["h"]


def test_ridge_of_large_means(spark):
    import numpy as np

    from tabforge.plans import models as M

    rng = np.random.default_rng(0)
    x = 1e9 + rng.standard_normal(400)
    y = 3 * (x - 1e9) + 0.01 * rng.standard_normal(400)
    rows = [(i, i % 4, float(y[i]), float(x[i])) for i in range(400)]
    oof, _ = M.meta_ridge(spark.createDataFrame(rows, "id long, fold int, label double, s double"), None, ["s"], 4, alpha=1.0)
    got = {r["id"]: r["pred"] for r in oof.collect()}
    assert np.mean([(got[i] - y[i]) ** 2 for i in range(400)]) < 1e-2


def test_unknown_and_impossible_parameters_raise():
    from tabforge.plans import models as M

    assert M.to_mllib({"max_features": 0.3, "min_child_weight": 2, "max_depth": None}, "forest") == {
        "featureSubsetStrategy": "0.3", "minInstancesPerNode": 2, "maxDepth": 30}
    for bad in ({"no_such": 1}, {"max_depth": 31}):
        with pytest.raises(ValueError):
            M.to_mllib(bad, "gbt")
