"""What round 3 mended outside of the training-data operators."""

from tabforge.streaming.apply import read_stream, run_to_table


def test_a_stream_reads_a_table_that_is_a_file_or_a_folder(spark, tmp_path):
    rows = spark.range(40).selectExpr("id", "cast(id as string) as s")
    rows.repartition(4).write.parquet(str(tmp_path / "many" / "t.parquet"))
    rows.write.parquet(str(tmp_path / "many" / "other.parquet"))
    (tmp_path / "one").mkdir()
    rows.toPandas().to_parquet(tmp_path / "one" / "t.parquet")
    for d in ("many", "one"):
        got = run_to_table(read_stream(spark, str(tmp_path / d), rows, glob="t.parquet"), "folder")
        assert sorted(map(tuple, got.collect())) == [(i, str(i)) for i in sorted(range(40))]


def _boost_rows(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 3))
    y = (x[:, 0] * x[:, 1] + 0.3 * rng.normal(size=600) > 0).astype(float)
    rows = [(i, i % 3, float(y[i]), x[i].tolist()) for i in range(600)]
    return spark.createDataFrame(rows, "id long, fold int, label double, features array<double>").repartition(4, "id")


def test_boosters_take_few_jobs_and_grow_the_same_trees_a_job_a_level(spark, monkeypatch):
    import numpy as np

    from tabforge.operators.infer import BINARY
    from tabforge.plans import boost as B

    rows = _boost_rows(spark).cache()
    learners = [B.HistBoost(12, 4, 0.3, rows=0.8, cols=0.7, min_rows=5), B.HistBoost(8, 3, 0.3, bins=32)]
    sc = spark.sparkContext

    def fit(group):
        sc.setJobGroup(group, group)
        models = B.fit_boosters(learners, rows, BINARY, 2, 3)
        jobs = len(sc.statusTracker().getJobIdsForGroup(group))
        sc.setLocalProperty("spark.jobGroup.id", None)
        return [[r["score"] for r in m.held_out(rows).orderBy("id").collect()] for m in models], jobs

    whole, jobs = fit("whole")
    assert jobs < 20  # formerly a job a level: 48 more
    monkeypatch.setattr(B, "WHOLE_ROWS", 0)
    monkeypatch.setattr(B, "BLOCK_ROWS", 200)
    levels, _ = fit("levels")
    assert np.abs(np.array(whole) - np.array(levels)).max() < 1e-9


def test_scores_of_many_models_take_one_python_pass(spark):
    from tabforge.operators.infer import BINARY
    from tabforge.plans import learners as L
    from tabforge.plans import solve as S

    rows = _boost_rows(spark)
    models = [(str(i), L.CountedBayes(4 + i).fit_folds(rows, BINARY, 2, 3)) for i in range(5)]
    stacked = S._stacked(rows, models, BINARY, "held_out")
    assert stacked._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    got = {r["id"]: r["features"] for r in stacked.collect()}
    for i, (_, m) in enumerate(models):
        assert all(got[r["id"]][i] == r["score"] for r in m.held_out(rows).collect())
