"""What was mended in the boosters after the findings of round 4."""

import numpy as np
import pytest

from tabforge.operators.infer import BINARY, MULTICLASS, REGRESSION
from tabforge.plans import boost as B


def test_leaves_from_the_last_level_up_are_those_of_a_walk():
    rng = np.random.default_rng(1)
    parts = rng.integers(0, 32, (500, 4)).astype(np.uint8)
    for depth in (1, 2, 6, 7, 8, 9):
        nodes = (1 << depth) - 1
        feature, part = rng.integers(0, 4, nodes).astype(np.int16), rng.integers(0, 32, nodes).astype(np.uint8)
        part[rng.random(nodes) < 0.2] = 255
        want = B._walk(parts.ravel(), np.arange(500) * 4, feature, part, depth)
        assert (B._leaf(np.ascontiguousarray(parts.T), feature, part, depth) == want).all()


def _repeated(spark, task):
    """Rows of few cells, in several blocks."""
    rng = np.random.default_rng(4)
    x = np.column_stack([rng.integers(0, 9, 1500), rng.integers(0, 3, 1500), rng.integers(0, 6, 1500), np.zeros(1500)]).astype(float)
    y = {REGRESSION: x[:, 0] * x[:, 1] + rng.normal(size=1500), BINARY: (x[:, 0] + rng.normal(size=1500) > x[:, 2]).astype(float), MULTICLASS: (x[:, 0] > 3).astype(float) + (x[:, 2] > 2)}[task]
    rows = [(i, int(i % 3), float(y[i]), x[i].tolist()) for i in range(1500)]
    return spark.createDataFrame(rows, "id long, fold int, label double, features array<double>").repartition(3, "id").cache()


@pytest.mark.parametrize("task", [REGRESSION, BINARY, MULTICLASS])
def test_cells_grow_the_trees_of_their_rows(spark, monkeypatch, task):
    """The tasks' states hold cells (formerly rows), draw the same rows, and give the scores of a job a level."""
    rows, n = _repeated(spark, task), {REGRESSION: 0, BINARY: 2, MULTICLASS: 3}[task]
    learners = [B.HistBoost(4, 3, 0.3, rows=0.7, cols=0.6, min_rows=5), B.HistBoost(3, 2, 0.3, l2=0.0)]
    blocks = B._blocks(rows, B._edges(rows, 4, 32, "quantile"))
    cells = B._cells(blocks, 1500, 4)
    assert len(cells) <= 3 * 9 * 3 * 6 < 1500
    monkeypatch.setattr(B, "SHARED_ROWS", 100)  # several models a task
    monkeypatch.setattr(B, "BLOCK_ROWS", 300)
    fit = lambda: [{r["id"]: r["score"] for r in getattr(m, how)(rows).collect()} for m in B.fit_boosters(learners, rows, task, n, 3) for how in ("held_out", "refit")]
    whole = fit()
    monkeypatch.setattr(B, "WHOLE_CELLS", 10)  # too many cells: rows, a job a level
    assert B._cells(blocks, 1500, 4) is None
    for a, b in zip(whole, fit(), strict=True):
        assert set(a) == set(b) == set(range(1500))
        assert max(np.abs(np.array(a[i]) - np.array(b[i])).max() for i in a) < 1e-9


def test_a_predictor_scores_a_cell_once_and_forgets(spark, monkeypatch):
    rows = _repeated(spark, BINARY)
    model = B.HistBoost(3, 3, 0.3).fit_folds(rows, BINARY, 2, 3)
    x = np.array([r["features"] for r in rows.select("features").collect()])
    want = {r["id"]: r["score"] for r in model.refit(rows).collect()}
    ids = [r["id"] for r in rows.select("id").collect()]
    monkeypatch.setattr(B, "REMEMBERED", 20)
    for at in (0, 200, 100, 0):
        got = model.predict(model.params[-1], x[at : at + 150])
        assert [want[i] for i in ids[at : at + 150]] == got.tolist()
    assert model.predict(model.params[-1], x[:0]).shape == (0,)


def test_batches_are_scored_together_in_their_order():
    import pyarrow as pa

    from tabforge.plans.learners import _larger

    batches = [pa.RecordBatch.from_arrays([pa.array(range(a, b), pa.int64()), pa.array([[float(i)] for i in range(a, b)], pa.list_(pa.float64()))], ["i", "x"]) for a, b in ((0, 3), (3, 3), (3, 9), (9, 10), (10, 12))]
    got = [*_larger(batches, 5)]
    assert [b.num_rows for b in got] == [9, 3] and [i for b in got for i in b.column(0).to_pylist()] == [*range(12)]
    assert [v for b in got for v in b.column(1).to_pylist()] == [[float(i)] for i in range(12)]
    assert [*_larger([], 5)] == [] and sum(b.num_rows for b in _larger(batches[1:2], 5)) == 0
