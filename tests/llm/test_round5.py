"""What was mended in the training-data operators after the check of round 3."""

import tracemalloc

import public_tokenizers
import pyarrow as pa

from tabforge.llm import hilbert_pack as H
from tabforge.llm import ngram_join as J

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_by_bytes_cuts_batches_and_loses_no_row():
    from tabforge.llm.common import by_bytes

    texts = [None, "a" * 9, "", "é" * 4, "b" * 50, None, "c", "", "d" * 10, "e"]
    for type_ in (pa.string(), pa.large_string()):
        whole = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, type_)], ["id", "text"])
        parts = [p for b in (whole.slice(0, 0), whole, whole.slice(3, 4)) for p in by_bytes([b], 1, 10)]
        assert [r for p in parts for r in p.to_pylist()] == whole.to_pylist() + whole.slice(3, 4).to_pylist()
        assert all(p.num_rows == 1 or sum(len((t or "").encode()) for t in p.column(1).to_pylist()) <= 10 for p in parts)
        assert [p.num_rows for p in by_bytes([whole], 1, 10)] == [3, 1, 1, 3, 1, 1]


def test_packing_encodes_a_large_batch_in_bounded_memory(monkeypatch):
    """A worker keeps what it once took, so a batch's ids are not all made at once."""
    text = "the quick brown fox jumps over the lazy dog " * 100
    n = 6000
    batch = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array([text] * n)], ["doc_id", "text"])
    taken = []

    class Frame:
        """Runs the function that the table hands to ``mapInArrow`` here, over the one batch."""

        sparkSession = None
        dtypes = [("doc_id", "bigint"), ("text", "string")]

        def select(self, *_):
            return self

        def mapInArrow(self, rows, _):
            next(iter(rows(iter([batch.slice(0, 1)]))))  # the encoder is made once
            tracemalloc.start()
            for out in rows(iter([batch])):
                taken.append([*zip(out.column("doc_id").to_pylist(), out.column("n_tokens").to_pylist(), strict=True)])
            taken.append(tracemalloc.get_traced_memory()[1])
            tracemalloc.stop()
            return self

        def withColumn(self, *_):
            return self

    monkeypatch.setattr(H, "stage", lambda df, label: df)
    monkeypatch.setattr(H.F, "monotonically_increasing_id", lambda: None)
    H.token_table(Frame(), PATH, 0)
    *rows, peak = taken
    rows = [r for part in rows for r in part]
    assert [i for i, _ in rows] == [*range(n)] and len({k for _, k in rows}) == 1
    assert peak < 30 << 20  # 26 MB of text; the whole batch at once took 44 MB


def test_runs_unpack_a_few_rows_at_a_time():
    n = 4 * J.BLOCK
    keys = [i // 300 for i in range(n)]
    batch = pa.RecordBatch.from_arrays([pa.array(keys), pa.array(["x" * 20_000 + str(i) for i in range(n)])], ["q", "v"])
    seen, now = [], []
    tracemalloc.start()
    for (q,), run in J._runs([batch, batch.slice(0, 0)], 1):
        for k, v in run:
            assert k == q
            seen.append((k, int(v[20_000:])))
    now = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert seen == [(k, i) for i, k in enumerate(keys)]
    assert now < 12 << 20  # of 20 MB
