"""What was mended in the training-data operators after the findings of round 3."""


def test_compared_list_entries_hold_a_sketch_of_half_the_cells_that_still_bounds():
    import numpy as np
    import pyarrow as pa

    from tabforge.llm import ngram_join as J

    rng = np.random.default_rng(1)
    for n in (3, 20, 150, 400):
        base = rng.integers(0, 1 << 63, 2 * n).astype(np.uint64)
        for swapped in (0, n // 40, n // 13, n):
            sets = [base[:n], np.concatenate([base[: n - swapped], base[n : n + swapped]])]
            full = [J.parity_sketch(g, 85) for g in sets]
            batch = pa.RecordBatch.from_arrays([pa.array([0, 1]), pa.array(full, pa.binary())], ["uid", "sketch"])
            half = next(J._halved([batch])).column(1).to_pylist()
            for f, h in zip(full, half, strict=True):
                assert len(h) == max(8, len(f) // 2)
                assert J._bits(h) == (J._fold(*J._bits(f), 8 * len(h)), 8 * len(h))
            links = 100 * (n - swapped) >= 85 * (n + swapped)
            assert J.may_link(n, J._bits(half[0]), n, J._bits(half[1]), 85) or not links
    assert not J.may_link(400, J._bits(half[0]), 400, J._bits(half[1]), 85)  # nothing in common
