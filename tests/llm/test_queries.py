"""The registered queries without a SQL twin: stated columns, a row (or set of rows) per input row."""

import pytest

import __spark_entry__ as entry_mod
from tests.conftest import SF_ORACLE
from tests.oracle import duck

QUERIES = entry_mod.queries()
SHAPES = {
    "op1_ngram_jaccard_join": ("doc_id n_shingles component_id class_size", "select count(*) from documents"),
    "op4_iblt_fingerprints": ("doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next n_paragraphs", "select count(*) from documents"),
    "op5_text_density": ("page_id url text n_chars", "select count(*) from pages"),
    "op8_string_kernel_language": ("doc_id held_out lang_pred score", "select count(*) from documents"),
    "op9_rank_array_bpe": ("doc_id n_tokens ids_sha256 decoded_sha256", "select count(*) from documents"),
    "op10_token_parquet": ("doc_id start n_tokens ids_crc32", "select count(*) from documents"),
    "op13_jacobi_davidson_whitening": ("vec_id component n deviation whitened explained identity_error", "select 8 * count(*) from embeddings"),
}


@pytest.mark.parametrize("name", sorted(SHAPES))
def test_queries_have_their_shape(spark, name):
    columns, rows = SHAPES[name]
    df = QUERIES[name](spark, SF_ORACLE)
    assert df.columns == columns.split()
    assert df.count() == duck(SF_ORACLE).execute(rows).fetchall()[0][0]


@pytest.mark.parametrize("name", ["op6_hilbert_packing", "pipeline"])
def test_pieces_fill_the_sequences_without_gaps(spark, name):
    rows = QUERIES[name](spark, SF_ORACLE).select("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset").collect()
    at = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == at.get(r["sequence_id"], 0)
        at[r["sequence_id"]] = r["offset"] + r["length"]
    assert all(n == 1024 for s, n in at.items() if s != max(at)) and sorted(at) == list(range(len(at)))
    assert {(r["sequence_id"], r["offset"]): r for r in rows}.__len__() == len(rows)


def test_every_training_data_query_is_checked():
    names = {n for n in QUERIES if n == "pipeline" or (n.startswith("op") and n[2].isdigit())}
    assert names - set(entry_mod.oracle_sql()) == set(SHAPES) | {"op6_hilbert_packing", "pipeline"}
