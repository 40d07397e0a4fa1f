"""What was mended in the training-data operators after the findings of round 4."""

import public_tokenizers

from tabforge.llm import hilbert_pack as H

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_packing_cuts_rows_whatever_the_kind_of_their_id(spark):
    texts = ["one two three " * 400, None, "", "four five " * 900, "six", "one two three " * 400]
    tok = H.text_encoder(PATH).tok
    want = [tok.encode(t or "", add_special_tokens=False).ids + [H.END_ID] for t in texts]
    for kind, ids in (("long", [1, None, 3, 4, 5, 1]), ("string", ["a", None, "c", "d", "e", "a"])):
        docs = spark.createDataFrame([*zip(ids, texts, strict=True)], f"doc_id {kind}, text string")
        rows = H.pack(docs, PATH).collect()
        assert sorted(str(r["doc_id"]) for r in rows if r["start"] == 0) == sorted(map(str, ids))
        places = sorted((r["sequence_id"] * H.LENGTH + r["offset"], r["piece_length"]) for r in rows)
        assert places[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(places, places[1:], strict=False))
        assert sorted(t for r in rows for t in memoryview(bytes(r["ids"])).cast("I").tolist()) == sorted(t for w in want for t in w)
