"""What round 3 mended in the training-data operators."""

from pyspark.sql import functions as F

from tabforge.llm import chat_prefix


def test_every_example_holds_its_whole_prefix_whatever_their_size(spark):
    turns = spark.range(60).selectExpr("1L as conv_id", "id as turn", "if(id % 2 = 0, 'user', 'assistant') as role", "concat('text ', id, repeat(' word', 80000)) as text")
    f = chat_prefix.format_turns(turns)
    own = {r["pos"]: r for r in f.select("pos", "context_chars", "loss_start", F.length("formatted").alias("n")).collect()}
    reply = F.expr("substring(text, loss_start + 1, 7)")
    got = chat_prefix.example_texts(f).select("pos", "loss_start", F.length("text").alias("n"), reply.alias("reply")).collect()
    assert len(got) == 30 and sum(r["n"] for r in got) > 1 << 28
    for r in got:
        assert r["n"] == own[r["pos"]]["context_chars"] + own[r["pos"]]["n"]
        assert r["loss_start"] == own[r["pos"]]["context_chars"] + own[r["pos"]]["loss_start"]
        assert r["reply"] == f"text {r['pos']} "[:7]


def test_ids_alone_equal_the_ids_of_pairs():
    import public_tokenizers

    from tabforge.llm.rank_bpe import RankBpe

    bpe = RankBpe(public_tokenizers.path("word_bpe_49k.json"))
    special = next(iter(bpe.added), "")
    for text in ("", "Hello, WORLD! don't stop", f"a{special} b {special}{special}", "x" * 500 + " ÄÖ ß 漢字 Σίσυφος 12:30", "\n\t two blanks "):
        assert bpe.encode(text) == b"".join(p[0] for p in bpe.pairs(text))
