"""The pipeline: each stage on what the one before kept."""

import random

from pyspark.sql import functions as F

import corpus_pipeline as C
from tabforge.llm import string_kernel
from tabforge.llm.common import stage, table

from .test_operators import brute_components, brute_quality

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    rows = {}
    for name, f in C.STAGES[:-1]:
        before, docs = docs, stage(f(spark, docs, SF), name)
        assert docs.columns == C.COLUMNS
        rows[name] = (before.collect(), docs.collect())
    came, left = rows["quality_rules"]
    text = {r["doc_id"]: r["text"] for r in came}
    for i in {r["doc_id"] for r in left}:
        n, _, _, _, repeated = brute_quality(text[i])
        assert n >= 50 and 100 * repeated <= 50 * n
    came, left = rows["language_id"]
    assert {r["doc_id"] for r in left} == {r["doc_id"] for r in came if string_kernel.grams(r["text"]) is not None}
    came, left = rows["near_duplicates"]
    want = {i for i, (n, root) in brute_components([(r["doc_id"], r["text"]) for r in came], 5, 80).items() if n == 0 or i == root}
    assert {r["doc_id"] for r in left} == want
    packed = C.STAGES[-1][1](spark, docs, SF).collect()
    assert {p["doc_id"] for p in packed} == want


def test_language_stage_rejects_foreign_and_garbage_texts(spark):
    docs = table(spark, SF, "documents")
    rng = random.Random(2)
    finnish = "kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan heille on annettu järki ja omatunto ja heidän".split()
    polish = "wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw są oni obdarzeni rozumem i sumieniem".split()
    garbage = ["".join(rng.choice(pool) for _ in range(rng.randint(2, 9))) for pool in ("abcdefghijklmnopqrstuvwxyz", "абвгдежзиклмноп") for _ in range(4000)]
    planted = [" ".join(rng.choice(w) for _ in range(n)) for w in (finnish, polish, garbage[:4000], garbage[4000:]) for n in (200, 5000)]
    planted += ["\U0001f600 12 " * 50]
    rows = [(-1 - i, t, None, "s", len(t)) for i, t in enumerate(planted)]
    for langs in (["en", "de", "fr", "es"], ["en", "fr"], ["en"]):
        clean = C.quality_rules(spark, docs, SF).filter(F.col("lang").isin(langs))
        left = {r["doc_id"] for r in C.language_id(spark, clean.unionByName(spark.createDataFrame(rows, clean.schema)), SF).select("doc_id").collect()}
        assert left == {r["doc_id"] for r in clean.select("doc_id").collect()}


def test_empty_table(spark):
    docs = table(spark, SF, "documents").limit(0)
    for _, f in C.STAGES:
        out = f(spark, docs, SF)
        assert out.count() == 0
