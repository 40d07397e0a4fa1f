"""Operators 11 to 13: prefix trie, FM-index, whitening, against brute force and SQL."""

import hashlib
import math
import random
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from tabforge.llm import fm_index, jacobi_davidson, prefix_trie
from tabforge.llm.queries import ORACLE_SQL

TURNS = "conv_id long, turn long, role string, text string, depth int"  # depth: a clashing extra column
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


# ---- 11 ---------------------------------------------------------------------------------------


def sql_trie(rows):
    import duckdb

    con = duckdb.connect()
    con.register("given", pd.DataFrame([r[:4] for r in rows], columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"}))
    con.execute("create table conversations as select conv_id::bigint as conv_id, turn::bigint as turn, role::varchar as role, text::varchar as text from given")
    return sorted(con.execute(ORACLE_SQL["op11_prefix_trie"]).fetchall(), key=str)


def spark_trie(spark, rows, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        return sorted(map(tuple, prefix_trie.trie(spark.createDataFrame(rows, TURNS)).collect()), key=str)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def random_turns(rng, convs, most, texts):
    rows = []
    for c in range(convs):
        conv = rng.choice([c, 7 * c, 100 * c, -c])  # repeated ids, donors, negative ids
        rows += [(conv, rng.choice([t, t, None, 0]), rng.choice(["user", "assistant", None]), rng.choice(texts), 1) for t in range(rng.randint(0, most))]
    return rows


def test_trie_of_random_conversations_equals_sql(spark):
    rng = random.Random(4)
    rows = random_turns(rng, 90, 6, ["x", "yy", None, "", "é中"]) + [(None, 1, "user", "q", 1)]
    assert spark_trie(spark, rows, 8) == sql_trie(rows)


def test_trie_of_hot_group_and_long_conversation_equals_sql(spark):
    rng = random.Random(5)
    rows = random_turns(rng, 30, 5, ["x", "yy"])
    rows += [(7000 + i, t, "user", f"same {t}", 1) for i in range(60) for t in range(4)]  # one group over many tasks
    rows += [(99, t, "user", f"long {t % 3}", 1) for t in range(300)] + [(5, 0, "user", "x", 1)] * 3
    assert spark_trie(spark, rows, 13) == sql_trie(rows)


def test_trie_of_nothing_and_of_one(spark):
    assert spark_trie(spark, [], 4) == []
    empty = hashlib.sha256(b"").hexdigest()
    # crc32("1") % 6 = 1: the first turn is taken from conversation 0, which is absent
    assert spark_trie(spark, [(1, 0, "user", "x", 1)], 4) == [(1, 0, None, 1, 0, 1, 0, hashlib.sha256(b"1").hexdigest())]
    two = spark_trie(spark, [(0, 0, "user", "abc", 1), (0, 1, "user", "de", 1)], 4)
    assert two == [(0, 0, None, 1, 1, 1, 0, empty), (0, 1, 0, 1, 1, 1, 0, empty), (0, 2, 0, 1, 0, 1, 0, hashlib.sha256(b"0").hexdigest())]


def test_forest_of_a_task_counts_subtrees():
    # sequences: A, AB, AB, AC of lengths 1, 2, 2, 2; the first and last rows' paths are spines
    rows = prefix_trie.Forest([5, 1, 2, 3], np.array([0, 1, 2, 1]), np.array([1, 2, 2, 2]), [np.array([4]), np.array([7]), np.array([]), np.array([9])]).rows
    node = [r for r in rows if r[0] == prefix_trie.NODE]
    assert [(r[2], r[3], r[6], r[7], r[8], r[9]) for r in node] == [(1, 2, 2, 0, 1, 7)]
    spine = {(r[1], r[3]): r for r in rows if r[0] == prefix_trie.SPINE}
    assert spine[(prefix_trie.BOTH, 1)][6:10] == [4, 2, 1, 7] and spine[(prefix_trie.BOTH, 1)][11] == "5"
    assert spine[(prefix_trie.RIGHT, 2)][6:8] == [1, 0] and (prefix_trie.BOTH, 0) in spine


# ---- 12 ---------------------------------------------------------------------------------------


def brute_leaks(docs, items, window=10):
    phrases = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            phrases.setdefault(tuple(w[k : k + window]), set()).add("" if i is None else str(i))
    sizes, out = sorted({len(p) for p in phrases}), []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for s in sizes:
            for k in range(len(w) - s + 1):
                if g := phrases.get(tuple(w[k : k + s])):
                    hit |= set(range(k, k + s))
                    found |= g
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def leak_case(seed=3):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(12)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, prose(rng.choice([1, 3, 9, 10, 11, 25]))) for i in range(24)] + [(100, None), (101, " ,"), (102, "Ünï 7"), (None, prose(12)), (3, prose(14))]
    docs = [(i, prose(rng.choice([0, 1, 5, 50, 700]))) for i in range(40)] + [(None, None), (None, "ünï 7 x"), (5, "Ünï, 7"), (6, prose(9000)), (6, prose(9000))]
    return docs + [(200 + k, f"{prose(230)} {items[k][1].upper()}. {prose(30)}") for k in range(12)], items


@pytest.mark.parametrize(("shard", "piece"), [(fm_index.SHARD, fm_index.PIECE), (400, 16)])
def test_leaks_equal_brute_force(spark, shard, piece):
    docs, items = leak_case()
    d = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, n_words int")
    got = fm_index.decontaminated(d, spark.createDataFrame(items, "item_id long, text string"), shard=shard, piece=piece)
    assert sorted(map(tuple, got.collect()), key=str) == brute_leaks(docs, items)


def test_phrases_in_several_blocks_give_merged_spans(spark, monkeypatch):
    monkeypatch.setattr(fm_index, "BLOCK", 40)
    docs, items = leak_case(9)
    got = fm_index.decontaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=str) == brute_leaks(docs, items)


def test_leaks_of_empty_tables(spark):
    docs, items = leak_case()
    d, i = spark.createDataFrame(docs[:5], "doc_id long, text string"), spark.createDataFrame(items[:3], "item_id long, text string")
    assert fm_index.decontaminated(d.limit(0), i).count() == 0
    assert [r["n_hit"] for r in fm_index.decontaminated(d, i.limit(0)).collect()] == [0] * 5


def test_words_are_cut_alike_in_chunks(monkeypatch):
    rng = random.Random(1)
    texts = ["".join(rng.choice("abAB09 -_\n éñ 中") for _ in range(rng.randint(0, 300))) for _ in range(200)] + [None, "", " ", "x" * 90]
    want, seen = [words(t) for t in texts], []
    for chunk in (64, 8 << 20):
        monkeypatch.setattr(fm_index, "CHUNK", chunk)
        hashes, n = fm_index.text_words(pa.array(texts))
        assert n.tolist() == [len(w) for w in want]
        seen.append(hashes.tolist())
    assert seen[0] == seen[1]
    name = dict(zip([w for x in want for w in x], seen[0], strict=True))
    assert [name[w] for x in want for w in x] == seen[0] and len(set(name.values())) == len(name)


def test_index_finds_and_locates_all_occurrences():
    rng = np.random.default_rng(2)
    sizes = np.array([50, 1, 0, 200, 30])
    hashes = rng.integers(1, 6, sizes.sum()).astype(np.uint64)
    index = fm_index.Index(*fm_index.Index.build(hashes, sizes))
    starts = np.cumsum(sizes) - sizes
    phrases = np.zeros((40, 10), np.uint64)
    n = rng.integers(1, 11, 40)
    for k in range(40):
        phrases[k, 10 - n[k] :] = rng.integers(1, 7, n[k])
    got = sorted(zip(*(np.concatenate(x).tolist() for x in zip(*index.find(phrases, n), strict=True)), strict=True))
    want = [
        (k, p, a)
        for k in range(40) for p in range(5) for a in range(sizes[p] - n[k] + 1)
        if (hashes[starts[p] + a : starts[p] + a + n[k]] == phrases[k, 10 - n[k] :]).all()
    ]
    assert got == sorted(want)


# ---- 13 ---------------------------------------------------------------------------------------


def brute_whitening(rows, k=8):
    good = [(i, [float(c) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    dims = max(len(v) for _, v in good)
    good = [g for g in good if len(g[1]) == dims]
    x = np.floor(np.array([g[1] for g in good]) * 1024).astype(np.int64) + 100_000
    n, sums = len(x), x.sum(0)
    c = x - sums / n
    e, q = np.linalg.eigh(c.T @ c / n)
    e, q = e[::-1], q[:, ::-1][:, :k]
    deviation = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(r, sums, strict=True)) for r in x]
    return [g[0] for g in good], n, deviation, c @ q / np.sqrt(e[:k]), e[:k] / e.sum()


def test_whitening_equals_dense_eigenvectors(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(6, 12))
    rows = [(i, [float(v) for v in centres[i % 6] + 0.2 * rng.normal(size=12)]) for i in range(300)]
    rows += [(7, rows[7][1]), (None, rows[8][1]), (900, None), (901, [math.nan] * 12), (902, [None] + [0.1] * 11), (903, [math.inf] * 12), (904, [])]
    d = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, n int").repartition(5)
    got = jacobi_davidson.whitened(d).toPandas()
    ids, n, deviation, white, explained = brute_whitening(rows)
    assert len(got) == 8 * len(ids) and set(got["n"]) == {n} and got["identity_error"].max() < 1e-9
    first = got[got["component"] == 1]
    assert sorted(zip(first["vec_id"].fillna(-1), first["deviation"], strict=True)) == sorted(zip([-1 if i is None else i for i in ids], deviation, strict=True))
    for c in range(8):
        part = got[got["component"] == c + 1]
        assert np.allclose(part["explained"], explained[c], rtol=1e-9)
        a, b = np.sort(part["whitened"]), white[:, c]
        assert min(np.abs(a - np.sort(b)).max(), np.abs(a - np.sort(-b)).max()) < 1e-8


def test_whitening_without_variance_few_dimensions_and_no_rows(spark):
    ddl = "vec_id long, embedding array<float>"
    one = jacobi_davidson.whitened(spark.createDataFrame([(1, [1.0, 2.0])], ddl)).collect()
    assert [(r["component"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one] == [(1, 0, None, 0.0, None), (2, 0, None, 0.0, None)]
    assert jacobi_davidson.whitened(spark.createDataFrame([(1, None), (2, [])], ddl)).count() == 0
    assert jacobi_davidson.whitened(spark.createDataFrame([], ddl)).count() == 0


@pytest.mark.parametrize("case", ["clusters", "flat", "rank 2", "decay", "equal", "nine", "one"])
def test_eigenpairs_reach_double_precision(case):
    rng = np.random.default_rng(0)
    dims = {"decay": 200, "nine": 9, "one": 1}.get(case, 64)
    a = rng.standard_normal((2000, dims))
    if case == "clusters":
        a = a * 30 + (rng.standard_normal((10, dims)) * 100)[rng.integers(0, 10, 2000)]
    elif case == "rank 2":
        a = a[:, :2] @ rng.standard_normal((2, dims))
    elif case == "decay":
        a = a * 0.9 ** np.arange(dims)
    a = a - a.mean(0)
    v = np.eye(dims) * 3 if case == "equal" else a.T @ a / len(a)
    e, q = jacobi_davidson.largest_pairs(lambda u: v @ u, dims, 8)
    want = np.linalg.eigvalsh(v)[::-1][: len(e)]
    assert len(e) == min(8, dims) and np.abs(e - want).max() <= 1e-13 * want[0]
    assert np.linalg.norm(v @ q - q * e, axis=0).max() <= 1e-12 * want[0] and np.abs(q.T @ q - np.eye(len(e))).max() < 1e-12
