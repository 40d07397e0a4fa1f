"""Brute-force, round-trip and edge-case tests of the training-data operators."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tabforge.llm import chat_prefix, hilbert_pack, html_density, iblt, line_templates, ngram_join, quality_cascade, rank_bpe, string_kernel, token_parquet
from tabforge.llm.token_library import TextEncoder

WORD_BPE, BYTE_BPE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, source string, n_words int"  # n_words: a clashing extra column
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(n))


def corpus(seed=3, groups=12):
    """Copies, near copies, null, empty, blank and very long texts, a repeated row."""
    rng, rows = random.Random(seed), []
    for g in range(groups):
        base = prose(rng, rng.randint(5, 120)).split(" ")
        for _ in range(rng.randint(1, 4)):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 3])):
                w[rng.randrange(len(w))] = "edit" + str(rng.randrange(99))
            lines = [" ".join(w[i : i + 9]) for i in range(0, len(w), 9)]
            rows.append((len(rows), "\n".join(lines), "en", "s", 1))
    n = len(rows)
    rows += [(n, None, None, "s", 1), (n + 1, "", "en", None, 1), (n + 2, " \n\t ", "en", "s", 1), (n + 3, "One", "en", "s", 1), (n + 4, "ONE", "en", "s", 1)]
    rows += [(n + 5, prose(rng, 20_000), "en", "s", 1), rows[0]]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def tokenizer(path):
    t = Tokenizer.from_file(path)
    t.no_padding()
    t.no_truncation()
    return t


# ---- 1 ----------------------------------------------------------------------------------------


def shingles(text, k):
    w = WORDS.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute_components(rows, k, percent):
    sets = {r[0]: shingles(r[1], k) for r in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            i = len(sets[a] & sets[b])
            if a < b and i and 100 * i >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_ngram_join_equals_brute_force(docs, none):
    rows = corpus()
    got = ngram_join.jaccard_components(docs).collect()
    assert len(got) == len(rows)
    want = brute_components(rows, 4, 85)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert ngram_join.jaccard_components(none).count() == 0


def test_ngram_join_keeps_one_of_each_group(docs):
    want = {i for i, (n, root) in brute_components(corpus(), 5, 80).items() if n == 0 or i == root}
    kept = ngram_join.keep_one(docs)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(want)
    assert kept.columns == docs.columns


def test_ngram_join_keeps_rows_of_one_id_with_other_texts(spark):
    rng = random.Random(8)
    one, two, three = (prose(rng, 60) for _ in range(3))
    rows = [(1, one), (1, two), (1, two), (2, one + " tail"), (3, two + " tail"), (4, three), (5, three), (6, None), (6, " "), (None, one)]
    kept = ngram_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter(map(tuple, kept)) == Counter([(1, one), (1, two), (4, three), (6, None), (6, " "), (None, one)])
    rows = [(5, one), (5, two), (2, two + " tail")]  # the second row of 5 is a copy of 2, the first is not
    for order in (rows, rows[::-1]):
        kept = ngram_join.keep_one(spark.createDataFrame(order, "doc_id long, text string")).collect()
        assert sorted(map(tuple, kept)) == [(2, two + " tail"), (5, one)]


def test_search_finds_all_sets_that_reach_the_overlap():
    rng = np.random.default_rng(5)
    q = np.unique(rng.integers(0, 2**63, 200).astype(np.uint64))
    chunk = []
    for k in range(60):
        keep = q[rng.random(len(q)) < rng.uniform(0.7, 1.0)]
        chunk.append((k, np.unique(np.concatenate([keep, rng.integers(0, 2**63, rng.integers(0, 40)).astype(np.uint64)]))))
    want = [k for k, s in chunk if 100 * len(np.intersect1d(q, s)) >= 85 * len(np.union1d(q, s))]
    assert ngram_join.divide_skip(q, chunk, 85) == want and want


def test_parity_bound_never_loses_a_link():
    rng = random.Random(1)
    for _ in range(300):
        n = rng.randint(1, 300)
        a = {rng.getrandbits(64) for _ in range(n)}
        b = set(rng.sample(sorted(a), max(1, int(n * rng.uniform(0.8, 1))))) | {rng.getrandbits(64) for _ in range(rng.randint(0, n // 8))}
        if 100 * len(a & b) >= 85 * len(a | b):
            bits = [ngram_join._bits(ngram_join.parity_sketch(np.array(sorted(x), np.uint64), 85)) for x in (a, b)]
            assert ngram_join.may_link(len(a), bits[0], len(b), bits[1], 85)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100)], "a long, b long")
    got = {r["node"]: r["root"] for r in ngram_join.connected(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


# ---- 2 ----------------------------------------------------------------------------------------


def test_line_templates(spark, none):
    log = "Server {} answered the request number {} of user alpha in good time"
    rows = [(i, f"own words of document {prose(random.Random(i), 6)}\n" + log.format(f"n{i}", i * 7) + "\nAll rights reserved.") for i in range(4)]
    rows += [(9, "a b c d e f g h i j one\nkept"), (10, "a b c d e f g h i j two"), (11, "a b c d e f g h i j three"), (12, None), (13, "short"), (14, "short"), (15, "short")]
    out = {r["doc_id"]: r for r in line_templates.drop_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[0]["text"] == rows[0][1] and out[0]["_n_dropped"] == 0  # first document keeps its lines
    for i in (1, 2, 3):
        assert out[i]["text"] == rows[i][1].split("\n")[0] and out[i]["_n_dropped"] == 2
    assert out[9]["text"] == rows[4][1] and out[10]["text"] == "" and out[11]["text"] == ""  # the differing word is a variable
    assert out[12]["text"] is None and out[13]["text"] == out[15]["text"] == "short"
    assert line_templates.drop_lines(none).count() == 0


# ---- 3 ----------------------------------------------------------------------------------------


def brute_quality(text):
    w = WORDS.findall(text or "")
    win = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    rep = {i + k for i in range(len(w) - 2) if win[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORDS.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(rep)


def test_quality_measures_and_verdicts(spark, none):
    rng = random.Random(2)
    clean = prose(rng, 80)
    texts = [clean, clean + "\n" + clean, "a b c " * 40, "a b c a b c", " ".join(x + "###" for x in clean.split()), clean.upper(), None, "", "\n \n", prose(rng, 20_000)]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in quality_cascade.measured(d).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute_quality(t), i
    assert [got[i]["kept"] for i in range(10)] == [True, False, False, False, False, False, False, False, False, True]
    kept = quality_cascade.quality_filter(d.withColumn("_text", F.lit(1)))
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 9] and kept.columns == ["doc_id", "text", "_text"]
    assert quality_cascade.measured(none).count() == 0


def test_cascade_order_does_not_change_the_verdict(docs):
    w = quality_cascade.with_words(docs.select("doc_id", "text"))
    rules = quality_cascade.rules()
    a = w.select("doc_id", quality_cascade.verdict(rules).isNull().alias("k"))
    b = w.select("doc_id", quality_cascade.verdict(rules[::-1]).isNull().alias("k"))
    assert sorted(a.collect()) == sorted(b.collect())


# ---- 4 ----------------------------------------------------------------------------------------


def paragraphs(t):
    return Counter(p for p in (t or "").split("\n") if p.strip(" \t\n\x0b\x0c\r"))


def jaccard(a, b):
    a, b = paragraphs(a), paragraphs(b)
    union = sum((a | b).values())
    return sum((a & b).values()) / union if union else 1.0


def test_fingerprints_equal_brute_force(spark, none):
    rows = corpus()[:-1]
    rows[-1] = (rows[-1][0], "\n".join(f"line {i % 700}" for i in range(900)), "en", "s", 1)  # needs larger sketches
    got = {r["doc_id"]: r for r in iblt.fingerprint_edits(spark.createDataFrame(rows, DOCS)).collect()}
    order = sorted(rows, reverse=True, key=lambda r: r[0])
    for k, r in enumerate(order):
        t, x = r[1] or "", order[(k + 1) % len(order)][1] or ""
        edited = t[: len(t) - len(t) // 2] + x[: len(t) // 2]
        g = got[r[0]]
        assert g["n_chars"] == len(t) and g["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert abs(g["near_edited"] - jaccard(t, edited)) < 1e-9 and abs(g["near_next"] - jaccard(t, x)) < 1e-9
    prints = {}
    for r in rows:
        prints.setdefault(r[1] or "", set()).add(got[r[0]]["fingerprint"])
    assert all(len(v) == 1 for v in prints.values())
    assert iblt.fingerprint_edits(none).count() == 0


# ---- 5 ----------------------------------------------------------------------------------------


def test_main_text():
    body = "<p>The first <b>para</b>graph has words,\n and more &amp; more.<br>Next</p><p>The second paragraph is long enough to be the text of it.</p>"
    page = (
        "<html><head><title>T</title><script>var a='<p>x</p>'</script></head><body><header>Site</header><nav><ul><li><a href=/>Home</a></li></ul></nav>"
        f"<div class='cookie-notice'>We use cookies</div><article><h1>Head</h1>{body}<form>Mail <input></form></article><aside>Side</aside>"
        "<section id=comments><p>Nice one, reader comment that is rather long and goes on and on</p></section><footer>&copy; us</footer></body></html>"
    )
    want = "Head The first paragraph has words, and more & more. Next The second paragraph is long enough to be the text of it."
    assert html_density.extract(page) == want
    plain = f"<body><div class=menu><a href=1>one</a> <a href=2>two</a></div><div><div><h2>Head</h2>{body}</div></div></body>"
    assert html_density.extract(plain) == want
    assert html_density.extract(None) == html_density.extract("") == html_density.extract("<html></html>") == ""
    assert html_density.extract("<p>just words") == "just words"
    assert html_density.extract("<div>" * 3000 + "deep") == "deep"


def html_part(seed, n=5):
    rng = random.Random(seed)
    return [" ".join(prose(rng, 100).split()) for _ in range(n)]


def html_tags(texts, tag="p"):
    return "".join(f"<{tag}>{t}</{tag}>" for t in texts)


MENU = "<ul class=nav>" + "".join(f"<li><a href={i}>item {i}</a></li>" for i in range(12)) + "</ul>"


def test_text_in_named_wrappers():
    text = html_part(1)
    for named in ("content no-sidebar", "layout with-sidebar", "elementor-widget elementor-widget-text-editor", "widget", "site related", "share"):
        crumbs = "<div class=widget>Subscribe now</div><div class='comment-list'>nice page</div>"
        assert html_density.extract(f'<body>{MENU}<div class="{named}">{html_tags(text)}</div>{crumbs}</body>') == " ".join(text)
        inside = f"<article><h1>Head</h1>{html_tags(text[:1])}</article><div class=sidebar>{html_tags(html_part(2))}</div>"
        assert html_density.extract(f'<body>{MENU}<div class="{named}">{inside}</div></body>') == "Head " + text[0]
    short = "<div class=ad>Longer than the article itself, by far.</div><article><h1>Head</h1><p>Short.</article>"
    assert html_density.extract(f"<body>{MENU}{short}</body>") == "Head Short."
    split = "".join(f"<div class=widget>{html_tags(html_part(i))}</div>" for i in range(3))
    assert html_density.extract(f"<body>{MENU}{split}</body>") == " ".join(" ".join(html_part(i)) for i in range(3))


def test_text_in_several_parts():
    one, two, three = html_part(1), html_part(2), html_part(3, 7)
    for tag in ("div", "section"):
        for page in ("<body>{}</body>", "<body><div id=page>{}</div></body>"):
            parts = f"<h2>Head</h2><{tag}>{html_tags(one)}</{tag}><h3>Middle</h3><{tag}>{html_tags(two)}</{tag}><{tag}>{html_tags(three)}</{tag}>"
            got = html_density.extract(page.format(f"{MENU}{parts}<div>Other footer words</div>"))
            assert got == " ".join(["Head", *one, "Middle", *two, *three])


def test_pages(spark):
    p = spark.createDataFrame([(1, "u", "<article><p>a b</p></article>", 5), (2, None, None, 5), (1, "u", "<p>x", 5)], "page_id long, url string, html string, n_chars int")
    assert sorted((r["page_id"], r["text"], r["n_chars"]) for r in html_density.extract_pages(p).collect()) == [(1, "a b", 3), (1, "x", 1), (2, "", 0)]
    assert html_density.extract_pages(p.limit(0)).count() == 0


# ---- 6 ----------------------------------------------------------------------------------------


def test_packing(docs, none):
    t, rows = tokenizer(BYTE_BPE), corpus()
    made = hilbert_pack.pack(docs, BYTE_BPE)
    pieces = made.collect()
    ids = {r[0]: [*t.encode(r[1] or "", add_special_tokens=False).ids, 0] for r in rows}
    copies = Counter(r[0] for r in rows)
    for i, want in ids.items():
        own = sorted((p["start"], p["ids"]) for p in pieces if p["doc_id"] == i)
        if copies[i] == 1:
            assert b"".join(x for _, x in own) == np.array(want, "<u4").tobytes()
        assert sum(len(x) for _, x in own) == 4 * len(want) * copies[i]
    seqs = {}
    for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])):
        assert p["offset"] == seqs.get(p["sequence_id"], 0)
        seqs[p["sequence_id"]] = p["offset"] + p["piece_length"]
    assert max(seqs.values()) <= 1024 and sum(v != 1024 for v in seqs.values()) <= 1
    out = hilbert_pack.sequences(made).collect()
    assert sum(r["n_tokens"] for r in out) == sum(seqs.values()) and all(len(r["input_ids"]) == 4 * r["n_tokens"] for r in out)
    assert hilbert_pack.pack(none, BYTE_BPE).count() == 0


def test_hilbert_curve_visits_neighbours():
    side = 4
    points = np.array([(a, b, c) for a in range(side) for b in range(side) for c in range(side)])
    keys = hilbert_pack.hilbert_keys(points, bits=2)
    assert sorted(keys) == list(range(side**3))
    steps = np.abs(np.diff(points[np.argsort(keys)], axis=0)).sum(1)
    assert (steps == 1).all()


# ---- 7 ----------------------------------------------------------------------------------------


def test_chat_round_trip(spark):
    nasty = ["<|im_end|>", "<\\|im_start|>", "a<\\\\|b", "", None, "x\ny", "<<||>>", "\\"]
    rows = [(1, i, ["user", "assistant"][i % 2], t, "extra") for i, t in enumerate(nasty)]
    rows += [(2, 0, "we%ird\nrole<|im_end|>", "t", "e"), (3, 0, None, "only", "e"), (None, 0, "assistant", "n", "e"), (4, 0, "user", "same", "e"), (4, 0, "user", "same", "e")]
    f = chat_prefix.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, pos string"))
    back = {(r["conv_id"], r["pos"]): r for r in chat_prefix.read_back(f).collect()}
    for i, t in enumerate(nasty):
        assert back[1, i]["text"] == (t or "") and back[1, i]["role"] == ["user", "assistant"][i % 2]
        assert back[1, i]["loss_text"] == ((t or "") if i % 2 else None)
        assert back[1, i]["formatted"].count("<|") == 2
    assert back[2, 0]["role"] == "we%ird\nrole<|im_end|>" and back[3, 0]["role"] == ""
    got = {r["conv_id"]: r for r in chat_prefix.conversation_digests(f).collect()}
    assert got[4]["n_turns"] == 2 and got[3]["n_examples"] == 0 and got[None]["loss_chars"] == 1
    loss = "".join(t or "" for t in nasty[1::2])
    assert got[1]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest() and got[1]["n_examples"] == 4
    texts = chat_prefix.example_texts(f).filter("conv_id = 1").collect()
    assert len(texts) == 4 and sum(len(r["text"]) for r in texts) == got[1]["example_chars"]
    assert all(chat_prefix.END not in r["text"][r["loss_start"] : r["loss_end"]] for r in texts)
    assert chat_prefix.conversation_digests(f.limit(0)).count() == 0


# ---- 8 ----------------------------------------------------------------------------------------


def test_language(spark, none):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    extra = spark.createDataFrame([(10_001, None, "en"), (10_002, "12 %% 3", "en"), (10_003, "", None)], d.schema)
    got = {r["doc_id"]: r for r in string_kernel.identify(d.unionByName(extra)).collect()}
    truth = {r["doc_id"]: r["lang"] for r in d.collect()}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i]["held_out"] == (i in held) for i in truth)
    assert sum(got[i]["lang_pred"] == truth[i] for i in held if truth[i]) >= 0.95 * len(held)
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (10_001, 10_002, 10_003))
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert string_kernel.identify(none).count() == 0
    no_labels = string_kernel.identify(d.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in no_labels.collect()} == {"und"}


def test_language_letters_beyond_the_basic_plane():
    assert string_kernel.grams(chr(0x1F600) * 9 + " 12 %" + chr(0x1D7D8)) is None  # emoji, digits and signs
    assert string_kernel.grams(chr(0x20000) * 3) is not None  # an ideograph is a letter
    assert string_kernel.grams("one" + chr(0x1F600) + "two").tolist() == string_kernel.grams("one two").tolist()


# ---- 9, 10 ------------------------------------------------------------------------------------


def nasty_texts():
    rng = random.Random(4)
    pool = "aé'sS \n\tΣσ½3北😀.,!<|>İ́‍"
    made = ["".join(rng.choice(pool) for _ in range(rng.randint(1, 30))) for _ in range(300)]
    return made + ["", "  ", "a" * 700, "!?" * 300, "x <|endoftext|>y<|startoftext|>", "l'école we'LL", "a\tb\x85c\x1cd \r\n"]


def test_encoders_equal_the_library():
    words, tw, tb = rank_bpe.RankBpe(WORD_BPE), tokenizer(WORD_BPE), tokenizer(BYTE_BPE)
    lib_w, lib_b = TextEncoder(WORD_BPE), TextEncoder(BYTE_BPE, cache=50)
    for t in nasty_texts():
        ids = tw.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(words.encode(t), "<u4").tolist() == ids == np.frombuffer(lib_w.encode(t), "<u4").tolist(), repr(t)
        assert words.decode(words.encode(t)) == tw.decode(ids, skip_special_tokens=False)
        assert np.frombuffer(lib_b.encode(t), "<u4").tolist() == tb.encode(t, add_special_tokens=False).ids, repr(t)


def test_bpe_table(docs, none):
    t = tokenizer(WORD_BPE)
    got = rank_bpe.digests(docs, WORD_BPE).collect()
    want = {r[0]: t.encode(r[1] or "", add_special_tokens=False).ids for r in corpus()}
    assert len(got) == len(corpus())
    for r in got:
        assert r["n_tokens"] == len(want[r["doc_id"]])
        assert r["ids_sha256"] == hashlib.sha256(np.array(want[r["doc_id"]], "<u4").tobytes()).hexdigest()
    assert rank_bpe.digests(none, WORD_BPE).count() == 0 == rank_bpe.encode_documents(none, WORD_BPE).count()


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_token_files(spark, docs, none, tmp_path, encoding):
    import pyarrow.parquet as pq

    out, t, rows = str(tmp_path / "t"), tokenizer(WORD_BPE), sorted(corpus(), key=lambda r: r[0])
    token_parquet.write_tokens(docs, out, WORD_BPE, encoding=encoding, files=5)
    got = token_parquet.read_tokens(spark, out).orderBy("start").collect()
    at = 0
    for r, w in zip(got, rows, strict=True):
        assert (r["doc_id"], r["start"], list(r["ids"])) == (w[0], at, [*t.encode(w[1] or "", add_special_tokens=False).ids, 2])
        at += r["n_tokens"]
    files = sorted(tmp_path.glob("t/*.parquet"))
    columns = [c for f in files for g in range(pq.read_metadata(f).num_row_groups) for c in [pq.read_metadata(f).row_group(g).column(3)]]
    assert columns and all(("RLE_DICTIONARY" in c.encodings or "PLAIN_DICTIONARY" in c.encodings) == (encoding == "dictionary") for c in columns if c.num_values)
    assert any("DELTA_BINARY_PACKED" in c.encodings for c in columns) == (encoding == "delta")
    assert all(c.has_offset_index for c in columns)
    assert {r["doc_id"] for r in token_parquet.read_range(spark, out, 3, 5).collect()} == {3, 4, 5}
    token_parquet.write_tokens(none, str(tmp_path / "e"), WORD_BPE)
    assert token_parquet.read_tokens(spark, str(tmp_path / "e")).count() == 0
