"""Cases that earlier versions of operators 1 to 10 got wrong."""

import random

import pytest
from pyspark.sql import functions as F

from tabforge.llm import chat_prefix, html_density, iblt, line_templates, ngram_join, quality_cascade, string_kernel, token_parquet

from .test_operators import WORD_BPE, prose

P = " ".join(f"This is sentence number {i} of the article body, long enough to count." for i in range(8))
ARTICLE = f"<h1>Title here</h1><p>{P}</p><p>{P}</p>"
TEXT = f"Title here {P} {P}"


@pytest.mark.parametrize(("html", "text"), [
    (f"<form id=form1 runat=server><div><p>{P}</p><p>{P}</p></div></form>", f"{P} {P}"),
    (f"<form id=form1><article>{ARTICLE}</article><label>Name</label><input><button>Send</button></form>", TEXT),
    (f"<div aria-hidden=true><article>{ARTICLE}</article></div>", TEXT),
    (f"<dialog open><main>{ARTICLE}</main></dialog>", TEXT),
    (f"<article>{ARTICLE}<p hidden>secret</p></article>", TEXT),
    (f"<article>{ARTICLE}</article><form>Sign up now <input></form>", TEXT),
    (f"<article>{ARTICLE}<ul><li><a href=a>One link</a></li><li><a href=b>Two link</a></li></ul><p>After.</p></article>", f"{TEXT} One link Two link After."),
    (f"<article>{ARTICLE}</article><ol class=commentlist><li>Nice post {P}</li><li>Bad post</li></ol>", TEXT),
    (f"<article>{ARTICLE}</article><!-- <div><p>raw markup</p></div>", TEXT),
    (f"<script>var a='<!--';</script><article>{ARTICLE}</article>", TEXT),
])
def test_main_text_keeps_articles_in_wrappers(html, text):
    assert html_density.extract(f"<html><body>{html}</body></html>") == text


def test_deep_pages_are_read_in_linear_time():
    import time

    took = []
    for n in (10_000, 40_000):
        t = time.process_time()
        html_density.extract("<html><body>" + "<div>" * n + "x" + "</div>" * n + "</body></html>")
        took.append(time.process_time() - t)
    assert took[1] < 12 * took[0] + 0.5


def test_densities_equal_a_plain_count():
    import math

    body = next(n for n in html_density._walk(html_density.parse(f"<html><body><div>{ARTICLE}<p>x <a href=u>link text</a></p></div><p>tail</p></body></html>")) if n.tag == "body")
    nodes = html_density.measure(body)

    def below(n):
        return [c for c in n.items if isinstance(c, html_density.Node)]

    def plain(n):
        kids = [plain(c) for c in below(n)]
        own = sum(len("".join(s.split())) for s in n.items if isinstance(s, str))
        chars, tags, lc, lt = (sum(k[i] for k in kids) for i in range(4))
        chars, tags = chars + own, tags + len(kids)
        lt += sum(c.tag == "a" for c in below(n))
        return chars, tags, chars if n.tag == "a" else lc, lt

    whole = plain(body)
    dens = {}
    for n in nodes:
        c, t, lc, lt = plain(n)
        base = math.log(c / max(c - lc, 1) * lc + whole[2] / whole[0] * c + math.e)
        dens[n] = c / max(t, 1) * math.log(max(c / max(lc, 1) * max(t, 1) / max(lt, 1), 1.0) + 1e-9) / base if c else 0.0
        assert (n.chars, n.tags, n.link_chars, n.link_tags) == (c, t, lc, lt) and math.isclose(n.density, dens[n], rel_tol=1e-12)
    for n in nodes:
        assert math.isclose(n.total, sum(dens[c] for c in below(n)), rel_tol=1e-12, abs_tol=1e-12)


def test_repeated_windows_of_long_texts(spark):
    n = quality_cascade.PACKED_WORDS + 500
    words = [f"w{i}" for i in range(n)]
    twice = [*words, *words[:5]]
    df = spark.createDataFrame([(0, " ".join(words)), (1, " ".join(twice)), (2, " ".join(twice[-20:] + words[:5]))], "doc_id long, text string")
    got = {r["doc_id"]: r["n_repeat_words"] for r in quality_cascade.measured(df).collect()}
    assert got == {0: 0, 1: 10, 2: 10}


def test_many_paragraphs_are_told_apart(spark):
    lines = [f"line {i}" for i in range(6000)] + ["same"] * 700 + ["other", "other"]
    random.Random(1).shuffle(lines)
    df = spark.createDataFrame([("\n".join(lines), "\n".join(lines[:-3] + ["new"]))], "x string, y string")
    r = df.select(iblt.paragraph_keys(F.col("x")).alias("a"), iblt.paragraph_keys(F.col("y")).alias("b")).select("a", "b", iblt.likeness(F.col("a"), F.col("b")).alias("l")).first()
    assert len(r["a"]) == len(set(r["a"])) == len(lines)
    both = len(set(r["a"]) & set(r["b"]))
    assert abs(r["l"] - both / len(set(r["a"]) | set(r["b"]))) < 1e-12 and both == len(lines) - 3


def test_starts_do_not_depend_on_the_rows_a_file_may_hold(spark, tmp_path):
    rng = random.Random(4)
    docs = spark.createDataFrame([(i, prose(rng, rng.randint(0, 30))) for i in range(300)], "doc_id long, text string")
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "40")
    try:
        token_parquet.write_tokens(docs, str(tmp_path / "t"), WORD_BPE, files=3)
        rows = token_parquet.read_tokens(spark, str(tmp_path / "t")).orderBy("doc_id").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    at = 0
    for r in rows:
        assert r["start"] == at
        at += r["n_tokens"]


def test_examples_of_long_chats_are_read_back_alike(spark, monkeypatch):
    rows = [(1, t, "user" if t % 2 else "assistant", f"text {t} <|im_end|>") for t in range(40)] + [(2, 0, "user", "no reply"), (3, 0, "assistant", "")]
    f = chat_prefix.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    spelled = sorted(map(tuple, chat_prefix.conversation_digests(f).collect()))
    texts = chat_prefix.example_texts(f).filter("conv_id = 1").orderBy("pos").collect()
    assert len(texts) == 20 and all(len(b["text"]) > len(a["text"]) and b["text"].startswith(a["text"]) for a, b in zip(texts, texts[1:], strict=False))
    monkeypatch.setattr(chat_prefix, "SPELLED_CHARS", 10)
    assert sorted(map(tuple, chat_prefix.conversation_digests(f).collect())) == spelled
    assert [r["text"].count(chat_prefix.START) for r in chat_prefix.example_texts(f).filter("conv_id = 1").collect()] == [1] * 20


def test_extra_columns_of_clashing_names_pass(spark):
    rng = random.Random(6)
    words = "der die das und ist ein nicht mit auf dem".split()
    rows = [(i, " ".join(rng.choice(words) for _ in range(80)), "de", "x", "y", 1, 2, 3, 4) for i in range(12)]
    rows += [rows[3][:1] + (rows[4][1],) + rows[3][2:]]  # a repeated id with another text
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, score string, _n int, _k1 int, _id int, _dropped int")
    assert string_kernel.in_learned_language(df).columns == df.columns
    assert ngram_join.keep_one(df).columns == df.columns
    out = line_templates.drop_lines(df)
    assert out.columns == [*df.columns, "_n_lines", "_n_dropped"] and out.count() == 13 and {r["_id"] for r in out.collect()} == {3}


def test_a_gram_of_very_many_documents_is_shared_without_a_count(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "COMMON", 3)
    rng = random.Random(7)
    base = prose(rng, 60)
    rows = [(i, base + " " + prose(rng, 4)) for i in range(8)] + [(50 + i, prose(rng, 40)) for i in range(6)]
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {got[i] for i in range(8)} == {0} and all(got[50 + i] == 50 + i for i in range(6))
