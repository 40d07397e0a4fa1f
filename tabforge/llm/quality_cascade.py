"""Quality rules as a short-circuit cascade (DataFrame functions only).

Each rule is a boolean rejection over a few text measures. Its cost (seconds per row) and
selectivity (share rejected) are measured on a bounded sample, and the rules run in the order of
rejections per second, each only on rows that the earlier ones kept (a chain of CASE branches).
The order changes the time alone: a document is kept when no rule rejects it.

Defined results: null or empty text has no words and is rejected (fewer than ``MIN_WORDS``);
repeated rows are judged separately; an empty table keeps the default order; extra columns pass
through ``quality_filter`` untouched.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS_CHARS, split_words

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MIN_MEAN_WORD, MAX_MEAN_WORD = 2, 15
MAX_SYMBOL_PERCENT = 30
MAX_DUP_LINE_PERCENT = 50
MAX_UPPER_PERCENT = 60
MAX_EXCLAIM_PERCENT = 30
#: Expected rows of the sample that costs and selectivities are measured on; no result depends on it.
#: Words up to which a window's hash and place share one number.
PACKED_WORDS = 1 << 15
SAMPLE_ROWS = 2000

SYMBOLS = "[#*$%&|<>]"


def with_words(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds _text (null: empty), _words and _n_words."""
    df = df.withColumn("_text", F.coalesce(F.col(text), F.lit("")))
    return df.withColumn("_words", split_words(F.col("_text"))).withColumn("_n_words", F.size("_words").cast("long"))


def word_chars() -> Column:
    return F.length(F.array_join("_words", "")).cast("long")


def n_symbols() -> Column:
    return F.regexp_count("_text", F.lit(SYMBOLS)).cast("long")


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(WS_CHARS)) != "")


def n_lines() -> Column:
    return F.size(_lines(F.col("_text"))).cast("long")


def n_dup_lines() -> Column:
    return F.expr("1") * F.get(
        F.transform(F.array(_lines(F.col("_text"))), lambda v: (F.size(v) - F.size(F.array_distinct(v))).cast("long")), F.lit(0)
    )


def n_repeat_words() -> Column:
    """Words inside 3-word windows found twice or more in the text. A window's hash and position
    are packed into one long (the position takes only the low bits that the text's length needs),
    sorted, and equal neighbours mark the positions: n log n on primitive longs. In a text of more
    than ``PACKED_WORDS`` words too few bits of the hash would be left, so there they are pairs."""
    n = F.col("_n_words")
    bits = F.ceil(F.log2(n + 1)).cast("int")
    packed = F.transform(
        F.sequence(F.lit(0), n.cast("int") - 3),
        lambda i: F.call_function("shiftleft", F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2)), bits).bitwiseOR(i.cast("long")),
    )
    hash_of = lambda x: F.call_function("shiftrightunsigned", x, bits)

    def positions(s):
        twin = lambda x, i, d: F.coalesce(hash_of(F.get(s, i + d)) == hash_of(x), F.lit(False))
        found = F.filter(s, lambda x, i: twin(x, i, -1) | twin(x, i, 1))
        mask = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1
        return F.sort_array(F.transform(found, lambda x: x.bitwiseAND(mask)))

    def covered(p):
        zero = F.struct(F.lit(0).cast("long").alias("c"), F.lit(-3).cast("long").alias("last"))
        step = lambda a, x: F.struct((a["c"] + F.least(F.lit(3).cast("long"), x - a["last"])).alias("c"), x.alias("last"))
        return F.aggregate(p, zero, step, lambda a: a["c"])

    pairs = F.transform(
        F.sequence(F.lit(0), n.cast("int") - 3),
        lambda i: F.struct(F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2)).alias("h"), i.cast("long").alias("p")),
    )

    def pair_positions(s):
        twin = lambda x, i, d: F.coalesce(F.get(s, i + d)["h"] == x["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(s, lambda x, i: twin(x, i, -1) | twin(x, i, 1)), lambda x: x["p"]))

    short = F.get(F.transform(F.array(F.sort_array(packed)), lambda s: covered(positions(s))), F.lit(0))
    long = F.get(F.transform(F.array(F.sort_array(pairs)), lambda s: covered(pair_positions(s))), F.lit(0))
    value = F.when(n <= PACKED_WORDS, short).otherwise(long)
    return F.when(n < 3, F.lit(0).cast("long")).otherwise(value)


@dataclass(frozen=True)
class Rule:
    """``rejects`` is a boolean over _text, _words and _n_words (or the measure columns given)."""

    name: str
    rejects: Column


def rules(measures: dict[str, Column] | None = None) -> list[Rule]:
    """The production rules. ``measures`` may name columns that already hold a measure."""
    m = {"word_chars": word_chars(), "n_symbols": n_symbols(), "n_dup_lines": n_dup_lines(), "n_repeat_words": n_repeat_words()} | (measures or {})
    n = F.col("_n_words")
    return [
        Rule("few_words", n < MIN_WORDS),
        Rule("word_length", (m["word_chars"] < MIN_MEAN_WORD * n) | (m["word_chars"] > MAX_MEAN_WORD * n)),
        Rule("symbols", 100 * m["n_symbols"] > MAX_SYMBOL_PERCENT * n),
        Rule("exclamations", 100 * F.regexp_count("_text", F.lit("!")) > MAX_EXCLAIM_PERCENT * n),
        Rule("upper_case", 100 * F.regexp_count("_text", F.lit(r"\p{Lu}")) > MAX_UPPER_PERCENT * F.length("_text")),
        Rule("dup_lines", 100 * m["n_dup_lines"] > MAX_DUP_LINE_PERCENT * n_lines()),
        Rule("repeated_windows", 100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * n),
    ]


def cascade_order(sample: DataFrame, candidates: list[Rule]) -> list[Rule]:
    """Rules by measured rejections per second of work, best first. ``sample`` holds the rules'
    input columns; each rule is run over it once alone and timed."""
    sample = sample.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        rows = sample.count()
        if not rows:
            return candidates
        t0 = time.perf_counter()
        sample.agg(F.count_if(F.col("_n_words") < 0)).collect()  # what a job costs besides the rule
        floor = time.perf_counter() - t0
        scored = []
        for k, r in enumerate(candidates):
            t0 = time.perf_counter()
            rejected = sample.agg(F.count_if(r.rejects).alias("n")).collect()[0]["n"]
            cost = max(time.perf_counter() - t0 - floor, 1e-3)
            scored.append((-(rejected / rows) / cost, cost, k))
        return [candidates[k] for _, _, k in sorted(scored)]
    finally:
        sample.unpersist()


def sampled(docs: DataFrame) -> DataFrame:
    """About ``SAMPLE_ROWS`` texts of the whole table, picked row by row (no shuffle)."""
    rows = docs.count()
    return docs.select("text").sample(fraction=min(1.0, SAMPLE_ROWS / max(rows, 1)), seed=11)


def verdict(ordered: list[Rule]) -> Column:
    """Name of the first rule that rejects, null if none does; later rules are not evaluated."""
    out = F.lit(None).cast("string")
    for r in reversed(ordered):
        out = F.when(r.rejects, F.lit(r.name)).otherwise(out)
    return out


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, all base measures, and the cascade's verdict as ``rejected_by``."""
    words = with_words(docs.select("doc_id", "text"))
    order = cascade_order(with_words(sampled(docs)), rules())
    names = ("word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    known = {r.name: r for r in rules({k: F.col(k) for k in names})}
    full = words.select(
        "doc_id", "_text", "_n_words", word_chars().alias("word_chars"), n_symbols().alias("n_symbols"),
        n_dup_lines().alias("n_dup_lines"), n_repeat_words().alias("n_repeat_words"),
    )
    failed = (F.col("_n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("_n_words"))
    return full.select(
        "doc_id", F.col("_n_words").alias("n_words"), *names, failed.alias("base_failed"),
        verdict([known[r.name] for r in order]).alias("rejected_by"),
    ).withColumn("kept", ~F.col("base_failed") & F.col("rejected_by").isNull())


def quality_filter(docs: DataFrame) -> DataFrame:
    """The documents that no rule rejects, all columns as they came."""
    order = cascade_order(with_words(sampled(docs)), rules())
    inner = with_words(docs.select(F.struct("*").alias("_row"), "text"))
    # as a generated column: a plain filter would be pushed below the words and split the text
    # again for every use of them
    judged = inner.select("_row", F.explode(F.array(verdict(order))).alias("_verdict"))
    return judged.filter(F.col("_verdict").isNull()).select("_row.*")
