"""Line dedup by a fixed-depth template tree (DataFrame functions only).

A line is cut into tokens and every token with a digit becomes ``<*>``. Its leaf in the tree is
(token count, first ``DEPTH`` tokens). In a leaf the line found in most documents is the pivot;
lines that agree with it in at least ``SIM_PERCENT`` of all positions, and in ``MIN_AGREE``
positions beyond the leading ones, share its template, whose differing positions are variable.
Other lines are templates of their own. A template found in at least ``MIN_DOCS`` documents
recurs: its lines are dropped everywhere but in the document of the smallest id that has it.

What is shuffled is 24-byte line keys; text moves only for the distinct lines of leaves that
hold several variants, and once to rebuild the documents.

Defined results: null text is the empty text; lines of fewer than ``MIN_TOKENS`` tokens stay;
copies of a line within the first document stay; rows of one doc_id are one document; rows with
a null doc_id stay whole; other columns pass through ``drop_lines`` untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS, WS_CHARS, broadcast_if_small, free_prefix, let, stage, unstage

DEPTH = 3
MIN_TOKENS = 3
MIN_DOCS = 3
SIM_PERCENT = 70
MIN_AGREE = 4
#: Broadcast bound, in rows of about 40 bytes.
BROADCAST_ROWS = 500_000


def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(WS_CHARS))


def _single_spaced(trimmed: Column) -> Column:
    uneven = F.contains(trimmed, F.lit("  "))
    for c in WS_CHARS.strip(" "):
        uneven = uneven | F.contains(trimmed, F.lit(c))
    return F.when(uneven, F.regexp_replace(trimmed, WS, " ")).otherwise(trimmed)


def _digits_masked(plain: Column) -> Column:
    # tries each token once from its start, so it is linear in the line
    return F.when(F.rlike(plain, F.lit("[0-9]")), F.regexp_replace(plain, r"(?<![^ ])[^ 0-9]*+[0-9][^ ]*+", "<*>")).otherwise(plain)


def masked(line: Column) -> Column:
    """Line with single spaces, and ``<*>`` for every token that holds a digit. Lines that are
    single-spaced, or hold no digit, skip the replacement that would leave them as they are."""
    return _digits_masked(_single_spaced(_trimmed(line)))


def line_keys(docs: DataFrame) -> DataFrame:
    """doc_id, pos, leaf and the 128-bit key (h1, h2) of every line that is long enough."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    # masked before the rows are made: the filter on the count below would repeat it per line.
    # The array is never empty; the outer form only keeps Spark from testing that beforehand.
    for step in (_trimmed, _single_spaced, _digits_masked):
        lines = F.transform(lines, step)
    m = docs.select("doc_id", F.posexplode_outer(lines).alias("pos", "m"))
    t = m.withColumn("n", F.length("m") - F.length(F.replace(F.col("m"), F.lit(" "), F.lit(""))) + 1)
    lead = F.substring_index("m", " ", DEPTH)
    return t.filter(F.col("n") >= MIN_TOKENS).select(
        "doc_id",
        "pos",
        F.xxhash64(F.lit(0), "n", lead).alias("leaf"),
        F.xxhash64(F.lit(1), "m").alias("h1"),
        F.xxhash64(F.lit(2), "m").alias("h2"),
    )


def templates(docs: DataFrame) -> DataFrame:
    """(leaf, h1, h2) -> template (t1, t2) for the lines of all templates that may recur."""
    keys = line_keys(docs)
    stats = stage(
        keys.groupBy("leaf", "h1", "h2").agg(F.count_distinct("doc_id").alias("docs"), F.min(F.struct("doc_id", "pos")).alias("first")),
        "line-stats",
    )
    best = F.struct(F.col("docs").alias("docs"), (-F.col("first.doc_id")).alias("d"), (-F.col("first.pos")).alias("p"))
    leaves = stats.groupBy("leaf").agg(
        F.sum("docs").alias("total"),
        F.count(F.lit(1)).alias("variants"),
        F.max_by(F.struct("h1", "h2"), best).alias("pivot"),
    )
    several = leaves.filter((F.col("variants") > 1) & (F.col("total") >= MIN_DOCS)).select("leaf", "pivot")
    variants = stats.join(several, "leaf").select(
        "leaf", "h1", "h2", F.col("first.doc_id").alias("doc_id"), F.col("first.pos").alias("pos"),
        ((F.col("h1") == F.col("pivot.h1")) & (F.col("h2") == F.col("pivot.h2"))).alias("is_pivot"),
    )
    where = variants.groupBy("doc_id").agg(F.collect_list(F.struct("pos", "leaf", "h1", "h2", "is_pivot")).alias("at"))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(where, "doc_id")
    # a line key fixes its tokens, so of repeated rows of a document any one will do
    shown = (
        texts.select(F.split("text", "\n").alias("lines"), F.explode("at").alias("x"))
        .select("x.*", F.split(masked(F.get("lines", F.col("x.pos"))), " ").alias("tokens"))
    )
    shown = stage(shown, "line-variants")
    pivots = shown.filter("is_pivot").select("leaf", F.col("tokens").alias("pivot_tokens")).dropDuplicates(["leaf"])
    agree = F.size(F.filter(F.zip_with("tokens", "pivot_tokens", lambda a, b: a == b), lambda x: x))
    alike = shown.join(pivots, "leaf").filter((agree >= DEPTH + MIN_AGREE) & (100 * agree >= SIM_PERCENT * F.size("tokens")))
    alike = alike.select("leaf", "h1", "h2").distinct().withColumn("alike", F.lit(True))
    of = stats.select("leaf", "h1", "h2", "docs").join(alike, ["leaf", "h1", "h2"], "left")
    of = of.select(
        "leaf", "h1", "h2", "docs",
        F.when(F.col("alike"), F.col("leaf")).otherwise(F.col("h1")).alias("t1"),
        F.when(F.col("alike"), F.lit(0).cast("long")).otherwise(F.col("h2")).alias("t2"),
    )
    # at most `docs` documents a line: templates whose lines sum to fewer cannot recur
    may = of.groupBy("t1", "t2").agg(F.sum("docs").alias("total")).filter(F.col("total") >= MIN_DOCS).select("t1", "t2")
    out = stage(of.join(may, ["t1", "t2"]).select("leaf", "h1", "h2", "t1", "t2"), "line-templates")
    unstage(stats, shown)
    return out


def dropped_lines(docs: DataFrame) -> DataFrame:
    """doc_id, dropped: positions of the lines that go (only documents that lose some)."""
    member = broadcast_if_small(templates(docs), BROADCAST_ROWS)
    found = stage(line_keys(docs).join(member, ["leaf", "h1", "h2"]).select("doc_id", "pos", "t1", "t2"), "line-found")
    recurring = found.groupBy("t1", "t2").agg(F.count_distinct("doc_id").alias("docs"), F.min("doc_id").alias("first_doc"))
    # narrow rows, one a template: small enough to be sent to all tasks, or a join that can split
    recurring = broadcast_if_small(stage(recurring.filter(F.col("docs") >= MIN_DOCS), "line-recurring"), BROADCAST_ROWS)
    gone = found.join(recurring, ["t1", "t2"]).filter(F.col("doc_id") > F.col("first_doc"))
    return gone.groupBy("doc_id").agg(F.collect_set("pos").alias("dropped"))


def drop_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with its recurring lines gone from ``text``, plus _n_lines and _n_dropped. A
    non-null text that loses nothing comes back as it was."""
    prefix = free_prefix(docs.columns)
    key, dropped = prefix + "id", prefix + "dropped"
    gone = dropped_lines(docs).select(F.col("doc_id").alias(key), F.col("dropped").alias(dropped))
    d = docs.join(gone, docs["doc_id"] == gone[key], "left").drop(key)
    lines = F.split("text", "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), dropped)  # by hash: linear in the lines
    left = let(lines, lambda own: F.array_join(F.transform(kept, lambda i: F.get(own, i)), "\n"))
    return (
        d.withColumn("_n_lines", F.coalesce(F.size(F.split(F.coalesce("text", F.lit("")), "\n")), F.lit(0)).cast("long"))
        .withColumn("text", F.when(F.col(dropped).isNull(), F.col("text")).otherwise(left))
        .withColumn("_n_dropped", F.coalesce(F.size(dropped), F.lit(0)).cast("long"))
        .drop(dropped)
    )
