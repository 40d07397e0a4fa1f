"""Chat formatting by prefix-target expansion (DataFrame functions only).

Every assistant turn is exploded into a training example of its own: all turns before it are the
context, and only that reply carries loss. The stored output holds each formatted turn once, with
the length of its formatted prefix (``context_chars``); the examples are written out from it, one
row a target, and each is gone once it is read. A conversation of n turns repeats its prefix up to
n times: the time of reading all examples grows with the square of n, what is held at once is one
example and its conversation, at every size.

Defined results: null text or role is the empty string; turns are ordered by (turn, role, text),
nulls first; repeated rows are separate turns; a null conv_id is one conversation of its own;
a conversation without assistant turns gives context rows only; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import let

START, END = "<|im_start|>", "<|im_end|>"
TARGET_ROLE = "assistant"
#: None: every example is written out, whatever the input's size. A caller who sets a number asks for
#: target turns alone (their prefix being ``context_chars`` long) beyond so many characters of examples.
SPELLED_CHARS: int | None = None


def escape(text):
    """One backslash more between ``<`` and ``|``: no control string is left in the text."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text):
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def escape_role(role):
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def unescape_role(role):
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def format_turns(turns: DataFrame) -> DataFrame:
    """One row per turn: conv_id, pos, formatted, is_target, loss_start, loss_end (offsets in
    ``formatted``; null unless the turn is a target) and context_chars (length of all formatted
    turns before it; with is_target this row is the example)."""
    t = turns.select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    t = t.select(
        "conv_id",
        "turn",
        "role",
        "text",
        head.alias("head"),
        escape(F.col("text")).alias("body"),
    ).withColumn("formatted", F.concat("head", "body", F.lit(END + "\n")))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    target = F.col("role") == TARGET_ROLE
    return t.select(
        "conv_id",
        (F.row_number().over(order) - 1).alias("pos"),
        "formatted",
        target.alias("is_target"),
        F.when(target, F.length("head")).alias("loss_start"),
        F.when(target, F.length("head") + F.length("body")).alias("loss_end"),
        F.coalesce(F.sum(F.length("formatted").cast("long")).over(before), F.lit(0)).alias("context_chars"),
    )


def conversations(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (formatted turns in order with their loss offsets), formatted_chars,
    example_chars (of all its examples), targets (places of the target turns) and spelled (examples
    are written out: always, unless ``SPELLED_CHARS`` is set)."""
    turn = F.struct("pos", "formatted", "is_target", "loss_start", "loss_end", "context_chars")
    size = F.length("formatted").cast("long")
    g = formatted.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(turn)).alias("turns"), F.sum(size).alias("formatted_chars"),
        F.sum(F.when(F.col("is_target"), F.col("context_chars") + size).otherwise(0)).alias("example_chars"),
    )
    targets = F.transform(F.filter("turns", lambda x: x["is_target"]), lambda x: x["pos"])
    spelled = F.lit(True) if SPELLED_CHARS is None else F.col("example_chars") <= SPELLED_CHARS
    return g.withColumns({"targets": targets, "spelled": spelled})


def examples(chats: DataFrame) -> DataFrame:
    """The rows of ``conversations`` exploded, a row per target turn (one with null pos if there is
    none): pos, text (all turns before it, then the target turn), loss_start, loss_end (of the reply
    in ``text``)."""
    one = chats.select("*", F.explode_outer("targets").alias("pos")).withColumn("own", F.get("turns", F.col("pos")))
    whole = F.array_join(F.transform(F.slice("turns", F.lit(1), F.col("pos").cast("int") + 1), lambda x: x["formatted"]), "")
    shift = F.when(F.col("spelled"), F.col("own.context_chars")).otherwise(0)
    return one.select(
        *chats.columns, "pos", F.when(F.col("spelled"), whole).otherwise(F.col("own.formatted")).alias("text"),
        (shift + F.col("own.loss_start")).alias("loss_start"), (shift + F.col("own.loss_end")).alias("loss_end"),
    )


def example_texts(formatted: DataFrame) -> DataFrame:
    """The examples of ``format_turns``: conv_id, pos, text, loss_start, loss_end."""
    return examples(conversations(formatted)).filter("pos is not null").select("conv_id", "pos", "text", "loss_start", "loss_end")


def read_back(formatted: DataFrame) -> DataFrame:
    """Role and text parsed back out of each formatted turn, and the text under the loss mask."""
    inner = F.expr(f"substring(formatted, {len(START) + 1}, length(formatted) - {len(START) + len(END) + 1})")
    cut = F.expr("instr(inner, '\n')")
    loss = F.expr("substring(formatted, loss_start + 1, loss_end - loss_start)")
    return formatted.withColumn("inner", inner).select(
        "conv_id",
        "pos",
        "formatted",
        "context_chars",
        "is_target",
        unescape_role(F.substring(F.col("inner"), F.lit(1), cut - 1)).alias("role"),
        unescape(F.substring(F.col("inner"), cut + 1, F.length("inner"))).alias("text"),
        F.when(F.col("is_target"), unescape(loss)).alias("loss_text"),
    )


def _turn_text(formatted):
    """role, line end, text, line end: parsed back out of a formatted turn."""
    inner = F.substring(formatted, F.lit(len(START) + 1), F.length(formatted) - (len(START) + len(END) + 1))

    def parts(x):
        cut = F.instr(x, F.lit("\n"))
        role, text = F.substring(x, F.lit(1), cut - 1), F.substring(x, cut + 1, F.length(x))
        return F.concat(unescape_role(role), F.lit("\n"), unescape(text), F.lit("\n"))

    return let(inner, parts)


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """Per conversation, read back from the formatted turns and from the examples: turn count,
    digest of (role, text) in order, characters and digest under the loss masks, characters stored
    and characters of all examples."""
    turns = F.array_join(F.transform("turns", lambda x: _turn_text(x["formatted"])), "")
    chats = conversations(formatted).withColumns({"n_turns": F.size("turns").cast("long"), "turns_sha256": F.sha2(turns, 256)})
    loss = unescape(F.substring(F.col("text"), F.col("loss_start").cast("int") + 1, (F.col("loss_end") - F.col("loss_start")).cast("int")))
    keys = ["conv_id", "n_turns", "turns_sha256", "formatted_chars", "example_chars"]
    masked = examples(chats).select(*keys, "pos", loss.alias("loss"))
    g = masked.groupBy(*keys).agg(F.sort_array(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", "loss")))).alias("l"))
    texts = F.array_join(F.transform("l", lambda x: x["loss"]), "")
    return g.select(
        "conv_id", "n_turns", "turns_sha256", F.length(texts).cast("long").alias("loss_chars"), F.sha2(texts, 256).alias("loss_sha256"),
        "formatted_chars", F.size("l").cast("long").alias("n_examples"), "example_chars",
    )
