"""Document fingerprints as invertible Bloom lookup sketches (DataFrame functions only).

A text's paragraphs (lines that hold more than white space) are hashed to 64-bit keys; the n-th
copy of a paragraph has a key of its own. A sketch has ``CELLS`` cells in three sub-tables; a key
goes to one cell of each and adds to its count, key sum (xor) and check sum (xor). Sketches of
two versions subtract cell by cell; keys in both cancel, and peeling takes keys out of cells that
hold one, until none is left. If that stops early, the keys are dealt over four times as many
segments with a sketch each (and other hash values) and tried again; beyond ``LEVELS`` retries
the difference is taken from the key arrays themselves.

Defined results: null text is the empty text; a text without paragraphs has the empty sketch, and
two such texts have likeness 1; repeated rows each get a row, ordered by text among equal ids; a
single document is its own next; a null doc_id counts as the smallest; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WS_CHARS, let

SLOTS = 6
CELLS = 3 * SLOTS
LEVELS = 5
GROWTH = 4
PEEL_ROUNDS = 24
#: Documents in one ordered run, and the largest number of runs.
RUN_ROWS, MAX_RUNS, EDGES = 1000, 50_000, 100


def _long(x) -> Column:
    return F.lit(x).cast("long")


def paragraph_keys(text: Column) -> Column:
    """Sorted hashes of all paragraphs; equal ones are told apart by their ordinal. Equal hashes
    are a run, so a copy finds its ordinal by halving steps back, not by a scan of the array."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(WS_CHARS)) != "")
    hashes = F.sort_array(F.transform(lines, lambda x: F.xxhash64(x)))
    steps = F.array(*[F.lit(1 << j) for j in range(30, -1, -1)])

    def ordinal(s, x, i):
        back = F.aggregate(steps, F.lit(0), lambda t, j: F.when((t + j <= i) & (F.get(s, i - t - j) == x), t + j).otherwise(t))
        return F.when((i > 0) & (F.get(s, i - 1) == x), back).otherwise(F.lit(0))

    return let(hashes, lambda s: F.transform(s, lambda x, i: F.xxhash64(x, ordinal(s, x, i).cast("long"))))


def _placed(keys: Column, level: int) -> Column:
    """(key, check, cell of each sub-table) of every key."""
    slot = lambda k, j: (F.pmod(F.xxhash64(F.lit(level), F.lit(j), k), F.lit(SLOTS)) + j * SLOTS).cast("int")
    return F.transform(keys, lambda k: F.struct(k.alias("k"), _check(k).alias("h"), *[slot(k, j).alias(f"p{j}") for j in range(3)]))


def _check(key: Column) -> Column:
    return F.xxhash64(F.lit("check"), key)


def _zero_cell() -> Column:
    return F.struct(_long(0).alias("c"), _long(0).alias("k"), _long(0).alias("h"))


def sketch(placed: Column) -> Column:
    """The ``CELLS`` cells (count, key sum, check sum) of placed keys."""

    def sub_table(j):
        def cell(c):
            add = lambda a, x: F.struct((a["c"] + 1).alias("c"), a["k"].bitwiseXOR(x["k"]).alias("k"), a["h"].bitwiseXOR(x["h"]).alias("h"))
            return F.aggregate(placed, _zero_cell(), lambda a, x: F.when(x[f"p{j}"] == c, add(a, x)).otherwise(a))

        return F.transform(F.sequence(F.lit(j * SLOTS), F.lit((j + 1) * SLOTS - 1)), cell)

    return F.concat(*[sub_table(j) for j in range(3)])


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(
        a, b, lambda x, y: F.struct((x["c"] - y["c"]).alias("c"), x["k"].bitwiseXOR(y["k"]).alias("k"), x["h"].bitwiseXOR(y["h"]).alias("h"))
    )


def peel(cells: Column, level: int) -> Column:
    """struct(cells, found): ``found`` holds (key, +1 only in the first, -1 only in the second).
    Peeling succeeded if the cells left are all zero."""
    empty = F.array().cast("array<struct<k:bigint,c:bigint>>")

    def pure(s):
        one = F.filter(s["cells"], lambda x: (F.abs(x["c"]) == 1) & (x["h"] == _check(x["k"])))
        return F.array_distinct(F.transform(one, lambda x: F.struct(x["k"].alias("k"), x["c"].alias("c"))))

    def remove(s, keys):
        at = _placed(F.transform(keys, lambda x: x["k"]), level)
        signed = F.zip_with(at, keys, lambda p, x: F.struct(p["k"], p["h"], p["p0"], p["p1"], p["p2"], x["c"].alias("c")))

        def less(x, i, placed):
            take = lambda a, p: F.struct((a["c"] - p["c"]).alias("c"), a["k"].bitwiseXOR(p["k"]).alias("k"), a["h"].bitwiseXOR(p["h"]).alias("h"))
            here = lambda p: (p["p0"] == i) | (p["p1"] == i) | (p["p2"] == i)
            return F.aggregate(placed, x, lambda a, p: F.when(here(p), take(a, p)).otherwise(a))

        cells_left = let(signed, lambda placed: F.transform(s["cells"], lambda x, i: less(x, i, placed)))
        return F.struct(cells_left.alias("cells"), F.concat(s["found"], keys).alias("found"), F.lit(True).alias("more"))

    def step(s, _):
        stop = F.struct(s["cells"].alias("cells"), s["found"].alias("found"), F.lit(False).alias("more"))
        return F.when(s["more"], let(pure(s), lambda keys: F.when(F.size(keys) > 0, remove(s, keys)).otherwise(stop))).otherwise(s)

    start = F.struct(cells.alias("cells"), empty.alias("found"), F.lit(True).alias("more"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(PEEL_ROUNDS)), start, step)


def _emptied(peeled: Column) -> Column:
    return F.forall(peeled["cells"], lambda x: (x["c"] == 0) & (x["k"] == 0) & (x["h"] == 0))


def _segments(keys: Column, level: int) -> Column:
    """The keys dealt over 4^level segments, four ways at a time, so that a key is looked at four
    times a level and not once a segment."""
    if level == 0:
        return F.array(keys)

    def deal(part, left):
        digit = lambda k: F.pmod(F.shiftright(F.xxhash64(F.lit("segment"), F.lit(level), k), 2 * left), F.lit(GROWTH))
        parts = F.transform(F.sequence(F.lit(0), F.lit(GROWTH - 1)), lambda s: F.filter(part, lambda k: digit(k) == s))
        return parts if left == 0 else F.flatten(F.transform(parts, lambda p: deal(p, left - 1)))

    return deal(keys, level - 1)


def _attempt(a: Column, b: Column, level: int, cells: tuple[Column, Column] | None = None) -> Column:
    """Differing keys with sign, or null if some segment did not peel. ``cells``: the sketches of
    the first level, if they are known."""
    none = F.lit(None).cast("array<struct<k:bigint,c:bigint>>")
    if level == 0:
        x, y = cells or (sketch(_placed(a, 0)), sketch(_placed(b, 0)))
        return let(peel(subtract(x, y), 0), lambda p: F.when(_emptied(p), p["found"]).otherwise(none))

    def segment(acc, xy):
        p = peel(subtract(sketch(_placed(xy["x"], level)), sketch(_placed(xy["y"], level))), level)
        return F.when(acc.isNull(), none).otherwise(let(p, lambda x: F.when(_emptied(x), F.concat(acc, x["found"])).otherwise(none)))

    start = F.array().cast("array<struct<k:bigint,c:bigint>>")
    pairs = F.zip_with(_segments(a, level), _segments(b, level), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    return F.aggregate(pairs, start, segment)


def difference(a: Column, b: Column, cells: tuple[Column, Column] | None = None) -> Column:
    """Keys that only one of two key arrays has, as (key, sign), by subtracting and peeling their
    sketches, larger ones on failure. ``a``, ``b`` and ``cells`` should be plain columns."""
    gap = F.abs(F.size(a) - F.size(b))
    tries = [F.when(gap <= CELLS * GROWTH**level, _attempt(a, b, level, cells)) for level in range(LEVELS)]
    sign = lambda keys, c: F.transform(keys, lambda k: F.struct(k.alias("k"), _long(c).alias("c")))
    return F.coalesce(*tries, F.concat(sign(F.array_except(a, b), 1), sign(F.array_except(b, a), -1)))


def likeness(a: Column, b: Column, cells: tuple[Column, Column] | None = None) -> Column:
    """Jaccard likeness of two key arrays from the recovered difference (1 for two empty ones)."""
    both = F.size(a) + F.size(b)
    d = F.size(difference(a, b, cells))
    return F.when(both == 0, F.lit(1.0)).otherwise(let(d, lambda x: (both - x) / (both + x)).cast("double"))


def fingerprint(keys: Column, cells: Column | None = None) -> Column:
    """The first-level sketch as text: key count, then count.keys.checks of every cell in hex."""
    cells = sketch(_placed(keys, 0)) if cells is None else cells
    cell = lambda x: F.concat_ws(".", F.hex(x["c"]), F.hex(x["k"]), F.hex(x["h"]))
    return F.lower(F.concat(F.hex(F.size(keys).cast("long")), F.lit(":"), F.array_join(F.transform(cells, cell), " ")))


def with_next(docs: DataFrame, made: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, text, next_text: the text of the next document by descending id, after the last
    the first; and the same two columns for each of ``made``, columns of text. Rows are dealt into runs of neighbouring ids; each run also gets the first row of
    the run below it, so that one shuffle and a window inside each run are enough."""
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("doc_id", _long(-(2**63))).alias("_k"))
    own_cols = ["text", *(made or {})]
    shown = ["doc_id", *own_cols]
    shares = [i / EDGES for i in range(EDGES + 1)]
    seen = d.agg(F.percentile_approx("_k", shares, 1000).alias("e"), F.count(F.lit(1)).alias("n")).collect()[0]
    for name, column in (made or {}).items():  # one after the other: a later one may read an earlier one
        d = d.withColumn(name, column)
    if not seen["n"]:
        return d.select(*shown, *[F.col(c).alias(f"next_{c}") for c in own_cols])
    edges = sorted(set(seen["e"]))
    fine = max(1, min(MAX_RUNS, seen["n"] // RUN_ROWS) // EDGES)
    below = F.array(*[_long(e) for e in edges])
    # the run: number of edges up to the id, then even parts between two edges; it grows with the id
    i = F.size(F.filter(below, lambda e: e <= F.col("_k")))
    lo = F.coalesce(F.get(below, F.col("_i") - 1), F.col("_k")).cast("double")
    hi = F.coalesce(F.get(below, F.col("_i")), F.col("_k") + 1).cast("double")
    part = F.least(F.lit(fine - 1), F.greatest(F.lit(0), F.floor((F.col("_k").cast("double") - lo) / F.greatest(hi - lo, F.lit(1.0)) * fine)))
    d = d.withColumn("_i", i).withColumn("run", (F.col("_i") * fine + part).cast("long")).drop("_i")
    # at most MAX_RUNS and some rows
    tops = sorted((r["run"], r["m"]) for r in d.groupBy("run").agg(F.max("_k").alias("m")).collect())
    lent = [(tops[j][1], tops[(j + 1) % len(tops)][0]) for j in range(len(tops))]
    lend = F.broadcast(docs.sparkSession.createDataFrame(lent, "_top long, to_run long"))
    d = d.join(lend, F.col("_k") == F.col("_top"), "left")
    own = F.struct(F.col("run").alias("run"), F.lit(False).alias("lent"))
    also = F.struct(F.col("to_run").alias("run"), F.lit(True).alias("lent"))
    d = d.select(*shown, "_k", F.explode(F.when(F.col("to_run").isNull(), F.array(own)).otherwise(F.array(own, also))).alias("at"))
    d = d.select(*shown, "_k", "at.run", "at.lent")
    w = Window.partitionBy("run").orderBy("lent", F.desc("_k"), "text")
    nexts = {f"next_{c}": F.lead(c).over(w) for c in own_cols}
    return d.withColumns(nexts).filter(~F.col("lent")).select(*shown, *nexts)


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text (the second half replaced by the start of
    the next document), and their likenesses."""
    d = with_next(docs, {"a": paragraph_keys(F.col("text")), "sa": sketch(_placed(F.col("a"), 0))}).withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    kept = F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - half)
    d = d.withColumn("edited", F.concat(kept, F.substring(F.col("next_text"), F.lit(1), half)))
    d = d.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), paragraph_keys(F.col("edited")).alias("e"), "a", "sa", "next_a", "next_sa")
    d = d.withColumn("se", sketch(_placed(F.col("e"), 0)))
    a, e, x, sa, se, sx = (F.col(c) for c in ("a", "e", "next_a", "sa", "se", "next_sa"))
    return d.select(
        "doc_id", "n_chars", "edited_sha256", fingerprint(a, sa).alias("fingerprint"), fingerprint(e, se).alias("edited_fingerprint"),
        likeness(a, e, (sa, se)).alias("near_edited"), likeness(a, x, (sa, sx)).alias("near_next"), F.size("a").cast("long").alias("n_paragraphs"),
    )
