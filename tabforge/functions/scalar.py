"""Column expressions (JVM-side, codegen-friendly) for the scalar feature operators.

Each function returns a ``Column``; none of them needs a Python UDF.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference's for equal results.
NA_TOKEN = "__NA__"
BOOL_TF = ("true", "false")
BOOLISH_MAP = {"true": 1, "false": 0, "yes": 1, "no": 0, "1": 1, "0": 0}
AGE_LIKE_EDGES = (0.0, 12.0, 18.0, 35.0, 60.0, 200.0)


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def norm_text(c) -> Column:
    """lower(trim(cast(c as string)))."""
    return F.lower(F.trim(_c(c).cast("string")))


def hash_bucket(id_col, salt: str = "", digits: int = 8) -> Column:
    """Unsigned integer from the first ``digits`` hex digits of md5(salt || id)."""
    s = _c(id_col).cast("string")
    if salt:
        s = F.concat(F.lit(salt), s)
    return F.conv(F.substring(F.md5(s), 1, digits), 16, 10).cast("bigint")


def digest128(c) -> Column:
    """128-bit digest of a value (two 64-bit hashes) for exact-in-practice distinct counts
    without shuffling long texts; null stays null. The salt comes first: the hash folds over its
    arguments, so a salt behind the value would collide wherever the plain hash does."""
    x = _c(c)
    return F.when(x.isNotNull(), F.struct(F.xxhash64(x), F.xxhash64(F.lit("salt"), x)))


def to_number(c) -> Column:
    """number or null (ANSI-safe)."""
    return _c(c).cast("string").try_cast("double")


def split_part_or_null(c, sep: str, i: int) -> Column:
    """i-th (0-based) part of ``c`` split on a literal separator, null when absent."""
    return F.get(F.split(_c(c).cast("string"), _lit_regex(sep)), i)


def _lit_regex(sep: str) -> str:
    import re

    return re.escape(sep)


def split_composite(c, sep: str, names: list[str]) -> list[Column]:
    """``a/b/c`` -> named parts; a missing first part becomes ``__NA__``,
    absent later parts stay null."""
    out = []
    for i, n in enumerate(names):
        part = split_part_or_null(c, sep, i)
        if i == 0:
            part = F.coalesce(part, F.lit(NA_TOKEN))
        out.append(part.alias(n))
    return out


def group_key(c, sep: str) -> tuple[Column, Column]:
    """prefix of an id before ``sep`` as text and as number."""
    txt = F.substring_index(_c(c).cast("string"), sep, 1)
    return txt, txt.try_cast("double")


def row_total(cols) -> Column:
    """sum of measure columns, non-numbers and nulls count as 0."""
    return reduce(lambda a, b: a + b, [F.coalesce(_c(c).cast("string").try_cast("double"), F.lit(0.0)) for c in cols])


def any_flag(total) -> Column:
    """F7."""
    return (_c(total) > 0).cast("int")


def log1p(c) -> Column:
    """F8."""
    return F.log1p(_c(c))


def per_capita(total, size=None) -> Column:
    """total / group size; size 0 or absent counts as 1."""
    if size is None:
        return _c(total) / F.lit(1.0)
    return _c(total) / F.coalesce(F.nullif(_c(size), F.lit(0)), F.lit(1))


def bool_to_int(c) -> Column:
    """true -> 1, false -> 0 (any case, or a real boolean), else -1."""
    v = norm_text(c)
    return F.when(v == "true", 1).when(v == "false", 0).otherwise(-1)


def boolish_to_int(c) -> Column:
    """yes/no/true/false/1/0 -> 1/0, anything else (null included) -> -1."""
    v = norm_text(c)
    m = F.create_map(*[x for k, val in BOOLISH_MAP.items() for x in (F.lit(k), F.lit(val))])
    return F.coalesce(F.element_at(m, F.coalesce(v, F.lit(""))), F.lit(-1))


def inconsistency_flag(flag, total) -> Column:
    """1 when flag = 1 and total > 0."""
    return ((_c(flag) == 1) & (_c(total) > 0)).cast("int")


def interact(a, b, fill_value: float) -> Column:
    """a with nulls filled by a fitted value, times b."""
    return F.coalesce(_c(a), F.lit(float(fill_value))) * _c(b)


def interact_log(a, total, fill_value: float) -> Column:
    """filled a times log1p(total)."""
    return F.coalesce(_c(a), F.lit(float(fill_value))) * F.log1p(_c(total))


def cross_categories(a, b) -> Column:
    """``a_b`` with nulls as ``__NA__``."""
    return F.concat_ws("_", F.coalesce(_c(a).cast("string"), F.lit(NA_TOKEN)), F.coalesce(_c(b).cast("string"), F.lit(NA_TOKEN)))


def datetime_parts(c, prefix: str) -> list[Column]:
    """F16: year, month, day, hour, weekday (Monday = 0) of a text/timestamp column."""
    ts = _c(c) if not isinstance(c, str) else F.col(c)
    ts = F.try_to_timestamp(ts.cast("string"))
    return [
        F.year(ts).alias(f"{prefix}_year"),
        F.month(ts).alias(f"{prefix}_month"),
        F.dayofmonth(ts).alias(f"{prefix}_day"),
        F.hour(ts).alias(f"{prefix}_hour"),
        F.weekday(ts).alias(f"{prefix}_weekday"),
    ]


def last_token(c) -> Column:
    """last whitespace-separated word of a text."""
    toks = F.split(F.trim(_c(c)), r"\s+")
    return F.when(F.trim(_c(c)) == "", F.lit(None)).otherwise(F.element_at(toks, -1))


def bin_edges(c, edges=AGE_LIKE_EDGES) -> Column:
    """right-closed bins ``(e0,e1], (e1,e2], ...`` -> 0..k-1; outside -> null."""
    x = _c(c)
    expr = F.lit(None).cast("int")
    for i in range(len(edges) - 2, -1, -1):
        expr = F.when((x > edges[i]) & (x <= edges[i + 1]), F.lit(i)).otherwise(expr)
    return expr


def bin_equal_width(c, lo: float | None, hi: float | None, k: int = 10) -> Column:
    """F3 apply side: 0-based right-closed equal-width bin over a fitted [lo, hi];
    the lowest edge is widened as pandas does, so x == lo falls in bin 0.
    A constant column puts every value in the middle bin."""
    x = _c(c).cast("double")
    if lo is None or hi is None:
        return F.lit(None).cast("int")
    if hi == lo:
        return F.when(x.isNull(), F.lit(None).cast("int")).otherwise(F.lit(k // 2 - (1 if k % 2 == 0 else 0)))
    b = F.ceil((x - F.lit(float(lo))) / F.lit(float(hi - lo)) * F.lit(k)).cast("int") - 1
    # greatest() skips nulls, so a null value must be caught before it
    return F.when(x.isNull() | (x < lo) | (x > hi), F.lit(None).cast("int")).otherwise(F.greatest(F.lit(0), b))
