"""Text column expressions (X1-X5, X7): regex rules and marker extraction, all
JVM-side (``rlike``, ``regexp_extract``, JSON path functions)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ordered, case-insensitive error rules (pattern, label).
ERROR_RULES = (
    (r"ChainedAssignment|column_setitem|_setitem_single_column", "pandas_copy_on_write"),
    (r"uniformly strings or numbers.*bool.*str|bool.*str.*uniformly", "mixed_bool_str"),
    (r"get_loc|KeyError", "missing_column"),
    (r"'<' not supported between instances of 'str' and 'bool'", "imputer_sort_mixed"),
    (r"X has \d+ features but \w+ is expecting \d+", "feature_count_mismatch"),
    (r"could not convert string to float", "categorical_not_encoded"),
    (r"Input contains NaN", "nan_not_imputed"),
)
UNKNOWN = "unknown"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_ws(c) -> Column:
    """Python-style strip of leading/trailing whitespace."""
    return F.regexp_replace(_c(c), r"^\s+|\s+\z", "")


def classify(c, rules=ERROR_RULES) -> Column:
    """Label of the first matching rule, else 'unknown'."""
    expr = F.lit(UNKNOWN)
    for pat, label in reversed(rules):
        expr = F.when(_c(c).rlike("(?i)" + pat), F.lit(label)).otherwise(expr)
    return expr


def extract_block(c, start: str, end: str) -> Column:
    """Stripped text between ``START\\n`` and ``END``; null when absent."""
    pat = "(?s)" + re.escape(start) + r"\n(.*?)" + re.escape(end)
    return F.when(_c(c).rlike(pat), strip_ws(F.regexp_extract(_c(c), pat, 1)))


def extract_code_block(c) -> Column:
    """First ```python fenced block, else first plain fenced block; stripped."""
    tagged = r"(?s)```python\s*\n(.*?)```"
    plain = r"(?s)```\s*\n(.*?)```"
    return F.when(_c(c).rlike(tagged), strip_ws(F.regexp_extract(_c(c), tagged, 1))).when(
        _c(c).rlike(plain), strip_ws(F.regexp_extract(_c(c), plain, 1))
    )


def extract_keyed_line(c, key: str) -> Column:
    """Value after ``KEY:`` up to the end of that line; null when absent."""
    pat = re.escape(key) + r":(.*?)(?:\n|$)"
    return F.when(_c(c).contains(key + ":"), strip_ws(F.regexp_extract(_c(c), pat, 1)))


def parse_numbers(c, sep: str = ",") -> Column:
    """X4 weights: list of numbers; null when any item is not a number."""
    items = F.transform(F.split(_c(c), re.escape(sep)), lambda x: strip_ws(x).try_cast("double"))
    return F.when(F.exists(items, lambda x: x.isNull()), F.lit(None)).otherwise(items)


def strip_fences(c) -> Column:
    """Drop a leading fence line and, when the last line is a fence, that line."""
    x = _c(c)
    no_head = F.regexp_replace(x, r"^```[^\n]*(\n|\z)", "")
    no_tail = F.regexp_replace(no_head, r"\n[ \t]*```[ \t]*\z", "")
    return F.when(x.startswith("```"), no_tail).otherwise(x)


def payload_after(c, key: str, until: str) -> Column:
    """Text after ``KEY:`` up to ``until`` (or the end), stripped (X7 input)."""
    pat = "(?s)" + re.escape(key) + ":(.*?)(?:" + re.escape(until) + r"|\z)"
    return F.when(_c(c).contains(key + ":"), strip_ws(F.regexp_extract(_c(c), pat, 1)))
