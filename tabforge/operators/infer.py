"""Task and column-role inference.

All decisions are taken from one small aggregate per table; the only data brought
to the driver are per-column summaries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabforge.functions.scalar import BOOL_TF, BOOLISH_MAP, _lit_regex, norm_text
from tabforge.operators.distinct import distinct_counts
from tabforge.session import fitted_table, ranked

BINARY, MULTICLASS, REGRESSION = "BINARY", "MULTICLASS", "REGRESSION"
# fixed values of the task rule
MAX_CLASSES = 25
ID_LIKE_SHARE = 0.97
ID_LIKE_MIN = 50
DATETIME_SHARE = 0.8
HIGH_CARD = 5


def detect_tasks(df: DataFrame, targets: dict[str, Column]) -> DataFrame:
    """I1 for several targets in one scan: a row (target, task, n_distinct, numeric_share) each.
    Distinct is over the lower-cased trimmed text; a null counts as one more label."""
    extra = []
    for i, y in enumerate(targets.values()):
        v = norm_text(y)
        extra += [
            F.max(v.isNull().cast("int")).alias(f"__z{i}"), F.avg(y.cast("string").try_cast("double").isNotNull().cast("double")).alias(f"__s{i}"),
            F.count_if(v.isNull() | ~v.isin(*BOOL_TF)).alias(f"__t{i}"),
        ]
    counts, r = distinct_counts(df, {name: norm_text(y) for name, y in targets.items()}, extra)
    rows = []
    for i, (name, n) in enumerate(counts.items()):
        n += r[f"__z{i}"] or 0
        task = BINARY if r[f"__t{i}"] == 0 or n == 2 else MULTICLASS if n <= MAX_CLASSES else REGRESSION
        rows.append((name, task, n, r[f"__s{i}"]))
    return df.sparkSession.createDataFrame(rows, "target string, task string, n_distinct long, numeric_share double")


def detect_task(df: DataFrame, y: str) -> DataFrame:
    """One row (task, n_distinct, numeric_share) of one target."""
    return detect_tasks(df, {y: F.col(y)}).drop("target")


def label_table(df: DataFrame, y: str) -> DataFrame:
    """(label, code, original) with codes 0.. in sorted label order over
    the distinct table only; ``original`` is the smallest raw spelling."""
    d = df.where(F.col(y).isNotNull()).groupBy(norm_text(y).alias("label")).agg(F.min(F.col(y).cast("string")).alias("original"))
    return ranked(d, [], "label", "code")


def encode_target(df: DataFrame, y: str, out: str = "y_code", task: str | None = None) -> DataFrame:
    """Classification -> 0-based code of the normalised label; regression -> number."""
    if task == REGRESSION:
        return df.withColumn(out, F.col(y).cast("string").try_cast("double"))
    t = fitted_table(label_table(df, y).select(F.col("label").alias("_lbl"), F.col("code").alias(out)))
    return df.withColumn("_lbl", norm_text(y)).join(t, "_lbl", "left").drop("_lbl")


def decode_predictions(pred: DataFrame, code_col: str, labels: DataFrame, out: str) -> DataFrame:
    """Code -> original-case label; an unknown code stays (as text)."""
    t = fitted_table(labels.select(F.col("code").alias("_code"), F.col("original").alias("_orig")))
    return (
        pred.join(t, pred[code_col] == F.col("_code"), "left")
        .withColumn(out, F.coalesce(F.col("_orig"), F.col(code_col).cast("string")))
        .drop("_code", "_orig")
    )


def is_id_like(distinct: int, rows: int) -> bool:
    return distinct > ID_LIKE_SHARE * rows and distinct > ID_LIKE_MIN


def id_like_counts(df: DataFrame, cols: list[str], rows: int | None = None) -> tuple[dict[str, int], int]:
    """Distinct counts, exact wherever they decide whether a column is id-like, and the row count."""
    n = df.count() if rows is None else rows
    counts, _ = distinct_counts(df, {c: F.col(c) for c in cols}, exact_from=int(0.85 * ID_LIKE_SHARE * n))
    return counts, n


def id_like_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    """I4: text column with distinct > 0.97 * rows and > 50, from bounded distinct states in one
    scan; columns near or beyond the share are counted exactly in one more job."""
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, id_like int")
    counts, n = id_like_counts(df, cols)
    rows = [(c, int(is_id_like(counts[c], n))) for c in cols]
    return df.sparkSession.createDataFrame(rows, "column string, id_like int")


def datetime_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    """Share of rows parsing as a timestamp, datetime when above 0.8."""
    r = df.agg(*[F.avg(F.try_to_timestamp(F.col(c).cast("string")).isNotNull().cast("double")).alias(c) for c in cols])
    return (
        r.unpivot([], cols, "column", "parse_share")
        .withColumn("is_datetime", (F.col("parse_share") > DATETIME_SHARE).cast("int"))
    )


def boolean_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    """Distinct normalised values within {true,false} (is_bool) or within the
    wider yes/no/1/0 vocabulary (is_boolish); at least one value required."""
    wide = list(BOOLISH_MAP)
    aggs = []
    for c in cols:
        v = norm_text(c)
        aggs += [
            F.count(v).alias(f"{c}|n"),
            F.count_if(v.isNotNull() & ~v.isin(*BOOL_TF)).alias(f"{c}|tf"),
            F.count_if(v.isNotNull() & ~v.isin(*wide)).alias(f"{c}|w"),
        ]
    r = df.agg(*aggs)
    structs = [
        F.struct(
            F.lit(c).alias("column"),
            ((F.col(f"`{c}|n`") > 0) & (F.col(f"`{c}|tf`") == 0)).cast("int").alias("is_bool"),
            ((F.col(f"`{c}|n`") > 0) & (F.col(f"`{c}|w`") == 0)).cast("int").alias("is_boolish"),
        )
        for c in cols
    ]
    return r.select(F.explode(F.array(*structs)).alias("s")).select("s.*")


def high_cardinality_columns(df: DataFrame, cols: list[str], k: int = HIGH_CARD) -> DataFrame:
    """Columns of at least one value with their distinct count and whether it is above k, from
    bounded distinct states in one scan."""
    counts, _ = distinct_counts(df, {c: F.col(c).cast("string") for c in cols})
    rows = [(c, n, int(n > k)) for c, n in counts.items() if n]
    return df.sparkSession.createDataFrame(rows, "column string, n_distinct long, high_card int")


def composite_columns(df: DataFrame, cols: list[str], sep: str) -> DataFrame:
    """I8: example value (smallest) and number of ``sep`` parts, plus the maximum."""
    aggs = []
    for c in cols:
        aggs += [F.min(F.col(c).cast("string")).alias(f"{c}|ex"), F.max(F.size(F.split(F.col(c).cast("string"), _lit_regex(sep)))).alias(f"{c}|mx")]
    r = df.agg(*aggs)
    structs = [
        F.struct(
            F.lit(c).alias("column"),
            F.lit(sep).alias("sep"),
            F.col(f"`{c}|ex`").alias("example"),
            F.size(F.split(F.col(f"`{c}|ex`"), _lit_regex(sep))).cast("long").alias("n_parts"),
            F.col(f"`{c}|mx`").cast("long").alias("max_parts"),
        )
        for c in cols
    ]
    return r.select(F.explode(F.array(*structs)).alias("s")).select("s.*")


HINT_SEPS = ("/", "_", "#", "-")  # fixed: separators tried for composite codes


def feature_hints(df: DataFrame, text_cols: list[str], measure_cols: list[str], id_col: str | None = None) -> DataFrame:
    """Rule table of suggestions (column, hint) derived from one aggregate:
    composite split when the smallest value holds a separator, a last-token hint
    for name-like columns, spend totals when measures have zeros, boolean casts, and
    the group prefix of an id whose smallest value holds a separator."""
    aggs = [F.min(F.col(c).cast("string")).alias(f"{c}|ex") for c in text_cols]
    if id_col:
        aggs.append(F.min(F.col(id_col).cast("string")).alias("|id"))
    aggs += [F.count_if(F.col(c) == 0).alias(f"{c}|z") for c in measure_cols]
    aggs += [F.count_if(norm_text(c).isNotNull() & ~norm_text(c).isin(*BOOL_TF)).alias(f"{c}|nb") for c in text_cols]
    aggs += [F.count(F.col(c)).alias(f"{c}|nn") for c in text_cols]
    r = df.agg(*aggs)
    rows = []
    for c in text_cols:
        ex = F.col(f"`{c}|ex`")
        for s in HINT_SEPS:
            rows.append(
                F.when(F.instr(ex, s) > 0, F.struct(F.lit(c).alias("column"), F.concat(F.lit(f"split on '{s}' into "), F.size(F.split(ex, _lit_regex(s))).cast("string"), F.lit(" parts")).alias("hint")))
            )
        if "name" in c.lower():
            rows.append(F.struct(F.lit(c).alias("column"), F.lit("last token").alias("hint")))
        rows.append(
            F.when((F.col(f"`{c}|nb`") == 0) & (F.col(f"`{c}|nn`") > 0), F.struct(F.lit(c).alias("column"), F.lit("cast boolean").alias("hint")))
        )
    if id_col:
        first = F.coalesce(*[F.when(F.instr(F.col("`|id`"), s) > 0, F.lit(s)) for s in HINT_SEPS])
        hint = F.concat(F.lit("group prefix before "), first, F.lit(" of "), F.col("`|id`"))
        rows.append(F.when(first.isNotNull(), F.struct(F.lit(id_col).alias("column"), hint.alias("hint"))))
    if measure_cols:
        anyz = None
        for m in measure_cols:
            z = F.col(f"`{m}|z`") > 0
            anyz = z if anyz is None else (anyz | z)
        rows.append(F.when(anyz, F.struct(F.lit(",".join(measure_cols)).alias("column"), F.lit("total, any, log1p").alias("hint"))))
    return r.select(F.explode(F.array(*rows)).alias("h")).where(F.col("h").isNotNull()).select("h.*")
