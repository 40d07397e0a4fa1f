"""Blending prediction tables.

Tables are matched by id, never by position: they are stacked into one long table
``(id, model, weight, value)`` and aggregated per id (one shuffle on id); the first
table's ids are the reference id set.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabforge.functions.scalar import norm_text
from tabforge.session import staged

BINARY_VALUES = ("true", "false", "1", "0")  # fixed: vocabulary of vote mode
# fixed: source priority weights of the final blend
PRIORITY_WEIGHTS = {"stacked": 2.0, "threshold": 1.5, "plain": 1.0, "generated": 1.0}


def normalise_vote(v) -> Column:
    """B1: true/1 (any case or type) -> 1, everything else -> 0."""
    c = F.col(v) if isinstance(v, str) else v
    t = norm_text(c)
    return F.when(t.isin("true", "1") | (c.cast("string").try_cast("double") == 1.0), 1).otherwise(0)


def stack_predictions(tables: list[tuple[str, DataFrame, float]], id_col: str, value_col: str) -> DataFrame:
    """One long table (id, model, weight, value as text, pos = table order)."""
    parts = [
        df.select(
            F.col(id_col).alias("id"),
            F.lit(name).alias("model"),
            F.lit(float(w)).alias("weight"),
            F.lit(i).alias("pos"),
            F.col(value_col).cast("string").alias("value"),
        )
        for i, (name, df, w) in enumerate(tables)
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


def value_set_subset(long: DataFrame, vocab=BINARY_VALUES, by: list[str] | None = None) -> DataFrame:
    """Are all (normalised) values inside ``vocab``? (0/1 per group)."""
    t = norm_text("value")
    return long.groupBy(*(by or [])).agg(
        (F.count_if(t.isNull() | ~t.isin(*vocab)) == 0).cast("int").alias("is_subset"),
        F.count_distinct(t).alias("n_values"),
    )


def blend_mode(long: DataFrame) -> str:
    """B4: 'vote' when every value of every table lies in {true,false,1,0}, else 'average'."""
    r = value_set_subset(long).first()
    return "vote" if (r["is_subset"] == 1 and r["n_values"] <= 4) else "average"


def output_as_bool(long: DataFrame) -> bool:
    """B5 fit: the first table's values are true/false text -> booleans, else 0/1."""
    r = value_set_subset(long.where(F.col("pos") == 0), ("true", "false")).first()
    return r["is_subset"] == 1


def align_predictions(long: DataFrame) -> DataFrame:
    """One row per id of the first table, one column per model (null if absent)."""
    models = [r["model"] for r in long.select("model", "pos").distinct().orderBy("pos").collect()]
    ref = long.where(F.col("pos") == 0).select("id").distinct()
    wide = long.groupBy("id").pivot("model", models).agg(F.first("value"))
    return ref.join(wide, "id", "left")


def _one_per_table(long: DataFrame) -> DataFrame:
    """One row per (id, table): an id listed twice in a table counts once (smallest value)."""
    return long.groupBy("id", "pos").agg(F.min("value").alias("value"), F.min("weight").alias("weight"))


def _tables(long: DataFrame, weights: list[float] | None) -> tuple[int, float]:
    """Number of stacked tables and their weights' sum: from the caller, or read off in one job."""
    if weights is None:
        weights = [r["weight"] for r in long.groupBy("pos").agg(F.min("weight").alias("weight")).collect()]
    return len(weights), float(sum(weights))


def weighted_majority(long: DataFrame, weights: list[float] | None = None) -> DataFrame:
    """B2: id and whether sum(w * vote) / sum(w) >= 0.5 over all tables (``majority``); an id that
    some table lacks compares false."""
    n_tables, total_w = _tables(long, weights)
    per = _one_per_table(long).groupBy("id").agg(
        F.sum(F.col("weight") * normalise_vote("value")).alias("ws"), F.count(F.lit(1)).alias("k")
    )
    maj = F.when(F.col("k") < n_tables, F.lit(False)).otherwise(F.col("ws") / F.lit(total_w) >= 0.5)
    ref = long.where(F.col("pos") == 0).select("id").distinct()
    return ref.join(per, "id", "left").select("id", maj.alias("majority"))


def vote_format(majority, as_bool: bool) -> Column:
    """A majority as True/False or 1/0 text."""
    m = F.col(majority) if isinstance(majority, str) else majority
    return F.when(m, "True").otherwise("False") if as_bool else m.cast("int").cast("string")


def weighted_vote(long: DataFrame, as_bool: bool | None = None, weights: list[float] | None = None) -> DataFrame:
    """B2 (+B5): the weighted majority, formatted like the first table."""
    if as_bool is None:
        as_bool = output_as_bool(long)
    return weighted_majority(long, weights).select("id", vote_format("majority", as_bool).alias("prediction"))


def weighted_average(long: DataFrame, weights: list[float] | None = None) -> DataFrame:
    """sum(w * number) / sum(w); any missing or non-numeric value -> null."""
    n_tables, total_w = _tables(long, weights)
    x = F.col("value").try_cast("double")
    per = _one_per_table(long).groupBy("id").agg(F.sum(F.col("weight") * x).alias("ws"), F.count(x).alias("k"))
    val = F.when(F.col("k") < n_tables, F.lit(None)).otherwise(F.col("ws") / F.lit(total_w))
    ref = long.where(F.col("pos") == 0).select("id").distinct()
    return ref.join(per, "id", "left").select("id", val.cast("double").alias("prediction"))


def blend(tables: list[tuple[str, DataFrame, float]], id_col: str, value_col: str) -> DataFrame:
    """B4 dispatch: vote or average."""
    long, weights = stack_predictions(tables, id_col, value_col), [float(w) for _, _, w in tables]
    return weighted_vote(long, None, weights) if blend_mode(long) == "vote" else weighted_average(long, weights)


def unanimous_rate(long: DataFrame) -> DataFrame:
    """Share of reference ids on which all tables give the same vote."""
    per = long.groupBy("id").agg(F.count_distinct(normalise_vote("value")).alias("nv"))
    ref = long.where(F.col("pos") == 0).select("id").distinct()
    return ref.join(per, "id", "left").agg(F.avg((F.col("nv") == 1).cast("double")).alias("unanimous_rate"))


@dataclass(frozen=True)
class BlendChoice:
    inputs: tuple[tuple[str, float], ...]
    action: str  # 'blend' | 'single' | 'none'


def select_blend_inputs(available: dict[str, bool]) -> BlendChoice:
    """Stacked (2.0), threshold (1.5) else plain (1.0), generated (1.0);
    one input passes through, several are blended."""
    chosen: list[tuple[str, float]] = []
    if available.get("stacked"):
        chosen.append(("stacked", PRIORITY_WEIGHTS["stacked"]))
    if available.get("threshold"):
        chosen.append(("threshold", PRIORITY_WEIGHTS["threshold"]))
    elif available.get("plain"):
        chosen.append(("plain", PRIORITY_WEIGHTS["plain"]))
    if available.get("generated"):
        chosen.append(("generated", PRIORITY_WEIGHTS["generated"]))
    action = "blend" if len(chosen) > 1 else ("single" if chosen else "none")
    return BlendChoice(tuple(chosen), action)


def final_predictions(sources: dict[str, DataFrame | None], id_col: str, value_col: str, last_resort: DataFrame | None = None) -> tuple[DataFrame | None, str]:
    """B6 to the end: (id, prediction) and how it came about. The chosen sources are blended; a blend
    that fails falls back to the first of them, a single source passes through, and without any the
    last resort does. The blend is written out here, so that its failure shows here."""
    choice = select_blend_inputs({name: df is not None for name, df in sources.items()})
    plain = lambda df: df.select(F.col(id_col).alias("id"), F.col(value_col).cast("string").alias("prediction"))
    if choice.action == "none":
        return (plain(last_resort), "last resort") if last_resort is not None else (None, "none")
    first = choice.inputs[0][0]
    if choice.action == "single":
        return plain(sources[first]), first
    try:
        tables = [(name, sources[name], w) for name, w in choice.inputs]
        done = staged(blend(tables, id_col, value_col), "blend")
        return done.select("id", F.col("prediction").cast("string").alias("prediction")), "blend"
    except Exception as e:  # noqa: BLE001 - goes on with the first input
        return plain(sources[first]), f"{first}: the blend failed with {type(e).__name__}"
