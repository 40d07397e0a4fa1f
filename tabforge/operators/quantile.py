"""Exact medians without gathering a column into one task.

``percentile(c, 0.5)`` keeps every distinct value of the group in one buffer; for a
global aggregate that is the whole column in the final task. Here one scan takes a
bracket around the median from a ``percentile_approx`` sketch, and a second counts the
values inside it (and the rows below it). The counted values are range-partitioned on
(column, value) and staged; per-partition sums tell in which partition a rank lies, and a
running sum inside that partition picks its value. The values are only ordered, never
divided into widths, so infinities and heavy tails change nothing. Result equals
pandas/DuckDB ``median`` (mean of the two middle values for even n).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabforge.session import staged

#: Accuracy of the sketch: ranks are right within n / ACCURACY.
ACCURACY = 10_000


def _long(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, x) over all listed columns; NaN treated as missing."""
    stack = F.explode(
        F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in cols])
    ).alias("kv")
    return df.select(stack).select("kv.column", "kv.x").where(F.col("x").isNotNull() & ~F.isnan("x"))


def _values_at(long: DataFrame, brackets: dict[str, tuple[float, float]], ranks: dict[str, list[int]]) -> dict[tuple[str, int], float]:
    """(column, 0-based rank) -> value, for the ranks that lie inside the column's bracket."""
    spark = long.sparkSession
    brk = spark.createDataFrame([(c, lo, hi) for c, (lo, hi) in brackets.items()], "column string, lo double, hi double")
    # rows below the bracket are one group per column, with a null value
    inside = long.join(F.broadcast(brk), "column").where(F.col("x") <= F.col("hi"))
    counted = inside.groupBy("column", F.when(F.col("x") >= F.col("lo"), F.col("x")).alias("x")).agg(F.count(F.lit(1)).alias("n"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sliced = staged(counted.repartitionByRange(parts, "column", "x").withColumn("p", F.spark_partition_id()), "median")
    slices: dict[str, list] = {}  # nulls sort first, so below-counts precede their column's values
    for r in sliced.groupBy("column", "p").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("x").isNull(), F.col("n"))).alias("below")).orderBy("column", "p").collect():
        slices.setdefault(r["column"], []).append(r)
    wanted = []
    for c, rows in slices.items():
        for k in ranks[c]:
            at = 0
            for r in rows:
                if k < at + r["n"]:
                    wanted.append((c, r["p"], k, k - at))
                    break
                at += r["n"]
    if not wanted:
        return {}
    want = spark.createDataFrame(wanted, "column string, p int, rank long, pos long")
    upto = F.sum("n").over(Window.partitionBy("column", "p").orderBy("x"))
    run = sliced.join(F.broadcast(want.select("column", "p").distinct()), ["column", "p"]).withColumn("upto", upto)
    hit = run.join(F.broadcast(want), ["column", "p"]).where((F.col("pos") < F.col("upto")) & (F.col("pos") >= F.col("upto") - F.col("n")))
    return {(r["column"], r["rank"]): r["x"] for r in hit.where(F.col("x").isNotNull()).collect()}


def exact_medians(df: DataFrame, cols: list[str]) -> dict[str, float | None]:
    """Exact median per column (nulls and NaN ignored); all-null column -> None."""
    if not cols:
        return {}
    long = _long(df, cols)
    off = 2 / ACCURACY
    sketch = F.percentile_approx("x", [0.5 - off, 0.5 + off], ACCURACY)
    stats = {
        r["column"]: r
        for r in long.groupBy("column").agg(F.count("x").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"), sketch.alias("s")).collect()
    }
    ranks = {c: sorted({(r["n"] - 1) // 2, r["n"] // 2}) for c, r in stats.items()}
    found = _values_at(long, {c: tuple(r["s"]) for c, r in stats.items()}, ranks) if stats else {}
    # a bracket that missed a rank (the sketch's bound does not hold) is replaced by the whole range
    missed = {c: (stats[c]["lo"], stats[c]["hi"]) for c in stats if any((c, k) not in found for k in ranks[c])}
    if missed:
        found |= _values_at(long, missed, ranks)
    return {c: sum(found[c, k] for k in ranks[c]) / len(ranks[c]) if c in stats else None for c in cols}
