"""Distinct counts of many columns in one scan.

Every column keeps a mergeable state of bounded size in one aggregate: the 2^``LG`` smallest hashes of
its 64-bit digests (a theta sketch). Up to that many distinct values the count is exact, rows are
not expanded per column, and no value is shuffled. Only columns beyond it, if an exact count is asked
for, go through a second job on 128-bit digests, all of them together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from tabforge.functions.scalar import digest128

LG = 12
EXACT = 1 << LG


def distinct_state(value: Column) -> Column:
    """Estimate from the bounded state of the non-null values; exact below ``EXACT``."""
    return F.theta_sketch_estimate(F.theta_sketch_agg(F.when(value.isNotNull(), F.xxhash64(value)), LG))


def distinct_counts(df: DataFrame, values: dict[str, Column], extra: list[Column] = (), exact_from: int = 0) -> tuple[dict[str, int], Row]:
    """Distinct non-null values per name, and the row of the ``extra`` aggregates of the same scan.
    Estimates below ``exact_from`` are left as they are (0: every count is exact)."""
    names = list(values)
    r = df.agg(*[distinct_state(values[n]).alias(f"__d{i}") for i, n in enumerate(names)], *extra).first()
    counts = {n: int(r[f"__d{i}"] or 0) for i, n in enumerate(names)}
    many = [n for n, c in counts.items() if c >= max(EXACT, exact_from)]
    if many:
        kv = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), digest128(values[n]).alias("d")) for i, n in enumerate(many) ])).alias("kv")
        per = df.select(kv).where(F.col("kv.d").isNotNull()).groupBy("kv.i", "kv.d").agg(F.lit(1)).groupBy("i").agg(F.count(F.lit(1)).alias("n"))
        counts |= {many[p["i"]]: p["n"] for p in per.collect()}
    return counts, r
