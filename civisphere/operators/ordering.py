"""Orders over whole tables, without one task that holds all rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Rows of a stretch, about; most stretches.
STRETCH, MOST = 100_000, 10_000


def stretch_bounds(df: DataFrame, key: Column, stretch: int = STRETCH) -> list:
    """Values that cut ``key`` into stretches of about equally many rows."""
    row = df.agg(F.count(F.lit(1)).alias("n")).first()
    wanted = min(MOST, row["n"] // stretch)
    if wanted < 2:
        return []
    at = df.agg(F.percentile_approx(key, [i / wanted for i in range(1, wanted)], max(10_000, 20 * wanted)).alias("b")).first()["b"]
    return sorted(set(at or []))


def stretch_of(bounds: list, key: Column) -> Column:
    """Number of bounds that are not above ``key``; a null key has none below it."""
    if not bounds:
        return F.lit(0)
    step = max(1, math.isqrt(len(bounds)))
    coarse, fine = F.array(*map(F.lit, bounds[::step])), F.array(*map(F.lit, bounds))
    c = F.size(F.filter(coarse, lambda b: b <= key))
    inner = F.slice(fine, F.greatest(c - 1, F.lit(0)) * step + 1, F.lit(step))
    return F.coalesce(F.when(c == 0, F.lit(0)).otherwise((c - 1) * step + F.size(F.filter(inner, lambda b: b <= key))), F.lit(0))


def running(df: DataFrame, key: str, order: list[Column], add: dict[str, Column], stretch: int = STRETCH) -> DataFrame:
    """Add running sums over the whole order (own row included).

    ``order`` begins with ``key`` ascending and ends with an id. Rows are dealt
    by stretches of the key; sums of earlier stretches, at most ``MOST`` rows,
    are broadcast.
    """
    bounds = stretch_bounds(df, F.col(key), stretch)
    rows = df.withColumn("__s", stretch_of(bounds, F.col(key)).cast("int")).withColumns({f"__{k}": v for k, v in add.items()})
    totals = rows.groupBy("__s").agg(*(F.sum(f"__{k}").alias(f"__t_{k}") for k in add))
    w = W.orderBy("__s").rowsBetween(W.unboundedPreceding, -1)
    before = totals.select(F.col("__s").alias("__b"), *(F.coalesce(F.sum(f"__t_{k}").over(w), F.lit(0)).alias(f"__before_{k}") for k in add))
    inner = W.partitionBy("__s").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    out = rows.join(F.broadcast(before), rows["__s"] == before["__b"])
    out = out.withColumns({k: F.sum(f"__{k}").over(inner) + F.col(f"__before_{k}") for k in add})
    return out.drop("__s", "__b", *(f"__{k}" for k in add), *(f"__before_{k}" for k in add))


def value_positions(df: DataFrame, value: str) -> DataFrame:
    """Per distinct known value: ``below`` and ``equal`` rows, and ``known`` rows in all."""
    each = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("equal"))
    out = running(each, value, [F.col(value).asc()], {"upto": F.col("equal")})
    known = each.agg(F.sum("equal").alias("n")).first()["n"] or 0
    return out.select(value, (F.col("upto") - F.col("equal")).alias("below"), "equal", F.lit(known).alias("known"))
