"""Ranks, bands, cuts and joins in time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from civisphere.operators.ordering import running, value_positions


def midrank_band(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Quarter of the mid-rank: min(3, floor(4 (2 below + equal) / 2n)). A null is lowest."""
    n = rows.count()
    at = value_positions(rows, value)
    nulls = n - rows.where(F.col(value).isNotNull()).count()
    out = rows.select(key, value).join(at, value, "left")
    below, equal = F.coalesce(F.col("below") + nulls, F.lit(0)), F.coalesce("equal", F.lit(nulls))
    band = F.least(F.lit(3), F.floor(4 * (2 * below + equal) / F.lit(2 * max(n, 1))).cast("int"))
    return out.select(key, value, band.alias("band"))


def standing(rows: DataFrame, key: str, value: str) -> DataFrame:
    """How many known values are below and tied, of how many, and the percentage below (floor)."""
    out = rows.select(key, value).join(value_positions(rows, value), value)
    return out.select(key, "below", (F.col("equal") - 1).alias("tied"), "known", F.floor(100 * F.col("below") / F.col("known")).cast("long").alias("percent_below"))


def decided_by(rows: DataFrame, group: str, criteria: list[str], key: str) -> DataFrame:
    """Rank in each group by all criteria (greater first), then the key, with
    the first criterion that differs from the row above."""
    w = W.partitionBy(group).orderBy(*(F.desc(c) for c in criteria), F.col(key))
    rule = F.when(F.row_number().over(w) == 1, "first")
    for c in criteria:
        rule = rule.when(~F.lag(c).over(w).eqNullSafe(F.col(c)), F.lit(c))
    return rows.select(group, key, *criteria, F.row_number().over(w).alias("rank"), rule.otherwise(F.lit("id")).alias("decided_by"))


def median_cut(rows: DataFrame, group: str, value: str, key: str, cap: int = 12) -> DataFrame:
    """Shown if the value is not below the upper median's row of its group and
    the position is within the cap; else why it is hidden."""
    w = W.partitionBy(group).orderBy(F.desc(value), F.col(key))
    out = rows.select(group, key, value).withColumn("pos", F.row_number().over(w)).withColumn("n", F.count(F.lit(1)).over(W.partitionBy(group)))
    mid = F.max(F.when(F.col("pos") == F.floor((F.col("n") - 1) / 2) + 1, F.col(value))).over(W.partitionBy(group))
    out = out.withColumn("mid", mid)
    return out.select(group, key, value, "pos", F.when(F.col(value) < F.col("mid"), "below_median").when(F.col("pos") > cap, "over_cap").otherwise("shown").alias("state"))


def top_per_group(rows: DataFrame, group: str, order: list[Column], k: int) -> DataFrame:
    """First k rows of each group. Spark keeps k rows of a group in each task before the shuffle."""
    return rows.withColumn("rn", F.row_number().over(W.partitionBy(group).orderBy(*order))).where(F.col("rn") <= k)


def densest_window(times: DataFrame, group: str, seconds: str, span_s: int = 72 * 3600) -> DataFrame:
    """Start of the span with most rows of each group, ties to the earliest."""
    w = W.partitionBy(group).orderBy(seconds).rangeBetween(0, span_s)
    each = times.select(group, seconds, F.count(F.lit(1)).over(w).alias("n"))
    return each.groupBy(group).agg(F.max(F.struct("n", (-F.col(seconds)).alias("s"))).alias("b")).select(group, (-F.col("b.s")).alias("start_s"), F.col("b.n").alias("n"))


def overlapping(a: DataFrame, b: DataFrame, key: str, cell_s: int) -> DataFrame:
    """Equi-join on ``key`` of rows whose [start, end] meet. Intervals are
    exploded to cells of time, so a key with many rows is not paired in full;
    a pair counts in the cell where the later one starts."""
    cells = lambda df: df.withColumn("cell", F.explode(F.sequence(F.floor(F.col("start") / cell_s), F.floor(F.col("end") / cell_s))))
    x, y = cells(a).alias("x"), cells(b).alias("y")
    both = x.join(y, (F.col(f"x.{key}") == F.col(f"y.{key}")) & (F.col("x.cell") == F.col("y.cell")))
    return both.where("x.start <= y.end and y.start <= x.end").where(F.col("x.cell") == F.floor(F.greatest("x.start", "y.start") / cell_s))


def asof(left: DataFrame, right: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """Each left row with the newest right value at or before its time: a union
    and a running last over each key, with no pairs."""
    both = left.withColumn("__r", F.lit(1)).withColumn("__v", F.lit(None).cast(right.schema[value].dataType)).unionByName(
        right.select(key, time, F.col(value).alias("__v")).withColumn("__r", F.lit(0)), allowMissingColumns=True
    )
    w = W.partitionBy(key).orderBy(time, "__r").rowsBetween(W.unboundedPreceding, 0)
    return both.withColumn(value, F.last("__v", ignorenulls=True).over(w)).where("__r = 1").drop("__r", "__v")


def pr_curve(rows: DataFrame, score: str, label: str) -> DataFrame:
    """Precision and recall at each distinct score as threshold."""
    each = rows.groupBy(score).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("long")).alias("pos")).withColumn("neg_score", -F.col(score))
    out = running(each, "neg_score", [F.col("neg_score").asc()], {"tp_fp": F.col("n"), "tp": F.col("pos")})
    total = each.agg(F.sum("pos").alias("p")).first()["p"] or 0
    return out.select(score, "tp", (F.col("tp_fp") - F.col("tp")).alias("fp"), F.round(F.col("tp") / F.col("tp_fp"), 6).alias("precision"), F.when(F.lit(total) > 0, F.round(F.col("tp") / F.lit(max(total, 1)), 6)).alias("recall"))
