"""Measures of agreement, and lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civisphere.operators import ordering
from civisphere.operators.tables import written


def confusion(rows: DataFrame, predicted: Column, actual: Column) -> DataFrame:
    """Counts with precision, recall and F1; null where there is nothing to divide by."""
    hit = lambda p, a: F.sum(F.when(p & a, 1).otherwise(0)).cast("long")
    c = rows.agg(hit(predicted, actual).alias("tp"), hit(predicted, ~actual).alias("fp"), hit(~predicted, actual).alias("fn"), hit(~predicted, ~actual).alias("tn"))
    ratio = lambda a, b: F.when(b > 0, F.round(a / b, 6))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return c.select("tp", "fp", "fn", "tn", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def kappa(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Cohen's kappa of two 0/1 labels."""
    c = rows.agg(F.count(F.lit(1)).alias("n"), F.sum((F.col(a) == F.col(b)).cast("long")).alias("agree"), F.sum(a).alias("x"), F.sum(b).alias("y"))
    n = F.col("n").cast("double")
    po, pe = F.col("agree") / n, (F.col("x") / n) * (F.col("y") / n) + (1 - F.col("x") / n) * (1 - F.col("y") / n)
    return c.select("n", "agree", F.when(pe < 1, F.round((po - pe) / (1 - pe), 6)).alias("kappa"))


def bcubed(rows: DataFrame, cluster: str, gold: str) -> DataFrame:
    """B-cubed precision and recall from cell counts, without pairs of items."""
    cells = rows.groupBy(cluster, gold).agg(F.count(F.lit(1)).alias("n"))
    c, g = cells.groupBy(cluster).agg(F.sum("n").alias("nc")), cells.groupBy(gold).agg(F.sum("n").alias("ng"))
    t = cells.join(c, cluster).join(g, gold)
    n = F.col("n").cast("double")
    return t.agg(F.round(F.sum(n * n / F.col("nc")) / F.sum("n"), 6).alias("precision"), F.round(F.sum(n * n / F.col("ng")) / F.sum("n"), 6).alias("recall"))


def lineage_roots(rows: DataFrame, key: str, parent: str, rounds: int = 32) -> DataFrame:
    """Survivor of each id along its parents, by pointer jumping: each round
    halves the length of all chains and is one equi-join."""
    at = rows.select(F.col(key).alias("id"), F.coalesce(parent, key).alias("root"))
    for _ in range(rounds):
        up = at.select(F.col("id").alias("root"), F.col("root").alias("above"))
        nxt = at.join(up, "root", "left").select("id", F.coalesce("above", "root").alias("root"), (F.coalesce("above", "root") != F.col("root")).alias("moved"))
        nxt = written(nxt)
        if not nxt.where("moved").limit(1).count():
            return nxt.select("id", "root")
        at = nxt.select("id", "root")
    raise ValueError("lineage is longer than 2**32 or has a cycle")


def average_precision(rows: DataFrame, score: str, label: str) -> DataFrame:
    """``ap``: precision at each score, weighted by the recall it adds; equal scores count at once.

    Counts by score are summed in the order of scores; there are as many rows as different scores.
    """
    g = rows.groupBy(score).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("long")).alias("p")).withColumn("order", -F.col(score))
    out = ordering.running(g, "order", [F.col("order").asc()], {"m": F.col("n"), "tp": F.col("p")})
    return out.agg(F.round(F.sum(F.col("p") * (F.col("tp") / F.col("m"))) / F.sum("p"), 6).alias("ap"))


def induced_pairs(rows: DataFrame, cluster: str, gold: str) -> DataFrame:
    """Precision, recall and F1 of the pairs that clusters induce, from cell counts without any pair."""
    pairs = lambda c: F.sum(c * (c - 1) / 2)
    n = F.col("n").cast("double")
    count = lambda *keys: rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(pairs(n).alias("k"))
    out = count(cluster, gold).select(F.col("k").alias("both")).crossJoin(count(cluster).select(F.col("k").alias("own"))).crossJoin(count(gold).select(F.col("k").alias("all")))
    ratio = lambda a, b: F.when(b > 0, F.round(a / b, 6))
    both, own, whole = F.col("both"), F.col("own"), F.col("all")
    return out.select(ratio(both, own).alias("precision"), ratio(both, whole).alias("recall"), ratio(2 * both, own + whole).alias("f1"))


def blocking_recall(pairs: DataFrame, kept: DataFrame, tier: str) -> DataFrame:
    """``tier, pairs, kept, recall`` of labelled ``pairs(a_id, b_id, tier)`` that a blocking keeps."""
    found = pairs.join(kept.select("a_id", "b_id").distinct().withColumn("hit", F.lit(1)), ["a_id", "b_id"], "left")
    out = found.groupBy(tier).agg(F.count(F.lit(1)).alias("pairs"), F.count("hit").alias("kept"))
    return out.withColumn("recall", F.round(F.col("kept") / F.col("pairs"), 6))


def moved(before: DataFrame, after: DataFrame) -> DataFrame:
    """``items, moved, lost``: members whose owner changed, and those that are gone; both are (id, owner)."""
    both = before.join(after.withColumnRenamed("owner", "now"), "id", "left")
    return both.agg(F.count(F.lit(1)).alias("items"), F.coalesce(F.sum((F.col("now") != F.col("owner")).cast("long")), F.lit(0)).alias("moved"), F.sum(F.col("now").isNull().cast("long")).alias("lost"))


def matrix(rows: DataFrame, a: str, b: str) -> DataFrame:
    """``a, b, n, share``: cells of the label matrix, as shares of the rows with the first label."""
    n = rows.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    whole = n.groupBy(a).agg(F.sum("n").alias("whole"))
    return n.join(whole, a).select(a, b, "n", F.round(F.col("n") / F.col("whole"), 6).alias("share"))
