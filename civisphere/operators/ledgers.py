"""Aggregates, diffs and histories of editions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def collapse(feeds: DataFrame, group: str, rank: str, official: Column, feed: str) -> DataFrame:
    """Sister feeds as one voice: best rank, whether any is official, the feeds in order."""
    return feeds.groupBy(group).agg(F.min(rank).alias("best_rank"), F.max(official).alias("official"), F.array_join(F.array_sort(F.collect_set(F.col(feed).cast("string"))), ",").alias("feeds"))


def snapshot_diff(before: DataFrame, after: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """new, removed, changed (with the fields) or same for each key of two snapshots."""
    a, b = before.select(F.col(key).alias("ka"), *(F.col(f).alias(f"a_{f}") for f in fields)), after.select(F.col(key).alias("kb"), *(F.col(f).alias(f"b_{f}") for f in fields))
    both = a.join(b, F.col("ka") == F.col("kb"), "full_outer")
    changed = F.concat_ws(",", *(F.when(~F.col(f"a_{f}").eqNullSafe(F.col(f"b_{f}")), F.lit(f)) for f in fields))
    state = F.when(F.col("ka").isNull(), "new").when(F.col("kb").isNull(), "removed").when(changed != "", "changed").otherwise("same")
    return both.select(F.coalesce("ka", "kb").alias(key), state.alias("state"), F.when(state == "changed", changed).otherwise(F.lit("")).alias("fields"))


def edition_ledger(rows: DataFrame, key: str, edition: str, count: str) -> DataFrame:
    """Each key in each edition against the edition before: new, developed
    (with the growth; only counts that grow do) or quiet."""
    w = W.partitionBy(key).orderBy(edition)
    out = rows.withColumn("prev", F.lag(count).over(w)).withColumn("prev_edition", F.lag(edition).over(w))
    seen = F.col("prev_edition") == F.col(edition) - 1
    growth = F.when(seen & (F.col(count) > F.col("prev")), F.col(count) - F.col("prev"))
    state = F.when(~F.coalesce(seen, F.lit(False)), "new").when(growth.isNotNull(), "developed").otherwise("quiet")
    return out.select(key, edition, count, state.alias("state"), growth.alias("growth"))


def presence_history(seen: DataFrame, editions: DataFrame, key: str, edition: str) -> DataFrame:
    """First and last edition of each key, editions seen and missed since the
    first, and how many it has been absent at the end. ``editions`` is numbered
    by ``no``; absence is only counted for editions that took place."""
    own = seen.select(key, edition).distinct().join(editions, edition)
    last = editions.agg(F.max("no").alias("n")).first()["n"]
    out = own.groupBy(key).agg(F.min("no").alias("first_no"), F.max("no").alias("last_no"), F.count(F.lit(1)).alias("seen"))
    return out.select(key, "first_no", "last_no", "seen", (F.lit(last) - F.col("first_no") + 1 - F.col("seen")).alias("missed"), (F.lit(last) - F.col("last_no")).alias("absent_streak"))


def health(runs: DataFrame, source: str, order: list[str], failed: Column, window: int = 10, streak: int = 3) -> DataFrame:
    """Of the last ``window`` runs of each source: runs, failures, the failure
    streak at the end, and a status (failing from ``streak`` on, else flaky or ok)."""
    w = W.partitionBy(source).orderBy(*(F.col(c).desc() for c in order))
    last = runs.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= window).withColumn("bad", failed.cast("int"))
    out = last.groupBy(source).agg(F.count(F.lit(1)).alias("runs"), F.sum("bad").alias("failures"), F.min(F.when(F.col("bad") == 0, F.col("rn"))).alias("first_ok"))
    run = F.coalesce(F.col("first_ok") - 1, F.col("runs")).cast("long")
    status = F.when(run >= streak, "failing").when(F.col("failures") > 0, "flaky").otherwise("ok")
    return out.select(source, "runs", F.col("failures").cast("long").alias("failures"), run.alias("streak"), status.alias("status"))


def churn(counts: DataFrame, edition: str, key: str, n: str, top: int = 30) -> DataFrame:
    """Keys that enter and leave the top of an edition against the one before."""
    w = W.partitionBy(edition).orderBy(F.desc(n), key)
    best = counts.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= top).select(edition, key)
    prev = best.select((F.col(edition) + 1).alias(edition), key)
    entered = best.join(prev, [edition, key], "left_anti").groupBy(edition).agg(F.count(F.lit(1)).alias("entered"))
    left = prev.join(best, [edition, key], "left_anti").groupBy(edition).agg(F.count(F.lit(1)).alias("left"))
    sizes = best.groupBy(edition).agg(F.count(F.lit(1)).alias("size"))
    return sizes.join(entered, edition, "left").join(left, edition, "left").select(edition, "size", F.coalesce("entered", F.lit(0)).alias("entered"), F.coalesce("left", F.lit(0)).alias("left"))


def display_variant(rows: DataFrame, key: str, variant: str) -> DataFrame:
    """Most frequent spelling of each key, ties by the lesser spelling."""
    each = rows.groupBy(key, variant).agg(F.count(F.lit(1)).alias("n"))
    w = W.partitionBy(key).orderBy(F.desc("n"), variant)
    total = each.groupBy(key).agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("variants"))
    return each.withColumn("rn", F.row_number().over(w)).where("rn = 1").select(key, F.col(variant).alias("display"), "n").join(total, key)


def concentration(rows: DataFrame, key: str, least: int = 8, factor: int = 4) -> DataFrame:
    """Keys with at least ``least`` rows and ``factor`` times the median per key."""
    each = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    mid = each.agg(F.median("n").alias("m")).first()["m"]
    return each.where((F.col("n") >= least) & (F.col("n") >= factor * F.lit(mid)))


def verdict(rules: list[tuple[int, str, DataFrame]], key: str, cap: int = 6) -> DataFrame:
    """Union of rule results ``(key, n)``, first by rule, then by count, at most ``cap`` shown."""
    rows = None
    for rank, name, df in rules:
        own = df.select(F.lit(rank).alias("rank"), F.lit(name).alias("rule"), F.col(key).cast("string").alias("key"), F.col("n").cast("long").alias("n"))
        rows = own if rows is None else rows.unionByName(own)
    return rows.orderBy("rank", F.desc("n"), "key").limit(cap)


def fact_slots(facts: DataFrame, slot: list[str], value: str, item: str) -> DataFrame:
    """Slots with their distinct values and items; divergent from two of each."""
    return facts.groupBy(*slot).agg(F.countDistinct(value).alias("values"), F.countDistinct(item).alias("items")).withColumn("divergent", (F.col("values") >= 2) & (F.col("items") >= 2))


def two_level_plurality(votes: DataFrame, event: str, area: str, place: str) -> DataFrame:
    """The area with most votes of each event, then the place with most votes in it; ties by name."""
    areas = votes.groupBy(event, area).agg(F.count(F.lit(1)).alias("area_votes"))
    wa, wp = W.partitionBy(event).orderBy(F.desc("area_votes"), area), W.partitionBy(event).orderBy(F.desc("place_votes"), place)
    best = areas.withColumn("rn", F.row_number().over(wa)).where("rn = 1").drop("rn")
    places = votes.groupBy(event, area, place).agg(F.count(F.lit(1)).alias("place_votes")).join(best, [event, area])
    return places.withColumn("rn", F.row_number().over(wp)).where("rn = 1").select(event, area, "area_votes", place, "place_votes")


def voice_register(spoke: DataFrame, voices: DataFrame, editions: DataFrame, voice: str) -> DataFrame:
    """Per voice: editions it spoke in, the last one, and the editions since."""
    last = editions.agg(F.max("no").alias("n")).first()["n"]
    own = spoke.select(voice, "no").distinct().groupBy(voice).agg(F.count(F.lit(1)).alias("spoke"), F.max("no").alias("last_no"))
    return voices.join(own, voice, "left").select(voice, F.coalesce("spoke", F.lit(0)).alias("spoke"), "last_no", F.coalesce(F.lit(last) - F.col("last_no"), F.lit(last)).alias("gap"))


def hash_chain(editions: DataFrame, no: str, payload: Column) -> DataFrame:
    """Leaf and root of each edition: root = sha256(previous root, leaf).

    The chain is sequential by definition. It runs over one row for each
    edition, an array of 64-character leaves that grows only with time.
    """
    leaves = editions.select(F.col(no).alias("no"), F.sha2(payload, 256).alias("leaf"))
    row = leaves.agg(F.array_sort(F.collect_list(F.struct("no", "leaf"))).alias("c"))
    step = lambda acc, x: F.concat(acc, F.array(F.sha2(F.concat(F.coalesce(F.element_at(acc, -1), F.lit("")), x["leaf"]), 256)))
    start = F.array().cast("array<string>")
    folded = row.withColumn("roots", F.aggregate("c", start, lambda acc, x: F.when(F.size(acc) == 0, F.array(F.sha2(x["leaf"], 256))).otherwise(step(acc, x))))
    return folded.select(F.explode(F.arrays_zip("c", "roots")).alias("z")).select("z.c.no", "z.c.leaf", F.col("z.roots").alias("root"))
