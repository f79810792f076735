"""Records, deltas and orders of editions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from civisphere.functions import stats as S
from civisphere.functions import url as U

KINDS = ("source", "host", "url", "image")


def delta(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """``key, state``: new, changed, gone or same between two snapshots, by a digest of the other columns."""
    mark = lambda df, name: df.select(key, F.sha2(F.to_json(F.struct(*(c for c in df.columns if c != key))), 256).alias(name))
    both = mark(before, "a").join(mark(after, "b"), key, "full_outer")
    state = F.when(F.col("a").isNull(), "new").when(F.col("b").isNull(), "gone").when(F.col("a") != F.col("b"), "changed").otherwise("same")
    return both.select(key, state.alias("state"))


def run_log(runs: DataFrame, source: str, at: str, body: str) -> DataFrame:
    """Adds ``digest`` and ``not_modified``: the body is that of the source's last run."""
    w = W.partitionBy(source).orderBy(at)
    out = runs.withColumn("digest", F.sha2(body, 256))
    return out.withColumn("not_modified", F.coalesce(F.lag("digest").over(w) == F.col("digest"), F.lit(False)))


def failures_since_ok(log: DataFrame, key: str, at: Column, ok: Column) -> DataFrame:
    """``key, last_ok, failed``: failures after the last success of each key."""
    rows = log.select(key, at.alias("at"), ok.alias("ok"))
    last = rows.groupBy(key).agg(F.max(F.when(F.col("ok"), F.col("at"))).alias("last_ok"))
    late = ~F.col("ok") & (F.col("last_ok").isNull() | (F.col("at") > F.col("last_ok")))
    return rows.join(last, key).groupBy(key).agg(F.max("last_ok").alias("last_ok"), F.sum(late.cast("long")).alias("failed"))


def rule_errors(rules: DataFrame) -> DataFrame:
    """Takedown rules with ``error``: unknown kind, empty value, repeated id, unknown status, or null for good ones."""
    first = F.row_number().over(W.partitionBy("id").orderBy("kind", "value")) == 1
    error = F.when(~F.col("kind").isin(*KINDS), "kind").when(F.coalesce(F.trim("value"), F.lit("")) == "", "value").when(~F.col("status").isin("active", "lifted"), "status").when(~first, "repeated")
    return rules.withColumn("error", error)


def apply_takedowns(items: DataFrame, rules: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Items that no active rule names. ``columns`` maps a kind to the column it
    looks at; hosts also match above their labels, addresses by canonical form.
    Every kind is one equi-join, whatever the number of rules."""
    live = rule_errors(rules).where("error is null and status = 'active'")
    for kind, column in columns.items():
        own = live.where(F.col("kind") == kind).select(F.col("value").alias("v"))
        if kind == "host":
            hosts = items.select(F.col(column).alias("c")).distinct().select("c", F.split(U.host(F.col("c")), r"\.").alias("l"))
            above = F.transform(F.sequence(F.lit(1), F.size("l")), lambda i: F.array_join(F.slice("l", i, F.size("l")), "."))
            named = hosts.select("c", F.explode(above).alias("v")).join(own, "v", "left_semi").select("c").distinct()
            items = items.join(named, items[column] == named["c"], "left_anti")
        elif kind in ("url", "image"):
            items = items.join(own.select(U.canonical_url(F.col("v")).alias("v")), U.canonical_url(F.col(column)) == F.col("v"), "left_anti")
        else:
            items = items.join(own, items[column] == F.col("v"), "left_anti")
    return items


def problems(rows: DataFrame, checks: list[tuple[str, Column]]) -> DataFrame:
    """Rows with ``problems``: names of the checks that do not hold (null counts as not holding)."""
    bad = F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks))
    return rows.withColumn("problems", F.array_join(F.filter(bad, lambda x: x.isNotNull()), ","))


def plurality(rows: DataFrame, key: str, value: str) -> DataFrame:
    """``key, value``: the most frequent value of a key, the first by name on ties."""
    n = rows.groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(key).agg(F.min_by(value, F.struct((-F.col("n")).alias("m"), F.col(value).alias("v"))).alias(value))


def record(rows: DataFrame, key: str, item: str, code: str, closed: list[str]) -> DataFrame:
    """One record for each edition: items and those of the closed list of codes, codes sorted, and how many fell out."""
    kept = F.col(code).isin(closed)
    return rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("items"), F.array_join(F.array_sort(F.collect_set(F.when(kept, F.col(code)))), ",").alias("codes"),
        F.sum((~kept).cast("long")).alias("dropped"), F.min(item).alias("first_item"), F.max(item).alias("last_item"),
    )


def impact_first(rows: DataFrame, group: str, impact: Column, order: list[Column], pinned: Column, most: int) -> DataFrame:
    """Rows with ``place``: pinned ones, then those with an impact, each in order; ``most`` of a group stay."""
    w = W.partitionBy(group).orderBy(F.desc(pinned.cast("int")), F.desc(impact.cast("int")), *order)
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def facet_order(items: DataFrame, facets: DataFrame, key: str, facet: str, group: str, most: int) -> DataFrame:
    """``key, group, score, place``: items by the summed weights of their facets, then by key; ``most`` of a group stay."""
    scored = items.join(facets, facet, "left").groupBy(key, group).agg(F.coalesce(F.sum("weight"), F.lit(0)).alias("score"))
    w = W.partitionBy(group).orderBy(F.desc("score"), key)
    return scored.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def promise(rows: DataFrame, key: str, at: str, official: Column) -> DataFrame:
    """``key, first_official, measured, run``: when a key first had an official
    voice, its editions since, and those before."""
    rows = rows.select(key, F.col(at).alias("at"), official.alias("o"))
    first = rows.groupBy(key).agg(F.min(F.when(F.col("o"), F.col("at"))).alias("first_official"))
    after = F.col("first_official").isNotNull() & (F.col("at") >= F.col("first_official"))
    return rows.join(first, key).groupBy(key).agg(F.max("first_official").alias("first_official"), F.sum(after.cast("long")).alias("measured"), F.sum((~after).cast("long")).alias("run"))


def revisions(rows: DataFrame, key: str, at: str, value: str, most: int) -> DataFrame:
    """``key, at, value, revision``: rows that change a key's value, the last ``most`` of each key."""
    w = W.partitionBy(key).orderBy(at)
    changed = rows.select(key, at, value, F.lag(value).over(w).alias("was")).where(~F.col(value).eqNullSafe(F.col("was")))
    back = W.partitionBy(key).orderBy(F.desc(at))
    return changed.withColumn("revision", F.row_number().over(w)).withColumn("back", F.row_number().over(back)).where(F.col("back") <= most).drop("back", "was")


def same_multiset(a: DataFrame, b: DataFrame) -> DataFrame:
    """``missing, extra``: rows of ``a`` that ``b`` lacks and the other way round, as often as they come, from counts alone."""
    n = lambda df, k: df.groupBy(*df.columns).agg(F.sum(F.lit(k)).alias("__n"))
    net = n(a, 1).union(n(b, -1)).groupBy(*a.columns).agg(F.sum("__n").alias("__n"))
    some = lambda x: F.coalesce(F.sum(F.greatest(x, F.lit(0))), F.lit(0)).cast("long")
    return net.agg(some(F.col("__n")).alias("missing"), some(-F.col("__n")).alias("extra"))


def chips(rows: DataFrame, group: str, hit: Column, floor: float) -> DataFrame:
    """``group, k, n, lo, chip``: measured if the Wilson bound reaches ``floor``, else estimated; none without rows."""
    c = rows.groupBy(group).agg(F.sum(hit.cast("long")).alias("k"), F.count(F.lit(1)).alias("n"))
    lo = F.round(S.wilson(F.col("k"), F.col("n")), 6)
    return c.withColumn("lo", lo).withColumn("chip", F.when(F.col("lo") >= floor, "measured").otherwise("estimated"))


def near_in_time(a: DataFrame, b: DataFrame, key: str, at: str, seconds: int) -> DataFrame:
    """``a_id, b_id, apart``: rows of equal ``key`` at most ``seconds`` apart.
    Spans of time are part of the join's key, so a hot key meets only its neighbours in time."""
    span = F.floor(F.unix_timestamp(at) / seconds)
    left = a.select(F.col("id").alias("a_id"), key, F.unix_timestamp(at).alias("ta"), F.explode(F.array(span - 1, span, span + 1)).alias("span"))
    right = b.select(F.col("id").alias("b_id"), key, F.unix_timestamp(at).alias("tb"), span.alias("span"))
    both = left.join(right, [key, "span"]).withColumn("apart", F.abs(F.col("ta") - F.col("tb")))
    return both.where(F.col("apart") <= seconds).select("a_id", "b_id", "apart")


def severity_order(rows: DataFrame, group: str, kind: str, ranks: dict[str, int], newest: str, key: str, most: int) -> DataFrame:
    """Rows with ``place`` by severity, then the newest, then the key; unknown kinds last, ``most`` of a group."""
    rank = F.coalesce(F.create_map(*(F.lit(x) for kv in ranks.items() for x in kv))[F.col(kind)], F.lit(max(ranks.values()) + 1))
    w = W.partitionBy(group).orderBy(rank, F.desc(newest), key)
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def fresh_groups(rows: DataFrame, clock: DataFrame, key: str, at: str, item: str, days: int) -> DataFrame:
    """Rows of the last ``days`` before the one-row ``clock(now)``, with ``fresh`` (today, week, older) and their ``place`` in it."""
    age = F.unix_micros("now") - F.unix_micros(F.col(at).cast("timestamp"))
    rows = rows.crossJoin(F.broadcast(clock.select(F.col("now").cast("timestamp").alias("now")))).where(age <= days * 86_400_000_000)
    fresh = F.when(age <= 86_400_000_000, "today").when(age <= 7 * 86_400_000_000, "week").otherwise("older")
    rows = rows.withColumn("fresh", fresh).drop("now")
    return rows.withColumn("place", F.row_number().over(W.partitionBy(key, "fresh").orderBy(F.desc(at), item)))


def blocks(rows: DataFrame, group: str, areas: Column, most: int) -> DataFrame:
    """``group, area, n, place``: areas of a group by how many rows they have, then by name."""
    n = rows.select(group, F.explode(areas).alias("area")).groupBy(group, "area").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("place", F.row_number().over(W.partitionBy(group).orderBy(F.desc("n"), "area"))).where(F.col("place") <= most)


def reduced(rows: DataFrame, key: str, name: str, stays: Column) -> DataFrame:
    """``key, stated_by, reduced``: names that stay, sorted, and how many are only counted."""
    out = rows.groupBy(key).agg(F.array_sort(F.collect_set(F.when(stays, F.col(name)))).alias("kept"), F.sum((~stays).cast("int")).cast("int").alias("reduced"))
    return out.select(key, F.array_join("kept", ",").alias("stated_by"), "reduced")
