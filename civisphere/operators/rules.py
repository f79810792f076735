"""First-match rules, gates, retention, retries and record checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def first_rule(text: Column, rules: list[tuple[str, str]], other: str) -> Column:
    """Name of the first pattern that ``text`` meets, in the order given; null texts are ``other``."""
    return F.coalesce(*(F.when(text.rlike(p), F.lit(name)) for name, p in rules), F.lit(other))


def score_types(title: Column, rules: dict[str, tuple[str, int, str]]) -> dict[str, Column]:
    """Score of each type: its weight for every hit of its pattern, 0 where its veto is met."""
    hits = lambda p: F.coalesce(F.regexp_count(title, F.lit(p)), F.lit(0))
    return {k: F.when(title.rlike(veto), 0).otherwise(w * hits(p)) for k, (p, w, veto) in rules.items()}


def best_type(scores: dict[str, Column], least: int) -> Column:
    """The type of the highest score of ``least`` or more, ties in table order, else null."""
    top = F.greatest(*scores.values(), F.lit(0))
    return F.when(top >= least, F.coalesce(*(F.when(c == top, F.lit(k)) for k, c in scores.items())))


def fresh(at: Column, edition: Column, back_s: int, ahead_s: int) -> Column:
    """Whether a time is in the edition's window; undated rows stay."""
    gap = F.unix_timestamp(at) - F.unix_timestamp(edition)
    return F.coalesce(gap.between(-back_s, ahead_s), F.lit(True))


def active(status: Column, end: Column, now: Column, on: str = "active") -> Column:
    """Active and not over; an open end counts as not over."""
    return F.coalesce(status == on, F.lit(False)) & F.coalesce(end >= now, F.lit(True))


def nest_gate(rows: DataFrame, group: str, voice: str, local: Column) -> DataFrame:
    """Groups of two voices or more, one of their rows local, with both counts."""
    out = rows.groupBy(group).agg(F.countDistinct(voice).alias("voices"), F.sum(F.when(local, 1).otherwise(0)).alias("local_rows"))
    return out.where("voices >= 2 and local_rows >= 1")


def keep_recent(rows: DataFrame, group: str, at: str, span_s: int) -> DataFrame:
    """Rows of the last ``span_s`` seconds before the newest of all, and the newest row time of each group whatever its age."""
    latest = rows.groupBy(group).agg(F.max(at).alias("group_latest"))
    edge = rows.agg(F.max(F.unix_timestamp(at)).alias("edge"))  # one row
    kept = rows.join(latest, group).join(F.broadcast(edge))
    return kept.where((F.unix_timestamp(at) >= F.col("edge") - span_s) | (F.col(at) == F.col("group_latest"))).select(*rows.columns)


def newest_outcome(runs: DataFrame, source: str, at: str, error: Column, tie: str) -> DataFrame:
    """The newest run of each source; of one time an outcome is preferred to an error, then the larger ``tie``."""
    best = F.max_by(F.struct(tie, error.alias("failed")), F.struct(F.col(at), (~error).cast("int"), F.col(tie)))
    return runs.groupBy(source).agg(best.alias("x"), F.max(at).alias("at")).select(source, "at", f"x.{tie}", "x.failed")


def retry_state(runs: DataFrame, key: str, at: str, failed: Column, most: int, wait_s: int) -> DataFrame:
    """Failures of each key, whether it is given up, and when (epoch seconds) it may be tried again."""
    out = runs.where(failed).groupBy(key).agg(F.count(F.lit(1)).alias("attempts"), F.max(F.unix_timestamp(at)).alias("last"))
    out = out.withColumn("permanent", F.col("attempts") >= most)
    return out.select(key, "attempts", "permanent", F.when(~F.col("permanent"), F.col("last") + wait_s).alias("retry_after"))


def check_chain(records: DataFrame) -> DataFrame:
    """``records(no, leaf, root, payload)`` with what is wrong: a leaf that is not
    the payload's digest, else a root that does not follow; null if sound.

    Each record is checked against the one before it alone, so this is a
    sort, not a fold. Records are one an edition.
    """
    before = F.coalesce(F.lag("root").over(W.orderBy("no")), F.lit(""))
    bad = F.when(F.sha2("payload", 256) != F.col("leaf"), "leaf").when(F.sha2(F.concat(before, "leaf"), 256) != F.col("root"), "root")
    return records.select("no", bad.alias("problem"))


def robots_allowed(paths: DataFrame, path: str, rules: list[tuple[str, bool]]) -> Column:
    """Whether the longest rule that a path meets allows it; of equal length an
    allowing rule wins, and a path that meets none is allowed. ``*`` stands for
    anything and a last ``$`` for the end."""
    met = []
    for rule, allow in rules:
        body, end = (rule[:-1], "$") if rule.endswith("$") else (rule, "")
        pattern = "^" + ".*".join(_quoted(x) for x in body.split("*")) + end
        met.append(F.when(F.coalesce(paths[path], F.lit("")).rlike(pattern), F.lit(2 * len(rule) + allow)).otherwise(1))
    return F.pmod(reduce(F.greatest, met, F.lit(1)) if met else F.lit(1), F.lit(2)) == 1


def _quoted(text: str) -> str:
    return "".join("\\" + c if c in r"\.^$|?+()[]{}" else c for c in text)


def contributions(rows: DataFrame, key: str, weights: dict[str, float]) -> DataFrame:
    """``key, feature, part, place``: what each feature adds to a logistic score, largest first, names break ties."""
    parts = F.array(*(F.struct((-(F.round(F.col(f) * w, 6) + 0.0)).alias("neg"), F.lit(f).alias("feature")) for f, w in weights.items()))
    out = rows.select(key, F.posexplode(F.array_sort(parts)).alias("place", "x"))
    return out.select(key, "x.feature", (-F.col("x.neg")).alias("part"), (F.col("place") + 1).alias("place"))


def related(rows: DataFrame, key: str, group: str, most: int = 5) -> DataFrame:
    """``key, other``: the first ``most`` other members of a row's group.

    Only the first ``most + 1`` members of a group are joined to its rows, so a
    group of any size makes at most ``most`` rows a member.
    """
    heads = rows.select(F.col(group).alias("g"), F.col(key).alias("other")).withColumn("n", F.row_number().over(W.partitionBy("g").orderBy("other"))).where(F.col("n") <= most + 1)
    both = rows.select(key, F.col(group).alias("g")).join(heads, "g").where(F.col(key) != F.col("other"))
    # without itself among the heads a row has one too many
    own = F.col(key) > F.col("other")
    return both.where(F.when(own, F.col("n")).otherwise(F.col("n") - 1) <= most).select(key, "other")


def overlap(a: DataFrame, b: DataFrame, key: str, left: str, right: str) -> DataFrame:
    """Members that groups of two groupings share, with the sizes of both."""
    na, nb = a.groupBy(left).agg(F.count(F.lit(1)).alias("left_size")), b.groupBy(right).agg(F.count(F.lit(1)).alias("right_size"))
    both = a.join(b, key).groupBy(left, right).agg(F.count(F.lit(1)).alias("shared"))
    return both.join(na, left).join(nb, right)


def best_threshold(curve: DataFrame) -> DataFrame:
    """The threshold of the largest F1 of a ``pr_curve``; the highest of equal ones."""
    f1 = F.round(2 * F.col("tp") / (F.col("tp") + F.col("fp") + F.col("positives")), 6)
    return curve.withColumn("f1", f1).agg(F.max_by("score", F.struct("f1", "score")).alias("threshold"), F.max("f1").alias("f1"))


def bootstrap_counts(rows: DataFrame, key: Column, positive: Column, rounds: int, seed: int) -> DataFrame:
    """Poisson bootstrap: in each round every row counts 0 to 3 times by a hash of
    its key, so rounds need neither resampled copies nor a shuffle of rows."""
    each = rows.select(key.cast("string").alias("k"), positive.cast("int").alias("p"), F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))).alias("round"))
    u = F.conv(F.substring(F.sha2(F.concat_ws("|", "k", "round", F.lit(seed)), 256), 1, 6), 16, 10).cast("long")
    # thresholds of a Poisson variable of mean 1, of 2 ** 24
    times = F.when(u < 6171992, 0).when(u < 12343985, 1).when(u < 15429981, 2).otherwise(3)
    return each.groupBy("round").agg(F.sum(times).alias("n"), F.sum(times * F.col("p")).alias("positive"))
