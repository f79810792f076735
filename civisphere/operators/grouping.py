"""Groups of items: components by shared keys, and the sequential rules, which
run inside one component at a time."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from civisphere.operators.tables import written

LINKS = ("average", "complete", "single")


def components_by_key(members: DataFrame, rounds: int = 64) -> DataFrame:
    """``id, component`` of ``members(id, key)``: items that share a key, by steps, are one.

    The component is the smallest id. In a round each key takes the smallest
    label of its items and each item that of its keys, so a key that very many
    items share costs one row for each of them and no pair.
    """
    rows = written(members.where("key is not null").distinct())
    label = written(members.select("id").distinct().withColumn("component", F.col("id")))
    for _ in range(rounds):
        low = rows.join(label, "id").groupBy("key").agg(F.min("component").alias("low"))
        new = rows.join(low, "key").groupBy("id").agg(F.min("low").alias("low"))
        # labels are ids, so the label of a label is a step ahead
        step = label.join(new, "id", "left").select("id", F.least("component", F.coalesce("low", "component")).alias("component"), F.col("component").alias("was"))
        jump = step.select(F.col("id").alias("component"), F.col("component").alias("up"))
        nxt = written(step.join(jump, "component").select("id", F.least("component", "up").alias("component"), "was"))
        label = nxt.select("id", "component")
        if nxt.where("component <> was").isEmpty():
            return label
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def split_of(component: Column, test_share: int) -> Column:
    """dev or test by a hash of the component, so that no component is in both."""
    lot = F.conv(F.substring(F.sha2(component.cast("string"), 256), 1, 8), 16, 10).cast("long") % 100
    return F.when(lot < test_share, "test").otherwise("dev")


def neighbours(pairs: DataFrame, owner: DataFrame) -> DataFrame:
    """``ea, eb, score``: the best pair score between two groups; ``pairs(a, b, score)``, ``owner(id, event)``."""
    a = owner.select(F.col("id").alias("a"), F.col("event").alias("x"))
    b = owner.select(F.col("id").alias("b"), F.col("event").alias("y"))
    both = pairs.join(a, "a").join(b, "b").where("x <> y")
    return both.select(F.least("x", "y").alias("ea"), F.greatest("x", "y").alias("eb"), "score").groupBy("ea", "eb").agg(F.max("score").alias("score"))


class Linkage(Protocol):
    """Decides whether an item links to a group, from its scores against the compared members."""

    def __call__(self, scores: list[float]) -> bool: ...


def linkage(link: str, threshold: float) -> Linkage:
    """average: mean and one member at the threshold; complete: all of them; single: one."""
    if link not in LINKS:
        raise ValueError(f"unknown link {link!r}")

    def rule(scores: list[float]) -> bool:
        hits = sum(s >= threshold for s in scores)
        if link == "average":
            return hits > 0 and sum(scores) / len(scores) >= threshold
        return hits == len(scores) if link == "complete" else hits > 0

    return rule


def attach(items: DataFrame, pairs: DataFrame, link: str = "average", threshold: float = 0.5, merge: bool = True) -> DataFrame:
    """``id, event, merged_into`` of ``items(id, at, event)`` by ``pairs(a, b, score)``.

    Items with an ``event`` are members already and never move. The others come
    in the order of (at, id): each joins the event with the strongest link (the
    mean of its scores, then more members at the threshold, then the smallest
    event), else it founds ``event = id``. Two events merge into the smaller
    name if two cross pairs reach the threshold and so does their mean; members
    keep their event and name the survivor. A pair that is not listed scores 0.

    Only items of one component of pairs at any score can meet, so each
    component is one group of ``applyInPandas``; it must fit into a task, which
    holds where pairs are listed above a floor.
    """
    rule = linkage(link, threshold)
    hubs = pairs.select(F.explode(F.array("a", "b")).alias("id"), F.concat_ws("-", F.least("a", "b"), F.greatest("a", "b")).alias("key"))
    known = items.where("event is not null").select("id", F.concat(F.lit("e"), F.col("event")).alias("key"))
    part = components_by_key(hubs.union(known).union(items.select("id", F.concat(F.lit("i"), F.col("id")).alias("key"))))
    each = items.join(part, "id").select("component", F.lit(0).alias("kind"), "id", F.lit(None).cast("long").alias("b"), F.col("at").cast("double").alias("x"), F.col("event").cast("long").alias("event"))
    links = pairs.join(part.withColumnRenamed("id", "a"), "a").select("component", F.lit(1), "a", "b", F.col("score").cast("double"), F.lit(None).cast("long"))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        score = {}
        for r in pdf[pdf.kind == 1].itertuples():
            score[int(r.id), int(r.b)] = score[int(r.b), int(r.id)] = r.x
        members: dict[int, list[int]] = {}
        rows = pdf[pdf.kind == 0].sort_values(["x", "id"])
        for r in rows[rows.event.notna()].itertuples():
            members.setdefault(int(r.event), []).append(int(r.id))
        for r in rows[rows.event.isna()].itertuples():
            found = []
            for event, own in members.items():
                s = [score.get((int(r.id), m), 0.0) for m in own]
                if rule(s):
                    found.append((-sum(s) / len(s), -sum(x >= threshold for x in s), event))
            members.setdefault(min(found)[2] if found else int(r.id), []).append(int(r.id))
        into: dict[int, int] = {}
        names = sorted(members)
        for i, old in enumerate(names if merge else []):
            for young in names[i + 1 :]:
                if old in into or young in into:
                    continue
                s = [score.get((a, b), 0.0) for a in members[old] for b in members[young]]
                if sum(x >= threshold for x in s) >= 2 and sum(s) / len(s) >= threshold:
                    into[young] = old
        out = [(m, event, into.get(event)) for event, own in members.items() for m in own]
        return pd.DataFrame(out, columns=["id", "event", "merged_into"]).astype({"merged_into": "Int64"})

    return each.union(links).groupBy("component").applyInPandas(fold, "id long, event long, merged_into long")


def average_link(ids: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """``id, cluster``: greedy merging by descending score where the mean of all cross pairs reaches the threshold."""
    hubs = pairs.select(F.explode(F.array("a", "b")).alias("id"), F.concat_ws("-", "a", "b").alias("key"))
    part = components_by_key(hubs.union(ids.select("id", F.concat(F.lit("i"), F.col("id")).alias("key"))))
    each = ids.join(part, "id").select("component", F.col("id").alias("a"), F.lit(None).cast("long").alias("b"), F.lit(None).cast("double").alias("score"))
    links = pairs.join(part.withColumnRenamed("id", "a"), "a").select("component", "a", "b", "score")

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf[pdf.b.notna()]
        score = {frozenset((int(r.a), int(r.b))): r.score for r in rows.itertuples()}
        of = {int(i): [int(i)] for i in pdf[pdf.b.isna()].a}
        for _, a, b in sorted((-s, *sorted(k)) for k, s in score.items()):
            x, y = of[a], of[b]
            if x is not y and sum(score.get(frozenset((i, j)), 0.0) for i in x for j in y) / (len(x) * len(y)) >= threshold:
                x.extend(y)
                for j in y:
                    of[j] = x
        return pd.DataFrame([(i, min(own)) for i, own in of.items()], columns=["id", "cluster"])

    return each.union(links).groupBy("component").applyInPandas(fold, "id long, cluster long")


#: Words of a set up to which pairs of its words are keys; larger sets meet by single words.
WIDE = 100
#: Pairs of small components that one group of ``applyInPandas`` takes.
LOT = 50_000


def alike(sets: DataFrame, least_shared: int, least_jaccard: float) -> DataFrame:
    """``a, b`` with a < b: pairs of ``sets(id, words)``, distinct words, that share
    ``least_shared`` words or more and ``least_jaccard`` of their union.

    Two such sets have k words in common among the first ``size - t + k`` of each,
    rarest first, where t is the least that a set of this size can share. Pairs of
    these words are keys (k = 2); single ones are (k = 1) where one word is enough
    or a set has more than ``WIDE`` words. What meets is compared exactly.
    """
    words = sets.select("id", F.explode("words").alias("word"))
    rare = words.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    order = words.join(rare, "word").groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("df", "word"))), lambda x: x["word"]).alias("w"))
    order = order.withColumn("n", F.size("w")).withColumn("t", F.greatest(F.lit(least_shared), F.ceil(F.lit(least_jaccard) * F.col("n"))))
    firsts = lambda k: order.select("id", "n", F.expr(f"slice(w, 1, cast(least(n, n - t + {k}) as int))").alias("w"))
    single = firsts(1).select("id", F.explode("w").alias("x")).select("id", F.xxhash64("x").alias("key"))
    if least_shared >= 2:
        near = firsts(2).where(F.col("n") <= WIDE).select("id", "w", F.posexplode("w").alias("at", "x"))
        both = near.select("id", "x", F.explode(F.expr("slice(w, at + 2, size(w))")).alias("y")).select("id", F.xxhash64("x", "y").alias("key"))
        large = order.where(F.col("n") >= least_jaccard * WIDE).select("id")
        keys = both.union(single.join(large, "id", "left_semi"))
    else:
        keys = single
    keys = written(keys)
    met = keys.select(F.col("id").alias("a"), "key").join(keys.select(F.col("id").alias("b"), "key"), "key").where("a < b").select("a", "b").distinct()
    met = met.join(sets.select(F.col("id").alias("a"), F.col("words").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("words").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return met.where((shared >= least_shared) & (shared >= F.lit(least_jaccard) * (F.size("x") + F.size("y") - shared))).select("a", "b")


def complete_link(items: DataFrame, least_shared: int = 3, least_jaccard: float = 0.55) -> DataFrame:
    """``id, bucket`` of ``items(id, words)``: in the order of ids each item joins
    the first bucket all of whose members share enough words with it, else it
    founds one of its id; an item with too few words is alone.

    Items of one set of words share a bucket, so the first of them stands for
    all. Only items that are alike can meet: components of alike pairs are
    whole in a group of ``applyInPandas``, which takes as many steps as pairs.
    """
    if least_shared < 1 or least_jaccard > 1:
        raise ValueError("least_shared is 1 or more, least_jaccard is 1 or less")
    own = written(items.select("id", F.array_sort(F.array_distinct(F.array_compact(F.coalesce("words", F.array())))).alias("words")))
    sets = written(own.where(F.size("words") >= least_shared).groupBy("words").agg(F.min("id").alias("id")))
    pairs = written(alike(sets, least_shared, least_jaccard))
    hubs = pairs.select(F.explode(F.array("a", "b")).alias("id"), F.concat_ws("-", "a", "b").alias("key"))
    before = pairs.groupBy(F.col("b").alias("id")).agg(F.collect_list("a").alias("before"))
    each = components_by_key(hubs).join(before, "id", "left").select("component", "id", F.coalesce("before", F.array().cast("array<long>")).alias("before"))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        home: dict[int, int] = {}
        size: Counter[int] = Counter()
        for r in pdf.sort_values("id").itertuples():
            met = Counter(home[int(x)] for x in r.before)
            bucket = home[int(r.id)] = min((g for g, n in met.items() if n == size[g]), default=int(r.id))
            size[bucket] += 1
        return pd.DataFrame(list(home.items()), columns=["first", "bucket"])

    # whole components, some LOT pairs together: a group of its own for each would cost a millisecond
    lots = pairs.count() // LOT + 1
    found = each.groupBy(F.pmod(F.xxhash64("component"), F.lit(lots))).applyInPandas(lambda pdf: fold(pdf), "first long, bucket long")
    firsts = sets.withColumnRenamed("id", "first").join(found, "first", "left").select("words", F.coalesce("bucket", "first").alias("bucket"))
    return own.join(firsts, "words", "left").select("id", F.coalesce("bucket", "id").alias("bucket"))


def continue_ids(before: DataFrame, after: DataFrame, least: int = 2) -> DataFrame:
    """``group, kept``: groups of ``after(group, item)`` take over the id of the
    group of ``before`` they overlap most, in ``least`` items or more, each id
    once and the largest overlap first; rounds of mutual best choices."""
    n = before.withColumnRenamed("group", "old").join(after, "item").groupBy("old", "group").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    left, done = written(n), None
    while not left.isEmpty():
        order = [F.desc("n"), "old", "group"]
        best = left.withColumn("x", F.row_number().over(W.partitionBy("old").orderBy(*order))).withColumn("y", F.row_number().over(W.partitionBy("group").orderBy(*order)))
        taken = written(best.where("x = 1 and y = 1").select("group", F.col("old").alias("kept")))
        done = taken if done is None else done.union(taken)
        left = written(left.join(taken, "group", "left_anti").join(taken.select(F.col("kept").alias("old")), "old", "left_anti"))
    groups = after.select("group").distinct()
    return groups.withColumn("kept", F.lit(None).cast(before.schema["group"].dataType)) if done is None else groups.join(done, "group", "left")


def atoms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For ``mapInPandas`` over (id, text): one row for each number and the word behind it."""
    for pdf in batches:
        found = pdf.text.fillna("").str.findall(r"([0-9]+) ([a-z]+)")
        rows = [(i, n, w) for i, each in zip(pdf.id, found, strict=True) for n, w in each]
        yield pd.DataFrame(rows, columns=["id", "number", "word"])
