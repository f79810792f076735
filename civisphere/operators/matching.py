"""Scores of item pairs: sixteen features from shared keys, a logistic score, tiers and a language guard."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civisphere.functions import stats as S
from civisphere.operators.tables import written

#: Kinds of keys an item has. Kinds of WEIGHTED count by how rare a key is.
WEIGHTED = ("numbers", "names", "terms", "tokens", "chars")
FEATURES = ("time", "far", "numbers", "dates", "names", "place", "conflict", "event_conflict", "terms", "event", "tokens", "title", "chars", "cross", "cross_tokens", "cross_chars")
FAR_HOURS = 72.0
TIERS = ("certain", "probable", "possible")
#: What texts of joined tokens are made of, so that a gram of ``GRAM`` characters is a number.
ALPHABET, GRAM = " abcdefghijklmnopqrstuvwxyz0123456789", 4
GRAMS = len(ALPHABET) ** GRAM
#: Parts of the table of gram counts, and rows of one Arrow batch.
BLOCKS, BATCH = len(ALPHABET), 256


def weights(keys: DataFrame, total: int) -> DataFrame:
    """``kind, key, w``: ln((n + 1) / (items with the key + 1)) + 1 of ``keys(id, kind, key, n)``."""
    df = keys.where(F.col("kind").isin(*WEIGHTED)).groupBy("kind", "key").agg(F.count(F.lit(1)).alias("df"))
    return df.select("kind", "key", (F.log(F.lit(total + 1.0) / (F.col("df") + 1)) + 1).alias("w"))


def weighted(keys: DataFrame, total: int) -> DataFrame:
    """``id, kind, key, w``: title tokens weigh as tokens, grams are parts of a unit vector, other kinds weigh 1."""
    table = weights(keys, total)
    base = F.when(F.col("kind") == "title", "tokens").otherwise(F.col("kind"))
    rows = keys.withColumn("base", base).join(table.withColumnRenamed("kind", "base"), ["base", "key"], "left").withColumn("w", F.coalesce("w", F.lit(1.0)))
    grams = rows.where("kind = 'chars'").withColumn("w", (F.log("n") + 1) * F.col("w"))
    norm = grams.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    grams = grams.join(norm, "id").select("id", "kind", "key", (F.col("w") / F.col("norm")).alias("w"))
    return rows.where("kind <> 'chars'").select("id", "kind", "key", "w").union(grams)


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the distinct grams of the texts of an item, ascending, and how often each comes."""
    place = np.full(128, -1, np.int32)
    place[[ord(c) for c in ALPHABET]] = np.arange(len(ALPHABET))
    found = [np.zeros(0, np.int32)]
    for text in texts:
        x = place[np.frombuffer((text or "").encode(), np.uint8)]
        if len(x) >= GRAM:
            if x.min() < 0:
                raise ValueError("texts have lower-case letters, digits and spaces alone")
            code = x[: len(x) - GRAM + 1]
            for k in range(1, GRAM):
                code = code * len(ALPHABET) + x[k : len(x) - GRAM + 1 + k]
            found.append(code)
    return np.unique(np.concatenate(found), return_counts=True)


def gram_counts(texts: DataFrame) -> np.ndarray:
    """How many items of ``texts(id, texts)`` have each gram. A task adds up its
    own table; the driver gets a sum of ``GRAMS`` numbers, whatever the corpus."""
    size = GRAMS // BLOCKS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(GRAMS, np.int32)
        for batch in batches:
            for each in batch.column(0).to_pylist():
                own[grams(each)[0]] += 1
        for k, part in enumerate(own.reshape(BLOCKS, size)):
            if len(at := np.flatnonzero(part).astype(np.int32)):
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([at.tobytes()], pa.binary()), pa.array([part[at].tobytes()], pa.binary())], ["k", "at", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, at, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own.setdefault(k, np.zeros(size, np.int64))[np.frombuffer(at, np.int32)] += np.frombuffer(n, np.int32)
        for k, part in own.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["k", "n"])

    parts = texts.select("texts").mapInArrow(count, "k int, at binary, n binary").repartition(BLOCKS, "k").mapInArrow(add, "k int, n binary")
    out = np.zeros((BLOCKS, size), np.int64)
    for r in parts.collect():
        out[r["k"]] = np.frombuffer(r["n"], np.int64)
    return out.reshape(-1)


def gram_likeness(pairs: DataFrame, texts: DataFrame, total: int) -> DataFrame:
    """``a, b, chars``: the product of the unit vectors of weighted grams, as kind
    chars of ``keys`` gives it, for ``texts(id, text)`` of joined tokens. A pair
    listed m times has m times the product, as posting joins have it."""
    spark = pairs.sparkSession
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= BATCH:
        spark.conf.set(key, str(BATCH))
    texts = written(texts.groupBy("id").agg(F.collect_list("text").alias("texts")))
    shared = spark.sparkContext.broadcast(np.log((total + 1.0) / (gram_counts(texts) + 1)) + 1)

    def vector(each: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        at, n = grams(each)
        w = (np.log(n) + 1) * shared.value[at]
        return at, w / np.sqrt((w * w).sum() or 1.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for m, x, y in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)), strict=True):
                (at, w), (to, v) = vector(x), vector(y)
                _, i, j = np.intersect1d(at, to, assume_unique=True, return_indices=True)
                out.append(float(w[i] @ v[j]) * m)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.float64())], ["a", "b", "chars"])

    met = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("m"))
    met = met.join(texts.select(F.col("id").alias("a"), F.col("texts").alias("x")), "a").join(texts.select(F.col("id").alias("b"), F.col("texts").alias("y")), "b")
    kind = pairs.schema["a"].dataType.simpleString()
    return met.select("a", "b", "m", "x", "y").mapInArrow(run, f"a {kind}, b {kind}, chars double")


def features(pairs: DataFrame, items: DataFrame, keys: DataFrame, total: int, chars: DataFrame | None = None) -> DataFrame:
    """``a, b`` and ``FEATURES`` of ``pairs(a, b)``.

    ``items`` has ``id, at, lang`` (``at`` in seconds, null if unknown) and
    ``keys`` has ``id, kind, key, n`` with the kinds numbers, dates, names,
    place, head_place, terms, event, title_event, tokens, title and chars. The
    pairs meet the keys of one side and then those of the other by equi-joins,
    so no item is compared with another that is not in a pair. With ``chars(a,
    b, chars)`` of ``gram_likeness``, keys have no kind chars.
    """
    w = written(weighted(written(keys), total))
    # an event of a title that the other item names anywhere: matched across kinds
    cross = lambda kind, name: w.where(F.col("kind") == kind).withColumn("kind", F.lit(name))
    left = w.union(cross("title_event", "ev1")).union(cross("terms", "ev2")).withColumnsRenamed({"id": "a", "w": "wa"})
    right = w.union(cross("terms", "ev1")).union(cross("title_event", "ev2")).withColumnsRenamed({"id": "b", "w": "wb"})
    met = pairs.select("a", "b").join(left, "a").join(right, ["b", "kind", "key"])
    own = F.when(F.col("kind") == "chars", F.col("wa") * F.col("wb")).otherwise(F.col("wa"))
    mark = F.col("key").startswith("d:")
    shared = met.groupBy("a", "b").pivot("kind", ["numbers", "dates", "names", "place", "terms", "event", "tokens", "title", "chars", "ev1", "ev2"]).agg(F.sum(own).alias("w"), F.max(mark.cast("int")).alias("day"))
    tot = w.groupBy("id").pivot("kind", ["numbers", "names", "terms", "tokens", "title", "head_place", "title_event"]).agg(F.sum("w"))
    side = lambda x: items.select("id", "at", "lang").join(tot, "id", "left").select(F.col("id").alias(x), *(F.col(c).alias(f"{x}_{c}") for c in ("at", "lang", "numbers", "names", "terms", "tokens", "title", "head_place", "title_event")))
    p = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").join(shared, ["a", "b"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    sums = lambda k: (zero(f"{k}_w"), zero(f"a_{k}"), zero(f"b_{k}"))
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    hours = F.abs(F.col("a_at") - F.col("b_at")) / 3600.0
    langs = F.coalesce((F.col("a_lang") != F.col("b_lang")), F.lit(False))
    if chars is not None:
        p = p.drop("chars_w").join(chars.withColumnRenamed("chars", "chars_w"), ["a", "b"], "left")
    tokens, chars = S.jaccard(*sums("tokens")), zero("chars_w")
    both = lambda k: F.col(f"a_{k}").isNotNull() & F.col(f"b_{k}").isNotNull()
    made = {
        "time": S.time_nearness(hours), "far": flag(F.coalesce(hours > FAR_HOURS, F.lit(False))), "numbers": S.dice(*sums("numbers")),
        "dates": F.when(F.col("dates_day") == 1, 1.0).when(F.col("dates_w").isNotNull(), 0.5).otherwise(0.0), "names": S.dice(*sums("names")),
        "place": flag(F.col("place_w").isNotNull()), "conflict": flag(both("head_place") & F.col("place_w").isNull()),
        "event_conflict": flag(both("title_event") & F.col("ev1_w").isNull() & F.col("ev2_w").isNull()), "terms": S.dice(*sums("terms")),
        "event": flag(F.col("event_w").isNotNull()), "tokens": tokens, "title": S.overlap(*sums("title")), "chars": chars,
        "cross": flag(langs), "cross_tokens": F.when(langs, tokens).otherwise(0.0), "cross_chars": F.when(langs, chars).otherwise(0.0),
    }
    return p.select("a", "b", *(made[f].alias(f) for f in FEATURES))


def scored(rows: DataFrame, weight: dict[str, float], bars: dict[str, float]) -> DataFrame:
    """Adds ``score`` and ``tier``: the logistic of the weighted features, and the
    first tier whose bar it reaches. A pair across languages that shares no name,
    place or number is possible at most."""
    z = reduce(Column.__add__, (F.col(f) * F.lit(weight.get(f, 0.0)) for f in FEATURES), F.lit(weight.get("bias", 0.0)))
    score = S.sigmoid(z)
    guard = (F.col("cross") == 0) | (F.col("names") > 0) | (F.col("place") > 0) | (F.col("numbers") > 0)
    tier = F.when((score >= bars["certain"]) & guard, "certain").when((score >= bars["probable"]) & guard, "probable").when(score >= bars["possible"], "possible")
    return rows.withColumn("score", score).withColumn("tier", tier)
