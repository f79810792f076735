"""Mixing sources to target weights by iterative proportional fitting.

Token weights of the cells (source, language, topic) are raked to the target
totals of each marginal in turn. Documents are then sampled with the
probability that their cell's weight calls for. Built with DataFrame
functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from civisphere.llm.common import Scratch

#: Exponents that flatten a marginal's token shares to its target shares.
FLATTEN = {"source": 0.7, "lang": 0.8, "topic": 0.9}
#: Most sweeps, those of one job, and how near marginals come to their targets.
SWEEPS, AT_ONCE, TOLERANCE = 40, 10, 1e-9
#: Digits of a ratio; cells up to which they stay in one partition.
DIGITS, FEW = 6, 100_000
#: Bytes of a token, about.
TOKEN_BYTES = 4
#: First rule that holds names the topic. Fixed values.
TOPICS = (("legal", "license"), ("contact", "@"), ("code", "{"), ("web", "http"))
LONG = 8000


def tokens_of(text: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.octet_length(text) / F.lit(TOKEN_BYTES))).cast("long")


def topic_of(text: Column) -> Column:
    rule = F.when(F.lit(False), F.lit(""))
    for name, mark in TOPICS:
        rule = rule.when(F.contains(text, F.lit(mark)), F.lit(name))
    return rule.when(F.octet_length(text) >= LONG, F.lit("long")).otherwise(F.lit("prose"))


def targets(cells: DataFrame, column: str, power: float) -> DataFrame:
    """``v, target`` of a marginal: shares to ``power``, scaled to all tokens."""
    own = cells.groupBy(F.col(column).alias("v")).agg(F.sum("tokens").alias("t"))
    power_of = F.pow(F.col("t").cast("double"), F.lit(power))
    whole = own.agg(F.sum("t").alias("whole"), F.sum(power_of).alias("norm")).first()
    return own.select("v", (power_of / F.lit(whole["norm"] or 1.0) * F.lit(float(whole["whole"] or 0))).alias("target"))


def given(cells: DataFrame, column: str, shares: dict[str, float]) -> DataFrame:
    """``v, target`` of a marginal from weights by value; values without a weight keep their tokens."""
    own = cells.groupBy(F.col(column).alias("v")).agg(F.sum("tokens").alias("t"))
    weight = F.create_map(*(F.lit(x) for k, w in shares.items() for x in (str(k), float(w))))[F.col("v")] if shares else F.lit(None).cast("double")
    own = own.withColumn("w", weight)
    named = own.where("w is not null").agg(F.sum("t").alias("t"), F.sum("w").alias("w")).first()
    return own.select("v", F.when(F.col("w").isNull(), F.col("t").cast("double")).otherwise(F.col("w") / F.lit(named["w"] or 1.0) * F.lit(float(named["t"] or 0))).alias("target"))


def rake(cells: DataFrame, goals: dict[str, DataFrame], scratch: Scratch, sweeps: int = SWEEPS, tolerance: float = TOLERANCE) -> DataFrame:
    """Fit ``weight`` of ``cells`` (with ``tokens``) to the target totals.

    ``goals`` maps a column to a table of its values ``v`` and ``target``. One
    sweep scales to each marginal once. Sweeps go on until every marginal is
    within ``tolerance`` of its target, ``sweeps`` at most; targets that no
    weights meet (a value that comes with one other value only, say) end there.
    Few cells stay in one partition, so a job of ``AT_ONCE`` sweeps has no shuffle.
    """
    now = cells
    for k, (column, goal) in enumerate(goals.items()):
        now = now.join(goal.withColumnRenamed("target", f"target{k}"), F.col(column) == F.col("v")).drop("v")
    now = scratch.save(now.withColumn("weight", F.col("tokens").cast("double")), "cells")
    few = now.count() <= FEW
    for done in range(0, sweeps, AT_ONCE):
        now = now.coalesce(1) if few else now
        for _ in range(min(AT_ONCE, sweeps - done)):
            for k, column in enumerate(goals):
                now = now.withColumn("weight", F.col("weight") * F.col(f"target{k}") / F.sum("weight").over(W.partitionBy(column)))
        now = scratch.save(now, "weights")
        off = [F.max(F.abs(F.col(f"have{k}") / F.col(f"target{k}") - 1)) for k in range(len(goals))]
        have = now.select("*", *(F.sum("weight").over(W.partitionBy(c)).alias(f"have{k}") for k, c in enumerate(goals)))
        if (have.agg(F.greatest(*off, F.lit(0.0)) if off else F.lit(0.0)).first()[0] or 0.0) <= tolerance:
            break
    return now


def _draw(doc_id: Column) -> Column:
    """A number from 0 to 1 that the id fixes."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 12), 16, 10).cast("double") / float(1 << 48)


def mix(docs: DataFrame, sweeps: int = SWEEPS, flatten: dict[str, float] = FLATTEN, keep: bool = False, goals: dict[str, dict[str, float]] | None = None, tokens: Column | None = None) -> DataFrame:
    """Sampling probability of every document and whether it is sampled.

    ``goals`` gives target weights by value for source, lang or topic; a
    marginal without them is flattened by its exponent. ``tokens`` counts the
    tokens of a row (by default a fourth of the bytes). Returns ``doc_id``
    (with ``keep`` all columns), ``topic``, ``tokens``, ``probability``,
    ``weight`` and ``sampled``. A cell's ratio is its fitted weight over its
    tokens: documents of a cell over its share are kept with that probability,
    others surely; ``weight`` (ratio over probability) makes the sampled tokens
    meet the targets in expectation. The draw is a hash of the id, so it is
    the same on every run, and copies of an id are drawn together. Null source,
    lang or text count as an empty string. Columns of these names are replaced,
    others may have any name; an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    made = ["topic", "tokens", "probability", "weight", "sampled"]
    held = [c for c in docs.columns if c not in made] if keep else ["doc_id"]
    plain = lambda c: F.coalesce(docs[c].cast("string"), F.lit(""))
    rows = docs.select(
        F.struct(*(docs[f"`{c}`"] for c in held)).alias("row"), _draw(docs["doc_id"]).alias("draw"), plain("source").alias("source"),
        plain("lang").alias("lang"), topic_of(text).alias("topic"), (tokens_of(text) if tokens is None else tokens).cast("long").alias("tokens"),
    )
    cells = scratch.save(rows.groupBy("source", "lang", "topic").agg(F.sum("tokens").alias("tokens")), "cells")
    want = {c: given(cells, c, (goals or {})[c]) if c in (goals or {}) else targets(cells, c, p) for c, p in flatten.items()}
    fitted = rake(cells, want, scratch, sweeps)
    fitted = scratch.save(fitted.select("source", "lang", "topic", F.round(F.col("weight") / F.col("tokens"), DIGITS).alias("ratio")), "ratios")
    # Spark broadcasts the cells only below its own size limit
    out = rows.join(fitted, ["source", "lang", "topic"])
    probability = F.least(F.lit(1.0), F.col("ratio"))
    return out.select(*(F.col(f"row.`{c}`").alias(c) for c in held), "topic", "tokens", probability.alias("probability"), F.greatest(F.lit(1.0), F.col("ratio")).alias("weight"), (F.col("draw") < probability).alias("sampled"))


def resample(docs: DataFrame, sweeps: int = SWEEPS, flatten: dict[str, float] = FLATTEN) -> DataFrame:
    """``docs`` with every row as often as the ratio of its cell asks for.

    A row comes as often as the whole part of the ratio, and once more with
    the rest as probability, so the tokens of the rows meet the targets in
    expectation without a weight. Rows that ``mix`` samples stay, those of
    cells below their share repeat.
    """
    kept = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    out = mix(docs.select("doc_id", "source", "lang", "text", kept.alias("kept")), sweeps, flatten, keep=True)
    # one of the two is 1
    ratio = F.col("probability") * F.col("weight")
    times = (F.floor(ratio) + (_draw(F.col("doc_id")) < ratio - F.floor(ratio)).cast("long")).cast("int")
    return out.select("kept", F.explode(F.array_repeat(F.lit(0), times))).select("kept.*")


def oracle(sweeps: int = SWEEPS) -> str:
    """DuckDB SQL for ``mix``."""
    topic = " ".join(f"WHEN contains(text, '{m}') THEN '{n}'" for n, m in TOPICS)
    parts = [
        "d AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, coalesce(text, '') AS text FROM documents)",
        f"r AS (SELECT doc_id, source, lang, CASE {topic} WHEN strlen(text) >= {LONG} THEN 'long' ELSE 'prose' END AS topic, greatest(1, ceil(strlen(text) / {TOKEN_BYTES}.0))::BIGINT AS tokens FROM d)",
        "c AS MATERIALIZED (SELECT source, lang, topic, sum(tokens)::BIGINT AS tokens FROM r GROUP BY ALL)",
        "w0 AS MATERIALIZED (SELECT *, tokens::DOUBLE AS weight FROM c)",
    ]
    for c, p in FLATTEN.items():
        parts.append(f"m_{c} AS (SELECT {c}, sum(tokens)::BIGINT AS t FROM c GROUP BY {c})")
        parts.append(f"g_{c} AS MATERIALIZED (SELECT {c}, pow(t::DOUBLE, {p}) / (SELECT sum(pow(t::DOUBLE, {p})) FROM m_{c}) * (SELECT sum(t) FROM m_{c})::DOUBLE AS target FROM m_{c})")
    k = 0
    for _ in range(sweeps):
        for c in FLATTEN:
            parts.append(f"w{k + 1} AS MATERIALIZED (SELECT w.source, w.lang, w.topic, w.tokens, w.weight * g.target / sum(w.weight) OVER (PARTITION BY w.{c}) AS weight FROM w{k} w JOIN g_{c} g ON g.{c} = w.{c})")
            k += 1
    parts.append(f"q AS (SELECT source, lang, topic, round(weight / tokens, {DIGITS}) AS ratio FROM w{k})")
    return (
        "WITH " + ",\n".join(parts) + "\nSELECT r.doc_id, r.topic, r.tokens, least(1.0::DOUBLE, ratio) AS probability, greatest(1.0::DOUBLE, ratio) AS weight,"
        " ('0x' || substr(md5(coalesce(r.doc_id::VARCHAR, '')), 1, 12))::BIGINT / 281474976710656.0 < least(1.0::DOUBLE, ratio) AS sampled FROM r JOIN q USING (source, lang, topic)"
    )
