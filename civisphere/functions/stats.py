"""Scores, similarities, intervals and times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Z = 1.959964
HALF_LIFE_H, TOLERANCE_S = 36.0, 300
#: Weight of nearness and recency, and nearness by tier. Fixed values.
GEO_WEIGHT, RECENCY_WEIGHT = 0.60, 0.40
NEARNESS = (("city", 1.0), ("region", 0.55), ("country", 0.25))
ELSEWHERE = 0.10


def wilson(k: Column, n: Column, upper: bool = False) -> Column:
    """Bound of the 95 % Wilson interval, within 0 and 1; no trial says nothing, so 0 and 1."""
    p, nn = k / n, n.cast("double")
    mid = p + Z * Z / (2 * nn)
    half = Z * F.sqrt(p * (1 - p) / nn + Z * Z / (4 * nn * nn))
    bound = F.least(F.lit(1.0), (mid + half) / (1 + Z * Z / nn)) if upper else F.greatest(F.lit(0.0), (mid - half) / (1 + Z * Z / nn))
    return F.when(n > 0, bound).otherwise(F.lit(1.0 if upper else 0.0))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def jaccard(shared: Column, a: Column, b: Column) -> Column:
    return F.when(a + b - shared > 0, shared / (a + b - shared)).otherwise(F.lit(0.0))


def dice(shared: Column, a: Column, b: Column) -> Column:
    return F.when(a + b > 0, 2.0 * shared / (a + b)).otherwise(F.lit(0.0))


def overlap(shared: Column, a: Column, b: Column) -> Column:
    return F.when(F.least(a, b) > 0, shared / F.least(a, b)).otherwise(F.lit(0.0))


def recency(age_s: Column) -> Column:
    """Halves every 36 hours; unknown, or more than 300 s ahead: 0."""
    return F.when(age_s.isNull() | (age_s < -TOLERANCE_S), F.lit(0.0)).otherwise(F.pow(F.lit(0.5), F.greatest(age_s, F.lit(0)) / (3600 * HALF_LIFE_H)))


def nearness(tier: Column) -> Column:
    rule = F.when(F.lit(False), F.lit(0.0))
    for name, value in NEARNESS:
        rule = rule.when(tier == name, F.lit(value))
    return rule.otherwise(F.lit(ELSEWHERE))


def rank_score(tier: Column, age_s: Column) -> Column:
    return F.round(GEO_WEIGHT * nearness(tier) + RECENCY_WEIGHT * recency(age_s), 6)


def time_nearness(hours: Column) -> Column:
    """exp(-h / 12); unknown: one half."""
    return F.when(hours.isNull(), F.lit(0.5)).otherwise(F.exp(-F.abs(hours) / 12))


def date_status(published: Column, first_seen: Column) -> Column:
    """missing, out_of_range (years outside 1990..2100), future (over 15 min
    ahead), suspect (over 6 h ahead) or valid."""
    ahead = F.unix_timestamp(published) - F.unix_timestamp(first_seen)
    return (
        F.when(published.isNull(), "missing")
        .when((F.year(published) < 1990) | (F.year(published) > 2100), "out_of_range")
        .when(ahead > 6 * 3600, "suspect")
        .when(ahead > 15 * 60, "future")
        .otherwise("valid")
    )
