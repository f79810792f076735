"""RSS and Atom feeds as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from civisphere.functions import url as U

_ITEM = r"(?is)<(?:item|entry)[\s>].*?</(?:item|entry)>"


def _field(item: Column, *names: str) -> Column:
    """First of the elements, CDATA opened, entities read, null if there is none."""
    found = [F.regexp_extract(item, rf"(?is)<{n}(?:\s[^>]*)?>(.*?)</{n}>", 1) for n in names]
    out = F.coalesce(*(F.when(F.trim(x) != "", x) for x in found))
    out = F.regexp_replace(out, r"(?s)^\s*<!\[CDATA\[(.*?)\]\]>\s*$", "$1")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(char))
    return F.trim(out)


def when(text: Column) -> Column:
    """ISO-8601 with an offset or RFC-822 as a timestamp; anything else, and
    years outside 1990..2100, null."""
    iso = F.when(text.rlike(r"(Z|[+-]\d\d:?\d\d)$"), F.try_to_timestamp(text))
    rfc = F.try_to_timestamp(F.regexp_replace(F.regexp_replace(text, r"^[A-Za-z]{3},\s*", ""), "(GMT|UTC)$", "+0000"), F.lit("d MMM yyyy HH:mm:ss Z"))
    at = F.coalesce(iso, rfc)
    return F.when(F.year(at).between(1990, 2100), at)


def parse_feeds(raw: DataFrame, source: str = "source", body: str = "body") -> DataFrame:
    """``source, position, title, url, summary, guid, author, published_at, item_id``.

    One row for each item that has a title or an address. Broken markup
    outside of an item does no harm.
    """
    items = raw.select(source, F.posexplode(F.regexp_extract_all(body, F.lit(_ITEM), F.lit(0))).alias("position", "item"))
    i = F.col("item")
    link = F.coalesce(_field(i, "link"), F.nullif(F.regexp_extract(i, r"""(?is)<link[^>]*href=["']([^"']+)""", 1), F.lit("")))
    out = items.select(source, "position", _field(i, "title").alias("title"), link.alias("url"), _field(i, "description", "summary", "content").alias("summary"), _field(i, "guid", "id").alias("guid"), _field(i, "dc:creator", "author").alias("author"), when(_field(i, "pubDate", "published", "updated", "dc:date")).alias("published_at"))
    out = out.where("title is not null or url is not null")
    return out.withColumn("item_id", U.stable_id(F.col("url"), F.col(source), F.coalesce("guid", "title")))


def merge_pages(items: DataFrame, source: str = "source") -> DataFrame:
    """Items of all pages of a source, the first of each id."""
    w = W.partitionBy(source, "item_id").orderBy("position")
    return items.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def newest_outcome(runs: DataFrame) -> DataFrame:
    """Newest run of each source; at one time an outcome beats an error."""
    w = W.partitionBy("source").orderBy(F.desc("stamp"), F.asc("is_error"))
    return runs.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")
