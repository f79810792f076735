"""Labels and mentions found in texts. Rules are data: lists of tuples that the
caller passes, so a table of them can be kept outside of the code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civisphere.functions import text as T
from civisphere.operators import content as C

#: Control characters, zero-width ones and those that turn the direction of text.
UNSEEN = r"[\x{0000}-\x{001F}\x{007F}-\x{009F}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2069}\x{FEFF}]"
MONEY = r"\$ ?([0-9]{1,3}(?:[ ,][0-9]{3})+(?:\.[0-9]{2})?|[0-9]+(?:\.[0-9]{2})?)"
PERCENT = r"([0-9]+(?:[.,][0-9]+)?) ?%"
NAME = r"[a-z,;] ([A-Z][a-z]{2,}(?: [A-Z][a-z]{2,})*)"
#: Words of street names and what they are written as. Fixed values.
STREET_WORDS = {"st": "saint", "ste": "sainte", "boul": "boulevard", "blvd": "boulevard", "ave": "avenue", "av": "avenue", "ch": "chemin", "rd": "road", "n": "nord", "s": "sud", "e": "est", "o": "ouest"}


def shown(text: Column) -> Column:
    """Text for display: unseen characters go, white space is collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, UNSEEN, ""), "[ \\t]+", " "))


def cents(text: Column) -> Column:
    """Amounts of money in whole cents, in order of appearance."""
    found = F.regexp_extract_all(text, F.lit(MONEY), F.lit(1))
    return F.transform(found, lambda x: F.round(F.regexp_replace(x, "[ ,]", "").cast("decimal(18,2)") * 100, 0).cast("long"))


def basis_points(text: Column) -> Column:
    """Percentages in hundredths of a percent, in order of appearance."""
    found = F.regexp_extract_all(text, F.lit(PERCENT), F.lit(1))
    return F.transform(found, lambda x: F.round(F.replace(x, F.lit(","), F.lit(".")).cast("decimal(18,4)") * 100, 0).cast("long"))


def names(text: Column) -> Column:
    """Distinct runs of capitalised words that do not begin a sentence."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(NAME), F.lit(1)))


def nearest_day(month: Column, day: Column, anchor: Column) -> Column:
    """The date of a month and day without a year that is nearest to ``anchor``
    and within 183 days of it; null for days that do not exist there."""
    years = [F.try_to_timestamp(F.concat_ws("-", F.year(anchor) + k, month, day), F.lit("yyyy-M-d")).cast("date") for k in (-1, 0, 1)]
    fits = F.filter(F.array(*years), lambda x: x.isNotNull() & (F.abs(F.datediff(x, anchor)) <= 183))
    return F.array_min(F.transform(fits, lambda x: F.struct(F.abs(F.datediff(x, anchor)).alias("far"), x.alias("date"))))["date"]


def terms(text: Column, surfaces: list[str]) -> Column:
    """Surfaces found in the folded text, longest first at each place, whole words alone."""
    words = F.concat(F.lit(" "), F.array_join(T.tokens(text), "  "), F.lit(" "))
    each = sorted(surfaces, key=lambda s: (-len(s), s))
    found = F.regexp_extract_all(words, F.lit("|".join(" " + s.replace(" ", "  ") + " " for s in each)), F.lit(0))
    return F.transform(found, lambda x: F.replace(F.trim(x), F.lit("  "), F.lit(" ")))


def street_key(name: Column) -> Column:
    """Key of a street name: folded words, short forms written out, joined by hyphens."""
    table = F.create_map(*(F.lit(x) for kv in STREET_WORDS.items() for x in kv))
    return F.array_join(F.transform(T.tokens(name), lambda w: F.coalesce(F.element_at(table, w), w)), "-")


def first_match(text: Column, rules: list[tuple[str, str, str]], default: str) -> Column:
    """``label, reason, evidence`` of the first rule (label, reason, pattern) that the folded text meets."""
    low = T.fold(text)
    made = [F.when(low.rlike(p), F.struct(F.lit(label).alias("label"), F.lit(reason).alias("reason"), F.regexp_extract(low, f"({p})", 1).alias("evidence"))) for label, reason, p in rules]
    return F.coalesce(*made, F.struct(F.lit(default).alias("label"), F.lit("default").alias("reason"), F.lit("").alias("evidence")))


def units(docs: DataFrame, rules: list[tuple[str, str]], most: int = 5) -> DataFrame:
    """``doc_id, kind, value, rank``: what the patterns of ``rules`` (kind, pattern)
    find, each value of a kind once, the first ``most`` by rule and place."""
    def of(kind: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all("text", F.lit(pattern), F.lit(1)), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("value")))

    found = F.flatten(F.array(*(of(kind, pattern) for kind, pattern in rules)))
    kept = F.slice(F.array_distinct(found), 1, most)
    return docs.select("doc_id", F.posexplode(kept).alias("rank", "u")).select("doc_id", "u.kind", "u.value", (F.col("rank") + 1).alias("rank"))


def places(text: Column, masks: list[str], rules: list[tuple[str, int, str, str | None]]) -> Column:
    """Codes of places (code, rank, pattern, context) by rank: masks are taken
    out of the folded text first, and a rule with a context needs that, too."""
    low = reduce(lambda t, m: F.regexp_replace(t, m, " "), masks, T.fold(text))
    meets = lambda p, c: low.rlike(p) if c is None else low.rlike(p) & low.rlike(c)
    found = F.array(*(F.when(meets(p, c), F.struct(F.lit(rank).alias("rank"), F.lit(code).alias("code"))) for code, rank, p, c in rules))
    return F.transform(F.array_sort(F.filter(found, lambda x: x.isNotNull())), lambda x: x["code"])


def credit_codes(rows: DataFrame, key: str, byline: str, aliases: DataFrame) -> DataFrame:
    """``key, codes``: codes of the byline's segments by an alias table (alias, code)."""
    each = rows.select(key, F.explode(F.split(F.lower(F.col(byline)), "[/|,-]")).alias("alias")).withColumn("alias", F.trim("alias"))
    found = each.join(aliases, "alias").groupBy(key).agg(F.array_sort(F.collect_set("code")).alias("codes"))
    return rows.select(key).join(found, key, "left").withColumn("codes", F.coalesce("codes", F.array().cast("array<string>")))


def origins(docs: DataFrame, official: list[str], wire: str) -> DataFrame:
    """``doc_id, origin``: official sources, then wire marks, then a named byline
    (the first words before a colon or comma), else unknown. A byline that two
    sources or more have is a relay: found by counting sources once for each byline."""
    byline = F.regexp_extract("text", r"^([A-Z][a-z]+(?: [a-z]+)?)[,. ]", 1)
    rows = docs.select("doc_id", "source", "text", byline.alias("byline"))
    shared = rows.where("byline <> ''").groupBy("byline").agg(F.countDistinct("source").alias("k")).where("k >= 2").select("byline", F.lit(True).alias("shared"))
    rows = rows.join(shared, "byline", "left")
    kind = F.when(F.col("source").isin(official), "official").when(T.fold(F.col("text")).rlike(wire), "wire").when(F.col("shared"), "relay").when(F.col("byline") != "", "named").otherwise("unknown")
    return rows.select("doc_id", kind.alias("origin"))


def phrase_hits(docs: DataFrame, phrases: DataFrame, words: int) -> DataFrame:
    """``doc_id, phrase``: phrases of ``words`` words that a document contains.

    The runs of words of a document meet the phrases by an equi-join, whatever
    their number, and each (document, phrase) comes once.
    """
    runs = C.word_runs(docs, "doc_id", words).withColumnRenamed("g", "phrase")
    return runs.join(C.counted_small(phrases.select("phrase").distinct()), "phrase").select("doc_id", "phrase").distinct()


def literal_span(text: Column, quote: Column) -> Column:
    """Whether a quote is a literal part of a text, white space collapsed in both."""
    plain = lambda x: F.trim(F.regexp_replace(x, "[ \\t\\r\\n]+", " "))
    return F.contains(plain(text), plain(quote))


def impacts(topics: Column, table: dict[str, list[str]]) -> Column:
    """Impacts of topics, each once; ``topics`` must be a column of its own."""
    entries = F.create_map(*(x for k, v in table.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    return F.array_distinct(F.flatten(F.filter(F.transform(topics, lambda t: F.element_at(entries, t)), lambda x: x.isNotNull())))


def ownership(rows: DataFrame, flag: str, table: DataFrame) -> DataFrame:
    """Adds ``owner`` from ``table(flag, owner, ref, day)``, if its reference is an
    https address and its day a date; else undeclared. Spark broadcasts the table
    below its own size limit."""
    sound = F.col("ref").rlike("^https://[^/]+") & F.try_to_timestamp("day", F.lit("yyyy-MM-dd")).isNotNull()
    own = table.select(F.col("flag").alias("__flag"), F.when(sound, F.col("owner")).alias("__owner"))
    out = rows.join(own, rows[flag] == F.col("__flag"), "left")
    return out.withColumn("owner", F.coalesce("__owner", F.lit("undeclared"))).drop("__flag", "__owner")


def eastern(at: Column) -> Column:
    """Eastern local time of a UTC time, with the daylight rule of the time-zone database."""
    return F.from_utc_timestamp(at, "America/Toronto")
