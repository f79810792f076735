"""Operators on texts, pages and addresses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from civisphere.functions import text as T
from civisphere.functions import url as U

#: Near-duplicate rule: shingles of 3 words, at least 6, Jaccard 3/5.
RUN, LEAST, NUM, DEN = 3, 6, 3, 5


def near_duplicate_pairs(docs: DataFrame) -> DataFrame:
    """Pairs ``a_id < b_id`` of similar texts with ``shared`` and ``total`` shingles.

    Texts with the same shingles are one class, named by its smallest id, so
    copies do not multiply; pairs are between classes. Candidates share a
    shingle of their prefixes, rarest first: a pair of similarity t
    must share one of the first n - ceil(t n) + 1 (prefix filter).
    """
    words = docs.select(F.col("doc_id").alias("id"), T.tokens(F.col("text")).alias("w"))
    hashed = words.select("id", F.sort_array(F.transform(T.shingles(F.col("w"), RUN), lambda x: F.xxhash64(x))).alias("h"))
    # the size is asked of an aggregate: asked of the array, it would be pushed below the words and part them again for each run
    sets = hashed.groupBy(F.sha2(F.array_join(F.col("h").cast("array<string>"), ","), 256).alias("d")).agg(F.min("id").alias("id"), F.any_value("h").alias("h"))
    sets = sets.select("id", "h", F.size("h").alias("n")).where(F.col("n") >= LEAST)
    each = sets.select("id", "n", F.explode("h").alias("k"))
    ranked = each.join(each.groupBy("k").agg(F.count(F.lit(1)).alias("df")), "k").groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("df", "k"))).alias("r"))
    prefix = F.slice("r", F.lit(1), F.col("n") - F.ceil(F.col("n") * NUM / DEN).cast("int") + 1)
    keyed = ranked.select("id", "n", F.explode(prefix).alias("x")).where("x.df > 1").select("id", "n", "x.k")
    a, b = keyed.select(F.col("id").alias("a_id"), F.col("n").alias("na"), "k"), keyed.select(F.col("id").alias("b_id"), F.col("n").alias("nb"), "k")
    pairs = a.join(b, "k").where((F.col("a_id") < F.col("b_id")) & (DEN * F.least("na", "nb") >= NUM * F.greatest("na", "nb"))).select("a_id", "b_id").distinct()
    pairs = pairs.join(sets.select(F.col("id").alias("a_id"), F.col("h").alias("ha")), "a_id").join(sets.select(F.col("id").alias("b_id"), F.col("h").alias("hb")), "b_id")
    shared = F.size(F.array_intersect("ha", "hb"))
    out = pairs.select("a_id", "b_id", shared.cast("long").alias("shared"), (F.size("ha") + F.size("hb") - shared).cast("long").alias("total"))
    return out.where(DEN * F.col("shared") >= NUM * F.col("total"))


def repeated_headlines(docs: DataFrame) -> DataFrame:
    """First lines that come more than once, with how often and the first id."""
    head = F.trim(T.fold(F.substring_index("text", "\n", 1)))
    return docs.select(head.alias("headline"), "doc_id").where("headline <> ''").groupBy("headline").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


def word_runs(rows: DataFrame, key: str, n: int) -> DataFrame:
    """``key, g``: runs of n words of whole texts, repeats included. A row for
    each place is made inside generated code, with no array of runs."""
    own = rows.select(key, T.tokens(F.col("text")).alias("w")).where(F.size("w") >= n)
    at = own.select(key, "w", F.explode(F.sequence(F.lit(0), F.size("w") - n)).alias("i"))
    return at.select(key, F.concat_ws(" ", *(F.get("w", F.col("i") + k) for k in range(n))).alias("g"))


def counted_small(table: DataFrame, rows: int = 200_000) -> DataFrame:
    """Broadcast a table that is counted to have few short rows; beyond, both sides are shuffled."""
    return F.broadcast(table) if table.count() <= rows else table


def leak_scan(docs: DataFrame, protected: DataFrame, n: int = 4) -> DataFrame:
    """Documents that hold word n-grams of protected texts, with how many and of
    how many items. Where the protected grams are few they go to the documents,
    whose own grams then meet them without a shuffle."""
    grams = word_runs(protected, "item_id", n).distinct()
    own = word_runs(docs, "doc_id", n)
    return own.join(counted_small(grams), "g").groupBy("doc_id").agg(F.countDistinct("g").alias("grams"), F.countDistinct("item_id").alias("items"))


def stemmed_tokens(docs: DataFrame, least: int = 3) -> DataFrame:
    """``doc_id, token, n``: stemmed tokens of whole texts, with counts."""
    own = docs.select("doc_id", F.explode(T.tokens(F.col("text"))).alias("t"))
    return own.where(F.length("t") >= least).select("doc_id", T.light_stem(F.col("t")).alias("token")).groupBy("doc_id", "token").agg(F.count(F.lit(1)).alias("n"))


def idf(tokens: DataFrame, documents: int) -> DataFrame:
    """Document frequency and log((n + 1) / (df + 1)) + 1 of each token."""
    return tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).withColumn("idf", F.log(F.lit(documents + 1.0) / (F.col("df") + 1)) + 1)


def tfidf_norm(tokens: DataFrame, documents: int) -> DataFrame:
    """Length of each document's vector of (1 + ln n) idf, and its number of terms."""
    w = (1 + F.log(F.col("n").cast("double"))) * F.col("idf")
    return tokens.join(idf(tokens, documents), "token").groupBy("doc_id").agg(F.count(F.lit(1)).alias("terms"), F.round(F.sqrt(F.sum(w * w)), 6).alias("norm"))


def blocking_pairs(rows: DataFrame, items: int, span: int = 7 * 86400) -> DataFrame:
    """Pairs of ``rows(id, key, t)`` that share a rare key (df <= max(30, 4 % of
    all)) within ``span`` seconds, with how many keys they share.

    The time bound is part of the join: each row meets the spans next to its
    own, so a key that is common over years makes no pairs across them. A row
    without a time or a key has no pairs.
    """
    cap = max(30, -(-4 * items // 100))
    rare = rows.groupBy("key").agg(F.count(F.lit(1)).alias("df")).where(f"df between 2 and {cap}").select("key")
    own = rows.join(rare, "key").withColumn("at", F.floor(F.col("t") / span))
    a = own.select("key", F.col("id").alias("a_id"), F.col("t").alias("ta"), "at")
    b = own.select("key", F.col("id").alias("b_id"), F.col("t").alias("tb"), F.explode(F.array(F.col("at") - 1, F.col("at"), F.col("at") + 1)).alias("at"))
    near = (F.col("a_id") < F.col("b_id")) & (F.abs(F.col("ta") - F.col("tb")) <= span)
    return a.join(b, ["key", "at"]).where(near).groupBy("a_id", "b_id").agg(F.count(F.lit(1)).alias("keys"))


def dedupe_urls(pages: DataFrame) -> DataFrame:
    """Every page with its canonical address, id and why it stays or goes: the
    first page of an address is kept, later ones are duplicates."""
    out = pages.select("page_id", "url", U.canonical_url(F.col("url")).alias("canonical"), U.stable_id(F.col("url"), F.lit(""), F.lit("")).alias("item_id"))
    w = W.partitionBy("canonical").orderBy("page_id")
    return out.withColumn("reason", F.when(F.row_number().over(w) == 1, "kept").otherwise("duplicate_url"))


def takedown(pages: DataFrame, hosts: DataFrame) -> DataFrame:
    """Pages whose host is neither a rule's nor below it. A host is exploded to
    its suffixes, so rules are met by an equi-join whatever their number."""
    own = pages.withColumn("host", U.host(F.col("url")))
    labels = F.split("host", r"\.")
    suffix = own.select("page_id", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).alias("rule"))
    gone = suffix.join(hosts, "rule", "left_semi").select("page_id").distinct()
    return own.join(gone, "page_id", "left_anti")


def topics(docs: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """``doc_id, topic``: every topic whose pattern the text meets, else ``other``."""
    low = T.fold(F.col("text"))
    found = F.filter(F.array(*(F.when(low.rlike(p), F.lit(name)) for name, p in rules)), lambda x: x.isNotNull())
    return docs.select("doc_id", "source", F.explode(F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("other")))).alias("topic"))
