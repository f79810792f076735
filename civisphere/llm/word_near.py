"""Near-duplicate documents by word shingles.

Groups of linked SimHash fingerprints, and sets of ``WORDS``-word shingles
with an equal MinHash band, are candidates; these are verified by exact
Jaccard similarity of 0.8 or more, and components are made as in
``line_dedup``. Fingerprints alone would not do here: at similarity 0.8 about
ten of 64 bits differ on average, so a Hamming distance that finds most pairs
is too wide for the pigeonhole principle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civisphere.llm import line_dedup, simhash
from civisphere.llm.common import Scratch

WORDS = 5


def word_sets(docs: DataFrame) -> DataFrame:
    """``doc_id, k1, k2, set``: hashes of the shingles of every whole text and a key of their set.

    Words are what ASCII white space parts, in lower case. Fewer words than a
    shingle has, or none: the whole sequence. Other columns are left out.
    """
    text = F.lower(F.coalesce(docs["text"].cast("string"), F.lit("")))
    words = F.transform(F.regexp_extract_all(text, F.lit("[^ \\t\\n\\x0b\\f\\r]+"), F.lit(0)), lambda w: F.xxhash64(w))
    out = docs.select(docs["doc_id"].alias("doc_id"), words.alias("w"))
    at = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("w") - WORDS))
    shingle = lambda i: F.xxhash64(*(F.get("w", i + k) for k in range(WORDS)))
    out = out.select("doc_id", F.sort_array(F.array_distinct(F.transform(at, shingle))).alias("set"))
    return out.select("doc_id", F.xxhash64("set").alias("k1"), F.xxhash64(F.lit(7), "set").alias("k2"), "set")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc, h1, h2, c`` for every row of ``docs``: its id, 128 bits of its text
    and the component of its set of shingles over pairs of similarity 0.8 or more."""
    scratch = Scratch(docs.sparkSession, "words")
    named = docs.select(F.struct(*line_dedup._named(docs)).alias("doc_id"), docs["text"].cast("string").alias("text"))
    made = scratch.save(word_sets(named), "sets")
    places = made.select("doc_id", "k1", "k2")
    distinct = places.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n"))
    distinct = scratch.save(distinct.withColumn("id", F.monotonically_increasing_id()), "distinct")
    lines = line_dedup.band_keys(made.select("k1", "k2", F.explode("set").alias("h")), ["k1", "k2"])
    lines = scratch.save(lines.join(distinct, ["k1", "k2"]).select("id", "n", "bands", "sig"), "signatures")
    scratch.release()
    members = line_dedup.candidates(lines, scratch)
    # documents equal in id and text have one fingerprint
    linked = simhash.near_duplicates(named).groupBy("doc_id").agg(F.first("component_id").alias("to"))
    linked = places.join(linked, "doc_id").groupBy("k1", "k2").agg(F.min(F.xxhash64("to")).alias("g"))
    linked = scratch.save(distinct.join(linked, ["k1", "k2"]).select("id", "n", "g"), "linked")
    sizes = scratch.save(linked.groupBy("g").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "sizes")
    members = scratch.save(members.select("id", "n", "g", "m").union(linked.join(sizes, "g").select("id", "n", "g", "m")), "candidates")

    def sets_of(ids: DataFrame) -> DataFrame:
        keys = scratch.save(distinct.join(ids, "id").select("id", "k1", "k2"), "keys")
        sets = line_dedup.sieved(made.select("k1", "k2", "set"), keys, "k1", "k2")
        return sets.join(keys, ["k1", "k2"]).groupBy("id").agg(F.first("set").alias("set"))

    comp = line_dedup.components(lines, members, sets_of, scratch)
    to = distinct.join(comp, distinct["id"] == comp["node"], "left").select("k1", "k2", F.coalesce("component", "id").alias("c"))
    out = scratch.save(places.join(scratch.save(to, "named"), ["k1", "k2"]).select("doc_id.doc", "doc_id.h1", "doc_id.h2", "c"), "out")
    scratch.drop(made)
    scratch.release()
    return out


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with one document of each component of near-duplicates.

    The one of the smallest id stays, ids before none; of documents with one id
    that whose text has the smaller hash; of rows equal in id and text one.
    Texts without a word are near-duplicates of each other.
    """
    scratch = Scratch(docs.sparkSession, "kept")
    found = near_duplicates(docs).groupBy("c", "doc", "h1", "h2").agg(F.count(F.lit(1)).alias("n"))
    order = F.struct(F.col("doc").isNull(), "doc", "h1", "h2")
    best = scratch.save(found.groupBy("c").agg(F.min(order).alias("best")), "best")
    marked = found.join(best, "c").select("doc", "h1", "h2", order.eqNullSafe(F.col("best")).alias("stays"), "n").where("not stays or n > 1")
    marked = scratch.save(marked, "marked")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *line_dedup._named(docs))
    same = rows["doc"].eqNullSafe(marked["doc"]) & rows["h1"].eqNullSafe(marked["h1"]) & rows["h2"].eqNullSafe(marked["h2"])
    rows = rows.join(marked, same, "left").select("row", rows["doc"], rows["h1"], rows["h2"], "stays")
    once = rows.where("stays").dropDuplicates(["doc", "h1", "h2"])
    return rows.where("stays is null").union(once).select("row.*")
