"""Document fingerprints: a Merkle tree over paragraphs and sections.

Sections are what blank lines part, paragraphs are the lines of a section,
and the leaves are blocks of up to ``BLOCK`` code points of a paragraph. Every
inner node is the digest of its children's digests, so equal roots mean equal
texts, and differing branches lead to the places of an edit. The root is
made from full leaf digests; the fingerprint is the root with the shortened
digests of all leaves.
Built with SQL functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Code points of a leaf, hex digits of its digest, rows of a stretch of ids.
BLOCK, DIGITS, STRETCH = 64, 8, 1500
#: Most stretches that ids are cut into; bounds what is broadcast.
MOST_STRETCHES = 10_000


def tree(text: Column) -> Column:
    """Sections of paragraphs, each the digests of its leaves, joined by commas."""
    leaves = lambda p: F.array_join(F.transform(F.regexp_extract_all(p, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)), lambda b: F.md5(b)), ",")
    return F.transform(F.split(text, "\n\n"), lambda s: F.transform(F.split(s, "\n"), leaves))


def root(nodes: Column) -> Column:
    """Digest of a tree: paragraphs, then sections, then the document."""
    return F.md5(F.array_join(F.transform(nodes, lambda s: F.md5(F.array_join(F.transform(s, lambda p: F.md5(p)), ""))), ""))


def serialised(nodes: Column) -> Column:
    """``root:leaf,leaf;leaf/leaf`` with ``;`` between paragraphs and ``/`` between sections."""
    listed = F.array_join(F.transform(nodes, lambda s: F.array_join(s, ";")), "/")
    return F.concat(root(nodes), F.lit(":"), F.regexp_replace(listed, f"([0-9a-f]{{{DIGITS}}})[0-9a-f]{{{32 - DIGITS}}}", "$1"))


def leaves_of(fingerprint: Column) -> Column:
    """Distinct leaf digests of a fingerprint."""
    return F.array_distinct(F.regexp_extract_all(F.substring(fingerprint, 34, 2**31 - 1), F.lit(f"[0-9a-f]{{{DIGITS}}}"), F.lit(0)))


def likeness(fa: Column, fb: Column, la: Column, lb: Column) -> Column:
    """1 for equal roots, else the Dice coefficient of the leaves (0 if there are none)."""
    both = F.size(la) + F.size(lb)
    dice = F.when(both > 0, 2.0 * F.size(F.array_intersect(la, lb)) / both).otherwise(F.lit(0.0))
    return F.when(F.substring(fa, 1, 32) == F.substring(fb, 1, 32), F.lit(1.0)).otherwise(dice)


def fingerprint_documents(docs: DataFrame, text_col: str = "text", name: str = "fingerprint") -> DataFrame:
    """Add the fingerprint of every whole text; a null text counts as empty.
    A column of this name is replaced."""
    return docs.withColumn("__tree", tree(F.coalesce(F.col(text_col).cast("string"), F.lit("")))).withColumn(name, serialised(F.col("__tree"))).drop("__tree")


def locate_edits(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Places where two fingerprints differ: adds ``edits``, an array of
    (section, paragraph, leaf), each from 0.

    Sections are compared by place, and only differing ones are entered, then
    their paragraphs and leaves. Equal roots give an empty array.
    """
    parts = lambda c, sep: F.split(c, sep)
    at = lambda arr, i: F.when(i < F.size(arr), F.get(arr, i))
    span = lambda x, y: F.sequence(F.lit(0), F.greatest(F.size(x), F.size(y)) - 1)

    def differing(x: Column, y: Column) -> Column:
        return F.filter(span(x, y), lambda i: ~at(x, i).eqNullSafe(at(y, i)))

    def within(x: Column, y: Column, sep: str) -> tuple[Column, Column]:
        return parts(F.coalesce(x, F.lit("")), sep), parts(F.coalesce(y, F.lit("")), sep)

    sa, sb = parts(F.substring(F.col(a), 34, 2**31 - 1), "/"), parts(F.substring(F.col(b), 34, 2**31 - 1), "/")

    def section(i: Column) -> Column:
        pa, pb = within(at(sa, i), at(sb, i), ";")

        def paragraph(j: Column) -> Column:
            la, lb = within(at(pa, j), at(pb, j), ",")
            return F.transform(differing(la, lb), lambda k: F.struct(i.alias("section"), j.alias("paragraph"), k.alias("leaf")))

        return F.flatten(F.transform(differing(pa, pb), paragraph))

    same = F.substring(F.col(a), 1, 32) == F.substring(F.col(b), 1, 32)
    none = F.array().cast("array<struct<section:int,paragraph:int,leaf:int>>")
    return pairs.withColumn("edits", F.when(same, none).otherwise(F.flatten(F.transform(differing(sa, sb), section))))


def _stretch(bounds: list, key: Column) -> Column:
    """Number of bounds that are not above ``key``: coarse ones first, then within one."""
    if not bounds:
        return F.lit(0)
    step = max(1, math.isqrt(len(bounds)))
    coarse, fine = F.array(*map(F.lit, bounds[::step])), F.array(*map(F.lit, bounds))
    c = F.size(F.filter(coarse, lambda b: b <= key))
    inner = F.slice(fine, F.greatest(c - 1, F.lit(0)) * step + 1, F.lit(step))
    return F.when(c == 0, F.lit(0)).otherwise((c - 1) * step + F.size(F.filter(inner, lambda b: b <= key)))


def with_next(docs: DataFrame, carried: list[str], key: str = "doc_id") -> DataFrame:
    """Add ``next``: the ``carried`` columns of the row that follows by ``key``
    (then by text), the first row for the last one.

    Rows are dealt by stretches of the key at its quantiles. The first row of
    each stretch also stands at the end of the one before, so no task needs
    more than its stretch. At most ``MOST_STRETCHES`` keys are broadcast.
    """
    total = docs.count()
    wanted = min(MOST_STRETCHES, total // STRETCH)
    bounds = []
    if wanted > 1:
        at = docs.agg(F.percentile_approx(key, [i / wanted for i in range(1, wanted)], max(10_000, 20 * wanted)).alias("b")).first()["b"] or []
        bounds = sorted(set(at))
    placed = docs.withColumn("__part", F.coalesce(_stretch(bounds, F.col(key)), F.lit(0)).cast("int")).withColumn("__end", F.lit(0)).withColumn("__tie", F.xxhash64("text"))
    firsts = docs.select(_stretch(bounds, F.col(key)).cast("int").alias("__part"), F.col(key).alias("k")).groupBy("__part").agg(F.min_by("k", F.struct(F.col("k").isNotNull(), "k")).alias("k")).select(F.coalesce("__part", F.lit(0)).alias("__part"), "k").collect()
    firsts = sorted(firsts, key=lambda r: r["__part"])
    if not firsts:
        return placed.withColumn("next", F.struct(*carried)).drop("__part", "__end", "__tie")
    nulls = docs.where(F.col(key).isNull()).limit(1).count() > 0
    first_keys = [None if nulls and not i else r["k"] for i, r in enumerate(firsts)]
    # the head of each stretch goes to the stretch before it, that of the first to the last
    kind = docs.schema[key].dataType.simpleString()
    heads = docs.sparkSession.createDataFrame([(k, firsts[i - 1]["__part"]) for i, k in enumerate(first_keys)], f"k {kind}, to int")
    copies = docs.join(F.broadcast(heads), docs[key].eqNullSafe(heads["k"])).withColumn("__tie", F.xxhash64("text"))
    lead = W.partitionBy("to").orderBy("__tie")
    copies = copies.withColumn("__n", F.row_number().over(lead)).where("__n = 1").select(*docs.columns, F.col("to").alias("__part"), F.lit(1).alias("__end"), "__tie")
    w = W.partitionBy("__part").orderBy("__end", F.col(key).asc_nulls_first(), "__tie")
    out = placed.select(*copies.columns).union(copies).withColumn("next", F.lead(F.struct(*carried)).over(w))
    return out.where("__end = 0").drop("__part", "__end", "__tie")


def compare_edited(docs: DataFrame) -> DataFrame:
    """Fingerprints of every whole text and of an edited copy.

    The edit replaces the last half (rounded down) of the code points by the
    first as many of the next document by ``doc_id`` (all of a shorter one).
    Returns ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next``. Null texts count as empty. Rows that share an id
    follow each other in the order of a hash of their texts; a null id comes
    first. A single document is its own next one; an empty table gives no rows.
    """
    base = docs.select("doc_id", F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
    base = with_next(fingerprint_documents(base), ["text", "fingerprint"])
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - half), F.substring(F.col("next.text"), F.lit(1), half))
    out = base.select("doc_id", F.length("text").cast("long").alias("n_chars"), "fingerprint", F.col("next.fingerprint").alias("next_fingerprint"), edited.alias("text"))
    out = fingerprint_documents(out, "text", "edited_fingerprint")
    out = out.select("doc_id", "n_chars", F.sha2("text", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "next_fingerprint")
    out = out.withColumns({"__a": leaves_of(F.col("fingerprint")), "__e": leaves_of(F.col("edited_fingerprint")), "__n": leaves_of(F.col("next_fingerprint"))})
    near = lambda f, l: likeness(F.col("fingerprint"), F.col(f), F.col("__a"), F.col(l))
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", near("edited_fingerprint", "__e").alias("near_edited"), near("next_fingerprint", "__n").alias("near_next"))


#: DuckDB SQL for ``compare_edited``.
ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT *, coalesce(lead(text) OVER (ORDER BY doc_id), first_value(text) OVER (ORDER BY doc_id)) AS next_text FROM d),
e AS (SELECT *, substr(text, 1, length(text) - length(text) // 2) || substr(next_text, 1, length(text) // 2) AS edited FROM n),
u AS (SELECT text AS t FROM e UNION SELECT edited FROM e),
k AS (SELECT t, list_transform(string_split(t, chr(10) || chr(10)), lambda s: list_transform(string_split(s, chr(10)),
  lambda p: array_to_string(list_transform(regexp_extract_all(p, '(?s).{{1,{BLOCK}}}'), lambda b: md5(b)), ','))) AS nodes FROM u),
f AS (SELECT t, md5(array_to_string(list_transform(nodes, lambda s: md5(array_to_string(list_transform(s, lambda p: md5(p)), ''))), ''))
  || ':' || regexp_replace(array_to_string(list_transform(nodes, lambda s: array_to_string(s, ';')), '/'), '([0-9a-f]{{{DIGITS}}})[0-9a-f]{{{32 - DIGITS}}}', '\\1', 'g') AS fp FROM k),
l AS (SELECT t, fp, list_distinct(regexp_extract_all(substr(fp, 34), '[0-9a-f]{{{DIGITS}}}')) AS leaves FROM f),
j AS (SELECT e.doc_id, length(e.text) AS n_chars, sha256(e.edited) AS edited_sha256, a.fp AS fingerprint, b.fp AS edited_fingerprint, c.fp AS next_fingerprint,
  a.leaves AS la, b.leaves AS lb, c.leaves AS lc FROM e JOIN l a ON a.t = e.text JOIN l b ON b.t = e.edited JOIN l c ON c.t = e.next_text)
SELECT doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
  CASE WHEN substr(fingerprint, 1, 32) = substr(edited_fingerprint, 1, 32) THEN 1.0::DOUBLE WHEN len(la) + len(lb) = 0 THEN 0.0::DOUBLE
    ELSE 2.0::DOUBLE * len(list_intersect(la, lb)) / (len(la) + len(lb)) END AS near_edited,
  CASE WHEN substr(fingerprint, 1, 32) = substr(next_fingerprint, 1, 32) THEN 1.0::DOUBLE WHEN len(la) + len(lc) = 0 THEN 0.0::DOUBLE
    ELSE 2.0::DOUBLE * len(list_intersect(la, lc)) / (len(la) + len(lc)) END AS near_next
FROM j
"""
