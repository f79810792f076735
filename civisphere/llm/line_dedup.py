"""Fuzzy line deduplication by MinHash.

Lines are compared by sets of character shingles. A line's signature holds a
minimum for each of ``ROWS * BANDS`` permutations; lines with an equal band
are candidates, candidates are verified by exact Jaccard similarity, and
distributed union-find makes components, of which one line stays. Built with
DataFrame functions only.

Shingles are the ``WIDTH`` characters from every position of the line, so
every character counts; a shorter line is its own shingle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civisphere.llm.common import Scratch, connected_components

WIDTH = 5
#: A pair of similarity 0.8 shares one of 13 bands of 5 with probability 0.994.
ROWS, BANDS = 5, 13
#: Bits of a signature that a pair may differ in; 52 are expected at similarity 0.8.
APART = 130
#: Similarity as a ratio of whole numbers.
NUM, DEN = 4, 5
#: Words of 64 bits in a sieve, the only table that is broadcast whatever the session's threshold (8 MB at most).
SIEVE = 1 << 17
#: Members that one task compares with a leader.
SLOT = 512
#: White space around a line.
SPACE = " \t\r"
#: Positions of a line that are laid out at once.
RUN = 4096
#: Longs of a parity sketch; columns of signatures and sketches.
SKETCH = 8
SIGS, SKETCHES = [f"c{i}" for i in range((ROWS * BANDS + 7) // 8)], [f"s{i}" for i in range(SKETCH)]


def _masks(n: int) -> list[int]:
    return [int.from_bytes(hashlib.sha256(f"mask {i}".encode()).digest()[:8], "big", signed=True) for i in range(n)]


def trimmed(line: Column) -> Column:
    return F.trim(line, F.lit(SPACE))


def normal(line: Column) -> Column:
    """What of a line is compared: lower case, without white space around it.

    The end of a line is cut where there is something to cut, as Spark lists
    all characters of a line for that.
    """
    left = F.ltrim(line, F.lit(SPACE))
    ends = reduce(Column.__or__, (F.endswith(left, F.lit(c)) for c in SPACE))
    return F.lower(F.when(ends, F.rtrim(left, F.lit(SPACE))).otherwise(left))


def _text(docs: DataFrame) -> Column:
    return docs["text"].cast("string")


def _named(docs: DataFrame) -> list[Column]:
    """``doc, h1, h2``: what names a document, its id and 128 bits of its text."""
    return [docs["doc_id"].alias("doc"), F.xxhash64(_text(docs)).alias("h1"), F.xxhash64(F.lit(7), _text(docs)).alias("h2")]


def _lines(docs: DataFrame) -> DataFrame:
    """``doc, h1, h2, no, line, k1, k2`` of every line that is not blank; the keys are two 64-bit hashes."""
    each = docs.select(*_named(docs), F.posexplode(F.split(_text(docs), "\n")).alias("no", "raw"))
    each = each.where(F.ltrim("raw", F.lit(SPACE)) != "").select("doc", "h1", "h2", "no", normal(F.col("raw")).alias("line"))
    return each.withColumn("k1", F.xxhash64("line")).withColumn("k2", F.xxhash64(F.lit(7), "line"))


def sieved(rows: DataFrame, wanted: DataFrame, *keys: str) -> DataFrame:
    """What of ``rows`` can have its ``keys`` in the written table ``wanted``: every
    row that has, and some others.

    Every wanted key sets one bit of words that are broadcast, from five to
    nine bits for a key, so about one in seven of the other rows passes. Rows
    are thus dropped before they are shuffled. There are ``SIEVE`` words at
    most, however long ``wanted`` is; then more of the others pass, up to all.
    """
    words = min(SIEVE, 1 << max(0, (wanted.count() // 9).bit_length()))
    at = F.pmod(F.xxhash64(F.lit(11), *keys), F.lit(64 * words))
    word, bit = F.shiftright("at", 6), F.expr("shiftleft(1L, cast(at & 63 as int))")
    sieve = wanted.select(at.alias("at")).groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits"))
    out = rows.withColumn("at", at).withColumn("word", word).join(F.broadcast(sieve), "word")
    return out.where(F.col("bits").bitwiseAND(bit) != 0).select(*rows.columns)


def wide(line: Column) -> Column:
    """The characters in four bytes each, so that a shingle is a slice at a known place."""
    return F.encode(line, "UTF-32")


def hashed_shingles(rows: DataFrame, *keys: str) -> DataFrame:
    """``keys, h``: a hash of each shingle of ``line``, from every position,
    which are laid out in runs, however long the line is."""
    rows = rows.select(*keys, wide(F.col("line")).alias("raw"), F.greatest(F.lit(0), F.length("line") - WIDTH).alias("last"))
    rows = rows.select(*keys, "raw", "last", F.explode(F.sequence(F.lit(0), F.col("last"), F.lit(RUN))).alias("run"))
    rows = rows.select(*keys, "raw", F.explode(F.sequence("run", F.least(F.col("run") + (RUN - 1), F.col("last")))).alias("at"))
    return rows.select(*keys, F.xxhash64(F.substring("raw", F.col("at") * 4 + 1, F.lit(4 * WIDTH))).alias("h"))


def shingle_set(line: Column) -> Column:
    """The hashes of the shingles of a line, each once.

    The wide form is a variable of the outer lambda: a column that is read from
    a row in the inner one would be copied as a whole for every position.
    """
    at = lambda r: F.sequence(F.lit(1), F.greatest(F.lit(1), F.octet_length(r) - 4 * WIDTH + 1), F.lit(4))
    each = lambda r: F.transform(at(r), lambda i: F.xxhash64(F.substring(r, i, F.lit(4 * WIDTH))))
    return F.array_distinct(F.get(F.transform(F.array(wide(line)), each), F.lit(0)))


def band_keys(each: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, bands, sig`` of sets, from rows of ``keys`` and an element's hash ``h``.

    Every permutation is half of a differently seeded 64-bit hash. ``sig`` has
    eight bits of each minimum, eight minima in a long.
    """
    masks = _masks((ROWS * BANDS + 1) // 2)
    each = each.select(*keys, *(F.xxhash64(F.col("h").bitwiseXOR(F.lit(m))).alias(f"x{i}") for i, m in enumerate(masks)))
    halves = [half for i in range(len(masks)) for half in (F.shiftrightunsigned(f"x{i}", 32), F.col(f"x{i}").bitwiseAND(F.lit(0xFFFFFFFF)))]
    out = each.groupBy(*keys).agg(*(F.min(x).alias(f"m{i}") for i, x in enumerate(halves[: ROWS * BANDS])))
    bands = [F.xxhash64(F.lit(b), *(F.col(f"m{b * ROWS + r}") for r in range(ROWS))) for b in range(BANDS)]
    byte = lambda i: F.shiftleft(F.col(f"m{i}").bitwiseAND(F.lit(255)), 8 * (i % 8))
    longs = [reduce(Column.bitwiseOR, map(byte, range(i, min(i + 8, ROWS * BANDS)))) for i in range(0, ROWS * BANDS, 8)]
    return out.select(*keys, F.array(*bands).alias("bands"), F.array(*longs).alias("sig"))


def signatures(docs: DataFrame) -> DataFrame:
    """``id, k1, k2, n, bands, sig``: distinct lines, how often they come, and what ``band_keys`` makes.

    Equal lines meet first, merged where they are read, so that a line that
    makes up a third of all rows leaves each task once. Signatures are then
    made where the lines are. ``id`` stands once this is written.
    """
    lines = _lines(docs).groupBy("k1", "k2").agg(F.first("line").alias("line"), F.count(F.lit(1)).alias("n"))
    out = band_keys(hashed_shingles(lines, "k1", "k2", "n"), ["k1", "k2", "n"])
    return out.withColumn("id", F.monotonically_increasing_id())


def candidates(made: DataFrame, scratch: Scratch) -> DataFrame:
    """``id, n, g, m``: what of ``made(id, n, bands)`` shares a band ``g`` with ``m`` rows in all."""
    banded = made.select("id", "n", F.explode("bands").alias("g"))
    shared = scratch.save(banded.groupBy("g").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "bands")
    scratch.release()
    out = scratch.save(sieved(banded, shared, "g").join(shared, "g"), "candidates")
    scratch.drop(shared)
    scratch.release()
    return out


def _leaders(members: DataFrame) -> DataFrame:
    """``a, id``: members and the leader of their group, each pair once.

    The leader of a group is the member with most exact copies, then the one
    whose groups are largest in total. In a family of edited copies that is
    the text they were edited from, or one close to it.
    """
    weight = members.groupBy("id").agg(F.sum("m").alias("w"))
    heads = members.join(weight, "id").groupBy("g").agg(F.max(F.struct("n", "w", "id"))["id"].alias("a"))
    return members.join(heads, "g").where("id <> a").select("a", "id").distinct()


def _facts(sets: DataFrame, unpack: Callable[[Column], Column]) -> DataFrame:
    """``id, size`` and a sketch of sets. Every element flips one of ``64 *
    SKETCH`` bits of it, so two sketches differ in no more bits than their sets
    do in elements."""
    each = sets.select("id", F.explode(unpack(F.col("set"))).alias("h"))
    word, bit = F.shiftrightunsigned("h", 6).bitwiseAND(F.lit(SKETCH - 1)), F.expr("shiftleft(1L, cast(h & 63 as int))")
    flips = [F.bit_xor(F.when(word == i, bit).otherwise(F.lit(0).cast("long"))).alias(c) for i, c in enumerate(SKETCHES)]
    return each.groupBy("id").agg(F.count(F.lit(1)).cast("int").alias("size"), *flips)


def _differ(names: list[str]) -> Column:
    return reduce(Column.__add__, (F.bit_count(F.col(c).bitwiseXOR(F.col(c + "_"))) for c in names))


def _agree() -> Column:
    """Whether signatures differ in ``APART`` bits at most; those of a pair of
    similarity 0.8 do not with probability below 1e-6."""
    return _differ(SIGS) <= APART


def _fit() -> Column:
    """Whether sizes and sketches, which bound the difference of two sets from
    below, leave it at (DEN - NUM) / (DEN + NUM) of both sizes. Null if not known."""
    most = (DEN - NUM) * (F.col("size") + F.col("size_"))
    return ((NUM + DEN) * F.abs(F.col("size") - F.col("size_")) <= most) & ((NUM + DEN) * _differ(SKETCHES) <= most)


def _dealt(rows: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """``rows`` with a ``slot`` of their ``a``, about ``SLOT`` rows each, and ``a, slot`` of all slots.

    Few ``a`` have more than one slot; these are a short table of their own,
    so Spark can broadcast it, or split the join on a hot key.
    """
    counted = rows.groupBy("a").agg(F.floor((F.count(F.lit(1)) - 1) / SLOT).cast("int").alias("top"))
    counted = scratch.save(counted, "slots")
    large = scratch.save(counted.where("top > 0"), "large")
    slot = F.pmod(F.xxhash64("id"), F.coalesce("top", F.lit(0)) + 1).cast("int")
    dealt = rows.join(large, "a", "left").withColumn("slot", slot).drop("top")
    return dealt, counted.select("a", F.explode(F.sequence(F.lit(0), F.col("top"))).alias("slot"))


def _others_of(table: DataFrame, **names: str) -> DataFrame:
    return table.withColumnsRenamed({c: names.get(c, c + "_") for c in table.columns})


def _similar(pairs: DataFrame, sets: DataFrame, unpack: Callable[[Column], Column], scratch: Scratch) -> DataFrame:
    """``a, id`` of the pairs whose sets are similar. The set of ``a`` goes to
    every slot of its pairs, so a large group takes many tasks. Sets travel as
    they are stored and are unpacked where a pair meets."""
    dealt, slots = _dealt(pairs, scratch)
    heads = slots.join(_others_of(sets, id="a"), "a")
    both = dealt.join(sets, "id").join(heads, ["a", "slot"])
    can = (NUM + DEN) * F.least("size", "size_") >= NUM * (F.col("size") + F.col("size_"))
    common = F.size(F.array_intersect(unpack(F.col("set")), unpack(F.col("set_"))))
    return both.where(can & ((NUM + DEN) * common >= NUM * (F.col("size") + F.col("size_")))).select("a", "id")


def _merged(comp: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """``node, component`` after further links; what is linked already counts as one node."""
    at = comp.select(F.col("node").alias("src"), "component")
    found = links.join(at, "src", "left").select(F.coalesce("component", "src").alias("src"), F.col("dst").alias("d"))
    found = found.join(at.withColumnRenamed("src", "d"), "d", "left").select("src", F.coalesce("component", "d").alias("dst"))
    new = connected_components(found, scratch).select("node", F.col("component").alias("to"))
    moved = comp.join(new.withColumnRenamed("node", "component"), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    return moved.union(new.join(comp, "node", "left_anti"))


def _others(rows: DataFrame, links: DataFrame, comp: DataFrame, facts: DataFrame, sigs: DataFrame, scratch: Scratch) -> DataFrame:
    """``a, id``: pairs within groups that can still be similar.

    Members that are similar to their leader are one component. Only a member
    that is not can add a link, so these alone meet the rest of their group,
    in slots. A pair is emitted only if its signatures agree, and sizes and
    sketches, where they are known, leave similarity possible. These join the
    members of groups that are open, not all of ``rows``.
    """
    rows = rows.join(links.withColumn("linked", F.lit(True)), ["a", "id"], "left").withColumn("linked", F.col("linked").isNotNull())
    rows = rows.join(comp.withColumnRenamed("node", "id"), "id", "left").withColumn("comp", F.coalesce("component", "id")).drop("component")
    rows = scratch.save(rows, "comps")
    several = rows.groupBy("a").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("a")
    rows = rows.join(scratch.save(several, "several"), "a")
    rows = scratch.save(rows.join(sigs, "id").join(facts, "id", "left"), "open")
    dealt, slots = _dealt(rows, scratch)
    odd = _others_of(rows.where("not linked").drop("linked"), a="a").join(slots, "a")
    can = (F.col("comp") != F.col("comp_")) & (F.col("linked") | (F.col("id") < F.col("id_"))) & _agree() & F.coalesce(_fit(), F.lit(True))
    pairs = dealt.join(odd, ["a", "slot"]).where(can)
    return scratch.save(pairs.select(F.least("id", "id_").alias("a"), F.greatest("id", "id_").alias("id")).distinct(), "pairs")


def _both(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "id")).alias("id")).distinct()


def components(made: DataFrame, members: DataFrame, sets_of: Callable[[DataFrame], DataFrame], scratch: Scratch, unpack: Callable[[Column], Column] = lambda x: x) -> DataFrame:
    """Components ``(node, component)`` of the similar pairs within groups ``(id, n, g, m)``.

    ``made`` has ``id, sig`` and ``sets_of`` gives ``id, set`` for ids, where
    ``unpack`` makes the array of a set. ``made`` and ``members``, as far as they
    are scratch tables, are deleted as soon as they are read. Members
    are compared with the leader of their group, which links a family of edited
    copies by one pair for each member. Members that are not similar to it meet
    the others; no similar pair of a group is lost. That second step looks at
    as many pairs as there are members times those unlike the leader, by some
    140 bytes each, but emits those that can be similar, which are few.
    """
    edges = lambda pairs: pairs.select(F.col("a").alias("src"), F.col("id").alias("dst"))
    leaders = scratch.save(_leaders(members), "leaders")
    sigs = made.select("id", *(F.get("sig", i).alias(c) for i, c in enumerate(SIGS)))
    heard = scratch.save(_both(leaders), "heard")
    sigs = scratch.save(sieved(sigs, heard, "id").join(heard, "id"), "sigs")
    scratch.drop(made, members)
    scratch.release()
    paired = scratch.save(leaders.join(sigs, "id"), "rows")
    dealt, slots = _dealt(paired, scratch)
    near = dealt.join(slots.join(_others_of(sigs, id="a"), "a"), ["a", "slot"]).where(_agree()).select("a", "id")
    near = scratch.save(near, "near")
    scratch.drop(paired)
    scratch.release()
    packed = lambda ids: scratch.save(sets_of(ids).withColumn("size", F.size(unpack(F.col("set")))), "sets")
    sets = packed(scratch.save(_both(near), "ids"))
    scratch.release()
    links = scratch.save(_similar(near, sets, unpack, scratch), "links")
    scratch.release()
    comp = scratch.save(connected_components(edges(links), scratch), "components")
    pairs = _others(leaders, links, comp, scratch.save(_facts(sets, unpack), "facts"), sigs, scratch)
    scratch.release()
    lacking = scratch.save(_both(pairs).join(sets, "id", "left_anti"), "ids")
    rest = None if lacking.isEmpty() else packed(lacking)
    more = scratch.save(_similar(pairs, sets.union(rest) if rest else sets, unpack, scratch), "links")
    scratch.drop(sets, rest)
    scratch.release()
    return scratch.save(_merged(comp, edges(more), scratch), "components")


def _line_texts(docs: DataFrame, keyed: DataFrame, ids: DataFrame, scratch: Scratch) -> DataFrame:
    """``id, set`` of distinct lines: the line itself, of which ``shingle_set``
    makes the set; eight bytes for each shingle would be many times its size."""
    keys = scratch.save(sieved(keyed.select("id", "k1", "k2"), ids, "id").join(ids, "id"), "keys")
    lines = sieved(_lines(docs).select("k1", "k2", "line"), keys, "k1", "k2")
    return lines.join(keys, ["k1", "k2"]).groupBy("id").agg(F.first("line").alias("set"))


def dropped_lines(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """``doc, h1, h2, drop``: numbers of the lines of a document that are not the
    first of their component by (doc_id, text hash, line number)."""
    lines = scratch.save(signatures(docs), "signatures")
    scratch.release()
    members = candidates(lines, scratch)
    keyed = scratch.save(lines.select("id", "k1", "k2", "n"), "keyed")
    comp = components(lines, members, lambda ids: _line_texts(docs, keyed, ids, scratch), scratch, shingle_set)
    comp = comp.withColumnRenamed("node", "id")
    own = keyed.where("n > 1").join(comp, "id", "left").select("k1", "k2", F.coalesce("component", "id").alias("g"))
    ruled = own.union(sieved(keyed.where("n = 1"), comp, "id").join(comp, "id").select("k1", "k2", F.col("component").alias("g")))
    ruled = scratch.save(ruled, "ruled")
    scratch.drop(keyed)
    scratch.release()
    places = sieved(_lines(docs).select("doc", "h1", "h2", "no", "k1", "k2"), ruled, "k1", "k2").join(ruled, ["k1", "k2"])
    places = scratch.save(places.select("g", "doc", "h1", "h2", "no"), "places")
    place = F.struct("doc", "h1", "h2", "no")
    first = scratch.save(places.groupBy("g").agg(F.min(place).alias("first")), "first")
    late = places.join(first, "g").where(~place.eqNullSafe(F.col("first")))
    out = scratch.save(late.groupBy("doc", "h1", "h2").agg(F.array_sort(F.collect_set("no")).alias("drop")), "drop")
    scratch.drop(places, ruled, first)
    scratch.release()
    return out


def dedupe_lines(docs: DataFrame, keep: bool = False) -> DataFrame:
    """Keep one line of each component of equal or similar lines.

    Returns ``doc_id, text, n_lines, n_kept`` (with ``keep`` all columns, with
    the new ``text``, ``n_chars`` if there is one, and these counts). The line
    that stays is the first by (doc_id, hash of the text, line number), null
    ids first. Blank lines stay and are not counted. Lines are what newlines
    part; texts without a dropped line are unchanged, a null text stays null
    with counts of 0, and a text all of whose lines go becomes empty or keeps
    its blank lines. Rows equal in id and text are one document and keep the
    same lines; rows that share an id alone, or have none, are documents of
    their own. Columns of the two counts' names are replaced, others may have
    any name. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    drop = dropped_lines(docs, scratch)
    rows = docs.drop("n_lines", "n_kept") if keep else docs.select("doc_id", "text")
    named = rows.select(F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("row"), *_named(rows))
    out = named.join(drop, named["doc"].eqNullSafe(drop["doc"]) & (named["h1"] == drop["h1"]) & (named["h2"] == drop["h2"]), "left").select("row", "drop")
    text = F.col("row.text").cast("string")
    lines = F.split(text, "\n")
    left = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains("drop", i)), "\n")
    full = F.coalesce(F.size(F.filter(lines, lambda x: trimmed(x) != "")), F.lit(0))
    new = F.when(F.col("drop").isNull(), text).otherwise(left)
    out = out.select("row", new.alias("new"), F.when(text.isNull(), 0).otherwise(full).alias("full"), F.coalesce(F.size("drop"), F.lit(0)).alias("gone"))
    made = {"text": F.col("new")}
    if keep and "n_chars" in docs.columns:
        made["n_chars"] = F.length("new").cast(docs.schema["n_chars"].dataType)
    return out.select(*((made[c] if c in made else F.col(f"row.`{c}`")).alias(c) for c in rows.columns), F.col("full").alias("n_lines"), (F.col("full") - F.col("gone")).alias("n_kept"))
