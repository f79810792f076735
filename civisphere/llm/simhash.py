"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints of 64 bits are compared at a Hamming distance of ``TAU`` or less.
Correlated bits are grouped into partitions; a partition i has a threshold
t_i from -1 (not used) with sum(t_i) = TAU - m + 1, so that any two linked
fingerprints are within t_i on some partition i (Qin et al. 2018). The
thresholds come from dynamic programming on estimated candidate counts. Each
fingerprint probes the signatures within t_i, and candidates are verified.

Signatures that very many fingerprints share are not paired. Their members
are linked exactly by another rule: two fingerprints differ in at most two
bits if and only if they share a neighbour at distance one or less, so each
emits itself and its 64 neighbours as keys, and members of a key are joined
to the smallest one. That work is linear in the members.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civisphere.llm.common import Scratch, bounded_batches, connected_components

BITS, TAU, SHINGLE, SEED = 64, 2, 3, 42
#: Fingerprints of the sample that the plan is made from; it does not decide results.
SAMPLE = 4000
#: A signature with more members than this is linked by neighbours, not by pairs.
CROWD = 48


def fingerprint(text: str | None) -> int:
    """SimHash over word shingles, repeats included, as an unsigned integer.

    Words are runs of bytes that are no ASCII white space, A-Z in lower case.
    Fewer words than a shingle has: the whole sequence. No word: 0.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - SHINGLE + 1)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    h = np.fromiter((digest(join(words[i : i + SHINGLE]), SEED) for i in range(n)), np.uint64, n)
    ones = np.zeros(BITS, np.int64)
    for a in range(0, n, 1 << 15):
        ones += np.unpackbits(h[a : a + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``(doc_id, fp)`` of every whole text; ``fp`` is the fingerprint as a signed long."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(x) for x in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    src = docs.select("doc_id", docs["text"].cast("string").alias("text"))
    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, fp long")


def group_bits(sample: np.ndarray, m: int) -> list[list[int]]:
    """m groups of about equally many bits, correlated ones together."""
    if not len(sample):
        sample = np.zeros(1, np.uint64)
    bits = (sample[:, None] >> np.arange(BITS, dtype=np.uint64) & np.uint64(1)).astype(float)
    spread = bits.std(axis=0)
    z = (bits - bits.mean(axis=0)) / np.where(spread > 0, spread, 1)
    like = np.abs(z.T @ z) / max(1, len(sample))
    np.fill_diagonal(like, 0)
    left, out = set(range(BITS)), []
    for k in range(m):
        room = BITS * (k + 1) // m - BITS * k // m
        first = max(left, key=lambda i: (like[i, sorted(left)].sum(), -i))
        own = [first]
        left.remove(first)
        while len(own) < room:
            own.append(b := max(left, key=lambda i: (like[i, own].sum(), -i)))
            left.remove(b)
        out.append(sorted(own))
    return out


def allocate(cost: list[list[float]], budget: int) -> list[int]:
    """Thresholds with the given sum and the least cost; cost[i][t + 1] for t >= -1."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for each in cost:
        nxt: dict[int, tuple[float, list[int]]] = {}
        for total, (c, path) in best.items():
            for t in range(-1, len(each) - 1):
                if (got := (c + each[t + 1], [*path, t])) < nxt.get(total + t, (float("inf"), [])):
                    nxt[total + t] = got
        best = nxt
    return best[budget][1]


def plan(sample: np.ndarray, total: int) -> tuple[list[list[int]], list[int]]:
    """Partitions and thresholds with the least estimated probes and candidates."""
    found = []
    n = max(2, len(sample))
    a, b = sample[: n // 2], sample[n // 2 : 2 * (n // 2)]
    for m in (2, 3, 4):
        groups, cost = group_bits(sample, m), []
        for g in groups:
            mask = np.uint64(sum(1 << i for i in g))
            each, probes = [0.0], 0.0
            for t in range(TAU + 1):
                probes += len(list(combinations(range(len(g)), t))) * total
                # chance that two fingerprints are that near, at least as even bits would have it
                near = np.mean([np.mean([int(x).bit_count() <= t for x in (b ^ v) & mask]) for v in a[:64]]) if len(a) and len(b) else 0
                even = probes / max(1, total) / 2.0 ** len(g)
                each.append(probes + max(near, even) * total * total / 2)
            cost.append(each)
        t = allocate(cost, TAU - m + 1)
        found.append((sum(c[x + 1] for c, x in zip(cost, t, strict=True)), m, groups, t))
    _, _, groups, t = min(found, key=lambda x: x[:2])
    return groups, t


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _post(part: int, mask: int) -> Callable[[Column], Column]:
    """From a flip of bits to the signature it probes in a partition; no flip is the own one."""
    return lambda flip: F.struct(F.xxhash64(F.lit(part), F.col("fp").bitwiseXOR(flip).bitwiseAND(F.lit(mask))).alias("sig"), (flip == 0).alias("own"))


def near_edges(fps: DataFrame, scratch: Scratch) -> DataFrame:
    """Edges ``(src, dst)`` whose components are those of all pairs of
    ``fps(fp, id)`` (distinct fp) that differ in at most ``TAU`` bits."""
    total = fps.count()
    rows = fps.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()
    groups, limits = plan(np.array([r["fp"] for r in rows], np.int64).view(np.uint64), total)
    posts = []
    for k, (g, t) in enumerate(zip(groups, limits, strict=True)):
        if t < 0:
            continue
        masks = [0, *(sum(1 << i for i in c) for n in range(1, t + 1) for c in combinations(g, n))]
        posts.append(F.transform(F.array(*(F.lit(_signed(x)) for x in masks)), _post(k, _signed(sum(1 << i for i in g)))))
    posted = fps.select("fp", "id", F.explode(F.concat(*posts)).alias("p")).select("fp", "id", "p.sig", "p.own")
    sizes = posted.groupBy("sig").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("own").cast("int")).alias("owners")).where("n > 1 and owners > 0").select("sig", (F.col("n") > CROWD).alias("crowd"))
    met = scratch.save(posted.join(sizes, "sig"), "posts")
    few = met.where("not crowd")
    left, right = few.where("own").select("sig", "fp", "id"), few.select("sig", F.col("fp").alias("fp2"), F.col("id").alias("id2"))
    # at most CROWD rows for each signature on either side
    pairs = left.join(right, "sig").where((F.col("fp") != F.col("fp2")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= TAU)).select(F.col("id").alias("src"), F.col("id2").alias("dst"))
    near = F.array(F.lit(0).cast("long"), *(F.lit(_signed(1 << i)) for i in range(BITS)))
    keyed = met.where("crowd").select("fp", "id").distinct().select("id", F.explode(F.transform(near, lambda x: F.col("fp").bitwiseXOR(x))).alias("key"))
    keyed = scratch.save(keyed, "keys")
    low = keyed.groupBy("key").agg(F.min("id").alias("dst"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "dst")
    star = keyed.join(low, "key").where("id <> dst").select(F.col("id").alias("src"), "dst")
    return scratch.save(pairs.union(star).distinct(), "pairs")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of ``docs``.

    ``component_id`` is the smallest ``doc_id`` reachable over links between
    fingerprints at distance ``TAU`` or less, the document itself included.
    Null, empty and blank texts have the fingerprint zero and are linked like
    any others; so are rows without an id, through which others can be
    reached. Repeated rows are returned as often as they come; a component of
    rows whose ids are all null has a null ``component_id``. Ids can be of any
    type that has an order. Other columns are ignored, whatever their names.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    made = scratch.save(fingerprints(docs), "fingerprints")
    # a number for each fingerprint, which stands once the table is written
    fps = made.groupBy("fp").agg(F.min("doc_id").alias("low"))
    fps = scratch.save(fps.withColumn("id", F.monotonically_increasing_id()), "distinct")
    parts = connected_components(near_edges(fps.select("fp", "id"), scratch), scratch)
    named = fps.join(parts, fps["id"] == parts["node"], "left").select("fp", "low", F.coalesce("component", "id").alias("c"))
    lows = named.groupBy("c").agg(F.min("low").alias("component_id"))
    named = scratch.save(named.join(lows, "c").select("fp", "component_id"), "named")
    # copies share a fingerprint: the right side has one row for each
    return made.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
