"""Sharding by balanced label propagation.

Documents that are linked (they share a hub, such as one equal text) move
towards the shard that holds most of their neighbours, round by round, while
every shard has a quota of rows. The state of a round is how many documents
of each hub a shard holds, so a round costs by hubs and not by documents;
documents are dealt once, after the last round. A last exact pass fills the
quotas, moving unlinked documents first. All tables but the loads of the
shards stay distributed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from civisphere.llm.common import Scratch

SHARDS, ROUNDS, SEED = 24, 12, 17
#: Hash buckets by which a quota admits part of the movers.
PARTS = 64
#: Rows of a numbering block, about.
BLOCK = 4000
#: Hubs up to which their shards are broadcast, at some 300 bytes each.
SMALL = 100_000


def quotas(rows: int, shards: int) -> list[int]:
    """Rows of each shard: at most one apart."""
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def _literal(values: list[int]) -> Column:
    return F.array(*(F.lit(int(v)).cast("long") for v in values))


def propagate(held: DataFrame, shards: int, quota: list[int], scratch: Scratch, rounds: int = ROUNDS) -> DataFrame:
    """Move the members of hubs between shards; ``held(hub, shard, n)`` in and out.

    In a round each hub looks for the shard with most of its members that has
    room left, and members in shards with fewer of them ask to move there.
    Each shard admits by size, largest first, as many as its quota has room
    for; where not all fit, hubs are chosen by a hash, and of a hub too large
    for a shard that share of each request goes. Ends when nothing moves.
    """
    spark, state = held.sparkSession, scratch.save(held, "held")
    limit = max(1, min(quota, default=1) // 4)
    for _ in range(rounds):
        loads = {r["shard"]: r["n"] for r in state.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
        free = [max(0, quota[s] - loads.get(s, 0)) for s in range(shards)]
        best = state.groupBy("hub").agg(
            F.max(F.when(_literal(free)[F.col("shard")] > 0, F.struct("n", F.xxhash64("hub", "shard").alias("tie"), "shard"))).alias("b"),
            F.sum("n").alias("size"),
        ).where("b is not null").select("hub", F.col("b.shard").alias("to"), F.col("b.n").alias("most"), "size")
        asks = state.join(best, "hub").where("shard <> to and n <= most")
        lot = F.pmod(F.xxhash64(F.lit(11), "hub"), F.lit(1 << 20)) / float(1 << 20)
        asks = asks.select("hub", "shard", "to", "n", F.floor(F.log2("most")).cast("int").alias("rank"), F.pmod(F.xxhash64(F.lit(3), "hub"), F.lit(PARTS)).cast("int").alias("part"), (F.col("size") > limit).alias("large"), lot.alias("lot"))
        asks = scratch.save(asks, "asks")
        # bounded: shards x sizes as powers of two x hash buckets
        wanted = asks.groupBy("to", "rank", "part", "large").agg(F.sum("n").alias("n")).collect()
        cuts, left = [], list(free)
        for r in sorted(wanted, key=lambda r: (r["to"], -r["rank"], r["part"], r["large"])):
            if got := min(r["n"], left[r["to"]]):
                left[r["to"]] -= got
                cuts.append((r["to"], r["rank"], r["part"], r["large"], got / r["n"]))
        if not cuts:
            break
        admit = spark.createDataFrame(cuts, "to int, rank int, part int, large boolean, share double")
        moves = asks.join(F.broadcast(admit), ["to", "rank", "part", "large"])
        # of a large hub that share goes, from the shards with most of it first
        hub = W.partitionBy("hub")
        before = F.sum("n").over(hub.orderBy(F.desc("n"), "shard")) - F.col("n")
        taken = F.least("n", F.greatest(F.lit(0), F.floor(F.sum("n").over(hub) * F.col("share") + 1e-6) - before))
        k = F.when(F.col("large"), taken).when(F.col("lot") < F.col("share"), F.col("n")).otherwise(0).cast("long")
        moves = moves.select("hub", "shard", "to", k.alias("k")).where("k > 0")
        after = state.union(moves.select("hub", "shard", -F.col("k"))).union(moves.select("hub", "to", "k"))
        after = scratch.save(after.groupBy("hub", "shard").agg(F.sum("n").alias("n")).where("n > 0"), "held")
        scratch.drop(state, asks)
        state = after
    return state


def fill(rows: DataFrame, shards: int, quota: list[int], total: int) -> DataFrame:
    """Place rows so that every shard holds exactly its quota.

    ``rows`` has ``uid``, ``shard`` (wanted), ``linked`` and any others; adds
    ``slot`` and replaces ``shard``. A row keeps its shard while its number
    there is below the quota; linked rows are numbered first. The rest are
    numbered over all shards and take the free slots in order. Numbers come
    from counts of blocks and a row number within a block, so no task holds a
    whole shard.
    """
    blocks = max(1, total // (shards * BLOCK))
    rows = rows.withColumn("block", F.pmod(F.xxhash64(F.lit(5), "uid"), F.lit(blocks)).cast("int"))
    key = ["shard", "linked", "block"]
    counts = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("shard").orderBy(F.desc("linked"), "block").rowsBetween(W.unboundedPreceding, -1)
    ahead = counts.select(*key, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    loads = {r["shard"]: r["n"] for r in counts.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    have = [loads.get(s, 0) for s in range(shards)]
    over, short = [max(0, h - q) for h, q in zip(have, quota, strict=True)], [max(0, q - h) for h, q in zip(have, quota, strict=True)]
    over_before, short_end = [sum(over[:s]) for s in range(shards)], [sum(short[: s + 1]) for s in range(shards)]
    inner = W.partitionBy(*key).orderBy("uid")
    placed = rows.join(ahead, key).withColumn("pos", F.col("ahead") + F.row_number().over(inner) - 1)
    extra = F.col("pos") - _literal(quota)[F.col("shard")]
    number = F.when(extra >= 0, extra + _literal(over_before)[F.col("shard")])
    placed = placed.withColumn("number", number)
    target = F.size(F.filter(_literal(short_end), lambda e: e <= F.col("number")))
    placed = placed.withColumn("to", F.when(F.col("number").isNotNull(), target))
    slot = F.when(F.col("to").isNull(), F.col("pos")).otherwise(_literal(have)[F.col("to")] + F.col("number") - (_literal(short_end)[F.col("to")] - _literal(short)[F.col("to")]))
    return placed.withColumn("slot", slot.cast("long")).withColumn("shard", F.coalesce("to", "shard").cast("int")).drop("block", "ahead", "pos", "number", "to")


def shard_documents(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """Assign every document to a shard under the law ``rows``.

    Links join documents of equal text. Returns ``doc_id, size, text_crc32,
    law, shard, slot, grown_shard``: UTF-8 bytes plus 8, unsigned CRC-32, and a
    gapless number within the shard; ``grown_shard`` is null under this law.
    Row counts of shards differ by at most one. A null text counts as empty.
    Repeated rows are placed each on its own; a null id is placed like any
    other row. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "shards")
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    base = docs.select(
        docs["doc_id"].alias("doc_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("crc"),
        F.xxhash64(text).alias("h1"),
        F.xxhash64(F.lit(7), text).alias("h2"),
    )
    # the number of a row stands once the table is written
    base = scratch.save(base.withColumn("uid", F.monotonically_increasing_id()), "rows")
    start = F.pmod(F.xxhash64(F.lit(SEED), "doc_id", "h1"), F.lit(shards)).cast("int")
    each = base.groupBy("h1", "h2", start.alias("shard")).agg(F.count(F.lit(1)).alias("n"))
    hubs = scratch.save(each.groupBy("h1", "h2").agg(F.sum("n").alias("size")).where("size > 1").select("h1", "h2", F.monotonically_increasing_id().alias("hub")), "hubs")
    quota = quotas(base.count(), shards)
    held = propagate(each.join(hubs, ["h1", "h2"]).select("hub", "shard", "n"), shards, quota, scratch, rounds)
    # members of a hub are dealt to its shards by a hash, in proportion
    ahead = F.sum("n").over(W.partitionBy("hub").orderBy("shard"))
    ends = held.select("hub", "shard", ahead.alias("end")).groupBy("hub").agg(F.array_sort(F.collect_list(F.struct("end", "shard"))).alias("ends"), F.max("end").alias("size"))
    ends = scratch.save(hubs.join(ends, "hub").drop("hub"), "ends")
    ends = F.broadcast(ends) if ends.count() <= SMALL else ends
    lot = F.pmod(F.xxhash64(F.lit(9), "uid"), F.col("size"))
    own = F.get(F.filter("ends", lambda e: e["end"] > F.col("lot")), 0)["shard"]
    rows = base.withColumnRenamed("size", "bytes").join(ends, ["h1", "h2"], "left").withColumn("lot", lot).select("doc_id", F.col("bytes").alias("size"), "crc", "uid", F.coalesce(own, start).alias("shard"), own.isNotNull().alias("linked"))
    out = fill(scratch.save(rows, "wanted"), shards, quota, sum(quota))
    return out.select("doc_id", "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def cut_edges(sharded: DataFrame, key: str) -> DataFrame:
    """``edges, cut``: pairs of rows with an equal ``key``, and those of them in different shards, from counts."""
    n = sharded.groupBy(key, "shard").agg(F.count(F.lit(1)).alias("n")).groupBy(key).agg(F.sum("n").alias("all"), F.sum(F.col("n") * F.col("n")).alias("own"))
    return n.agg(F.sum((F.col("all") * F.col("all") - F.col("all")) / 2).cast("long").alias("edges"), F.sum((F.col("all") * F.col("all") - F.col("own")) / 2).cast("long").alias("cut"))
