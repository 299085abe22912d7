"""Operator 8: shards by balanced label propagation.

Documents with one link value (here: one text) are linked. All start in the shard of their id's hash. In each round every
linked group asks to move its smaller parts to the shard where most of it is that has room; requests are met in order of
what they gain until the shard's quota is full. Documents without links cost nothing to move: at the end they fill
what the groups leave of each quota, so that counts are at most one apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from churnlens.llm.common import staged, text_of
from churnlens.llm.mixing import running

SHARDS, ROUNDS, PARTS = 16, 8, 256
#: Rows that one task numbers: the whole table is numbered in as many parts as that makes, PARTS at least.
PART_ROWS = 100_000
_HASHES = 1 << 30


def _values(spark, numbers: list[int]) -> Column:
    return F.array(*(F.lit(int(x)).cast("long") for x in numbers))


def propagate(blocks: DataFrame, quotas: list[int], rounds: int = ROUNDS) -> DataFrame:
    """link, shard, n after the rounds, given the same at the start; a shard never takes in more than its quota.

    Blocks (one link's rows in one shard) are all it sees, so that a link of any size is at most one row per shard. A shard
    that starts above its quota gives up what is over: blocks beyond it must look for room elsewhere.
    """
    spark, shards = blocks.sparkSession, len(quotas)
    now = blocks
    for _ in range(rounds):
        loads = {r["shard"]: r["n"] for r in now.groupBy("shard").agg(F.sum("n").alias("n")).collect()}  # a row per shard
        room = _values(spark, [max(0, q - loads.get(s, 0)) for s, q in enumerate(quotas)])
        # of each link: its largest block stays; the others ask to join the largest block whose shard has room
        by_size = Window.partitionBy("link").orderBy(F.desc("n"), "shard")
        open_ = F.get(room, F.col("shard")) > 0
        best = F.first(F.when(open_, F.col("shard")), ignorenulls=True).over(by_size.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        gain = F.max(F.when(open_, F.col("n"))).over(Window.partitionBy("link"))
        asked = now.withColumn("to", best).withColumn("gain", gain).withColumn("rank", F.row_number().over(by_size))
        moves = (F.col("rank") > 1) & F.col("to").isNotNull() & (F.col("to") != F.col("shard"))
        requests = asked.where(moves).withColumn("part", (F.lit(PARTS) - F.least(F.col("gain"), F.lit(PARTS))).cast("int") * PARTS + F.pmod(F.xxhash64("link"), F.lit(PARTS)).cast("int"))
        ranked = running(requests, ["to"], "part", [F.col("link"), F.col("shard")], "n", "before")
        met = staged(ranked.select("link", "shard", "to", "n", F.greatest(F.lit(0), F.least("n", F.get(room, F.col("to")) - F.col("before"))).cast("long").alias("moved")).where("moved > 0"))
        if met.isEmpty():
            break
        change = met.select("link", F.col("to").alias("shard"), F.col("moved").alias("n")).unionByName(met.select("link", "shard", (-F.col("moved")).alias("n")))
        now = staged(now.select("link", "shard", "n").unionByName(change).groupBy("link", "shard").agg(F.sum("n").alias("n")).where("n > 0"))
    return now


def shard(docs: DataFrame, link: Column, size: Column, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row; law is `rows`: counts at most one apart.

    link is any column: rows with the same value are linked. slot numbers a shard's rows from 0 with no gap. grown_shard is null,
    as this law promises nothing of one more shard. Repeated rows and null ids count as rows of their own; null texts as
    empty, so they are linked with each other and with empty texts. An empty table gives no rows.
    """
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), size.cast("long").alias("size"), F.crc32(text_of(docs).cast("binary")).alias("text_crc32"), link.alias("link"))
    rows = staged(rows.withColumn("row", F.monotonically_increasing_id()).withColumn("hash", F.pmod(F.xxhash64("doc_id", "row"), F.lit(_HASHES))).withColumn("start", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int")))
    total = rows.count()
    parts = max(PARTS, -(-total // PART_ROWS))
    rows = rows.withColumn("h", F.floor(F.col("hash") * parts / _HASHES).cast("int")).drop("hash")
    quotas = [total // shards + (s < total % shards) for s in range(shards)]
    groups = staged(rows.groupBy("link", "start").agg(F.count("*").alias("n")))
    linked = groups.withColumn("all", F.sum("n").over(Window.partitionBy("link"))).where("all > 1").select("link", F.col("start").alias("shard"), "n")
    blocks = _within(propagate(staged(linked), quotas), quotas)
    load = {r["shard"]: r["n"] for r in blocks.groupBy("shard").agg(F.sum("n").alias("n")).collect()}  # a row per shard
    # each link's rows, numbered, fall to its blocks in turn; the link's blocks travel as one short array
    plan = blocks.groupBy("link").agg(F.array_sort(F.collect_list(F.struct("shard", "n"))).alias("blocks"))
    own = rows.join(plan, rows["link"].eqNullSafe(plan["link"]), "left").drop(plan["link"])
    tied = running(own.where("blocks is not null").withColumn("one", F.lit(1).cast("long")), ["link"], "h", [F.col("row")], "one", "k")
    place = F.aggregate("blocks", F.struct(F.lit(0).cast("long").alias("upto"), F.lit(-1).alias("shard")), lambda a, b: F.struct((a["upto"] + b["n"]).alias("upto"), F.when((a["shard"] < 0) & (F.col("k") < a["upto"] + b["n"]), b["shard"]).otherwise(a["shard"]).alias("shard")), lambda a: a["shard"])
    tied = tied.select("doc_id", "size", "text_crc32", "row", "h", place.alias("shard"))
    # the rest fill what is left of each quota: numbered over the whole table, cut at the running sums of the room
    free = own.where("blocks is null").withColumn("one", F.lit(1).cast("long")).withColumn("all", F.lit(0))
    free = running(free, ["all"], "h", [F.col("row")], "one", "k")
    ends, at = [], 0
    for s, q in enumerate(quotas):
        at += q - load.get(s, 0)
        ends.append(at)
    cut = F.aggregate(_values(docs.sparkSession, ends), F.lit(0), lambda a, e: a + F.when(F.col("k") >= e, 1).otherwise(0))
    done = staged(tied.unionByName(free.select("doc_id", "size", "text_crc32", "row", "h", cut.alias("shard"))).withColumn("one", F.lit(1).cast("long")))
    slots = running(done, ["shard"], "h", [F.col("row")], "one", "slot")
    return slots.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _within(blocks: DataFrame, quotas: list[int]) -> DataFrame:
    """blocks cut to the quotas: what a shard holds beyond its own goes, whole table in one running order, to the room left elsewhere."""
    spark, shards = blocks.sparkSession, len(quotas)
    load = {r["shard"]: r["n"] for r in blocks.groupBy("shard").agg(F.sum("n").alias("n")).collect()}  # a row per shard
    if all(load.get(s, 0) <= q for s, q in enumerate(quotas)):
        return blocks
    parted = blocks.withColumn("part", F.pmod(F.xxhash64("link"), F.lit(PARTS)).cast("int"))
    ranked = running(parted, ["shard"], "part", [F.col("link")], "n", "before")
    keep = F.greatest(F.lit(0), F.least(F.col("n"), F.get(_values(spark, quotas), F.col("shard")) - F.col("before"))).cast("long")
    cut = staged(ranked.withColumn("keep", keep).select("link", "shard", "n", "keep", "part"))
    over = cut.where("n > keep").select("link", "part", F.col("shard").alias("was"), (F.col("n") - F.col("keep")).alias("n"), F.lit(0).alias("all"))
    ranked = running(over, ["all"], "part", [F.col("link"), F.col("was")], "n", "before")
    room = [max(0, q - load.get(s, 0)) for s, q in enumerate(quotas)]
    starts = [sum(room[:s]) for s in range(shards)]
    spread = ranked.select("link", "n", "before", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))  # a row per shard and block over quota
    begin, end = F.get(_values(spark, starts), F.col("shard")), F.get(_values(spark, [a + b for a, b in zip(starts, room, strict=True)]), F.col("shard"))
    part = F.least(F.col("before") + F.col("n"), end) - F.greatest(F.col("before"), begin)
    moved = spread.select("link", "shard", part.cast("long").alias("n")).where("n > 0")
    return staged(cut.select("link", "shard", F.col("keep").alias("n")).unionByName(moved).groupBy("link", "shard").agg(F.sum("n").alias("n")).where("n > 0"))


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """shard with equal texts linked and sizes in UTF-8 bytes plus one."""
    text = text_of(docs)
    return shard(docs, F.md5(text.cast("binary")), F.octet_length(text) + 1, shards)


def edge_cut(placed: DataFrame, link: str, shard: str = "shard") -> DataFrame:
    """One row: pairs of linked rows, and how many of them lie in different shards. Counts of a link's rows by shard tell both, so no pair is made."""
    blocks = placed.groupBy(link, shard).agg(F.count("*").cast("double").alias("n"))
    each = blocks.groupBy(link).agg(F.sum("n").alias("all"), F.sum(F.col("n") * F.col("n")).alias("within"))
    pairs, cut = F.sum(F.col("all") * (F.col("all") - 1) / 2), F.sum((F.col("all") * F.col("all") - F.col("within")) / 2)
    return each.agg(F.coalesce(pairs, F.lit(0.0)).cast("long").alias("linked_pairs"), F.coalesce(cut, F.lit(0.0)).cast("long").alias("cut_pairs"))
