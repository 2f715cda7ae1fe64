"""Sharding by longest processing time: groups that stay together, largest first, to the least-loaded shard.

Groups are the rows of equal text. The driver never sees groups, only how many there are of each size class:
a size with its leading 12 bits kept, so at most 2^11 classes for each power of two, however many rows. The
heap deals the classes out, largest first; a class's groups are then numbered in parallel, and number ranges
go to shards. Sizes below 4096 bytes are classes of their own, so only large groups are ever approximated,
by less than 1/2048 of their size.

Defined cases: a null text is an empty one (size 1). Repeated rows are in one group. An empty table gives an
empty result. Other columns of the input are not read.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomtext.session import pinned

KEPT_BITS = 12
RANK_BUCKETS = 256
SLOT_BUCKETS = 512


def deal(classes: list[tuple[int, int, float]], shards: int) -> list[tuple[int, list[int]]]:
    """[(class, groups for each shard)] for (class, groups, mean size), the largest mean first.

    Equal items are interchangeable, so a large class is dealt out in bulk: first what levels the loads, then
    whole rounds; the heap places the rest one by one, as it does all items of small classes.
    """
    load = [0.0] * shards
    out = []
    for name, count, size in sorted(classes, key=lambda c: -c[2]):
        given = [0] * shards
        if count > 16 * shards and size > 0:
            low, high = min(load), max(load) + size * count
            for _ in range(100):  # the highest level that takes no more than `count` items
                level = (low + high) / 2
                low, high = (level, high) if sum(max(0, int((level - x) // size)) for x in load) <= count else (low, level)
            given = [max(0, int((low - x) // size)) for x in load]
        heap = [(load[s] + given[s] * size, s) for s in range(shards)]
        heapq.heapify(heap)
        for _ in range(count - sum(given)):
            now, s = heap[0]
            given[s] += 1
            heapq.heapreplace(heap, (now + size, s))
        load = [x + g * size for x, g in zip(load, given)]
        out.append((name, given))
    return out


def assign(docs: DataFrame, shards: int = 8) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): slot numbers a shard's rows from 0 without gaps."""
    spark = docs.sparkSession
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    rows = pinned(docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.md5(text.cast("binary"))).alias("key")))
    groups = rows.groupBy("key").agg(F.sum("size").alias("group_size"))
    digits = F.length(F.bin("group_size"))
    cut = F.greatest(digits - KEPT_BITS, F.lit(0))
    kept = F.expr("shiftleft(shiftright(group_size, cut), cut)")
    groups = pinned(groups.withColumn("cut", cut).withColumn("class", kept).withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(RANK_BUCKETS))).drop("cut"))
    classes = groups.groupBy("class").agg(F.count("*").alias("n"), F.avg("group_size").alias("mean")).collect()  # at most 2^11 for each power of two
    plan = deal([(c["class"], c["n"], c["mean"]) for c in classes], shards)
    ends = spark.createDataFrame([(name, [sum(given[: i + 1]) for i in range(shards)]) for name, given in plan], "class long, ends array<long>")
    per_salt = groups.groupBy("class", "salt").agg(F.count("*").alias("n"))
    before = per_salt.withColumn("before", F.sum("n").over(Window.partitionBy("class").orderBy("salt")) - F.col("n")).drop("n").join(F.broadcast(ends), "class")
    ranked = groups.withColumn("rank", F.row_number().over(Window.partitionBy("class", "salt").orderBy("key")) - 1)
    placed = ranked.join(before, ["class", "salt"]).select("key", F.expr("size(filter(ends, e -> e <= before + rank))").alias("shard"))
    dealt = pinned(rows.join(placed, "key").drop("key").withColumn("part", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(SLOT_BUCKETS))))
    first = dealt.groupBy("shard", "part").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")).drop("n")
    place = F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size"))
    return dealt.withColumn("place", place).join(F.broadcast(first), ["shard", "part"]).select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("place") - 1).alias("slot"))
