"""Sharding by best-fit-decreasing bin packing.

Rows that share a text are a group and stay together. Groups in order of size enter the bin with the least room that
still holds them, found in a balanced tree of remaining capacities; where none holds one, the emptiest bin takes it. With a given
capacity and no number of bins, bins are opened as needed, which minimises their number.

The packing sees a bounded list of sizes with counts, in decreasing order: items of one size enter bins in turn, each as many as
it holds, which places all of them as one by one. Groups of at least capacity / PARTS bytes are listed at their exact size (there are at
most bins * PARTS), and so is every size below EXACT bytes; others are rounded up to DIGITS binary digits, by less than 1 / 32768 of their size.
The list so has at most bins * PARTS + EXACT + (EXACT / 2) * log2(capacity / EXACT) rows, however many groups there are, and every
group is placed as a whole. Within a size, groups go by hash; ranks are counted in two levels.

A group above a shard's capacity can't be whole: it is dealt by hash of doc_id into pieces of capacity / PIECES, which are items like others.

Null texts are one group with 16 bytes a row and checksum 0. Ties go by group hash. Repeated rows get slots of their own.
"""

from __future__ import annotations

from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import prepare

SHARDS, OVERHEAD, PARTS, PIECES = 40, 16, 500, 50
EXACT, DIGITS = 1 << 16, 16
#: Groups of one size that are ranked by one sort, on average.
RANKED = 100_000
#: Sub-ranges of a shard within which slots are counted by sorting.
SUBS = 64


class Rooms:
    """Remaining capacities in a balanced search tree (a treap keyed by (room, bin), priorities by hash)."""

    def __init__(self):
        self.root = None

    @staticmethod
    def _rank(key):
        return hash((key[0] * 0x9E3779B1 + key[1] * 0x85EBCA77) & 0xFFFFFFFF) * 0x27D4EB2F & 0xFFFFFFFF

    def add(self, key: tuple[int, int]) -> None:
        def put(node):
            if node is None:
                return [key, None, None]
            side = 1 if key < node[0] else 2
            node[side] = put(node[side])
            child = node[side]
            if self._rank(child[0]) > self._rank(node[0]):
                node[side], child[3 - side] = child[3 - side], node
                return child
            return node

        self.root = put(self.root)

    def remove(self, key: tuple[int, int]) -> None:
        def merge(a, b):
            if a is None or b is None:
                return a or b
            if self._rank(a[0]) > self._rank(b[0]):
                a[2] = merge(a[2], b)
                return a
            b[1] = merge(a, b[1])
            return b

        def drop(node):
            if node[0] == key:
                return merge(node[1], node[2])
            side = 1 if key < node[0] else 2
            node[side] = drop(node[side])
            return node

        self.root = drop(self.root)

    def tightest(self, size: int) -> tuple[int, int] | None:
        node, best = self.root, None
        while node is not None:
            if node[0][0] >= size:
                best, node = node[0], node[1]
            else:
                node = node[2]
        return best

    def widest(self) -> tuple[int, int]:
        node = self.root
        while node[2] is not None:
            node = node[2]
        return node[0]


def pack(sizes: list[tuple[int, int]], capacity: int, bins: int | None = None) -> list[list[tuple[int, int]]]:
    """For each (size, count), in decreasing order of size: the bins that its items enter in turn, as (bin, items).

    With `bins`, what fits nowhere enters the emptiest; else a bin is opened for it. Where an item enters the tightest bin, that bin
    stays the tightest for others of its size until it is too full, so that items of one size are placed in strides.
    """
    rooms, out, opened = Rooms(), [], 0
    while opened < (bins or 0):
        rooms.add((capacity, opened))
        opened += 1
    for size, left in sizes:
        own = []
        while left:
            found = rooms.tightest(size)
            if found is not None:
                rooms.remove(found)
            elif bins is None:
                found = (max(capacity, size), opened)
                opened += 1
            else:
                found = rooms.widest()
                rooms.remove(found)
            n = min(left, max(1, found[0] // size)) if size else left
            rooms.add((found[0] - n * size, found[1]))
            own.append((found[1], n))
            left -= n
        out.append(own)
    return out


def best_fit_decreasing(sizes: list[int], capacity: int, bins: int | None = None) -> list[int]:
    """The bin of each item, ties by place."""
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    classes = [(k, len(list(own))) for k, own in groupby(sizes[i] for i in order)]
    out = [0] * len(sizes)
    for i, b in zip(order, (b for own in pack(classes, capacity, bins) for b, n in own for _ in range(n)), strict=True):
        out[i] = b
    return out


def size_class(size: Column, exact_from: int) -> Column:
    """The size that the packing takes an item for."""
    step = F.pow(F.lit(2.0), F.length(F.bin(size)) - DIGITS).cast("long")
    rounded = F.ceil(size / step).cast("long") * step
    return F.when((size < EXACT) | (size >= exact_from), size).otherwise(rounded)


def shard(docs: DataFrame, shards: int = SHARDS, capacity: int | None = None, parts: int = PARTS, subs: int = SUBS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard, one row per row of docs; sizes of shards are near equal.

    With a capacity, as few shards of at most that size are opened as best-fit-decreasing needs; `shards` is not used then.
    """
    spark = prepare(docs.sparkSession)
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long").alias("size"), F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"), F.xxhash64(text.isNull(), text).alias("g"), F.xxhash64(text, F.lit(11)).alias("g2")).checkpoint()
    total = rows.agg(F.sum("size")).first()[0] or 0
    bins = None if capacity else shards
    room = capacity or max(1, -(-total // shards))
    # At most total / capacity rows: groups too large for a shard, with their number of pieces.
    large = rows.groupBy("g", "g2").agg(F.sum("size").alias("bytes")).filter(F.col("bytes") > room).select("g", "g2", F.ceil(F.col("bytes") * PIECES / room).cast("int").alias("pieces"))
    keyed = rows.join(F.broadcast(large), ["g", "g2"], "left")
    keyed = keyed.withColumn("piece", F.when(F.col("pieces").isNotNull(), F.pmod(F.xxhash64("doc_id", F.lit(5)), F.col("pieces"))).otherwise(0).cast("int")).drop("pieces")
    items = keyed.groupBy("g", "g2", "piece").agg(F.sum("size").alias("bytes")).withColumn("class", size_class(F.col("bytes"), max(1, room // parts))).checkpoint()
    listed = sorted(((r["class"], r["count"]) for r in items.groupBy("class").count().collect()), reverse=True)  # bounded as said above
    frame = []
    for (size, _), own in zip(listed, pack(listed, room, bins), strict=True):
        frame.append((size, [sum(n for _, n in own[: i + 1]) for i in range(len(own))], [b for b, _ in own]))
    chosen = spark.createDataFrame(frame, "class long, ends array<long>, bins array<int>")
    ranges = max(1, sum(n for _, n in listed) // RANKED)
    items = items.withColumn("range", F.floor((F.col("g").cast("double") / float(1 << 64) + 0.5) * ranges).cast("long"))
    base = items.groupBy("class", "range").agg(F.count("*").alias("n"))
    base = base.select("class", "range", (F.sum("n").over(W.partitionBy("class").orderBy("range")) - F.col("n")).alias("base"))
    nth = F.row_number().over(W.partitionBy("class", "range").orderBy("g", "g2", "piece"))
    ranked = items.withColumn("nth", nth).join(base, ["class", "range"]).join(chosen, "class")
    place = F.size(F.filter("ends", lambda e: e < F.col("base") + F.col("nth")))
    ranked = ranked.select("g", "g2", "piece", F.get("bins", place).alias("shard"))
    placed = keyed.join(ranked, ["g", "g2", "piece"])
    placed = placed.select("doc_id", "size", "text_crc32", "shard", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(subs)).cast("int").alias("sub")).checkpoint()
    before = placed.groupBy("shard", "sub").agg(F.count("*").alias("n"))
    before = before.withColumn("base", F.sum("n").over(W.partitionBy("shard").orderBy("sub")) - F.col("n")).drop("n")
    order = W.partitionBy("shard", "sub").orderBy("doc_id", "text_crc32", "size")
    out = placed.join(before, ["shard", "sub"]).withColumn("slot", (F.col("base") + F.row_number().over(order) - 1).cast("long"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
