"""Frequent itemsets level by level (B2, B6): hashed pair buckets, then vertical bitmaps.

FP-growth groups the conditional baskets of an item in one task, so a very
frequent item makes one large group.  Here no item makes a group; tasks
hold baskets.

1. Items are counted and the frequent ones numbered in their order.
2. Pairs (after Park, Chen & Yu): every task hashes the pairs of its baskets into a
   table of ``BUCKETS`` counters.  A pair whose bucket, summed over all tasks, stays below the
   threshold cannot be frequent, so the second pass counts only pairs whose bit is set in a
   bitmap of ``BUCKETS`` bits, which is all that is sent to the tasks.
3. Longer sets: two frequent sets that differ in their last item make a candidate, if all its subsets
   are frequent.  Baskets lie in blocks; a block holds a bitmap of its baskets for each item, and a
   candidate's count is the number of bits in the intersection of its items' bitmaps.  Candidates meet blocks in chunks of
   bounded size.

Empty baskets count in the support's denominator; null baskets are empty ones, null items and repeats in a basket do not count.  The result equals that of
FP-growth.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .ranking import row_number_distributed

#: Counters of pair hashes: 4 MB a task, and a bitmap of 128 KB for all.
BUCKETS = 1 << 20
#: Bytes of a block's bitmaps, and the most baskets in it.
BLOCK_BYTES = 32 << 20
BLOCK_BASKETS = 32_768
#: Candidates that meet a block at once.
CHUNK = 100_000
_PAIRS = 1 << 20


def _pairs(col: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs ``a < b`` of the sorted items of every basket, some at a time."""
    flat = col.flatten().to_numpy()
    size = np.diff(col.offsets.to_numpy())
    last = np.repeat(np.cumsum(size), size)
    count = last - np.arange(len(flat)) - 1  # partners after each item
    upto = np.cumsum(count)
    at = 0
    while at < len(flat):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + _PAIRS, side="right")))
        n = count[at:end]
        first = np.repeat(np.arange(at, end), n)
        other = first + 1 + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        yield flat[first], flat[other]
        at = end


def _bucket(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x ^ (x >> np.uint64(32))) % np.uint64(BUCKETS)).astype(np.int64)


def _bucket_bits(baskets: DataFrame, least: int) -> np.ndarray:
    """Which buckets hold at least ``least`` pairs, as flags (a bitmap on the way)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(BUCKETS, np.int64)
        for b in batches:
            for x, y in _pairs(b.column(0)):
                table += np.bincount(_bucket(x, y), minlength=BUCKETS)
        held = np.flatnonzero(table)
        for at in range(0, len(held), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(held[at:at + (1 << 16)]), pa.array(table[held[at:at + (1 << 16)]])], ["bucket", "n"])

    full = baskets.select("ids").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    place = F.col("bucket") + 1
    maps = (full.groupBy(F.bitmap_bucket_number(place).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
            .collect())  # BUCKETS bits in all
    out = np.zeros(BUCKETS, bool)
    for r in maps:
        bits = np.unpackbits(np.frombuffer(r["bits"], np.uint8), bitorder="little")
        at = (r["part"] - 1) * len(bits)
        out[at:at + len(bits)] = bits[:BUCKETS - at]
    return out


def frequent_pairs(baskets: DataFrame, least: int) -> DataFrame:
    """``(ids, freq)`` of the pairs that at least ``least`` baskets hold."""
    bits = np.packbits(_bucket_bits(baskets, least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = np.unpackbits(bits)[:BUCKETS].astype(bool)
        for b in batches:
            for x, y in _pairs(b.column(0)):
                may = kept[_bucket(x, y)]
                both, n = np.unique(x[may].astype(np.int64) << 32 | y[may].astype(np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(both), pa.array(n.astype(np.int64))], ["pair", "n"])

    counts = baskets.select("ids").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("freq")).where(F.col("freq") >= least)
    return counts.select(F.array(F.shiftright("pair", 32).cast("int"), F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)).cast("int")).alias("ids"), "freq")


def candidates(frequent: DataFrame, k: int) -> DataFrame:
    """``ids`` of the sets of ``k + 1`` items whose subsets of ``k`` items are all in ``frequent``."""
    head = F.slice("ids", 1, k - 1)
    sets = frequent.select(head.alias("head"), F.element_at("ids", -1).alias("tail"))
    joined = (sets.join(sets.toDF("head", "other"), "head").where(F.col("tail") < F.col("other"))
              .select(F.concat("head", F.array("tail", "other")).alias("ids")))
    # the two subsets without one of the last items are frequent by the join
    parts = joined.select("ids", F.explode(F.transform(F.sequence(F.lit(0), F.lit(k - 2)), lambda i: F.filter("ids", lambda x, j: j != i))).alias("part"))
    return (parts.join(frequent.select(F.col("ids").alias("part")), "part").groupBy("ids").agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") == k - 1).select("ids"))


def bitmap_blocks(baskets: DataFrame, n_items: int) -> DataFrame:
    """``(block, items, width, bits)``: for a block of baskets, the bitmap of every item in it, one after the other."""
    most = int(max(64, min(BLOCK_BASKETS, 8 * BLOCK_BYTES // max(n_items, 1))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, n = [], 0

        def block(cols: list[pa.Array]) -> pa.RecordBatch:
            col = pa.concat_arrays(cols)
            items, row = np.unique(col.flatten().to_numpy(), return_inverse=True)
            place = np.repeat(np.arange(len(col)), np.diff(col.offsets.to_numpy()))
            flags = np.zeros((len(items), -(-len(col) // 8)), np.uint8)
            np.bitwise_or.at(flags, (row, place >> 3), (1 << (place & 7)).astype(np.uint8))
            return pa.RecordBatch.from_arrays([pa.array([items]), pa.array([flags.shape[1]], pa.int32()), pa.array([flags.tobytes()], pa.binary())],
                                              ["items", "width", "bits"])

        for b in batches:
            col = b.column(0)
            while len(col):
                take = col.slice(0, most - n)
                rest.append(take)
                n += len(take)
                col = col.slice(len(take))
                if n == most:
                    yield block(rest)
                    rest, n = [], 0
        if n:
            yield block(rest)

    blocks = baskets.select("ids").mapInArrow(run, "items array<int>, width int, bits binary")
    return blocks.withColumn("block", F.monotonically_increasing_id())


def count_sets(sets: DataFrame, blocks: DataFrame, n_sets: int) -> DataFrame:
    """``(ids, freq)`` of the candidates over all blocks."""
    chunks = math.ceil(n_sets / CHUNK)
    schema = pa.schema([("ids", pa.list_(pa.int32())), ("n", pa.int64())])

    def run(key, some: pa.Table, held: pa.Table) -> pa.Table:
        if not some.num_rows or not held.num_rows:
            return schema.empty_table()
        ids = some["ids"].combine_chunks()
        wanted = ids.flatten().to_numpy().reshape(len(ids), -1)
        n = np.zeros(len(wanted), np.int64)
        for items, width, bits in zip(held["items"], held["width"].to_pylist(), held["bits"]):
            known = np.asarray(items.values)
            flags = np.frombuffer(bits.as_buffer(), np.uint8).reshape(len(known), width)
            at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
            rows = np.flatnonzero((known[at] == wanted).all(axis=1))
            for s in range(0, len(rows), 2048):
                part = at[rows[s:s + 2048]]
                both = flags[part[:, 0]]
                for c in range(1, part.shape[1]):
                    both = both & flags[part[:, c]]
                n[rows[s:s + 2048]] += np.bitwise_count(both).sum(axis=1, dtype=np.int64)
        hit = np.flatnonzero(n)
        return pa.Table.from_arrays([ids.take(pa.array(hit)), pa.array(n[hit])], schema=schema)

    left = sets.withColumn("chunk", F.pmod(F.xxhash64("ids"), F.lit(chunks)))
    dealt = blocks.select("block").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))))
    # the candidates go to the blocks, chunk by chunk
    sent = left.join(dealt.toDF("to", "chunk"), "chunk").select("ids", F.col("chunk").alias("part"), "to")
    many = blocks.join(dealt, "block")
    return (sent.groupBy("part", "to").cogroup(many.groupBy("chunk", "block")).applyInArrow(run, "ids array<int>, n long")
            .groupBy("ids").agg(F.sum("n").alias("freq")))


def frequent_itemsets(basket_df: DataFrame, min_support: float, items_col: str = "items", max_size: int | None = None) -> DataFrame:
    """``(items, freq, support)`` with ``support >= min_support``, where support = freq / number of baskets; sets of at most ``max_size`` items, if given."""
    rows = cut_lineage(basket_df.select(F.array_distinct(F.array_compact(F.coalesce(F.col(items_col).cast("array<string>"), F.array()))).alias("items")))
    n = rows.count()
    least = max(1, math.ceil(min_support * n - 1e-9))
    while least > 1 and (least - 1) / n >= min_support:
        least -= 1
    while n and least / n < min_support:
        least += 1
    counts = rows.select(F.explode("items").alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("freq")).where(F.col("freq") >= least)
    items = cut_lineage(row_number_distributed(counts, ["item"], out="id").withColumn("id", F.col("id").cast("int")))
    keyed = cut_lineage(rows.withColumn("basket", F.monotonically_increasing_id()).select("basket", F.explode("items").alias("item")))
    baskets = cut_lineage(keyed.join(items.select("item", "id"), "item").groupBy("basket").agg(F.sort_array(F.collect_list("id")).alias("ids")).select("ids"))
    level = items.select(F.array("id").alias("ids"), "freq")
    found, k, blocks = level, 1, None
    n_items = items.count()
    while max_size is None or k < max_size:
        if k == 1:
            level = cut_lineage(frequent_pairs(baskets, least)) if n_items > 1 else None
        else:
            if blocks is None:
                blocks = cut_lineage(bitmap_blocks(baskets, n_items))
            sets = cut_lineage(candidates(level, k))
            n_sets = sets.count()
            level = cut_lineage(count_sets(sets, blocks, n_sets).where(F.col("freq") >= least)) if n_sets else None
        if level is None or level.isEmpty():
            break
        found, k = found.unionByName(level), k + 1
    # numbers follow the order of the items, so sorted numbers are sorted items
    named = (found.select("ids", "freq", F.posexplode("ids").alias("at", "id")).join(items.select("id", "item"), "id")
             .groupBy("ids", "freq").agg(F.sort_array(F.collect_list(F.struct("at", "item"))).alias("p")))
    return named.select(F.col("p.item").alias("items"), "freq", (F.col("freq") / F.lit(n)).alias("support"))
