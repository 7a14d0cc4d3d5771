"""Sharding by sampled splitters (operator 5), DataFrame functions only.

Law ``bytes``: shards of nearly equal size.  Records are ordered by (CRC of
the text, id, row), so equal texts are neighbours.  A group of them that a
shard boundary would cut goes whole to the shard it begins in, unless it
holds more than ``1 / GROUP_PART`` of a shard's share.

1. Keys are sampled with a chance that grows with the record's size (half
   of the weight is shared out by rows, so that very many tiny records
   cannot crowd one range).  ``SAMPLE`` bounds the expected sample.
2. Quantiles of the sampled keys are the splitters of ``RANGES`` ranges.
3. A range that came out overfull is subdivided by splitters sampled
   within it, again and again; keys are unique, so this ends.
4. Bytes and rows before each range are running totals over the short
   table of ranges, those within a range come from a window over it.  A
   record's shard is the sixteenth its first byte falls in, so a shard
   exceeds its share by less than one record and one small group.

A null text has size 1 (no bytes plus 1); null ids sort first.  Repeated rows
are records of their own, texts of any length go by their bytes, further
columns take no part, and an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from .common import materialize

SAMPLE = 8192
RANGES = 256
#: A range may hold this many times its share of rows or bytes.
OVERFULL = 4
#: Groups of equal texts up to this part of a shard's share stay together.
GROUP_PART = 16
_COARSE = 16
_SALT = 7919


def _key() -> Column:
    return F.struct(F.col("text_crc32").alias("c"), F.coalesce("doc_id", F.lit(1 - (1 << 63))).alias("i"), F.col("row").alias("r"))


def _chance() -> Column:
    """A number in [0, 1) that a record always gets again."""
    return F.pmod(F.xxhash64("text_crc32", "doc_id", "row", F.lit(_SALT)), F.lit(1 << 40)) / F.lit(float(1 << 40))


def _range_of(splitters: list[Row]) -> Column:
    """How many of the ascending splitters lie at or before the record's key: a coarse step, then one within it.
    The splitters are few (``RANGES`` and what subdividing adds), so they are literals of the expression."""
    def upto(keys: Column) -> Column:
        return F.size(F.filter(keys, lambda s: s <= _key()))

    def literal(rows: list[Row]) -> str:
        return "array(" + ", ".join(f"named_struct('c', {r.c}L, 'i', {r.i}L, 'r', {r.r}L)" for r in rows) + ")"

    if not splitters:
        return F.lit(0).cast("long")
    parts = [splitters[k:k + _COARSE] for k in range(0, len(splitters), _COARSE)]
    near = upto(F.expr(literal([p[0] for p in parts])))
    part = F.element_at(F.expr(f"array({', '.join(map(literal, parts))})"), F.greatest(near, F.lit(1)))
    return F.when(near == 0, F.lit(0)).otherwise((near - 1) * _COARSE + upto(part)).cast("long")


def _quantiles(sample: DataFrame, by: list[str], parts: int) -> DataFrame:
    """The keys that cut each group of the (bounded) sample into ``parts``."""
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    n, rank = F.count(F.lit(1)).over(group), F.row_number().over(group.orderBy("key"))
    return (sample.select("key", n.alias("n"), rank.alias("k"))
            .where(F.floor(F.col("k") * parts / F.col("n")) > F.floor((F.col("k") - 1) * parts / F.col("n")))
            .select("key"))


def shard(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, size, text_crc32, law, shard, slot, grown_shard)`` of every row."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rec = materialize(docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
                                  F.crc32(text.cast("binary")).alias("text_crc32"),
                                  F.monotonically_increasing_id().alias("row")), "shard-records")
    whole = rec.agg(F.sum("size"), F.count(F.lit(1)), F.max("size")).first()
    total, rows, largest = whole[0] or 1, max(whole[1], 1), whole[2] or 1
    weight = (F.col("size") / F.lit(float(total)) + F.lit(1.0 / rows)) / 2
    sample = rec.where(_chance() < weight * SAMPLE).select(_key().alias("key"))
    splitters = sorted(r.key for r in _quantiles(sample, [], RANGES).collect())
    while True:
        placed = rec.withColumn("range", _range_of(splitters))
        stats = materialize(placed.groupBy("range").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")), "ranges")
        over = stats.where((F.col("rows") > 1) & ((F.col("bytes") > OVERFULL * total // RANGES + largest)
                                                  | (F.col("rows") > OVERFULL * rows // RANGES + 1)))
        if over.isEmpty():
            break
        # about 64 weighted samples of each overfull range cut it into 8 or more
        inner = (placed.join(over, "range")
                 .where(_chance() < 32 * (F.col("size") / F.col("bytes") + 1 / F.col("rows")))
                 .select("range", _key().alias("key")))
        splitters = sorted({*splitters, *(r.key for r in _quantiles(inner, ["range"], 8).collect())})
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stats.select("range", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
                           F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"))
    inside = Window.partitionBy("range").orderBy(F.col("text_crc32"), F.col("doc_id"), F.col("row"))
    first_byte = F.col("bytes_before") + F.col("upto") - F.col("size")
    placed = (placed.select("*", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"),
                            F.row_number().over(inside).alias("nth"))
              .join(offsets, "range")
              .select("doc_id", "size", "text_crc32",
                      F.least(F.floor(first_byte.cast("decimal(38,0)") * shards / F.lit(total).cast("decimal(20,0)")), F.lit(shards - 1))
                      .cast("int").alias("shard"),
                      (F.col("rows_before") + F.col("nth") - 1).alias("place")))
    placed = materialize(placed, "shards")
    # a boundary cuts one group at most, so this table has fewer rows than there are shards
    cut = placed.groupBy("shard").agg(F.min_by("text_crc32", "place").alias("first"), F.max_by("text_crc32", "place").alias("last"))
    cut = cut.alias("a").join(cut.alias("b"), F.col("a.last") == F.col("b.first")).where(F.col("a.shard") < F.col("b.shard"))
    groups = (placed.join(F.broadcast(cut.select(F.col("a.last").alias("text_crc32")).distinct()), "text_crc32")
              .groupBy("text_crc32").agg(F.sum("size").alias("bytes"), F.min("shard").alias("begins"))
              .where(F.col("bytes") * (shards * GROUP_PART) <= total))
    placed = (placed.join(F.broadcast(groups.select("text_crc32", "begins")), "text_crc32", "left")
              .withColumn("shard", F.coalesce("begins", "shard")).drop("begins"))
    firsts = placed.groupBy("shard").agg(F.min("place").alias("first"))  # one row a shard
    return placed.join(firsts, "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("place") - F.col("first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))
