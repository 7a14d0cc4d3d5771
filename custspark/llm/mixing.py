"""Mixing sources to target weights by pivotal dependent rounding (operator 11).

Targets: the sources, ascending by code point and a null source last, weigh
``WEIGHTS`` in turn and share ``SHARE`` times the words of all documents; no target exceeds
``LIMIT`` times its source's words, and what is cut off goes to the others by weight
until none is above (each round is one aggregate over the table of sources).

A document of a source with ``target / words = r`` is taken ``floor(r)`` times,
and once more with chance ``r - floor(r)``.  These fractional copies are
rounded together: two documents meet, and mass (words) moves from one to the
other, in the direction a fair draw says, until one of them is taken or left for
certain; the other goes on to meet the next.  The words taken stay the same at
every meeting, and every document keeps its chance.

* A source's documents stand in a row, largest first, in leaves of ``LEAF`` documents,
  numbered across the cluster; a leaf leaves one document undecided, ``FAN`` leaves meet a
  level higher, and so on (a reduction tree; no task holds more than a leaf or
  ``FAN`` leftovers, whatever a source's share of the rows).
* One undecided document at the end would miss the target by its size, so documents above
  a ``GIANT``-th of their source (fewer than ``GIANT`` of them a source) are settled first, size class
  by size class, and each class's miss goes into the rate of the documents smaller than
  it.  The bulk then misses by one document of at most a ``GIANT``-th of the source's words.

Draws are hashes of id, text and place, so reruns agree, on any partitioning.
Documents without words (null, empty, blank) are taken with no words.  Rows
with equal or null ids are rows of their own.  Other columns are not looked at.  An empty table
gives an empty result; a table without words has targets of 0.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import row_number_distributed
from .common import map_arrow, materialize, space_class, text_buffers, text_column, text_steps

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
LIMIT = 2.0
LEAF = 8192
FAN = 1024
GIANT = 1000


def word_counts(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """``(doc_id, source, tie, size)`` of every row: its words and a hash of id and text."""
    text = text_column(docs, text_col)
    doc_id = F.col(id_col).cast("long")
    rows = docs.select(doc_id.alias("doc_id"), F.col(source_col).cast("string").alias("source"),
                       F.xxhash64(F.coalesce(doc_id, F.lit(-1)), text).alias("tie"), text.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        is_word = space_class()
        for b in text_steps(batches, "text"):
            data, off = text_buffers(b.column(3))
            start = is_word[data]
            head = off[:-1][off[:-1] < off[1:]]  # the first byte of every text that has one
            first = start[head]
            start[1:] &= ~start[:-1].copy()
            start[head] = first
            upto = np.zeros(len(data) + 1, np.int64)
            np.cumsum(start, out=upto[1:])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(upto[off[1:]] - upto[off[:-1]])],
                                             ["doc_id", "source", "tie", "size"])

    return map_arrow(rows, run, "doc_id long, source string, tie long, size long")


def targets(sources: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, limit: float = LIMIT) -> DataFrame:
    """``(sid, source, source_size, target)`` from ``(source, source_size)``."""
    order = [F.col("source").isNull(), F.col("source")]
    rows = row_number_distributed(sources, order, out="sid")
    weight = F.array(*[F.lit(float(w)) for w in weights])[F.pmod(F.col("sid") - 1, F.lit(len(weights))).cast("int")]
    rows = materialize(rows.withColumn("weight", weight).withColumn("most", F.col("source_size") * F.lit(limit)), "sources")
    rate = 0.0
    while True:
        # sources whose share at this rate is above their limit stand at the limit
        full = F.col("most") <= F.col("weight") * F.lit(rate)
        total, fixed, free = rows.agg(F.sum("source_size"), F.sum(F.when(full, F.col("most"))), F.sum(F.when(~full, F.col("weight")))).first()
        if not free:
            break
        now = (share * (total or 0) - (fixed or 0.0)) / free
        if now <= rate:
            break
        rate = now
    return rows.withColumn("target", F.least(F.col("most"), F.col("weight") * F.lit(rate))).select("sid", "source", "source_size", "target")


def _draws(tie: np.ndarray, place: np.ndarray, salt: int) -> np.ndarray:
    """Numbers from 0 to below 1, by hash."""
    with np.errstate(over="ignore"):
        x = tie.astype(np.int64).view(np.uint64) + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt)
        for shift, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(times)
        x ^= x >> np.uint64(31)
    return (x >> np.uint64(11)).astype(np.float64) / 9007199254740992.0


def settle(size: np.ndarray, part: np.ndarray, draw: np.ndarray) -> tuple[np.ndarray, int]:
    """Round the fractions ``part`` of documents of ``size`` words, in the given order: ``(rounded, left)``, where ``left``
    is the row that keeps a fraction (-1 if none does).  The sum of ``size * part`` stays as it is."""
    out = part.copy()
    held = -1
    a = p = 0.0
    for i, (b, q, u) in enumerate(zip(size.tolist(), part.tolist(), draw.tolist())):
        if q <= 0.0 or q >= 1.0 or b <= 0:
            continue
        if held < 0:
            held, a, p = i, b, q
            continue
        up, down = min(a * (1.0 - p), b * q), min(a * p, b * (1.0 - q))  # words that may move to the held one, or from it
        if u * (up + down) < down:
            to_end = up >= a * (1.0 - p)
            p, q = (1.0, q - up / b) if to_end else (p + up / a, 0.0)
        else:
            to_end = down >= a * p
            p, q = (0.0, q + down / b) if to_end else (p - down / a, 1.0)
        if to_end:
            out[held] = p
            held, a, p = (i, b, q) if 1e-12 < q < 1.0 - 1e-12 else (-1, 0.0, 0.0)
            if held < 0:
                out[i] = round(q)
        else:
            out[i] = q
            if not 1e-12 < p < 1.0 - 1e-12:
                out[held] = round(p)
                held = -1
    if held >= 0:
        out[held] = p
    return out, held


def settle_giants(size: np.ndarray, tie: np.ndarray, target: float, total: int, limit: float, salt: int) -> np.ndarray:
    """Copies of a source's largest documents (descending sizes), class by class of sizes within a factor of two; what a class
    misses goes into the rate of all smaller documents."""
    copies = np.zeros(len(size), np.int64)
    words, rest = float(target), float(total)
    draw, last = _draws(tie, np.arange(len(size)), salt), _draws(tie, np.arange(len(size)), salt + 1)
    at = 0
    while at < len(size):
        end = int(np.searchsorted(-size, -size[at] / 2.0, side="left"))
        end = max(end, at + 1)
        rate = min(max(words / rest, 0.0), limit)
        whole = math.floor(rate)
        part, left = settle(size[at:end], np.full(end - at, rate - whole), draw[at:end])
        if left >= 0:
            part[left] = float(last[at + left] < part[left])
        copies[at:end] = whole + np.rint(part).astype(np.int64)
        words -= float((copies[at:end] * size[at:end]).sum())
        rest -= float(size[at:end].sum())
        at = end
    return copies


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, limit: float = LIMIT, seed: int = 0,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``(doc_id, source, size, source_size, target, copies, taken)`` of every row; ``taken`` is ``copies * size``.
    ``limit`` is a whole number: no document is taken more often."""
    if limit != int(limit):
        raise ValueError("limit must be a whole number")
    salt = (seed * 7919 + 17) % (1 << 31)
    counted = materialize(word_counts(docs, id_col, text_col, source_col), "word-counts")
    sources = materialize(targets(counted.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, limit), "targets")
    rows = counted.join(sources.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    placed = materialize(row_number_distributed(rows, [F.desc("size"), F.col("tie"), F.col("doc_id")], strata=["sid"], out="place"), "placed")
    giant = (F.col("size") > 0) & (F.col("size") * F.lit(GIANT) > F.col("source_size"))

    def large(of: pa.Table) -> pa.Table:
        of = of.sort_by("place")
        copies = settle_giants(of["size"].to_numpy(), of["tie"].to_numpy(), of["target"][0].as_py(), of["source_size"][0].as_py(), limit, salt)
        return of.select(["sid", "place", "doc_id", "size"]).append_column("copies", pa.array(copies))

    # fewer than GIANT rows a source
    giants = materialize(placed.where(giant).select("sid", "place", "doc_id", "size", "tie", "target", "source_size").groupBy("sid")
                         .applyInArrow(large, "sid long, place long, doc_id long, size long, copies long"), "giants")
    done = giants.groupBy("sid").agg(F.sum("size").alias("large"), F.sum(F.col("size") * F.col("copies")).alias("gone"))
    rate = F.try_divide(F.col("target") - F.coalesce("gone", F.lit(0)), F.col("source_size") - F.coalesce("large", F.lit(0)))
    rates = materialize(sources.join(done, "sid", "left").withColumn(
        "rate", F.coalesce(F.least(F.greatest(rate, F.lit(0.0)), F.lit(float(limit))), F.lit(0.0)))
        .select("sid", F.floor("rate").alias("whole"), (F.col("rate") - F.floor("rate")).alias("part")), "rates")

    def level(depth: int):
        def run(of: pa.Table) -> pa.Table:
            of = of.sort_by("place")
            size, place, tie, part = (of[c].to_numpy() for c in ("size", "place", "tie", "part"))
            part, left = settle(size, part, _draws(tie, place, salt + 2 + depth))
            at = of.schema.get_field_index("part")
            return of.set_column(at, "part", pa.array(part)).append_column("open", pa.array(np.arange(len(part)) == left))
        return run

    # a leaf's documents are settled but for one; no row of the bulk moves again after this
    schema = "sid long, place long, doc_id long, size long, tie long, whole long, leaf long, part double"
    leaves = materialize(
        placed.where(~giant).join(rates, "sid").withColumn("leaf", F.floor((F.col("place") - 1) / LEAF))
        .withColumn("part", F.when(F.col("size") > 0, F.col("part")).otherwise(0.0))
        .select("sid", "place", "doc_id", "size", "tie", "whole", "leaf", "part")
        .groupBy("sid", "leaf").applyInArrow(level(0), schema + ", open boolean"), "leaves")
    # leftovers, one a leaf, meet FAN at a time until one a source is left
    ended = leaves.where(~F.col("open")).drop("open")
    rest, depth = leaves.where("open").drop("open"), 1
    while (rest.agg(F.max("leaf")).first()[0] or 0) > 0:
        met = materialize(rest.withColumn("leaf", F.floor(F.col("leaf") / FAN)).groupBy("sid", "leaf")
                          .applyInArrow(level(depth), schema + ", open boolean"), "meeting")
        ended = ended.unionByName(met.where(~F.col("open")).drop("open"))
        rest, depth = met.where("open").drop("open"), depth + 1

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            place, tie, part = (b.column(i).to_numpy() for i in (1, 4, 7))
            yield b.set_column(7, "part", pa.array((_draws(tie, place, salt + 1) < part).astype(np.float64)))

    copies = (ended.unionByName(map_arrow(rest, final, schema))
              .select("sid", "doc_id", "size", (F.col("whole") + F.rint("part").cast("long")).alias("copies"))
              .unionByName(giants.select("sid", "doc_id", "size", "copies")))
    return (copies.join(sources, "sid")
            .select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")))
