"""Hard-negative mining over Hilbert-ordered blocks with zone maps (operator 13).

Entries become whole numbers (``floor(scale * x)``), a score is the inner product with the
anchor, and higher scores come first, ties by the smaller id.

Rows are ordered along a Hilbert curve through the axes of the greatest variance and cut into
blocks of ``BLOCK`` rows.  A block is one row of a Parquet table: its packed vectors, and beside them a zone
map, the least and greatest entry of every dimension and the labels it holds.  Interval
arithmetic on the zone map bounds every score a block can give an anchor
(``sum(max(a * low, a * high))`` from above, with ``min`` from below), so a block is read for an
anchor only if one of the anchor's windows of scores meets that interval.  What an
anchor asks for has no upper end for its positives and is ``low`` to ``high`` percent of the
positive's score for each positive's negatives.  Its own group of blocks is read
first, and the k-th best score found there raises the lower end of the window.

Anchors are dealt in slices and blocks in groups, both of bounded bytes; a task holds one slice and one
group that has a block the slice must read.  Work grows with anchors times rows where the zone maps exclude little, as for
vectors without structure in many dimensions; results are exact either way.  A task returns the best k of
each window, no other pair.

Rows with a null label, a null vector or a null or non-finite entry take no part.  Vectors of
different lengths are compared as if the shorter ones ended in zeros (an empty vector
scores 0).  Rows with equal ids are rows of their own (ties between them fall either way, with equal results); a null id
is no anchor and stands last among ties (the id 2**63 - 1 means null inside).
Scores are exact below 2**53.  Other columns are not looked at; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranking import row_number_distributed
from .common import map_arrow, materialize, parallelism

BLOCK = 256
#: Bytes of the vectors in a slice of anchors, or in a group of blocks.
TILE_BYTES = 8 << 20
#: Zone maps that one task holds.
ZONES = 2048
#: Axes of the curve.
AXES = 8
_NO_ID = (1 << 63) - 1
_LEAST = -(1 << 62)
_MOST = 1 << 62
_STEP = 128


def hilbert_key(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place of every row of ``cells`` (whole numbers below ``2**bits``, one column an axis) on the Hilbert curve."""
    x = cells.astype(np.int64).copy()
    axes = x.shape[1]
    for bit in range(bits - 1, 0, -1):  # undo turns and mirrors, from the largest cube down
        low = (1 << bit) - 1
        for i in range(axes):
            on = (x[:, i] >> bit & 1).astype(bool)
            swap = np.where(on, 0, (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] ^= np.where(on, low, swap)
            if i:
                x[:, i] ^= swap
    for i in range(1, axes):
        x[:, i] ^= x[:, i - 1]
    turn = np.zeros(len(x), np.int64)
    for bit in range(bits - 1, 0, -1):
        turn ^= np.where(x[:, -1] >> bit & 1, (1 << bit) - 1, 0)
    x ^= turn[:, None]
    key = np.zeros(len(x), np.int64)
    for bit in range(bits - 1, -1, -1):
        for i in range(axes):
            key = key << 1 | x[:, i] >> bit & 1
    return key


def _matrix(col: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """The vectors of a list column as doubles, shorter ones filled up with zeros."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    size = np.diff(col.offsets.to_numpy())
    if (size == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(col), dim))
    out[np.repeat(np.arange(len(col)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def whole_vectors(vectors: DataFrame, scale: int, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """``(vec_id, label, v)`` of the rows that take part, entries as whole numbers."""
    vector = F.col(vector_col).cast("array<double>")
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.col(label_col).isNotNull()
    return (vectors.where(F.coalesce(good, F.lit(False)))
            .select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"),
                    F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x)).alias("v")))


def _axes(rows: DataFrame, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The axes of greatest variance, and their least and greatest entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column(0), dim)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim, dtype=np.int32)), pa.array(np.full(dim, len(x))), pa.array(x.sum(axis=0)),
                                                  pa.array((x * x).sum(axis=0)), pa.array(x.min(axis=0)), pa.array(x.max(axis=0))],
                                                 ["axis", "n", "s", "q", "low", "high"])

    got = (map_arrow(rows.select("v"), run, "axis int, n long, s double, q double, low double, high double").groupBy("axis")
           .agg((F.sum("q") / F.sum("n") - F.pow(F.sum("s") / F.sum("n"), 2)).alias("spread"), F.min("low").alias("low"), F.max("high").alias("high"))
           .orderBy(F.desc("spread"), "axis").limit(AXES).collect())
    return tuple(np.array([r[c] for r in got]) for c in ("axis", "low", "high"))


def ordered_blocks(rows: DataFrame, dim: int) -> tuple[DataFrame, DataFrame]:
    """``(placed, blocks)``: the rows with their ``place`` on the curve, and a row a block with its vectors and zone map."""
    axis, low, high = _axes(rows, dim)
    bits = min(60 // max(len(axis), 1), 16)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(2), dim)[:, axis]
            cells = np.minimum(np.floor((x - low) * (2.0 ** bits / (high - low + 1.0))), 2 ** bits - 1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(hilbert_key(cells, bits))], ["vec_id", "label", "v", "curve"])

    keyed = map_arrow(rows, run, "vec_id long, label long, v array<long>, curve long")
    placed = materialize(row_number_distributed(keyed, ["curve", "vec_id", "label", "v"], out="place").drop("curve"), "placed")
    schema = "block long, ids array<long>, labels array<long>, v array<double>, places array<long>, low array<double>, high array<double>, kinds array<long>"

    def pack(of: pa.Table) -> pa.Table:
        of = of.sort_by([("vec_id", "ascending"), ("place", "ascending")])
        x = _matrix(of["v"], dim)
        labels = of["label"].to_numpy()
        lists = ([of["vec_id"].to_numpy()], [labels], [x.reshape(-1)], [of["place"].to_numpy()], [x.min(axis=0)], [x.max(axis=0)], [np.unique(labels)])
        return pa.Table.from_arrays([of["block"].slice(0, 1), *(pa.array(c) for c in lists)],
                                    ["block", "ids", "labels", "v", "places", "low", "high", "kinds"])

    blocks = (placed.withColumn("block", F.floor((F.col("place") - 1) / BLOCK)).withColumn("vec_id", F.coalesce("vec_id", F.lit(_NO_ID)))
              .groupBy("block").applyInArrow(pack, schema))
    return placed, materialize(blocks, "blocks")


_ASK = "aid long, slice long, label long, v array<long>, lows array<long>, highs array<long>"


def _meets(of: np.ndarray, kinds: list[list[int]], label: np.ndarray, same: bool) -> np.ndarray:
    """Which blocks (columns) hold a row of the wanted labels for which anchors (rows)."""
    out = np.zeros((len(label), len(kinds)), bool)
    for i, k in enumerate(kinds):
        out[:, i] = np.isin(label, k) if same else (len(k) > 1) | (label != k[0])
    return out & of


def wanted_blocks(asks: DataFrame, blocks: DataFrame, dim: int, group: int, n_blocks: int, slices: int, same: bool) -> DataFrame:
    """``asks`` once for each group of blocks it must read, with the blocks: those whose interval of scores meets one of its windows."""

    def bounds(key, ask: pa.Table, zones: pa.Table) -> pa.Table:
        schema = pa.schema([*ask.schema.remove(ask.schema.get_field_index("zs")), ("grp", pa.int64()), ("need", pa.list_(pa.int64()))])
        ask = ask.drop_columns(["zs"])
        if not ask.num_rows or not zones.num_rows:
            return schema.empty_table()
        zones = zones.sort_by("block")
        low, high = _matrix(zones["low"], dim), _matrix(zones["high"], dim)
        block = zones["block"].to_numpy()
        kinds, grp = zones["kinds"].to_pylist(), block // group
        edges = np.concatenate([[0], np.flatnonzero(np.diff(grp)) + 1, [len(grp)]])
        out = []
        for at in range(0, ask.num_rows, _STEP):
            part = ask.slice(at, _STEP)
            a = _matrix(part["v"], dim)
            up, down = np.maximum(a, 0.0), np.minimum(a, 0.0)
            most, least = up @ high.T + down @ low.T, up @ low.T + down @ high.T
            need = np.zeros(most.shape, bool)
            lows, highs = part["lows"].to_pylist(), part["highs"].to_pylist()
            for i, (lo, hi) in enumerate(zip(lows, highs)):
                for x, y in zip(lo, hi):
                    need[i] |= (most[i] >= x) & (least[i] <= y)
            need = _meets(need, kinds, part["label"].to_numpy(), same)
            for s, e in zip(edges[:-1].tolist(), edges[1:].tolist()):
                rows = np.flatnonzero(need[:, s:e].any(axis=1))
                if len(rows):
                    out.append(part.take(pa.array(rows)).append_column("grp", pa.array(np.full(len(rows), grp[s])))
                               .append_column("need", pa.array([block[s:e][need[r, s:e]] for r in rows.tolist()], pa.list_(pa.int64()))))
        return pa.concat_tables(out).cast(schema) if out else schema.empty_table()

    tiles = math.ceil(n_blocks / ZONES)
    left = asks.withColumn("zs", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(tiles - 1).cast("long"))))
    right = (blocks.select("block", "low", "high", "kinds", F.floor(F.col("block") / ZONES).alias("zs"),
                           F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slices - 1).cast("long"))).alias("slice")))
    return left.groupBy("slice", "zs").cogroup(right.groupBy("slice", "zs")).applyInArrow(bounds, _ASK + ", grp long, need array<long>")


def _scored(dim: int, same: bool, k: int) -> Callable:
    schema = pa.schema([("aid", pa.int64()), ("w", pa.int32()), ("score", pa.int64()), ("found", pa.int64())])

    def run(key, ask: pa.Table, held: pa.Table) -> pa.Table:
        if not ask.num_rows or not held.num_rows:
            return schema.empty_table()
        ask = ask.sort_by("aid")
        count = [len(x) for x in held["ids"].to_pylist()]
        of = np.repeat(held["block"].to_numpy(), count)
        ids, labels, places = (held[c].combine_chunks().flatten().to_numpy() for c in ("ids", "labels", "places"))
        x = held["v"].combine_chunks().flatten().to_numpy().reshape(len(ids), dim)
        by_id = np.lexsort((places, ids))  # so that the first of equal scores has the least id
        of, ids, labels, places, x = of[by_id], ids[by_id], labels[by_id], places[by_id], x[by_id]
        out: list[tuple] = []
        for at in range(0, ask.num_rows, _STEP):
            part = ask.slice(at, _STEP)
            a, aid, label = _matrix(part["v"], dim), part["aid"].to_numpy(), part["label"].to_numpy()
            cols = np.flatnonzero(np.isin(of, part["need"].combine_chunks().flatten().to_numpy()))
            scores = a @ x[cols].T
            usable = (labels[cols][None, :] == label[:, None]) == same
            usable &= places[cols][None, :] != aid[:, None]
            scores[~usable] = -np.inf
            lows, highs = part["lows"].to_pylist(), part["highs"].to_pylist()
            rows = np.arange(len(a))
            for w in range(max(map(len, lows))):
                lo = np.array([v[w] if w < len(v) else _MOST for v in lows], np.float64)[:, None]
                hi = np.array([v[w] if w < len(v) else _LEAST for v in highs], np.float64)[:, None]
                now = np.where((scores >= lo) & (scores <= hi), scores, -np.inf)
                for _ in range(k):
                    best = now.argmax(axis=1)
                    value = now[rows, best]
                    some = value > -np.inf
                    if not some.any():
                        break
                    out.append((aid[some], np.full(int(some.sum()), w, np.int32), value[some].astype(np.int64), ids[cols[best[some]]]))
                    now[rows, best] = -np.inf
        if not out:
            return schema.empty_table()
        return pa.Table.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], schema=schema)

    return run


def best_of(asks: DataFrame, blocks: DataFrame, dim: int, group: int, same: bool, k: int) -> DataFrame:
    """``(aid, w, rank, score, found)``: the best ``k`` rows of every window ``w``, from the blocks of ``need`` (asks with ``grp`` and ``need``)."""
    asks = materialize(asks, "reads")
    held = (blocks.select(F.floor(F.col("block") / group).alias("grp"), "block", "ids", "labels", "v", "places")
            .join(asks.select("slice", "grp").distinct().toDF("part", "of"), F.col("of") == F.col("grp")).drop("grp"))
    found = (asks.groupBy("slice", "grp").cogroup(held.groupBy("part", "of"))
             .applyInArrow(_scored(dim, same, k), "aid long, w int, score long, found long"))
    order = Window.partitionBy("aid", "w").orderBy(F.desc("score"), "found")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(vectors: DataFrame, anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256,
         id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``: for each row that ``anchor`` (a condition on
    the column ``vec_id``) marks, and each of its first ``positives`` other rows of the same label, the first ``negatives`` rows of another label whose
    score is from ``low`` to ``high`` percent of the positive's."""
    spark = vectors.sparkSession
    result = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    rows = materialize(whole_vectors(vectors, scale, id_col, vector_col, label_col), "whole-vectors")
    n, dim = rows.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    if not n:
        return spark.createDataFrame([], result)
    dim = max(dim, 1)
    placed, blocks = ordered_blocks(rows, dim)
    n_blocks = math.ceil(n / BLOCK)
    tile = max(TILE_BYTES // (8 * dim), 1)
    # a group holds no more than a tile, and there are some groups for every task
    group = max(1, min(tile // BLOCK, math.ceil(n_blocks / (2 * parallelism(spark)))))
    anchors = row_number_distributed(placed.where(F.col("vec_id").isNotNull()).where(anchor), ["place"], out="_rn")
    anchors = materialize(anchors.select(F.col("place").alias("aid"), F.col("vec_id").alias("anchor_id"),
                                         F.floor((F.col("_rn") - 1) / tile).alias("slice"), "label", "v"), "anchors")
    slices = (anchors.agg(F.max("slice")).first()[0] or 0) + 1
    own = F.floor((F.col("aid") - 1) / (BLOCK * group))  # the group an anchor stands in
    own_blocks = F.sequence(F.col("grp") * group, F.col("grp") * group + group - 1)

    def search(asks: DataFrame, same: bool, k: int) -> DataFrame:
        ask = [c.strip().split()[0] for c in _ASK.split(",")]
        near = best_of(asks.select(*ask, own.alias("grp")).withColumn("need", own_blocks), blocks, dim, group, same, k)
        near = near.where(F.col("rank") == k).select("aid", F.struct("w", "score").alias("p")).groupBy("aid").agg(F.collect_list("p").alias("least"))
        at_least = F.transform("lows", lambda x, i: F.greatest(x, F.coalesce(F.get(F.filter("least", lambda p: p["w"] == i), F.lit(0))["score"], F.lit(_LEAST))))
        asks = asks.join(near, "aid", "left").withColumn("lows", F.when(F.col("least").isNull(), F.col("lows")).otherwise(at_least))
        reads = wanted_blocks(materialize(asks.select(*ask), "asks"), blocks, dim, group, n_blocks, slices, same)
        return materialize(best_of(reads, blocks, dim, group, same, k), "found")

    open_window = anchors.withColumns({"lows": F.array(F.lit(_LEAST)), "highs": F.array(F.lit(_MOST))})
    best = search(open_window, True, positives)
    # windows in whole numbers: low * positive <= 100 * negative <= high * positive; below 0 no score is in it
    useful = best.where(F.col("score") >= 0).select("aid", "rank", F.col("found").alias("positive"), F.col("score").alias("positive_score"))
    window = F.struct("rank", F.expr(f"({low} * positive_score + 99) div 100").alias("lo"), F.expr(f"({high} * positive_score) div 100").alias("hi"))
    windows = useful.groupBy("aid").agg(F.sort_array(F.collect_list(window)).alias("p"))  # at most ``positives`` an anchor
    asks = anchors.join(windows, "aid").withColumns({"lows": F.col("p.lo"), "highs": F.col("p.hi")})
    found = search(asks, False, negatives)
    # useful positives of an anchor are its first ones, so window w is that of rank w + 1
    out = found.join(useful.withColumnRenamed("rank", "of").withColumn("w", F.col("of") - 1), ["aid", "w"]).join(anchors.select("aid", "anchor_id"), "aid")
    known = lambda c: F.nullif(F.col(c), F.lit(_NO_ID))
    return out.select("anchor_id", known("positive").alias("positive_id"), "rank", known("found").alias("negative_id"), "positive_score",
                      F.col("score").alias("negative_score"))
