"""Embedding near-duplicates by random hyperplanes (operator 7).

Sign hashing: a table's code is the sides of ``k`` random hyperplanes a
vector lies on; two vectors at angle t agree in one bit with chance
``1 - t / pi``.  ``k`` follows the number of different vectors (a code then
holds about half an unrelated one), and as many tables are made as give a
pair at the threshold itself the chance ``RECALL`` to share a code.

Equal vectors are one node with a multiplicity.  Nodes that share a code
are compared in chunks of at most about ``CHUNK`` against each other, so a
code that many vectors share is work for many tasks, none of which holds
it whole.  Every pair is verified by its cosine in double precision and
counted in the first table that brings it together.  A task returns one
row a node (links, and its least linked node), no pairs; components are
joined by star contraction.

Vectors that are null, empty, zero or hold a null or non-finite component link
with nothing; vectors of different length are never linked.  Rows with
equal ids are rows of their own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import gather, materialize, to_int64, worker_state, tidy
from .components import Union, components

RECALL = 0.95
CHUNK = 256
_SMALL = 48  # larger groups are multiplied whole
_PAIRS = 1 << 18


def tables_for(n: int, threshold: float, recall: float = RECALL) -> tuple[int, int]:
    """``(bits, tables)`` for n different vectors."""
    bits = max(4, math.ceil(math.log2(max(n, 2))) + 1)
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log1p(-agree)))


def _planes(dim: int, bits: int, tables: int) -> np.ndarray:
    st = worker_state()
    key = ("planes", dim, bits, tables)
    if key not in st:
        st[key] = np.random.default_rng([2718, dim]).standard_normal((dim, bits * tables))
    return st[key]


def _matrix(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(flat doubles, offsets)`` of a list column without nulls."""
    off = col.offsets.to_numpy().astype(np.int64)
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64), off - off[0]


def sign_codes(nodes: DataFrame, bits: int, tables: int) -> DataFrame:
    """``(node, n, vector, codes)``: adds the code of each table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = np.left_shift(np.int64(1), np.arange(bits, dtype=np.int64))
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                part = b.slice(at, 2048)
                flat, off = _matrix(part.column(2))
                dims = np.diff(off)
                codes = np.zeros((part.num_rows, tables), np.int64)
                for d in np.unique(dims).tolist():
                    which = np.flatnonzero(dims == d)
                    v = flat[gather(off[which], dims[which])].reshape(len(which), d)
                    side = v / np.abs(v).max(axis=1, keepdims=True) @ _planes(d, bits, tables) >= 0
                    codes[which] = side.reshape(len(which), tables, bits) @ weight
                kind = pa.int32() if bits < 32 else pa.int64()
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2),
                                                  pa.array(list(codes.astype(kind.to_pandas_dtype())), pa.list_(kind))], ["node", "n", "vector", "codes"])

    vector = nodes.schema["vector"].dataType.simpleString()
    return nodes.mapInArrow(tidy(run), f"node long, n long, vector {vector}, codes array<{'int' if bits < 32 else 'long'}>")


def _pairs(bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows within each group, some at a time."""
    size = np.diff(bounds)
    last = np.repeat(bounds[1:], size)
    rows = np.arange(bounds[0], bounds[-1])
    count = last - rows - 1
    upto = np.cumsum(count)
    at = 0
    while at < len(rows):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + _PAIRS, side="right")))
        yield np.repeat(rows[at:end], count[at:end]), gather(rows[at:end] + 1, count[at:end])
        at = end


def _compare(table, side, node, n, vec, off, codes, bounds, threshold):
    """``(node, links, root)`` rows for sorted groups: rows ``bounds[g]`` to ``bounds[g + 1]``; ``side`` 0 or 1 tells
    the chunk of a row if the group is a pair of chunks (two rows of one chunk are then left to its own group)."""
    links = np.zeros(len(node), np.int64)
    union = Union(len(node))
    dims = np.diff(off)
    small = np.diff(bounds) <= _SMALL

    def found(a: np.ndarray, b: np.ndarray) -> None:
        first = (codes[a] == codes[b]).argmax(axis=1) == table[a]
        np.add.at(links, a[first], n[b[first]])
        np.add.at(links, b[first], n[a[first]])
        for x, y in zip(a.tolist(), b.tolist()):
            union.join(x, y)

    for d in np.unique(dims).tolist():
        rows = np.flatnonzero(dims == d)
        unit = np.zeros((len(node), d))
        v = vec[gather(off[rows], dims[rows])].reshape(len(rows), d)
        v = v / np.abs(v).max(axis=1, keepdims=True)
        unit[rows] = v / np.sqrt((v * v).sum(axis=1, keepdims=True))
        ok = np.zeros(len(node), bool)
        ok[rows] = True
        # runs of small groups together, pair by pair
        edges = np.flatnonzero(np.diff(np.concatenate([[0], small.astype(np.int8), [0]])))
        for s, e in zip(edges[::2].tolist(), edges[1::2].tolist()):
            for a, b in _pairs(bounds[s:e + 1]):
                use = (side[a] != side[b]) | (side[a] < 0)
                use &= ok[a] & ok[b]
                a, b = a[use], b[use]
                near = np.einsum("ij,ij->i", unit[a], unit[b]) >= threshold
                found(a[near], b[near])
        for g in np.flatnonzero(~small).tolist():
            own = np.arange(bounds[g], bounds[g + 1])
            own = own[ok[own]]
            if not len(own):
                continue
            near = unit[own] @ unit[own].T >= threshold
            near &= (side[own][:, None] != side[own][None, :]) | (side[own] < 0)[:, None]
            a, b = np.nonzero(np.triu(near, 1))
            found(own[a], own[b])
    root = node[union.roots()]
    some = (links > 0) | (root != node)
    return node[some], links[some], root[some]


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, recall: float = RECALL, id_col: str = "vec_id",
                    vector_col: str = "embedding") -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` of every row."""
    given = vectors.schema[vector_col].dataType
    single = isinstance(given, T.ArrayType) and isinstance(given.elementType, T.FloatType)
    vector = F.col(vector_col).cast("array<float>" if single else "array<double>")  # as narrow as they come; compared as doubles
    usable = (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(
        vector, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"),
                          F.when(F.coalesce(usable, F.lit(False)), F.transform(vector, lambda x: F.when(x == 0, F.lit(0.0).cast("float" if single else "double")).otherwise(x))).alias("vector"))
    rows = rows.withColumn("node", F.xxhash64("vector", F.size("vector")))
    rows = rows.withColumn("node", F.when(F.col("vector").isNotNull(), F.col("node")))
    nodes = materialize(rows.where(F.col("node").isNotNull()).groupBy("node")
                        .agg(F.count(F.lit(1)).alias("n"), F.any_value("vector").alias("vector")), "vectors")
    bits, tables = tables_for(nodes.count(), threshold, recall)
    coded = materialize(sign_codes(nodes, bits, tables), "codes")
    places = coded.select("node", F.posexplode("codes").alias("table", "code"))
    shared = (places.groupBy("table", "code").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") > 1)
              .withColumn("chunks", F.ceil(F.col("members") / CHUNK).cast("int")))
    shared = materialize(shared, "shared-codes")
    own = F.pmod(F.xxhash64("node", F.lit(5)), F.col("chunks")).cast("int")
    dealt = (places.join(shared, ["table", "code"]).withColumn("own", own)
             .select("node", "table", "code", "own", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
             .select("node", "table", "code", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
                     F.when(F.col("own") == F.col("other"), F.lit(-1)).otherwise((F.col("own") > F.col("other")).cast("int")).alias("side")))
    # in a pair of chunks (i, j), i < j, rows of i have side 0, rows of j side 1; a chunk by itself has side -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None

        def work(t: pa.Table) -> pa.RecordBatch:
            t = t.combine_chunks()
            cols = {c: t.column(c).to_numpy().astype(np.int64) for c in ("table", "code", "i", "j", "side", "node", "n")}
            flat, off = _matrix(t.column("vector").chunk(0))
            codes = t.column("codes").chunk(0).flatten().to_numpy().reshape(t.num_rows, tables)
            key = np.stack([cols[c] for c in ("table", "code", "i", "j")])
            bounds = np.concatenate([[0], np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1, [t.num_rows]])
            node, links, root = _compare(cols["table"], cols["side"], cols["node"], cols["n"], flat, off, codes, bounds, threshold)
            return pa.RecordBatch.from_arrays([to_int64(node), pa.array(links), to_int64(root)], ["node", "links", "root"])

        for b in batches:
            t = pa.Table.from_batches([b])
            rest = t if rest is None else pa.concat_tables([rest, t])
            key = [rest.column(c).to_numpy() for c in ("table", "code", "i", "j")]
            # the last group may go on in the next batch
            change = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in key]))
            cut = int(change[-1]) + 1 if len(change) else 0
            if cut >= 4096:
                for at in _group_steps(key, cut):
                    yield work(rest.slice(at[0], at[1] - at[0]))
                rest = rest.slice(cut)
        if rest is not None and rest.num_rows:
            key = [rest.column(c).to_numpy() for c in ("table", "code", "i", "j")]
            for at in _group_steps(key, rest.num_rows):
                yield work(rest.slice(at[0], at[1] - at[0]))

    found = materialize(dealt.join(coded, "node").repartition("table", "code", "i", "j")
                        .sortWithinPartitions("table", "code", "i", "j")
                        .select("table", "code", "i", "j", "side", "node", "n", "vector", "codes")
                        .mapInArrow(tidy(run), "node long, links long, root long"), "near-vectors")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.where(F.col("node") != F.col("root")), "node", "root")
    state = materialize(nodes.select("node", "n").join(links, "node", "left").join(roots, "node", "left")
                        .select("node", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
                                F.coalesce("root", "node").alias("root")), "vector-state")
    placed = materialize(rows.select("vec_id", "node").join(state, "node", "left").select("vec_id", "n_links", "root"), "vector-rows")
    least = materialize(placed.where(F.col("root").isNotNull()).groupBy("root").agg(F.min("vec_id").alias("component_id")), "vector-roots")
    return (placed.join(least, "root", "left")
            .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                    F.coalesce("component_id", "vec_id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))))


def _group_steps(key: list[np.ndarray], n: int, rows: int = 8192) -> Iterator[tuple[int, int]]:
    """Cut the first n rows between groups, about ``rows`` at a time."""
    starts = np.concatenate([[0], np.flatnonzero(np.logical_or.reduce([k[1:n] != k[:n - 1] for k in key])) + 1, [n]])
    at = 0
    while at < n:
        end = int(starts[np.searchsorted(starts, at + rows, side="left")]) if at + rows < n else n
        yield at, end
        at = end
