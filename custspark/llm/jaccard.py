"""Jaccard join over word shingles in metric space (operator 3).

The Jaccard distance ``d`` is a metric, and two sets link when ``d`` is at
most ``EPS = 1 - 0.75``.  The join runs in regions around pivots.

Regions of the corpus.  Most texts have nothing in common, so whole texts
are bad pivots at first: nearly all distances are 1.  The first pivots are
single shingles: ``d(x, {s}) < 1`` exactly if s is in x.  A partner of x
within EPS lacks at most a quarter of x's shingles, so of any
``n - ceil(0.75 n) + 1`` of them, x and the partner share one if both take
them in the same order (the window that replicates x to several regions).
Shingles that many texts of a sample hold come last in that order; the
sample decides the cost of the join, never its result.  All texts that
share a shingle of their windows meet in the region of the least text
among them; for a frequent shingle that is its least sampled holder.  A
shingle whose holders all have the same shingle before it in their windows
needs no region: they meet at that one already.

First pass over the regions: sets are compared by bitmaps of about one bit a
shingle.  Different bits of two bitmaps are different members of the sets,
so a pair with more of them than ``d <= EPS`` allows is no link (sizes too far
apart are the simplest case).  What may be linked is connected to candidate
classes; a text belongs to one, and travels there once.

Cells of a class.  ``CELLS`` pivot sets of a class of more than ``BLOCK`` sets
create Voronoi cells.  A set x is at home in its nearest pivot's cell if that
is within ``RADIUS``, else in the cell of what is far from all pivots.  Sets
that link to x have distances within ``EPS`` of x's, so by the triangle
inequality a set also goes to every cell whose pivot is at most ``2 EPS``
farther than its nearest and within ``RADIUS + EPS``, and to the far cell if it
is more than ``RADIUS - EPS`` from all pivots: the partners of a set are all in
the cell where it is at home, and its links are counted there.  Cells are
divided in the same way, round by round over the cluster, until they are small
or stop shrinking.

Cells in a task.  At most about ``BLOCK`` sets (two of a larger cell's blocks at
a time) meet in one task.  There, pivots divide them again, and what is small
or stops shrinking is joined exactly, by intersection sizes.  When only classes are asked for, sets already
known to be connected need no further links, so a cell whose sets hang together
is done.  When links are counted, every pair that the cells allow is verified;
two sets of one block meet in several tasks and count in one of them.

Equal sets are one node.  Texts without words have no shingles and are
classes of their own; texts with fewer words than a shingle have one, their
whole sequence.  Null ids take part; a class is named by its least id that
is not null.  Repeated rows are one node and rows of their own in the result;
a very long text is a step of its own.  Further columns take no part, whatever
their names, and ``keep_first`` hands them on; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import (tidy, Words, _mix, filesystem, gather, keyed, lower_ascii, materialize, scratch_path, space_class, text_buffers,
                     text_steps, to_int64, unused_names, whole_rows, windows, worker_state)
from .components import Union, components

SHINGLE = 5
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Expected text bytes of the sample that orders the shingles; bounds the table that tasks load.
SAMPLE_BYTES = 64 << 20
#: Sampled texts that must hold a shingle to call it frequent.
FREQUENT = 3
#: Sets of a region or cell that meet in one task, and those joined without further pivots.
BLOCK = 512
LEAF = 192
PIVOTS = 8
#: Pivots of a cell that is divided over the cluster, and the distance up to which a set is at home with one.
CELLS = 32
RADIUS = 0.5
#: A cell is divided on if it has no more than this part of the sets of the cell it came from.
SHRINK = 0.8


# --- sets ----------------------------------------------------------------------

def shingle_sets(col: pa.Array, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """``(hashes, row bounds)``: the sorted distinct shingles of every text."""
    data, offsets = text_buffers(col)
    words = Words(lower_ascii(data), offsets, space_class())
    h = words.hashes()
    full = whole_rows(words, k)
    values, rows = windows(h, k)[full], words.doc[:len(full)][full]
    short = np.flatnonzero((words.count > 0) & (words.count < k))
    if len(short):
        first = words.first[short]
        whole = np.zeros(len(short), np.uint64)
        for j in range(k - 1):  # the whole sequence, position by position
            has = words.count[short] > j
            at = np.minimum(first + j, len(h) - 1)
            whole = np.where(has, _mix(whole + h[at]) + np.uint64(j + 1), whole)
        values, rows = np.concatenate([values, _mix(whole)]), np.concatenate([rows, short])
    order = np.lexsort((values, rows))
    values, rows = values[order], rows[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (rows[1:] != rows[:-1])
    values, rows = values[new], rows[new]
    return values, np.searchsorted(rows, np.arange(len(col) + 1))


def node_keys(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set (of its members, whatever the text)."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix(values), dtype=np.uint64)])
    return _mix(sums[bounds[1:]] - sums[bounds[:-1]] + np.diff(bounds).astype(np.uint64))


def bitmaps(values: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """A bitmap of each set: one bit a shingle, rounded up to a power of two (64 at least)."""
    out = []
    for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        size = max(64, 1 << max(e - s - 1, 0).bit_length())
        bits = np.zeros(size, np.uint8)
        bits[(values[s:e] & np.uint64(size - 1)).astype(np.int64)] = 1
        out.append(np.packbits(bits, bitorder="little").tobytes())
    return out


def _documents(rows: DataFrame, k: int) -> DataFrame:
    """``(doc_id, key, row, node, n, bits)`` of rows ``(doc_id, key, text, row)``; the node of an empty set is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_steps(batches, "text"):
            values, bounds = shingle_sets(b.column(2), k)
            n = np.diff(bounds)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(3), pa.array(node_keys(values, bounds).view(np.int64), mask=n == 0), pa.array(n),
                 pa.array(bitmaps(values, bounds), pa.binary())], ["doc_id", "key", "row", "node", "n", "bits"])

    return rows.mapInArrow(tidy(run), "doc_id long, key long, row long, node long, n long, bits binary")


# --- regions -------------------------------------------------------------------

def _frequent(rows: DataFrame, k: int) -> str:
    """A table in the shared folder of shingles held by several sampled texts, with the least holder's node."""
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chance = F.pmod(F.xxhash64("key", "doc_id", F.lit(11)), F.lit(1 << 30))
    sample = rows.where(chance < F.lit(int((1 << 30) * min(1.0, SAMPLE_BYTES / max(total, 1)))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_steps(batches, "text"):
            values, bounds = shingle_sets(b.column(2), k)
            yield pa.RecordBatch.from_arrays([to_int64(values), to_int64(np.repeat(node_keys(values, bounds), np.diff(bounds)))],
                                             ["shingle", "node"])

    folder = scratch_path(rows.sparkSession, "frequent-shingles")
    (sample.mapInArrow(tidy(run), "shingle long, node long").groupBy("shingle").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("pivot"))
     .where(F.col("n") >= FREQUENT).select("shingle", "pivot").write.parquet(folder))
    return folder


def _load(folder: str) -> tuple[np.ndarray, np.ndarray]:
    """The frequent shingles, sorted, and their pivots."""
    st = worker_state()
    if ("frequent", folder) not in st:
        import pyarrow.parquet as pq
        system, path = filesystem(folder)
        from pyarrow import fs
        tables = []
        for info in system.get_file_info(fs.FileSelector(path)):
            if info.path.endswith(".parquet"):
                with system.open_input_file(info.path) as f:
                    tables.append(pq.read_table(f))
        shingle = np.concatenate([t.column(0).to_numpy() for t in tables] or [np.zeros(0, np.int64)]).view(np.uint64)
        pivot = np.concatenate([t.column(1).to_numpy() for t in tables] or [np.zeros(0, np.int64)])
        order = np.argsort(shingle)
        for old in [key for key in st if isinstance(key, tuple) and key[0] == "frequent"]:
            del st[old]
        st[("frequent", folder)] = shingle[order], pivot[order]
    return st[("frequent", folder)]


def window_sizes(n: np.ndarray, percent: int) -> np.ndarray:
    """Shingles of which a partner holds one at least."""
    return n + (-percent * n // 100) + 1


def _windows(rows: DataFrame, k: int, percent: int, frequent: str) -> DataFrame:
    """``(shingle, hot, of, node)``: the windows of all sets; ``of`` is the pivot of a frequent shingle, and for another one
    the shingle before it in the window (the first one's is itself)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, pivots = _load(frequent)
        for b in text_steps(batches, "text"):
            values, bounds = shingle_sets(b.column(2), k)
            n = np.diff(bounds)
            row = np.repeat(np.arange(len(n)), n)
            at = np.minimum(np.searchsorted(hot, values), max(len(hot) - 1, 0))
            is_hot = hot[at] == values if len(hot) else np.zeros(len(values), bool)
            order = np.lexsort((values, is_hot, row))
            take = order[gather(bounds[:-1], np.where(n > 0, window_sizes(n, percent), 0))]
            nodes = node_keys(values, bounds)[row[take]].view(np.int64)
            h = is_hot[take]
            before = np.concatenate([take[:1], take[:-1]])
            before = np.where(row[before] == row[take], before, take)  # a window starts
            hot_rows = np.unique(np.stack([pivots[at[take[h]]], nodes[h]]), axis=1) if h.any() else np.zeros((2, 0), np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([values[take[~h]].view(np.int64), hot_rows[1]])),
                 pa.array(np.arange((~h).sum() + hot_rows.shape[1]) >= (~h).sum()),
                 pa.array(np.concatenate([values[before[~h]].view(np.int64), hot_rows[0]])),
                 pa.array(np.concatenate([nodes[~h], hot_rows[1]]))], ["shingle", "hot", "of", "node"])

    return rows.mapInArrow(tidy(run), "shingle long, hot boolean, of long, node long")


def _members(rows: DataFrame, k: int, percent: int) -> DataFrame:
    """``(pivot, node)``: which sets meet in which region; regions of one set are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [tuple(c.to_numpy(zero_copy_only=False) for c in b.columns) for b in batches]
        if not parts:
            return
        shingle, hot, of, node = (np.concatenate(c) for c in zip(*parts))
        if hot.any():
            yield pa.RecordBatch.from_arrays([pa.array(of[hot]), pa.array(node[hot])], ["pivot", "node"])
        shingle, of, node = shingle[~hot], of[~hot], node[~hot]
        order = np.lexsort((node, shingle))
        shingle, of, node = shingle[order], of[order], node[order]
        first = np.ones(len(shingle), bool)
        first[1:] = shingle[1:] != shingle[:-1]
        start = np.maximum.accumulate(np.where(first, np.arange(len(node)), 0))
        group = np.cumsum(first) - 1
        # a shingle's holders that all came from one other shingle have met there
        needed = np.zeros(len(shingle) and int(group[-1]) + 1, bool)
        needed[group[(of != of[start]) | (of == shingle)]] = True
        pivot = node[start]
        # a region's least set is a member too, once there is another
        other = (pivot != node) & needed[group]
        pairs = np.unique(np.stack([np.concatenate([pivot[other], pivot[other]]), np.concatenate([node[other], pivot[other]])]), axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["pivot", "node"])

    # frequent shingles, whose region is known, are dealt out by the set; only the others by the shingle
    dealt = _windows(rows, k, percent, _frequent(rows, k)).repartition("shingle")
    members = materialize(dealt.mapInArrow(tidy(run), "pivot long, node long").distinct(), "regions")
    sizes = materialize(members.groupBy("pivot").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > 1), "region-sizes")
    return members.join(sizes, "pivot")


# --- the join within a task -----------------------------------------------------

def _overlaps(sets: list[np.ndarray], others: list[np.ndarray]) -> np.ndarray:
    """Intersection sizes of all sets with all others."""
    ids, column = np.unique(np.concatenate(others), return_inverse=True)
    out = np.zeros((len(sets), len(others)), np.float32)
    values = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    at = np.minimum(np.searchsorted(ids, values), len(ids) - 1)
    hit = ids[at] == values
    at, row = at[hit], row[hit]
    orow = np.repeat(np.arange(len(others)), [len(s) for s in others])
    width = max(1, min(len(ids), (8 << 20) // (len(sets) + len(others))))
    order = np.argsort(at, kind="stable")
    at, row = at[order], row[order]
    corder = np.argsort(column, kind="stable")
    column, orow = column[corder], orow[corder]
    for c in range(0, len(ids), width):
        a, b = np.searchsorted(at, [c, c + width])
        if a == b:
            continue
        left, right = np.zeros((len(sets), width), np.float32), np.zeros((len(others), width), np.float32)
        left[row[a:b], at[a:b] - c] = 1
        p, q = np.searchsorted(column, [c, c + width])
        right[orow[p:q], column[p:q] - c] = 1
        out += left @ right.T
    return out


def _distances(sets: list[np.ndarray], others: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(distance, intersection, union)`` of all sets and all others."""
    inter = _overlaps(sets, others).astype(np.int64)
    union = np.array([len(s) for s in sets])[:, None] + np.array([len(s) for s in others])[None, :] - inter
    return 1 - inter / union, inter, union


def _link(linked: np.ndarray | None, union: Union, a: int, b: int) -> None:
    union.join(a, b)
    if linked is not None and a != b:
        linked[a, b] = linked[b, a] = True


def join_region(sets: list[np.ndarray], percent: int, union: Union, own: list[int] | None = None,
                linked: np.ndarray | None = None) -> None:
    """Connect all sets (by their numbers ``own``) that are linked, directly or through others; all links are marked in the
    matrix ``linked``, if there is one."""
    own = list(range(len(sets))) if own is None else own
    if len(own) < 2:
        return
    here = [sets[i] for i in own]
    if len(own) <= LEAF:
        _, inter, whole = _distances(here, here)
        for a, b in zip(*(x.tolist() for x in np.nonzero(np.triu(100 * inter >= percent * whole, 1)))):
            _link(linked, union, own[a], own[b])
        return
    eps = 1 - percent / 100
    step = len(own) / PIVOTS
    pivots = [int(i * step) for i in range(PIVOTS)]
    d, inter, whole = _distances(here, [here[p] for p in pivots])
    for a, b in zip(*(x.tolist() for x in np.nonzero(100 * inter >= percent * whole))):
        _link(linked, union, own[a], own[pivots[b]])
    if linked is None and len({union.root(i) for i in own}) == 1:
        return
    cells = d <= d.min(axis=1, keepdims=True) + 2 * eps + 1e-6
    if linked is not None and (cells.sum(axis=0) ** 2).sum() >= len(own) ** 2:  # cells with more pairs than there are
        return _join_blocks(sets, percent, union, own, linked)
    for q in range(PIVOTS):
        cell = [own[i] for i in np.flatnonzero(cells[:, q])]
        if len({union.root(i) for i in cell} if linked is None else cell) < 2:
            continue
        if len(cell) > SHRINK * len(own):
            _join_blocks(sets, percent, union, cell, linked)
        else:
            join_region(sets, percent, union, cell, linked)


def _join_blocks(sets: list[np.ndarray], percent: int, union: Union, own: list[int], linked: np.ndarray | None = None) -> None:
    """The exact join of a cell that pivots do not divide."""
    for i in range(0, len(own), LEAF):
        a = own[i:i + LEAF]
        for j in range(i, len(own), LEAF):
            b = own[j:j + LEAF]
            if linked is None and len({union.root(x) for x in a + b}) < 2:
                continue
            _, inter, whole = _distances([sets[x] for x in a], [sets[x] for x in b])
            for x, y in zip(*(z.tolist() for z in np.nonzero(100 * inter >= percent * whole))):
                if a[x] != b[y]:
                    _link(linked, union, a[x], b[y])


def count_links(sets: list[np.ndarray], times: np.ndarray, block: np.ndarray, home: np.ndarray, percent: int,
                union: Union) -> np.ndarray:
    """Connect all linked sets and count each one's links, ``times`` (rows of the other set) each; two sets of one block
    count where the block is at home."""
    linked = np.zeros((len(sets), len(sets)), bool)
    join_region(sets, percent, union, linked=linked)
    return (linked & ((block[:, None] != block[None, :]) | home[None, :])) @ times


def may_link(n: np.ndarray, bits: list[bytes], percent: int, union: Union) -> None:
    """Connect all sets whose sizes and bitmaps allow a link."""
    size = np.array([len(b) * 8 for b in bits])
    for s in np.unique(size).tolist():
        # partners have bitmaps as large or twice as large, which fold onto the smaller ones
        own = np.flatnonzero((size == s) | (size == 2 * s))
        if len(own) < 2:
            continue
        m = np.zeros((len(own), s // 64), np.uint64)
        for r, i in enumerate(own.tolist()):
            words = np.frombuffer(bits[i], np.uint64)
            m[r] = words if len(words) == s // 64 else words[:s // 64] | words[s // 64:]
        count, small = n[own], size[own] == s
        for r in range(len(own) - 1):
            apart = np.bitwise_count(m[r + 1:] ^ m[r]).sum(axis=1)
            # |x ^ y| <= (1 - t) / (1 + t) * (|x| + |y|)
            ok = (apart * (100 + percent) <= (100 - percent) * (count[r + 1:] + count[r])) & (small[r + 1:] | small[r])
            ok &= 100 * np.minimum(count[r + 1:], count[r]) >= percent * np.maximum(count[r + 1:], count[r])
            for x in np.flatnonzero(ok).tolist():
                union.join(int(own[r]), int(own[r + 1 + x]))


def _grouped(dealt: DataFrame, connect) -> DataFrame:
    """``(a, b, n)``: star links within each group of rows ``(group, i, j, node, ...)``, sorted by group.  ``connect(batch)``
    gives what is kept of each row; ``connect(None, kept, union)`` connects the rows of a group and may return the links
    of each node, which come out as ``n`` (also of the star's centre, where a = b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, nodes, held = None, [], []
        left: list[int] = []
        right: list[int] = []
        counts: list[int] = []

        def close() -> None:
            if len(nodes) > 1:
                union = Union(len(nodes))
                n = connect(None, held, union)
                n = [0] * len(nodes) if n is None else n.tolist()
                for i, r in enumerate(union.roots().tolist()):
                    if i != r or n[i]:
                        left.append(nodes[i])
                        right.append(nodes[r])
                        counts.append(n[i])

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (left, right, counts)], ["a", "b", "n"])

        for b in batches:
            for part, kept in connect(b):
                for r, (p, i, j, node) in enumerate(zip(*(part.column(c).to_pylist() for c in range(4)))):
                    if (p, i, j) != group:
                        close()
                        group, nodes, held = (p, i, j), [], []
                    if not nodes or nodes[-1] != node:
                        nodes.append(node)
                        held.append(kept[r])
            if left:
                yield rows()
                left, right, counts = [], [], []
        close()
        if left:
            yield rows()

    return dealt.mapInArrow(tidy(run), "a long, b long, n long")


def _dealt(members: DataFrame, group: str, *columns: str) -> DataFrame:
    """Rows by group; a group of more than ``BLOCK`` rows (column ``size``) meets block by block, every two blocks once.
    ``columns`` can name ``own``, the row's block, and ``home``, set in one of the tasks that the block goes to."""
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("node", F.lit(3)), F.col("blocks")).cast("int")
    return (members.withColumn("blocks", blocks).withColumn("own", own)
            .select(group, "node", *[c for c in columns if c not in ("own", "home")], "blocks", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
            .where((F.col("own") != F.col("other")) | (F.col("blocks") == 1))
            .withColumn("home", F.pmod(F.col("own") + 1, F.col("blocks")) == F.col("other"))
            .select(group, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", *columns)
            .repartition(group, "i", "j").sortWithinPartitions(group, "i", "j", "node"))


def _nearest(sets: DataFrame, percent: int, k: int) -> DataFrame:
    """``(cell, q, node, mine)``: the new cells of all sets, from rows ``(cell, part, q, node, mine, text)`` sorted by
    (cell, part, q), where ``q`` numbers the pivots of the cell and is ``CELLS`` in the rows of its sets.  In the result it
    is ``CELLS`` for the far cell."""
    eps, far, radius = 1 - percent / 100 + 1e-6, CELLS, RADIUS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, pivots = None, []
        for b in batches:
            for part in text_steps(iter([b]), "text"):
                values, bounds = shingle_sets(part.column(5), k)
                own = [values[s:e] for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
                cell, block, number = (part.column(c).to_pylist() for c in range(3))
                out = []
                start = 0
                while start < len(own):
                    if (cell[start], block[start]) != group:
                        group, pivots = (cell[start], block[start]), []
                    if number[start] < far:
                        pivots.append((number[start], own[start].copy()))
                        start += 1
                        continue
                    end = start
                    while end < len(own) and (cell[end], block[end]) == group:
                        end += 1
                    d = _distances(own[start:end], [p for _, p in pivots])[0]
                    least = d.min(axis=1)
                    home = np.where(least <= radius, d.argmin(axis=1), len(pivots))
                    there = np.column_stack([(d <= least[:, None] + 2 * eps) & (d <= radius + eps), least > radius - eps])
                    row, to = np.nonzero(there)
                    out.append((start + row, np.array([q for q, _ in pivots] + [far])[to], home[row] == to))
                    start = end
                if out:
                    row, q, at_home = (np.concatenate(c) for c in zip(*out))
                    mine = part.column(4).to_numpy(zero_copy_only=False)[row] & at_home
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(q.astype(np.int32)),
                                                      part.column(3).take(pa.array(row)), pa.array(mine)], ["cell", "q", "node", "mine"])

    return sets.mapInArrow(tidy(run), "cell string, q int, node long, mine boolean")


def voronoi_cells(classes: DataFrame, texts: DataFrame, percent: int, k: int) -> DataFrame:
    """``(cell, node, mine, size)``: the cells in which the sets of each class ``(class, node, size)`` are joined; ``mine`` where
    the set is at home.  ``texts``: ``(node, text)``.  A round of pivots divides all cells of more than ``BLOCK`` sets; only
    whether there are any comes back to the driver."""
    members = classes.select(F.col("class").cast("string").alias("cell"), "node", F.lit(True).alias("mine"), "size")
    done, members = members.where(F.col("size") <= BLOCK), members.where(F.col("size") > BLOCK)
    turn = 0
    while not members.isEmpty():
        turn += 1
        blocks = F.ceil(F.col("size") / BLOCK).cast("int")
        slot = F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(CELLS)).cast("int")
        pivots = (members.groupBy("cell", slot.alias("q"))
                  .agg(F.min(F.struct(F.xxhash64("node", F.lit(-turn)), "node")).alias("r"), F.any_value("size").alias("size"))
                  .select("cell", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("part"), "q", F.col("r.node").alias("node"),
                          F.lit(False).alias("mine")))
        own = members.select("cell", F.pmod(F.xxhash64("node", F.lit(5)), blocks).cast("int").alias("part"),
                             F.lit(CELLS).alias("q"), "node", "mine")
        dealt = (own.union(pivots).join(texts, "node").select("cell", "part", "q", "node", "mine", "text")
                 .repartition("cell", "part").sortWithinPartitions("cell", "part", "q"))
        found = materialize(_nearest(dealt, percent, k), "voronoi-cells")
        parents = members.groupBy("cell").agg(F.any_value("size").alias("whole"))
        sizes = (found.groupBy("cell", "q").agg(F.count(F.lit(1)).alias("size"), F.max("mine").alias("used"))
                 .join(parents, "cell").where("used"))
        # a cell is divided if that leaves fewer pairs than it has itself
        better = sizes.groupBy("cell").agg(F.sum(F.col("size") * F.col("size")).alias("pairs"), F.any_value("whole").alias("whole"))
        better = better.where(F.col("pairs") < F.col("whole") * F.col("whole")).select("cell")
        sizes = materialize(sizes.join(better, "cell", "left_semi")
                            .select("cell", "q", "size", (F.col("size") > F.col("whole") * SHRINK).alias("stuck")), "cell-sizes")
        whole = members.join(sizes.select("cell").distinct(), "cell", "left_anti")
        cells = materialize(found.join(sizes, ["cell", "q"]).select(F.concat_ws(".", "cell", "q").alias("cell"), "node", "mine", "size",
                                                                    (F.col("stuck") | (F.col("size") <= BLOCK)).alias("ready")), "cells")
        done = done.union(whole).union(cells.where("ready").drop("ready"))
        members = cells.where(~F.col("ready")).drop("ready")
    return done


def jaccard_links(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id",
                  text_col: str = "text", row_col: str | None = None, count: bool = False) -> tuple[DataFrame, DataFrame]:
    """``(rows, links)``: rows ``(doc_id, key, row, node, n, bits)`` (``row`` is ``row_col`` or null), and links ``(a, b, n)`` between nodes that connect exactly the
    nodes whose sets are linked, directly or through others.  With ``count``, the sum of ``n`` over the rows of ``a`` is the
    number of rows with another set that ``a`` is linked with."""
    rows = keyed(docs, id_col, text_col)
    row = (F.col(row_col) if row_col else F.lit(None)).cast("long").alias("row")
    placed = materialize(_documents(keyed(docs, id_col, text_col, row), k), "shingle-nodes")
    members = _members(rows, k, percent)
    holders = materialize(placed.where(F.col("node").isNotNull()).groupBy("node")
                          .agg(F.min(F.struct("doc_id", "key")).alias("r"), F.count(F.lit(1)).alias("times"),
                               F.any_value("n").alias("n"), F.any_value("bits").alias("bits")),
                          "shingle-sets")

    def by_bits(b, held=None, union=None):
        if b is None:
            return may_link(np.array([h[0] for h in held]), [h[1] for h in held], percent, union)
        return [(b, list(zip(b.column(4).to_pylist(), b.column(5).to_pylist())))]

    def by_sets(b, held=None, union=None):
        if b is None and count:
            sets, times, block, home, mine = zip(*held)
            return count_links(list(sets), np.array(times), np.array(block), np.array(home), percent, union) * np.array(mine)
        if b is None:
            return join_region([h[0] for h in held], percent, union)
        return _sets(b)

    def _sets(b):
        for part in text_steps(iter([b]), "text"):
            values, bounds = shingle_sets(part.column(4), k)
            more = (part.column(c).to_pylist() for c in (5, 6, 7, 8))
            yield part, [(values[s:e].copy(), *m) for s, e, *m in zip(bounds[:-1].tolist(), bounds[1:].tolist(), *more)]

    near = _dealt(members.join(holders.select("node", "n", "bits"), "node"), "pivot", "n", "bits")
    classes = materialize(components(_grouped(near, by_bits)).withColumnRenamed("root", "class"), "candidate-classes")
    sizes = materialize(classes.groupBy("class").agg(F.count(F.lit(1)).alias("size")), "candidate-sizes")
    classes = classes.join(sizes, "class")
    held_by = F.col("r.doc_id").alias("rid"), F.col("r.key").alias("rkey")

    def with_text(sets: DataFrame) -> DataFrame:
        """Sets (rows of a ``node``) with the text and the number of rows that hold it."""
        wanted = sets.join(holders.select("node", "r", "times"), "node").select(*held_by, *sets.columns, "times")
        return rows.join(wanted, F.col("doc_id").eqNullSafe(F.col("rid")) & (F.col("key") == F.col("rkey"))).select(*sets.columns, "times", "text")

    large = classes.where(F.col("size") > BLOCK)
    if large.isEmpty():
        cells = classes.select(F.col("class").alias("cell"), "node", F.lit(True).alias("mine"), "size")
    else:
        cells = voronoi_cells(classes, materialize(with_text(large.select("node")).select("node", "text").dropDuplicates(["node"]),
                                                   "texts-of-large-classes"), percent, k)
    dealt = _dealt(with_text(cells), "cell", "text", "times", "own", "home", "mine")
    return placed, materialize(_grouped(dealt, by_sets), "jaccard-links")


def _named(placed: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows with ``root``, a node of their class, null without shingles."""
    return placed.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def near_duplicates(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """``(doc_id, key, n_shingles, n_links, component_id)`` of every row; ``key`` tells rows of one id apart, ``n_links`` is the
    number of other rows that the row is linked with."""
    placed, links = jaccard_links(docs, k, percent, id_col, text_col, count=True)
    counts = links.groupBy("a").agg(F.sum("n").alias("others")).withColumnRenamed("a", "node")
    copies = placed.where(F.col("node").isNotNull()).groupBy("node").agg(F.count(F.lit(1)).alias("times"))
    counts = materialize(copies.join(counts, "node", "left")
                         .select("node", (F.coalesce("others", F.lit(0)) + F.col("times") - 1).alias("n_links")), "link-counts")
    named = materialize(_named(placed.join(counts, "node", "left"), components(links))
                        .select("doc_id", "key", "n", F.coalesce("n_links", F.lit(0)).alias("n_links"), "root"), "shingle-roots")
    least = materialize(named.where(F.col("root").isNotNull()).groupBy("root").agg(F.min("doc_id").alias("component_id")), "least-ids")
    return (named.join(least, "root", "left")
            .select("doc_id", "key", F.col("n").alias("n_shingles"), "n_links", F.coalesce("component_id", "doc_id").alias("component_id")))


def keep_first(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class, the one with the least id, columns as they are; rows without shingles stay."""
    # rows can be equal in all columns, so a written number tells them apart
    number, = unused_names(docs, "__row")
    numbered = materialize(docs.withColumn(number, F.monotonically_increasing_id()), "numbered-rows")
    placed, links = jaccard_links(numbered, k, percent, id_col, text_col, number)
    named = materialize(_named(placed, components(links)).select("doc_id", "key", "row", "root"), "shingle-roots")
    # by the root, as different classes can have the same least id, or none
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "key", "row")).alias("r")
    single = named.where(F.col("root").isNotNull()).groupBy("root").agg(first).select(F.col("r.row").alias(number))
    empty = named.where(F.col("root").isNull()).select(F.col("row").alias(number))
    return numbered.join(single.union(empty), number, "left_semi").drop(number)
