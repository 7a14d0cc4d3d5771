"""Second-order histogram boosting for many settings and folds at once.

The rows are binned once: a categorical column by its levels, a numeric one by cuts at its
quantiles.  All models of a search, one for each setting and fold, grow
level by level together: one pass over the binned rows sums the gradients and
hessians of every model, node, column and bin, the sums of all parts are added
model by model, and the best split of each node goes back to the rows.

Layout: a task keeps its rows for the whole training, ordered by their bins.  Rows of equal bins have
equal margins and nodes, so gradients are summed up by them once a tree and the levels work on those sums.

* Up to ``TABLE_ROWS`` rows every task has all of them (some bytes a row) and a group of the models.  Nothing is exchanged.  A search
  does so up to ``SEARCH_ROWS`` rows: its tasks are busy with models of their own, and none waits for another.
* More rows lie in parts.  The gradients of a tree are kept with the parts, and the parts of a group add their sums of every level: small
  ones on the driver, those of many or deep models by a shuffle.

Both ways call the same functions and give the same trees: gradients are whole multiples of
``2**-20``, so sums do not depend on the order, and rows and columns are drawn by hashes.

Objective as in the well-known gradient boosting libraries: gain
``GL²/(HL+1) + GR²/(HR+1) - G²/(H+1)``, leaf ``-step * G/(H+1)``, hessian of at least 1 on both sides,
start at margin 0 (``logistic``) or 0.5 (``squared``).  A null or unknown category is in no
level; a null number counts as lower than all others.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

#: Rows that one task may have; least rows of a part of more rows; bytes of a level's sums that are added on the driver.
TABLE_ROWS = 1 << 20
PART_ROWS = 65_536
DRIVER_BYTES = 1 << 20
#: Rows that one task of a search may have, and those whose gradients are worked out at a time, so that working arrays are small.
SEARCH_ROWS = 1 << 23
STEP_ROWS = 1 << 15
MAX_BINS = 64
MAX_LEVELS = 200
#: Combinations of the bins of neighbouring columns that are summed up together.
JOINT_BINS = 256
#: Trees between two checkpoints of the margins.
CHECKPOINT_TREES = 20
_UNIT = float(1 << 20)
_L2 = 1.0
_LEAST_HESSIAN = 1.0
_START = {"logistic": 0.0, "squared": 0.5}


@dataclass(frozen=True)
class Setting:
    """What a search varies: trees, their depth, step size, share of rows and of columns a tree sees."""
    trees: int = 300
    depth: int = 4
    step: float = 0.1
    rows: float = 0.8
    columns: float = 0.8
    seed: int = 42


# --- binning ------------------------------------------------------------------------

@dataclass
class Bins:
    """Bins of every column: ``levels`` of the categorical ones, ascending ``cuts`` of the numeric ones.  A split sends a row to the right
    if its category is the level, or its number at least the cut."""
    cats: list[str]
    nums: list[str]
    levels: list[list[str]]
    cuts: list[list[float]]
    sizes: list[int] = field(init=False)

    def __post_init__(self):
        self.sizes = [len(v) + 1 for v in self.levels] + [len(c) + 1 for c in self.cuts]

    @property
    def columns(self) -> list[str]:
        return [*self.cats, *self.nums]

    def candidates(self) -> tuple[np.ndarray, np.ndarray]:
        """``(column, cut)`` of every split there can be; a category's cut is its level."""
        column = np.concatenate([np.full(n - 1, i) for i, n in enumerate(self.sizes)] or [[]]).astype(np.int64)
        first = len(self.cats)
        cut = np.concatenate([np.arange(n - 1) + (i >= first) for i, n in enumerate(self.sizes)] or [[]]).astype(np.int64)
        return column, cut

    def names(self) -> list[str]:
        """Names of the candidates' features: a level of a category, or the numeric column."""
        return [f"{c}={v}" for c, vs in zip(self.cats, self.levels) for v in vs] + [c for c, k in zip(self.nums, self.cuts) for _ in k]

    def place(self, values: Sequence[pd.Series]) -> np.ndarray:
        """Bins of rows, one column each."""
        out = np.zeros((len(values[0]) if values else 0, len(self.sizes)), np.int64)
        for i, levels in enumerate(self.levels):
            got = pd.Index(levels).get_indexer(values[i].astype("object")) if len(levels) else np.full(len(out), -1)
            out[:, i] = np.where(got < 0, len(levels), got)
        for i, cuts in enumerate(self.cuts, len(self.levels)):
            x = pd.to_numeric(values[i]).to_numpy(np.float64)
            out[:, i] = np.where(np.isnan(x), 0, np.searchsorted(cuts, x, side="right"))
        return out


def fit_bins(df: DataFrame, cats: Sequence[str], nums: Sequence[str], max_bins: int = MAX_BINS) -> Bins:
    """Levels (the ``MAX_LEVELS`` most frequent of a column) and quantile cuts, each in one pass."""
    levels: list[list[str]] = [[] for _ in cats]
    if cats:
        pairs = F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).cast("string").alias("v")) for i, c in enumerate(cats)])
        counts = df.select(F.explode(pairs).alias("p")).where("p.v is not null").groupBy("p.i", "p.v").agg(F.count(F.lit(1)).alias("n"))
        first = F.row_number().over(Window.partitionBy("i").orderBy(F.desc("n"), "v"))
        for r in counts.withColumn("rank", first).where(F.col("rank") <= MAX_LEVELS).collect():
            levels[r["i"]].append(r["v"])
    cuts: list[list[float]] = [[] for _ in nums]
    if nums:
        probs = F.lit([k / max_bins for k in range(max_bins + 1)])
        x = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in nums}
        got = df.agg(*[F.percentile_approx(x[c], probs, 10_000).alias(f"q{i}") for i, c in enumerate(nums)]).first()
        cuts = [sorted(set(q or []))[1:] for q in got]
    return Bins(list(cats), list(nums), [sorted(v) for v in levels], cuts)


# --- one part of the rows and one group of models ---------------------------------------

@dataclass
class Models:
    """The models of a group: the setting and the held-out fold (-1: none) of each."""
    settings: list[Setting]
    fold: np.ndarray
    number: np.ndarray

    def active(self, tree: int) -> np.ndarray:
        return np.array([s.trees > tree for s in self.settings])

    def live(self, tree: int, level: int) -> np.ndarray:
        """The models that may split nodes of this level of this tree."""
        return np.flatnonzero([s.trees > tree and s.depth > max(level, 0) for s in self.settings])

    def depth(self) -> int:
        return max(s.depth for s in self.settings)


def distinct(bins: np.ndarray, *minor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(order, new bins, new)``: an order of rows by their bins, then by ``minor``, and where in it a row differs from the one before."""
    wide = np.zeros((len(bins), -(-max(bins.shape[1], 1) // 8) * 8), np.uint8)
    wide[:, :bins.shape[1]] = bins
    words = wide.view(np.uint64)
    order = np.lexsort((*minor[::-1], *words.T))
    other = lambda x: np.concatenate([[True], x[1:] != x[:-1]])[:len(order)]
    new_bins = np.logical_or.reduce([other(x[order]) for x in words.T])
    return order, new_bins, np.logical_or.reduce([new_bins, *(other(x[order]) for x in minor)])


@dataclass
class Part:
    """Rows ordered by bins, fold, label and weight; a cell is a run of rows equal in all of them, a pattern one of equal bins."""
    key: np.ndarray         # of every row
    cell_at: np.ndarray     # first row of every cell
    fold: np.ndarray        # of every cell
    y: np.ndarray
    w: np.ndarray
    pattern: np.ndarray
    pattern_at: np.ndarray  # first cell of every pattern
    bins: np.ndarray        # (columns, patterns), bytes

    @staticmethod
    def of(chunks: Iterable[tuple], n_columns: int) -> Part:
        """From chunks ``(bins, key, fold, y, w)`` of rows as bytes."""
        joined = [b"".join(x) for x in zip(*chunks)] or [b""] * 5
        bins, key, fold, y, w = (np.frombuffer(x, t) for x, t in zip(joined, (np.uint8, np.int64, np.int32, np.float64, np.float64)))
        bins = bins.reshape(len(y), n_columns)
        order, new_bins, new = distinct(bins, fold, y, w)
        cell_at, first = np.flatnonzero(new), new_bins[new]
        at = order[cell_at]
        return Part(key[order], cell_at, fold[at], y[at], w[at], np.cumsum(first) - 1, np.flatnonzero(first), np.ascontiguousarray(bins[at[first]].T))

    def cell_rows(self) -> np.ndarray:
        return np.diff(np.append(self.cell_at, len(self.key))).astype(np.float64)

    def steps(self) -> Iterator[tuple]:
        """``(rows, cells, patterns, first row of each cell, first cell of each pattern)`` of ``STEP_ROWS`` rows at a time; a cell or pattern
        may go on in the next step."""
        for start in range(0, len(self.key), STEP_ROWS):
            end = min(start + STEP_ROWS, len(self.key))
            c, d = int(np.searchsorted(self.cell_at, start, side="right")) - 1, int(np.searchsorted(self.cell_at, end))
            p, q = int(self.pattern[c]), int(self.pattern[d - 1]) + 1
            cell_at, pattern_at = self.cell_at[c:d] - start, self.pattern_at[p:q] - c
            cell_at[0], pattern_at[0] = max(cell_at[0], 0), max(pattern_at[0], 0)
            yield slice(start, end), slice(c, d), slice(p, q), cell_at, pattern_at


@dataclass
class Trees:
    """A tree of each model of a group, nodes in heap order; ``column`` is -1 in a leaf."""
    column: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    gain: np.ndarray
    cover: np.ndarray

    @staticmethod
    def empty(models: int, depth: int) -> Trees:
        n = 2 ** (depth + 1) - 1
        return Trees(np.full((models, n), -1, np.int16), np.zeros((models, n), np.int16), np.zeros((models, n)), np.zeros((models, n)), np.zeros((models, n)))


def _scrambled(key: np.ndarray, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = key.view(np.uint64) + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64))
        for shift, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x ^= x >> np.uint64(shift)
            x *= np.uint64(times)
        x ^= x >> np.uint64(31)
    return x


def _hash(key: np.ndarray, salt: int) -> np.ndarray:
    """Numbers from 0 to below 1."""
    return (_scrambled(key, salt) >> np.uint64(11)).astype(np.float64) / 9007199254740992.0


def _bound(share: float) -> np.uint64:
    """What scrambled keys are below where their :func:`_hash` is below ``share`` (less than 1)."""
    return np.uint64(math.ceil(max(share, 0.0) * 9007199254740992.0) << 11)


def _add(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of the runs that start at ``at``."""
    return x.astype(np.float64) if len(at) == len(x) else np.add.reduceat(x, at, dtype=np.float64)


def gradients(part: Part, margin: np.ndarray, models: Models, tree: int, loss: str) -> tuple[np.ndarray, np.ndarray]:
    """``(g, h)`` of every model and pattern, in units of ``2**-20``: sums over its rows without the model's fold and rows that are not drawn."""
    g, h = np.zeros(margin.shape), np.zeros(margin.shape)
    active = np.flatnonzero(models.active(tree))
    level = {j: 1.0 / (1.0 + np.exp(-margin[j])) if loss == "logistic" else margin[j] for j in active}
    for rows, cells, patterns, cell_at, pattern_at in part.steps():
        pattern, fold, y, w = part.pattern[cells], part.fold[cells], part.y[cells], part.w[cells]
        weighed = bool((w != 1.0).any())
        scrambled: dict[int, np.ndarray] = {}
        drawn: dict[tuple, np.ndarray] = {}
        kept: dict[tuple, tuple] = {}
        for j in active:
            s, out = models.settings[j], models.fold[j]
            draw = (s.seed, s.rows) if s.rows < 1.0 else ()
            if draw and s.seed not in scrambled:
                scrambled[s.seed] = _scrambled(part.key[rows], s.seed * 1_000_003 + tree)
            if draw not in drawn:
                drawn[draw] = (_add(scrambled[s.seed] < _bound(s.rows), cell_at) if draw
                               else np.diff(np.append(cell_at, rows.stop - rows.start)).astype(np.float64))
            if (draw, out) not in kept:
                n = drawn[draw] * (fold != out)
                kept[draw, out] = n, _add(np.rint(w * _UNIT) * n if weighed else _UNIT * n, pattern_at) if loss != "logistic" else None
            n, whole = kept[draw, out]
            x = level[j].take(pattern)
            if loss == "logistic":
                whole = _add(np.rint(x * (1.0 - x) * w * _UNIT) * n, pattern_at)
            h[j, patterns] += whole
            x -= y
            if weighed:
                x *= w
            x *= _UNIT
            np.rint(x, out=x)
            x *= n
            g[j, patterns] += _add(x, pattern_at)
    return g, h


def step_down(bins: np.ndarray, trees: Trees, node: np.ndarray, n_cats: int, models: Sequence[int]) -> None:
    """Move the patterns of some models to their next nodes; in a leaf they stay."""
    flat, places = bins.ravel(), np.arange(bins.shape[1])
    nodes, bin_ = np.arange(trees.column.shape[1])[:, None], np.arange(int(bins.max(initial=0)) + 1)[None, :]
    for j in models:
        column, cut = trees.column[j].astype(np.int64), trees.cut[j][:, None]
        if (column >= 0).any():
            right = np.where((column < n_cats)[:, None], bin_ == cut, bin_ >= cut)
            to = np.where((column >= 0)[:, None], 2 * nodes + 1 + right, nodes)  # by node and bin
            at = (np.maximum(column, 0) * bins.shape[1])[node[j]]
            at += places
            next_ = node[j] * to.shape[1]
            next_ += flat[at]
            node[j] = to.ravel()[next_]


def joint_columns(sizes: Sequence[int]) -> list[list[int]]:
    """Runs of columns with up to ``JOINT_BINS`` combinations of their bins (one column at least)."""
    out: list[list[int]] = []
    for c, n in enumerate(sizes):
        if out and math.prod(sizes[k] for k in out[-1]) * n <= JOINT_BINS:
            out[-1].append(c)
        else:
            out.append([c])
    return out


def joint_bins(bins: np.ndarray, sizes: Sequence[int]) -> list[np.ndarray]:
    """The combination of bins of every pattern in each run of :func:`joint_columns`."""
    out = []
    for run in joint_columns(sizes):
        joint = bins[run[0]].astype(np.int64)
        for c in run[1:]:
            joint *= sizes[c]
            joint += bins[c]
        out.append(joint)
    return out


def histograms(joint: Sequence[np.ndarray], node: np.ndarray, level: int, g: np.ndarray, h: np.ndarray, sizes: list[int], live: Sequence[int]) -> np.ndarray:
    """Sums of ``g`` and ``h`` of the nodes of a level: ``(live models, nodes, bins of all columns, 2)``, from :func:`joint_bins`."""
    first, width = 2 ** level - 1, 2 ** level
    out = np.zeros((len(live), width, sum(sizes), 2))
    runs = []
    for run in joint_columns(sizes):
        n = math.prod(sizes[c] for c in run)
        each = np.unravel_index(np.arange(n), [sizes[c] for c in run])
        # which combinations a bin has: sums of whole units stay exact
        runs.append((n, np.concatenate([each[i][:, None] == np.arange(sizes[c]) for i, c in enumerate(run)], axis=1).astype(np.float64)))
    for i, j in enumerate(live):
        here = node[j] >= first
        rows = slice(None) if here.all() else np.flatnonzero(here)
        place, weights = node[j][rows] - first, (g[j][rows], h[j][rows])
        at = 0
        for b, (n, has) in zip(joint, runs):
            index = b[rows] + place * n if level else b[rows]
            for k in (0, 1):
                out[i, :, at:at + has.shape[1], k] = np.bincount(index, weights[k], minlength=width * n).reshape(width, n) @ has
            at += has.shape[1]
    return out


def best_splits(hist: np.ndarray, bins: Bins, allowed: np.ndarray) -> tuple[np.ndarray, ...]:
    """``(gain, candidate, left sums, sums)`` of every model's nodes from their histograms; ``allowed`` marks the candidates a model's tree may use."""
    first = bins.sizes[0] if bins.sizes else 0
    sums = hist[:, :, :first].sum(axis=2) / _UNIT  # the bins of one column hold all rows
    left, at = [], 0
    for c, n in enumerate(bins.sizes):
        part = hist[:, :, at:at + n] / _UNIT
        left.append(sums[:, :, None] - part[:, :, :-1] if c < len(bins.cats) else np.cumsum(part, axis=2)[:, :, :-1])
        at += n
    left = np.concatenate(left, axis=2)
    right = sums[:, :, None] - left
    score = lambda s: s[..., 0] ** 2 / (s[..., 1] + _L2)
    gain = score(left) + score(right) - score(sums)[:, :, None]
    fits = (left[..., 1] >= _LEAST_HESSIAN) & (right[..., 1] >= _LEAST_HESSIAN) & allowed[:, None, :]
    gain = np.where(fits, gain, -np.inf)
    if not gain.shape[2]:
        return np.full(gain.shape[:2], -np.inf), np.zeros(gain.shape[:2], np.int64), sums, sums
    best = gain.argmax(axis=2)
    pick = np.take_along_axis(left, best[:, :, None, None], axis=2)[:, :, 0]
    return np.take_along_axis(gain, best[:, :, None], axis=2)[:, :, 0], best, pick, sums


def grow(trees: Trees, level: int, found: tuple[np.ndarray, ...], bins: Bins, models: Models, live: np.ndarray) -> bool:
    """Put the best splits of a level of the live models into the trees; whether any node was split."""
    gain, best, left, sums = found
    column, cut = bins.candidates()
    step = np.array([models.settings[j].step for j in live])
    value = lambda s: -step[:, None] * s[..., 0] / (s[..., 1] + _L2)
    at = slice(2 ** level - 1, 2 ** (level + 1) - 1)
    if level == 0:
        trees.value[live, at], trees.cover[live, at] = value(sums), sums[..., 1]
    m, i = np.nonzero(gain > 1e-9)
    node = 2 ** level - 1 + i
    trees.column[live[m], node], trees.cut[live[m], node], trees.gain[live[m], node] = column[best[m, i]], cut[best[m, i]], gain[m, i]
    for child, s in ((2 * node + 1, left), (2 * node + 2, sums - left)):
        trees.value[live[m], child], trees.cover[live[m], child] = value(s)[m, i], s[m, i, 1]
    return bool(len(m))


def allowed_columns(bins: Bins, models: Models, tree: int) -> np.ndarray:
    """Candidates that each model's tree may use: levels of a category and numeric columns are drawn one by one."""
    column, cut = bins.candidates()
    slot = np.where(column < len(bins.cats), column * 1000 + cut, column * 1000)
    slots = np.unique(slot)
    out = np.zeros((len(models.settings), len(column)), bool)
    for j, s in enumerate(models.settings):
        keep = max(1, int(s.columns * len(slots)))
        order = np.argsort(_hash(slots.astype(np.int64) + 7, s.seed * 2_000_003 + tree), kind="stable")
        out[j] = np.isin(slot, slots[order[:keep]])
    return out


def _train_here(part: Part, bins: Bins, models: Models, loss: str, keep: bool) -> tuple[np.ndarray, list[Trees]]:
    """``(margins, trees)`` of a group whose rows lie in this part alone.  Trees are kept where asked for."""
    margin, out = np.full((len(models.settings), part.bins.shape[1]), _START[loss]), []
    places, joint = part.bins.astype(np.int64), joint_bins(part.bins, bins.sizes)
    for t in range(max(s.trees for s in models.settings)):
        trees = Trees.empty(len(models.settings), models.depth())
        g, h = gradients(part, margin, models, t, loss)
        allowed = allowed_columns(bins, models, t)
        node = np.zeros(margin.shape, np.int64)
        for level in range(models.depth()):
            live = models.live(t, level)
            found = best_splits(histograms(joint, node, level, g, h, bins.sizes, live), bins, allowed[live])
            if not grow(trees, level, found, bins, models, live):
                break
            step_down(places, trees, node, len(bins.cats), live)
        _move(margin, trees, models, t, node)
        if keep:
            out.append(trees)
    return margin, out


def _move(margin: np.ndarray, trees: Trees, models: Models, tree: int, node: np.ndarray) -> None:
    for j in np.flatnonzero(models.active(tree)):
        margin[j] += trees.value[j][node[j]]


def _nodes(bins: np.ndarray, trees: Trees, levels: int, n_cats: int) -> np.ndarray:
    node = np.zeros((len(trees.column), bins.shape[1]), np.int64)
    for _ in range(levels):
        step_down(bins, trees, node, n_cats, range(len(node)))
    return node


def _judged(part: Part, margin: np.ndarray, models: Models, loss: str) -> list[tuple[int, np.ndarray]]:
    """Sums over each model's held-out rows (all rows, where none are): true, false and missed positives, or the absolute errors and the rows."""
    out, rows = [], part.cell_rows()
    for j, (fold, number) in enumerate(zip(models.fold, models.number)):
        n = rows * (part.fold == fold) if fold >= 0 else rows
        y, m = part.y, margin[j][part.pattern]
        if loss == "logistic":
            out.append((int(number), np.array([n[(m > 0) & (y == 1)].sum(), n[(m > 0) & (y != 1)].sum(), n[(m <= 0) & (y == 1)].sum()])))
        else:
            out.append((int(number), np.array([(np.abs(y - m) * n).sum(), n.sum()])))
    return out


# --- the cluster ---------------------------------------------------------------------------

def _packed(df: DataFrame, bins: Bins, label: str, key: Column, weight: Column, fold: Column, parts: int) -> DataFrame:
    """Chunks of binned rows as arrays; the key of a row says in which part it lies."""
    rows = df.select(key.alias("_key"), fold.cast("int").alias("_fold"), F.col(label).cast("double").alias("_y"), weight.cast("double").alias("_w"),
                     *[F.col(c).cast("string").alias(f"_c{i}") for i, c in enumerate(bins.cats)],
                     *[F.col(c).cast("double").alias(f"_n{i}") for i, c in enumerate(bins.nums)])
    rows = rows.where(F.col("_y").isNotNull())

    def chunks(got: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(got)
        values = [t.column(c).to_pandas() for c in t.column_names[4:]]
        arrays = [bins.place(values).astype(np.uint8), *(t.column(c).to_numpy() for c in ("_key", "_fold", "_y", "_w"))]
        part = arrays[1].view(np.uint64) % np.uint64(parts)
        for p in np.unique(part):
            here = [x[part == p] for x in arrays]
            yield pa.RecordBatch.from_arrays([pa.array([int(p)], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in here)], ["part", "bins", "key", "fold", "y", "w"])

    def run(batches):
        got: list[pa.RecordBatch] = []
        for b in batches:
            got += [b] if b.num_rows else []
            if sum(x.num_rows for x in got) >= PART_ROWS:
                yield from chunks(got)
                got = []
        if got:
            yield from chunks(got)

    return rows.mapInArrow(run, "part int, bins binary, key binary, fold binary, y binary, w binary")


@dataclass
class Search:
    """The models' trees, where they were asked for, and each model's sums over its held-out rows (see :func:`_judged`)."""
    groups: list[Models]
    bins: Bins
    loss: str
    trees: list[list[Trees]]
    judged: dict[int, tuple[float, ...]]


def _dealt(models: list[tuple], groups: int) -> list[Models]:
    """The models in groups of about equal work: the long ones first, each to the group with the least."""
    dealt: list[list] = [[] for _ in range(groups)]
    work = [0] * groups
    for m in sorted(models, key=lambda m: (-m[0].trees * m[0].depth, m[2])):
        g = work.index(min(work))
        work[g] += m[0].trees * m[0].depth
        dealt[g].append(m)
    return [Models([m[0] for m in d], np.array([m[1] for m in d]), np.array([m[2] for m in d])) for d in dealt]


def train(df: DataFrame, bins: Bins, label: str, id_col: str, settings: Sequence[Setting], loss: str, folds: int = 0, fold_col: str = "fold",
          weight_col: str | None = None, part_rows: int | None = None, keep: bool = True) -> Search:
    """Train a model for every setting and fold (``folds`` 0: one for every setting, on all rows).  Model ``setting * folds + fold`` is
    held out of the rows whose ``fold_col`` is its fold.  Rows without a label take no part.  Trees are returned if ``keep`` is set;
    more than ``part_rows`` rows are divided into parts of that size."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    sc = spark.sparkContext
    key = F.xxhash64(F.col(id_col).cast("string"))
    weight = F.col(weight_col) if weight_col else F.lit(1.0)
    fold = F.col(fold_col) if folds else F.lit(-2)
    n, slots = df.count(), sc.defaultParallelism
    models = [(s, k, i * max(folds, 1) + max(k, 0)) for i, s in enumerate(settings) for k in (range(folds) if folds else [-1])]
    n_columns, n_cats = len(bins.sizes), len(bins.cats)

    if part_rows is not None:
        parts = max(1, math.ceil(n / part_rows))
    elif n <= (SEARCH_ROWS if folds else TABLE_ROWS):
        parts = 1
    else:
        parts = max(min(slots, math.ceil(n / PART_ROWS)), math.ceil(n / TABLE_ROWS))
    groups = _dealt(models, min(len(models), max(1, math.ceil(slots / parts))))
    n_groups = len(groups)

    packed = _packed(df, bins, label, key, weight, fold, parts)
    chunks = packed.rdd.flatMap(lambda r: [(r[0] * n_groups + g, tuple(r[1:])) for g in range(n_groups)]).partitionBy(parts * n_groups, int)

    def here(index: int, items):
        part = Part.of((c for _, c in items), n_columns)
        margin, trees = _train_here(part, bins, groups[index], loss, keep)
        yield trees, _judged(part, margin, groups[index], loss)

    if parts == 1:
        done = chunks.mapPartitionsWithIndex(here).collect()  # trees and sums, bounded by the settings
        return Search(groups, bins, loss, [trees for trees, _ in done], {k: tuple(v.tolist()) for _, sums in done for k, v in sums})

    def unpack(index: int, items):
        part = Part.of((c for _, c in items), n_columns)
        yield index, part, np.full((len(groups[index % n_groups].settings), part.bins.shape[1]), _START[loss])

    def opened(t: int):
        def run(item):
            index, part, margin = item
            return index, part.bins, *gradients(part, margin, groups[index % n_groups], t, loss)
        return run

    def summed(trees: list[Trees], t: int, level: int):
        def run(item):
            index, places, g, h = item
            group = index % n_groups
            live = groups[group].live(t, level)
            if not len(live):
                return []
            hist = histograms(joint_bins(places, bins.sizes), _nodes(places, trees[group], level, n_cats), level, g, h, bins.sizes, live)
            return [((group, int(j)), hist[i]) for i, j in enumerate(live)]
        return run

    def split(t: int):
        def run(item):
            (g, j), hist = item
            one = Models([groups[g].settings[j]], groups[g].fold[j:j + 1], groups[g].number[j:j + 1])
            return (g, j), [x[0] for x in best_splits(hist[None], bins, allowed_columns(bins, one, t))]
        return run

    def moved(trees: list[Trees], t: int):
        def run(item):
            index, part, margin = item
            g, margin = index % n_groups, margin.copy()
            _move(margin, trees[g], groups[g], t, _nodes(part.bins, trees[g], groups[g].depth(), n_cats))
            return index, part, margin
        return run

    def best(grads, trees: list[Trees], t: int, level: int) -> dict:
        """The best splits of a level of every model: sums of the parts meet on the driver if they are small, else a model's in one task."""
        sums = grads.flatMap(summed(trees, t, level))
        if parts * len(models) * 2 ** level * sum(bins.sizes) * 16 > DRIVER_BYTES:
            return dict(sums.reduceByKey(np.add, len(models)).map(split(t)).collect())
        total: dict = {}
        for k, hist in sums.collect():
            total[k] = total[k] + hist if k in total else hist
        return dict(map(split(t), total.items()))

    state = chunks.mapPartitionsWithIndex(unpack).persist(StorageLevel.MEMORY_AND_DISK)
    grown: list[list[Trees]] = [[] for _ in groups]
    held = [state]
    for t in range(max(s.trees for s in settings)):
        trees = [Trees.empty(len(m.settings), m.depth()) for m in groups]
        grads = state.map(opened(t)).persist(StorageLevel.MEMORY_AND_DISK)
        for level in range(max(m.depth() for m in groups)):
            found, went_on = best(grads, trees, t, level), False
            for g, m in enumerate(groups):
                live = m.live(t, level)
                if len(live):
                    went_on |= grow(trees[g], level, tuple(np.stack(x) for x in zip(*[found[g, int(j)] for j in live])), bins, m, live)
            if not went_on:
                break
        grads.unpersist()
        for g in range(n_groups if keep else 0):
            grown[g].append(trees[g])
        state = state.map(moved(trees, t)).persist(StorageLevel.MEMORY_AND_DISK)
        held.append(state)
        if (t + 1) % CHECKPOINT_TREES == 0:
            state.checkpoint()
            state.count()
        if len(held) > 2:  # the latest one is made from the one before
            held.pop(0).unpersist()
    sums = state.flatMap(lambda item: _judged(item[1], item[2], groups[item[0] % n_groups], loss)).reduceByKey(np.add).collect()
    for old in held:
        old.unpersist()
    return Search(groups, bins, loss, grown, {k: tuple(v.tolist()) for k, v in sums})


# --- one fitted model ------------------------------------------------------------------------

@dataclass
class BoostedModel:
    """Trees of one model, nodes in heap order: ``column``, ``cut``, ``value`` and ``cover`` by tree and node."""
    bins: Bins
    loss: str
    column: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    cover: np.ndarray

    def margins(self, values: Sequence[pd.Series]) -> np.ndarray:
        """Margins of rows; rows of equal bins go through the trees once."""
        bins = self.bins.place(values)
        order, new, _ = distinct(bins)
        rows = bins[order[new]]
        out = np.full(len(rows), _START[self.loss])
        depth = int(math.log2(self.column.shape[1] + 1)) - 1
        first = np.arange(len(self.column))[None, :] * self.column.shape[1]
        column, cut, value = self.column.reshape(-1).astype(np.int64), self.cut.reshape(-1), self.value.reshape(-1)
        category, leaf, column = column < len(self.bins.cats), column < 0, np.maximum(column, 0)
        for at in range(0, len(out), 1024):
            part = rows[at:at + 1024]
            flat, row = part.reshape(-1), np.arange(len(part))[:, None] * part.shape[1]
            node = np.zeros((len(part), len(self.column)), np.int64)
            for _ in range(depth):
                i = node + first
                b, c = flat.take(row + column.take(i)), cut.take(i)
                node = np.where(leaf.take(i), node, 2 * node + 1 + np.where(category.take(i), b == c, b >= c))
            out[at:at + 1024] += value.take(node + first).sum(axis=1)
        got = np.empty(len(bins))
        got[order] = out[np.cumsum(new) - 1]
        return got

    def score(self) -> Column:
        """The probability of class 1 (``logistic``) or the prediction (``squared``), as a column of the model's input columns."""
        model = self
        logistic = self.loss == "logistic"

        @F.pandas_udf("double")
        def run(*values: pd.Series) -> pd.Series:
            x = model.margins(values)
            return pd.Series(1.0 / (1.0 + np.exp(-x)) if logistic else x)

        return run(*[F.col(c).cast("string") for c in self.bins.cats], *[F.col(c).cast("double") for c in self.bins.nums])

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with ``prediction``, and for classes ``p1``, the probability of class 1."""
        if self.loss != "logistic":
            return df.withColumn("prediction", self.score())
        return df.withColumn("p1", self.score()).withColumn("prediction", (F.col("p1") > 0.5).cast("double"))

    def save(self, spark: SparkSession, path: str) -> None:
        """The model as a table of its nodes and one of its bins."""
        n = self.column.shape
        tree, node = np.divmod(np.arange(self.column.size), n[1])
        pdf = pd.DataFrame({"tree": tree, "node": node, "column": self.column.reshape(-1).astype(int), "cut": self.cut.reshape(-1).astype(int),
                            "value": self.value.reshape(-1), "cover": self.cover.reshape(-1)})
        spark.createDataFrame(pdf).write.mode("overwrite").parquet(f"{path}/nodes")
        bins = asdict(self.bins)
        bins.pop("sizes")
        spark.createDataFrame([(json.dumps(bins), self.loss)], "bins string, loss string").write.mode("overwrite").parquet(f"{path}/bins")

    @staticmethod
    def load(spark: SparkSession, path: str) -> BoostedModel:
        head = spark.read.parquet(f"{path}/bins").first()
        pdf = spark.read.parquet(f"{path}/nodes").orderBy("tree", "node").toPandas()
        shape = (-1, int(pdf["node"].max()) + 1)
        take = lambda c, t: pdf[c].to_numpy(t).reshape(shape)
        return BoostedModel(Bins(**json.loads(head["bins"])), head["loss"], take("column", np.int16), take("cut", np.int16), take("value", float), take("cover", float))


def fit(df: DataFrame, cats: Sequence[str], nums: Sequence[str], label: str, id_col: str, setting: Setting, loss: str,
        weight_col: str | None = None, max_bins: int = MAX_BINS, part_rows: int | None = None) -> BoostedModel:
    """One model on all rows."""
    bins = fit_bins(df, cats, nums, max_bins)
    trees = train(df, bins, label, id_col, [setting], loss, weight_col=weight_col, part_rows=part_rows).trees[0]
    if not trees:
        trees = [Trees.empty(1, setting.depth)]
    return BoostedModel(bins, loss, *[np.stack([getattr(t, c)[0] for t in trees]) for c in ("column", "cut", "value", "cover")])


def search(df: DataFrame, cats: Sequence[str], nums: Sequence[str], label: str, id_col: str, settings: Sequence[Setting], loss: str, folds: int,
           fold_col: str = "fold", weight_col: str | None = None, part_rows: int | None = None) -> list[list[float]]:
    """Each setting's metric on each fold, by a model that has not seen the fold: F1 of class 1 (``logistic``) or the mean absolute error (``squared``)."""
    found = train(df, fit_bins(df, cats, nums), label, id_col, settings, loss, folds, fold_col, weight_col, part_rows, keep=False).judged
    out = []
    for i in range(len(settings)):
        sums = [found.get(i * folds + k) for k in range(folds)]
        if loss == "logistic":
            out.append([2 * s[0] / (2 * s[0] + s[1] + s[2]) if s and sum(s) else 0.0 for s in sums])
        else:
            out.append([s[0] / s[1] for s in sums if s and s[1]])
    return out
