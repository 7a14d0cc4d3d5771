"""Top drivers of a tree model by mean absolute contribution.

Per-row feature contributions are the path-dependent tree Shapley values (Lundberg,
Erion & Lee, 2018).  A contribution of a leaf depends on the row only through, for each feature on the
path to that leaf, whether the row satisfies *all* of that feature's conditions there.  Executors
evaluate the split conditions with numpy on Arrow batches, work out the contributions of the patterns that a batch
holds, in closed form, and emit sums, aggregated by Spark.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import BoostedModel, distinct


@dataclass
class Node:
    feature: int = -1          # -1 = leaf
    threshold: float = 0.0     # continuous split: left when x <= threshold
    left_cats: tuple = ()      # categorical split: left when x in left_cats
    categorical: bool = False
    left: int = -1
    right: int = -1
    cover: float = 0.0
    value: float = 0.0


def _java_tree_nodes(root, leaf_value) -> list[Node]:
    """Flatten a Spark ``Node`` (via the JVM gateway) into a list; the model
    is small (bounded by depth), the data never passes here."""
    nodes: list[Node] = []

    def walk(j):
        idx = len(nodes)
        nodes.append(Node())
        stats = j.impurityStats()
        cover = float(stats.count())
        if j.getClass().getSimpleName() == "InternalNode":
            split = j.split()
            n = nodes[idx]
            n.feature = int(split.featureIndex())
            n.cover = cover
            if split.getClass().getSimpleName() == "ContinuousSplit":
                n.threshold = float(split.threshold())
            else:
                n.categorical = True
                n.left_cats = tuple(float(v) for v in split.leftCategories())
            n.left = walk(j.leftChild())
            n.right = walk(j.rightChild())
        else:
            nodes[idx] = Node(cover=cover, value=leaf_value(j))
        return idx

    walk(root)
    return nodes


def trees_of(model) -> list[tuple[list[Node], float]]:
    """``(nodes, weight)`` per tree for GBT ensembles (raw margin, regression
    leaves) and single trees (class-1 probability for classifiers)."""
    def reg_value(j):
        return float(j.prediction())

    def class1_value(j):
        s = list(j.impurityStats().stats())
        tot = sum(s)
        return float(s[1] / tot) if tot > 0 and len(s) > 1 else 0.0

    name = model.__class__.__name__
    if name in ("GBTClassificationModel", "GBTRegressionModel", "RandomForestRegressionModel"):
        weights = list(model.treeWeights)
        return [(_java_tree_nodes(t._java_obj.rootNode(), reg_value), float(w))
                for t, w in zip(model.trees, weights)]
    if name == "DecisionTreeClassificationModel":
        return [(_java_tree_nodes(model._java_obj.rootNode(), class1_value), 1.0)]
    return [(_java_tree_nodes(model._java_obj.rootNode(), reg_value), 1.0)]


# --- contributions of one leaf, by pattern of satisfied features ------------------

@dataclass
class Leaf:
    """The path to a leaf: its features, the conditions on each, and for each feature the share of the
    training rows that pass its conditions (product of the cover fractions)."""
    features: list[int]
    conditions: list[tuple]             # (feature, node, goes_left)
    shares: np.ndarray
    value: float


def _leaves(nodes: list[Node]) -> list[Leaf]:
    out: list[Leaf] = []

    def walk(j: int, conditions: list[tuple], shares: dict[int, float]) -> None:
        n = nodes[j]
        if n.feature < 0:
            out.append(Leaf(list(shares), conditions, np.array(list(shares.values())), n.value))
            return
        for child, goes_left in ((n.left, True), (n.right, False)):
            share = nodes[child].cover / n.cover if n.cover > 0 else 0.0
            walk(child, [*conditions, (n.feature, j, goes_left)], {**shares, n.feature: shares.get(n.feature, 1.0) * share})

    walk(0, [], {})
    return out


def leaf_contributions(leaf: Leaf, patterns: np.ndarray) -> np.ndarray:
    """Contributions ``[patterns, features]`` of a leaf, where bit k of a pattern says whether the row satisfies all conditions on feature k.
    With shares z and satisfied flags o, feature i gets ``value * (o_i - z_i) * sum_s c_s s! (u - 1 - s)! / u!``, where
    ``c_s`` are the coefficients of the product of ``z_j + o_j x`` over the other features j."""
    u = len(leaf.features)
    o = (patterns[:, None] >> np.arange(u) & 1).astype(float)
    weight = np.array([math.factorial(s) * math.factorial(u - 1 - s) / math.factorial(u) for s in range(u)])
    out = np.zeros((len(patterns), u))
    for i in range(u):
        c = np.zeros((len(patterns), u))
        c[:, 0] = 1.0
        for j in range(u):
            if j != i:
                c[:, 1:] = leaf.shares[j] * c[:, 1:] + o[:, j, None] * c[:, :-1]
                c[:, 0] *= leaf.shares[j]
        out[:, i] = leaf.value * (o[:, i] - leaf.shares[i]) * (c @ weight)
    return out


def expected_value(trees: list[tuple[list[Node], float]]) -> float:
    """Base value: cover-weighted mean leaf value, summed over weighted trees."""
    total = 0.0
    for nodes, w in trees:
        root = nodes[0].cover
        total += w * sum(n.cover / root * n.value for n in nodes if n.feature < 0 and root > 0)
    return total


def _satisfies(x: np.ndarray, n: Node, goes_left: bool) -> np.ndarray:
    col = x[:, n.feature]
    left = np.isin(col, n.left_cats) if n.categorical else col <= n.threshold
    return left if goes_left else ~left


def _outcomes(x: np.ndarray, nodes: list[Node]) -> tuple[np.ndarray, np.ndarray] | None:
    """``(first, which)``: rows that between them show every combination of outcomes of a tree's tests, and for each row the one like it.
    None for trees of very many tests."""
    tests = [n for n in nodes if n.feature >= 0]
    if len(tests) > 62 or not len(x):
        return None
    code = np.zeros(len(x), np.int64)
    for k, n in enumerate(tests):
        code |= _satisfies(x, n, True).astype(np.int64) << k
    if len(tests) > 16:
        _, first, which = np.unique(code, return_index=True, return_inverse=True)
        return first, which
    first = np.full(1 << len(tests), -1)
    first[code[::-1]] = np.arange(len(x))[::-1]
    held = np.flatnonzero(first >= 0)
    place = np.zeros(len(first), np.int64)
    place[held] = np.arange(len(held))
    return first[held], place[code]


def contributions_numpy(x: np.ndarray, compiled) -> np.ndarray:
    """Contributions [rows, features] of a batch of feature rows; of each tree, only the combinations of outcomes that the batch holds are worked out."""
    phi = np.zeros(x.shape[::-1])
    x = np.asfortranarray(x)  # the tests read columns
    for nodes, weight, leaves in compiled:
        seen = _outcomes(x, nodes)
        part = _tree_contributions(x if seen is None else x[seen[0]], nodes, leaves)
        for f, values in part.items():
            phi[f] += weight * (values if seen is None else values[seen[1]])
    return np.ascontiguousarray(phi.T)


def _tree_contributions(x: np.ndarray, nodes: list[Node], leaves: list[Leaf]) -> dict[int, np.ndarray]:
    """Contributions of every feature that a tree tests; of each leaf, only the patterns that the rows hold are worked out."""
    phi: dict[int, np.ndarray] = {}
    passes: dict[tuple, np.ndarray] = {}
    for leaf in leaves:
        if not leaf.features:
            continue
        sat = {f: None for f in leaf.features}
        for f, j, left in leaf.conditions:
            if (j, left) not in passes:
                passes[j, left] = _satisfies(x, nodes[j], left)
            sat[f] = passes[j, left] if sat[f] is None else sat[f] & passes[j, left]
        pattern = np.zeros(len(x), dtype=np.int64)
        for k, f in enumerate(leaf.features):
            pattern |= sat[f].astype(np.int64) << k
        held = np.flatnonzero(np.bincount(pattern, minlength=1))
        place = np.zeros(held[-1] + 1 if len(held) else 0, np.int64)
        place[held] = np.arange(len(held))
        values = leaf_contributions(leaf, held)[place[pattern]]          # [rows, u]
        for k, f in enumerate(leaf.features):
            phi[f] = phi[f] + values[:, k] if f in phi else values[:, k]
    return phi


def compile_trees(trees):
    return [(nodes, w, _leaves(nodes)) for nodes, w in trees]


def contributions(df: DataFrame, model, feature_names: Sequence[str], features_col: str = "features",
                  key: str | None = None) -> DataFrame:
    """Long table ``(key?, feature, contribution)`` of per-row contributions.
    The compiled tree tables (a few KB per tree) ride in the task closure."""
    compiled = compile_trees(trees_of(model))
    names = list(feature_names)
    cols = ([key] if key else []) + ["_x"]
    src = df.select(*([F.col(key)] if key else []), vector_to_array(features_col).alias("_x"))
    schema = (f"{key} long, " if key else "") + "feature string, contribution double"

    def run(batches):
        for pdf in batches:
            if pdf.empty:
                continue
            x = np.vstack(pdf["_x"].to_numpy())
            phi = contributions_numpy(x, compiled)
            out = pd.DataFrame({"feature": np.tile(np.array(names[:x.shape[1]], dtype=object), len(x)),
                                "contribution": phi.reshape(-1)})
            if key:
                out.insert(0, key, np.repeat(pdf[key].to_numpy(), x.shape[1]))
            yield out

    del cols
    return src.mapInPandas(run, schema)


def mean_abs_contributions(df: DataFrame, model, feature_names: Sequence[str],
                           features_col: str = "features") -> DataFrame:
    """``(feature, mean_abs_contribution)``: every Arrow batch emits only its
    per-feature sums of |contribution| and its row count, so the shuffle
    carries (#batches x #features) rows instead of (#rows x #features)."""
    compiled = compile_trees(trees_of(model))
    names = list(feature_names)
    src = df.select(vector_to_array(features_col).alias("_x"))

    def run(batches):
        for pdf in batches:
            if pdf.empty:
                continue
            x = np.vstack(pdf["_x"].to_numpy())
            phi = contributions_numpy(x, compiled)
            yield pd.DataFrame({"feature": np.array(names[:x.shape[1]], dtype=object),
                                "abs_sum": np.abs(phi).sum(axis=0), "rows": np.full(x.shape[1], len(x))})

    parts = src.mapInPandas(run, "feature string, abs_sum double, rows long")
    return parts.groupBy("feature").agg((F.sum("abs_sum") / F.sum("rows")).alias("mean_abs_contribution"))


def top_drivers(df: DataFrame, model, feature_names: Sequence[str], n: int = 8,
                features_col: str = "features") -> DataFrame:
    """The ``n`` features with the largest mean absolute contribution."""
    return (mean_abs_contributions(df, model, feature_names, features_col)
            .orderBy(F.desc("mean_abs_contribution"), "feature").limit(n))


def boosted_trees(model: BoostedModel) -> tuple[list[tuple[list[Node], float]], list[str]]:
    """Trees and feature names of a boosted model: a feature is a level of a category (0 or 1) or the bin of a number."""
    first = np.concatenate([[0], np.cumsum([len(v) for v in model.bins.levels])]).astype(int)
    n_cats = len(model.bins.cats)

    def flat(column, cut, value, cover) -> list[Node]:
        nodes: list[Node] = []

        def walk(i: int) -> int:
            at = len(nodes)
            nodes.append(Node(cover=float(cover[i]), value=float(value[i])))
            if column[i] >= 0:
                c = int(column[i])
                nodes[at].feature = int(first[c] + cut[i]) if c < n_cats else int(first[n_cats] + c - n_cats)
                nodes[at].threshold = 0.5 if c < n_cats else float(cut[i]) - 0.5
                nodes[at].left = walk(2 * i + 1)
                nodes[at].right = walk(2 * i + 2)
            return at

        walk(0)
        return nodes

    trees = [(flat(*t), 1.0) for t in zip(model.column, model.cut, model.value, model.cover)]
    return trees, [f"{c}={v}" for c, vs in zip(model.bins.cats, model.bins.levels) for v in vs] + list(model.bins.nums)


def boosted_features(model: BoostedModel, values: Sequence[pd.Series]) -> np.ndarray:
    """The features of :func:`boosted_trees` of some rows."""
    return features_of_bins(model, model.bins.place(values))


def features_of_bins(model: BoostedModel, bins: np.ndarray) -> np.ndarray:
    shown = [bins[:, i, None] == np.arange(len(v))[None, :] for i, v in enumerate(model.bins.levels)]
    return np.concatenate([*shown, bins[:, len(shown):]], axis=1).astype(float)


#: Different binned rows that a task explains at once.
EXPLAINED_ROWS = 1 << 16


def top_boosted_drivers(df: DataFrame, model: BoostedModel, n: int = 8) -> DataFrame:
    """The ``n`` features of a boosted model with the largest mean absolute contribution over ``df``.  Tasks unfold the trees
    themselves, explain rows of equal bins once, and emit sums only."""

    def merged(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        bins, rows = (np.concatenate(x) for x in zip(*held))
        order, new, _ = distinct(bins)
        at = np.flatnonzero(new)
        return bins[order[at]], np.add.reduceat(rows[order], at)

    def run(batches):
        trees, names = boosted_trees(model)
        compiled = compile_trees(trees)

        def explained(bins: np.ndarray, rows: np.ndarray) -> pd.DataFrame:
            phi = contributions_numpy(features_of_bins(model, bins), compiled)
            return pd.DataFrame({"feature": names, "abs_sum": rows @ np.abs(phi), "rows": rows.sum()})

        held: list[tuple[np.ndarray, np.ndarray]] = []
        for pdf in batches:
            if len(pdf):
                held.append((model.bins.place([pdf[c] for c in pdf.columns]).astype(np.uint8), np.ones(len(pdf), np.int64)))
            if sum(len(r) for _, r in held) >= 2 * EXPLAINED_ROWS:
                held = [merged(held)]
                if len(held[0][1]) >= EXPLAINED_ROWS:
                    yield explained(*held.pop())
        if held:
            yield explained(*merged(held))

    src = df.select(*[F.col(c).cast("string") for c in model.bins.cats], *[F.col(c).cast("double") for c in model.bins.nums])
    parts = src.mapInPandas(run, "feature string, abs_sum double, rows long")
    return (parts.groupBy("feature").agg((F.sum("abs_sum") / F.sum("rows")).alias("mean_abs_contribution"))
            .orderBy(F.desc("mean_abs_contribution"), "feature").limit(n))
