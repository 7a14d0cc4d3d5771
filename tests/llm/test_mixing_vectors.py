"""Mixing, whitening and hard negatives against brute force on small, awkward tables."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from custspark.llm import mixing, negatives, whitening

SPACE = re.compile("[^\x20\x09-\x0D]+")


# --- mixing -------------------------------------------------------------------

def brute_targets(sizes, weights=(5, 2, 1), share=1.5, limit=2):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full = set()
    while True:
        free = [s for s in names if s not in full]
        if not free:
            return {s: float(limit * sizes[s]) for s in names}
        rate = (share * sum(sizes.values()) - sum(limit * sizes[s] for s in full)) / sum(weight[s] for s in free)
        above = {s for s in free if rate * weight[s] > limit * sizes[s]}
        if not above:
            return {s: float(limit * sizes[s]) if s in full else rate * weight[s] for s in names}
        full |= above


def check_mix(out, sizes):
    want = brute_targets(sizes)
    taken, largest = defaultdict(int), defaultdict(int)
    for r in out:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source], rel=1e-12)
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 2
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    return {s: (taken[s] - want[s], largest[s]) for s in want}


def test_mix_of_odd_rows(spark, docs, rows, empty):
    out = mixing.mix(docs.drop("source").withColumn("source", F.when(F.col("doc_id") % 5 == 0, None).when(F.col("doc_id") % 5 < 3, "ſb").otherwise("a\U0001F600"))).collect()
    source = lambda i: "a\U0001F600" if i is None else (None if i % 5 == 0 else "ſb" if i % 5 < 3 else "a\U0001F600")
    sizes = defaultdict(int)
    for r in rows:
        sizes[source(r[0])] += len(SPACE.findall(r[1] or ""))
    assert Counter((r.doc_id, r.size) for r in out) == Counter((r[0], len(SPACE.findall(r[1] or ""))) for r in rows)
    for miss, largest in check_mix(out, sizes).values():
        assert abs(miss) <= largest
    assert mixing.mix(empty).count() == 0
    blank = mixing.mix(spark.createDataFrame([(1, None, "x"), (2, " \t", None)], "doc_id long, text string, source string")).collect()
    assert sorted((r.doc_id, r.size, r.target, r.taken) for r in blank) == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]


@pytest.fixture(scope="module")
def many(spark):
    """Four sources, one with most rows; one document holds a third of its source; repeated rows."""
    n = F.col("id")
    words = F.when(n == 7, 3000).otherwise(1 + F.pmod(F.xxhash64("id"), F.lit(9))).cast("int")
    source = F.when(n % 10 < 7, "big").when(n % 10 == 7, "one").when(n % 10 == 8, "mid").otherwise(F.lit(None))
    df = spark.range(6000).select(F.when(n % 11 != 0, n).alias("doc_id"), F.repeat(F.lit("w "), words).alias("text"), source.alias("source"))
    return df.union(df.where("doc_id = 5")).union(df.where("doc_id = 5")).repartition(5)


def test_mix_through_the_tree(spark, many, monkeypatch):
    monkeypatch.setattr(mixing, "LEAF", 50)
    monkeypatch.setattr(mixing, "FAN", 4)
    sizes = {r.source: r.n for r in many.groupBy("source").agg(F.sum(F.size(F.split(F.rtrim("text"), " "))).alias("n")).collect()}
    first = mixing.mix(many).collect()
    assert len(first) == 6002
    for s, (miss, largest) in check_mix(first, sizes).items():
        assert abs(miss) <= max(9, sizes[s] / mixing.GIANT), s
    assert Counter(mixing.mix(many.repartition(3)).collect()) == Counter(first)
    assert Counter(mixing.mix(many, seed=1).collect()) != Counter(first)


def test_settling_keeps_mass_and_chances():
    rng = np.random.default_rng(3)
    size, part = rng.integers(1, 50, 60), np.full(60, 0.3)
    hits = np.zeros(60)
    for _ in range(4000):
        out, left = mixing.settle(size, part, rng.random(60))
        assert abs((out * size).sum() - (part * size).sum()) < 1e-6
        assert all(x in (0.0, 1.0) for i, x in enumerate(out) if i != left)
        hits += out
    assert np.abs(hits / 4000 - 0.3).max() < 0.04


# --- vectors --------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int, node int, n int, v string, place int, curve string"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "x", 3, "c") for r in rows], VECTORS).repartition(3)


@pytest.fixture(scope="module")
def vector_rows():
    rng = np.random.default_rng(8)
    rows = [(i, rng.standard_normal(6).tolist(), int(rng.integers(0, 4))) for i in range(700)]
    rows += [(700 + i, rows[3][1], int(rng.integers(0, 4))) for i in range(300)]  # a large group of equal vectors
    rows += [(None, rows[1][1], 1), (50, rows[2][1], 2), (50, rows[2][1], 2), (100, rows[9][1], None), (150, None, 1),
             (200, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (250, [float("nan")] * 6, 2), (300, [float("inf")] + [0.0] * 5, 2), (350, [0.0] * 6, 3)]
    return rows


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def test_whitening(spark, vector_rows):
    good = [r for r in vector_rows if usable(r[1])]
    x = np.floor(64 * np.array([np.float32(r[1]) for r in good], np.float64)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    y = (n * x - s) / n
    e, q = np.linalg.eigh(y.T @ y / n)
    e, q = e[::-1], q[:, ::-1]
    out = whitening.whiten(vectors(spark, vector_rows), components=4).collect()
    assert Counter(r.vec_id for r in out) == Counter({k: 4 * c for k, c in Counter(r[0] for r in good).items()})
    assert {r.n for r in out} == {n} and max(r.identity_error for r in out) < 1e-10 and len({r.identity_error for r in out}) == 1
    assert Counter((r.vec_id, r.deviation) for r in out if r.component == 1) == Counter(
        (r[0], int(d)) for r, d in zip(good, ((n * x - s) ** 2).sum(axis=1)))
    times = Counter(r[0] for r in good)
    for c in range(4):
        mine = {r.vec_id: r.whitened for r in out if r.component == c + 1}
        assert {round(r.explained, 12) for r in out if r.component == c + 1} == {round(e[c] / e.sum(), 12)}
        side = np.sign(mine[0] * (y[0] @ q[:, c]))
        for r, w in zip(good, y @ q[:, c] / np.sqrt(e[c])):
            if times[r[0]] == 1:
                assert mine[r[0]] == pytest.approx(side * w, abs=1e-10)


def test_whitening_of_few_or_flat_vectors(spark):
    assert whitening.whiten(vectors(spark, [])).count() == 0
    assert whitening.whiten(vectors(spark, [(1, [0.5, 1.0], 0)])).count() == 0
    assert whitening.whiten(vectors(spark, [(1, None, 0), (2, [], 0)])).count() == 0
    assert whitening.whiten(vectors(spark, [(i, [0.5, 1.0], 0) for i in range(5)])).count() == 0
    line = whitening.whiten(vectors(spark, [(i, [float(i), -2.0 * i, 7.0], 0) for i in range(5)] + [(9, [1.0], 0)])).collect()
    assert {r.component for r in line} == {1} and {r.vec_id for r in line} == set(range(5))
    assert line[0].explained == pytest.approx(1.0, rel=1e-9) and line[0].identity_error < 1e-10


def test_spectrum_of_awkward_matrices():
    rng = np.random.default_rng(0)
    for t in range(150):
        n = int(rng.integers(1, 30))
        a = rng.standard_normal((n, int(rng.integers(1, n + 1))))
        v = [a @ a.T, np.diag(np.round(rng.random(n) * 3)), np.eye(n) * 2, np.ones((n, n)) + np.eye(n), np.round(a @ a.T)][t % 5]
        e, x = whitening.spectrum(v)
        size = max(1.0, np.abs(v).max())
        assert np.abs(e - np.linalg.eigvalsh(v)[::-1]).max() < 1e-12 * size * n
        assert np.abs(x.T @ x - np.eye(n)).max() < 1e-12 and np.abs(v @ x - x * e).max() < 1e-12 * size * n


def test_polar_factor():
    rng = np.random.default_rng(1)
    q = np.linalg.qr(rng.standard_normal((12, 12)))[0]
    e = np.array([3.0, -2.0, 1e-6, -1e-9, 5.0, 0.1, -0.1, 1.0, -1.0, 2.0, -7.0, 4.0])
    assert np.abs(whitening.polar_factor(q @ np.diag(e) @ q.T) - q @ np.diag(np.sign(e)) @ q.T).max() < 1e-5


def brute_negatives(rows, is_anchor, positives=5, k=3, scale=256):
    good = [(i, r[0], r[2], np.floor(scale * np.array(r[1], np.float32).astype(float)).astype(int)) for i, r in enumerate(rows) if usable(r[1]) and r[2] is not None]
    dim = max([len(v) for *_, v in good], default=0)
    good = [(i, d, c, np.pad(v, (0, dim - len(v)))) for i, d, c, v in good]
    order = lambda p: (-p[0], p[1] is None, p[1] or 0)
    out = []
    for i, d, c, v in good:
        if not is_anchor(d):
            continue
        scored = [(int(v @ w), e, b) for j, e, b, w in good if j != i]
        best = sorted((p for p in scored if p[2] == c), key=order)[:positives]
        rest = sorted((p for p in scored if p[2] != c), key=order)
        for ps, pid, _ in best:
            hit = [p for p in rest if 50 * ps <= 100 * p[0] <= 95 * ps][:k]
            out += [(d, pid, r + 1, p[1], ps, p[0]) for r, p in enumerate(hit)]
    return Counter(out)


@pytest.mark.parametrize("block,tile", [(256, 8 << 20), (16, 2048)])
def test_hard_negatives(spark, vector_rows, monkeypatch, block, tile):
    monkeypatch.setattr(negatives, "BLOCK", block)  # small blocks, many slices, groups and zone tables
    monkeypatch.setattr(negatives, "TILE_BYTES", tile)
    monkeypatch.setattr(negatives, "ZONES", 24 if block == 16 else 2048)
    rows = vector_rows + [(400, [3.0, 1.0], 1), (450, [], 2)]
    out = negatives.mine(vectors(spark, rows), F.col("vec_id") % 50 == 0).collect()
    assert Counter(tuple(r) for r in out) == brute_negatives(rows, lambda d: d is not None and d % 50 == 0)


def test_hard_negatives_of_few_rows(spark):
    ask = lambda rows: negatives.mine(vectors(spark, rows), F.col("vec_id") % 50 == 0).count()
    assert ask([]) == 0 and ask([(0, [1.0], 1)]) == 0 and ask([(1, [1.0], 1), (2, [0.9], 1), (3, [0.8], 2)]) == 0
    assert ask([(0, [1.0], 1), (2, [0.9], 1), (3, [0.8], 2)]) == 1


def test_zone_maps_leave_blocks_out(spark, monkeypatch):
    """Far-apart clusters: an anchor reads only the blocks that its bounds allow."""
    monkeypatch.setattr(negatives, "BLOCK", 20)
    rng = np.random.default_rng(2)
    centre = np.eye(5) * 4
    rows = [(i, (centre[i % 5] + 0.01 * rng.standard_normal(5)).tolist(), int(rng.integers(0, 2))) for i in range(1000)]
    read = []
    plain = negatives.best_of

    def counted(asks, *more):
        df = plain(asks, *more)
        read.append(asks.agg(F.sum(F.size("need"))).first()[0])
        return df

    monkeypatch.setattr(negatives, "best_of", counted)
    negatives.mine(vectors(spark, rows), F.col("vec_id") % 50 == 0).count()
    assert read[1] < 20 * 50 / 2  # twenty anchors, fifty blocks


def test_hilbert_neighbours_are_next_to_each_other():
    side, axes = 8, 3
    cells = np.stack(np.meshgrid(*[np.arange(side)] * axes, indexing="ij"), axis=-1).reshape(-1, axes)
    order = cells[np.argsort(negatives.hilbert_key(cells, 3))]
    assert sorted(negatives.hilbert_key(cells, 3)) == list(range(side ** axes))
    assert (np.abs(np.diff(order, axis=0)).sum(axis=1) == 1).all()
