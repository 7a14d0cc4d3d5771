"""Learner-backed operators: seeded, small."""

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from custspark.operators import boosting, drivers, metrics, segments


def _data(spark, n=400):
    df = spark.range(0, n).select(
        F.col("id").alias("Customer_ID"),
        (F.col("id") % 17).cast("double").alias("a"),
        ((F.col("id") * 7) % 11).cast("double").alias("b"),
        ((F.col("id") * 3) % 5).cast("double").alias("c"))
    df = df.withColumn("label", ((F.col("a") + F.col("b") * 0.5) > 11).cast("double"))
    return VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df)


def test_contributions_sum_to_margin(spark):
    df = _data(spark)
    model = GBTClassifier(labelCol="label", maxIter=8, maxDepth=3, seed=7).fit(df)
    trees = drivers.trees_of(model)
    compiled = drivers.compile_trees(trees)
    base = drivers.expected_value(trees)
    rows = model.transform(df).select(vector_to_array("features").alias("x"),
                                      vector_to_array("rawPrediction")[1].alias("m")).collect()
    x = np.array([r["x"] for r in rows])
    phi = drivers.contributions_numpy(x, compiled)
    margin = np.array([r["m"] for r in rows])
    assert np.allclose(phi.sum(axis=1) + base, margin, atol=1e-8)


def test_top_drivers_and_auc(spark):
    df = _data(spark)
    model = GBTClassifier(labelCol="label", maxIter=8, maxDepth=3, seed=7).fit(df)
    top = drivers.top_drivers(df, model, ["a", "b", "c"], 2).collect()
    assert [r["feature"] for r in top][0] in ("a", "b")
    scored = model.transform(df).withColumn("p", vector_to_array("probability")[1])
    assert metrics.roc_auc(scored, "label", "p").first()["auc"] > 0.9


def test_kmeans_and_davies_bouldin(spark):
    df = _data(spark)
    _, assigned = segments.kmeans_segments(df, 3)
    assert assigned.select("KMeans_Segment").distinct().count() == 3
    db = segments.davies_bouldin(assigned).first()[0]
    assert db > 0


# --- boosting ---------------------------------------------------------------------

CATS, NUMS = ["kind"], ["a", "b", "c"]


def _rows(spark, n=240):
    df = _data(spark, n).drop("features").withColumn("kind", F.when(F.col("Customer_ID") % 13 != 0, F.concat(F.lit("k"), (F.col("Customer_ID") % 3).cast("string"))))
    return (df.withColumn("a", F.when(F.col("Customer_ID") % 19 != 0, F.col("a"))).withColumn("weight", F.when(F.col("label") == 1, 1.5).otherwise(1.0))
            .withColumn("value", F.coalesce("a", F.lit(3.0)) + F.when(F.col("kind") == "k1", 4.0).otherwise(0.0) + F.col("b") / 8)
            .withColumn("fold", (F.col("Customer_ID") % 3).cast("int")).repartition(3))


def _brute_margins(pdf, label, loss, trees, depth, step, train):
    """Boosting by trying every level and every value of every column, node by node."""
    y, w = pdf[label].to_numpy(float), (pdf["weight"] if loss == "logistic" else pdf["weight"] * 0 + 1).to_numpy(float)
    tests = [(pdf["kind"] == v).to_numpy() for v in sorted(pdf["kind"].dropna().unique())]
    for c in NUMS:
        x = pdf[c].fillna(-1e9).to_numpy()
        tests += [x >= v for v in sorted(pdf[c].dropna().unique())[1:]]
    margin = np.full(len(pdf), 0.0 if loss == "logistic" else 0.5)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = ((p - y) * w, p * (1 - p) * w) if loss == "logistic" else ((margin - y) * w, w)
        g, h = np.rint(g * 2**20) / 2**20, np.rint(h * 2**20) / 2**20

        def grow(rows, level):
            fit = rows & train
            G, H = g[fit].sum(), h[fit].sum()
            best = (1e-9, None)
            for t in tests if level < depth else []:
                r, l = fit & t, fit & ~t
                if h[r].sum() >= 1 and h[l].sum() >= 1:
                    gain = g[l].sum()**2 / (h[l].sum() + 1) + g[r].sum()**2 / (h[r].sum() + 1) - G**2 / (H + 1)
                    if gain > best[0] + 1e-12:
                        best = (gain, t)
            if best[1] is None:
                margin[rows] -= step * G / (H + 1)
            else:
                grow(rows & ~best[1], level + 1)
                grow(rows & best[1], level + 1)

        grow(np.ones(len(pdf), bool), 0)
    return margin


@pytest.mark.parametrize("loss,label", [("logistic", "label"), ("squared", "value")])
def test_boosting_equals_brute_force(spark, loss, label):
    df = _rows(spark).cache()
    weight = "weight" if loss == "logistic" else None
    model = boosting.fit(df, CATS, NUMS, label, "Customer_ID", boosting.Setting(4, 3, 0.3, 1.0, 1.0), loss, weight)
    got = df.withColumn("p", model.score()).toPandas().sort_values("Customer_ID").reset_index(drop=True)
    want = _brute_margins(got, label, loss, 4, 3, 0.3, np.ones(len(got), bool))
    assert np.allclose(got["p"], 1 / (1 + np.exp(-want)) if loss == "logistic" else want, atol=1e-9)
    found = boosting.search(df, CATS, NUMS, label, "Customer_ID", [boosting.Setting(3, 2, 0.5, 1.0, 1.0)], loss, 3, weight_col=weight)[0]
    for k in range(3):
        held = (got["fold"] == k).to_numpy()
        m = _brute_margins(got, label, loss, 3, 2, 0.5, ~held)[held]
        y = got[label][held].to_numpy()
        f1 = 2 * ((m > 0) & (y == 1)).sum() / max(1, (m > 0).sum() + (y == 1).sum())
        assert found[k] == pytest.approx(f1 if loss == "logistic" else np.abs(m - y).mean(), abs=1e-9)


def test_boosting_is_the_same_in_many_parts(spark):
    """Parts that exchange sums level by level give the trees of one part, past a checkpoint too."""
    df = _rows(spark).cache()
    settings = [boosting.Setting(22, 2, 0.3, 0.8, 0.7, seed=1), boosting.Setting(5, 4, 0.1, 0.7, 0.8)]
    args = (df, CATS, NUMS, "label", "Customer_ID", settings, "logistic", 3)
    assert boosting.search(*args, weight_col="weight", part_rows=70) == boosting.search(*args, weight_col="weight")
    a = boosting.fit(df, CATS, NUMS, "value", "Customer_ID", settings[1], "squared")
    b = boosting.fit(df.repartition(7), CATS, NUMS, "value", "Customer_ID", settings[1], "squared", part_rows=70)
    assert (a.column == b.column).all() and (a.cut == b.cut).all() and (a.value == b.value).all()


def test_boosted_model_saved_and_odd_rows(spark, tmp_path):
    df = _rows(spark)
    model = boosting.fit(df, CATS, NUMS, "label", "Customer_ID", boosting.Setting(10, 3, 0.3), "logistic")
    model.save(spark, str(tmp_path / "m"))
    back = boosting.BoostedModel.load(spark, str(tmp_path / "m"))
    odd = spark.createDataFrame([(1, None, None, None, None), (2, "new", 5.0, 1e9, -1e9), (3, "k1", float("nan"), 2.0, 3.0)], "Customer_ID long, kind string, a double, b double, c double")
    for data in (df.select("Customer_ID", *CATS, *NUMS), odd):
        got = data.withColumn("x", model.score()).withColumn("y", back.score()).collect()
        assert all(0 < r["x"] < 1 and r["x"] == r["y"] for r in got)
    none = boosting.fit(df.where("false"), CATS, NUMS, "label", "Customer_ID", boosting.Setting(3, 2), "logistic")
    assert [r["p1"] for r in none.transform(odd).collect()] == [0.5] * 3
    flat = boosting.fit(df.withColumn("label", F.lit(0.0)), [], ["a"], "label", "Customer_ID", boosting.Setting(3, 2, 0.1, 1.0, 1.0), "logistic")
    assert all(r["p1"] < 0.5 for r in flat.transform(odd).collect())


def test_boosted_contributions_sum_to_margin(spark):
    df = _rows(spark)
    model = boosting.fit(df, CATS, NUMS, "value", "Customer_ID", boosting.Setting(12, 4, 0.3, 1.0, 1.0), "squared")
    pdf = df.toPandas()
    values = [pdf[c] for c in model.bins.columns]
    trees, names = drivers.boosted_trees(model)
    phi = drivers.contributions_numpy(drivers.boosted_features(model, values), drivers.compile_trees(trees))
    assert np.allclose(phi.sum(axis=1) + drivers.expected_value(trees) + 0.5, model.margins(values), atol=1e-8)
    top = drivers.top_boosted_drivers(df, model, 3).collect()
    mean = dict(zip(names, np.abs(phi).mean(axis=0)))
    assert [r["feature"] for r in top] == sorted(mean, key=lambda k: -mean[k])[:3] and top[0]["feature"] == "a"
    assert top[0]["mean_abs_contribution"] == pytest.approx(mean["a"])


def test_contributions_are_shapley_values():
    """Against the definition: averages over all orders of the features of the leaf's path."""
    import itertools
    import math
    leaf = drivers.Leaf([4, 7, 2], [], np.array([0.3, 0.5, 0.9]), 2.0)
    for pattern in range(8):
        o = [(pattern >> k) & 1 for k in range(3)]
        worth = lambda s: 2.0 * math.prod(o[k] if k in s else leaf.shares[k] for k in range(3))
        want = np.zeros(3)
        for order in itertools.permutations(range(3)):
            for at, k in enumerate(order):
                want[k] += (worth(order[:at + 1]) - worth(order[:at])) / 6
        assert np.allclose(drivers.leaf_contributions(leaf, np.array([pattern]))[0], want)


def test_searches_draw_from_the_whole_grids(spark):
    from custspark.operators import models
    df = _rows(spark).withColumn("log_value", F.log1p("value"))
    few = {"trees": [3], "depth": [2, 3], "step": [0.3]}
    best, table = models.churn_search(df, models.ModelSpec(CATS, ["b", "c"], "label"), grid=few, n_iter=2, k=5)
    rows = table.collect()
    assert len(rows) == 2 and all(0 <= r["mean_metric"] <= 1 for r in rows) and best.depth in (2, 3)
    best, table = models.value_search(df, models.ModelSpec(CATS, NUMS, "log_value"), grid=few, n_iter=2, k=2)
    rows = table.collect()
    assert len(rows) == 2 and f"depth={best.depth}" in min(rows, key=lambda r: r["mean_metric"])["params"]
    for grid, n, drawn in ((models.CHURN_GRID, 162, 10), (models.VALUE_GRID, 243, 15)):
        every = models.draw_settings(grid, 1000)
        assert len(set(every)) == n and len(set(models.draw_settings(grid, drawn))) == drawn


def test_training_is_one_job_for_all_trees(spark):
    """A table of more rows than a part trains without a Spark job for every level of every tree."""
    df = spark.range(70_000).selectExpr("id as Customer_ID", "cast(id % 7 as double) as a", "cast(hash(id) % 2 = 0 or id % 7 = 3 as int) as label", "cast(id % 3 as int) as fold")
    sc = spark.sparkContext
    for group, run in (("boosting-fit", lambda: boosting.fit(df, [], ["a"], "label", "Customer_ID", boosting.Setting(12, 3, 0.3), "logistic")),
                       ("boosting-search", lambda: boosting.search(df, [], ["a"], "label", "Customer_ID", [boosting.Setting(12, 3, 0.3)], "logistic", 3))):
        sc.setJobGroup(group, group)
        try:
            run()
        finally:
            sc.setLocalProperty("spark.jobGroup.id", None)
        assert len(sc.statusTracker().getJobIdsForGroup(group)) < 12


def test_search_over_many_rows_waits_for_no_level(spark, monkeypatch):
    """A search of more rows than ``TABLE_ROWS``, needs no Spark job a level and finds what parts find."""
    monkeypatch.setattr(boosting, "TABLE_ROWS", 100)
    monkeypatch.setattr(boosting, "PART_ROWS", 50)
    df, sc = _rows(spark).withColumn("fold", (F.col("Customer_ID") % 2).cast("int")).cache(), spark.sparkContext
    settings = [boosting.Setting(12, 3, 0.3, 0.8, 0.8, seed) for seed in (1, 2, 3)]
    assert df.count() > boosting.TABLE_ROWS
    sc.setJobGroup("boosting-many", "boosting-many")
    try:
        found = boosting.search(df, CATS, NUMS, "value", "Customer_ID", settings, "squared", 2)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert len(sc.statusTracker().getJobIdsForGroup("boosting-many")) < 12
    parts = boosting.search(df, CATS, NUMS, "value", "Customer_ID", settings[:2], "squared", 2, part_rows=70)
    assert np.allclose(found[:2], parts, rtol=1e-12)


@pytest.mark.parametrize("loss", ["squared", "logistic"])
def test_gradients_step_by_step(monkeypatch, loss):
    """Cells and patterns that go on in the next step count once; sums as by the definition, row by row."""
    rng = np.random.default_rng(8)
    bins, key, fold = rng.integers(0, 2, (400, 3)).astype(np.uint8), rng.integers(-2**62, 2**62, 400), rng.integers(0, 3, 400).astype(np.int32)
    y, w = rng.integers(0, 2, 400).astype(float), np.where(rng.random(400) < 0.5, 1.0, 1.3)
    part = boosting.Part.of([[x.tobytes() for x in (bins, key, fold, y, w)]], 3)
    models = boosting.Models([boosting.Setting(rows=r) for r in (0.7, 0.9, 1.0, 0.7)], np.array([0, 2, -1, 1]), np.arange(4))
    margin = rng.normal(size=(4, part.bins.shape[1]))
    unit = 2.0 ** 20
    of = {tuple(b): i for i, b in enumerate(part.bins.T.tolist())}
    p, hp = (1 / (1 + np.exp(-margin)),) * 2 if loss == "logistic" else (margin, None)
    want = np.zeros((2, *margin.shape))
    for j, s in enumerate(models.settings):
        takes = (boosting._hash(key, s.seed * 1_000_003 + 5) < s.rows) & (fold != models.fold[j])
        for r in np.flatnonzero(takes):
            i = of[tuple(bins[r].tolist())]
            want[0, j, i] += np.rint((p[j, i] - y[r]) * w[r] * unit)
            want[1, j, i] += np.rint((hp[j, i] * (1 - hp[j, i]) if hp is not None else 1.0) * w[r] * unit)
    for rows in (7, 150, 1 << 15):
        monkeypatch.setattr(boosting, "STEP_ROWS", rows)
        assert (np.stack(boosting.gradients(part, margin, models, 5, loss)) == want).all()


def test_columns_are_summed_up_together(monkeypatch):
    """Sums of joint columns, and of columns too large to be joined, are those of each column."""
    rng = np.random.default_rng(9)
    sizes = [3, 2, 5, 40, 4]
    bins = np.stack([rng.integers(0, n, 600) for n in sizes])
    node, g, h = rng.integers(0, 7, (2, 600)), rng.integers(-99, 99, (2, 600)).astype(float), rng.integers(0, 9, (2, 600)).astype(float)
    want = np.zeros((2, 4, sum(sizes), 2))
    for j in range(2):
        for r in np.flatnonzero(node[j] >= 3):
            for c, n in enumerate(sizes):
                want[j, node[j, r] - 3, sum(sizes[:c]) + bins[c, r]] += g[j, r], h[j, r]
    for limit in (1, 12, 256):
        monkeypatch.setattr(boosting, "JOINT_BINS", limit)
        assert (boosting.histograms(boosting.joint_bins(bins, sizes), node, 2, g, h, sizes, [0, 1]) == want).all()


def test_large_sums_meet_in_tasks(spark, monkeypatch):
    """Sums of the parts that are too large for the driver are added by a shuffle, with the same trees."""
    df = _rows(spark).cache()
    args = (df, CATS, NUMS, "value", "Customer_ID", boosting.Setting(5, 3, 0.3, 0.8, 0.7), "squared")
    a = boosting.fit(*args)
    for limit in (0, 1 << 30):
        monkeypatch.setattr(boosting, "DRIVER_BYTES", limit)
        b = boosting.fit(*args, part_rows=70)
        assert (a.column == b.column).all() and (a.cut == b.cut).all() and (a.value == b.value).all()


def test_equal_rows_are_one_pattern(spark):
    """Patterns and cells hold all rows once, whatever their order; more than eight columns too."""
    rng = np.random.default_rng(3)
    bins, key = rng.integers(0, 2, (500, 11)).astype(np.uint8), np.arange(500)
    bins[:, 3:9] = 1
    fold, y, w = rng.integers(0, 2, 500).astype(np.int32), rng.integers(0, 2, 500).astype(float), np.ones(500)
    part = boosting.Part.of([[x[s].tobytes() for x in (bins, key, fold, y, w)] for s in (slice(0, 200), slice(200, 500))], 11)
    assert part.bins.shape[1] == len(np.unique(bins, axis=0)) and sorted(part.key) == list(range(500))
    cell = np.repeat(np.arange(len(part.cell_at)), part.cell_rows().astype(int))
    assert (part.bins.T[part.pattern[cell]] == bins[part.key]).all()
    assert (part.fold[cell] == fold[part.key]).all() and (part.y[cell] == y[part.key]).all()
    empty = boosting.Part.of([], 11)
    assert empty.bins.shape == (11, 0) and boosting.gradients(empty, np.zeros((1, 0)), boosting.Models([boosting.Setting()], np.array([-1]), np.array([0])), 0, "logistic")[0].shape == (1, 0)


def test_contributions_of_equal_outcomes_are_worked_out_once(spark, monkeypatch):
    df = _rows(spark)
    model = boosting.fit(df, CATS, NUMS, "value", "Customer_ID", boosting.Setting(6, 3, 0.3, 1.0, 1.0), "squared")
    pdf = df.toPandas()
    compiled = drivers.compile_trees(drivers.boosted_trees(model)[0])
    x = drivers.boosted_features(model, [pdf[c] for c in model.bins.columns])
    want = drivers.contributions_numpy(x, compiled)
    rows = []
    plain = drivers._tree_contributions
    monkeypatch.setattr(drivers, "_tree_contributions", lambda x, *a: rows.append(len(x)) or plain(x, *a))
    assert np.allclose(drivers.contributions_numpy(np.tile(x, (9, 1)), compiled), np.tile(want, (9, 1)))
    assert len(rows) == 6 and max(rows) <= 128
    monkeypatch.setattr(drivers, "_outcomes", lambda x, nodes: None)
    assert np.allclose(drivers.contributions_numpy(x, compiled), want)
    assert drivers.contributions_numpy(x[:0], compiled).shape == x[:0].shape
    monkeypatch.setattr(drivers, "EXPLAINED_ROWS", 8)
    top = drivers.top_boosted_drivers(df.unionByName(df), model, 3).collect()
    assert [r["mean_abs_contribution"] for r in top] == pytest.approx(sorted(np.abs(want).mean(axis=0))[:-4:-1])


def test_holdout_reports_score_and_split_once(spark):
    from custspark.plans import catalog
    catalog.load_all()
    plan = lambda name: catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "run(" not in plan("churn_holdout_report")
    for name in ("churn_holdout_report", "cltv_holdout_report", "green_holdout_report"):
        assert "Join Inner, (Customer_ID" not in plan(name)
