"""Quantiles by bracket against pandas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from custspark.operators import quantiles


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(6)
    n = 30_000
    pdf = pd.DataFrame({"normal": rng.standard_normal(n), "heavy": np.where(rng.random(n) < 0.4, 7.0, rng.pareto(1.0, n)), "few": rng.integers(0, 4, n).astype(float),
                        "flat": 3.0, "gaps": np.where(rng.random(n) < 0.5, np.nan, rng.random(n)), "wide": rng.standard_normal(n) * 10.0 ** rng.integers(-300, 300, n),
                        "signed": np.where(rng.random(n) < 0.01, -np.inf, rng.random(n))})
    return pdf, spark.createDataFrame(pdf).withColumn("none", F.lit(None).cast("double")).repartition(5)


PROBS = [0.0, 0.001, 0.25, 0.3333, 0.5, 0.75, 0.9999, 1.0]


@pytest.mark.parametrize("accuracy", [10_000, 50])
def test_equal_to_pandas(table, monkeypatch, accuracy):
    monkeypatch.setattr(quantiles, "ACCURACY", accuracy)
    monkeypatch.setattr(quantiles, "SMALL", 1)
    pdf, df = table
    got = quantiles.quantiles(df, [*pdf.columns, "none"], PROBS)
    for c in pdf.columns:
        values = np.sort(pdf[c].dropna().to_numpy())
        for p, x in zip(PROBS, got[c]):
            pos = p * (len(values) - 1)
            lo, hi = values[int(np.floor(pos))], values[min(int(np.floor(pos)) + 1, len(values) - 1)]
            assert x == lo if pos == np.floor(pos) else x == pytest.approx(lo + (pos - np.floor(pos)) * (hi - lo), rel=1e-12, nan_ok=True), (c, p)
    assert got["none"] == [None] * len(PROBS)


def test_small_tables(spark):
    for values in ([], [None], [5.0], [2.0, 1.0], [1.0, None, float("nan"), 3.0, 2.0], list(map(float, range(10)))):
        df = spark.createDataFrame([(v,) for v in values], "x double")
        known = pd.Series([v for v in values if v is not None], dtype=float).dropna()
        want = [None if known.empty else known.quantile(p) for p in (0.25, 0.5, 0.75)]
        assert quantiles.quantiles(df, ["x"], [0.25, 0.5, 0.75])["x"] == want


def test_a_wrong_bracket_is_mended(table):
    pdf, df = table
    summary = quantiles.column_summary(df, ["normal", "few"])
    want = np.sort(pdf["normal"].to_numpy())
    got = quantiles.order_statistics(df, {("normal", 15_000): (100.0, 101.0), ("normal", 7): (-0.1, 0.1), ("few", 0): (0.0, 3.0)}, summary)
    assert got == {("normal", 15_000): want[15_000], ("normal", 7): want[7], ("few", 0): 0.0}


def test_only_the_bracket_is_shuffled(table, monkeypatch):
    """What is grouped by value is a small part of a continuous column."""
    _, df = table
    monkeypatch.setattr(quantiles, "SMALL", 1)
    seen = []
    plain = F.explode

    def counted(col):
        seen.append(df.select(plain(col)).count() if not seen else 0)
        return plain(col)

    monkeypatch.setattr(quantiles.F, "explode", counted)
    quantiles.medians(df, ["normal"])
    assert seen and seen[0] < 30_000 * 10 / quantiles.ACCURACY + 20


def test_yeo_johnson_fit_is_at_least_as_good_as_a_fine_grid(spark):
    from custspark.operators import features
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"right": rng.pareto(3.0, 4000) * 10, "normal": rng.standard_normal(4000), "left": -rng.gamma(2.0, 3.0, 4000), "flat": 2.0,
                        "gaps": np.where(rng.random(4000) < 0.3, np.nan, rng.random(4000) ** 3)})
    df = spark.createDataFrame(pdf).replace(float("nan"), None)
    lam = features.fit_yeo_johnson(df, list(pdf.columns))

    def likelihood(x, t):
        with np.errstate(all="ignore"):
            pos = np.log1p(x) if abs(t) < 1e-12 else ((x + 1) ** t - 1) / t
            neg = -np.log1p(-x) if abs(2 - t) < 1e-12 else -((-x + 1) ** (2 - t) - 1) / (2 - t)
            return -len(x) / 2 * np.log(np.where(x >= 0, pos, neg).var()) + (t - 1) * (np.sign(x) * np.log1p(np.abs(x))).sum()

    assert lam["flat"] == 1.0
    for c in ("right", "normal", "left", "gaps"):
        x = pdf[c].dropna().to_numpy()
        assert likelihood(x, lam[c]) >= max(likelihood(x, t) for t in np.linspace(-5, 5, 2001)) - 1e-4, c
