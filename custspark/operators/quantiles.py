"""Exact quantiles by bracket.

Spark's exact ``percentile`` keeps a value->count map of the whole column
in one final task, which does not survive a continuous column with
billions of distinct values.  Here a mergeable sketch of each column gives two values that
certainly stand around a wanted rank; a second scan counts the values below the
bracket and sorts only those in it, about ``6 / ACCURACY`` of the column (ties
merge before the shuffle).  The number of passes is fixed, whatever the values, no
shuffle holds all distinct values, and one row comes back for each rank.

Nulls and NaN are no values.  Results equal pandas' linear interpolation
(``quantile``, ``median``).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Inverse of the sketch's rank error.
ACCURACY = 10_000
#: Columns of up to SMALL * ACCURACY values are sorted whole (after counting equal ones).
SMALL = 4


def _value(col: str) -> Column:
    x = F.col(col).cast("double")
    return F.when(~F.isnan(x), x)


def column_summary(df: DataFrame, cols: Sequence[str], probs: Sequence[float] = ()) -> dict[str, tuple]:
    """``{col: (min, max, count of values, brackets)}`` in one aggregate; ``brackets`` holds for each of ``probs`` two values around
    its rank, from mergeable sketches: ranks are off by ``count / ACCURACY`` at most, and three times that is allowed for."""
    wide = 3.0 / ACCURACY
    asked = F.lit([q for p in probs for q in (max(0.0, p - wide), min(1.0, p + wide))])
    aggs = []
    for i, c in enumerate(cols):
        x = _value(c)
        aggs += [F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}"), F.count(x).alias(f"n{i}")]
        if probs:
            aggs.append(F.percentile_approx(x, asked, ACCURACY).alias(f"q{i}"))
    row = df.agg(*aggs).first()
    out = {}
    for i, c in enumerate(cols):
        q = (row[f"q{i}"] if probs else None) or []
        out[c] = (row[f"lo{i}"], row[f"hi{i}"], row[f"n{i}"], list(zip(q[::2], q[1::2])))
    return out


def order_statistics(df: DataFrame, wanted: dict[tuple[str, int], tuple[float, float]], summary: dict[str, tuple]) -> dict[tuple[str, int], float]:
    """Exact values of the given ``(column, 0-based rank)`` (ascending, missing values ignored), each with a bracket that likely
    holds it.  A bracket that does not is replaced by the whole column."""
    out: dict[tuple[str, int], float] = {}
    left = dict(wanted)
    while left:
        places = sorted(left)
        spans = sorted({(c, *left[c, r]) for c, r in places})
        at = {s: i for i, s in enumerate(spans)}
        # one scan counts what lies below each bracket, the next sorts what lies in it
        cut = [(i, c, lo) for i, (c, lo, _) in enumerate(spans) if lo > summary[c][0]]
        below = df.agg(*[F.count_if(_value(c) < F.lit(lo)).alias(f"b{i}") for i, c, lo in cut]).first().asDict() if cut else {}
        held = F.array(*[F.struct(F.lit(i).alias("k"), _value(c).alias("x")) for i, (c, _, _) in enumerate(spans)])
        lows, highs = F.lit([float(s[1]) for s in spans]), F.lit([float(s[2]) for s in spans])
        inside = F.filter(held, lambda v: (v["x"] >= F.get(lows, v["k"])) & (v["x"] <= F.get(highs, v["k"])))
        counts = df.select(F.explode(inside).alias("v")).groupBy("v.k", "v.x").agg(F.count(F.lit(1)).alias("n"))
        upto = F.sum("n").over(Window.partitionBy("k").orderBy("x"))
        ranks: list[list[int]] = [[] for _ in spans]
        for c, r in places:
            i = at[(c, *left[c, r])]
            ranks[i].append(r - below.get(f"b{i}", 0))
        here = F.filter(F.get(F.lit(ranks), F.col("k")), lambda r: (r < F.col("upto")) & (r >= F.col("upto") - F.col("n")))
        rows = counts.withColumn("upto", upto).select("k", "x", F.explode(here).alias("r")).collect()  # one row a rank
        for row in rows:
            out[spans[row["k"]][0], row["r"] + below.get(f"b{row['k']}", 0)] = row["x"]
        left = {(c, r): summary[c][:2] for c, r in places if (c, r) not in out}
    return out


def quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float]) -> dict[str, list[float | None]]:
    """Exact linear-interpolation quantiles per column (pandas semantics)."""
    summary = column_summary(df, list(cols), probs)
    wanted: dict[tuple[str, int], tuple[float, float]] = {}
    for c in cols:
        low, high, n, brackets = summary[c]
        for j, p in enumerate(probs if n else ()):
            lo = int(math.floor(p * (n - 1)))
            # a column whose whole length is within a few bracket widths is its own bracket
            span = brackets[j] if n > SMALL * ACCURACY else (low, high)
            for r in (lo, min(lo + 1, n - 1)):
                wanted.setdefault((c, r), span)
    found = order_statistics(df, wanted, summary)
    out: dict[str, list[float | None]] = {}
    for c in cols:
        n, values = summary[c][2], []
        for p in probs:
            if not n:
                values.append(None)
                continue
            pos = p * (n - 1)
            lo = int(math.floor(pos))
            a, b = found[c, lo], found[c, min(lo + 1, n - 1)]
            values.append(a if pos == lo else a + (pos - lo) * (b - a))
        out[c] = values
    return out


def medians(df: DataFrame, cols: Sequence[str]) -> dict[str, float | None]:
    q = quantiles(df, cols, [0.5])
    return {c: q[c][0] for c in cols}
