"""Feature preparation (M1-M5): encoders, robust scaling, Yeo-Johnson power
transform, feature weights.

Fitted statistics (medians, quartiles, lambdas) are small one-row tables;
they are applied as scalar subqueries or literals, so transforms stay
column expressions inside whole-stage codegen.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def one_hot_stages(cats: Sequence[str], prefix: str = "_oh_") -> list:
    """M1: ``OneHotEncoder(handle_unknown='ignore')``.  The indexer keeps an
    extra slot for unseen / null values and the encoder drops the last slot,
    which is exactly that one, so unknown values become the zero vector."""
    stages = []
    for c in cats:
        stages.append(StringIndexer(inputCol=c, outputCol=f"{prefix}{c}_idx", handleInvalid="keep",
                                    stringOrderType="alphabetAsc"))
        stages.append(OneHotEncoder(inputCol=f"{prefix}{c}_idx", outputCol=f"{prefix}{c}", dropLast=True))
    return stages


def robust_scale(df: DataFrame, cols: Sequence[str], suffix: str = "") -> DataFrame:
    """M2 (exact form): ``(x - median) / IQR`` with interpolated quartiles
    (``RobustScaler`` semantics); an IQR of 0 leaves the centred value.  The
    quartiles are fitted once (bounded memory) and applied as literals."""
    from .quantiles import quantiles
    q = quantiles(df, list(cols), [0.25, 0.5, 0.75])
    out = {}
    for c in cols:
        q1, med, q3 = q[c]
        centred = F.col(c).cast("double") - F.lit(med)
        iqr = (q3 - q1) if q1 is not None else 0.0
        out[f"{c}{suffix}"] = centred if iqr == 0 else centred / F.lit(iqr)
    return df.withColumns(out)


def feature_pipeline(cats: Sequence[str], nums: Sequence[str], scale: bool = True,
                     features_col: str = "features") -> Pipeline:
    """M3: the column transformer as one Spark ML pipeline: one-hot for the
    categorical columns, robust scaling for the numeric ones, assembled into
    one vector.  Numeric gaps must be filled first (P9)."""
    from pyspark.ml.feature import RobustScaler
    stages = one_hot_stages(cats)
    num_vec = "_num_vec"
    stages.append(VectorAssembler(inputCols=list(nums), outputCol=num_vec, handleInvalid="keep"))
    if scale:
        stages.append(RobustScaler(inputCol=num_vec, outputCol="_num_scaled", withCentering=True,
                                   withScaling=True, relativeError=1e-4))
        num_vec = "_num_scaled"
    stages.append(VectorAssembler(inputCols=[f"_oh_{c}" for c in cats] + [num_vec], outputCol=features_col))
    return Pipeline(stages=stages)


def feature_names(cats_levels: dict[str, list[str]], nums: Sequence[str]) -> list[str]:
    """Names of the assembled vector slots (``cat_level`` then numerics)."""
    names = []
    for c, levels in cats_levels.items():
        names += [f"{c}_{v}" for v in levels]
    return names + list(nums)


# --- M4 Yeo-Johnson --------------------------------------------------------

def yeo_johnson(x: Column, lam) -> Column:
    """Yeo-Johnson transform of ``x`` for ``lam`` (a float or a Column)."""
    lam = F.lit(float(lam)) if isinstance(lam, (int, float)) else lam
    pos = F.when(F.abs(lam) < 1e-12, F.log1p(x)).otherwise((F.pow(x + 1, lam) - 1) / lam)
    two = F.lit(2.0) - lam
    neg = F.when(F.abs(two) < 1e-12, -F.log1p(-x)).otherwise(-(F.pow(-x + 1, two) - 1) / two)
    return F.when(x >= 0, pos).otherwise(neg)


def fit_yeo_johnson(df: DataFrame, cols: Sequence[str], lo: float = -5.0, hi: float = 5.0,
                    tol: float = 1e-4, most: int = 20) -> dict[str, float]:
    """M4 fit: the lambda maximising the Yeo-Johnson log-likelihood
    ``-n/2 log(var_pop(y)) + (lam - 1) sum(sign(x) log1p(|x|))`` per column, by a
    bracketed search for all columns together.  The first aggregate tries whole steps between ``lo`` and ``hi``; each
    further one tries, for every column that is not done, the vertex of the parabola through the best point and
    its neighbours and a point on either side of it (golden sections where the parabola leaves the bracket).
    An aggregate reads back a number for each point."""
    cols = list(cols)
    xs = {c: F.col(c).cast("double") for c in cols}
    base = df.agg(*[F.sum(F.signum(xs[c]) * F.log1p(F.abs(xs[c]))).alias(f"s{i}") for i, c in enumerate(cols)],
                  *[F.count(xs[c]).alias(f"n{i}") for i, c in enumerate(cols)],
                  *[(F.min(xs[c]) < F.max(xs[c])).alias(f"v{i}") for i, c in enumerate(cols)]).first()
    fitted = {c: 1.0 for c in cols}  # a column of one value stays as it is
    cols = [c for i, c in enumerate(cols) if base[f"v{i}"]]
    if not cols:
        return fitted
    number = {c: i for i, c in enumerate(fitted)}
    tried: dict[str, dict[float, float]] = {c: {} for c in cols}

    def likelihoods(points: dict[str, list[float]]) -> None:
        # one generated row per (value, column, lambda) and ONE transform
        # expression with lambda as a column: the plan stays small, and the partial aggregate folds the
        # generated rows inside each task before the (tiny) shuffle
        cands = [F.struct(F.lit(cols.index(c)).alias("c"), F.lit(k).alias("k"), F.lit(float(lam)).alias("lam"), xs[c].alias("x"))
                 for c, lams in points.items() for k, lam in enumerate(lams)]
        rows = (df.select(F.explode(F.array(*cands)).alias("g")).where(F.col("g.x").isNotNull())
                .groupBy("g.c", "g.k").agg(F.var_pop(yeo_johnson(F.col("g.x"), F.col("g.lam"))).alias("v"))
                .collect())
        var = {(cols[r["c"]], r["k"]): r["v"] for r in rows}
        for c, lams in points.items():
            i = number[c]
            for k, lam in enumerate(lams):
                v = var.get((c, k))
                bad = v is None or v <= 0 or math.isnan(v) or math.isinf(v)
                tried[c][lam] = -math.inf if bad else -base[f"n{i}"] / 2 * math.log(v) + (lam - 1) * base[f"s{i}"]

    steps = max(2, math.ceil(hi - lo))
    likelihoods({c: [lo + (hi - lo) * k / steps for k in range(steps + 1)] for c in cols})
    last: dict[str, float] = {}
    for _ in range(most):
        points = {}
        for c in cols:
            lams = sorted(tried[c])
            at = max(range(len(lams)), key=lambda k: tried[c][lams[k]])
            if tried[c][lams[at]] == -math.inf:
                continue  # no variance at any lambda
            left, mid, right = lams[max(at - 1, 0)], lams[at], lams[min(at + 1, len(lams) - 1)]
            if right - left <= 2 * tol or abs(last.get(c, math.inf) - mid) <= tol and min(mid - left or math.inf, right - mid or math.inf) <= 4 * tol:
                continue
            last[c] = mid
            guess = _vertex(*((x, tried[c][x]) for x in (left, mid, right))) if left < mid < right else None
            near = [x for x in (guess,) if x is not None]
            width = max(tol, 0.02 * (right - left))
            near = [near[0] - width, near[0], near[0] + width] if near else [mid - 0.382 * (mid - left), mid + 0.382 * (right - mid)]
            near = [x for x in near if left < x < right and all(abs(x - y) > tol / 4 for y in (left, mid, right))]
            if near:
                points[c] = near
        if not points:
            break
        likelihoods(points)
    return fitted | {c: max(sorted(tried[c]), key=lambda x: tried[c][x]) for c in cols if max(tried[c].values()) > -math.inf}


def _vertex(a: tuple[float, float], b: tuple[float, float], c: tuple[float, float]) -> float | None:
    """Where the parabola through three points is highest, if it is a hill."""
    p, q = (b[0] - a[0]) * (b[1] - c[1]), (b[0] - c[0]) * (b[1] - a[1])
    if not math.isfinite(p - q) or p - q == 0:
        return None
    x = b[0] - ((b[0] - a[0]) * p - (b[0] - c[0]) * q) / (2 * (p - q))
    return x if a[0] < x < c[0] else None


def apply_yeo_johnson(df: DataFrame, lambdas: dict[str, float], standardize: bool = True,
                      suffix: str = "_yj") -> DataFrame:
    """M4 transform, then (y - mean) / std_pop as ``PowerTransformer`` does.
    Mean and std are a scalar-subquery struct of the same table."""
    out = df.withColumns({f"{c}{suffix}": yeo_johnson(F.col(c).cast("double"), lam) for c, lam in lambdas.items()})
    if not standardize:
        return out
    st = out.agg(F.struct(*[F.struct(F.avg(f"{c}{suffix}").alias("m"), F.stddev_pop(f"{c}{suffix}").alias("s"))
                            .alias(c) for c in lambdas]).alias("st")).scalar()
    return out.withColumns({f"{c}{suffix}": F.when(st[c]["s"] > 0, (F.col(f"{c}{suffix}") - st[c]["m"]) / st[c]["s"])
                            .otherwise(F.lit(0.0)) for c in lambdas})


def weight_features(df: DataFrame, weights: dict[str, float]) -> DataFrame:
    """M5: multiply columns by fixed weights."""
    return df.withColumns({c: F.col(c) * F.lit(float(w)) for c, w in weights.items()})
