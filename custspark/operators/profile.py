"""Profiles and grouped statistics.

Rule of thumb used throughout: one aggregate per table (all columns in a
single pass), then ``stack``/``explode`` into a long table.  Grand totals
that a per-group figure needs are scalar subqueries, never a window over
the whole table.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .clean import null_count, numeric_columns, string_columns
from .quantiles import medians, quantiles


def _long(row: DataFrame, structs: list[Column]) -> DataFrame:
    """One-row frame of structs -> one row per struct."""
    return row.select(F.explode(F.array(*structs)).alias("_r")).select("_r.*")


# A2, A3, A4, A5, A6, A7, A8 -------------------------------------------------

def groups_with_many_values(df: DataFrame, key: str, col: str, min_values: int = 2) -> DataFrame:
    """A2: groups where ``col`` takes at least ``min_values`` distinct
    non-null values."""
    return (df.groupBy(key).agg(F.countDistinct(col).alias("n_values"))
            .where(F.col("n_values") >= min_values))


def value_counts(df: DataFrame, col: str, top: int | None = None, dropna: bool = True) -> DataFrame:
    """A4: ``(value, count)`` by descending count, ties by value; optional
    top ``n`` (a take-ordered: k rows per partition move)."""
    src = df.where(F.col(col).isNotNull()) if dropna else df
    vc = src.groupBy(col).agg(F.count(F.lit(1)).alias("count"))
    if top is not None:
        vc = vc.orderBy(F.desc("count"), F.asc_nulls_last(col)).limit(top)
    return vc


def value_share(df: DataFrame, col: str, places: int = 2) -> DataFrame:
    """A5: percent of rows per value (half-even to ``places``), rows without a value left
    out of the list and of the total.  The total is a scalar subquery, not a window over
    the whole table."""
    df = df.where(F.col(col).isNotNull())
    total = df.agg(F.count(F.lit(1))).scalar()
    return (df.groupBy(col).agg(F.count(F.lit(1)).alias("count"))
            .withColumn("share_pct", F.bround(F.col("count") * F.lit(100.0) / total, places)))


def count_of_counts(df: DataFrame, key: str, out: str = "n") -> DataFrame:
    """How many keys occur ``n`` times (a null is no key)."""
    return (df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias(out))
            .groupBy(out).agg(F.count(F.lit(1)).alias("groups")))


def rate_by_category(df: DataFrame, cat: str, flag: str, out: str = "rate") -> DataFrame:
    """Mean of a 0/1 flag per category (a null is no category)."""
    return df.where(F.col(cat).isNotNull()).groupBy(cat).agg(F.avg(flag).alias(out), F.count(F.lit(1)).alias("rows"))


def top_sums(df: DataFrame, cat: str, col: str, top: int = 10, out: str = "total") -> DataFrame:
    """Sum per category, the ``top`` largest (ties by category; a null is no category)."""
    return (df.where(F.col(cat).isNotNull()).groupBy(cat).agg(F.sum(col).alias(out))
            .orderBy(F.desc(out), F.asc(cat)).limit(top))


def means_by_class(df: DataFrame, target: str, cols: Sequence[str], classes: Sequence) -> DataFrame:
    """Per feature the mean in each class, classes as columns
    (``groupby(t)[cols].mean().T``).  Explicit class values keep the pivot
    to one pass."""
    means = df.groupBy(target).agg(*[F.avg(c).alias(c) for c in cols])
    long = means.unpivot(target, list(cols), "feature", "mean")
    return (long.groupBy("feature").pivot(target, list(classes)).agg(F.first("mean"))
            .withColumnsRenamed({str(v): f"class_{v}" for v in classes}))


# A13, A17, A18 ---------------------------------------------------------------

def entity_counts(df: DataFrame, cols: Sequence[str], approx: bool = False) -> DataFrame:
    """Distinct count per column, one row (``approx`` = HyperLogLog++,
    bounded memory for very large domains)."""
    f = (lambda c: F.approx_count_distinct(c)) if approx else (lambda c: F.countDistinct(c))
    return df.agg(*[f(c).alias(f"n_{c}") for c in cols])


def duplicate_counts(df: DataFrame, keys: Sequence[Sequence[str]]) -> DataFrame:
    """``duplicated(subset).sum()`` for whole rows and for each key set:
    rows minus distinct tuples.  Tuples are structs so rows with nulls count
    as values too."""
    sets = [list(df.columns)] + [list(k) for k in keys]
    names = ["all_columns"] + ["+".join(k) for k in keys]
    aggs = [F.count(F.lit(1)).alias("rows")]
    aggs += [F.count_distinct(F.struct(*k)).alias(f"d{i}") for i, k in enumerate(sets)]
    row = df.agg(*aggs)
    return _long(row, [F.struct(F.lit(n).alias("subset"),
                                (F.col("rows") - F.col(f"d{i}")).alias("duplicates"))
                       for i, n in enumerate(names)])


# A19-A21 ---------------------------------------------------------------------

def missing_report(df: DataFrame, places: int = 2) -> DataFrame:
    """Per column the missing count and percent (half-even)."""
    cols = df.columns
    row = df.agg(F.count(F.lit(1)).alias("_n"),
                 *[F.count_if(F.col(c).isNull()).alias(f"m_{i}") for i, c in enumerate(cols)])
    return _long(row, [F.struct(F.lit(c).alias("column"), F.col(f"m_{i}").alias("missing"),
                                F.bround(F.col(f"m_{i}") * F.lit(100.0) / F.col("_n"), places)
                                .alias("missing_pct"))
                       for i, c in enumerate(cols)])


def null_count_distribution(df: DataFrame) -> DataFrame:
    """How many rows have 0, 1, 2 ... nulls."""
    return (df.select(null_count(df.columns).alias("nulls_in_row"))
            .groupBy("nulls_in_row").agg(F.count(F.lit(1)).alias("rows")))


def cardinality(df: DataFrame, cols: Sequence[str] | None = None, approx: bool = False) -> DataFrame:
    """Distinct non-null values of every text column.  Exact distinct
    counts of several columns expand the rows once per column before the
    shuffle; ``approx`` (HyperLogLog++) needs one small sketch per column."""
    cols = list(cols or string_columns(df))
    f = (lambda c: F.approx_count_distinct(c, 0.01)) if approx else (lambda c: F.countDistinct(c))
    row = df.agg(*[f(c).alias(f"c_{i}") for i, c in enumerate(cols)])
    return _long(row, [F.struct(F.lit(c).alias("column"), F.col(f"c_{i}").alias("distinct_values"))
                       for i, c in enumerate(cols)])


# A22, A23, A24 ---------------------------------------------------------------

def numeric_profile(df: DataFrame, cols: Sequence[str] | None = None, exact: bool = True) -> DataFrame:
    """``describe()``: count, mean, sample std, min, quartiles, max.
    ``exact`` quartiles interpolate like pandas (bounded-memory refinement,
    :mod:`.quantiles`); ``exact=False`` uses one ``percentile_approx``."""
    cols = list(cols or numeric_columns(df))
    if exact:
        qs = quantiles(df, cols, [0.25, 0.5, 0.75])
        qcol = {c: F.array(*[F.lit(v).cast("double") for v in qs[c]]) for c in cols}
    else:
        qcol = {c: F.percentile_approx(F.col(c).cast("double"), [0.25, 0.5, 0.75], 10000) for c in cols}
    structs = [F.struct(F.lit(c).alias("column"), F.count(c).alias("count"),
                        F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"),
                        F.min(F.col(c).cast("double")).alias("min"), qcol[c].alias("_q"),
                        F.max(F.col(c).cast("double")).alias("max")).alias(f"s_{i}")
               for i, c in enumerate(cols)]
    return (_long(df.agg(*structs), [F.col(f"s_{i}") for i in range(len(cols))])
            .select("column", "count", "mean", "std", "min",
                    F.col("_q")[0].alias("q25"), F.col("_q")[1].alias("median"),
                    F.col("_q")[2].alias("q75"), "max"))


def skew_profile(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Mean, median and bias-corrected skew (pandas ``skew``).  Spark's
    ``skewness`` is the population form g1; G1 = g1 * sqrt(n(n-1)) / (n-2)."""
    med = medians(df, list(cols))
    structs = []
    for i, c in enumerate(cols):
        n = F.count(c).cast("double")
        g1 = F.skewness(c)
        structs.append(F.struct(F.lit(c).alias("column"), F.avg(c).alias("mean"),
                                F.lit(med[c]).cast("double").alias("median"),
                                F.when(n > 2, g1 * F.sqrt(n * (n - 1)) / (n - 2)).alias("skew"))
                       .alias(f"s_{i}"))
    return _long(df.agg(*structs), [F.col(f"s_{i}") for i in range(len(cols))])


def correlation_long(df: DataFrame, cols: Sequence[str], target: str | None = None) -> DataFrame:
    """Pairwise-complete Pearson correlations in one aggregate, long
    form ``(a, b, corr)``; with ``target`` only the pairs with the target."""
    cols = list(cols)
    pairs = ([(c, target) for c in cols if c != target] if target
             else [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]])
    row = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"r_{i}")
                   for i, (a, b) in enumerate(pairs)])
    return _long(row, [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r_{i}").alias("corr"))
                       for i, (a, b) in enumerate(pairs)])


# A25, A26, A27, A28, A29, A30 ---------------------------------------------------

def equal_width_bins(df: DataFrame, col: str, bins: int = 10, right_closed: bool = True) -> DataFrame:
    """Equal-width bins over [min, max] with counts.
    ``right_closed`` = ``pd.cut`` (bins (a, b], the minimum falls in bin 1);
    otherwise the numpy ``histogram`` form [a, b) with the maximum in the
    last bin.  Empty bins count 0; a column without values has no bins."""
    x = F.col(col).cast("double")
    ends = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
    mm = ends.select(F.struct("lo", "hi").alias("m")).scalar()
    width = (mm["hi"] - mm["lo"]) / F.lit(float(bins))
    pos = (x - mm["lo"]) / width
    b = F.greatest(F.lit(1), F.ceil(pos)) if right_closed else F.floor(pos) + F.lit(1)
    b = F.when(width == 0, F.lit(1)).otherwise(F.least(F.lit(bins), b)).cast("int")
    counts = df.where(x.isNotNull()).select(b.alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    step = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    # one row a bin, whether it holds rows or not
    every = (ends.where(F.col("lo").isNotNull()).select("lo", step.alias("step"), F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin")))
    return every.join(counts, "bin", "left").select(
        "bin", F.coalesce("n", F.lit(0)).alias("count"), (F.col("lo") + (F.col("bin") - 1) * F.col("step")).alias("lower"),
        (F.col("lo") + F.col("bin") * F.col("step")).alias("upper"))


def conditional_counts(df: DataFrame, predicates: dict[str, Column], total: str = "total") -> DataFrame:
    """Row count and one ``count_if`` per named predicate, one pass."""
    return df.agg(F.count(F.lit(1)).alias(total),
                  *[F.count_if(F.coalesce(p, F.lit(False))).alias(n) for n, p in predicates.items()])


def predicate_share(df: DataFrame, pred: Column, out: str = "share_pct") -> DataFrame:
    """Percent of rows meeting a predicate."""
    return df.agg((F.avg(F.coalesce(pred, F.lit(False)).cast("int")) * F.lit(100.0)).alias(out))


def iqr_outliers(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Per numeric column the count of values outside the 1.5 IQR
    fences (strict); columns without outliers are left out.  Pass 1 finds
    the exact quartiles (bounded memory), pass 2 is one aggregate of
    conditional counts against literal fences."""
    cols = list(cols or numeric_columns(df))
    qs = quantiles(df, cols, [0.25, 0.75])
    aggs = []
    for i, c in enumerate(cols):
        q1, q3 = qs[c]
        x = F.col(c).cast("double")
        if q1 is None:
            cnt = F.lit(0).cast("long")
        else:
            iqr = q3 - q1
            cnt = F.count_if((x < F.lit(q1 - 1.5 * iqr)) | (x > F.lit(q3 + 1.5 * iqr)))
        aggs.append(F.struct(F.lit(c).alias("column"), cnt.alias("outliers")).alias(f"o{i}"))
    return (_long(df.agg(*aggs), [F.col(f"o{i}") for i in range(len(cols))])
            .where(F.col("outliers") > 0))


def class_ratio(df: DataFrame, label: str, positive=1) -> DataFrame:
    """``sqrt(negatives / positives)`` (weight for the positive class)."""
    pos = F.count_if(F.col(label) == positive)
    neg = F.count_if(F.col(label) != positive)
    return df.agg(pos.alias("positives"), neg.alias("negatives"),
                  F.sqrt(F.try_divide(neg.cast("double"), pos.cast("double"))).alias("ratio"))


def suffix_counts(df: DataFrame, col: str) -> DataFrame:
    """Trailing letters of a text, counted (no letters -> not counted)."""
    suf = F.regexp_extract(F.col(col), r"([A-Za-z]+)$", 1)
    return (df.select(F.when(suf == "", F.lit(None)).otherwise(suf).alias("suffix"))
            .where(F.col("suffix").isNotNull())
            .groupBy("suffix").agg(F.count(F.lit(1)).alias("count")))


def contingency(df: DataFrame, a: str, b: str, b_values: Sequence) -> DataFrame:
    """``pd.crosstab(a, b)``: one row per value of ``a``, one count
    column per listed value of ``b`` (absent pairs are 0; rows with a null are left out)."""
    return (df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a).pivot(b, list(b_values)).agg(F.count(F.lit(1))).na.fill(0)
            .withColumnsRenamed({str(v): f"{b}_{v}" for v in b_values}))


# M12 ------------------------------------------------------------------------


def _chi2_sf(x: float, dof: int) -> float:
    """Upper tail of the chi-square law: Q(dof/2, x/2), regularised upper
    incomplete gamma by series / continued fraction."""
    if x is None or dof is None or dof <= 0 or x != x:
        return float("nan")
    a, z = dof / 2.0, x / 2.0
    if z <= 0:
        return 1.0
    gln = math.lgamma(a)
    if z < a + 1:
        term = total = 1.0 / a
        ap = a
        for _ in range(1000):
            ap += 1
            term *= z / ap
            total += term
            if abs(term) < abs(total) * 1e-15:
                break
        return max(0.0, 1.0 - total * math.exp(-z + a * math.log(z) - gln))
    b = z + 1 - a
    c = 1.0 / 1e-300
    d = 1.0 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = 1e-300 if abs(d) < 1e-300 else d
        c = b + an / c
        c = 1e-300 if abs(c) < 1e-300 else c
        d = 1.0 / d
        delta = d * c
        h *= delta
        if abs(delta - 1) < 1e-15:
            break
    return math.exp(-z + a * math.log(z) - gln) * h


def chi_square(df: DataFrame, a: str, b: str, with_p: bool = True) -> DataFrame:
    """Chi-square test of independence of two columns.  Cells, row and
    column totals are grouped counts; expected counts of the cells that
    occur come from joins of the margin tables, the others from the totals.  With one degree of freedom Yates'
    continuity correction is applied (as the usual scipy default).  The
    p-value of the one-row result is a small Arrow-batched Python step."""
    cells = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(
        F.count(F.lit(1)).alias("o"))
    ra = cells.groupBy(a).agg(F.sum("o").alias("ra"))
    cb = cells.groupBy(b).agg(F.sum("o").alias("cb"))
    tot = cells.agg(F.sum("o")).scalar()
    dims = cells.agg(F.struct(F.countDistinct(a).alias("r"), F.countDistinct(b).alias("c")).alias("d")).scalar()
    dof = (dims["r"] - 1) * (dims["c"] - 1)
    e = F.col("ra") * F.col("cb") / tot
    diff = F.abs(F.col("o") - e)
    sums = cells.join(ra, a).join(cb, b).agg(F.sum(diff * diff / e).alias("x"), F.sum(e).alias("e"), F.max(diff).alias("d"))
    # an empty cell adds its expected count, and all of those together are what the other cells leave of the total;
    # the four cells of a 2 x 2 table differ equally from their expected counts
    plain = F.col("x") + F.greatest(tot - F.col("e"), F.lit(0.0))
    inverse = ra.agg(F.sum(1 / F.col("ra"))).scalar() * cb.agg(F.sum(1 / F.col("cb"))).scalar() * tot
    yates = F.pow(F.greatest(F.col("d") - F.lit(0.5), F.lit(0.0)), 2) * inverse
    stat = sums.select(F.when(dof == 1, yates).otherwise(plain).alias("statistic"), dof.cast("long").alias("dof"))
    if not with_p:
        return stat

    def add_p(batches):
        for pdf in batches:
            pdf["p_value"] = [_chi2_sf(x, int(k)) for x, k in zip(pdf["statistic"], pdf["dof"])]
            yield pdf

    return stat.mapInPandas(add_p, "statistic double, dof long, p_value double")
