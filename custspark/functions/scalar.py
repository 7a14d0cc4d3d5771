"""Scalar column functions.

All of them compose built-in expressions; none is a Python UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _c(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- cleaning -----------------------------------------------------------

def numeric_coerce(c: ColumnOrName) -> Column:
    """Strip every character that is not a digit or a dot, then read the
    rest as a double; text that is still no number becomes NULL (the
    ``errors='coerce'`` contract).  ``try_cast`` keeps ANSI mode from
    raising.  Minus signs are stripped too, as in the original rule."""
    stripped = F.regexp_replace(_c(c).cast("string"), r"[^\d.]", "")
    return F.when(stripped == "", F.lit(None).cast("double")).otherwise(stripped.try_cast("double"))


def round_half_even(c: ColumnOrName, scale: int = 0) -> Column:
    """Numpy / pandas ``round`` is half-to-even; Spark's is ``bround``."""
    return F.bround(_c(c), scale)


def round_to_long(c: ColumnOrName) -> Column:
    """``.round().astype(int64)``: half-even to an integer, NULL stays NULL."""
    return F.bround(_c(c), 0).cast("long")


def zero_pad(c: ColumnOrName, width: int = 4) -> Column:
    """``str(i).zfill(width)``.  ``lpad`` alone would cut longer values,
    so the target length is never below the value's own length."""
    s = _c(c).cast("string")
    return F.lpad(s, F.greatest(F.lit(width), F.length(s)), F.lit("0"))


def replace_letter(c: ColumnOrName, old: str, new: str) -> Column:
    """``str.replace(old, new)`` on every occurrence."""
    return F.replace(_c(c), F.lit(old), F.lit(new))


# --- customer features --------------------------------------------------

def purchase_intensity(orders: ColumnOrName = "Total_Orders_This_Month",
                       spend: ColumnOrName = "Total_Amount_Spent") -> Column:
    """orders x spend / 1000."""
    return _c(orders) * _c(spend) / F.lit(1000.0)


def avg_spend_per_order(spend: ColumnOrName = "Total_Amount_Spent",
                        orders: ColumnOrName = "Total_Orders_This_Month") -> Column:
    """spend / (orders + 1); the +1 keeps zero-order customers finite."""
    return _c(spend) / (_c(orders) + F.lit(1.0))


def recency(days: ColumnOrName = "Days_Since_Last_Order") -> Column:
    """recency is the days since the last order."""
    return _c(days)


def log1p_target(c: ColumnOrName) -> Column:
    """F4 forward transform of the value target."""
    return F.log1p(_c(c))


def expm1_target(c: ColumnOrName) -> Column:
    """F4 inverse transform."""
    return F.expm1(_c(c))


def clip(c: ColumnOrName, lower: float | None = None, upper: float | None = None) -> Column:
    """pandas ``clip``.  ``greatest``/``least`` skip NULLs, pandas keeps
    NaN, so NULL is passed through explicitly."""
    x = _c(c)
    out = x
    if lower is not None:
        out = F.greatest(out, F.lit(lower))
    if upper is not None:
        out = F.least(out, F.lit(upper))
    return F.when(x.isNull(), F.lit(None)).otherwise(out)


# Eco label names and score edges used by the green model.
ECO_WARRIOR = "Eco_Warrior"
ECO_CONSCIOUS = "Eco_Conscious"
LOW_INTEREST = "Low_Interest"
ECO_LABELS = (ECO_CONSCIOUS, ECO_WARRIOR, LOW_INTEREST)
ECO_WARRIOR_MIN = 0.7
ECO_CONSCIOUS_MIN = 0.4


def eco_label(green_class: ColumnOrName, score: ColumnOrName,
              round_first: bool = True) -> Column:
    """class 1 with score >= 0.7 is a warrior, class 1 with
    0.4 <= score < 0.7 is conscious, everything else low interest.
    Training rounds the score to two places (half-even) before labelling;
    ``round_first=False`` gives the dashboard reading."""
    s = F.bround(_c(score), 2) if round_first else _c(score)
    k = _c(green_class)
    return (F.when((k == 1) & (s >= ECO_WARRIOR_MIN), F.lit(ECO_WARRIOR))
            .when((k == 1) & (s >= ECO_CONSCIOUS_MIN), F.lit(ECO_CONSCIOUS))
            .otherwise(F.lit(LOW_INTEREST)))


def eco_score_pct(score: ColumnOrName) -> Column:
    """``(score * 100).round(1)``, half-even."""
    return F.bround(_c(score) * F.lit(100.0), 1)


def threshold(p: ColumnOrName, cut: float = 0.5) -> Column:
    """F8: strict ``p > cut`` as 0.0/1.0."""
    return (_c(p) > F.lit(cut)).cast("double")


def is_text_one(c: ColumnOrName) -> Column:
    """``astype(str).str.strip() == '1'``."""
    return F.coalesce(F.trim(_c(c).cast("string")) == F.lit("1"), F.lit(False))


def items_text(items: ColumnOrName, sep: str = ", ") -> Column:
    """sorted items joined to one text."""
    return F.array_join(F.array_sort(_c(items)), sep)


def rule_text(antecedents: ColumnOrName, consequents: ColumnOrName) -> Column:
    """``'a, b -> c'``."""
    return F.concat_ws(" -> ", items_text(antecedents), items_text(consequents))


def parse_timestamp(c: ColumnOrName) -> Column:
    """lenient timestamp parse; text that is no timestamp gives NULL."""
    return F.try_to_timestamp(_c(c).cast("string"))


def pct_change(value: ColumnOrName, base: ColumnOrName) -> Column:
    """``(v - b) / b * 100`` and 0 when the base is 0."""
    b = _c(base)
    return F.when(b == 0, F.lit(0.0)).otherwise((_c(value) - b) / b * F.lit(100.0))
