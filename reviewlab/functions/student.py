"""Student t probabilities and number formatting for result tables (a handful of rows per experiment)."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType


def paired_p_ten_runs(t: Column) -> Column:
    """Two-sided p of a t statistic with nine degrees of freedom, in closed form."""
    theta = F.atan(F.abs(t) / 3.0)
    c = F.cos(theta)
    series = c + c**3 * (2 / 3) + c**5 * (8 / 15) + c**7 * (48 / 105)
    return 1 - (theta + F.sin(theta) * series) * (2 / math.pi)


def _two_sided(t: float, df: float) -> float:
    """P(|T| > t) as the regularised incomplete beta function, by its continued fraction (Lentz)."""
    if not (math.isfinite(t) and df > 0):
        return math.nan if math.isnan(t) or not df > 0 else 0.0
    a, b, x = df / 2, 0.5, df / (df + t * t)
    if x >= 1:
        return 1.0
    if x <= 0:
        return 0.0
    flip = x > (a + 1) / (a + b + 2)
    if flip:
        a, b, x = b, a, t * t / (df + t * t)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    tiny = 1e-300
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), tiny)
    value = d
    for m in range(1, 500):
        for step in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1 / ((1 + step * d) or tiny)
            c = (1 + step / c) or tiny
            value *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    tail = front * value / a
    return 1 - tail if flip else tail


@F.pandas_udf(DoubleType())
def t_pvalue(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided p for any degrees of freedom; null statistics give null."""
    return pd.Series([_two_sided(x, n) for x, n in zip(t.astype("float64"), df.astype("float64"))]).where(t.notna())


@F.pandas_udf(StringType())
def fixed(value: pd.Series, digits: pd.Series) -> pd.Series:
    """``value`` with that many decimals, rounded on its exact binary value.

    The JVM formatter rounds the shortest decimal form instead, which differs on ties such as 0.155.
    """
    return pd.Series([None if pd.isna(v) else f"{v:.{d}f}" for v, d in zip(value, digits)], dtype="object")
