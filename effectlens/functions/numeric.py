"""Numeric expressions that Spark lacks, as Column builders.

``erfc_sql`` gives one text that any ANSI engine reads: a series near zero and a
continued fraction beyond it, so that p-values keep their relative precision.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN = float("nan")


def erfc_sql(x: str, terms: int = 36) -> str:
    """erfc of a non-negative expression."""
    series = "1.0"
    for k in range(terms, 0, -1):
        series = f"(1.0 + 2.0*{x}*{x}/{2 * k + 1}.0*{series})"
    fraction = x
    for k in range(terms, 0, -1):
        fraction = f"({x} + {k / 2}/{fraction})"
    near = f"1.0 - {2 / math.sqrt(math.pi)!r}*exp(-{x}*{x})*{x}*{series}"
    return f"CASE WHEN {x} < 2.0 THEN {near} ELSE exp(-{x}*{x})/({math.sqrt(math.pi)!r}*{fraction}) END"


def ratio(a: Column, b: Column, empty: float | None = NAN) -> Column:
    """a / b as double; ``empty`` where b is 0 or either is null."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(empty))


def defined(x: Column) -> Column:
    """Non-null, non-NaN and non-zero: the value has a direction (infinities do)."""
    return x.isNotNull() & ~F.isnan(x) & (x != 0)


def pearson(n: Column, sx: Column, sy: Column, sxx: Column, syy: Column, sxy: Column) -> Column:
    """Pearson correlation from sums; NaN without two points or without variance."""
    vx, vy = n * sxx - sx * sx, n * syy - sy * sy
    fine = (n >= 2) & (vx > 1e-12) & (vy > 1e-12)
    return F.when(fine, (n * sxy - sx * sy) / F.sqrt(F.when(fine, vx * vy).otherwise(F.lit(1.0)))).otherwise(F.lit(NAN))


def log2_ratio(m: Column, ref: Column, epsilon: float, clip: float | None = None) -> Column:
    """log2((m + e) / (ref + e)); with ``clip`` c, 0/0 is 1, x/0 is c and 0/x is 1/c."""
    if clip is not None:
        r = F.when((m == 0) & (ref == 0), F.lit(1.0)).when(ref == 0, F.lit(float(clip))).when(m == 0, F.lit(1.0 / clip)).otherwise(F.try_divide(m, ref))
        return F.log2(r)
    a, b = m + epsilon, ref + epsilon
    inf = F.lit(float("inf"))
    return F.when((a > 0) & (b > 0), F.log2(F.try_divide(a, b))).when((a == 0) & (b == 0), F.lit(NAN)).when(a == 0, -inf).otherwise(inf)
