"""Vector and probability expressions (higher-order functions, no UDF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dot(x, y) -> Column:
    prods = F.zip_with(_c(x).cast("array<double>"), _c(y).cast("array<double>"), lambda a, b: a * b)
    return F.aggregate(prods, F.lit(0.0), lambda acc, v: acc + F.coalesce(v, F.lit(0.0)))


def vector_cosine(x, y) -> Column:
    """Cosine of two dense vectors; 0.0 when either has zero norm (or is null)."""
    den = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
    return F.coalesce(F.try_divide(dot(x, y), F.when(den > 0, den)), F.lit(0.0))


def logistic_p(theta, z) -> Column:
    """Rasch probability 1 / (1 + exp(-(theta - z)))."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-(_c(theta) - _c(z))))


def fit_residuals(y, p) -> tuple[Column, Column]:
    """(standardised residual z, weight w) with w = p(1-p); z is null when w is 0."""
    w = _c(p) * (F.lit(1.0) - _c(p))
    z = F.try_divide(_c(y) - _c(p), F.sqrt(F.when(w > 0, w)))
    return z, w
