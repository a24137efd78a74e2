"""Column expressions shared by the operators; all stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash32(*cols: Column | str, seed: str = "") -> Column:
    """A 32-bit number drawn from md5, the same in any engine and on any retry."""
    parts = [F.lit(seed)] + [F.col(c) if isinstance(c, str) else c for c in cols]
    digest = F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def finite(v: Column) -> Column:
    """NaN and both infinities become null."""
    bad = F.isnan(v) | (F.abs(v) == F.lit(float("inf")))
    return F.when(~bad, v)


def max_modulus(v: Column) -> Column:
    """Aggregate: the largest absolute value."""
    return F.max(F.abs(v))


def unbiased_skewness(v: Column, n: Column) -> Column:
    """Bias-corrected sample skewness; 0 for a constant column, null under 3 values."""
    g = F.skewness(v) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0))
    return F.when(n < 3, None).when(F.var_pop(v) == 0, 0.0).otherwise(g)


def unbiased_kurtosis(v: Column, n: Column) -> Column:
    """Bias-corrected excess kurtosis; 0 for a constant column, null under 4 values."""
    scale = (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0))
    g = scale * ((n + 1) * F.kurtosis(v) + 6)
    return F.when(n < 4, None).when(F.var_pop(v) == 0, 0.0).otherwise(g)


def order_of_magnitude(v: Column) -> Column:
    """floor(log10(|v|)); minus infinity for 0 and null."""
    return F.when(F.coalesce(v, F.lit(0.0)) == 0, F.lit(float("-inf"))).otherwise(
        F.floor(F.log10(F.abs(v))).cast("double"))


def zero_if_undefined(v: Column) -> Column:
    return F.coalesce(F.nanvl(v, F.lit(0.0)), F.lit(0.0))


def pearson(x: str, y: str) -> Column:
    """Aggregate: Pearson correlation, null where a side is constant (``corr`` raises in ANSI mode)."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    spread = F.stddev_pop(F.when(both, F.col(x))) * F.stddev_pop(F.when(both, F.col(y)))
    return F.covar_pop(x, y) / F.nullif(spread, F.lit(0.0))
