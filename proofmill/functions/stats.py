"""Statistics as column expressions. "Not measured" is null, never zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Z95 = 1.959963984540054


def share(part: Column, whole: Column) -> Column:
    return F.when(whole != 0, part / whole)


def wilson(k: Column, n: Column) -> tuple[Column, Column]:
    """The 95 % interval of k of n, within [0, 1]; null where n is 0. In doubles: the square of a number of pairs is beyond a bigint."""
    n = F.nullif(n, F.lit(0)).cast("double")
    p, z2 = k / n, Z95 * Z95
    middle = (p + z2 / (2 * n)) / (1 + z2 / n)
    half = Z95 / (1 + z2 / n) * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))
    return F.when(n.isNotNull(), F.greatest(middle - half, F.lit(0.0))), F.when(n.isNotNull(), F.least(middle + half, F.lit(1.0)))


def wilson_sql(k: str, n: str) -> tuple[str, str]:
    p, z2 = f"({k} / nullif({n}, 0))", f"({Z95}::DOUBLE * {Z95}::DOUBLE)"
    middle = f"(({p} + {z2} / (2 * {n})) / (1 + {z2} / {n}))"
    half = f"({Z95}::DOUBLE / (1 + {z2} / {n}) * sqrt({p} * (1 - {p}) / {n} + {z2} / (4 * {n} * {n})))"
    return f"CASE WHEN {n} > 0 THEN greatest({middle} - {half}, 0.0) END", f"CASE WHEN {n} > 0 THEN least({middle} + {half}, 1.0) END"


def money(tokens_in: Column, tokens_out: Column, cached: Column, p_in: Column, p_out: Column, p_cached: Column) -> Column:
    """Cost in millionths rounded half up to six places; null for an unpriced tier, 0 for a price of 0."""
    d = lambda c: c.cast("decimal(20,0)")
    fresh = F.greatest(tokens_in - cached, F.lit(0))
    return F.round((d(fresh) * p_in + d(tokens_out) * p_out + d(cached) * p_cached) / F.lit(1_000_000).cast("decimal(7,0)"), 6).cast("decimal(18,6)")
