"""Exact integer rounding, so that a rounded metric never depends on summation order.

Arguments are SQL expressions, which also keeps building a plan cheap.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio_round(num: str, den: str, digits: int, scale: int = 1) -> Column:
    """``round(scale * num / den, digits)`` half up for non-negative integers; 0 where ``den`` is 0."""
    k = 10**digits
    return F.expr(
        f"CASE WHEN ({den}) > 0 THEN CAST((({num}) * {2 * k * scale}L + ({den})) div (2L * ({den})) AS DOUBLE) / {k}D "
        "ELSE 0D END"
    )


def double_round(value: str, digits: int) -> Column:
    """Half-up rounding of a non-negative double."""
    k = 10**digits
    return F.expr(f"CAST(floor(({value}) * {k}D + 0.5D) AS DOUBLE) / {k}D")


def population_stdev(n: str, total: str, squares: str) -> str:
    """SQL of the population stdev from the sums n, sum(x), sum(x*x); decimals keep the difference exact."""
    spread = (
        f"CAST({n} AS DECIMAL(12, 0)) * CAST({squares} AS DECIMAL(25, 0)) "
        f"- CAST({total} AS DECIMAL(18, 0)) * CAST({total} AS DECIMAL(18, 0))"
    )
    return f"CASE WHEN {n} > 0 THEN sqrt(greatest(CAST({spread} AS DOUBLE), 0D)) / CAST({n} AS DOUBLE) ELSE 0D END"
