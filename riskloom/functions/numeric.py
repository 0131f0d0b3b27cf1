"""Money, rounding and safe arithmetic as JVM column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_cents(amount) -> Column:
    """Money with at most two decimals as exact integer cents."""
    return F.round(col_(amount) * 100).cast("bigint")


def cents_to_money(cents) -> Column:
    """Integer cents back to a two-decimal amount (exact for the display)."""
    return col_(cents).cast("double") / 100


def round_half_up(x, digits: int = 2) -> Column:
    """Round half away from zero on the binary value.

    ``sign(x) * floor(|x| * 10^d + 0.5) / 10^d``: the same operations in any
    IEEE engine give the same double, unlike decimal based ``round``.
    """
    scale = float(10 ** digits)
    x = col_(x)
    return F.signum(x) * F.floor(F.abs(x) * scale + 0.5).cast("double") / scale


def safe_div(num, den) -> Column:
    """``num / NULLIF(den, 0)`` as a double; NULL when den is 0 or NULL."""
    return col_(num).cast("double") / F.nullif(col_(den), F.lit(0)).cast("double")


def flag(cond: Column) -> Column:
    """``CASE WHEN cond THEN 1 ELSE 0 END``: a NULL condition gives 0."""
    return F.when(cond, F.lit(1)).otherwise(F.lit(0))


def share_pct(part, whole, digits: int = 2) -> Column:
    """``ROUND(part * 100.0 / whole, digits)`` as a double."""
    return round_half_up(col_(part).cast("double") * 100 / col_(whole).cast("double"), digits)
