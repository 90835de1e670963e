"""Numeric helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_to(c: Column | str, decimals: int = 2) -> Column:
    """Round a DOUBLE by its binary value: ``round(x * 10^d) / 10^d``, ties
    away from zero.

    ``F.round(x, 2)`` rounds the shortest decimal *string* of x half-up, so
    275.655 (stored as 275.65499...) becomes 275.66; Python's ``round`` -- and
    therefore the reference -- gives 275.65. Scaling first keeps the binary
    value: ``round(x * 100, 0)`` is exact on the scaled double (its decimal
    string cannot cross the .5 tie), then one division brings it back."""
    c = F.col(c) if isinstance(c, str) else c
    m = float(10 ** decimals)
    return F.round(c * m, 0) / m


def round_cents(c: Column | str) -> Column:
    return round_to(c, 2)
