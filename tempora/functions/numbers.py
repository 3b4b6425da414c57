"""Column builders over doubles whose last bit matters: a tie falls the same way wherever it is computed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(c: Column | str, digits: int) -> Column:
    """A double to so many decimals, halves away from zero, as SQL engines in C round: the double scaled, rounded, scaled back.

    ``F.round`` rounds the shortest decimal that stands for the double: 50.00055 to four decimals is 50.0006 by it, but 50.0005 here.
    """
    scale = float(10**digits)
    return F.round((F.col(c) if isinstance(c, str) else c).cast("double") * scale, 0) / scale


def between(low: Column, high: Column, share: Column) -> Column:
    """low * (1 - share) + high * share, the first product and the sum rounded once."""
    return F.reflect(F.lit("java.lang.Math"), F.lit("fma"), low, 1 - share, high * share).cast("double")
