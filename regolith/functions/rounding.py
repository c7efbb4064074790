"""Rounding of doubles as SQL does it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(value: str | Column, places: int) -> Column:
    """``value`` times a power of ten, halves of that product rounded away from zero, and divided again. F.round() rounds the
    shortest decimal text of a double instead, so the two part where a double is not quite the half that it is written as;
    and what is negative and comes to zero stays -0.0 here."""
    scaled = (F.col(value) if isinstance(value, str) else value) * 10.0**places
    near = F.rint(scaled)
    return F.when(F.abs(scaled - near) == 0.5, scaled + F.signum(scaled) * 0.5).otherwise(near) / 10.0**places
