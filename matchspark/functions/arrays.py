"""Small helpers for array functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, make: Callable[[Column], Column]) -> Column:
    """make(value) with the value computed once, wherever and however often it stands in what is made, lambdas included."""
    return F.get(F.transform(F.array(value), make), F.lit(0))
