"""Helpers for building expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with value evaluated once, however often f uses it, also inside lambdas: it's bound as the only element of an array."""
    return F.get(F.transform(F.array(value), f), F.lit(0))
