"""Trailing windows that give null unless they hold enough observations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def trailing(key: str, order: str, rows: int, lag: int = 0) -> WindowSpec:
    """The last `rows` rows of a key, the newest `lag` rows back."""
    return Window.partitionBy(key).orderBy(order).rowsBetween(-(rows + lag - 1), -lag)


def full(f: Callable[[str], Column], c: str, w: WindowSpec, least: int) -> Column:
    """f(c) over w, if at least `least` values of c are there."""
    return F.when(F.count(c).over(w) >= least, f(c).over(w))
