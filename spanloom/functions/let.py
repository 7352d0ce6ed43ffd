"""Naming a value inside an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, computed once however often ``body`` uses it; otherwise each use repeats the whole
    expression, and nested uses multiply."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
