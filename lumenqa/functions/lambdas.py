"""Help for expressions with lambdas."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with the value computed once a row, though f uses it several times or within lambdas."""
    return F.element_at(F.transform(F.array(value), lambda x: f(x)), 1)
