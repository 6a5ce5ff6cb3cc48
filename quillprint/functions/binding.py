"""Computing a value once within one expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once per row.

    A Column used in several places is an expression repeated in several places; inside the lambda of an array
    function it is even computed anew for every element.
    """
    return F.transform(F.array(value), use)[0]
