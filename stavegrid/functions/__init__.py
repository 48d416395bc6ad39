"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_even(c: Column) -> Column:
    """Round half to even, as an int."""
    return F.rint(c).cast("int")
