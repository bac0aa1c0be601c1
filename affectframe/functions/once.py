"""Computing a costly expression only once.

Catalyst substitutes expressions where they are used. A column that occurs several
times in an expression or inside a lambda, or that a later filter refers to, would be
computed again for each occurrence.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value bound to a lambda variable."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def with_column_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``withColumn`` whose expression later filters are not pushed into.

    A filter on a plain computed column moves below the projection and takes a copy of
    the expression with it. It does not move below a generator.
    """
    return df.withColumn(name, F.explode(F.array(value)))
