"""Expressions that are worked out once, however often they are used."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once: it is the one element of an array that use goes over."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def settled(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that later filters and projections read, and never work out again: they aren't pushed below an explode."""
    return df.withColumn(name, F.explode_outer(F.array(value)))
