"""Helpers that keep a costly value from being evaluated more than once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate a value once and use it in several places of an expression."""
    return F.transform(F.array(value), body)[0]


def stage(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that is computed once per row.

    Filters on what derives from a plain column are pushed below it, with the expression copied into each place that
    uses it; parsed JSON would be parsed again for every field. Nothing is pushed below a generator, here of one row.
    The value is a column before the generator too: Spark's estimate of a table's size does not count what a generator adds, and takes off
    what is dropped later, so that without it a large table would be estimated at nothing, and broadcast.
    """
    own = f"{name}__value"
    return df.select("*", value.alias(own)).select("*", F.explode(F.array(own)).alias(name)).drop(own)
