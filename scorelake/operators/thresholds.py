"""Attach dataset thresholds to cases or runs, and read them as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.schemas import THRESHOLD_TYPES


def threshold_struct(defaults: dict, **overrides) -> Column:
    """One struct column with every threshold of a dataset kind."""
    unknown = set(overrides) - set(defaults)
    if unknown:
        raise ValueError(f"unknown thresholds: {sorted(unknown)}")
    values = {**defaults, **overrides}
    return F.struct(
        *[
            (v if isinstance(v, Column) else F.lit(v)).cast(THRESHOLD_TYPES.get(k, "double")).alias(k)
            for k, v in values.items()
        ]
    )


def attach_thresholds(df: DataFrame, datasets: DataFrame, defaults: dict, on: str = "dataset") -> DataFrame:
    """Join the thresholds of each dataset; datasets without metadata get the defaults.

    One row per dataset is read from the catalog. No broadcast is forced: Catalyst and AQE choose it when the
    catalog is small enough.
    """
    given = F.coalesce(F.col("_given"), threshold_struct(defaults))
    catalog = datasets.select(on, F.col("thresholds").alias("_given"))
    return df.join(catalog, on, "left").withColumn("thresholds", given).drop("_given")
