"""Turning array columns into rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unnest(df: DataFrame, keep: list, array: Column, name: str) -> DataFrame:
    """One row per array element.

    A plain ``explode`` makes the optimizer put ``size(array) > 0`` in front of
    it, which works a costly array out once more per check. The outer form does
    not; the rows it adds for empty arrays are dropped right after it.
    """
    return df.select(*keep, F.explode_outer(array).alias(name)).filter(F.col(name).isNotNull())
