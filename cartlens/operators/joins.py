"""Joins against fitted tables."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def attach(df: DataFrame, table: DataFrame, keys: Mapping[str, Column],
           null_safe: bool = False) -> DataFrame:
    """Left join: the other columns of ``table``, whose columns ``keys`` are
    unique together, for the rows of ``df`` that give these values.

    The planner chooses: a table that is small at run time is broadcast, a
    larger one is shuffled and its skewed keys are split. ``null_safe`` matches
    NULL to NULL.
    """
    named = {c: f"_key_{c}" for c in keys}
    right = table.withColumnsRenamed(named)
    on = [e.eqNullSafe(F.col(named[c])) if null_safe else e == F.col(named[c])
          for c, e in keys.items()]
    return df.join(right, reduce(and_, on), "left").drop(*named.values())
