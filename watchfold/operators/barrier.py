"""Expressions that must be evaluated once per row, and typed nulls."""

from __future__ import annotations

from functools import lru_cache

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, name: str, expression: Column, keep: list[str] | None = None) -> DataFrame:
    """``df`` (or its columns ``keep``) plus ``name``, computed exactly once.

    A filter above a projection is pushed below it with the projected expression
    copied into every place it is used; forty predicates over a parsed document
    would parse it forty times. A one-element ``explode`` is the same row, but
    its output is an attribute that nothing is copied through.
    """
    columns = ["*"] if keep is None else keep
    return df.select(*columns, F.explode(F.array(expression)).alias(name))


def null_of(type_name: str) -> Column:
    """A typed null. Wide projections need hundreds, so they are kept."""
    return _null(type_name, id(SparkContext._active_spark_context))


@lru_cache(maxsize=None)
def _null(type_name: str, context: int) -> Column:
    return F.lit(None).cast(type_name)
