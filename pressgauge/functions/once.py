"""Expensive columns that later filters read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_columns_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Like `withColumns`, but each expression is evaluated once per row.

    A filter on a plain derived column is pushed below the projection with a copy of its
    expression, so a pattern over a whole text would run in the filter and again in the
    projection. The output of a one-element `inline` is not copied that way.
    """
    packed = F.struct(*[expression.alias(name) for name, expression in columns.items()])
    return df.select("*", F.inline(F.array(packed)))
