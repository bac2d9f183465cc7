"""Equality, inequality and set filters over extracted values, combined with AND or OR."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklane.functions.extract import extract


def _check(values) -> None:
    if any(isinstance(v, float) for v in values):
        raise TypeError("floating-point operands are not allowed in equality filters")


def eq(df: DataFrame, spec: str, value) -> Column:
    _check([value])
    return extract(df, spec, strict=False) == F.lit(value)


def ne(df: DataFrame, spec: str, value) -> Column:
    _check([value])
    return extract(df, spec, strict=False) != F.lit(value)


def is_in(df: DataFrame, spec: str, values) -> Column:
    values = list(values)
    _check(values)
    return extract(df, spec, strict=False).isin(values)


def filter_all(df: DataFrame, *predicates: Column) -> DataFrame:
    """Rows passing every predicate; none given lets all rows pass, an unreadable value drops the row."""
    return df.filter(reduce(lambda a, b: a & b, predicates, F.lit(True)))


def filter_any(df: DataFrame, *predicates: Column) -> DataFrame:
    """Rows passing at least one predicate; none given lets all rows pass.

    Predicates are looked at in order: an unreadable value drops the row unless an earlier one passed.
    """
    if not predicates:
        return df
    passed = F.lit(False)
    for p in reversed(predicates):
        passed = F.when(p.isNull(), False).when(p, True).otherwise(passed)
    return df.filter(passed)
