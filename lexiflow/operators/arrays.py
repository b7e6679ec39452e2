"""Edits of lists: arrays in a column, whose positions count from 0, and tables of rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F


def replaced_at(values: Column, place: Column, value: Callable[[Column], Column]) -> Column:
    """The array with ``value(old)`` at ``place``; a place outside changes nothing."""
    return F.transform(values, lambda x, i: F.when(i == place, value(x)).otherwise(x))


def dropped_at(values: Column, place: Column) -> Column:
    """The array without the element at ``place``."""
    return F.filter(values, lambda x, i: ~F.coalesce(i == place, F.lit(False)))


def added(values: Column, value: Column) -> Column:
    """The set with ``value``; a set that has it stays as it is."""
    return F.array_union(values, F.array(value))


def index_of(values: Column, test: Callable[[Column], Column]) -> Column:
    """Place of the first element that passes, or -1."""
    places = F.filter(F.transform(values, lambda x, i: F.when(F.coalesce(test(x), F.lit(False)), i)), lambda i: i.isNotNull())
    return F.coalesce(F.get(places, F.lit(0)), F.lit(-1))


def first_where(values: Column, test: Callable[[Column], Column]) -> Column:
    """The first element that passes, or null."""
    return F.get(F.filter(values, test), F.lit(0))


def twice(df: DataFrame, name: str = "twin") -> DataFrame:
    """Every row two times, told apart by ``name`` 0 and 1."""
    return df.withColumn(name, F.explode(F.array(F.lit(0), F.lit(1))))


def updated_where(df: DataFrame, test: Column, **fields: Column) -> DataFrame:
    """The rows with new values in ``fields`` where ``test`` is true; where it is null they stay."""
    return df.withColumns({name: F.when(test, value).otherwise(F.col(name)) for name, value in fields.items()})


def without(df: DataFrame, column: str, value) -> DataFrame:
    """The rows whose ``column`` is not ``value``; rows without a value stay."""
    return df.filter(~F.col(column).eqNullSafe(F.lit(value)))
