"""Positions: ordinals, next and previous rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def ordinals(df: DataFrame, by: str, *order: str) -> DataFrame:
    """``page`` from 1 and ``pages``."""
    w = Window.partitionBy(by)
    return df.withColumn("page", F.row_number().over(w.orderBy(*order)).cast("long")).withColumn("pages", F.count("*").over(w))


def next_and_previous(df: DataFrame, by: str, value: str, *order: str) -> DataFrame:
    """``following`` wraps to the first row; ``previous`` stays on it."""
    w = Window.partitionBy(by).orderBy(*order)
    first = F.first(value).over(w)
    return df.withColumn("following", F.coalesce(F.lead(value).over(w), first)).withColumn("previous", F.coalesce(F.lag(value).over(w), F.col(value)))


def play_next(df: DataFrame, by: str, url: str, *order: str) -> DataFrame:
    """Each distinct url at its first position, with the one before it and the one after it; no wrap."""
    w = Window.partitionBy(by)
    first = df.withColumn("__n", F.row_number().over(Window.partitionBy(by, url).orderBy(*order))).withColumn("__p", F.row_number().over(w.orderBy(*order)))
    following = F.lead(url).over(w.orderBy("__p"))
    return first.withColumn("following", following).withColumn("preceding", F.lag(url).over(w.orderBy("__p"))).filter("__n = 1").drop("__n").withColumnRenamed("__p", "position")
