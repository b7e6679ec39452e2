"""Seeded choices: the order of a seed's hashes stands for chance, so results are the same on every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def seeded(seed: str, *key: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(seed), *key))


def shuffled(df: DataFrame, key: str, seed: str) -> DataFrame:
    return df.orderBy(seeded(seed, F.col(key)), key)


def sample_n(df: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """``n`` rows; Spark keeps the best ``n`` of each partition, then of those."""
    return shuffled(df, key, seed).limit(n)


def sample_with(df: DataFrame, key: str, must: Column, n: int, seed: str) -> DataFrame:
    """The row that ``must`` holds for (the first by hash of several) and others that it doesn't hold for, ``n`` altogether.

    ``place`` is their order after a second shuffle, from 1; only the ``n`` rows chosen are numbered.
    """
    first = shuffled(df.filter(must), key, seed).limit(1)
    others = shuffled(df.filter(~F.coalesce(must, F.lit(False))), key, seed).limit(n)
    chosen = first.withColumn("other", F.lit(0)).unionByName(others.withColumn("other", F.lit(1)))
    chosen = chosen.orderBy("other", seeded(seed, F.col(key)), key).limit(n).drop("other")
    return chosen.withColumn("place", F.row_number().over(Window.orderBy(seeded(seed, F.lit("again"), F.col(key)), key)).cast("long"))


def pick_other(groups: DataFrame, pool: DataFrame, by: str, key: str, previous: str, seed: str) -> DataFrame:
    """For each row of ``groups`` one key of its pool by hash, not the previous one unless the pool holds no other.

    The two best of each pool are enough to choose from.
    """
    h = seeded(seed, F.col(key))
    best = pool.groupBy(by).agg(F.min(F.struct(h, key)).alias("one"))
    second = pool.join(best, by).filter(F.col(key) != F.col(f"one.{key}")).groupBy(by).agg(F.min(F.struct(h, key)).alias("two"))
    joined = groups.join(best, by).join(second, by, "left")
    return joined.withColumn("picked", F.when((F.col(f"one.{key}") == F.col(previous)) & F.col("two").isNotNull(), F.col(f"two.{key}")).otherwise(F.col(f"one.{key}"))).drop("one", "two")


def pick_with_replacement(x: Column, values: list[str], seed: str) -> Column:
    at = F.conv(F.substring(seeded(seed, x), 1, 8), 16, 10).cast("long") % len(values)
    return F.element_at(F.array(*map(F.lit, values)), (at + 1).cast("int"))


def preferred(df: DataFrame, by: str, rank: Column, key: str) -> DataFrame:
    """The row of least rank of each group, ties by key."""
    return df.groupBy(by).agg(F.min(F.struct(rank.alias("rank"), F.col(key))).alias("r")).select(by, f"r.{key}", "r.rank")


def first_of_group(df: DataFrame, by: str, key: str, n: int, seed: str) -> DataFrame:
    """``n`` rows of each group by hash order; the group limit is pushed below the shuffle by Spark."""
    w = Window.partitionBy(by).orderBy(seeded(seed, F.col(key)), key)
    return df.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)


def unit(seed: str, *key: Column) -> Column:
    """A number of [0, 1) from the hash of seed and key."""
    return F.conv(F.substring(seeded(seed, *key), 1, 8), 16, 10).cast("double") / float(1 << 32)


def whole_number(seed: str, low: int, high: int, *key: Column) -> Column:
    """A whole number of ``low`` to ``high``."""
    return F.lit(low) + F.floor(unit(seed, *key) * (high - low + 1)).cast("int")
