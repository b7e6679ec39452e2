"""Independent sets over tables: members of groups of which no two chosen ones share a group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..sources.tables import written


def independent_members(df: DataFrame, group: str, member: str, order: Column) -> DataFrame:
    """(member, chosen, round): what a greedy walk in ``order`` (ties by member) would choose, found in rounds.

    In each round a member is chosen if it comes first in all its groups among those not decided yet; all others of its
    groups are then out. That gives the walk's choice: who is first everywhere can't be excluded any more. Groups are never
    paired out: a round is two aggregates and joins over (group, member), and about log(n) rounds are needed for orders
    by hash. Rows with a null group count as members without a group, null members are left out. ``order`` goes with every
    row through the shuffles of each round, so it should be short: a digest as bytes, not as text.
    """
    rows = df.filter(F.col(member).isNotNull()).select(F.col(group).alias("g"), F.col(member).alias("m"), order.alias("o")).distinct()
    rank = F.struct("o", "m")
    rows = written(rows, "members")
    single = rows.groupBy("m").agg(F.count("g").alias("n")).filter("n = 0").select("m", F.lit(True).alias("chosen"), F.lit(0).alias("round"))
    done, left, n = [single], rows.filter("g IS NOT NULL"), 0
    while not left.isEmpty():
        n += 1
        # Aggregates are written before rows are joined to them, so that Spark can split a large group.
        first = written(left.groupBy("g").agg(F.min(rank).alias("first")), "first")
        chosen = written(left.join(first, "g").groupBy("m").agg(F.min(rank == F.col("first")).alias("all")).filter("all").select("m"), "chosen")
        closed = written(left.join(chosen, "m", "left_semi").select("g").distinct(), "closed")
        out = written(left.join(closed, "g", "left_semi").select("m").distinct(), "out")
        done += [chosen.select("m", F.lit(True).alias("chosen"), F.lit(n).alias("round")), out.join(chosen, "m", "left_anti").select("m", F.lit(False).alias("chosen"), F.lit(n).alias("round"))]
        left = written(left.join(out, "m", "left_anti"), "left")
    return reduce(DataFrame.unionAll, done).select(F.col("m").alias(member), "chosen", "round")
