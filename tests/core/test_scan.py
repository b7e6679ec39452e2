"""Scans over keys that span many blocks, against loops."""

import random

import pytest
from lexiflow.operators import scan as S
from pyspark.sql import functions as F


def greedy(events, pause):
    out, last = [], {}
    for who, us, key in sorted(events, key=lambda e: (e[0] is not None, e[0] or 0, e[1], e[2])):
        if who not in last or us - last[who] >= pause:
            last[who] = us
            out.append((who, key, us))
    return sorted(out, key=str)


@pytest.mark.parametrize("pause", [1, 7, 40, 5000])
@pytest.mark.parametrize("users", [1, 3, 60])
def test_cooldown(spark, pause, users):
    r = random.Random(pause * users)
    events = [(r.choice([None, 0, 0, 0, *range(users)]), r.randrange(3000), i) for i in range(1500)]
    df = spark.createDataFrame([(w, k, us) for w, us, k in events] + [(1, 9999, None)], "u bigint, k bigint, us bigint")
    got = S.cooldown(df, "u", "k", pause, block_rows=60)
    assert sorted(map(tuple, got.collect()), key=str) == greedy(events, pause)


def test_cooldown_of_one_actor_is_spread(spark):
    df = spark.range(20_000).select(F.lit("a").alias("u"), F.col("id").alias("k"), (F.col("id") * 3).alias("us"))
    got = S.cooldown(df, "u", "k", 10, block_rows=1000)
    assert got.count() == 5000 and got.agg(F.max("us")).first()[0] == 59988
    assert S._blocks(df, ["u", "us"], 1000).rdd.getNumPartitions() == 20
    assert S.cooldown(df.limit(0), "u", "k", 10).count() == 0


def test_scan(spark):
    r = random.Random(4)
    rows = [(r.choice([None, "a", "a", "a", "b", *"cdefgh"]), i, r.choice([None, r.random()])) for i in range(1200)]
    df = spark.createDataFrame(rows, "k string, o int, v double")
    got = {x["o"]: x for x in S.scanned(df, ["k"], ["o"], "v", block_rows=50).collect()}
    assert len(got) == len(rows)
    for k in {k for k, *_ in rows}:
        own = [x for x in rows if x[0] == k]
        for i, (_, o, v) in enumerate(own):
            g = got[o]
            assert (g["place"], g["first"], g["v"]) == (i + 1, own[0][2], v)
            assert g["previous"] == (own[i - 1][2] if i else None)
            assert g["following"] == (own[i + 1][2] if i + 1 < len(own) else None)


def test_permutation_and_union(spark):
    df = spark.range(3000).withColumn("x", F.lit("s"))
    got = S.permuted(df, "seed", "id", block_rows=100).orderBy("place").collect()
    assert [g["place"] for g in got] == list(range(1, 3001)) and {g["id"] for g in got} == set(range(3000)) and [g["id"] for g in got] != list(range(3000))
    a, b = spark.range(700).withColumn("n", F.lit(1)), spark.range(300).withColumn("m", F.lit("z"))
    both = S.ordered_union([(a, [-F.col("id")]), (b, [F.col("id")]), (a.limit(0), [F.col("id")])], block_rows=40).orderBy("ord").collect()
    assert [x["ord"] for x in both] == list(range(1000)) and [x["id"] for x in both] == [*range(699, -1, -1), *range(300)]
    assert both[0]["n"] == 1 and both[-1]["m"] == "z" and both[-1]["n"] is None
