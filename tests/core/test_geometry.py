"""Boxes and choices without conflicts against loops."""

import random

from lexiflow.operators import boxes as B, independent as I
from pyspark.sql import functions as F


def test_points_in_boxes(spark):
    r = random.Random(1)
    pts = [(i, r.choice([0.0, 5.0, 100.0, r.random() * 100]), r.choice([0.0, 50.0, r.random() * 100])) for i in range(300)] + [(900, None, 1.0), (901, float("nan"), 1.0)]
    bxs = [(i, r.random() * 90, r.choice([0.0, 5.0, 45.0]), r.choice([0.0, 5.0, r.random() * 30]), r.choice([5.0, 60.0])) for i in range(60)] + [(70, 0.0, 0.0, 101.0, 101.0), (71, None, 0.0, 5.0, 5.0), (72, 0.0, 0.0, float("inf"), 5.0)]
    p = spark.createDataFrame(pts, "p int, x double, y double")
    b = spark.createDataFrame(bxs, "b int, left double, top double, width double, height double")
    got = sorted((q.p, q.b) for q in B.points_in_boxes(p, "x", "y", b).collect())
    ok = lambda v: v is not None and abs(v) < 1e300
    want = sorted((i, j) for i, x, y in pts for j, left, t, w, h in bxs if all(map(ok, (x, y, left, t, w, h))) and left <= x < left + w and t <= y < t + h)
    assert got == want and len(want) > 500


def test_sums_in_boxes(spark):
    """Sums without pairs: equal points, edges, cells dealt to several tasks, one key for two boxes."""
    r = random.Random(4)
    pts = [(r.choice([0.0, 5.0, 7.5, 100.0, r.random() * 20]), r.choice([0.0, 50.0, r.random() * 20]), r.choice([None, -3, 1, 9])) for _ in range(500)] + [(None, 1.0, 1), (float("nan"), 1.0, 1)]
    bxs = [(i % 90, r.choice([0.0, r.random() * 20]), r.choice([0.0, 5.0, r.random() * 20]), r.choice([0.0, 5.0, r.random() * 9]), r.choice([5.0, 60.0])) for i in range(100)] + [(200, -5.0, -5.0, 200.0, 200.0), (201, None, 0.0, 5.0, 5.0), (202, 300.0, 0.0, 5.0, 5.0)]
    p = spark.createDataFrame(pts, "x double, y double, v int")
    b = spark.createDataFrame(bxs, "b int, left double, top double, width double, height double")
    want = {}
    for k, left, t, w, h in bxs:
        for x, y, v in pts:
            if None not in (x, left) and left <= x < left + w and t <= y < t + h:
                n, q = want.get(k, (0, 0))
                want[k] = n + 1, q + (v or 0)
    for most in (B.SLICE, 4):
        out = B.sums_in_boxes(p, "x", "y", ["v"], b, "b", most=most)
        assert {k: (n, q) for k, n, q in out.collect()} == want and len(want) > 50


def test_drawn_index_equals_a_list():
    r = random.Random(2)
    d, held = B.Drawn(), []
    for _ in range(300):
        x, y = r.choice([0.0, 100.0, r.random() * 100]), r.random() * 100
        assert d.covers(x, y) == any(a <= x < c and b <= y < e for a, b, c, e in held)
        box = (x, y, min(100.0, x + r.random() * 12), min(100.0, y + r.random() * 12))
        held.append(box)
        d.add(*box)


def test_down_on_a_box_is_ignored(spark):
    rows = [("view", 10, 10), ("click", 30, 30), ("view", 20, 20), ("click", 90, 90), ("view", 50, 50), ("view", 15, 15), ("click", 60, 62), ("click", 99, 99), ("view", 80, 80), ("click", 82, 99)]
    df = spark.createDataFrame([(1, i, k, float(x), float(y)) for i, (k, x, y) in enumerate(rows)], "u int, k int, e string, x double, y double").withColumn("ts", F.timestamp_millis(F.col("k").cast("long")))
    got = [tuple(r)[1:] for r in B.drawn_zones(df, "u", "ts", "k", "e", "view", "click", "x", "y").orderBy("up_id").collect()]
    # The second drag begins on the first box; the third one is not moved by a down on it; the last is too narrow.
    assert got == [(0, 1, 10, 10, 20, 20), (4, 6, 50, 50, 10, 12)]


def greedy(rows, rank):
    groups = {}
    for g, m in rows:
        groups.setdefault(m, set()).add(g)
    closed, chosen = set(), set()
    for m in sorted(groups, key=rank):
        if groups[m].isdisjoint(closed):
            chosen.add(m)
            closed |= groups[m] - {None}
    return {m: m in chosen for m in groups}


def test_independent_members(spark):
    import hashlib

    r = random.Random(3)
    rows = [(r.choice([None, 0, *range(80)]), r.randrange(120)) for _ in range(260)] + [(0, m) for m in range(60, 110)] + [(1, None)]
    df = spark.createDataFrame(rows, "g int, m int")
    out = I.independent_members(df, "g", "m", F.md5(F.col("m").cast("string")))
    got = {x.m: x.chosen for x in out.collect()}
    assert out.count() == len(got)
    assert got == greedy([x for x in rows if x[1] is not None], lambda m: (hashlib.md5(str(m).encode()).hexdigest(), m))
    assert I.independent_members(df.limit(0), "g", "m", F.col("m")).count() == 0
    line = spark.range(40).select(F.explode(F.array("id", F.col("id") + 1)).alias("g"), F.col("id").alias("m"))
    assert I.independent_members(line, "g", "m", F.col("m")).filter("chosen").count() == 20


def test_rows_of_independent_parts_are_short(spark, monkeypatch):
    """Rounds shuffle these rows again and again: two keys and sixteen bytes that order them."""
    from lexiflow.plans.geometry import independent_parts

    kinds = {}
    monkeypatch.setattr(I, "written", lambda df, name, keep=I.written: kinds.setdefault(name, [t for _, t in df.dtypes]) and keep(df, name))
    independent_parts(spark, "/root/testdata/sf0.001")
    assert kinds["members"] == kinds["left"] == ["bigint", "bigint", "binary"]


def test_query_of_parts(spark):
    import hashlib

    from lexiflow.plans.geometry import independent_parts
    from lexiflow.sources.tables import table

    d = "/root/testdata/sf0.001"
    rows = [tuple(x) for x in table(spark, d, "lineitem").select("l_orderkey", "l_partkey").collect()]
    out = independent_parts(spark, d).collect()
    assert {x.l_partkey: x.chosen for x in out} == greedy(rows, lambda m: (hashlib.md5(f"s12|{m}".encode()).hexdigest(), m))
    assert max(x["round"] for x in out) <= 20
