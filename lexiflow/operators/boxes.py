"""Points and boxes on a square of 100 by 100 percent, by cells of a grid."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from ..sources.tables import written
from .events import micros

#: Percent of a cell's side.
CELL = 5.0
#: Points, or boxes, of a cell that one task takes at once.
SLICE = 500_000


def _cells(low: Column, high: Column, side: float) -> Column:
    return F.sequence(F.floor(low / side).cast("int"), F.floor(high / side).cast("int"))


def points_in_boxes(points: DataFrame, x: str, y: str, boxes: DataFrame, side: float = CELL) -> DataFrame:
    """Each point with each box (left, top, width, height) it lies in; edges count on the left and top only.

    The join is by cell: a box stands in every cell that it touches, a point in one. What a cell joins is compared exactly.
    A box or point with a null or a number that is not finite is in nothing. Both sides are plain, so Spark splits a
    cell that is crowded.
    """
    fit = lambda *c: ~F.greatest(*(F.abs(F.col(f"`{i}`").cast("double")) for i in c)).isin(float("inf"), float("nan"))
    right, bottom = F.col("left") + F.col("width"), F.col("top") + F.col("height")
    b = boxes.filter(fit("left", "top", "width", "height") & (F.col("width") > 0) & (F.col("height") > 0))
    b = b.withColumn("__cx", F.explode(_cells(F.col("left"), right, side))).withColumn("__cy", F.explode(_cells(F.col("top"), bottom, side)))
    p = points.filter(fit(x, y)).withColumns({"__cx": F.floor(F.col(x) / side).cast("int"), "__cy": F.floor(F.col(y) / side).cast("int")})
    inside = (F.col(x) >= F.col("left")) & (F.col(x) < right) & (F.col(y) >= F.col("top")) & (F.col(y) < bottom)
    return p.join(b, ["__cx", "__cy"]).filter(inside).drop("__cx", "__cy")


def sums_below(px, py, weights, qx, qy) -> np.ndarray:
    """For each (qx, qy) the sum of each row of ``weights`` over points with px < qx and py < qy, exact in 64-bit integers.

    Points are sorted by x and told apart by the bits of their rank in y, from the highest one (a wavelet matrix): a
    query keeps a range of points and goes once through the bits, so time is n log n in points and queries.
    """
    order = np.argsort(px, kind="stable")
    ys = np.unique(py)
    rank, w = np.searchsorted(ys, py)[order], weights[:, order]
    lo, hi, top = np.zeros(len(qx), np.int64), np.searchsorted(px[order], qx, "left"), np.searchsorted(ys, qy, "left")
    out = np.zeros((len(weights), len(qx)), np.int64)
    start = lambda v: np.concatenate([np.zeros(v.shape[:-1] + (1,), np.int64), np.cumsum(v, axis=-1, dtype=np.int64)], axis=-1)
    for bit in reversed(range(len(ys).bit_length())):
        one = (rank >> bit) & 1
        zeros, sums = start(1 - one), start(w * (1 - one))
        high = (top >> bit) & 1 == 1
        out += np.where(high, sums[:, hi] - sums[:, lo], 0)
        lo, hi = (np.where(high, zeros[-1] + i - zeros[i], zeros[i]) for i in (lo, hi))
        to = np.argsort(one, kind="stable")
        rank, w = rank[to], w[:, to]
    return out


def sums_in_boxes(points: DataFrame, x: str, y: str, values: list[str], boxes: DataFrame, key: str, side: float = CELL, most: int = SLICE) -> DataFrame:
    """(key, points, *values): number of points in each box that has any, and the sums of the points' whole numbers ``values``.

    As ``points_in_boxes`` with a grouping by ``key``, but pairs are never made: a cell's sums below the corners of its boxes
    give what lies in them. A cell with more than ``most`` points or boxes is dealt to several tasks by hash; their sums
    add up. Null values count as 0.
    """
    fit = lambda *c: ~F.greatest(*(F.abs(F.col(f"`{i}`").cast("double")) for i in c)).isin(float("inf"), float("nan"))
    right, bottom = F.col("left") + F.col("width"), F.col("top") + F.col("height")
    b = boxes.filter(fit("left", "top", "width", "height") & (F.col("width") > 0) & (F.col("height") > 0))
    b = b.select(F.col(key).alias("k"), F.col("left").cast("double").alias("x0"), F.col("top").cast("double").alias("y0"), right.cast("double").alias("x1"), bottom.cast("double").alias("y1"))
    b = b.withColumn("cx", F.explode(_cells(F.col("x0"), F.col("x1"), side))).withColumn("cy", F.explode(_cells(F.col("y0"), F.col("y1"), side)))
    px, py = F.col(x).cast("double"), F.col(y).cast("double")
    sums = [f"v{i}" for i in range(len(values) + 1)]
    # Equal points are one, with their sums.
    p = points.filter(fit(x, y)).groupBy(px.alias("x"), py.alias("y")).agg(F.count("*").alias("v0"), *(F.sum(F.coalesce(F.col(c).cast("long"), F.lit(0))).alias(v) for c, v in zip(values, sums[1:])))
    p = p.withColumns({"cx": F.floor(F.col("x") / side).cast("int"), "cy": F.floor(F.col("y") / side).cast("int")})
    slices = lambda n: F.ceil(F.coalesce(F.col(n), F.lit(0)) / most).cast("int")
    held = p.groupBy("cx", "cy").agg(F.count("*").alias("np")).join(b.groupBy("cx", "cy").agg(F.count("*").alias("nb")), ["cx", "cy"])
    held = written(held.select("cx", "cy", slices("np").alias("sp"), slices("nb").alias("sb")), "cells")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    p = p.join(held, ["cx", "cy"]).withColumn("i", F.pmod(F.xxhash64("x", "y"), F.col("sp")).cast("int")).withColumn("j", every("sb"))
    b = b.join(held, ["cx", "cy"]).withColumn("j", F.pmod(F.xxhash64("k", "x0", "y0"), F.col("sb")).cast("int")).withColumn("i", every("sp"))
    at = ["cx", "cy", "i", "j"]

    def below(pts, bxs):
        import pyarrow as pa

        q, r = ({c: t.column(c).to_numpy() for c in names} for t, names in ((pts, ["x", "y", *sums]), (bxs, ["x0", "y0", "x1", "y1"])))
        n = len(r["x0"])
        w = np.array([q[v] for v in sums], np.int64).reshape(len(sums), -1)
        f = sums_below(q["x"], q["y"], w, np.concatenate([r["x1"], r["x0"], r["x1"], r["x0"]]), np.concatenate([r["y1"], r["y1"], r["y0"], r["y0"]]))
        got = f[:, :n] - f[:, n : 2 * n] - f[:, 2 * n : 3 * n] + f[:, 3 * n :]
        return pa.table([bxs.column("k"), *got], names=["k", *sums]).filter(pa.array(got[0] > 0))

    found = p.select(*at, "x", "y", *sums).groupBy(*at).cogroup(b.select(*at, "k", "x0", "y0", "x1", "y1").groupBy(*at)).applyInArrow(below, f"k {dict(boxes.dtypes)[key]}, " + ", ".join(f"{v} bigint" for v in sums))
    return found.groupBy(F.col("k").alias(key)).agg(*(F.sum(v).alias(c) for v, c in zip(sums, ["points", *values])))


class Drawn:
    """Boxes drawn so far, by cell: what a cell holds of them, without those that a later one covers there."""

    def __init__(self, side: float = CELL):
        self.side, self.cells = side, {}

    def covers(self, x: float, y: float) -> bool:
        return any(a <= x < c and b <= y < d for a, b, c, d in self.cells.get((int(x // self.side), int(y // self.side)), ()))

    def add(self, left: float, top: float, right: float, bottom: float) -> None:
        s = self.side
        for i in range(int(left // s), int(right // s) + 1):
            for j in range(int(top // s), int(bottom // s) + 1):
                a, b, c, d = max(left, i * s), max(top, j * s), min(right, i * s + s), min(bottom, j * s + s)
                if a < c and b < d:
                    self.cells[i, j] = [(a, b, c, d), *(o for o in self.cells.get((i, j), ()) if not (a <= o[0] and b <= o[1] and o[2] <= c and o[3] <= d))]


def drawn_zones(df: DataFrame, by: str, ts: str, key: str, event: str, down: str, up: str, x: str, y: str, least: float = 3.0) -> DataFrame:
    """(by, down_id, up_id, left, top, width, height) of the boxes that drags draw, one after the other.

    A down on a box that is drawn already is ignored, and a drag that is open then stays open; any other down begins a drag
    anew. An up ends an open drag; its box is drawn if it has ``least`` on both sides. Points are clamped to 0..100; those
    with a null are left out.
    """
    from ..functions.values import clamp
    from .machines import folded

    kind = dict(df.dtypes)

    def start(actor):
        drawn, begun = Drawn(), None

        def step(row):
            nonlocal begun
            if row is None:
                return
            _, _, k, pressed, px, py = row
            if pressed:
                if not drawn.covers(px, py):
                    begun = k, px, py
                return
            if begun:
                k0, x0, y0 = begun
                begun = None
                left, top, width, height = min(px, x0), min(py, y0), abs(px - x0), abs(py - y0)
                if width >= least and height >= least:
                    drawn.add(left, top, left + width, top + height)
                    yield actor, k0, k, left, top, width, height

        return step

    rows = df.filter(F.col(event).isin(down, up) & F.col(x).isNotNull() & F.col(y).isNotNull())
    rows = rows.select(by, micros(F.col(ts)).alias("us"), key, (F.col(event) == down).alias("pressed"), clamp(F.col(x)).alias("px"), clamp(F.col(y)).alias("py"))
    return folded(rows, by, ["us", key], f"`{by}` {kind[by]}, down_id {kind[key]}, up_id {kind[key]}, left double, top double, width double, height double", start)
