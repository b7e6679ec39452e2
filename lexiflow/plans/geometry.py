"""Queries of points, boxes and choices without conflicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.values import percent_of
from ..operators import boxes as B, independent as I
from ..sources.tables import table

#: Where the picture begins and how large it is, in pixels.
LEFT, WIDTH, TOP, HEIGHT = 40, 800, 25, 500


def _pointer(spark, d):
    """Events as pointer positions in percent of a picture; some lie outside of it."""
    x, y = percent_of(F.col("event_id") * 37 % 907, F.lit(LEFT), F.lit(WIDTH)), percent_of(F.col("event_id") * 53 % 571, F.lit(TOP), F.lit(HEIGHT))
    return table(spark, d, "events").select("event_id", "ts", "user_id", "event_type", x.alias("x"), y.alias("y"))


def pointer_percent(spark, d):
    return _pointer(spark, d).select("event_id", "x", "y")


def drawn_zones(spark, d):
    """Boxes that each user's drags draw; a down on one that is there already is ignored."""
    return B.drawn_zones(_pointer(spark, d), "user_id", "ts", "event_id", "event_type", "view", "click", "x", "y")


def box_points(spark, d):
    """Lines as points in small boxes of the events: number of points and sum of quantities for each box."""
    p = table(spark, d, "lineitem").select("l_quantity", (F.col("l_extendedprice") % 100).alias("x"), ((F.col("l_orderkey") * 13 + F.col("l_linenumber") * 7) % 1000 / 10).alias("y"))
    e = table(spark, d, "events").filter("event_type = 'click'")
    boxes = e.select("event_id", (F.col("event_id") * 41 % 97).cast("double").alias("left"), (F.col("event_id") * 59 % 98).cast("double").alias("top"), (F.col("value") % 4 + 0.5).alias("width"), (F.col("event_id") % 5 + 0.25).cast("double").alias("height"))
    return B.sums_in_boxes(p.withColumn("quantity", F.col("l_quantity").cast("long")), "x", "y", ["quantity"], boxes, "event_id")


def independent_parts(spark, d):
    """Parts of which no two share an order, as a greedy walk in a seeded order chooses them, and the round that decided."""
    return I.independent_members(table(spark, d, "lineitem"), "l_orderkey", "l_partkey", F.unhex(F.md5(F.concat(F.lit("s12|"), F.col("l_partkey").cast("string")))))


QUERIES = {f.__name__: f for f in (pointer_percent, drawn_zones, box_points, independent_parts)}

_P = f"""p AS (SELECT event_id, ts, user_id, event_type, least(100, greatest(0, (event_id * 37 % 907 - {LEFT}) * 100.0::DOUBLE / {WIDTH}))::DOUBLE AS x, least(100, greatest(0, (event_id * 53 % 571 - {TOP}) * 100.0::DOUBLE / {HEIGHT}))::DOUBLE AS y FROM events)"""
_BOX = "STRUCT(l DOUBLE, t DOUBLE, r DOUBLE, b DOUBLE)"
SQL = {
    "pointer_percent": f"WITH {_P} SELECT event_id, x, y FROM p",
    "drawn_zones": f"""WITH RECURSIVE {_P}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS i FROM p WHERE event_type IN ('view', 'click')),
s(user_id, i, k, kx, ky, boxes, down_id, up_id, x0, y0, x1, y1) AS (SELECT DISTINCT user_id, 0::BIGINT, NULL::BIGINT, NULL::DOUBLE, NULL::DOUBLE, []::{_BOX}[], NULL::BIGINT, NULL::BIGINT, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE FROM n
 UNION ALL SELECT user_id, i, CASE WHEN dn AND NOT hit THEN event_id WHEN dn THEN k END, CASE WHEN dn AND NOT hit THEN x WHEN dn THEN kx END, CASE WHEN dn AND NOT hit THEN y WHEN dn THEN ky END,
  CASE WHEN made THEN list_append(boxes, {{'l': least(x, kx), 't': least(y, ky), 'r': least(x, kx) + abs(x - kx), 'b': least(y, ky) + abs(y - ky)}}) ELSE boxes END, CASE WHEN made THEN k END, CASE WHEN made THEN event_id END, kx, ky, x, y
 FROM (SELECT s.user_id, n.i, n.event_id, n.x, n.y, s.k, s.kx, s.ky, s.boxes, n.event_type = 'view' AS dn, len([q for q in s.boxes if q.l <= n.x AND n.x < q.r AND q.t <= n.y AND n.y < q.b]) > 0 AS hit,
   n.event_type = 'click' AND s.k IS NOT NULL AND abs(n.x - s.kx) >= 3 AND abs(n.y - s.ky) >= 3 AS made FROM s JOIN n ON n.user_id = s.user_id AND n.i = s.i + 1))
SELECT user_id, down_id, up_id, least(x0, x1) AS "left", least(y0, y1) AS top, abs(x1 - x0) AS width, abs(y1 - y0) AS height FROM s WHERE up_id IS NOT NULL""",
    "box_points": """WITH q AS (SELECT l_quantity, l_extendedprice % 100 AS x, ((l_orderkey * 13 + l_linenumber * 7) % 1000)::DOUBLE / 10 AS y FROM lineitem),
b AS (SELECT event_id, (event_id * 41 % 97)::DOUBLE AS l, (event_id * 59 % 98)::DOUBLE AS t, value % 4 + 0.5 AS w, event_id % 5 + 0.25::DOUBLE AS h FROM events WHERE event_type = 'click')
SELECT event_id, count(*) AS points, sum(l_quantity::BIGINT)::BIGINT AS quantity FROM q JOIN b ON x >= l AND x < l + w AND y >= t AND y < t + h GROUP BY event_id""",
}
