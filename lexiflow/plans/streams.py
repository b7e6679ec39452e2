"""Queries that replay the events through the streaming operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import cooldown_stream, dwell_stream, funnel_stream, slot_stream
from ..sources.tables import table
from ..streaming.gaze import buckets_for
from ..streaming.replay import dealt, replayed

HOUR = 3_600_000
#: Files of a late stream, and its delay.
FILES, LATE = 6, 24 * HOUR


def _events(stream):
    """Pointer events: views enter one of three elements."""
    element = F.concat(F.lit("e"), (F.col("event_id") % 3).cast("string"))
    return stream.select("user_id", element.alias("element_id"), F.when(F.col("event_type") == "view", "enter").otherwise(F.col("event_type")).alias("event_type"), F.col("ts").cast("timestamp").alias("ts"))


def _replayed(spark, d, make, files=1, late=HOUR):
    """Events in folders that ``make``'s stream, of so many buckets, reads one by one, with a last row that ends the wait for late ones."""
    events = table(spark, d, "events").select("event_id", "ts", "user_id", "event_type")
    buckets = buckets_for(events.count())
    return replayed(spark, dealt(events, "ts", "event_id", files, late * 1000), lambda s: make(s, buckets), files + 1)


def dwell_replay(spark, d):
    """Dwells of four hours; those that nothing ends fire if they are due an hour before the last event."""
    last = table(spark, d, "events").agg(F.max(F.unix_millis(F.col("ts").cast("timestamp")))).first()[0]
    return _replayed(spark, d, lambda s, n: dwell_stream(_events(s), 4 * HOUR, "1 hour", None if last is None else last - HOUR, buckets=n))


def cooldown_replay(spark, d):
    return _replayed(spark, d, lambda s, n: cooldown_stream(_events(s), 24 * HOUR, "1 hour", buckets=n))


def funnel_replay(spark, d):
    return _replayed(spark, d, lambda s, n: funnel_stream(_events(s), ["enter", "click", "purchase"], "1 hour", buckets=n))


def dwell_late(spark, d):
    """Dwells of eight hours from files whose rows come up to a day late."""
    return _replayed(spark, d, lambda s, n: dwell_stream(_events(s), 8 * HOUR, "24 hours", buckets=n), FILES, LATE)


def cooldown_late(spark, d):
    return _replayed(spark, d, lambda s, n: cooldown_stream(_events(s), 16 * HOUR, "24 hours", buckets=n), FILES, LATE)


def funnel_late(spark, d):
    return _replayed(spark, d, lambda s, n: funnel_stream(_events(s), ["enter", "click", "enter", "purchase", "error"], "24 hours", buckets=n), FILES, LATE)


def slots_late(spark, d):
    """Each user's events of a day as a snapshot of three slots, some without a value, from files whose rows come up to a day late."""
    def rows(s):
        value = F.when(F.col("event_id") % 4 > 0, F.col("event_type"))
        return s.select("user_id", F.concat(F.lit("s"), F.col("event_id") % 3).alias("slot"), value.alias("value"), F.col("ts").cast("timestamp").alias("ts"))

    return _replayed(spark, d, lambda s, n: slot_stream(rows(s), 24 * HOUR, "24 hours", buckets=n), FILES, LATE)


QUERIES = {f.__name__: f for f in (dwell_replay, cooldown_replay, funnel_replay, dwell_late, cooldown_late, funnel_late, slots_late)}

_E = "e AS (SELECT event_id, user_id, 'e' || event_id % 3 AS element_id, CASE WHEN event_type = 'view' THEN 'enter' ELSE event_type END AS kind, epoch_us(ts) // 1000 AS ms FROM events)"
SQL = {
    "dwell_replay": f"""WITH {_E}, n AS (SELECT *, lead(ms) OVER (PARTITION BY user_id, element_id ORDER BY ms) AS nxt FROM e)
SELECT user_id, element_id, ms + {4 * HOUR} AS fired_ms FROM n WHERE kind = 'enter' AND (nxt - ms >= {4 * HOUR} OR nxt IS NULL AND ms + {4 * HOUR} < (SELECT max(ms) - {HOUR} FROM e))""",
    "cooldown_replay": f"""WITH RECURSIVE {_E}, f AS (SELECT user_id, element_id, ms FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ms) AS r FROM e) WHERE r = 1
 UNION ALL SELECT n.user_id, n.element_id, n.ms FROM f, LATERAL (SELECT * FROM e x WHERE x.user_id = f.user_id AND x.ms - f.ms >= {24 * HOUR} ORDER BY ms LIMIT 1) n)
SELECT user_id, element_id, ms AS fired_ms FROM f""",
    "funnel_replay": f"""WITH {_E}, a AS (SELECT user_id, arg_min(element_id, ms) AS element_id, min(ms) AS ms FROM e WHERE kind = 'enter' GROUP BY 1),
b AS (SELECT e.user_id, arg_min(e.element_id, e.ms) AS element_id, min(e.ms) AS ms FROM e JOIN a USING (user_id) WHERE kind = 'click' AND e.ms > a.ms GROUP BY 1),
c AS (SELECT e.user_id, arg_min(e.element_id, e.ms) AS element_id, min(e.ms) AS ms FROM e JOIN b USING (user_id) WHERE kind = 'purchase' AND e.ms > b.ms GROUP BY 1)
SELECT user_id, element_id, ms AS fired_ms FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c""",
    "dwell_late": f"""WITH {_E}, n AS (SELECT *, lead(ms) OVER (PARTITION BY user_id, element_id ORDER BY ms) AS nxt FROM e)
SELECT user_id, element_id, ms + {8 * HOUR} AS fired_ms FROM n WHERE kind = 'enter' AND (nxt - ms >= {8 * HOUR} OR nxt IS NULL)""",
    "cooldown_late": f"""WITH RECURSIVE {_E}, f AS (SELECT user_id, element_id, ms FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ms) AS r FROM e) WHERE r = 1
 UNION ALL SELECT n.user_id, n.element_id, n.ms FROM f, LATERAL (SELECT * FROM e x WHERE x.user_id = f.user_id AND x.ms - f.ms >= {16 * HOUR} ORDER BY ms LIMIT 1) n)
SELECT user_id, element_id, ms AS fired_ms FROM f""",
    "funnel_late": f"""WITH RECURSIVE {_E}, s AS (SELECT * FROM (VALUES (1, 'enter'), (2, 'click'), (3, 'enter'), (4, 'purchase'), (5, 'error')) t(i, kind)),
f AS (SELECT user_id, arg_min(element_id, ms) AS element_id, min(ms) AS ms, 1 AS i FROM e WHERE kind = 'enter' GROUP BY 1
 UNION ALL SELECT n.user_id, n.element_id, n.ms, n.i FROM f, LATERAL (SELECT e.user_id, e.element_id, e.ms, s.i FROM e JOIN s ON s.i = f.i + 1 AND s.kind = e.kind WHERE e.user_id = f.user_id AND e.ms > f.ms ORDER BY e.ms LIMIT 1) n)
SELECT user_id, element_id, ms AS fired_ms FROM f""",
    "slots_late": f"""WITH x AS (SELECT user_id, epoch_us(ts) // 1000 // {24 * HOUR} * {24 * HOUR} AS day, 's' || event_id % 3 AS slot, arg_max(struct_pack(v := CASE WHEN event_id % 4 > 0 THEN event_type END), ts).v AS v FROM events GROUP BY 1, 2, 3),
n AS (SELECT user_id, day, lag(day) OVER (PARTITION BY user_id ORDER BY day) AS prev FROM (SELECT DISTINCT user_id, day FROM x)),
a AS (SELECT n.user_id, n.day, slot, v FROM n JOIN x USING (user_id, day)), b AS (SELECT n.user_id, n.day, slot, v FROM n JOIN x ON x.user_id = n.user_id AND x.day = n.prev)
SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.day, b.day) AS at_ms, coalesce(a.slot, b.slot) AS slot, b.v AS before, a.v AS after,
 CASE WHEN b.slot IS NULL THEN 'create' WHEN a.slot IS NULL THEN 'dispose' WHEN a.v IS NOT DISTINCT FROM b.v THEN 'keep' ELSE 'replace' END AS action
FROM a FULL JOIN b ON a.user_id = b.user_id AND a.day = b.day AND a.slot = b.slot""",
}
