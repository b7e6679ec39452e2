"""Queries of event operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import events as E, machines as G
from ..sources.literals import BALLOONS
from ..sources.tables import table

HOUR = 3_600_000_000
KINDS = "signup error click view purchase".split()


def _events(spark, d):
    return table(spark, d, "events").select("event_id", "ts", "user_id", "event_type")


def dwell(spark, d):
    return E.dwell(_events(spark, d), ["user_id"], "ts", "event_type", "view", 4 * HOUR, "event_id").select("user_id", "event_id", "fired_us")


def dwell_progress(spark, d):
    """Events as moments of a dwell of 1500 ms."""
    p, jitter = E.progress(F.col("event_id") % 31 * 100.0, 1500.0)
    return table(spark, d, "events").select("event_id", p.alias("progress"), jitter.alias("jitter"))


def cooldown(spark, d):
    return E.cooldown(_events(spark, d), "user_id", "ts", "event_id", 24 * HOUR)


def gaze_names(spark, d):
    return E.gaze_names(_events(spark, d), "user_id", "ts", "event_id", "event_type", "view", 4 * HOUR, 30 * HOUR)


def dwell_gated(spark, d):
    """Activations of those events whose actor has them switched on and isn't locked."""
    e = table(spark, d, "events").select("event_id", "ts", "user_id", "event_type", "value")
    gate = (F.col("user_id") % 3 > 0) & (F.col("value") > 20)
    return E.dwell(e, ["user_id"], "ts", "event_type", "view", 4 * HOUR, "event_id", gate=gate).select("user_id", "event_id", "fired_us")


def funnel(spark, d):
    return E.funnel(_events(spark, d), "user_id", "ts", "event_id", "event_type", ["view", "click", "purchase"])


def collect_all(spark, d):
    return E.collect_all(_events(spark, d), "user_id", "ts", "event_type", len(KINDS))


def rounds(spark, d):
    return E.rounds(_events(spark, d), "user_id", "ts", "event_id", "event_type", "click", "error", 24 * HOUR)


def memory_pairs(spark, d):
    return E.pairs(_events(spark, d), "user_id", "ts", "event_id", "event_type")


def memory_turns(spark, d):
    """The memory game over six cards with three faces; its pauses in hours instead of milliseconds."""
    e = table(spark, d, "events").select("event_id", "ts", "user_id", F.pmod("event_id", F.lit(6)).alias("card"), F.pmod("event_id", F.lit(3)).alias("face"))
    return E.turns(e, "user_id", "ts", "event_id", "card", "face", 4 * HOUR, 11 * HOUR, 6, 30 * HOUR)


def drag_pairs(spark, d):
    return E.drags(_events(spark, d), "user_id", "ts", "event_id", "event_type", "view", "click")


def drawn_boxes(spark, d):
    e = table(spark, d, "events").select("event_id", "ts", "user_id", "event_type", (F.col("event_id") * 37 % 121 - 10).cast("double").alias("x"), (F.col("event_id") * 53 % 121 - 10).cast("double").alias("y"))
    return E.drawn_boxes(e, "user_id", "ts", "event_id", "event_type", "view", "click", "x", "y")


def puzzle_placement(spark, d):
    """A puzzle of four pieces; events click on one of five, of which one is no piece. Pauses in hours."""
    e = table(spark, d, "events").select("event_id", "ts", "user_id", F.element_at(F.array(*map(F.lit, ("0-0", "0-1", "1-0", "1-1", "9-9"))), (F.col("event_id") * 7 % 5 + 1).cast("int")).alias("piece"))
    return G.puzzle(e, "user_id", "ts", "event_id", "piece", ("0-0", "0-1", "1-0", "1-1"), 6 * HOUR, 40 * HOUR)


def balloon_pops(spark, d):
    """Balloons in four places; events pop one of five, of which one is no place. Pauses in hours."""
    e = table(spark, d, "events").select("event_id", "ts", "user_id", (F.col("event_id") * 3 % 5).alias("slot"))
    return G.balloons(e, "user_id", "ts", "event_id", "slot", tuple(b[1] for b in BALLOONS), 7 * HOUR, 30 * HOUR)


def word_reading(spark, d):
    """Pages of three, four and two words; each event enters the word of its number, or none. Pauses in hours."""
    e = table(spark, d, "events").select("event_id", "ts", "user_id", F.when(F.col("event_id") % 5 < 4, F.col("event_id") % 4).alias("word"))
    return G.reading(e, "user_id", "ts", "event_id", "word", (3, 4, 2), 2 * HOUR, 5 * HOUR, 400 * HOUR)


def open_screens(spark, d):
    return G.screens(_events(spark, d), "user_id", "ts", "event_id", "event_type", "signup", "error", {"view": "story", "click": "game", "purchase": "music"})


def auto_turns(spark, d):
    """Pages that turn by themselves until the actor's next event, of stories of six pages."""
    e = _events(spark, d).withColumn("page", F.col("event_id") % 6)
    return G.auto_turns(e, "user_id", "ts", "page", 5, 3 * HOUR, "event_id").select("event_id", "page", "turns", "page_after")


def page_visits(spark, d):
    """Reading starts anew where the page changes."""
    return G.visits(_events(spark, d), "user_id", "ts", ["event_type"], "event_id").select("event_id", "visit", "place")


def confetti(spark, d):
    """Pieces and fragments of each event: until when they stay, and what is left of them after an hour's thousandth."""
    from ..functions import values as V
    from ..operators import sampling as S

    k = F.col("event_id").cast("string")
    duration, delay = 1.6 + S.unit("dur", k) * 1.3, S.unit("del", k) * 0.4
    alive, opacity = V.fragment_life(S.unit("life", k) * 2, F.lit(1.2))
    return _events(spark, d).select("event_id", F.round(V.confetti_ms(duration, delay), 6).alias("stays_ms"), alive.alias("alive"), F.round(opacity, 6).alias("opacity"))


def bounce_frames(spark, d):
    """Balloons of two axes over frames of different lengths, of which long ones are cut."""
    frames = F.array(*(F.lit(x) for x in (0.016, 0.04, 0.2, 0.05, 0.033) * 12))
    p = table(spark, d, "part").select("p_partkey", (F.col("p_partkey") % 60).cast("double").alias("x"), (F.col("p_size") % 40).cast("double").alias("y"), (F.col("p_partkey") % 37 * 7.0 - 120).alias("vx"), (F.col("p_size") * 5.0 - 130).alias("vy"))
    a, b = E.moved(F.col("x"), F.col("vx"), frames, 0.0, 90.0), E.moved(F.col("y"), F.col("vy"), frames, 0.0, 45.0)
    return p.select("p_partkey", a.alias("a"), b.alias("b")).select("p_partkey", F.round("a.x", 6).alias("x"), F.round("b.x", 6).alias("y"), F.col("a.v").alias("vx"), F.col("b.v").alias("vy"))


def note_highlight(spark, d):
    return E.shown_until(_events(spark, d), "user_id", "ts", "event_id", 8 * HOUR).select("event_id", "shown_us")


def navigation_depth(spark, d):
    return E.depth(_events(spark, d), "user_id", "ts", "event_id", "event_type", "signup", ["view", "click"], "error").select("event_id", "depth")


def ttl_active(spark, d):
    return E.active_by_hour(_events(spark, d), "ts", 6)


def bounce(spark, d):
    """Users as balls between two walls, after three seconds."""
    balls = table(spark, d, "events").select("user_id").distinct().select(F.col("user_id").alias("ord"), (F.col("user_id") * 7 % 101).cast("double").alias("x"), (F.col("user_id") * 53 % 601 - 300).cast("double").alias("v"))
    at = E.bounced(F.col("x"), F.col("v"), 60, 0.25, 0.0, 100.0)
    return balls.select("ord", at.alias("s")).select("ord", F.round("s.x", 6).alias("x"), "s.v")


QUERIES = {f.__name__: f for f in (dwell, dwell_gated, gaze_names, drawn_boxes, puzzle_placement, balloon_pops, word_reading, open_screens, auto_turns, page_visits, confetti, bounce_frames, dwell_progress, cooldown, funnel, collect_all, rounds, memory_pairs, memory_turns, drag_pairs, note_highlight, navigation_depth, ttl_active, bounce)}

_FIRED = """f AS (SELECT user_id, event_id, us FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS r FROM {0}) WHERE r = 1
 UNION ALL SELECT n.user_id, n.event_id, n.us FROM f, LATERAL (SELECT * FROM {0} x WHERE x.user_id = f.user_id AND x.us - f.us >= {1} ORDER BY us, event_id LIMIT 1) n)"""
_E = "e AS (SELECT *, epoch_us(ts) AS us FROM events)"
_W = "(PARTITION BY user_id ORDER BY us, event_id)"
SQL = {
    "dwell": f"WITH {_E}, n AS (SELECT *, lead(us) OVER {_W} AS nxt FROM e) SELECT user_id, event_id, us + {4 * HOUR} AS fired_us FROM n WHERE event_type = 'view' AND (nxt IS NULL OR nxt - us >= {4 * HOUR})",
    "dwell_gated": f"WITH {_E}, n AS (SELECT *, lead(us) OVER {_W} AS nxt FROM e) SELECT user_id, event_id, us + {4 * HOUR} AS fired_us FROM n WHERE event_type = 'view' AND user_id % 3 > 0 AND value > 20 AND (nxt IS NULL OR nxt - us >= {4 * HOUR})",
    "gaze_names": f"WITH RECURSIVE {_E}, n AS (SELECT *, lead(us) OVER {_W} AS nxt FROM e), h AS (SELECT * FROM n WHERE event_type = 'view' AND (nxt IS NULL OR nxt - us >= {4 * HOUR})), {_FIRED.format('h', 34 * HOUR)} SELECT * FROM f",
    "drawn_boxes": f"""WITH {_E}, p AS (SELECT *, least(100, greatest(0, event_id * 37 % 121 - 10))::DOUBLE AS x, least(100, greatest(0, event_id * 53 % 121 - 10))::DOUBLE AS y FROM e WHERE event_type IN ('view', 'click')),
n AS (SELECT *, lag(event_id) OVER {_W} AS k, lag(event_type) OVER {_W} AS b, lag(x) OVER {_W} AS px, lag(y) OVER {_W} AS py FROM p)
SELECT user_id, k AS down_id, event_id AS up_id, least(x, px) AS "left", least(y, py) AS top, abs(x - px) AS width, abs(y - py) AS height FROM n WHERE event_type = 'click' AND b = 'view' AND abs(x - px) >= 3 AND abs(y - py) >= 3""",
    "open_screens": f"""WITH RECURSIVE {_E}, n AS (SELECT *, row_number() OVER {_W} AS i FROM e),
s(user_id, i, event_id, game, story, music) AS (SELECT user_id, 0::BIGINT, NULL::BIGINT, false, false, false FROM (SELECT DISTINCT user_id FROM e) UNION ALL
 SELECT n.user_id, n.i, n.event_id, CASE event_type WHEN 'signup' THEN false WHEN 'error' THEN false WHEN 'click' THEN true ELSE game END, CASE event_type WHEN 'signup' THEN false WHEN 'error' THEN story AND game WHEN 'view' THEN true ELSE story END,
 CASE event_type WHEN 'signup' THEN false WHEN 'error' THEN music AND (game OR story) WHEN 'purchase' THEN true ELSE music END FROM s JOIN n ON n.user_id = s.user_id AND n.i = s.i + 1)
SELECT user_id, event_id, game, story, music FROM s WHERE i > 0""",
    "puzzle_placement": f"""WITH RECURSIVE {_E}, n AS (SELECT *, row_number() OVER {_W} AS i, ['0-0', '0-1', '1-0', '1-1', '9-9'][event_id * 7 % 5 + 1] AS piece FROM e),
s(user_id, i, event_id, round, placed, free, target, piece, shown, hit, asked) AS (SELECT user_id, 0::BIGINT, NULL::BIGINT, 1::BIGINT, []::VARCHAR[], NULL::BIGINT, list_sort([md5(user_id || '|1|0|' || x) || x for x in ['0-0', '0-1', '1-0', '1-1']])[1][33:], NULL::VARCHAR, false, false, NULL::VARCHAR FROM (SELECT DISTINCT user_id FROM e) UNION ALL
 SELECT user_id, i, event_id, rnd, now, CASE WHEN NOT ignored AND piece = tgt THEN us + {6 * HOUR} + CASE WHEN len(now) = 4 THEN {40 * HOUR} ELSE 0 END ELSE free END,
  CASE WHEN ignored OR piece <> tgt THEN tgt ELSE list_sort([md5(user_id || '|' || rnd || '|' || len(now) || '|' || x) || x for x in ['0-0', '0-1', '1-0', '1-1'] if NOT list_contains(now, x)])[1][33:] END, piece, NOT ignored, piece = tgt, tgt
 FROM (SELECT *, CASE WHEN ignored OR piece <> tgt THEN held ELSE list_append(held, piece) END AS now FROM (SELECT *, CASE WHEN NOT ignored AND target IS NULL THEN list_sort([md5(user_id || '|' || rnd || '|0|' || x) || x for x in ['0-0', '0-1', '1-0', '1-1']])[1][33:] ELSE target END AS tgt FROM
  (SELECT *, CASE WHEN NOT ignored AND target IS NULL THEN round + 1 ELSE round END AS rnd, CASE WHEN NOT ignored AND target IS NULL THEN [] ELSE placed END AS held FROM (SELECT s.user_id, n.i, n.event_id, n.us, n.piece, s.round, s.placed, s.free, s.target, free IS NOT NULL AND n.us < free AS ignored FROM s JOIN n ON n.user_id = s.user_id AND n.i = s.i + 1)))))
SELECT user_id, event_id, round, piece, hit AS placed, asked AS target FROM s WHERE i > 0 AND shown""",
    "memory_turns": f"""WITH RECURSIVE {_E}, n AS (SELECT *, row_number() OVER {_W} AS i, event_id % 6 AS card, event_id % 3 AS face FROM e),
s(user_id, i, matched, k, c, f, free, a, b, same) AS (SELECT user_id, 0::BIGINT, []::BIGINT[], NULL::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::BOOLEAN FROM (SELECT DISTINCT user_id FROM e) UNION ALL
 SELECT user_id, i, CASE WHEN turned AND f = face THEN list_concat(held, [card, c]) ELSE held END, CASE WHEN skipped THEN k WHEN k IS NULL THEN event_id END, CASE WHEN skipped THEN c WHEN k IS NULL THEN card END, CASE WHEN skipped THEN f WHEN k IS NULL THEN face END,
  CASE WHEN turned THEN us + CASE WHEN f = face THEN {4 * HOUR} + CASE WHEN len(held) = 4 THEN {30 * HOUR} ELSE 0 END ELSE {11 * HOUR} END ELSE free END, CASE WHEN turned THEN k END, CASE WHEN turned THEN event_id END, CASE WHEN turned THEN f = face END
 FROM (SELECT *, NOT skipped AND k IS NOT NULL AS turned FROM (SELECT *, ignored OR list_contains(held, card) OR (k IS NOT NULL AND c = card) AS skipped FROM (SELECT *, CASE WHEN NOT ignored AND len(matched) = 6 THEN []::BIGINT[] ELSE matched END AS held FROM
  (SELECT s.user_id, n.i, n.us, n.event_id, n.card, n.face, s.matched, s.k, s.c, s.f, s.free, s.free IS NOT NULL AND n.us < s.free AS ignored FROM s JOIN n ON n.user_id = s.user_id AND n.i = s.i + 1)))))
SELECT user_id, a AS first, b AS second, same AS match FROM s WHERE a IS NOT NULL""",
    "auto_turns": f"WITH {_E}, n AS (SELECT *, event_id % 6 AS page, lead(us) OVER {_W} - us AS gap FROM e), t AS (SELECT event_id, page, least(5 - page, coalesce(gap // {3 * HOUR}, 5 - page))::BIGINT AS turns FROM n) SELECT *, page + turns AS page_after FROM t",
    "page_visits": f"WITH {_E}, n AS (SELECT *, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER {_W} THEN 0 ELSE 1 END AS b FROM e), v AS (SELECT *, sum(b) OVER {_W} AS visit FROM n) SELECT event_id, visit::BIGINT AS visit, row_number() OVER (PARTITION BY user_id, visit ORDER BY us, event_id) - 1 AS place FROM v",
    "confetti": """WITH u AS (SELECT event_id, ('0x' || md5('dur|' || event_id)[1:8])::BIGINT / 4294967296.0::DOUBLE AS a, ('0x' || md5('del|' || event_id)[1:8])::BIGINT / 4294967296.0::DOUBLE AS b, ('0x' || md5('life|' || event_id)[1:8])::BIGINT / 4294967296.0::DOUBLE * 2 - 1.2 AS life FROM events)
SELECT event_id, round((1.6 + a * 1.3 + b * 0.4) * 1000 + 150, 6) AS stays_ms, life > 0 AS alive, round(greatest(0, least(1, life / 0.4)), 6) AS opacity FROM u""",
    "bounce_frames": """WITH RECURSIVE b(p_partkey, i, x, y, vx, vy) AS (SELECT p_partkey, 0, (p_partkey % 60)::DOUBLE, (p_size % 40)::DOUBLE, p_partkey % 37 * 7.0::DOUBLE - 120, p_size * 5.0::DOUBLE - 130 FROM part UNION ALL
SELECT p_partkey, i + 1, least(90, greatest(0, nx)), least(45, greatest(0, ny)), CASE WHEN nx < 0 THEN abs(vx) WHEN nx > 90 THEN -abs(vx) ELSE vx END, CASE WHEN ny < 0 THEN abs(vy) WHEN ny > 45 THEN -abs(vy) ELSE vy END
FROM (SELECT *, x + vx * dt AS nx, y + vy * dt AS ny FROM (SELECT *, [0.016::DOUBLE, 0.04, 0.05, 0.05, 0.033][i % 5 + 1] AS dt FROM b WHERE i < 60)))
SELECT p_partkey, round(x, 6) AS x, round(y, 6) AS y, vx, vy FROM b WHERE i = 60""",
    "dwell_progress": "SELECT event_id, least(id * 100.0 / 1500.0, 1.0)::DOUBLE AS progress, 4 * least(id * 100.0::DOUBLE / 1500.0, 1.0) * least(id * 100.0::DOUBLE / 1500.0, 1.0) AS jitter FROM (SELECT event_id, event_id % 31 AS id FROM events)",
    "cooldown": f"WITH RECURSIVE {_E}, {_FIRED.format('e', 24 * HOUR)} SELECT * FROM f",
    "funnel": f"""WITH {_E}, u AS (SELECT DISTINCT user_id FROM e),
a AS (SELECT user_id, min((us, event_id)) AS at FROM e WHERE event_type = 'view' GROUP BY 1),
b AS (SELECT e.user_id, min((us, event_id)) AS at FROM e JOIN a USING (user_id) WHERE event_type = 'click' AND (us, event_id) > a.at GROUP BY 1),
c AS (SELECT e.user_id, min((us, event_id)) AS at FROM e JOIN b USING (user_id) WHERE event_type = 'purchase' AND (us, event_id) > b.at GROUP BY 1)
SELECT user_id, ((a.at IS NOT NULL)::INT + (b.at IS NOT NULL)::INT + (c.at IS NOT NULL)::INT)::BIGINT AS reached, coalesce(c.at[1], b.at[1], a.at[1]) AS last_us FROM u LEFT JOIN a USING (user_id) LEFT JOIN b USING (user_id) LEFT JOIN c USING (user_id)""",
    "collect_all": f"WITH {_E} SELECT user_id, count(*) AS found, CASE WHEN count(*) = 5 THEN max(us) END AS done_us FROM (SELECT user_id, event_type, min(us) AS us FROM e GROUP BY ALL) GROUP BY user_id",
    "rounds": f"""WITH RECURSIVE {_E}, r AS (SELECT * FROM e WHERE event_type = 'click'), {_FIRED.format('r', 24 * HOUR)},
g AS (SELECT e.user_id, e.event_type, e.us, f.us AS won, max(f.us) OVER (PARTITION BY e.user_id ORDER BY e.us, e.event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM e LEFT JOIN f USING (user_id, event_id) WHERE event_type IN ('click', 'error'))
SELECT user_id, count(won) AS rounds, sum(CASE WHEN event_type = 'error' AND (last IS NULL OR us - last >= {24 * HOUR}) THEN 1 ELSE 0 END)::BIGINT AS wrong FROM g GROUP BY user_id""",
    "memory_pairs": f"WITH {_E}, n AS (SELECT *, row_number() OVER {_W} - 1 AS n, lead(event_id) OVER {_W} AS k, lead(event_type) OVER {_W} AS v FROM e) SELECT user_id, event_id AS first, k AS second, event_type = v AS match FROM n WHERE n % 2 = 0 AND k IS NOT NULL",
    "drag_pairs": f"WITH {_E}, n AS (SELECT *, lag(event_id) OVER {_W} AS k, lag(event_type) OVER {_W} AS b, lag(us) OVER {_W} AS t FROM e WHERE event_type IN ('view', 'click')) SELECT user_id, k AS down_id, event_id AS up_id, us - t AS us FROM n WHERE event_type = 'click' AND b = 'view'",
    "note_highlight": f"WITH {_E} SELECT event_id, least(coalesce(lead(us) OVER {_W} - us, {8 * HOUR}), {8 * HOUR})::BIGINT AS shown_us FROM e",
    "navigation_depth": f"WITH {_E}, t AS (SELECT *, sum((event_type = 'signup')::INT) OVER {_W} AS tab FROM e), s AS (SELECT *, sum(CASE WHEN event_type IN ('view', 'click') THEN 1 WHEN event_type = 'error' THEN -1 ELSE 0 END) OVER w AS s FROM t WINDOW w AS (PARTITION BY user_id, tab ORDER BY us, event_id)) SELECT event_id, (s - least(0, min(s) OVER (PARTITION BY user_id, tab ORDER BY us, event_id)))::BIGINT AS depth FROM s",
    "ttl_active": f"WITH {_E} SELECT hour, count(*) AS active FROM (SELECT unnest(range(us // {HOUR} + 1, us // {HOUR} + 7)) AS hour FROM e) GROUP BY hour",
    "bounce": """WITH RECURSIVE b(ord, i, x, v) AS (SELECT DISTINCT user_id, 0, (user_id * 7 % 101)::DOUBLE, (user_id * 53 % 601 - 300)::DOUBLE FROM events UNION ALL
SELECT ord, i + 1, greatest(0.0, least(100.0, x + v * 0.05::DOUBLE)), CASE WHEN x + v * 0.05::DOUBLE < 0 THEN abs(v) WHEN x + v * 0.05::DOUBLE > 100 THEN -abs(v) ELSE v END FROM b WHERE i < 60)
SELECT ord, round(x, 6) AS x, v FROM b WHERE i = 60""",
}
