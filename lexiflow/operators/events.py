"""Pointer and answer events in batch form. Each operator needs a total order, here (ts, id) of one actor.

Times are compared as epoch microseconds. Windows and folds stream an actor's events through one task in order; nothing
gathers an actor's events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from . import scan


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def dwell(df: DataFrame, by: list[str], ts: str, event: str, start: str, hold_us: int, *order: str, gate: Column | None = None) -> DataFrame:
    """Events of kind ``start`` that no other event of the same actor ends within ``hold_us``; ``fired_us`` is when it fires.

    ``gate``, if given, has to be true when the event begins; what it becomes later does not matter.
    """
    w = Window.partitionBy(*by).orderBy(ts, *order)
    nxt = F.lead(micros(F.col(ts))).over(w)
    begins = F.col(event) == start if gate is None else (F.col(event) == start) & gate
    held = df.withColumn("__next", nxt).filter(begins).filter(F.col("__next").isNull() | (F.col("__next") - micros(F.col(ts)) >= hold_us))
    return held.withColumn("fired_us", micros(F.col(ts)) + hold_us).drop("__next")


def progress(elapsed: Column, hold: float) -> tuple[Column, Column]:
    """Share of the hold that is over, and the jitter's amplitude."""
    p = F.least(elapsed / F.lit(hold), F.lit(1.0))
    return p, 4 * p * p


def cooldown(df: DataFrame, by: str, ts: str, key: str, pause_us: int) -> DataFrame:
    """(by, key, us) of events that fire: those within ``pause_us`` after one that fired are ignored.

    An actor's events may be spread over many tasks, see ``scan.cooldown``.
    """
    return scan.cooldown(df.select(by, key, micros(F.col(ts)).alias("us")), by, key, pause_us)


def gaze_names(df: DataFrame, by: str, ts: str, key: str, event: str, start: str, hold_us: int, pause_us: int) -> DataFrame:
    """(by, key, us) of gazes that name something: held for ``hold_us``, when they fire; ``us`` is when they began.

    Those that begin within ``pause_us`` after a firing are ignored, however long they are held.
    """
    return cooldown(dwell(df, [by], ts, event, start, hold_us, key), by, ts, key, hold_us + pause_us)


def funnel(df: DataFrame, by: str, ts: str, key: str, event: str, steps: list[str]) -> DataFrame:
    """(by, reached, last_us): how many ``steps`` an actor took in order, each after the one before.

    One partial aggregate and one join for each step; a hot actor's events are summed before they are shuffled.
    """
    e = df.select(by, F.col(event).alias("__e"), F.struct(micros(F.col(ts)).alias("us"), F.col(key).alias("k")).alias("at"))
    state = e.groupBy(by).agg(F.min(F.when(F.col("__e") == steps[0], F.col("at"))).alias("at")).withColumn("reached", F.when(F.col("at").isNotNull(), 1).otherwise(0).cast("long"))
    for i, step in enumerate(steps[1:], 1):
        ahead = e.filter(F.col("__e") == step).join(state.filter(F.col("reached") == i).select(by, F.col("at").alias("__from")), by).filter("at > __from").groupBy(by).agg(F.min("at").alias("__at"))
        state = state.join(ahead, by, "left").select(by, F.coalesce("__at", "at").alias("at"), F.when(F.col("__at").isNotNull(), i + 1).otherwise(F.col("reached")).cast("long").alias("reached"))
    return state.select(by, "reached", F.col("at.us").alias("last_us"))


def collect_all(df: DataFrame, by: str, ts: str, item: str, total: int) -> DataFrame:
    """When each actor had found ``total`` different items; null where some are missing."""
    first = df.groupBy(by, item).agg(F.min(micros(F.col(ts))).alias("us"))
    return first.groupBy(by).agg(F.count("*").alias("found"), F.when(F.count("*") == total, F.max("us")).alias("done_us"))


def rounds(df: DataFrame, by: str, ts: str, key: str, event: str, right: str, wrong: str, lock_us: int) -> DataFrame:
    """(by, rounds, wrong): right answers outside of the lock that follows each right answer, and wrong ones outside of it."""
    ends = cooldown(df.filter(F.col(event) == right), by, ts, key, lock_us)
    e = df.filter(F.col(event).isin(right, wrong)).select(by, key, micros(F.col(ts)).alias("us"), F.col(event).alias("__e")).join(ends.select(by, key, F.col("us").alias("__won")), [by, key], "left")
    w = Window.partitionBy(by).orderBy("us", key).rowsBetween(Window.unboundedPreceding, -1)
    e = e.withColumn("__last", F.last("__won", ignorenulls=True).over(w))
    free = (F.col("__e") == wrong) & (F.col("__last").isNull() | (F.col("us") - F.col("__last") >= lock_us))
    return e.groupBy(by).agg(F.count("__won").alias("rounds"), F.sum(free.cast("long")).alias("wrong"))


def pairs(df: DataFrame, by: str, ts: str, key: str, value: str) -> DataFrame:
    """Two turned cards at a time, in order: whether they match. A last single card is left out."""
    w = Window.partitionBy(by).orderBy(ts, key)
    n = df.withColumn("__n", F.row_number().over(w) - 1).withColumn("__v", F.lead(value).over(w)).withColumn("__k", F.lead(key).over(w))
    return n.filter("__n % 2 = 0 AND __k IS NOT NULL").select(by, F.col(key).alias("first"), F.col("__k").alias("second"), (F.col(value) == F.col("__v")).alias("match"))


def turns(df: DataFrame, by: str, ts: str, key: str, card: str, face: str, match_us: int, miss_us: int, deck: int, next_us: int) -> DataFrame:
    """(by, first, second, match) of the pairs that the memory game turns; ignored clicks turn nothing.

    Ignored are clicks on a matched card or on the one selected, and those within ``match_us`` after a match or ``miss_us``
    after a miss. When all ``deck`` cards are matched, a new round begins ``next_us`` later. A last single card is left
    out. State is one round's cards at most, so an actor's clicks stream through one task in order.
    """
    from .machines import folded

    kinds = dict(df.dtypes)

    def start(actor):
        matched, picked, free = set(), None, None

        def step(row):
            nonlocal matched, picked, free
            if row is None or free is not None and row[1] < free:
                return
            _, us, k, c, f = row
            if len(matched) == deck:
                matched = set()
            if c in matched or picked and c == picked[1]:
                return
            if picked is None:
                picked = k, c, f
                return
            same = f == picked[2]
            yield actor, picked[0], k, same
            free = us + (match_us if same else miss_us)
            if same:
                matched = matched | {c, picked[1]}
                free += next_us if len(matched) == deck else 0
            picked = None

        return step

    rows = df.select(by, micros(F.col(ts)).alias("us"), key, F.col(card).alias("card"), F.col(face).alias("face"))
    return folded(rows, by, ["us", key], f"`{by}` {kinds[by]}, first {kinds[key]}, second {kinds[key]}, match boolean", start)


def drags(df: DataFrame, by: str, ts: str, key: str, event: str, down: str, up: str) -> DataFrame:
    """Each ``up`` with the ``down`` right before it among downs and ups; an up without one is left out."""
    w = Window.partitionBy(by).orderBy(ts, key)
    e = df.filter(F.col(event).isin(down, up)).withColumn("__b", F.lag(event).over(w)).withColumn("__k", F.lag(key).over(w)).withColumn("__t", F.lag(micros(F.col(ts))).over(w))
    return e.filter((F.col(event) == up) & (F.col("__b") == down)).select(by, F.col("__k").alias("down_id"), F.col(key).alias("up_id"), (micros(F.col(ts)) - F.col("__t")).alias("us"))


def drawn_boxes(df: DataFrame, by: str, ts: str, key: str, event: str, down: str, up: str, x: str, y: str, least: float = 3.0) -> DataFrame:
    """(by, down_id, up_id, left, top, width, height) of the boxes that drags draw; those below ``least`` on a side are none.

    Corners are clamped to 0..100 before they are joined.
    """
    from ..functions.values import clamp, rectangle

    w = Window.partitionBy(by).orderBy(ts, key)
    e = df.filter(F.col(event).isin(down, up)).withColumns({c: F.lag(v).over(w) for c, v in (("__b", event), ("__k", key), ("__x", x), ("__y", y))})
    box = rectangle(*(clamp(F.col(c)) for c in ("__x", "__y", x, y)))
    drawn = e.filter((F.col(event) == up) & (F.col("__b") == down)).select(by, F.col("__k").alias("down_id"), F.col(key).alias("up_id"), box.alias("box"))
    return drawn.select(by, "down_id", "up_id", "box.*").filter((F.col("width") >= least) & (F.col("height") >= least))


def shown_until(df: DataFrame, by: str, ts: str, key: str, most_us: int) -> DataFrame:
    """``shown_us``: how long each note stays lit, until the next or ``most_us``."""
    w = Window.partitionBy(by).orderBy(ts, key)
    return df.withColumn("shown_us", F.least(F.coalesce(F.lead(micros(F.col(ts))).over(w) - micros(F.col(ts)), F.lit(most_us)), F.lit(most_us)))


def depth(df: DataFrame, by: str, ts: str, key: str, event: str, reset: str, opens: list[str], back: str) -> DataFrame:
    """``depth`` of open screens after each event: ``reset`` closes all, ``opens`` add one, ``back`` closes one if there is any."""
    w = Window.partitionBy(by).orderBy(ts, key)
    e = df.withColumn("__tab", F.sum((F.col(event) == reset).cast("int")).over(w))
    own = Window.partitionBy(by, "__tab").orderBy(ts, key)
    move = F.when(F.col(event).isin(opens), 1).when(F.col(event) == back, -1).otherwise(0)
    e = e.withColumn("__s", F.sum(move).over(own))
    return e.withColumn("depth", (F.col("__s") - F.least(F.lit(0), F.min("__s").over(own))).cast("long")).drop("__tab", "__s")


def active_by_hour(df: DataFrame, ts: str, hours: int) -> DataFrame:
    """(hour, active): items alive at each full hour, each for ``hours`` after its time."""
    at = F.floor(micros(F.col(ts)) / 3_600_000_000).cast("long")
    return df.select(F.explode(F.sequence(at + 1, at + hours)).alias("hour")).groupBy("hour").agg(F.count("*").alias("active"))


def bounced(x: Column, v: Column, frames: int, dt: float, low: float, high: float) -> Column:
    """(x, v) after ``frames`` frames of ``dt`` seconds; see ``moved``."""
    return moved(x, v, F.array_repeat(F.lit(float(dt)), frames), low, high)


def moved(x: Column, v: Column, frames: Column, low: float, high: float) -> Column:
    """(x, v) after ``frames``, an array of seconds of which each counts 0.05 at most, between two walls.

    A wall that is passed holds the position and sends the speed away from it.
    """
    def move(s, dt):
        at = s["x"] + s["v"] * F.least(dt, F.lit(0.05))
        return F.struct(F.greatest(F.lit(low), F.least(F.lit(high), at)).alias("x"), F.when(at < low, F.abs(s["v"])).when(at > high, -F.abs(s["v"])).otherwise(s["v"]).alias("v"))
    return F.aggregate(frames, F.struct(x.cast("double").alias("x"), v.cast("double").alias("v")), move)
