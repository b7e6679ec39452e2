"""State machines over one actor's events, replayed in order.

Spark deals the events by actor and sorts them; they stream through a task, which holds one actor's state, a few values
however long the actor's history is. Times are epoch microseconds, order is (us, key). Random choices of a game are the
least hash of actor, round and candidate, so a replay gives the same game.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, functions as F

from .events import micros


def folded(df: DataFrame, by: str, order: list[str], schema: str, start: Callable[[object], Callable[[tuple], Iterable[tuple]]]) -> DataFrame:
    """Rows of ``schema`` that each actor's machine emits: ``start(actor)`` makes it, and it is called with each row.

    ``df`` holds what the machine reads, in its order of columns. With a row of None the machine is told that the
    actor's events have ended.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)
    at = df.columns.index(by)

    def run(batches):
        actor, machine = None, None
        out: list[tuple] = []
        flush = lambda: pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k.type) for i, k in enumerate(kinds)], schema=kinds)
        for b in batches:
            for i in range(0, b.num_rows, 4096):
                for row in zip(*(c.slice(i, 4096).to_pylist() for c in b.columns)):
                    if machine is None or row[at] != actor:
                        if machine is not None:
                            out.extend(machine(None))
                        actor, machine = row[at], start(row[at])
                    out.extend(machine(row))
                if out:
                    yield flush()
                    out = []
        if machine is not None:
            out.extend(machine(None))
        yield flush()

    return df.repartition(by).sortWithinPartitions(by, *order).mapInArrow(run, schema)


def choice(candidates: Iterable, *seed):
    """The candidate whose hash with ``seed`` is least; None of none."""
    return min(candidates, key=lambda c: (hashlib.md5("|".join(map(str, (*seed, c))).encode()).hexdigest(), str(c)), default=None)


def puzzle(df: DataFrame, by: str, ts: str, key: str, piece: str, pieces: tuple[str, ...], flight_us: int, next_us: int) -> DataFrame:
    """(by, key, round, piece, placed, target): clicks on pieces of a puzzle, of which one place at a time is asked for.

    The piece of the place that shines is placed, others are refused. While a piece flies, and from the last one on until
    the next puzzle, clicks are ignored and emit nothing.
    """
    kind = dict(df.dtypes)

    def start(actor):
        number, placed, free, target = 1, set(), None, choice(pieces, actor, 1, 0)

        def step(row):
            nonlocal number, placed, free, target
            if row is None or free is not None and row[1] < free:
                return
            if target is None:
                number, placed = number + 1, set()
                target = choice(pieces, actor, number, 0)
            _, us, k, p = row
            yield actor, k, number, p, p == target, target
            if p == target:
                placed = placed | {p}
                target = choice([x for x in pieces if x not in placed], actor, number, len(placed))
                free = us + flight_us + (next_us if target is None else 0)

        return step

    rows = df.select(by, micros(F.col(ts)).alias("us"), key, F.col(piece).cast("string").alias("piece"))
    return folded(rows, by, ["us", key], f"`{by}` {kind[by]}, `{key}` {kind[key]}, round bigint, piece string, placed boolean, target string", start)


def balloons(df: DataFrame, by: str, ts: str, key: str, slot: str, pool: tuple[str, ...], replace_us: int, next_us: int, slots: int = 4) -> DataFrame:
    """(by, key, round, slot, item, hit): pops of balloons in ``slots`` places, of which one shows the item asked for.

    A popped balloon is ignored until it is replaced, ``replace_us`` later, by an item that is neither asked for nor in
    another place. The right one ends the round; until the next, ``next_us`` later, all pops are ignored.
    """
    kind = dict(df.dtypes)

    def start(actor):
        number, items, target, due, ends, made = 0, [], None, {}, None, 0

        def deal():
            nonlocal number, items, target, due, ends
            number += 1
            left, items = list(pool), []
            for i in range(min(slots, len(pool))):
                items.append(choice(left, actor, number, i))
                left.remove(items[-1])
            target, due, ends = choice(items, actor, number, "target"), {}, None

        def step(row):
            nonlocal made
            if row is None:
                return
            _, us, k, s = row
            if ends is not None and us < ends:
                return
            if ends is not None:
                deal()
            for place, at in sorted(due.items(), key=lambda x: (x[1], x[0])):
                if at <= us:
                    made += 1
                    others = [x for i, x in enumerate(items) if i != place]
                    fresh = choice([x for x in pool if x not in others and x != target], actor, number, f"new{made}")
                    items[place] = items[place] if fresh is None else fresh
                    del due[place]
            if s is None or not 0 <= s < len(items) or s in due:
                return
            yield actor, k, number, s, items[s], items[s] == target
            if items[s] == target:
                finish(us)
            else:
                due[s] = us + replace_us

        def finish(us):
            nonlocal ends
            ends = us + next_us

        deal()
        return step

    rows = df.select(by, micros(F.col(ts)).alias("us"), key, F.col(slot).cast("long").alias("slot"))
    return folded(rows, by, ["us", key], f"`{by}` {kind[by]}, `{key}` {kind[key]}, round bigint, slot bigint, item string, hit boolean", start)


def reading(df: DataFrame, by: str, ts: str, key: str, word: str, sizes: tuple[int, ...], gaze_us: int, turn_us: int, auto_us: int | None = None) -> DataFrame:
    """(by, us, what, page, word): words read and pages turned by a gaze that enters words; each event ends the one before.

    Only the word behind the last one read reacts, if it is held for ``gaze_us``. The last word of a page turns it
    ``turn_us`` later, unless it is the last page. With ``auto_us`` a page turns by itself that long after it came up. A
    turn sets reading back to the page's start and ends a gaze. An event of no word (null) only ends the gaze. ``sizes``:
    words of each page.
    """
    kind = dict(df.dtypes)
    last_page = len(sizes) - 1

    def start(actor):
        page, read, turn, gaze, open_us = 0, -1, None, None, None

        def until(us):
            """What happens before ``us`` (None: to the end), in order of time; a word read at a turn's moment comes first."""
            nonlocal page, read, turn, gaze, open_us
            while True:
                turns = [x for x in (turn, open_us + auto_us if auto_us is not None and open_us is not None and page < last_page else None) if x is not None]
                reads = gaze[0] + gaze_us if gaze else None
                first = min((x for x in (*turns, reads) if x is not None), default=None)
                if first is None or us is not None and first > us:
                    return
                if reads == first:
                    read, gaze = gaze[1], None
                    yield actor, first, "read", page, read
                    if read == sizes[page] - 1 and page < last_page:
                        turn = first + turn_us
                else:
                    page, read, turn, gaze, open_us = page + 1, -1, None, None, first
                    yield actor, first, "turn", page, None

        def step(row):
            nonlocal gaze, open_us
            if row is None:
                yield from until(None)
                return
            _, us, _, w = row
            if open_us is None:
                open_us = us
            yield from until(us)
            gaze = (us, w) if w is not None and w == read + 1 and w < sizes[page] else None

        return step

    rows = df.select(by, micros(F.col(ts)).alias("us"), key, F.col(word).cast("long").alias("word"))
    return folded(rows, by, ["us", key], f"`{by}` {kind[by]}, us bigint, what string, page bigint, word bigint", start)


def screens(df: DataFrame, by: str, ts: str, key: str, event: str, tab: str, back: str, opens: dict[str, str]) -> DataFrame:
    """(by, key, game, story, music): which screens are open after each event.

    ``opens`` names the screen that an event opens. A tab closes all; back closes the game, else the story, else music.
    """
    kind = dict(df.dtypes)
    names = ("game", "story", "music")

    def start(actor):
        shown = dict.fromkeys(names, False)

        def step(row):
            if row is None:
                return
            _, _, k, e = row
            if e == tab:
                shown.update(dict.fromkeys(names, False))
            elif e == back:
                top = next((n for n in names if shown[n]), None)
                if top:
                    shown[top] = False
            elif e in opens:
                shown[opens[e]] = True
            yield (actor, k, *(shown[n] for n in names))

        return step

    rows = df.select(by, micros(F.col(ts)).alias("us"), key, F.col(event).alias("event"))
    return folded(rows, by, ["us", key], f"`{by}` {kind[by]}, `{key}` {kind[key]}, game boolean, story boolean, music boolean", start)


def auto_turns(df: DataFrame, by: str, ts: str, page: str, last: int, hold_us: int, *order: str) -> DataFrame:
    """``turns`` and ``page_after``: how often pages turn by themselves between an event and the actor's next.

    A page turns ``hold_us`` after it came up, but for the last; so an actor's history needs no fold, only the next event.
    """
    from pyspark.sql import Window

    gap = F.lead(micros(F.col(ts))).over(Window.partitionBy(by).orderBy(ts, *order)) - micros(F.col(ts))
    left = F.greatest(F.lit(last) - F.col(page), F.lit(0))
    turns = F.least(left, F.coalesce(F.floor(gap / hold_us), left)).cast("long")
    return df.withColumn("turns", turns).withColumn("page_after", F.col(page) + F.col("turns"))


def visits(df: DataFrame, by: str, ts: str, keys: list[str], *order: str) -> DataFrame:
    """``visit`` and ``place``: a visit begins where a key differs from the event before; places in it count from 0."""
    from pyspark.sql import Window

    w = Window.partitionBy(by).orderBy(ts, *order)
    now: Column = F.struct(*keys)
    fresh = F.coalesce(~now.eqNullSafe(F.lag(now).over(w)), F.lit(True)) | (F.row_number().over(w) == 1)
    out = df.withColumn("visit", fresh.cast("int")).withColumn("visit", F.sum("visit").over(w).cast("long"))
    return out.withColumn("place", (F.row_number().over(Window.partitionBy(by, "visit").orderBy(ts, *order)) - 1).cast("long"))
