"""The memory game's clicks, by hand and against its rules written out with timers."""

from datetime import datetime, timedelta, timezone

from lexiflow.operators import events as E
from lexiflow.queries import queries

HOUR = 3_600_000_000


def flip(clicks, match_us, miss_us, deck, next_us):
    """MemoryGame.jsx: timers that are due run before a click."""
    busy, selected, matched, timers, out = False, [], set(), [], []
    for us, k, card, face in clicks:
        while timers and timers[0][0] <= us:
            at, what = timers.pop(0)
            if what == "round":
                busy, selected, matched = False, [], set()
                continue
            if what == "match":
                matched |= {s[1] for s in selected}
            selected = []
            if len(matched) == deck:
                timers.append((at + next_us, "round"))
            else:
                busy = False
        if busy or card in matched or card in [s[1] for s in selected]:
            continue
        selected.append((k, card, face))
        if len(selected) == 2:
            busy, same = True, selected[0][2] == face
            out.append((selected[0][0], k, same))
            timers.append((us + (match_us if same else miss_us), "match" if same else "miss"))
    return out


def test_turns(spark):
    start = datetime(2024, 1, 1, tzinfo=timezone.utc)
    # ms, card: a repeated click, clicks while busy, clicks on matched cards, a whole round and the next one.
    clicks = [(0, 0), (10, 0), (20, 3), (30, 1), (470, 3), (480, 1), (500, 5), (1599, 2), (1600, 1), (1700, 4), (2149, 2), (2150, 2), (2200, 5), (5649, 0), (5650, 0), (5700, 1)]
    rows = [(1, start + timedelta(milliseconds=ms), i, c, c % 3) for i, (ms, c) in enumerate(clicks)] + [(None, start, 99, 0, 0)]
    df = spark.createDataFrame(rows, "a bigint, ts timestamp, k bigint, card int, face int")
    got = [tuple(r) for r in E.turns(df, "a", "ts", "k", "card", "face", 450_000, 1_100_000, 6, 3_000_000).collect()]
    assert got == [(1, 0, 2, True), (1, 5, 6, False), (1, 8, 9, True), (1, 11, 12, True), (1, 14, 15, False)]
    assert [x[1:] for x in got] == flip([(ms * 1000, i, c, c % 3) for i, (ms, c) in enumerate(clicks)], 450_000, 1_100_000, 6, 3_000_000)


def test_query(spark):
    d = "/root/testdata/sf0.001"
    events = spark.read.parquet(f"{d}/events.parquet").select("user_id", E.micros(E.F.col("ts")).alias("us"), "event_id").collect()
    want = set()
    for u in {e.user_id for e in events}:
        clicks = [(e.us, e.event_id, e.event_id % 6, e.event_id % 3) for e in sorted(events, key=lambda e: (e.us, e.event_id)) if e.user_id == u]
        want |= {(u, *x) for x in flip(clicks, 4 * HOUR, 11 * HOUR, 6, 30 * HOUR)}
    assert {tuple(r) for r in queries()["memory_turns"](spark, d).collect()} == want and len(want) > 100
