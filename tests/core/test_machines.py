"""The machines against the rules written as a simulation of timers."""

import heapq
import random

from lexiflow.operators import events as E, machines as G


def frame(spark, rows, value):
    return spark.createDataFrame(rows, f"user_id bigint, us bigint, event_id bigint, {value}").selectExpr("user_id", "timestamp_micros(us) AS ts", "event_id", value.split()[0]).repartition(3)


def clicks(seed, users, n, step, values):
    r = random.Random(seed)
    rows, k = [], 0
    for u in range(users):
        us = 0
        for _ in range(n):
            us += r.randrange(step)
            rows.append((u, us, k, r.choice(values)))
            k += 1
    return rows


def test_puzzle(spark):
    pieces = ("a", "b", "c", "d")
    rows = clicks(1, 7, 120, 30, [*pieces, "z"])
    got = [tuple(x) for x in G.puzzle(frame(spark, rows, "piece string"), "user_id", "ts", "event_id", "piece", pieces, 20, 50).orderBy("event_id").collect()]
    want = []
    for u in range(7):
        number, placed, free, target = 1, [], None, G.choice(pieces, u, 1, 0)
        for _, us, k, p in (x for x in rows if x[0] == u):
            if free is not None and us < free:
                continue
            if target is None:
                number, placed, target = number + 1, [], G.choice(pieces, u, number + 1, 0)
            want.append((u, k, number, p, p == target, target))
            if p == target:
                placed.append(p)
                target = G.choice([x for x in pieces if x not in placed], u, number, len(placed))
                free = us + 20 + (0 if target else 50)
    assert got == want and max(x[2] for x in got) > 2


def test_balloons(spark):
    pool = tuple("abcdefgh")
    rows = clicks(2, 6, 150, 30, [0, 1, 2, 3, 4, None])
    got = G.balloons(frame(spark, rows, "slot int"), "user_id", "ts", "event_id", "slot", pool, 25, 90).collect()
    assert got
    times = {k: us for _, us, k, _ in rows}
    for u in range(6):
        own = sorted((x for x in got if x.user_id == u), key=lambda x: x.event_id)
        for number in {x.round for x in own}:
            mine = [x for x in own if x.round == number]
            hits = [x for x in mine if x.hit]
            assert len(hits) <= 1 and all(x.event_id <= hits[0].event_id for x in mine if hits)
            for a, b in zip(mine, mine[1:]):
                if a.slot == b.slot:
                    assert times[b.event_id] >= times[a.event_id] + 25
            later = [x for x in own if x.round == number + 1]
            assert not (hits and later) or times[later[0].event_id] >= times[hits[0].event_id] + 90
            if hits:
                assert all(x.item != hits[0].item for x in mine if not x.hit)


def simulated(rows, sizes, gaze_us, turn_us, auto_us):
    """Timers in a queue: each event cancels a gaze; a turn cancels all."""
    out, last = [], len(sizes) - 1
    for u in sorted({r[0] for r in rows}):
        own = [r for r in rows if r[0] == u]
        page, read, queue, n, alive = 0, -1, [], 0, {}
        if not own:
            continue

        def timer(at, what, word=None):
            nonlocal n
            n += 1
            alive[what] = n
            heapq.heappush(queue, (at, 0 if what == "read" else 1, n, what, word))

        if auto_us is not None and page < last:
            timer(own[0][1], "none")
            timer(own[0][1] + auto_us, "auto")
        events = [(r[1], r[3]) for r in own] + [(None, None)]
        for us, word in events:
            while queue and (us is None or queue[0][0] <= us):
                at, _, k, what, w = heapq.heappop(queue)
                if alive.get(what) != k:
                    continue
                if what == "read":
                    read = w
                    out.append((u, at, "read", page, w))
                    if w == sizes[page] - 1 and page < last:
                        timer(at + turn_us, "turn")
                elif what in ("turn", "auto"):
                    page, read, alive = page + 1, -1, {}
                    out.append((u, at, "turn", page, None))
                    if auto_us is not None and page < last:
                        timer(at + auto_us, "auto")
            if us is None:
                break
            alive.pop("read", None)
            if word is not None and word == read + 1 and word < sizes[page]:
                timer(us + gaze_us, "read", word)
    return sorted(out, key=str)


def test_reading(spark):
    rows = clicks(3, 8, 150, 40, [0, 1, 2, 3, None, 0, 1, 2])
    for auto in (None, 400, 97):
        got = [tuple(x) for x in G.reading(frame(spark, rows, "word int"), "user_id", "ts", "event_id", "word", (3, 4, 2), 15, 21, auto).collect()]
        assert sorted(got, key=str) == simulated(rows, (3, 4, 2), 15, 21, auto) and got


def test_cooldown_and_gaze(spark):
    rows = [(1, 0, 0, "view"), (1, 800, 1, "leave"), (1, 1000, 2, "view"), (1, 2100, 3, "leave"), (1, 2300, 4, "view")]
    df = frame(spark, rows, "event string")
    got = [x.event_id for x in E.gaze_names(df, "user_id", "ts", "event_id", "event", "view", 700, 1500).orderBy("us").collect()]
    assert got == [0, 4]
    assert [x.event_id for x in E.cooldown(df, "user_id", "ts", "event_id", 1000).orderBy("us").collect()] == [0, 2, 3]
    assert E.cooldown(df.limit(0), "user_id", "ts", "event_id", 1000).count() == 0
