"""Dwell, cooldown and funnel as keyed state machines in the order of event time.

Input streams have (user_id, element_id, event_type, ts). Rows of a micro-batch, and micro-batches among each other, may
come in any order within the watermark's delay: a key's events wait in state, and an event-time timer releases them,
sorted by (ts, event_type, element_id), once the watermark has reached them. What comes later than the watermark is
dropped by Spark. The same timer fires what is due without an event (a dwell) and forgets what has no more effect, so
state is the events of one delay and a few numbers for each key that is active.

Keys are dealt to ``buckets`` by their hash, and Spark's state is kept by bucket: a micro-batch is one append and a timer
one read for all keys of a bucket, where a call to the state store for every key would take most of the time. A task
holds one bucket's waiting events at a time. A call takes about as long as fifty events, so a bucket should have
thousands of them (``buckets_for``), and nothing is asked of the store that is known already.

The state store must be able to hold several states of a key (``spark.sql.streaming.stateStore.providerClass``: RocksDB).
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: How long a funnel waits for its next step in event time.
IDLE_MS = 365 * 24 * 3_600_000
#: Buckets of keys; more of them for more events within one delay, since a bucket's are in memory at once.
BUCKETS = 1024
#: Events of a bucket, and the least buckets, where the number of events is known.
BUCKET_EVENTS, LEAST_BUCKETS = 1 << 14, 256


def buckets_for(events: int) -> int:
    """So many buckets that one's events, and the calls for each of them, stay as they are however many events come."""
    return max(LEAST_BUCKETS, -(-events // BUCKET_EVENTS))


class Dwell:
    """An ``enter`` that no other event of its key ends for ``hold_ms`` fires once.

    ``until_ms``: one that nothing ended at all fires only before that moment; None: always.
    """

    def __init__(self, hold_ms: int, until_ms: int | None = None):
        self.hold_ms, self.until_ms = hold_ms, until_ms

    def step(self, state, ms: int, kind: str, element: str):
        fired = None
        if state and ms - state[0] >= self.hold_ms:
            fired = state[0] + self.hold_ms
        return ((ms,) if kind == "enter" else None), fired

    def due(self, state) -> int:
        return state[0] + self.hold_ms

    def at(self, state):
        fired = state[0] + self.hold_ms
        return None, fired if self.until_ms is None or fired < self.until_ms else None


class Cooldown:
    """Events less than ``pause_ms`` after one that fired are ignored."""

    def __init__(self, pause_ms: int):
        self.pause_ms = pause_ms

    def step(self, state, ms: int, kind: str, element: str):
        if state and ms - state[0] < self.pause_ms:
            return state, None
        return (ms,), ms

    def due(self, state) -> int:
        return state[0] + self.pause_ms

    def at(self, state):
        return None, None


class Funnel:
    """``steps`` taken in their order, each firing; a funnel ends ``idle_ms`` after its last step, and another may begin."""

    def __init__(self, steps: list[str], idle_ms: int):
        self.steps, self.idle_ms = steps, idle_ms

    def step(self, state, ms: int, kind: str, element: str):
        done, last = state or (0, ms)
        if ms - last >= self.idle_ms:
            done, state = 0, None
        if done < len(self.steps) and kind == self.steps[done]:
            return (done + 1, ms), ms
        return state, None

    def due(self, state) -> int:
        return state[1] + self.idle_ms

    def at(self, state):
        return None, None


class Timed(StatefulProcessor):
    """State of a bucket of keys: rows that wait for the watermark, what is remembered of keys, and one timer.

    A subclass has ``rows(frame)``, tuples that begin with the milliseconds, and ``wakes(ms)``, when a row is to be released.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "rows binary")
        self.state = handle.getValueState("state", "keys binary")
        self.timer = handle.getValueState("timer", "ms bigint")

    def wakes(self, ms: int) -> int:
        return ms

    def wake(self, ms: int | None) -> None:
        """Keep one timer for the bucket, at ``ms``, after the one before it has fired."""
        if ms is None:
            self.timer.clear()
        else:
            self.handle.registerTimer(ms)
            self.timer.update((ms,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [x for f in rows for x in self.rows(f)]
        self.held.appendValue((pickle.dumps(new),))
        first, old = min(self.wakes(x[0]) for x in new), self.timer.get()
        if old is None or first < old[0]:
            if old is not None:
                self.handle.deleteTimer(old[0])
            self.wake(first)
        return iter(())

    def released(self, now: int) -> tuple[list[tuple], list[tuple], dict]:
        """Rows that the watermark ``now`` has reached, those it has not, and what is remembered of keys."""
        ready, left, packs = [], [], 0
        for (pack,) in self.held.get():
            packs += 1
            for x in pickle.loads(pack):
                (ready if self.wakes(x[0]) <= now else left).append(x)
        if not left:
            self.held.clear()
        elif ready or packs > 1:
            self.held.put([(pickle.dumps(left),)])
        keys = self.state.get()
        return ready, left, pickle.loads(keys[0]) if keys is not None else {}

    def remember(self, keys: dict) -> None:
        if keys:
            self.state.update((pickle.dumps(keys),))
        else:
            self.state.clear()

    def close(self) -> None:
        pass


def millis(f: pd.DataFrame) -> list[int]:
    return f["ts"].astype("datetime64[ms]").astype("int64").tolist()


def in_buckets(rows: DataFrame, by: list[str], delay: str, buckets: int) -> DataFrame:
    """``rows`` with a watermark, their key's bucket, and users as text, since pandas has no null among whole numbers."""
    bucket = F.pmod(F.xxhash64(*by), F.lit(buckets)).alias("bucket")
    return rows.withWatermark("ts", delay).select(bucket, F.col("user_id").cast("string").alias("user_id"), *(c for c in rows.columns if c != "user_id"))


class InOrder(Timed):
    """Runs a machine over each key's events in the order of event time.

    A machine has ``step(state, ms, kind, element)`` and ``at(state)`` for the moment ``due(state)`` when no event came before
    it, both giving the next state (None: nothing to remember) and when something fired or None.
    """

    def __init__(self, machine, by_element: bool):
        self.machine, self.by_element = machine, by_element

    def rows(self, f: pd.DataFrame):
        return zip(millis(f), f["event_type"].tolist(), f["element_id"].tolist(), f["user_id"].tolist())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        ready, left, states = self.released(now)
        ready.sort(key=lambda x: (x[0], x[1] is not None, x[1] or "", x[2] is not None, x[2] or ""))
        step, due, fired = self.machine.step, self.machine.due, []
        for ms, kind, element, user in ready:
            k = (user, element) if self.by_element else (user, None)
            state, at = step(states.get(k), ms, kind, element)
            if at is not None:
                fired.append((user, element, at))
            if state:
                states[k] = state
            else:
                states.pop(k, None)
        for k in [k for k, state in states.items() if due(state) <= now]:
            state, at = self.machine.at(states.pop(k))
            if at is not None:
                fired.append((*k, at))
            if state:
                states[k] = state
        self.remember(states)
        self.wake(min([x[0] for x in left] + [due(s) for s in states.values()], default=None))
        if fired:
            yield pd.DataFrame(fired, columns=["user_id", "element_id", "fired_ms"])


def in_order(events: DataFrame, by: list[str], machine, delay: str, buckets: int) -> DataFrame:
    """What ``machine`` fires over each key's events, as a stream of (user_id, element_id, fired_ms)."""
    rows = in_buckets(events.select("user_id", "element_id", "event_type", "ts"), by, delay, buckets)
    out = rows.groupBy("bucket").transformWithStateInPandas(InOrder(machine, "element_id" in by), "user_id string, element_id string, fired_ms bigint", "append", "eventTime")
    return out.select(F.col("user_id").cast("bigint").alias("user_id"), "element_id", "fired_ms")


def dwell_stream(events: DataFrame, hold_ms: int = 1500, delay: str = "1 minute", until_ms: int | None = None, buckets: int = BUCKETS) -> DataFrame:
    """An ``enter`` that no leave, down, cancel or other enter of the same element ends for ``hold_ms`` fires once.

    ``until_ms``: when the events end; what is open then fires only if it was due before.
    """
    return in_order(events, ["user_id", "element_id"], Dwell(hold_ms, until_ms), delay, buckets)


def cooldown_stream(firings: DataFrame, pause_ms: int = 1500, delay: str = "1 minute", buckets: int = BUCKETS) -> DataFrame:
    """Events of a user less than ``pause_ms`` after one that fired are ignored; after that the user is forgotten."""
    return in_order(firings, ["user_id"], Cooldown(pause_ms), delay, buckets)


def funnel_stream(events: DataFrame, steps: list[str], delay: str = "1 minute", idle_ms: int = IDLE_MS, buckets: int = BUCKETS) -> DataFrame:
    """(user_id, element_id, fired_ms) of each step taken in its turn; other events are ignored."""
    return in_order(events, ["user_id"], Funnel(steps, idle_ms), delay, buckets)
