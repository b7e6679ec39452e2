"""What changes between a key's snapshots, from a stream of their rows.

Input streams have (user_id, slot, value, ts). A snapshot is what a user has in one window of ``width_ms``; of several rows of
a slot the last counts, and a slot without a value is a slot. A snapshot is complete when the watermark has passed its
window; it is then compared with the user's snapshot before, which the state keeps. Windows without a row are no
snapshot. Rows may come in any order within the watermark's delay.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .gaze import BUCKETS, Timed, in_buckets, millis

NAMES = ["user_id", "at_ms", "slot", "before", "after", "action"]


class Snapshots(Timed):
    """What is remembered of a user is the last snapshot, (slot, value) of its slots."""

    def __init__(self, width_ms: int):
        self.width = width_ms

    def wakes(self, ms: int) -> int:
        return ms - ms % self.width + self.width

    def rows(self, f: pd.DataFrame):
        values = (None if pd.isna(v) else v for v in f["value"])
        return zip(millis(f), f["slot"].tolist(), values, f["user_id"].tolist())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        ready, left, users = self.released(timerValues.getCurrentWatermarkInMs())
        windows: dict[int, dict] = {}
        for x in ready:
            windows.setdefault(x[0] - x[0] % self.width, {}).setdefault(x[3], []).append(x)
        out = []
        for at in sorted(windows):
            for user, rows in windows[at].items():
                rows.sort(key=lambda x: (x[0], x[2] is not None, x[2] or ""))
                before, after = users.get(user, {}), {s: v for _, s, v, _ in rows}
                for s in sorted(before.keys() | after.keys()):
                    a, b = before.get(s), after.get(s)
                    out.append((user, at, s, a, b, "create" if s not in before else "dispose" if s not in after else "keep" if a == b else "replace"))
                users[user] = after
        if windows:
            self.remember(users)
        self.wake(min((self.wakes(x[0]) for x in left), default=None))
        if out:
            yield pd.DataFrame({c: pd.Series([x[i] for x in out], dtype="int64" if c == "at_ms" else object) for i, c in enumerate(NAMES)})


def slot_stream(rows: DataFrame, width_ms: int, delay: str = "1 minute", buckets: int = BUCKETS) -> DataFrame:
    """(user_id, at_ms, slot, before, after, action): create, keep, replace or dispose for each slot of each new snapshot."""
    dealt = in_buckets(rows.select("user_id", "slot", "value", "ts"), ["user_id"], delay, buckets)
    out = dealt.groupBy("bucket").transformWithStateInPandas(Snapshots(width_ms), "user_id string, at_ms bigint, slot string, before string, after string, action string", "append", "eventTime")
    return out.select(F.col("user_id").cast("bigint").alias("user_id"), *NAMES[1:])
