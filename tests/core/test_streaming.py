"""Streams against the rules by hand, with late and shuffled rows."""

from datetime import datetime, timedelta

import pytest
from lexiflow.streaming import cooldown_stream, dwell_stream, funnel_stream
from lexiflow.streaming.replay import PROVIDER, STORE, dealt

START = datetime(2024, 1, 1)
SCHEMA = "user_id bigint, element_id string, event_type string, ts timestamp"

#: Lets the watermark pass all events.
END = [(None, None, None, 10**9)]


def run(spark, tmp_path, batches, make):
    """The rows that ``make``'s stream writes, one file for each batch."""
    source = tmp_path / "in"
    source.mkdir()
    for i, rows in enumerate(batches):
        part = spark.createDataFrame([(u, e, k, START + timedelta(milliseconds=ms)) for u, e, k, ms in rows], SCHEMA).coalesce(1)
        part.write.mode("append").json(str(source / f"b{i}"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("latestFirst", "false").json(str(source / "*"))
    spark.conf.set(PROVIDER, STORE)
    q = make(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    base = int(START.timestamp() * 1000)
    return sorted((r.user_id, r.element_id, r.fired_ms - base) for r in spark.read.parquet(str(tmp_path / "out")).collect())


@pytest.fixture
def utc(spark, monkeypatch):
    monkeypatch.setenv("TZ", "UTC")
    import time

    time.tzset()
    return spark


def test_dwell(utc, tmp_path):
    first = [(1, "a", "leave", 1499), (1, "a", "enter", 0), (1, "b", "enter", 0), (1, "b", "leave", 1501), (2, "a", "enter", 0), (2, "a", "down", 800), (3, "z", "enter", 5000)]
    later = [(9, "x", "leave", 600_000)]
    assert run(utc, tmp_path, [first, later, [(9, "x", "leave", 700_000)]], dwell_stream) == [(1, "b", 1500), (3, "z", 6500)]


def test_cooldown(utc, tmp_path):
    rows = [(1, "c", "hit", 3000), (1, "a", "hit", 700), (1, "b", "hit", 1700), (2, "a", "hit", 0)]
    assert run(utc, tmp_path, [rows, [(1, "d", "hit", 4400), (1, "e", "hit", 4500)], END], cooldown_stream) == [(1, "a", 700), (1, "c", 3000), (1, "e", 4500), (2, "a", 0)]


def test_funnel(utc, tmp_path):
    held = [(1, str(i), k, 1000 * i) for i, k in enumerate("bacbc")]
    assert run(utc, tmp_path, [held[:3][::-1], held[3:], END], lambda s: funnel_stream(s, ["a", "b", "c"])) == [(1, "1", 1000), (1, "3", 3000), (1, "4", 4000)]


def test_order_across_batches(utc, tmp_path):
    """The step that comes a batch late, but inside the watermark, is taken; one behind the watermark is not."""
    batches = [[(1, "x", "a", 10_000), (1, "z", "c", 30_000)], [(1, "y", "b", 20_000)], END]
    assert run(utc, tmp_path, batches, lambda s: funnel_stream(s, ["a", "b", "c"])) == [(1, "x", 10_000), (1, "y", 20_000), (1, "z", 30_000)]
    more = tmp_path / "behind"
    more.mkdir()
    batches = [[(1, "x", "a", 10_000), (1, "z", "c", 30_000), (2, "o", "a", 200_000)], [(3, "n", "c", 210_000)], [(1, "y", "b", 20_000)], END]
    assert run(utc, more, batches, lambda s: funnel_stream(s, ["a", "b", "c"])) == [(1, "x", 10_000), (2, "o", 200_000)]


def test_cooldown_across_batches(utc, tmp_path):
    batches = [[(1, "c", "hit", 3000)], [(1, "a", "hit", 700)], [(1, "b", "hit", 1700)], END]
    assert run(utc, tmp_path, batches, cooldown_stream) == [(1, "a", 700), (1, "c", 3000)]


def test_dwell_across_batches(utc, tmp_path):
    batches = [[(1, "a", "enter", 0), (1, "a", "enter", 5000)], [(1, "a", "leave", 900)], [(1, "a", "down", 6000)], END]
    assert run(utc, tmp_path, batches, dwell_stream) == []
    more = tmp_path / "held"
    more.mkdir()
    assert run(utc, more, [batches[0], [(1, "a", "leave", 1600)], batches[2], END], dwell_stream) == [(1, "a", 1500)]


def test_state_expires(utc, tmp_path):
    """A funnel is forgotten a minute after its last step; then it can begin anew."""
    rows = [(1, "p", "a", 0), (1, "q", "b", 59_000), (1, "r", "a", 60_000), (1, "s", "a", 119_000), (1, "t", "b", 120_000)]
    assert run(utc, tmp_path, [rows, END], lambda s: funnel_stream(s, ["a", "b"], idle_ms=60_000)) == [(1, "p", 0), (1, "q", 59_000), (1, "s", 119_000), (1, "t", 120_000)]


def test_state_holds_active_keys_only(utc, tmp_path):
    rows = [[(u, "e", "hit", 1000 * u) for u in range(200)], [(0, "e", "hit", 400_000)], [(0, "e", "hit", 800_000)]]
    run(utc, tmp_path, rows, cooldown_stream)
    state = utc.read.format("statestore").option("stateVarName", "state").load(str(tmp_path / "state"))
    assert {r.key[0] for r in state.collect()} <= {0}


def test_dealt_rows_come_late_across_files(utc):
    rows = utc.range(400).selectExpr("id", "timestamp_millis(id * 60000) AS ts")
    path = dealt(rows, "ts", "id", 5, 3600 * 10**6)
    files = [utc.read.parquet(path.replace("*", f"file{i}")).selectExpr("min(id)", "max(id)", "count(*)").first() for i in range(5)]
    assert sum(f[2] for f in files) == 400 and all(f[1] > g[0] for f, g in zip(files, files[1:]))
    assert utc.read.parquet(path).count() == 401


def test_replays_of_several_files(utc, tmp_path):
    """Each file of a table covers the whole time, and some dwells end within the last hour."""
    import duckdb
    from lexiflow.plans import streams as S
    from pyspark.sql import functions as F

    rows = utc.range(1200).withColumn("user_id", F.col("id") % 30)
    minute = F.when(F.col("id") >= 1170, 20_000 + F.col("user_id")).when((F.col("id") >= 1140), 19_700 + F.col("user_id") * 3).otherwise(F.col("id") * 17)
    kind = F.when(F.col("id").between(1140, 1169), "view").otherwise(F.element_at(F.array(*map(F.lit, ("view", "click", "purchase", "error"))), (F.col("id") * 7 % 4 + 1).cast("int")))
    # An element is its event's number modulo 3, so the last two events of a user share one.
    e = rows.select((F.col("user_id") * 3000 + F.when(F.col("id") >= 1140, F.floor(F.col("id") / 30) * 3).otherwise(F.col("id"))).alias("event_id"), F.expr("timestamp_ntz '2024-01-01 00:00:00'").alias("start"), "user_id", kind.alias("event_type"), minute.alias("minute"))
    e = e.select("event_id", (F.col("start") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("minute").cast("int"))).alias("ts"), "user_id", "event_type")
    e.repartition(5, "event_id").write.parquet(str(tmp_path / "events.parquet"))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    for q in (S.dwell_replay, S.cooldown_replay, S.funnel_replay, S.dwell_late):
        want = sorted(db.execute(S.SQL[q.__name__]).fetchall())
        assert len(want) > 30 and sorted(tuple(r) for r in q(utc, str(tmp_path)).collect()) == want, q.__name__


def events_of(spark, tmp_path, rows=900, users=12):
    """A table of events, each at its own time, in files that cover the whole time."""
    from pyspark.sql import functions as F

    e = spark.range(rows).select(F.col("id").alias("event_id"), F.expr("timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(id * 31 AS int))").alias("ts"), (F.col("id") * 7 % users).alias("user_id"), F.element_at(F.array(*map(F.lit, ("view", "click", "purchase", "error"))), (F.col("id") % 4 + 1).cast("int")).alias("event_type"))
    e.repartition(3, "event_id").write.parquet(str(tmp_path / "events.parquet"))


@pytest.mark.parametrize("name", ["slots_late", "cooldown_late"])
def test_replay_has_a_store_a_core(utc, tmp_path, monkeypatch, name):
    """A replay's tasks follow cores and rows, not the session's shuffle partitions, and its rows are those of its SQL."""
    import duckdb
    from lexiflow.plans import streams as S
    from lexiflow.streaming import gaze, replay

    monkeypatch.setattr(gaze, "LEAST_BUCKETS", 16)
    events_of(utc, tmp_path)
    monkeypatch.setattr(replay, "scratch", lambda _: str(tmp_path / "shared"))
    before = utc.conf.get("spark.sql.shuffle.partitions")
    utc.conf.set("spark.sql.shuffle.partitions", "24")
    try:
        got = sorted(map(tuple, S.QUERIES[name](utc, str(tmp_path)).collect()), key=repr)
        assert utc.conf.get("spark.sql.shuffle.partitions") == "24"
    finally:
        utc.conf.set("spark.sql.shuffle.partitions", before)
    (state,) = (tmp_path / "shared").glob("replay-*/state")
    assert utc.read.format("state-metadata").load(str(state)).select("numPartitions").distinct().collect() == [(utc.sparkContext.defaultParallelism,)]
    db = duckdb.connect()
    db.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = sorted(db.execute(S.SQL[name]).fetchall(), key=repr)
    assert len(want) > 100 and got == want


def test_buckets_and_stores_follow_events(utc):
    from lexiflow.streaming.gaze import BUCKET_EVENTS, LEAST_BUCKETS, buckets_for
    from lexiflow.streaming.replay import STORE_ROWS, state_partitions

    assert buckets_for(0) == LEAST_BUCKETS and buckets_for(10_000 * BUCKET_EVENTS + 1) == 10_001
    assert state_partitions(utc, 0) == utc.sparkContext.defaultParallelism and state_partitions(utc, 100 * STORE_ROWS) == 100


class Store:
    """A state of one bucket that counts what is asked of it."""

    def __init__(self):
        self.values, self.timers, self.calls = {}, set(), 0

    def named(self, name, _):
        return Named(self, name)

    getListState = getValueState = named

    def registerTimer(self, ms):
        self.calls += 1
        self.timers.add(ms)

    def deleteTimer(self, ms):
        self.calls += 1
        self.timers.remove(ms)


class Named:
    def __init__(self, store, name):
        self.store, self.name = store, name

    def get(self):
        self.store.calls += 1
        return self.store.values.get(self.name, () if self.name == "held" else None)

    def exists(self):
        self.store.calls += 1
        return self.name in self.store.values

    def put(self, value):
        self.store.calls += 1
        self.store.values[self.name] = value

    update = put

    def appendValue(self, value):
        self.store.calls += 1
        self.store.values.setdefault(self.name, []).append(value)

    def clear(self):
        self.store.calls += 1
        self.store.values.pop(self.name, None)


def test_few_calls_to_the_store():
    """Four for a bucket's first rows, two for more behind its timer, five for some before it, six for a timer that leaves some."""
    import pandas as pd
    from types import SimpleNamespace
    from lexiflow.streaming.gaze import Cooldown, InOrder

    frame = lambda *ms: pd.DataFrame({"ts": pd.to_datetime(list(ms), unit="ms"), "event_type": "hit", "element_id": "e", "user_id": "1"})
    machine, store = InOrder(Cooldown(1500), False), Store()
    machine.init(store)
    counts = []
    for call in (
        lambda: machine.handleInputRows((0,), iter([frame(3000, 9000)]), None),
        lambda: machine.handleInputRows((0,), iter([frame(4000)]), None),
        lambda: machine.handleInputRows((0,), iter([frame(2000)]), None),
        lambda: (store.timers.remove(2000), [tuple(r) for f in machine.handleExpiredTimer((0,), SimpleNamespace(getCurrentWatermarkInMs=lambda: 3200), None) for r in f.itertuples(index=False)])[1],
    ):
        store.calls = 0
        out = list(call())
        counts.append(store.calls)
    assert out == [("1", "e", 2000)] and store.timers == {3500} and counts == [4, 2, 5, 6]
