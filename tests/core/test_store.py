"""The bucketed store, migrations that break off, and changes that give a key twice."""

import json

import pytest
from lexiflow.operators import matching as M
from lexiflow.sources import catalog as C, legacy as L
from lexiflow.sources.store import Store
from pyspark.sql import functions as F


@pytest.fixture
def store(spark, tmp_path):
    s = Store(spark, str(tmp_path / "store"), "k", 16)
    s.create(spark.range(400).selectExpr("id AS k", "id * 2 AS v"))
    return s


def rows(df):
    return {r.k: r.v for r in df.collect()}


def test_versions(spark, store):
    want = {k: 2 * k for k in range(400)}
    assert rows(store.read()) == want and store.version() == 1
    changes = spark.createDataFrame([(5, -1, 2), (5, -2, 3), (5, -3, 1), (900, 7, 1)], "k bigint, v bigint, turn int")
    with_turn = store.read().withColumn("turn", F.lit(0))
    assert {r.k: r.v for r in C.upsert(with_turn, changes, "k", "turn").collect()} == want | {5: -2, 900: 7}
    assert store.upsert(changes.select("k", "v").filter("v <> -1 AND v <> -3")) == 2
    assert rows(store.read()) == want | {5: -2, 900: 7} and rows(store.read(1)) == want
    assert store.delete(spark.range(10).selectExpr("id AS k")) == 3
    assert rows(store.read()) == {k: v for k, v in (want | {900: 7}).items() if k >= 10} and store.read().count() == 391
    assert store.upsert(changes.select("k", "v").limit(0)) == 3 and store.delete(spark.range(0).selectExpr("id AS k")) == 3


def test_only_touched_buckets(spark, store):
    before = store._state()["buckets"]
    changes = spark.createDataFrame([(1, 0), (2, 0)], "k bigint, v bigint")
    touched = store._touched(changes)
    store.upsert(changes)
    after = store._state()["buckets"]
    assert {int(b) for b in after if after[b] != before[b]} == touched and len(touched) <= 2 < len(before)
    read = store._rows(store._state(1), touched)
    assert read.count() < 400 and len(read.inputFiles()) <= 2
    assert store.vacuum() == len(touched) and store._numbers() == [2] and store.read().count() == 400


def test_break_off_before_the_marker(spark, store):
    store._before_marker = lambda: 1 / 0
    changes = spark.createDataFrame([(1, -1)], "k bigint, v bigint")
    with pytest.raises(ZeroDivisionError):
        store.upsert(changes)
    again = Store(spark, store.path, "k", 16)
    assert again.version() == 1 and rows(again.read())[1] == 2
    assert again.upsert(changes) == 2 and rows(again.read())[1] == -1
    # A marker that was not written to its end is no version.
    from lexiflow.sources.store import write_once

    write_once(spark, again._marker(3), '{"version": 3')
    assert again.version() == 2 and again.upsert(changes) == 4
    with pytest.raises(Exception, match="(?i)exist"):
        write_once(spark, again._marker(4), "x")


def test_one_row_a_key(spark, tmp_path):
    with pytest.raises(ValueError):
        Store(spark, str(tmp_path / "s"), "k").create(spark.createDataFrame([(1, 1), (1, 2)], "k int, v int"))
    base = spark.createDataFrame([(1, "a")], "k int, v string")
    assert [tuple(r) for r in C.upsert(base, spark.createDataFrame([(1, "b"), (1, "c")], "k int, v string"), "k", "v").collect()] == [(1, "c")]
    assert C.upsert(base, spark.createDataFrame([(1, "b"), (1, "c"), (1, "c")], "k int, v string"), "k").count() == 1


def write_sources(tmp_path):
    book = lambda title, image, **more: {"title": title, "pages": [{"text": "t", "image": image}], **more}
    for name, books in (("local", [book("A", None), book("Both", None), book("A", None)]), ("db", [book("Photos", "A"), book("Photos", "B"), book("Both", "", coverImage="c")])):
        (tmp_path / name).mkdir()
        (tmp_path / name / "x.json").write_text(json.dumps(books))
    return str(tmp_path / "local"), str(tmp_path / "db")


def titles(df):
    return sorted((r.title, r.coverThumb, r.pages[0].image) for r in df.collect())


BOOKS = [("A", None, None), ("Both", "c", None), ("Photos", None, "A"), ("Photos", None, "B")]


@pytest.mark.parametrize("step", [None, *L.STEPS])
def test_migration_goes_on(spark, tmp_path, step):
    local, db = write_sources(tmp_path)
    store = Store(spark, str(tmp_path / "books"), "id", 4)

    def crash(done):
        if done == step:
            raise KeyboardInterrupt

    if step:
        with pytest.raises(KeyboardInterrupt):
            L.migrate_into(store, local, db, crash)
    assert L.migrate_into(store, local, db) == 4
    assert titles(store.read()) == sorted(BOOKS, key=str)
    assert L.source_rows(L.read_sources(spark, local)).count() == 0 == L.source_rows(L.read_sources(spark, db)).count()
    assert L.migrate_into(store, local, db) == 0 and store.read().count() == 4


def test_a_source_that_changes_is_kept(spark, tmp_path):
    local, db = write_sources(tmp_path)
    store = Store(spark, str(tmp_path / "books"), "id", 4)

    def late(done):
        if done == "stored":
            (tmp_path / "db" / "y.json").write_text('[{"title": "Late", "pages": [{"text": "z"}]}]')

    L.migrate_into(store, local, db, late)
    assert L.source_rows(L.read_sources(spark, db)).count() == 4
    L.migrate_into(store, local, db)
    assert [t for t, *_ in titles(store.read())] == ["A", "Both", "Late", "Photos", "Photos"] and L.source_rows(L.read_sources(spark, db)).count() == 0


def test_plain_migration_goes_on(spark, tmp_path, monkeypatch):
    local, db = write_sources(tmp_path)
    path = str(tmp_path / "table")
    with monkeypatch.context() as m:
        m.setattr(L, "truncate", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            L.migrate(spark, local, db, path)
    assert L.migrate(spark, local, db, path) == 4
    assert titles(spark.read.parquet(path)) == sorted(BOOKS, key=str)
    assert L.migrate(spark, local, db, path) == 0


def test_slots_without_a_value(spark):
    old = spark.createDataFrame([(1, None), (2, "a"), (3, None), (4, "b"), (5, "b")], "s int, v string")
    new = spark.createDataFrame([(1, None), (2, None), (3, "a"), (5, "b"), (6, None)], "s int, v string")
    assert {r.s: r.action for r in M.slot_changes(old, new, "s", "v").collect()} == {1: "keep", 2: "replace", 3: "replace", 4: "dispose", 5: "keep", 6: "create"}


def test_rows_without_value_or_order(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, "x"), (4, "x")], "k int, v string")
    assert [tuple(r) for r in M.equal_pairs(df, "k", "v").collect()] == [(3, 4, "x")]
    assert {r.v: r.k for r in M.first_by(df.withColumn("o", F.lit(None).cast("int")), "v", "o").collect()}.keys() == {None, "x"}
    assert all(r.k for r in M.first_by(df.withColumn("o", F.lit(None).cast("int")), "v", "o").collect())
