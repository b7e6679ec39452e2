"""Queries that give all rows where a query of a like name gives the first or shortened ones."""

from pathlib import Path

import duckdb
from lexiflow.queries import queries

SF = Path("/root/testdata/sf0.001")


def count(sql):
    return duckdb.sql(sql).fetchall()[0][0]


def test_listing_and_zones_are_whole(spark):
    q = queries()
    rows = q["list_all"](spark, str(SF)).collect()
    assert len(rows) == count(f"SELECT count(*) FROM '{SF}/orders.parquet'") > 50
    assert rows[:50] == q["list_recent"](spark, str(SF)).collect()
    assert [r.o_orderdate for r in rows] == sorted((r.o_orderdate for r in rows), reverse=True)
    zones = q["all_zone_hits"](spark, str(SF)).collect()
    assert len(zones) == len({z.item_id for z in zones}) > 20
    assert sorted(zones, key=lambda z: (-z.hits, z.item_id))[:20] == q["word_zone_hits"](spark, str(SF)).collect()


def test_urls_are_whole(spark):
    rows = queries()["play_next_url"](spark, str(SF)).collect()
    assert len(rows) == count(f"SELECT count(*) FROM (SELECT DISTINCT user_id, props FROM '{SF}/events.parquet')")
    assert {r.url for r in rows} == {x for (x,) in duckdb.sql(f"SELECT DISTINCT props FROM '{SF}/events.parquet'").fetchall()}
