"""The filter in front of exact joins."""

from lexiflow.llm.common import likely, stored
from pyspark.sql import functions as F


def test_filter_grows_with_its_keys(spark):
    keys = stored(spark.range(300_000).select(F.xxhash64(F.concat(F.lit("k"), "id")).alias("h")), "keys")
    others = spark.range(200_000).select(F.xxhash64(F.concat(F.lit("o"), "id")).alias("h"), F.lit(1).alias("chunk"), F.lit("x").alias("words"))
    assert likely(others, keys, "h").count() < 0.05 * 200_000
    assert likely(keys, keys, "h").count() == 300_000 and likely(keys, keys, "h", without=True).count() == 0
    assert likely(others, keys, "h").count() + likely(others, keys, "h", without=True).count() == 200_000
    assert likely(others, keys, "h").columns == ["h", "chunk", "words"]


def test_no_filter_beyond_its_bound(spark):
    keys = stored(spark.range(100).select(F.xxhash64("id").alias("h")), "keys")
    assert likely(keys, keys, "h", most=99).count() == 100 and likely(keys, keys, "h", without=True, most=99).count() == 0
    none = keys.limit(0)
    assert likely(keys, none, "h").count() == 0 and likely(keys, none, "h", without=True).count() == 100


def test_null_keys(spark):
    rows = spark.createDataFrame([(None,), (1,), (2,)], "h bigint")
    keys = stored(rows.filter("h = 1"), "keys")
    assert 1 in [r.h for r in likely(rows, keys, "h").collect()]
    assert likely(rows, keys, "h").count() + likely(rows, keys, "h", without=True).count() == 3
