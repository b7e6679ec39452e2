"""JSON lists cut into many ranges against the standard parser."""

import json
import random

import pytest
from lexiflow.sources.json_lists import list_elements, write_lists
from pyspark.sql import functions as F

GOOD = {
    "plain": [{"a": 1}, {"b": [1, {"c": "x}y"}]}], "empty": [], "scalars": [1, None, "a,b", [1, [2]], True, {}], "quotes": [{"q": 'say "}" \\', "w": "\\\\"}, {"e": "[{,}]\"\\\""}],
    "long": [{"t": "é🐷}" * 50, "i": i, "n": {"x": [{"y": i}]}} for i in range(20)],
}
BAD = {"cut": '[{"a": 1}, {"b": 2', "object": '{"a": [1]}', "after": '[{"a": 1}] x', "two": "[{}][{}]", "comma": '[{"a": 1},]', "hole": '[{"a": 1},,{}]', "string": '[{"a": "x}]', "crossed": '[{"a": [}]]', "nothing": "", "before": 'x[{"a": 1}]', "word": '[{"a": tru}, {}]'}


@pytest.mark.parametrize("size", ["300b", "1m"])
def test_ranges(spark, tmp_path, size):
    r = random.Random(1)
    for name, rows in GOOD.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(rows, ensure_ascii=False, indent=r.choice([None, 1])) + r.choice(["", "\n"]))
    for name, text in BAD.items():
        (tmp_path / f"{name}.json").write_text(text)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        got: dict = {}
        for x in list_elements(spark, str(tmp_path)).collect():
            got.setdefault(x.source.rpartition("/")[2][:-5], {})[x.pos] = json.loads(x.json)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == {k: dict(enumerate(v)) for k, v in GOOD.items() if v}


def test_write_and_read(spark, tmp_path):
    df = spark.range(500).select(F.to_json(F.struct("id", F.lit('a}"').alias("t"))).alias("j"))
    write_lists(df, "j", str(tmp_path / "x"), 3)
    assert {json.loads(r.json)["id"] for r in list_elements(spark, str(tmp_path / "x")).collect()} == set(range(500))
    write_lists(df.limit(0), "j", str(tmp_path / "y"), 1)
    assert list_elements(spark, str(tmp_path / "y")).count() == 0
