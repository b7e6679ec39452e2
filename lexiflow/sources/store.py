"""A table of rows by primary key with versions: a change reads and writes only the buckets that its keys are in.

Rows lie in ``buckets`` folders by the hash of their key. A change writes the touched buckets anew, under a name that nothing
knows yet, and then a marker that says for each bucket which folder holds it. The marker comes last and is one small file,
so a change that breaks off leaves the version before as it was, and readers of a version never see another's files. Two
writers of one version can't both succeed: the marker is created only if it is not there.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType


def files(spark: SparkSession, path: str):
    """The file system of ``path`` and a maker of its paths."""
    make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), make


def write_once(spark: SparkSession, path: str, text: str) -> None:
    """Create a small file; an error if it is there."""
    fs, make = files(spark, path)
    out = fs.create(make(path), False)
    out.write(bytearray(text.encode()))
    out.close()


def read_small(spark: SparkSession, path: str) -> str | None:
    """The text of a small file, None if it is not there."""
    fs, make = files(spark, path)
    if not fs.exists(make(path)):
        return None
    stream = fs.open(make(path))
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def last_of_key(changes: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """One row for each key: that of greatest ``order``; ties, and changes without an order, go by the row's hash."""
    rank = F.struct(*([F.col(order)] if order else []), F.xxhash64(*changes.columns), F.to_json(F.struct(*changes.columns)))
    return changes.groupBy(key).agg(F.max_by(F.struct(*changes.columns), rank).alias("r")).select("r.*")


class Store:
    """Versions of a table at ``path``, from 1 on; ``key`` names its primary key."""

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = 64):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets

    def _marker(self, version: int) -> str:
        return f"{self.path}/_versions/{version:012d}.json"

    def _numbers(self) -> list[int]:
        fs, make = files(self.spark, self.path)
        at = make(f"{self.path}/_versions")
        return sorted(int(f.getPath().getName()[:12]) for f in fs.listStatus(at)) if fs.exists(at) else []

    def _state(self, version: int | None = None) -> dict | None:
        """The marker of a version, by default the last one that was written to its end."""
        for n in [version] if version else reversed(self._numbers()):
            text = read_small(self.spark, self._marker(n))
            if text and text.endswith("\n"):
                return json.loads(text)
        return None

    def version(self) -> int:
        state = self._state()
        return state["version"] if state else 0

    def _bucket(self):
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.buckets)).cast("int")

    def _rows(self, state: dict, only: set[int] | None = None) -> DataFrame:
        schema = StructType.fromJson(state["schema"])
        paths = [f"{self.path}/{where}" for b, where in state["buckets"].items() if only is None or int(b) in only]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None) -> DataFrame:
        state = self._state(version)
        if state is None:
            raise ValueError(f"{self.path} has no version {version or ''}")
        return self._rows(state)

    def _commit(self, rows: DataFrame, touched: set[int], state: dict | None) -> int:
        """Write ``rows`` as the touched buckets of the next version."""
        name = f"data/{uuid.uuid4().hex}"
        rows.withColumn("__bucket", self._bucket()).repartition("__bucket").write.partitionBy("__bucket").parquet(f"{self.path}/{name}")
        fs, make = files(self.spark, self.path)
        found = {int(f.getPath().getName().partition("=")[2]): f"{name}/{f.getPath().getName()}" for f in fs.listStatus(make(f"{self.path}/{name}")) if f.isDirectory()}
        kept = {int(b): w for b, w in state["buckets"].items()} if state else {}
        buckets = {b: w for b, w in kept.items() if b not in touched} | found
        version = max([0, *self._numbers()]) + 1
        said = {"version": version, "before": state["version"] if state else 0, "schema": json.loads(rows.schema.json()), "buckets": {str(b): buckets[b] for b in sorted(buckets)}}
        self._before_marker()
        write_once(self.spark, self._marker(version), json.dumps(said) + "\n")
        return version

    def _before_marker(self) -> None:
        """Called when all files are written and nothing points at them yet."""

    def create(self, rows: DataFrame) -> int:
        """The first version; a key with two rows is an error."""
        if self._state() is not None:
            raise ValueError(f"{self.path} is there already")
        twice = rows.groupBy(self.key).count().filter("count > 1").head(1)
        if twice:
            raise ValueError(f"two rows of the key {twice[0][0]!r}")
        return self._commit(rows, set(range(self.buckets)), None)

    def _touched(self, keys: DataFrame) -> set[int]:
        return {r[0] for r in keys.select(self._bucket()).distinct().collect()}

    def upsert(self, changes: DataFrame, order: str | None = None) -> int:
        """Rows of ``changes`` replace those of their key or are added; of several for one key the last by ``order`` counts."""
        state = self._state()
        if state is None:
            return self.create(last_of_key(changes, self.key, order))
        old = self._rows(state, touched := self._touched(changes))
        changes = last_of_key(changes, self.key, order).select(*old.columns)
        return self._commit(old.join(changes.select(self.key), self.key, "left_anti").unionByName(changes), touched, state) if touched else state["version"]

    def delete(self, keys: DataFrame) -> int:
        """Without the rows of ``keys``."""
        state = self._state()
        if state is None:
            return 0
        old = self._rows(state, touched := self._touched(keys))
        return self._commit(old.join(keys.select(self.key), self.key, "left_anti"), touched, state) if touched else state["version"]

    def vacuum(self, keep: int = 1) -> int:
        """Remove the files that none of the last ``keep`` versions needs, with older markers; returns how many folders."""
        numbers = self._numbers()
        states = [s for s in map(self._state, numbers) if s][-keep:]
        used = {w for s in states for w in s["buckets"].values()}
        fs, make = files(self.spark, self.path)
        for n in numbers:
            if not states or n < states[0]["version"]:
                fs.delete(make(self._marker(n)), False)
        gone = 0
        for top in fs.listStatus(make(f"{self.path}/data")):
            for f in fs.listStatus(top.getPath()):
                if f.isDirectory() and f"data/{top.getPath().getName()}/{f.getPath().getName()}" not in used:
                    gone += bool(fs.delete(f.getPath(), True))
        return gone
