"""Streams run to their end over what is there now, so that their rows can be queried like a table's."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.tables import scratch

#: State store with several states for each key and timers.
PROVIDER, STORE = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Whether a stream runs a micro-batch for the watermark alone.
NO_DATA = "spark.sql.streaming.noDataMicroBatches.enabled"
#: Tasks of a micro-batch. Each loads and commits a state store, which takes most of a second however few rows it has.
PARTITIONS = "spark.sql.shuffle.partitions"
#: Rows of all micro-batches that one task's store sees.
STORE_ROWS = 1 << 20


def state_partitions(spark: SparkSession, rows: int) -> int:
    """As many state stores as cores, and more of them where one would see too many rows."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // STORE_ROWS))


def replayed(spark: SparkSession, path: str, make: Callable[[DataFrame], DataFrame], folders: int | None = None) -> DataFrame:
    """The rows that ``make``'s stream over the Parquet files at ``path`` writes, once it has seen all of them.

    ``folders``: ``path`` is a pattern of ``dealt`` with so many folders, which come one after the other; the files of a folder
    come together, in one micro-batch however many they are. Rows and state go to the shared scratch folder.
    """
    base = f"{scratch(spark)}/replay-{uuid.uuid4().hex}"
    # A stream takes folders or patterns; as a pattern the path may be a single file too.
    folder, _, name = path.rpartition("/")
    pattern = path if "*" in path else f"{folder}/[{name[0]}]{name[1:]}"
    patterns = [f"{folder}/file{{{','.join(map(str, range(i + 1)))}}}" for i in range(folders)] if folders else [pattern]
    there = spark.read.parquet(path)
    schema = there.schema
    before = {k: spark.conf.get(k, None) for k in (PROVIDER, NO_DATA, PARTITIONS)}
    try:
        spark.conf.set(PROVIDER, STORE)
        spark.conf.set(PARTITIONS, str(state_partitions(spark, there.count())))
        for i, pattern in enumerate(patterns):
            # Only after the last folder need the watermark be passed on without rows.
            spark.conf.set(NO_DATA, str(i == len(patterns) - 1).lower())
            stream = make(spark.readStream.schema(schema).parquet(pattern))
            stream.writeStream.format("parquet").option("path", f"{base}/rows").option("checkpointLocation", f"{base}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    return spark.read.schema(stream.schema).parquet(f"{base}/rows")


def dealt(df: DataFrame, ts: str, key: str, files: int, within_us: int, close: bool = True) -> str:
    """Write ``df`` to ``files`` folders of files that come one after the other, as a late and shuffled stream would.

    Rows go by their time plus up to ``within_us`` that their key's hash says, so a row comes less than ``within_us`` after
    later ones: inside a watermark of that delay. ``close``: a last file with one row of nulls, two delays later than all
    others, that lets the watermark pass them. Returns the pattern of their paths.
    """
    spark = df.sparkSession
    base = f"{scratch(spark)}/dealt-{uuid.uuid4().hex}"
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    lo, hi = df.agg(F.min(us), F.max(us)).first()
    if lo is None:
        for i in range(files + close):
            df.write.parquet(f"{base}/file{i}")
        return f"{base}/*"
    width = (hi + within_us - lo) // files + 1
    rows = df.withColumn("__file", F.floor((us + F.pmod(F.xxhash64(key), F.lit(within_us)) - lo) / width))
    for i in range(files):
        rows.filter(F.col("__file") == i).drop("__file").write.parquet(f"{base}/file{i}")
    if close:
        end = F.timestamp_micros(F.lit(hi + 2 * within_us)).cast(dict(df.dtypes)[ts])
        spark.range(1).select(*((end if c == ts else F.lit(None).cast(t)).alias(c) for c, t in df.dtypes)).write.parquet(f"{base}/file{files}")
    return f"{base}/*"
