"""Shared helpers: table readers and scratch tables in the folder all executors see."""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by the cluster in spark.checkpoint.dir; a local one only for a local master without it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="lexiflow-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def stored(df: DataFrame, name: str, level: int = 3) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared scratch folder and read it back; ``level`` is that of compression.

    This cuts the lineage: a lost executor costs a re-read, not a recomputation. The files go when the
    driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", str(level)).parquet(path)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[id(out)] = (weakref.ref(out), path)
    return out


_paths: dict[int, tuple] = {}


def discard(df: DataFrame) -> None:
    """Delete the table of a ``stored`` DataFrame that nothing will read again."""
    found, path = _paths.pop(id(df), (lambda: None, None))
    if found() is df:
        jvm = df.sparkSession.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def where(df: DataFrame, verdict: str) -> DataFrame:
    """Rows whose boolean column ``verdict`` is true, tested after it has been computed once.

    A plain filter is moved below the projection that computes the verdict, which repeats its expressions, and inside
    lambdas repeats them for every element of an array. A filter on a row number stays where it is.
    """
    row = free_name(df, "row")
    return df.withColumn(row, F.monotonically_increasing_id()).filter(named(verdict) & (F.col(row) >= 0)).drop(row)


def named(column: str) -> Column:
    """The column of this name, whatever characters it has."""
    return F.col("`" + column.replace("`", "``") + "`")


def free_name(df: DataFrame, stem: str) -> str:
    """``stem``, longer where a column has that name; names that differ in case only are one name."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def carried(df: DataFrame, but: tuple[str, ...] = ()) -> tuple[Column, list[str]]:
    """The row but for the columns ``but`` as one struct named ``row``, and its fields' names.

    Helper columns can stand beside it under any name; ``uncarried`` gives the fields back.
    """
    drop = {c.lower() for c in but}
    names = [c for c in df.columns if c.lower() not in drop]
    return F.struct(*(named(c).alias(c) for c in names), *([] if names else [F.lit(None).alias("none")])).alias("row"), names


def uncarried(names: list[str]) -> list[Column]:
    return [F.col("row").getField(c).alias(c) for c in names]


#: Keys of a ``likely`` filter; beyond them nothing is broadcast. A word of 64 bits is kept for at most ``PER_WORD`` keys.
MOST_KEYS, PER_WORD, WORDS = 50_000_000, 4, 64


def likely(df: DataFrame, keys: DataFrame, name: str, without: bool = False, most: int = MOST_KEYS) -> DataFrame:
    """Rows of ``df`` whose 64-bit column ``name`` may be one of ``keys``, or the rest: a Bloom filter of 64-bit words.

    ``keys`` must be a stored table; its rows are counted first. The filter grows with them: each key sets four bits of one
    word, and a word has four keys at most on average, so about one row in a hundred passes that is not asked for. With
    ``most`` keys its words take 134 MB; with more, nothing is broadcast and every row passes. An exact join has to follow.
    """
    n = keys.count()
    if n > most:
        return df.filter(F.lit(not without))
    words = 1 << max(6, (max(n, 1) - 1).bit_length() - PER_WORD.bit_length() + 1)
    at, of = free_name(df, "chunk"), free_name(df, "words")
    h = F.xxhash64(named(name))
    word = F.shiftrightunsigned(h, 24).bitwiseAND(F.lit(words - 1))
    bits = F.lit(0).cast("long")
    for i in range(4):
        bits = bits.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63).cast("long")).cast("int")))
    chunk, place = F.shiftrightunsigned(word, 6).cast("int"), word.bitwiseAND(F.lit(WORDS - 1)).cast("int")
    held = keys.select(chunk.alias(at), place.alias("place"), bits.alias("bits")).groupBy(at, "place").agg(F.bit_or("bits").alias("bits"))
    held = held.groupBy(at).agg(F.map_from_entries(F.collect_list(F.struct("place", "bits"))).alias("m"))
    held = held.select(at, F.transform(F.sequence(F.lit(0), F.lit(WORDS - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0).cast("long"))).alias(of))
    found = df.withColumn(at, chunk).join(F.broadcast(held), at, "left")
    may = F.coalesce(F.get(of, place).bitwiseAND(bits) == bits, F.lit(False))
    return found.filter(~may if without else may).drop(at, of)


_memory: dict = {}


def remembered(name: str, make):
    """What an operator keeps between the tasks of a Python worker. A worker keeps one such thing, the last one asked for."""
    if name not in _memory:
        _memory.clear()
        _memory[name] = make()
    return _memory[name]


def byte_blocks(batches, max_bytes: int, column: str = "text"):
    """Slices of Arrow batches that hold about ``max_bytes`` of ``column`` each, and one row at least."""
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False)
        start = held = 0
        for i, n in enumerate(sizes):
            if held and held + n > max_bytes:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(n)
        yield batch.slice(start)
