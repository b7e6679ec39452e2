"""Scans along a sorted key that no single task has to hold: places, neighbours and greedy cooldowns.

Rows are range-partitioned by (key, order), so a key with all rows is spread over as many tasks as its rows need. Each task
works on its block alone and says what its neighbours must know: a row at either edge, or a step function. From these,
one small row a block, what comes into each block is worked out, and rows of a key that goes on are put right.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..sources.tables import written

#: Rows of a block, about.
BLOCK_ROWS = 1_000_000


def _blocks(df: DataFrame, order: list[str], rows: int) -> DataFrame:
    """``df`` in blocks of about ``rows`` rows, sorted."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = max(least, -(-df.count() // rows))
    return df.repartitionByRange(n, *order).sortWithinPartitions(*order)


def _new_runs(table, by: list[str]):
    """True where a row's key is not the one of the row before; nulls are a key."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    n = table.num_rows
    new = np.zeros(n, bool)
    new[:1] = True
    for c in by:
        a = table.column(c).combine_chunks()
        if isinstance(a, pa.ChunkedArray):
            a = pa.concat_arrays(a.chunks) if a.num_chunks else pa.array([], a.type)
        same = pc.equal(a[1:], a[:-1]).to_numpy(zero_copy_only=False) if not a.null_count else np.array([x is True for x in pc.equal(a[1:], a[:-1]).to_pylist()])
        if a.null_count:
            null = pc.is_null(a).to_numpy(zero_copy_only=False)
            same |= null[1:] & null[:-1]
        new[1:] |= ~same.astype(bool)
    return new


def scanned(df: DataFrame, by: list[str], order: list[str], value: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows with ``place`` (from 1), ``first``, ``previous`` and ``following`` of ``value`` along each key of ``by``, in ``order``.

    ``order`` has to be total. ``previous`` and ``following`` are null at a key's ends. With no ``by`` all rows are one key.
    """
    import pyarrow as pa
    from pyspark.sql.types import LongType, StructField, StructType

    kind = df.schema[value].dataType
    out = StructType([*df.schema.fields, StructField("place", LongType()), *(StructField(c, kind) for c in ("first", "previous", "following")), *(StructField(c, LongType()) for c in ("__block", "__run", "__edge"))])

    def run(batches):
        import numpy as np
        from pyspark import TaskContext

        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        t = pa.Table.from_batches(batches)
        n = t.num_rows
        new = _new_runs(t, by)
        starts, runs = np.flatnonzero(new), new.cumsum() - 1
        at = np.arange(n)
        v = t.column(value)
        take = lambda i, none: v.take(pa.array(np.where(none, 0, i), mask=none))
        last = np.append(new[1:], True)
        edge = (at == 0) + 2 * (at == n - 1)
        block = TaskContext.get().partitionId()
        for name, c in (("place", pa.array(at - starts[runs] + 1)), ("first", v.take(pa.array(starts[runs]))), ("previous", take(at - 1, new)), ("following", take(at + 1, last)), ("__block", pa.array(np.full(n, block))), ("__run", pa.array(runs)), ("__edge", pa.array(edge.astype(np.int64)))):
            t = t.append_column(name, c)
        yield from t.to_batches(10_000)

    rows = written(_blocks(df, [*by, *order], block_rows).mapInArrow(run, out), "scan")
    # Two rows of each block at most: its first and its last.
    ends = sorted(rows.filter("__edge > 0").select("__block", "__edge", F.struct(*by).alias("key") if by else F.lit(0).alias("key"), "place", "__run", "first", F.col(value).alias("value")).collect(), key=lambda r: (r[0], r[1] & 1 == 0))
    sides: dict[int, list] = {}
    for r in ends:
        sides.setdefault(r[0], []).append(r)
    fix, before = {}, None
    for b, rs in sides.items():
        head, tail = rs[0], rs[-1]
        goes_on = before is not None and before["key"] == head["key"]
        carried, first = (before["n"], before["first"]) if goes_on else (0, head["value"])
        fix[b] = [b, carried, first, before["value"] if goes_on else None, None]
        if goes_on:
            fix[before["block"]][4] = head["value"]
        whole = tail["__run"] == 0
        before = {"block": b, "key": tail["key"], "n": tail["place"] + (carried if whole else 0), "first": first if whole else tail["first"], "value": tail["value"]}
    edges = df.sparkSession.createDataFrame([tuple(x) for x in fix.values()], StructType([StructField("__block", LongType()), StructField("__carried", LongType()), *(StructField(c, kind) for c in ("__first", "__before", "__after"))]))
    joined = rows.join(F.broadcast(edges), "__block", "left")
    head, tail = F.col("__edge").bitwiseAND(F.lit(1).cast("long")) > 0, F.col("__edge") >= 2
    put = {
        "place": F.col("place") + F.when(F.col("__run") == 0, F.col("__carried")).otherwise(0),
        "first": F.when(F.col("__run") == 0, F.col("__first")).otherwise(F.col("first")),
        "previous": F.when(head, F.col("__before")).otherwise(F.col("previous")),
        "following": F.when(tail, F.col("__after")).otherwise(F.col("following")),
    }
    return joined.select(*(F.col(c) for c in df.columns), *(x.alias(c) for c, x in put.items()))


def permuted(df: DataFrame, seed: str, *key: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """All rows with their ``place`` in a permutation that ``seed`` and the rows' unique ``key`` give."""
    text = F.concat_ws("|", F.lit(seed), *(F.col(k).cast("string") for k in key))
    rows = df.withColumn("__by", F.md5(text))
    return scanned(rows, [], ["__by", *key], key[0], block_rows).drop("__by", "first", "previous", "following")


def ordered_union(frames: list[tuple[DataFrame, list[Column]]], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """All rows of ``frames``, each in the order of its columns, one frame behind the other, with ``ord`` from 0 on.

    Frames have one list of order columns each, of the same types, total for their frame; nothing is dropped.
    """
    parts = [df.withColumns({"__frame": F.lit(i)} | {f"__o{j}": o for j, o in enumerate(order)}) for i, (df, order) in enumerate(frames)]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p, allowMissingColumns=True)
    width = max(len(order) for _, order in frames)
    order = ["__frame", *(f"__o{j}" for j in range(width))]
    out = scanned(rows, [], order, "__frame", block_rows)
    return out.withColumn("ord", F.col("place") - 1).drop(*order, "place", "first", "previous", "following")


def _orbit(following, starts):
    """Marks of all places that are reached from ``starts`` by going on to ``following``, whose last place is the end."""
    import numpy as np

    n = len(following)
    mark = np.zeros(n + 1, bool)
    mark[starts] = True
    jump = np.append(following, n)
    while True:
        mark[jump[np.flatnonzero(mark)]] = True
        if (jump == n).all():
            return mark[:n]
        jump = jump[jump]


def _following(runs, us, pause: int):
    """For each event the first of its run that is ``pause`` or more later, else the number of events."""
    import numpy as np

    times, rank = np.unique(us, return_inverse=True)
    width = len(times) + 1
    place = runs * width + rank
    to = place.searchsorted(runs * width + times.searchsorted(us + pause))
    last = runs.searchsorted(runs, "right")
    return np.where(to < last, to, len(us))


def cooldown(rows: DataFrame, by: str, key: str, pause_us: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(by, key, us) of the events that fire: of each actor the first, then each first one ``pause_us`` after the last that did.

    ``rows``: (by, key, us), unique. A block is a step function from the last firing before it to the last in it. The
    functions of an actor are composed in the order of its blocks, a few numbers each, and blocks replay side by side.
    Events without a time are left out.
    """
    import pyarrow as pa

    kinds = dict(rows.dtypes)
    fields = f"kind int, block bigint, place bigint, `{by}` {kinds[by]}, `{key}` {kinds[key]}, us bigint, until binary, ends binary"
    names = ["kind", "block", "place", by, key, "us", "until", "ends"]

    def scan(batches):
        import numpy as np
        from pyspark import TaskContext

        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        block = TaskContext.get().partitionId()
        t = pa.Table.from_batches(batches)
        n = t.num_rows
        new = _new_runs(t, [by])
        runs, us = new.cumsum() - 1, t.column("us").to_numpy()
        following = _following(runs, us, pause_us)
        starts = np.flatnonzero(new)
        fired = _orbit(following, starts)
        first = runs == 0  # may go on from the block before
        made = lambda kind, at: pa.Table.from_arrays([pa.array(np.full(len(at), kind, np.int32)), pa.array(np.full(len(at), block)), pa.array(at), t.column(by).take(pa.array(at)), t.column(key).take(pa.array(at)), pa.array(us[at]), pa.nulls(len(at), pa.binary()), pa.nulls(len(at), pa.binary())], names=names)
        for kind, at in ((0, np.flatnonzero(first)), (1, np.flatnonzero(fired & ~first))):
            yield from made(kind, at).to_batches(10_000)
        # The first run as a function, and the last firing of the last run if that is another one.
        m = int(first.sum())
        last = np.where(following[:m] < n, following[:m], np.arange(m))
        while (last[last] != last).any():
            last = last[last]
        step = np.flatnonzero(np.append(np.diff(last) != 0, True))
        edge = lambda kind, i, until, ends: pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([block]), pa.array([0 if kind == 2 else 1]), t.column(by).slice(i, 1).combine_chunks(), pa.nulls(1, t.schema.field(key).type), pa.array([None if kind == 2 else int(us[np.flatnonzero(fired)[-1]])], pa.int64()), pa.array([until], pa.binary()), pa.array([ends], pa.binary())], names=names)
        yield edge(2, 0, us[step].astype(np.int64).tobytes(), us[last[step]].astype(np.int64).tobytes())
        if len(starts) > 1:
            yield edge(3, n - 1, None, None)

    def compose(batches):
        """(block, last firing before it, null if there is none) of each block's first run."""
        import numpy as np

        actor, last = object(), None
        for b in batches:
            block, before = [], []
            for kind, at, who, us, until, ends in zip(*(b.column(c).to_pylist() for c in ("kind", "block", by, "us", "until", "ends"))):
                if who != actor:
                    actor, last = who, None
                if kind == 3:
                    last = us
                    continue
                block.append(at)
                before.append(last)
                until, ends = np.frombuffer(until, np.int64), np.frombuffer(ends, np.int64)
                i = 0 if last is None else int(until.searchsorted(last + pause_us))
                last = int(ends[i]) if i < len(ends) else last
            yield pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), pa.array(before, pa.int64())], names=["block", "before"])

    def replay(batches):
        import numpy as np

        def solve(held, before):
            t = pa.Table.from_batches(held)
            us = t.column("us").to_numpy()
            following = _following(np.zeros(len(us), np.int64), us, pause_us)
            start = 0 if before is None else int(us.searchsorted(before + pause_us))
            at = np.flatnonzero(_orbit(following, np.array([start]))) if start < len(us) else np.zeros(0, np.int64)
            return t.select([by, key, "us"]).take(pa.array(at)).to_batches(10_000)

        block, before, held = None, None, []
        for b in batches:
            of = b.column("block").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), b.num_rows]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                part = b.slice(lo, hi - lo)
                if of[lo] != block:
                    if held:
                        yield from solve(held, before)
                    # A block's first row says what came before it.
                    block, before, held = of[lo], part.column("us")[0].as_py(), []
                    part = part.slice(1)
                if part.num_rows:
                    held.append(part)
        if held:
            yield from solve(held, before)

    rows = rows.filter("us IS NOT NULL")
    done = written(_blocks(rows.select(by, key, "us"), [by, "us", key], block_rows).mapInArrow(scan, fields), "cooldown")
    edges = done.filter("kind >= 2").repartition(by).sortWithinPartitions(by, "block", "kind")
    before = edges.mapInArrow(compose, "block bigint, before bigint")
    heads = before.select("block", F.lit(-1).cast("long").alias("place"), F.lit(None).cast(kinds[by]).alias(by), F.lit(None).cast(kinds[key]).alias(key), F.col("before").alias("us"))
    waiting = done.filter("kind = 0").select("block", "place", by, key, "us").unionByName(heads)
    out = f"`{by}` {kinds[by]}, `{key}` {kinds[key]}, us bigint"
    return done.filter("kind = 1").select(by, key, "us").unionAll(waiting.repartition("block").sortWithinPartitions("block", "place").mapInArrow(replay, out))
