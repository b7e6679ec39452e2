"""JSON texts that hold one list each, read by several tasks.

A file is read in pieces that end with ``}``, so Spark splits it by byte ranges wherever its list holds objects. What a range
begins with (inside a string or not, how deep in brackets) follows from the ranges before it: each range says how it would
change either state, these few numbers are put together in the order of ranges, and then each range cuts its text at the
commas of the outer list. Elements that reach over ranges are put together from their parts.

A source that is no list, or has an element that does not parse, has no rows at all; it does not spoil the others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .tables import written

_QUOTE, _ESCAPE, _OPEN, _CLOSE, _COMMA, _LIST, _END = 34, 92, (91, 123), (93, 125), 44, 91, 93


def _scanned(text: bytes, inside: int):
    """For each byte whether it is inside a string, and by how much it changes the depth; a range begins without an escape."""
    import numpy as np

    b = np.frombuffer(text, np.uint8)
    at = np.arange(len(b))
    plain = np.maximum.accumulate(np.where(b != _ESCAPE, at, -1))
    before = np.concatenate([[-1], plain[:-1]]) if len(b) else plain
    quote = (b == _QUOTE) & ((at - 1 - before) % 2 == 0)
    strings = (quote.cumsum() + inside) & 1
    free = strings == 0
    move = np.where(free & np.isin(b, _OPEN), 1, 0) - np.where(free & np.isin(b, _CLOSE), 1, 0)
    return b, strings, move


def _ranges(batches):
    """((source, start), texts) of each range, texts as they come; a text begins with the ``}`` that ended the one before."""
    last, first = None, True
    for b in batches:
        names, starts, values = (c.to_pylist() for c in b.columns)
        lo = 0
        for i in range(1, len(names) + 1):
            if i == len(names) or (names[i], starts[i]) != (names[lo], starts[lo]):
                key = names[lo], starts[lo]
                first = key != last
                last = key
                yield key, first, ("" if first else "}").encode() + "}".join(values[lo:i]).encode()
                lo = i


def _effects(pieces: DataFrame) -> list:
    """(source, start, and for either state to begin with: the state at the end and the change of depth) of each range."""
    import pyarrow as pa

    def run(batches):
        held, key = None, None
        row = lambda: pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]], pa.int64()), *(pa.array([x], pa.int64()) for h in held for x in h)], names=names)
        for k, first, text in _ranges(batches):
            if first:
                if held:
                    yield row()
                key, held = k, [[0, 0], [1, 0]]
            for h in held:
                _, strings, move = _scanned(text, h[0])
                if len(strings):
                    h[0], h[1] = int(strings[-1]), h[1] + int(move.sum())
        if held:
            yield row()

    names = ["source", "start", "end0", "move0", "end1", "move1"]
    return sorted(map(tuple, pieces.mapInArrow(run, "source string, start bigint, end0 bigint, move0 bigint, end1 bigint, move1 bigint").collect()))


def _parts(pieces: DataFrame, begins: dict) -> DataFrame:
    """Parts of elements (kind 0), other text than white space outside of the list (1), and what each range did (2)."""
    import pyarrow as pa

    sent = pieces.sparkSession.sparkContext.broadcast(begins)

    def run(batches):
        import numpy as np

        key, out = None, []
        depth = inside = n = opened = 0
        held: list[bytes] = []
        head = False

        def close(tail: bool):
            text = b"".join(held).decode()
            held.clear()
            if depth_of:
                out.append((*key, 0, n, head, tail, text))
            elif text.strip(" \t\r\n"):
                out.append((*key, 1, n, head, tail, text))

        def end():
            nonlocal depth_of
            depth_of = depth
            close(False)
            out.append((*key, 2, n, inside == 0, False, str(opened)))
            out.append((*key, 3, depth, False, False, ""))

        depth_of = 0
        made = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.bool_(), pa.string()))], names=names)
        for k, first, text in _ranges(batches):
            if first:
                if key:
                    end()
                key, (inside, depth) = k, sent.value[k]
                n = opened = 0
                head = False
            b, strings, move = _scanned(text, inside)
            if not len(b):
                continue
            deep = depth + move.cumsum()
            cuts = np.flatnonzero((strings == 0) & (((b == _COMMA) & (deep == 1)) | ((move == 1) & (deep == 1)) | ((move == -1) & (deep == 0))))
            at = 0
            for c in cuts.tolist():
                depth_of = int(deep[c] - move[c])
                held.append(text[at:c])
                close(True)
                at = c + 1
                if b[c] == _COMMA:
                    n, head = n + 1, True
                elif move[c] == 1:
                    n, head, opened = n + 1, True, opened + 1
                    if b[c] != _LIST:
                        out.append((*key, 1, n, False, False, "{"))
                elif b[c] != _END:
                    out.append((*key, 1, n, False, False, "}"))
            held.append(text[at:])
            depth, inside = int(deep[-1]), int(strings[-1])
            if len(out) > 5000:
                yield made()
                out.clear()
        if key:
            end()
        if out:
            yield made()

    names = ["source", "start", "kind", "n", "head", "tail", "text"]
    return pieces.mapInArrow(run, "source string, start bigint, kind int, n bigint, head boolean, tail boolean, text string")


def list_elements(spark: SparkSession, path: str) -> DataFrame:
    """(source, pos, json): the elements of every file's list below ``path``, as texts, in their order."""
    pieces = spark.read.option("lineSep", "}").text(path).select(F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_block_start").alias("start"), "value")
    begins, last = {}, None
    for source, start, *ends in _effects(pieces):
        if source != last:
            inside, depth = 0, 0
        elif not inside:
            depth -= 1  # the brace that ended the range before
        last = source
        begins[source, start] = inside, depth
        inside, depth = ends[2 * inside], depth + ends[2 * inside + 1]
    parts = written(_parts(pieces, begins), "json-parts")
    # One row for each range: how many elements begin in it, and whether the source ends well.
    ranges, starts, bad, last = {}, [], set(), None
    for r in parts.filter("kind >= 2").select("source", "start", "kind", "n", "head", "text").collect():
        ranges.setdefault((r[0], r[1]), {})[r[2]] = r
    opened: dict[str, int] = {}
    ended: dict[str, tuple] = {}
    count: dict[str, int] = {}
    for (source, start), r in sorted(ranges.items()):
        starts.append((source, start, count.get(source, 0)))
        count[source] = count.get(source, 0) + r[2][3]
        opened[source] = opened.get(source, 0) + int(r[2][5])
        ended[source] = (r[2][4], r[3][3])
    bad = {s for s in ended if ended[s] != (True, 0) or opened[s] != 1}
    offsets = spark.createDataFrame(starts, "source string, start bigint, offset bigint")
    found = parts.filter("kind = 0").join(F.broadcast(offsets), ["source", "start"]).withColumn("pos", F.col("offset") + F.col("n") - 1)
    whole = found.filter("head AND tail").select("source", "pos", F.col("text").alias("json"))
    split = found.filter("NOT (head AND tail)").groupBy("source", "pos").agg(F.array_sort(F.collect_list(F.struct("start", "text"))).alias("t"))
    elements = whole.unionByName(split.select("source", "pos", F.array_join(F.transform("t", lambda x: x["text"]), "}").alias("json")))
    # A list with nothing in it has one blank element.
    empty = [s for s, n in count.items() if n == 1]
    blank = F.col("source").isin(empty) & (F.trim(F.translate("json", "\t\r\n", "   ")) == "") if empty else F.lit(False)
    elements = written(elements.filter(~blank).withColumn("ok", F.try_parse_json("json").isNotNull()), "json-elements")
    spoilt = elements.filter("NOT ok").select("source").union(parts.filter("kind = 1").select("source")).union(spark.createDataFrame([(s,) for s in bad], "source string")).distinct()
    return elements.join(spoilt, "source", "left_anti").select("source", F.col("pos").cast("long").alias("pos"), "json")


def write_lists(df: DataFrame, column: str, path: str, files: int) -> None:
    """Write the JSON texts of ``column`` as ``files`` files of one list each, in the order of rows' hashes."""
    import pyarrow as pa

    def run(batches):
        line = "["
        for b in batches:
            values = b.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([(line if not i else ",") + v for i, v in enumerate(values)], pa.string())], names=["value"])
            if values:
                line = ","
        yield pa.RecordBatch.from_arrays([pa.array(["[]" if line == "[" else "]"], pa.string())], names=["value"])

    df.select(column).repartition(files, column).sortWithinPartitions(column).mapInArrow(run, "value string").write.text(path)
