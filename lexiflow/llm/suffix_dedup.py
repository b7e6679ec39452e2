"""Removal of repeated byte strings by merging Burrows-Wheeler transforms of shards.

A byte goes if a string of ``length`` bytes covers it that also starts anywhere else, in the same text or another.

1. Anchors. Each window of ``length`` bytes has one anchor, its leftmost ``GRAM``-byte string of least hash. Windows
   with one anchor lie side by side and form a context, about half a window plus ``length`` bytes long. Equal windows
   have equal anchors at equal places, so only contexts with one anchor string have to be compared. A scan emits a row
   of hashes per context, no text.
2. Classes. Contexts whose anchor occurs once are dropped, the others are counted by (anchor, content); of a class with
   two occurrences every window is repeated. Of the rest, only anchors with several classes go on, one context a class.
3. Merge. Contexts of such anchors are cut from their texts and dealt by anchor. A task splits them into shards, sorts
   the windows of each shard and keeps what a Burrows-Wheeler transform keeps: for each depth, the symbols that precede
   the suffixes in their order. A symbol is a block of a quarter of a window. The shards are merged by refining the
   interleave of their suffixes: at each depth the preceding symbols, read off the shards through the interleave so far,
   give the next one by a stable distribution, and the common prefixes of neighbours follow from those of the depth
   before. Suffixes are not compared again. Intervals of neighbours that share a whole window are repeated windows.
4. Hot anchors. An anchor with more than ``HOT`` classes would fill a task. Its windows are dealt anew, by blocks of
   ``WIDTHS`` distances to the anchor and by the bytes that all windows of such a block have in common: equal windows
   still meet. These parts go the way of contexts again, through steps 2 and 3, with smaller blocks where a part is still
   hot; at a width of one a part is a single window, so equal ones are one class and none can be hot.
5. Spans. Repeated windows are gathered per distinct text, and each text is cut once.

Edge cases: null and empty texts, and texts shorter than ``length``, lose nothing; repeated rows and exact copies of at
least ``length`` bytes lose all; ties between anchors go to the leftmost; an empty table gives an empty result; other
columns stay in ``remove_repeats``, whatever their names. A text of any length is scanned in segments.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import byte_blocks, carried, likely, named, stored, uncarried

LENGTH, GRAM, STEPS = 400, 32, 4
SHARD_WINDOWS, MERGE_BYTES, HOT = 1 << 16, 1 << 20, 2000
#: Distances to the anchor that parts of a hot anchor span, level by level.
WIDTHS = (64, 8, 1)
BLOCK_BYTES = 2 << 20
#: Bytes that are scanned at once; a scan takes about ninety bytes of memory for each of them.
SCAN_BYTES = 1 << 18
PLACE = 28
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def block_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """Hash of the ``width`` bytes from each place on, by doubling: pieces of 1, 2, 4, ... bytes are joined."""
    power, piece, size = MULTIPLIER, data.astype(np.uint64) + np.uint64(1), 1
    out, at = None, 0
    n = len(data) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        while size <= width:
            if width & size:
                own = piece[at : at + n]
                out = own if out is None else out * power + own
                at += size
            if size * 2 <= width:
                piece = piece[:-size] * power + piece[size:]
                power = power * power
            size *= 2
        return _mixed(out)


def contexts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int, gram: int) -> tuple:
    """(text, first window, last window, anchor, anchor's hash) of each context of texts that lie in one buffer."""
    counts = np.maximum(ends - starts - length + 1, 0)
    total = int(counts.sum())
    if not total:
        e = np.zeros(0, np.int64)
        return e, e, e, e, np.zeros(0, np.uint64)
    h = block_hashes(data, gram)
    wide = length - gram + 1
    key = (h >> np.uint64(PLACE) << np.uint64(PLACE)) | np.arange(len(h), dtype=np.uint64)
    padded = np.full(-(-len(key) // wide) * wide, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(key)] = key
    rows = padded.reshape(-1, wide)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    owner = np.repeat(np.arange(len(starts)), counts)
    window = np.arange(total) + np.repeat(starts - (np.cumsum(counts) - counts), counts)
    least = np.minimum(behind[window], ahead[window + wide - 1]) & np.uint64((1 << PLACE) - 1)
    first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    last = np.append(first[1:], total) - 1
    anchor = least[first].astype(np.int64)
    return owner[first], window[first], window[last], anchor, h[anchor]


def _buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string column without nulls."""
    import pyarrow as pa

    c = column.cast(pa.large_binary())
    offsets = np.frombuffer(c.buffers()[1], np.int64)[c.offset : c.offset + len(c) + 1]
    data = np.frombuffer(c.buffers()[2], np.uint8) if c.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def segments(starts: np.ndarray, ends: np.ndarray, length: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, start, end) of pieces of at most ``most`` windows; neighbours overlap, so each window is in one piece."""
    pieces = np.maximum(-(-(ends - starts - length + 1) // most), 1)
    owner = np.repeat(np.arange(len(starts)), pieces)
    start = starts[owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * most
    return owner, start, np.minimum(start + most + length - 1, ends[owner])


CONTEXT = "anchor bigint, content bigint, row bigint, mark bigint, lo int, n int, place int, copies bigint"


def context_rows(texts: DataFrame, length: int, gram: int, most: int = SCAN_BYTES) -> DataFrame:
    """A row per context of each distinct text of a block; ``copies`` is how often the block holds the text.

    ``texts``: (row, mark, text): hashes of the row's key and of its text, and the text. ``place`` is the anchor's. Texts of more
    than ``most`` windows are scanned in segments.
    """
    import pyarrow as pa
    import xxhash

    def run(batches):
        for b in byte_blocks(batches, BLOCK_BYTES):
            marks = b.column(1).to_numpy()
            _, pick, copies = np.unique(marks, return_index=True, return_counts=True)
            b = b.take(pa.array(pick))
            whole, offsets = _buffer(b.column(2))
            text_of, starts, ends = segments(offsets[:-1], offsets[1:], length, most)
            # Segments that end in one stretch of the block are a group, which is scanned at once.
            edges = [0, *(np.flatnonzero(np.diff(ends // most)) + 1).tolist(), len(starts)]
            for g in map(slice, edges[:-1], edges[1:]):
                base = int(starts[g][0]) if len(starts) else 0
                data = whole[base : int(ends[g][-1])] if len(starts) else whole
                piece, lo, hi, anchor, ah = contexts(data, starts[g] - base, ends[g] - base, length, gram)
                raw = memoryview(data.tobytes())
                ch = np.array([xxhash.xxh3_64_intdigest(raw[x : y + length], seed=a - x) for x, y, a in zip(lo.tolist(), hi.tolist(), anchor.tolist())], np.uint64)
                owner = text_of[g][piece]
                shift = base - offsets[owner]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ah.view(np.int64)), pa.array(ch.view(np.int64)), b.column(0).take(pa.array(owner)), b.column(1).take(pa.array(owner)), pa.array((lo + shift).astype(np.int32)), pa.array((hi - lo + 1).astype(np.int32)), pa.array((anchor + shift).astype(np.int32)), pa.array(copies[owner].astype(np.int64))],
                    names=["anchor", "content", "row", "mark", "lo", "n", "place", "copies"],
                )

    return texts.mapInArrow(run, CONTEXT)


def part_rows(texts: DataFrame, length: int, width: int) -> DataFrame:
    """Parts of the contexts listed with each text: windows whose distances to the anchor lie in one block of ``width``.

    A part's ``anchor`` is a hash of the old one, the block, and the bytes that every window of such a block has.
    """
    import pyarrow as pa
    import xxhash

    def run(batches):
        for b in byte_blocks(batches, BLOCK_BYTES):
            out = [[] for _ in range(8)]
            for row, mark, text, asked in zip(*(b.column(i).to_pylist() for i in range(4))):
                raw = memoryview(text.encode())
                for x in asked:
                    place, low, high = x["place"], x["place"] - x["lo"] - x["n"] + 1, x["place"] - x["lo"]
                    for block in range(low // width, high // width + 1):
                        near, far = max(low, block * width), min(high, block * width + width - 1)
                        start = place - block * width
                        core = raw[start : max(start, start - width + 1 + length)]
                        anchor = xxhash.xxh3_64_intdigest(core, seed=(x["anchor"] ^ block * 0x9E3779B97F4A7C15) & (1 << 64) - 1)
                        content = xxhash.xxh3_64_intdigest(raw[place - far : place - near + length], seed=far)
                        for column, value in zip(out, (anchor, content, row, mark, place - far, far - near + 1, place, x["copies"])):
                            column.append(value)
            yield pa.RecordBatch.from_arrays([*(pa.array(np.array(c, np.uint64).view(np.int64)) for c in out[:2]), *(pa.array(c, t) for c, t in zip(out[2:], (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64())))], names=["anchor", "content", "row", "mark", "lo", "n", "place", "copies"])

    return texts.mapInArrow(run, CONTEXT)


class ShardTransform:
    """The windows of a shard in order, and for each depth the symbols that precede its suffixes in theirs."""

    def __init__(self, symbols: list[np.ndarray]):
        """``symbols``: for each window, its blocks from last to first."""
        order = np.arange(len(symbols[0]))
        self.preceding = []
        for s in symbols:
            c = s[order]
            self.preceding.append(c)
            order = order[np.argsort(c, kind="stable")]
        self.order = order


def merge(shards: list[ShardTransform]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merge shards by refining their interleave.

    Returns for each rank the shard and the window there, and the symbols it has in common with the rank before.
    """
    sizes = [len(s.order) for s in shards]
    z = np.repeat(np.arange(len(shards), dtype=np.uint16 if len(shards) < 1 << 16 else np.int64), sizes)
    n = len(z)
    prefix = np.zeros(n, np.int32)  # of the suffixes so far; at first all are empty
    for depth in range(len(shards[0].preceding)):
        c = np.empty(n, np.int32)
        c[np.argsort(z, kind="stable")] = np.concatenate([s.preceding[depth] for s in shards])
        move = np.argsort(c, kind="stable")
        # Neighbours with one preceding symbol share it and what all between their old ranks share.
        least = _least_between(prefix, move, depth)
        same = np.zeros(n, bool)
        same[1:] = c[move][1:] == c[move][:-1]
        z, prefix = z[move], np.where(same, least + 1, 0).astype(np.int32)
    where = np.empty(n, np.int64)
    where[np.argsort(z, kind="stable")] = np.concatenate([s.order for s in shards]) if n else where
    return z, where, prefix


def _least_between(prefix: np.ndarray, move: np.ndarray, most: int) -> np.ndarray:
    """At i the least of ``prefix`` behind old rank ``move[i - 1]`` up to ``move[i]``; of no use where ranks fall.

    Values are 0 to ``most``: the least is the number of levels that no value between stays below.
    """
    out = np.zeros(len(move), np.int32)
    for level in range(1, most + 1):
        below = np.cumsum(prefix < level)
        out[1:] += below[move[1:]] == below[move[:-1]]
    return out


def repeated_windows(data: np.ndarray, at: np.ndarray, length: int, shard: int = SHARD_WINDOWS, steps: int = STEPS) -> np.ndarray:
    """Which of the windows that begin at ``at`` in ``data`` are equal to another one of them."""
    out = np.zeros(len(at), bool)
    if not len(at):
        return out
    width = -(-length // steps)
    hashes = block_hashes(data, width)
    blocks = [hashes[at + o] for o in sorted({min(i * width, length - width) for i in range(steps)}, reverse=True)]
    ranks = [np.unique(b, return_inverse=True)[1].astype(np.int32) for b in blocks]
    cuts = range(0, len(at), shard)
    shards = [ShardTransform([r[i : i + shard] for r in ranks]) for i in cuts]
    z, where, prefix = merge(shards)
    whole = prefix == len(blocks)
    twice = whole | np.append(whole[1:], False)
    out[where[twice] + z[twice].astype(np.int64) * shard] = True
    return out


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end (exclusive) of the runs of True."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return edges[::2], edges[1::2]


def merged_contexts(rows: DataFrame, length: int) -> DataFrame:
    """Repeated windows (mark, lo, hi) of the rows that are ``single``, by the merge; rows of an anchor come together."""
    import pyarrow as pa

    def flush(held):
        t = pa.Table.from_batches(held).combine_chunks()
        data, offsets = _buffer(t.column("bytes").combine_chunks())
        n = t.column("n").to_numpy()
        first = np.cumsum(n) - n
        at = np.arange(int(n.sum())) + np.repeat(offsets[:-1] - first, n)
        flags = repeated_windows(data, at, length)
        single = np.repeat(t.column("single").to_numpy(), n)
        owner = np.repeat(np.arange(len(n)), n)
        flags &= single
        # Runs end where a context ends.
        spaced = np.zeros(len(flags) + len(n), bool)
        spaced[np.arange(len(flags)) + owner] = flags
        begin, end = _runs(spaced)
        who = owner[begin - np.searchsorted(first + n + np.arange(len(n)), begin, "right")] if len(begin) else begin
        lo = t.column("lo").to_numpy()[who] + begin - (first + np.arange(len(n)))[who]
        return pa.RecordBatch.from_arrays([pa.array(t.column("mark").to_numpy()[who]), pa.array(lo.astype(np.int32)), pa.array((lo + end - begin - 1).astype(np.int32))], names=["mark", "lo", "hi"])

    def run(batches):
        held, size, last = [], 0, None
        for b in batches:
            anchors = b.column(0).to_numpy()
            for i, j in zip(*(lambda c: (c[:-1], c[1:]))(np.concatenate([[0], np.flatnonzero(np.diff(anchors)) + 1, [len(anchors)]]).tolist())):
                part = b.slice(i, j - i)
                if held and size > MERGE_BYTES and anchors[i] != last:
                    yield flush(held)
                    held, size = [], 0
                held.append(part)
                size += 600 * (j - i)
                last = anchors[i]
        if held:
            yield flush(held)

    return rows.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(run, "mark bigint, lo int, hi int")


def _cut_contexts(texts: DataFrame, length: int) -> DataFrame:
    """(anchor, mark, lo, n, single, bytes) of the contexts listed with each text."""
    import pyarrow as pa

    def run(batches):
        for b in byte_blocks(batches, BLOCK_BYTES):
            out = [[] for _ in range(6)]
            for mark, text, asked in zip(*(b.column(i).to_pylist() for i in range(3))):
                raw = text.encode()
                for x in asked:
                    for column, value in zip(out, (x["anchor"], mark, x["lo"], x["n"], x["single"], raw[x["lo"] : x["lo"] + x["n"] + length - 1])):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary()))], names=["anchor", "mark", "lo", "n", "single", "bytes"])

    return texts.mapInArrow(run, "anchor bigint, mark bigint, lo int, n int, single boolean, bytes binary")


def _asked(contexts: DataFrame, long: DataFrame, *fields: str) -> DataFrame:
    """The texts of ``long`` that own some of the contexts, with these as ``asked``; other texts aren't shuffled."""
    asked = stored(contexts.groupBy("row", "mark").agg(F.collect_list(F.struct(*fields)).alias("asked")).withColumn("name", F.xxhash64("row", "mark")), "asked")
    return likely(long.withColumn("name", F.xxhash64("row", "mark")), asked, "name").drop("name").join(asked.drop("name"), ["row", "mark"])


def repeated_spans(docs: DataFrame, text: str = "text", key: str = "doc_id", length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """(mark, spans) of texts with repeated strings: spans of first and last window start; ``mark`` is xxhash64(text)."""
    gram = min(gram, length // 2)
    body = F.coalesce(named(text), F.lit(""))
    texts = docs.select(F.xxhash64(named(key)).alias("row"), F.xxhash64(body).alias("mark"), body.alias("text"))
    long = texts.filter(F.octet_length("text") >= length)
    rows = stored(context_rows(long, length, gram), "contexts")
    spans = None
    for width in (*WIDTHS, None):
        twice = rows.groupBy("anchor").agg(F.sum("copies").alias("c")).filter("c > 1").select("anchor")
        twice = stored(twice, "twice")
        # A few rows of other anchors may pass here: they are classes of their own, alone with their anchor, and drop out.
        near = likely(rows, twice, "anchor")
        classes = stored(near.groupBy("anchor", "content").agg(F.sum("copies").alias("copies"), F.min(F.struct("row", "mark", "lo", "n", "place")).alias("one")), "classes")
        several_copies = stored(classes.filter("copies > 1").select("anchor", "content", F.xxhash64("anchor", "content").alias("name")), "copies")
        some = likely(rows.withColumn("name", F.xxhash64("anchor", "content")), several_copies, "name")
        whole = some.join(several_copies.select("anchor", "content"), ["anchor", "content"], "left_semi").select("mark", "lo", (F.col("lo") + F.col("n") - 1).alias("hi"))
        # Written, so that the join below shares its shuffle with no aggregate and Spark can split a hot anchor.
        counts = stored(classes.groupBy("anchor").agg(F.count("*").alias("k")).filter("k > 1"), "counts")
        several = classes.join(counts, "anchor").select("anchor", "k", "copies", "one.*", (F.col("copies") == 1).alias("single"))
        few = F.col("k") <= hot if width else F.lit(True)
        merged = merged_contexts(_cut_contexts(_asked(several.filter(few), long, "anchor", "lo", "n", "single").select("mark", "text", "asked"), length), length)
        found = whole.unionByName(merged)
        spans = found if spans is None else spans.unionByName(found)
        many = several.filter(~few)
        if not width or counts.filter(F.col("k") > hot).isEmpty():
            break
        rows = stored(part_rows(_asked(many, long, "anchor", "lo", "n", "place", "copies").select("row", "mark", "text", "asked"), length, width), "parts")
    return spans.groupBy("mark").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))


def cut_spans(raw: bytes, spans, length: int) -> tuple[bytes, list[tuple[int, int]]]:
    """What is left of ``raw``, and the maximal removed runs."""
    runs: list[list[int]] = []
    for lo, hi in sorted((s["lo"], s["hi"]) for s in (() if spans is None else spans)):
        if runs and lo <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], hi + length)
        else:
            runs.append([lo, hi + length])
    kept, at = [], 0
    for lo, hi in runs:
        kept.append(raw[at:lo])
        at = hi
    kept.append(raw[at:])
    return b"".join(kept), [tuple(r) for r in runs]


def _with_spans(docs: DataFrame, text: str, key: str, length: int, gram: int, hot: int) -> tuple[DataFrame, list[str]]:
    """(row, text, spans): each row as a struct, its text, and the spans of that; only rows that may have some are shuffled."""
    spans = stored(repeated_spans(docs, text, key, length, gram, hot), "spans")
    row, names = carried(docs)
    rows = docs.select(row, named(text).alias("text"), F.xxhash64(F.coalesce(named(text), F.lit(""))).alias("mark"))
    with_spans = likely(rows, spans, "mark").join(spans, "mark", "left").select("row", "text", "spans")
    return with_spans.unionByName(likely(rows, spans, "mark", without=True).select("row", "text", F.lit(None).cast("array<struct<lo:int,hi:int>>").alias("spans"))), names


def repeat_digests(docs: DataFrame, text: str = "text", key: str = "doc_id", length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256, text) of each row; ``text`` is what is left of it."""
    import pyarrow as pa

    def run(batches):
        for b in byte_blocks(batches, BLOCK_BYTES):
            size, left, runs, sha, rest = [], [], [], [], []
            for t, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                raw = (t or "").encode()
                kept, gone = cut_spans(raw, spans, length)
                size.append(len(raw))
                left.append(len(raw) - len(kept))
                runs.append(len(gone))
                sha.append(hashlib.sha256(kept).hexdigest())
                rest.append(kept.decode(errors="ignore") if gone else t or "")
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in (size, left, runs)), pa.array(sha, pa.string()), pa.array(rest, pa.string())], names=["key", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text"])

    rows, _ = _with_spans(docs.select(named(key).alias("key"), named(text).alias("text")), "text", "key", length, gram, hot)
    out = rows.select("row.key", "text", "spans").mapInArrow(run, f"key {dict(docs.dtypes)[key]}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, text string")
    return out.withColumnRenamed("key", key)


def remove_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """The rows with repeated strings cut out of ``text``; a character that a cut splits goes."""
    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else cut_spans(t.encode(), s, length)[0].decode(errors="ignore") for t, s in zip(texts, spans)], dtype=object)

    rows, names = _with_spans(docs, text, key, length, gram, hot)
    # Texts without spans are not sent to Python.
    same = rows.filter("spans IS NULL").select(*uncarried(names))
    cut_rows = rows.filter("spans IS NOT NULL").select("row", cut("text", "spans").alias("text")).select(*(F.col("text").alias(c) if c == text else F.col("row").getField(c).alias(c) for c in names))
    return same.unionByName(cut_rows)


def op6_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return repeat_digests(table(spark, sf_dir, "documents").select("doc_id", "text"))
