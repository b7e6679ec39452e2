"""Mixture-controlled packing: deficit round-robin over source queues.

Documents of one source form one queue, a stream of token ids; each document ends with ``END``. Every sequence takes
from every queue its share of ``SEQUENCE`` tokens. A queue's deficit is the part of its share that it has not got yet; it
grows by the share with each sequence, whole tokens are paid out of it, what is missing from a full sequence goes to the
queues of largest deficit, and the rest is carried to the next sequence. Only the last sequence can be short.

How it is spread: sequences form blocks of ``BLOCK``. What each queue has paid at the edge of a block has a closed form
(the tokens of all queues in order of their due times, ``(j + 0.5) / share``), and so has its deficit there. So a task
that needs block b starts the round-robin from the deficits carried into b, and no task waits for another. Texts are
encoded once; ids go to a table in the shared scratch folder, and pieces are cut where those ids are read. Nothing is
shuffled but counts: (queue, partition) totals give each document its place in its queue.

Shares default to the sources' parts of all tokens, so that all queues last to the end; with other shares a queue that
runs dry leaves the rest to the others. Sources beyond the ``QUEUES - 1`` with most documents share one queue, so what
the driver holds is bounded. Its share is the sum of theirs, and its tokens are ordered by the same round-robin: a tree
whose leaves are sources and whose nodes have about ``FAN`` children each. A node's totals and shares come with the row
by a join, and a token's place in a node's stream is its place in that of the node above.

Edge cases: a null or empty text is its end token alone; a null source is a queue of its own (shared with the empty
one); repeated rows are packed one by one; an empty table gives an empty result. Columns of the input that are not named
are not read, so clashing names do no harm.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_right
from functools import lru_cache
from itertools import chain, compress, filterfalse, repeat
from operator import is_

import numpy as np
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.window import Window

from .common import byte_blocks, remembered, stored
from .token_counts import tokenizer

SEQUENCE, END, BLOCK, QUEUES = 2048, 1, 512, 64
REMEMBERED, TOGETHER = 500_000, 16
#: Children of a node below the shared queue, and the round and block of its schedule.
FAN, NODE_ROUND, NODE_BLOCK = 32, 64, 16
BLOCK_BYTES = 4 << 20
BROADCAST_ROWS = 200_000
TAIL = b"*&$#%.,!|;:?"


# The settings of the tokenizers whose texts may be encoded piece by piece.
KNOWN = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "splits": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "end": "</w>",
}
#: First bytes in UTF-8 of U+0300 to U+037F, where all marks lie that have a composed form with an ASCII letter.
MARK_BYTES = (b"\xcc", b"\xcd")


def _cut(text: str) -> list[bytes]:
    """Pieces between ASCII white space, in lower case where that gives the same ids."""
    raw = text.encode()
    if MARK_BYTES[0] in raw or MARK_BYTES[1] in raw:
        return [p.lower() if p.isascii() else p for p in raw.split()]
    return raw.lower().split()


class PieceEncoder:
    """Ids of texts, from the ids of their pieces between ASCII white space.

    White space is a stable boundary of the tokenizer, and so is the edge between an ASCII letter or digit and the run of
    ``TAIL`` characters that ends a piece (no pre-split reaches over it). ASCII letters are lower-cased beforehand, but for
    pieces with other characters in a text that has combining marks: NFC comes before lower case, and a capital may have
    no composed form where its small letter has one. A text that might hold a special token goes to
    the library whole. New pieces of lower-case Latin letters are one word each, and a word's last token, and no other,
    has the end mark; so they are encoded ``TOGETHER``, without normalising, and cut behind these tokens.
    Beyond ``REMEMBERED`` pieces a new memory begins; what the one before it held is taken from there while it lasts.

    All this holds for a tokenizer with the settings in ``KNOWN``; with another one all texts go to the library whole.
    """

    def __init__(self, path: str):
        self.tk, self.pieces, self.older = tokenizer(path), {}, {}
        self.plain = frozenset(b"abcdefghijklmnopqrstuvwxyz0123456789")
        words = self.tk.get_vocab(True)
        self.ends = np.zeros(max(words.values(), default=0) + 1, bool)
        self.ends[[i for w, i in words.items() if w.endswith("</w>")]] = True
        own = json.loads(self.tk.to_str())
        added = [a["content"] for a in own["added_tokens"]]
        self.known = {"normalizer": own["normalizer"], "splits": own["pre_tokenizer"], "end": own["model"].get("end_of_word_suffix")} == KNOWN and all(a.startswith("<|") for a in added)
        self.words = self.tk
        if self.known:
            # For words that normalising and splitting leave as they are: the same model without these two.
            from tokenizers import Tokenizer

            plain = [{"type": "WhitespaceSplit"}, KNOWN["splits"]["pretokenizers"][1]]
            self.words = Tokenizer.from_str(json.dumps(own | {"normalizer": None, "pre_tokenizer": {"type": "Sequence", "pretokenizers": plain}, "added_tokens": []}))
        self.id_bytes = 2 if len(self.ends) <= 1 << 16 else 4

    def _learn(self, new: set[bytes]) -> None:
        known, older = self.pieces, self.older
        known.update((p, older[p]) for p in new.intersection(older))
        new = new.difference(older)
        words, cuts, letters, others = set(filter(bytes.isalpha, new)), [], [], []  # ASCII letters
        for p in filterfalse(bytes.isalpha, new):
            s = p.rstrip(TAIL)
            if s and s[-1] in self.plain and len(s) < len(p):
                cuts.append((p, s, p[len(s) :]))
                parts = cuts[-1][1:]
            else:
                parts = (p,)
            for x in parts:
                if x not in known:
                    if x in older:
                        known[x] = older[x]
                    else:
                        words.add(x)
        for s in filterfalse(bytes.isalpha, words):
            t = s.decode()
            (letters if t.isalpha() and max(t) <= "ſ" and t == t.lower() else others).append(s)
        letters += filter(bytes.isalpha, words)
        for s, e in zip(others, self.tk.encode_batch_fast([s.decode() for s in others], add_special_tokens=False)):
            known[s] = np.array(e.ids, "<u4").tobytes()
        if letters:
            rows = self.words.encode_batch_fast([b" ".join(letters[i : i + TOGETHER]).decode() for i in range(0, len(letters), TOGETHER)], add_special_tokens=False)
            ids = np.fromiter(chain.from_iterable(e.ids for e in rows), "<u4")
            raw, cut = ids.tobytes(), [0, *((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()]
            if len(cut) != len(letters) + 1:
                raise ValueError("the tokenizer does not end each word with one end mark")
            known.update(zip(letters, map(raw.__getitem__, map(slice, cut, cut[1:]))))
        known.update((p, known[a] + known[b]) for p, a, b in cuts)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        if not self.known:
            rows = self.tk.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)
            return [np.array(e.ids if t else [], "<u4").tobytes() for t, e in zip(texts, rows)]
        if len(self.pieces) > REMEMBERED:
            self.pieces, self.older = {}, self.pieces
        get, found, gaps = self.pieces.get, [], []
        for t in texts:  # a text's pieces are looked up while they are near, and only new ones are kept
            ps = _cut(t) if t and "<|" not in t else []
            ids = list(map(get, ps))
            found.append(ids)
            gaps.append([(i, ps[i]) for i in compress(range(len(ids)), map(is_, ids, repeat(None)))])
        self._learn({p for at in gaps for _, p in at})
        for ids, at in zip(found, gaps):
            for i, p in at:
                ids[i] = get(p)
        out = [b"".join(ids) for ids in found]
        for i, t in enumerate(texts):
            if t and "<|" in t:
                out[i] = np.array(self.tk.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
        return out


def piece_encoder(path: str) -> PieceEncoder:
    return remembered(f"pieces of {path}", lambda: PieceEncoder(path))


class Schedule:
    """Who gets which tokens of which sequence, from the queues' totals and shares alone."""

    def __init__(self, totals: list[int], shares: list[float] | None = None, sequence: int = SEQUENCE, block: int = BLOCK):
        self.totals = np.array(totals, np.int64)
        self.shares = np.array(shares if shares is not None else totals, np.float64)
        if (self.shares[self.totals > 0] <= 0).any():
            raise ValueError("every queue with tokens needs a share above 0")
        self.shares = np.where(self.totals > 0, self.shares, 1.0)
        self.total, self.sequence, self.size = int(self.totals.sum()), sequence, sequence * block
        self.blocks = -(-self.total // self.size)
        self.edge, self.block = lru_cache(4096)(self._edge), lru_cache(QUEUES)(self._block)  # a queue is in one block at a time
        self.columns = lru_cache(QUEUES)(self._columns)

    def _paid(self, time: float) -> np.ndarray:
        """Tokens of each queue that are due by ``time``; token j is due at (j + 0.5) / share."""
        n = np.clip(np.floor(time * self.shares - 0.5).astype(np.int64) + 1, 0, self.totals)
        n = np.where((n < self.totals) & ((n + 0.5) / self.shares <= time), n + 1, n)
        return np.where((n > 0) & ((n - 0.5) / self.shares > time), n - 1, n)

    def _edge(self, b: int) -> tuple[np.ndarray, float]:
        """What each queue has paid when block b begins, and the due time reached."""
        n = min(b * self.size, self.total)
        lo, hi = 0.0, float((self.totals / self.shares).max())
        if n >= self.total:
            return self.totals.copy(), hi
        for _ in range(200):
            mid = (lo + hi) / 2
            if mid in (lo, hi):
                break
            lo, hi = (mid, hi) if int(self._paid(mid).sum()) <= n else (lo, mid)
        paid = self._paid(lo)
        for _ in range(n - int(paid.sum())):  # ties at one due time: by queue
            q = int(np.argmin(np.where(paid < self.totals, (paid + 0.5) / self.shares, np.inf)))
            paid[q] += 1
        return paid, lo

    def _block(self, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Round-robin of block b: for each sequence and queue, tokens paid before it, and the place of its tokens there.

        Both arrays have a row per sequence; the first has one more, which is the state at the block's end.
        """
        start, time = self.edge(b)
        left = self.edge(b + 1)[0] - start
        deficit = np.where(left > 0, time * self.shares - start, 0.0)
        windows = -(-int(left.sum()) // self.sequence)
        paid = np.zeros((windows + 1, len(left)), np.int64)
        place = np.zeros((windows, len(left)), np.int64)
        paid[0] = start
        for w in range(windows):
            room = min(self.sequence, int(left.sum()))
            live = np.where(left > 0, self.shares, 0.0)
            deficit += room * live / live.sum()
            take = np.clip(np.floor(deficit), 0, left).astype(np.int64)
            over = int(take.sum()) - room
            if over > 0:  # more is owed than there is room: the round ends at the last queues
                take = np.diff(np.minimum(np.cumsum(take), room), prepend=0)
            while over < 0:  # rounding left room: one token more to the queues of largest deficit
                order = np.argsort(take - deficit, kind="stable")
                order = order[(left - take)[order] > 0]
                each = max(1, -over // len(order))
                for q in order.tolist():
                    more = min(each, int(left[q] - take[q]), -over)
                    take[q] += more
                    over += more
                    if not over:
                        break
            place[w] = np.cumsum(take) - take
            deficit -= take
            left = left - take
            paid[w + 1] = paid[w] + take
        return paid, place

    def _columns(self, b: int, queue: int) -> tuple[list[int], list[int]]:
        """A queue's part of both arrays of a block."""
        paid, place = self.block(b)
        return paid[:, queue].tolist(), place[:, queue].tolist()

    def find(self, queue: int, token: int) -> int:
        """The block that holds a queue's token."""
        lo, hi = 0, self.blocks - 1
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if token < int(self.edge(mid + 1)[0][queue]) else (mid + 1, hi)
        return lo

    def pieces(self, queue: int, start: int, n: int):
        """(sequence, offset there, tokens from ``start``, length) of each piece of a document in its queue."""
        at, stop = start, start + n
        b = self._near.get(queue, -1) if hasattr(self, "_near") else -1
        if b < 0 or not int(self.edge(b)[0][queue]) <= at < int(self.edge(b + 1)[0][queue]):
            b = self.find(queue, at)
        width = self.size // self.sequence
        while at < stop:
            column, places = self.columns(b, queue)
            w = bisect_right(column, at) - 1
            while at < stop and w < len(places):
                end = min(column[w + 1], stop)
                if end > at:
                    yield b * width + w, places[w] + at - column[w], at - start, end - at
                    at = end
                w += 1
            self.__dict__.setdefault("_near", {})[queue] = b
            if at < stop:
                b = self.find(queue, at)


def encoded(df: DataFrame, path: str, key: str, text: str, source: str, queues: int = QUEUES) -> DataFrame:
    """(key, queue, source, part, start, tokens, ids): each document's ids and its place among its source's in its partition.

    ``source`` is empty but for rows of the shared queue.
    """
    import pyarrow as pa
    from pyspark import TaskContext

    name = F.coalesce(F.col(f"`{source}`").cast("string"), F.lit(""))
    top = [r["q"] for r in df.groupBy(name.alias("q")).count().orderBy(F.desc("count"), "q").limit(queues - 1).collect()]
    queue = F.coalesce(*[F.when(name == q, F.lit(i)) for i, q in enumerate(top)], F.lit(queues - 1)) if top else F.lit(0)
    kind = dict(df.dtypes)[key]

    def run(batches):
        enc, part, sums = piece_encoder(path), TaskContext.get().partitionId(), {}
        for b in byte_blocks(batches, BLOCK_BYTES, "__text"):
            ids = [x + b"\x01\0\0\0" for x in enc.encode(b.column(3).to_pylist())]
            starts = []
            for q, x in zip(zip(b.column(1).to_pylist(), b.column(2).to_pylist()), ids):
                starts.append(sums.get(q, 0))
                sums[q] = starts[-1] + len(x) // 4
            small = [np.frombuffer(x, "<u4").astype("<u2").tobytes() for x in ids] if enc.id_bytes == 2 else ids
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array([part] * len(ids), pa.int32()), pa.array(starts, pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(small, pa.binary())], names=[key, "queue", "source", "part", "start", "tokens", "ids"])

    return df.select(F.col(f"`{key}`"), queue.alias("queue"), F.when(queue == queues - 1, name).otherwise("").alias("__source"), F.col(f"`{text}`").alias("__text")).mapInArrow(run, f"`{key}` {kind}, queue int, source string, part int, start bigint, tokens bigint, ids binary")


def shared_tree(rest: DataFrame) -> DataFrame:
    """(source, path) for (source, n, share): from leaf to top, the source's place in each node and the node's totals and shares."""
    depth, count = 0, rest.count()
    while count > FAN ** (depth + 1):
        depth += 1
    nodes = rest.select("source", F.xxhash64("source").alias("h"), F.col("source").alias("child"), "n", "share", F.array().cast("array<struct<at:int,totals:array<bigint>,shares:array<double>>>").alias("path"))
    up = nodes.select("source", "h", "path")
    for level in range(depth, -1, -1):
        node = F.pmod("h", F.lit(FAN**level))
        own = stored(nodes.groupBy(node.alias("node")).agg(F.sort_array(F.collect_list(F.struct("child", "n", "share"))).alias("c"), F.min("h").alias("h"), F.sum("n").alias("n"), F.sum("share").alias("share")), "nodes")
        places = own.select(F.posexplode("c").alias("at", "e"), F.struct(F.col("c.n").alias("totals"), F.col("c.share").alias("shares")).alias("s")).select(F.col("e.child").alias("child"), "at", "s")
        below = F.col("source") if level == depth else F.pmod("h", F.lit(FAN ** (level + 1)))
        up = up.withColumn("child", below).join(places, "child").select("source", "h", F.concat("path", F.array(F.struct("at", F.col("s.totals").alias("totals"), F.col("s.shares").alias("shares")))).alias("path"))
        nodes = own.select("h", F.col("node").alias("child"), "n", "share")
    return stored(up.select("source", "path"), "tree")


@lru_cache(16)
def node_schedule(totals: tuple[int, ...], shares: tuple[float, ...]) -> Schedule:
    return Schedule(list(totals), list(shares), NODE_ROUND, NODE_BLOCK)


def lifted(path: list[dict], start: int, n: int) -> list[tuple[int, int, int]]:
    """(place in the shared queue, tokens from ``start``, length) of each run of a document's tokens."""
    runs = [(start, 0, n)]
    for node in path:
        plan, out = node_schedule(tuple(node["totals"]), tuple(node["shares"])), []
        for begin, at, length in runs:
            for s, offset, more, m in plan.pieces(node["at"], begin, length):
                place = s * NODE_ROUND + offset
                if out and out[-1][0] + out[-1][2] == place:
                    out[-1] = (*out[-1][:2], out[-1][2] + m)
                else:
                    out.append((place, at + more, m))
        runs = out
    return runs


def pack(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", source: str = "source", shares: dict[str, float] | None = None, sequence: int = SEQUENCE, block: int = BLOCK, with_ids: bool = True, queues: int = QUEUES) -> DataFrame:
    """(key, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_length[, ids]) of each piece.

    ``shares``: a share for each source (default: its part of all tokens). Ids are little-endian 32-bit integers.
    """
    import pyarrow as pa

    if shares is not None:
        ranked = [r["q"] for r in df.groupBy(F.coalesce(F.col(f"`{source}`").cast("string"), F.lit("")).alias("q")).count().orderBy(F.desc("count"), "q").limit(queues - 1).collect()]
    docs = stored(encoded(df, path, key, text, source, queues), "ids")
    parts = stored(docs.groupBy("queue", "source", "part").agg(F.sum("tokens").alias("n")), "parts")
    totals = {r["queue"]: r["n"] for r in parts.groupBy("queue").agg(F.sum("n").alias("n")).collect()}  # QUEUES rows at most
    width = max(totals, default=0) + 1
    shared, rest = width == queues, None
    if shared:
        rest = parts.filter(F.col("queue") == queues - 1).groupBy("source").agg(F.sum("n").alias("n"))
        if shares is None:
            rest = rest.withColumn("share", F.col("n").cast("double"))
        else:
            named = df.sparkSession.createDataFrame([(k, float(v)) for k, v in shares.items()], "source string, share double")
            rest = rest.join(named, "source", "left").withColumn("share", F.coalesce("share", F.lit(0.0)))
        rest = stored(rest, "rest")
        sums = rest.agg(F.sum("share").alias("all"), F.min("share").alias("least")).first()
        if sums["least"] <= 0:
            raise ValueError("every source with tokens needs a share above 0")
    schedule = Schedule([totals.get(q, 0) for q in range(width)], None if shares is None else [shares.get(ranked[q], 0) if q < len(ranked) else sums["all"] if shared else 1.0 for q in range(width)], sequence, block)
    before = Window.partitionBy("queue", "source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = parts.select("queue", "source", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    small = parts.count() <= (BROADCAST_ROWS // 100 if shared else BROADCAST_ROWS)
    route = []
    if shared:
        tree = shared_tree(rest).withColumn("queue", F.lit(queues - 1))
        base, route = base.join(tree, ["queue", "source"], "left"), ["path"]
    placed = docs.join(F.broadcast(base) if small else base, ["queue", "source", "part"]).select(F.col(f"`{key}`"), "queue", (F.col("start") + F.col("base")).alias("start"), "tokens", "ids", *(F.col(c).alias("__path") for c in route))
    arguments = schedule.totals.tolist(), schedule.shares.tolist(), sequence, block
    full = schedule.total // sequence
    rest = schedule.total % sequence
    names = [key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_length"] + ["ids"] * with_ids
    types = [None, *[pa.int64()] * 7] + [pa.binary()] * with_ids

    def run(batches):
        plan = Schedule(*arguments)
        for whole in batches:
            for b in (whole.slice(i, 512) for i in range(0, whole.num_rows, 512)):
                owner, columns = [], [[] for _ in names[1:]]
                paths = b.column(5).to_pylist() if shared else [None] * b.num_rows
                for i, (q, start, n, ids, up) in enumerate(zip(*(b.column(c).to_pylist() for c in range(1, 5)), paths)):
                    ids = np.frombuffer(ids, "<u2").astype("<u4").tobytes() if len(ids) < 4 * n else ids
                    runs = lifted(up, start, n) if up else [(start, 0, n)]
                    for s, offset, at, length in ((s, o, first + x, m) for place, first, long in runs for s, o, x, m in plan.pieces(q, place, long)):
                        own = ids[4 * at : 4 * (at + length)]
                        owner.append(i)
                        for column, value in zip(columns, (at, length, zlib.crc32(own), n, s, offset, sequence if s < full else rest, own)):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(owner, pa.int32())), *(pa.array(c, t) for c, t in zip(columns, types[1:]))], names=names)

    kind = dict(df.dtypes)[key]
    return placed.mapInArrow(run, f"`{key}` {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, sequence_length bigint" + ", ids binary" * with_ids)


def padded_length(length, sequence: int = SEQUENCE):
    """Length after padding: a sequence is padded to ``sequence`` unless its length is a power of two."""
    return F.when(F.bit_count(length) == 1, length).otherwise(F.lit(sequence))


def op9_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    out = pack(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=False)
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", padded_length(F.col("sequence_length")).alias("padded_length"))
