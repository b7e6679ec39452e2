"""Alignment of two tokenizers: groups between common token ends, links inside groups, and how many texts hold each link.

Tokenizer A is byte-level BPE (a ``tokenizers`` file), B sentencepiece BPE with byte fallback. Both cover the bytes of
space + text. Byte offsets where a token of A and one of B end cut them into groups; every A and B token of one group
are linked. A pair's count is the number of texts that hold it.

1. Encode. A text is cut before each space that stands between two other characters. No token of A crosses such a place
   (its pattern starts a new match there) and none of B (its pieces have the space mark in front only, which is checked),
   so pieces are encoded and aligned one by one and remembered. A block of texts becomes one row of its distinct pairs,
   packed as ``a << 32 | b`` and sorted, with the number of the block's texts for each, and a row per text with the
   places of its pairs in that list.
2. Count. Tasks merge their blocks by ``np.unique``; the partial counts are range-partitioned by pair, sorted, and equal
   neighbours are summed. Each range is a shard of sorted pairs and counts. The highest count of each A id is at most one
   number for each id of the vocabulary, so it is gathered and sent to all tasks.
3. Look up. A block asks each shard for its pairs in that range, as one packed row. The task of a shard writes the shard to a
   file of its own, maps it into memory, answers by ``searchsorted`` as questions stream in, and removes it. The answers go
   back to the block's texts. Ranges are cut by numbers of partial counts, so a common pair makes no shard larger.

Edge cases: null and empty texts, and those whose tokens don't give space + text back, have zeros and an empty digest;
they hold no links. Repeated rows count as texts of their own; equal counts are all the highest. Empty tables give empty
results; columns that are not asked for are dropped, whatever their names.
"""

from __future__ import annotations

import hashlib
import os
import re
import tempfile
from itertools import chain

from pyspark.sql import DataFrame, functions as F

from .common import byte_blocks, remembered, stored

#: Bytes of text in a block; pieces and bytes of them beyond which the memory starts anew.
BLOCK_BYTES, REMEMBERED, HELD = 4 << 20, 400_000, 32 << 20
#: Links of a group beyond which it goes by its distinct ids.
WIDE = 1 << 16
#: Pairs that a task merges before it passes them on, and pairs in a row of a shard.
MERGED, CHUNK = 2_000_000, 1 << 16
INNER = re.compile(r"[^\s\u180e]{2}")
#: Pieces in a call of the libraries.
ROW = 64
WHITE = "".join(chr(i) for i in range(0x3001) if chr(i).isspace() and i != 32) + "\u180e"
CUT = re.compile(r"(?<=[^\s\u180e]) (?=[^\s\u180e])")


def byte_alphabet() -> dict[str, int]:
    """The bytes that the characters of byte-level tokens stand for: printable ones for themselves, others from 256 up."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def cut_pieces(text: str) -> list[str]:
    """The text without the spaces that stand between two other characters, cut there."""
    if text[0] == " " or text[-1] == " " or "  " in text or any(c in text and (c + " " in text or " " + c in text) for c in WHITE):
        return CUT.split(text)
    return text.split(" ")


class Aligner:
    """Pieces of texts to aligned tokens, remembered by piece."""

    def __init__(self, path_a: str, path_b: str, remembered: int = REMEMBERED):
        import numpy as np
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a, self.b = Tokenizer.from_file(path_a), SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        alphabet = byte_alphabet()
        vocab = self.a.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.bytes_a[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("a piece holds the space mark behind other characters: texts can't be cut before spaces")
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.size_a, self.size_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        # The text of an id and of what follows it: another of its side, the other side, the next group.
        size = max(len(self.bytes_a), len(self.bytes_b))
        self.width, self.names = size, [f"{i}{sign}" for sign in ",|;" for i in range(size)]
        self.remembered = remembered
        self._forget()

    def _forget(self):
        import numpy as np

        self.known: dict[str, int] = {}
        self.texts: list[str] = []  # groups, each with a semicolon behind it
        self.pairs: list[bytes] = []  # distinct pairs, packed
        self.times: list[bytes | None] = []  # how often each is linked; None: once each
        self.sums = np.zeros((1024, 4), np.int64)  # tokens of A, of B, groups, links
        self.bad: set[int] = set()  # pieces that the tokens don't give back
        self.held = 0

    def _together(self, new: list[str], raw: list[bytes]):
        """Ids of both sides and their numbers for each piece, encoded ``ROW`` pieces to a call; None if a piece is not given back."""
        import numpy as np

        rows = ["".join(new[i : i + ROW]) for i in range(0, len(new), ROW)]
        ids_a = list(chain.from_iterable(e.ids for e in self.a.encode_batch_fast(rows, add_special_tokens=False)))
        ids_b = list(chain.from_iterable(self.b.encode([r[1:] for r in rows], num_threads=1)))
        whole, ends = b"".join(raw), np.fromiter(map(len, raw), np.int64, len(raw)).cumsum()
        out = []
        for ids, tokens, size in ((ids_a, self.bytes_a, self.size_a), (ids_b, self.bytes_b, self.size_b)):
            if b"".join(map(tokens.__getitem__, ids)) != whole:
                return None
            ids = np.array(ids, np.int64)
            stops = size[ids].cumsum()
            to = stops.searchsorted(ends)
            if (stops[to] != ends).any():
                return None
            out.append((ids, np.diff(to + 1, prepend=0)))
        (a, n_a), (b, n_b) = out
        return a, b, n_a, n_b

    def _learn(self, new: list[str], together: bool):
        """Encode and align pieces, all of which start with a space; ``together``: those that may stand side by side in a text."""
        import numpy as np

        at, raw = len(self.texts), [p.encode() for p in new]
        self.held += sum(map(len, raw))
        while len(self.sums) < at + len(new):
            self.sums = np.concatenate([self.sums, np.zeros_like(self.sums)])
        texts, pairs, times = [""] * len(new), [b""] * len(new), [None] * len(new)
        good, found = list(range(len(new))), together and self._together(new, raw)
        if not found:
            ids_a = [e.ids for e in self.a.encode_batch_fast(new, add_special_tokens=False)]
            ids_b = self.b.encode([p[1:] for p in new], num_threads=1)
            good = [i for i, r in enumerate(raw) if b"".join(map(self.bytes_b.__getitem__, ids_b[i])) == r and b"".join(map(self.bytes_a.__getitem__, ids_a[i])) == r]
            self.bad.update(at + i for i in set(range(len(new))).difference(good))
        if good:
            if found:
                a, b, n_a, n_b = found
            else:
                n_a, n_b = (np.array([len(ids[i]) for i in good]) for ids in (ids_a, ids_b))
                a, b = (np.fromiter(chain.from_iterable(map(ids.__getitem__, good)), np.int64, int(n.sum())) for ids, n in ((ids_a, n_a), (ids_b, n_b)))
            end_a, end_b = self.size_a[a].cumsum(), self.size_b[b].cumsum()
            common = np.intersect1d(end_a, end_b)
            g_a, g_b = common.searchsorted(end_a), common.searchsorted(end_b)
            k_a, k_b = np.bincount(g_a, minlength=len(common)), np.bincount(g_b, minlength=len(common))
            last_a, last_b = k_a.cumsum(), k_b.cumsum()
            groups_to = g_a[n_a.cumsum() - 1] + 1
            groups = np.diff(groups_to, prepend=0)
            piece = np.repeat(np.arange(len(good)), groups)
            self.sums[at + np.array(good)] = np.stack([n_a, n_b, groups, np.add.reduceat(k_a * k_b, groups_to - groups)], 1)
            # A's ids of a group, then B's, each with the sign that follows.
            codes = np.empty(len(a) + len(b), np.int64)
            codes[np.arange(len(a)) + (last_b - k_b)[g_a]] = a
            codes[np.arange(len(b)) + last_a[g_b]] = b
            codes[last_a + last_b - k_b - 1] += self.width
            codes[last_a + last_b - 1] += 2 * self.width
            names = list(map(self.names.__getitem__, codes.tolist()))
            keys, n, of = self._pairs(a, b, last_a - k_a, last_b - k_b, k_a, k_b, piece)
            stop = of.searchsorted(np.arange(len(good)), "right")
            most = np.maximum.reduceat(n, np.concatenate([[0], stop[:-1]]))
            start = lo = 0
            for i, end, hi, m in zip(good, (n_a + n_b).cumsum().tolist(), stop.tolist(), most.tolist()):
                texts[i], pairs[i] = "".join(names[start:end]), keys[lo:hi].tobytes()
                if m > 1:
                    times[i] = n[lo:hi].tobytes()
                start, lo = end, hi
        self.texts += texts
        self.pairs += pairs
        self.times += times
        return range(at, at + len(new))

    @staticmethod
    def _pairs(a, b, first_a, first_b, k_a, k_b, piece):
        """Distinct pairs of each piece, how often each is linked, and the piece, in the order of piece and pair."""
        import numpy as np

        wide = k_a * k_b > WIDE
        k = np.where(wide, 0, k_a * k_b)
        g = np.repeat(np.arange(len(k)), k)
        i = np.arange(len(g)) - (k.cumsum() - k)[g]
        parts = [((a[first_a[g] + i // k_b[g]] << 32) | b[first_b[g] + i % k_b[g]], np.ones(len(g), np.int64), piece[g])]
        for w in np.flatnonzero(wide):
            x, n_x = np.unique(a[first_a[w] : first_a[w] + k_a[w]], return_counts=True)
            y, n_y = np.unique(b[first_b[w] : first_b[w] + k_b[w]], return_counts=True)
            parts.append((((x << 32)[:, None] | y).ravel(), (n_x[:, None] * n_y).ravel(), np.full(len(x) * len(y), piece[w])))
        keys, n, of = map(np.concatenate, zip(*parts))
        order = np.lexsort((keys, of))
        keys, n, of = keys[order], n[order], of[order]
        new = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (of[1:] != of[:-1])]))
        return keys[new], np.add.reduceat(n, new), of[new]

    def __call__(self, texts: list[str | None]) -> list[list[int]]:
        """The numbers of each text's pieces in ``texts``, ``pairs``, ``times`` and ``sums``; none where there are no tokens."""
        if len(self.texts) > self.remembered or self.held > HELD:
            self._forget()
        cut = [cut_pieces(t) if t else [] for t in texts]
        known = self.known
        new = set().union(*cut).difference(known)
        # Only a text's first and last piece may have white space at an end.
        edges = {p for ps in cut if ps for p in (ps[0], ps[-1]) if p in new and not (p and INNER.fullmatch(p[0] + p[-1]))}
        for pieces, together in ((list(new - edges), True), (list(edges), False)):
            for k in range(0, len(pieces), 1 << 14):
                known.update(zip(pieces[k : k + (1 << 14)], self._learn([" " + p for p in pieces[k : k + (1 << 14)]], together)))
        out = [list(map(known.__getitem__, ps)) for ps in cut]
        return [[] if not self.bad.isdisjoint(x) else x for x in out] if self.bad else out

    def links(self, pieces: list[int]):
        """A text's distinct pairs in order and how often each is linked."""
        import numpy as np

        distinct, n = np.unique(np.array(pieces), return_counts=True)
        distinct = distinct.tolist()
        parts = list(map(self.pairs.__getitem__, distinct))
        keys = np.frombuffer(b"".join(parts), np.int64)
        size = np.array(list(map(len, parts))) >> 3
        n = np.repeat(n, size)
        for at, t in zip((size.cumsum() - size).tolist(), map(self.times.__getitem__, distinct)):
            if t:
                t = np.frombuffer(t, np.int64)
                n[at : at + len(t)] *= t
        order = keys.argsort(kind="stable")
        keys, n = keys[order], n[order]
        new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        return keys[new], np.add.reduceat(n, new)


def aligner(path_a: str, path_b: str) -> Aligner:
    return remembered(f"alignment of {path_a} {path_b}", lambda: Aligner(path_a, path_b))


_SUMS = ("n_a", "n_b", "n_groups", "n_links")


def _aligned(df: DataFrame, path_a: str, path_b: str, key: str, text: str) -> DataFrame:
    """Rows of blocks (kind 0: pairs, and texts that hold each) and of texts (kind 1: places in the block's pairs, and links)."""
    import pyarrow as pa

    def run(batches):
        import numpy as np
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        align = aligner(path_a, path_b)
        for b in byte_blocks(batches, BLOCK_BYTES, "__text"):
            found = align(b.column(1).to_pylist())
            linked = [align.links(x) if x else (np.empty(0, np.int64), np.empty(0, np.int64)) for x in found]
            pairs, where, n = np.unique(np.concatenate([k for k, _ in linked]), return_inverse=True, return_counts=True)
            if len(pairs):
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([0], pa.int32()), pa.nulls(1, b.column(0).type), *(pa.nulls(1, pa.int64()) for _ in _SUMS), pa.nulls(1, pa.string()), pa.array([pairs.tobytes()]), pa.array([n.astype(np.int32).tobytes()])], names=names)
            sums = np.array([align.sums[x].sum(0) if x else np.zeros(4, np.int64) for x in found])
            digests = [hashlib.sha256("".join(map(align.texts.__getitem__, x))[:-1].encode()).hexdigest() if x else "" for x in found]
            at, places, times = 0, [], []
            for keys, t in linked:
                w = where[at : at + len(keys)]
                at += len(keys)
                places.append(np.diff(w, prepend=0).astype(np.int32).tobytes())
                times.append(t.astype(np.int32 if not len(t) or t.max() < 1 << 31 else np.int64).tobytes())
            columns = [pa.array(np.full(len(found), block)), pa.array(np.ones(len(found), np.int32)), b.column(0), *(pa.array(c) for c in sums.T), pa.array(digests, pa.string()), pa.array(places, pa.binary()), pa.array(times, pa.binary())]
            rows = pa.RecordBatch.from_arrays(columns, names=names)
            for k in range(0, len(found), 512):
                yield rows.slice(k, 512)
            block += 1

    names = ["block", "kind", "key", *_SUMS, "groups_sha256", "places", "times"]
    kinds = f"block bigint, kind int, key {dict(df.dtypes)[key]}, {', '.join(f'{c} bigint' for c in _SUMS)}, groups_sha256 string, places binary, times binary"
    return df.selectExpr(f"`{key}` AS key", f"`{text}` AS __text").mapInArrow(run, kinds)


def pair_counts(blocks: DataFrame, shards: int) -> DataFrame:
    """(shard, part, pairs, counts) from blocks of (places, times): shards of sorted pairs, packed; each pair stands in one."""
    import pyarrow as pa

    def merged(batches):
        import numpy as np

        held, size = [], 0

        def out():
            keys, n = (np.concatenate(x) for x in zip(*held))
            keys, where = np.unique(keys, return_inverse=True)
            return keys, np.bincount(where, n).astype(np.int64)

        for b in batches:
            for p, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                held.append((np.frombuffer(p, np.int64), np.frombuffer(t, np.int32)))
                size += len(held[-1][0])
                if size > MERGED:
                    held = [out()]
                    size = len(held[0][0])
                    if size > MERGED // 2:
                        yield from rows(*held.pop())
                        size = 0
        if held:
            yield from rows(*out())

    def rows(keys, n):
        for k in range(0, len(keys), CHUNK):
            yield pa.RecordBatch.from_arrays([pa.array(keys[k : k + CHUNK]), pa.array(n[k : k + CHUNK])], names=["pair", "n"])

    def summed(batches):
        import numpy as np
        from pyspark import TaskContext

        shard, part = TaskContext.get().partitionId(), 0
        keys, n = np.empty(0, np.int64), np.empty(0, np.int64)

        def row(size):
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([part], pa.int32()), pa.array([keys[:size].tobytes()]), pa.array([n[:size].tobytes()])], names=["shard", "part", "pairs", "counts"])

        for b in batches:
            if b.num_rows:
                keys, n = np.concatenate([keys, b.column(0).to_numpy()]), np.concatenate([n, b.column(1).to_numpy()])
                new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
                keys, n = keys[new], np.add.reduceat(n, new)
                while len(keys) > CHUNK:  # the last pair may go on in the next batch
                    yield row(CHUNK)
                    keys, n, part = keys[CHUNK:], n[CHUNK:], part + 1
        if len(keys):
            yield row(len(keys))

    parts = blocks.select("places", "times").mapInArrow(merged, "pair bigint, n bigint")
    return parts.repartitionByRange(shards, "pair").sortWithinPartitions("pair").mapInArrow(summed, "shard int, part int, pairs binary, counts binary")


def _highest(counts: DataFrame) -> DataFrame:
    """(a, best, first, shard): highest count of each A id in each row of a shard, and the shard's least pair."""
    import pyarrow as pa

    def run(batches):
        import numpy as np

        for b in batches:
            for s, p, c in zip(*(x.to_pylist() for x in b.columns)):
                keys, n = np.frombuffer(p, np.int64), np.frombuffer(c, np.int64)
                new = np.flatnonzero(np.diff(keys >> 32, prepend=-1))
                yield pa.RecordBatch.from_arrays([pa.array(keys[new] >> 32), pa.array(np.maximum.reduceat(n, new)), pa.array(keys[new]), pa.array(np.full(len(new), s, np.int32))], names=["a", "best", "first", "shard"])

    return counts.select("shard", "pairs", "counts").mapInArrow(run, "a bigint, best bigint, first bigint, shard int")


def _asked(blocks: DataFrame, firsts: list[int], ids: list[int]) -> DataFrame:
    """(shard, kind 1, block, pairs): what each block asks each shard."""
    import pyarrow as pa

    def run(batches):
        import numpy as np

        for b in batches:
            for block, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                pairs = np.frombuffer(p, np.int64)
                cuts = pairs.searchsorted(np.array(firsts[1:], np.int64)).tolist()
                asked = [(i, lo, hi) for i, lo, hi in zip(ids, [0, *cuts], [*cuts, len(pairs)]) if hi > lo]
                if asked:
                    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in asked], pa.int32()), pa.array([1] * len(asked), pa.int32()), pa.array([block] * len(asked), pa.int64()), pa.array([pairs[lo:hi].tobytes() for _, lo, hi in asked]), pa.nulls(len(asked), pa.binary())], names=["shard", "kind", "block", "pairs", "counts"])

    return blocks.select("block", "places").mapInArrow(run, "shard int, kind int, block bigint, pairs binary, counts binary")


class _Shard:
    """A shard's pairs and counts in two files that are mapped into memory and already removed from their folder."""

    def __init__(self):
        self.files, self.n = [tempfile.TemporaryFile(prefix="shard-") for _ in range(2)], 0
        self.maps = None

    def add(self, pairs: bytes, counts: bytes):
        for f, x in zip(self.files, (pairs, counts)):
            f.write(x)
        self.n += len(pairs) >> 3

    def counts(self, pairs):
        import numpy as np

        if self.maps is None:
            for f in self.files:
                f.flush()
            self.maps = [np.memmap(f, np.int64, "r", shape=(self.n,)) for f in self.files]
        return self.maps[1][self.maps[0].searchsorted(pairs)]

    def close(self):
        self.maps = None
        for f in self.files:
            f.close()


def _answers(counts: DataFrame, asked: DataFrame, best) -> DataFrame:
    """(block, shard, counts, highest) for each question: counts of its pairs, and whether each is its A id's highest."""
    import pyarrow as pa

    def run(batches):
        import numpy as np

        most = np.frombuffer(best.value, np.int64)
        last, shard = None, None
        for b in batches:
            for s, kind, block, pairs, n in zip(*(c.to_pylist() for c in b.columns)):
                if s != last:
                    if shard:
                        shard.close()
                    last, shard = s, _Shard()
                if not kind:
                    shard.add(pairs, n)
                    continue
                pairs = np.frombuffer(pairs, np.int64)
                n = shard.counts(pairs)
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([s], pa.int32()), pa.array([n.tobytes()]), pa.array([np.packbits(n == most[pairs >> 32]).tobytes()])], names=["block", "shard", "counts", "highest"])
        if shard:
            shard.close()

    held = counts.select("shard", F.lit(0).alias("kind"), F.col("part").cast("long").alias("block"), "pairs", "counts")
    both = held.unionAll(asked).repartition("shard").sortWithinPartitions("shard", "kind", "block")
    return both.mapInArrow(run, "block bigint, shard int, counts binary, highest binary")


def align_tokens(df: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each row."""
    import numpy as np
    import pyarrow as pa

    spark = df.sparkSession
    rows = stored(_aligned(df, path_a, path_b, key, text), "aligned")
    blocks = rows.filter("kind = 0")
    # Some shards to a task, so that tasks hold about as much as each other.
    counts = stored(pair_counts(blocks, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))), "pair-counts")
    highest = stored(_highest(counts), "highest")
    firsts = sorted((r["first"], r["shard"]) for r in highest.groupBy("shard").agg(F.min("first").alias("first")).collect())
    # One number for each id of A's vocabulary at most.
    of_a = highest.groupBy("a").agg(F.max("best").alias("best")).toPandas()
    most = np.zeros(int(of_a["a"].max()) + 1 if len(of_a) else 1, np.int64)
    most[of_a["a"].to_numpy(np.int64)] = of_a["best"].to_numpy(np.int64)
    best = spark.sparkContext.broadcast(most.tobytes())
    answers = _answers(counts, _asked(blocks, [f for f, _ in firsts], [s for _, s in firsts]), best)
    order = {s: i for i, (_, s) in enumerate(firsts)}

    def finish(batches):
        last, held, joined = None, [], None
        for b in batches:
            out, at_row = [], []
            fields = [c for c in b.schema.names if c != "key"]
            for i, (block, kind, n_a, n_b, n_groups, n_links, sha, places, times, shard) in enumerate(zip(*(b.column(c).to_pylist() for c in fields))):
                if block != last:
                    last, held, joined = block, [], None
                if not kind:
                    held.append((order[shard], np.frombuffer(places, np.int64), times))
                    continue
                n_best = count_sum = 0
                if n_a:
                    if joined is None:
                        held.sort(key=lambda x: x[0])
                        joined = np.concatenate([n for _, n, _ in held]), np.concatenate([np.unpackbits(np.frombuffer(h, np.uint8), count=len(n)) for _, n, h in held]).astype(bool)
                        held = []
                    at = np.frombuffer(places, np.int32).cumsum()
                    t = np.frombuffer(times, np.int32 if len(times) == len(places) else np.int64).astype(np.int64)
                    n_best, count_sum = int(t[joined[1][at]].sum()), int((t * joined[0][at]).sum())
                out.append((n_a, n_b, n_groups, n_links, n_best, count_sum, sha))
                at_row.append(i)
            if out:
                columns = list(zip(*out))
                yield pa.RecordBatch.from_arrays([b.column("key").take(pa.array(at_row)), *(pa.array(c, pa.int64()) for c in columns[:-1]), pa.array(columns[-1], pa.string())], names=names)

    names = [key, *_SUMS, "n_best", "count_sum", "groups_sha256"]
    back = answers.select("block", F.lit(0).alias("kind"), F.lit(None).cast(rows.schema["key"].dataType).alias("key"), *(F.lit(None).cast("long").alias(c) for c in _SUMS), F.lit(None).cast("string").alias("groups_sha256"), F.col("counts").alias("places"), F.col("highest").alias("times"), "shard")
    both = back.unionAll(rows.filter("kind = 1").withColumn("shard", F.lit(-1)))
    kinds = f"`{key}` {dict(df.dtypes)[key]}, {', '.join(f'{c} bigint' for c in names[1:-1])}, groups_sha256 string"
    return both.repartition("block").sortWithinPartitions("block", "kind").mapInArrow(finish, kinds)


def op11_token_alignment(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .common import table

    return align_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
