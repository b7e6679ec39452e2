"""Byte-level BPE by corpus-level merge replay, and its decoding.

The words (pattern matches) of a block of texts are gathered once each. All of them are laid out as one sequence of
symbols, linked word by word, with an inverted index from symbol pair to the positions where it stands. The merges are
then replayed over the whole block in rank order; each one visits only the positions of its pair and updates only the
neighbours it touches. Words are independent of each other, so a block gives the same ids as the whole corpus would;
the words of a Spark task's earlier blocks are remembered up to a bound, and only new ones are replayed. Symbols and pairs
are numbers, not bytes, so that a merge hashes and joins no strings.

Edge cases: null and empty texts have no ids; repeated rows are encoded one by one; an empty table gives an empty
result. Only the key and the text are read, so clashing names of other columns do no harm. Lone words of any length are
handled in time n log n.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from functools import lru_cache

from pyspark.sql import DataFrame

BLOCK_BYTES = 4 << 20
#: Words remembered between blocks of a task; beyond it a new memory begins, and the one before it is kept as long as that.
REMEMBERED = 300_000


@lru_cache(2)
def vocabulary(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of base64 tokens and ranks."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def pair_ranks(ranks: dict[bytes, int]) -> tuple[dict[int, int], int]:
    """Rank of each token by the ranks of two tokens that make it up, as one number: left, shifted by the bits given too, and right."""
    bits, pairs = max(ranks.values(), default=0).bit_length(), {}
    for token, rank in ranks.items():
        for i in range(1, len(token)):
            left, right = ranks.get(token[:i]), ranks.get(token[i:])
            if left is not None and right is not None:
                pairs[left << bits | right] = rank
    return pairs, bits


def replay(words: list[bytes], ranks: dict[bytes, int]) -> list[list[int]]:
    """Ids of each word: the merges of the whole list, in rank order, through an inverted index."""
    import numpy as np

    return [np.frombuffer(ids, "<u4").tolist() for ids in replay_bytes(words, ranks, *pair_ranks(ranks))]


def replay_bytes(words: list[bytes], ranks: dict[bytes, int], pairs: dict[int, int], bits: int) -> list[bytes]:
    """``replay`` with the table of ``pair_ranks``; ids as little-endian 32-bit integers. Symbols are ranks, -1 where merged away."""
    import numpy as np

    joined = np.frombuffer(b"".join(words), np.uint8)
    sizes = np.array([len(w) for w in words], np.int64)
    n, stops = len(joined), np.cumsum(sizes)
    single = np.array([ranks.get(bytes([i]), -1) for i in range(256)], np.int64)
    symbols = single[joined]
    if (symbols < 0).any():  # not every byte is a token: bytes have no ranks to go by
        return [np.array(merge_word(w, ranks), "<u4").tobytes() for w in words]
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    after[stops[sizes > 0] - 1] = -1
    before[(stops - sizes)[sizes > 0]] = -1
    # The index begins with the pairs of bytes: places in the order of their ranks.
    table = np.full((256, 256), -1, np.int64)
    for x in range(256):
        table[x] = [pairs.get(int(single[x]) << bits | int(y), -1) if single[x] >= 0 <= y else -1 for y in single]
    places = np.flatnonzero(after >= 0)
    found = table[joined[places], joined[places + 1]] if n else places
    places, found = places[found >= 0], found[found >= 0]
    order = np.argsort(found, kind="stable")
    places, found = places[order], found[order]
    edges = np.flatnonzero(np.diff(found, prepend=-1, append=-1)).tolist() if len(found) else [0]
    index = {int(found[x]): places[x:y].tolist() for x, y in zip(edges, edges[1:])}
    symbol, after, before, get = symbols.tolist(), after.tolist(), before.tolist(), pairs.get
    queue = list(index)
    heapq.heapify(queue)
    early: list[int] = []
    while queue:
        rank = heapq.heappop(queue)
        for i in sorted(index.pop(rank)):
            left, j = symbol[i], after[i]
            if left < 0 or j < 0 or get(left << bits | symbol[j]) != rank:
                continue
            # The pair at i becomes one symbol; only its two neighbours get new pairs.
            symbol[i], symbol[j] = rank, -1
            k, h = after[j], before[i]
            after[i] = k
            if h >= 0:
                r = get(symbol[h] << bits | rank)
                if r is not None:
                    if r <= rank:
                        early.append(i)
                    if r in index:
                        index[r].append(h)
                    else:
                        index[r] = [h]
                        heapq.heappush(queue, r)
            if k >= 0:
                before[k] = i
                r = get(rank << bits | symbol[k])
                if r is not None:
                    if r <= rank:
                        early.append(i)
                    if r in index:
                        index[r].append(i)
                    else:
                        index[r] = [i]
                        heapq.heappush(queue, r)
    ids = np.array(symbol, np.int64)
    raw = ids[ids >= 0].astype("<u4").tobytes()
    cuts = (np.concatenate([[0], np.cumsum(ids >= 0)])[np.concatenate([[0], stops])] * 4).astype(np.int64).tolist()
    out = list(map(raw.__getitem__, map(slice, cuts, cuts[1:])))
    if early:  # a merge that makes a pair of no higher rank: such words are merged one by one
        for k in set(np.searchsorted(stops, early, "right").tolist()):
            out[k] = np.array(merge_word(words[k], ranks), "<u4").tobytes()
    return out


def merge_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word: again and again the leftmost pair of least rank, from a heap of (rank, place, pair)."""
    n = len(word)
    parts: list[bytes | None] = [word[i : i + 1] for i in range(n)]
    after, before = [*range(1, n), -1], list(range(-1, n - 1))
    heap: list[tuple[int, int, bytes]] = []

    def offer(i: int, j: int) -> None:
        if i >= 0 and j >= 0:
            pair = parts[i] + parts[j]
            if pair in ranks:
                heapq.heappush(heap, (ranks[pair], i, pair))

    for i in range(n - 1):
        offer(i, i + 1)
    while heap:
        _, i, pair = heapq.heappop(heap)
        j = after[i] if parts[i] is not None else -1
        # A place that was merged since then has another pair, or none.
        if j < 0 or parts[i] + parts[j] != pair:
            continue
        parts[i], parts[j] = pair, None
        after[i] = after[j]
        if after[i] >= 0:
            before[after[i]] = i
        offer(before[i], i)
        offer(i, after[i])
    return [ranks[p] for p in parts if p is not None]


class Encoder:
    """Words to little-endian 32-bit ids, block by block."""

    def __init__(self, path: str, pattern: str, remembered: int = REMEMBERED):
        import regex

        self.ranks, self.split, self.remembered = vocabulary(path), regex.compile(pattern).findall, remembered
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for t, r in self.ranks.items():
            self.tokens[r] = t
        self.pairs, self.bits = pair_ranks(self.ranks)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as bytes."""
        words = [self.split(t) if t else [] for t in texts]
        if len(self.known) > self.remembered:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        new = set().union(*words).difference(known)
        known.update((w, older[w]) for w in new.intersection(older))
        new = list(new.difference(older))
        known.update(zip(new, replay_bytes([w.encode() for w in new], self.ranks, self.pairs, self.bits)))
        return [b"".join(map(known.__getitem__, ws)) for ws in words]

    def decode(self, ids: bytes) -> bytes:
        import numpy as np

        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encoder(path: str, pattern: str) -> Encoder:
    from .common import remembered

    return remembered(f"words of {path} {pattern}", lambda: Encoder(path, pattern))


def encode_texts(df: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids, decoded): ids as little-endian 32-bit integers, decoded as the bytes they stand for."""
    return _mapped(df, path, pattern, key, text, "ids binary, decoded binary", lambda ids, back: (ids, back))


def encode_digests(df: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) of each row."""
    return _mapped(df, path, pattern, key, text, "ids_sha256 string, decoded_sha256 string", lambda ids, back: (hashlib.sha256(ids).hexdigest(), hashlib.sha256(back).hexdigest()))


def _mapped(df, path, pattern, key, text, columns, row):
    import pyarrow as pa

    from .common import byte_blocks

    names = [key, "n_tokens", *(c.split()[0] for c in columns.split(", "))]
    kind = pa.string() if "string" in columns else pa.binary()

    def run(batches):
        enc = encoder(path, pattern)
        for b in byte_blocks(batches, BLOCK_BYTES, "__text"):
            ids = enc.encode(b.column(1).to_pylist())
            out = [row(x, enc.decode(x)) for x in ids]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([x[0] for x in out], kind), pa.array([x[1] for x in out], kind)], names=names)

    return df.selectExpr(f"`{key}`", f"`{text}` AS __text").mapInArrow(run, f"`{key}` {dict(df.dtypes)[key]}, n_tokens bigint, {columns}")


def op5_byte_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .common import table

    return encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
