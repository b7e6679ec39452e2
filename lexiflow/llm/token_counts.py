"""Token counts of whole texts, with overlap resynchronisation for huge documents.

A text of up to ``CHUNK`` characters is short: its count is the sum over its pieces between ASCII white space, each
encoded once. A longer one is cut into chunks that overlap by
``OVERLAP`` characters; each chunk is encoded with offsets, and neighbours are spliced at a position inside the overlap
that (a) is proven stable, (b) is a token boundary of both chunks, and (c) is followed by the same tokens at the same
offsets in both. Where the overlap has no such position it is doubled, at worst until the two chunks are one.

A position is proven stable when no match of the tokenizer's pre-splitting pattern, no normalisation and no special
token can reach across it: next to ASCII white space (which the pattern drops), or between an ASCII digit and an ASCII
letter or digit (letters are matched in runs, digits one by one, and special tokens hold no digits or spaces). Tokens
never cross a pre-split, so what stands left of such a position has no effect on what stands right of it. This holds for
tokenizers with the settings in ``packing.KNOWN``; others get every text whole.

Edge cases: null and empty texts have 0 bytes and 0 tokens; repeated rows are counted one by one; an empty table gives
an empty result; columns of the input that are not asked for are dropped, so clashing names do no harm.
"""

from __future__ import annotations

import os
from functools import lru_cache

from pyspark.sql import DataFrame

CHUNK, OVERLAP = 32768, 512
REMEMBERED = 400_000
#: Tokens after the splice that must agree, and characters at either end of the overlap that are not looked at.
AGREE, GUARD = 4, 32
LIMIT = 2048
BLOCK_BYTES = 4 << 20
SPACE = frozenset(" \t\n\r\x0b\x0c")
DIGIT = frozenset("0123456789")
ALNUM = DIGIT | frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")


@lru_cache(2)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def is_stable(text: str, p: int) -> bool:
    """True where the tokens of ``text`` are those of ``text[:p]`` and then those of ``text[p:]``."""
    a, b = text[p - 1], text[p]
    return a in SPACE or b in SPACE or (a in DIGIT and b in ALNUM) or (a in ALNUM and b in DIGIT)


class _Chunk:
    """A chunk's tokens: ids, and offsets in the whole text; the tokens before ``first`` are spent."""

    def __init__(self, tk, text: str, start: int, stop: int):
        e = tk.encode(text[start:stop], add_special_tokens=False)
        self.offsets, self.ids, self.start, self.stop, self.first, self.begin = e.offsets, e.ids, start, stop, 0, start

    def token(self, i: int) -> tuple[int, int, int]:
        a, b = self.offsets[i]
        return a + self.start, b + self.start, self.ids[i]


def _splice(text: str, left: _Chunk, right: _Chunk) -> tuple[int, int, int] | None:
    """A common stable boundary: the position, the tokens before it on the left, the tokens before it on the right."""
    lo, hi = right.start + GUARD, left.stop - GUARD
    n, m = len(left.ids), len(right.ids)
    i, j = n, 0
    while i > left.first and left.token(i - 1)[0] >= lo:
        i -= 1
    inside = lambda c, k, size: [x for x in map(c.token, range(k, min(k + AGREE, size))) if x[1] <= hi]
    while i < n and left.token(i)[0] < hi:
        p = left.token(i)[0]
        while j < m and right.token(j)[0] < p:
            j += 1
        if p > 0 and is_stable(text, p) and (i == left.first or left.token(i - 1)[1] <= p) and (not j or right.token(j - 1)[1] <= p) and inside(left, i, n) == inside(right, j, m):
            return p, i, j
        i += 1
    return None


def encode_long(tk, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
    """Token ids of a text of any length, from overlapping chunks."""
    n = len(text)
    ids: list[int] = []
    left = _Chunk(tk, text, 0, min(n, chunk))
    while left.stop < n:
        reach, stop = overlap, min(n, left.stop + chunk - overlap)
        while True:
            start = max(left.begin, left.stop - reach)
            if start == left.begin:
                # All of the left chunk is overlap: encode both as one, twice as long at least.
                left = _Chunk(tk, text, start, min(n, max(stop, 2 * left.stop - start)))
                break
            right = _Chunk(tk, text, start, stop)
            found = _splice(text, left, right)
            if found:
                p, i, j = found
                ids += left.ids[left.first : i]
                right.first, right.begin = j, p
                left = right
                break
            reach *= 2
    return ids + left.ids[left.first :]


def proven(tk) -> bool:
    """True for a tokenizer with the settings for which the module's stable positions are proven."""
    import json

    from .packing import KNOWN

    own = json.loads(tk.to_str())
    settings = {"normalizer": own["normalizer"], "splits": own["pre_tokenizer"], "end": own["model"].get("end_of_word_suffix")}
    return settings == KNOWN and all(a["content"].startswith("<|") for a in own["added_tokens"])


class Counter:
    """Token counts of short texts as sums over their pieces between white space, which are stable boundaries.

    Counts of pieces are remembered up to ``REMEMBERED``; beyond it the memory starts anew. A tokenizer that is not
    ``proven`` gets every text whole, however long it is.
    """

    def __init__(self, path: str):
        self.tk, self.known = tokenizer(path), {}
        self.proven = proven(self.tk)
        self.tk.no_truncation()
        self.tk.no_padding()

    def short(self, texts: list[str]) -> list[int]:
        pieces = [t.encode().split() for t in texts]  # bytes are split at ASCII white space only
        if len(self.known) > REMEMBERED:
            self.known = {}
        known = self.known
        new = list({p for ps in pieces for p in ps if p not in known})
        known.update(zip(new, map(len, self.tk.encode_batch_fast([p.decode() for p in new], add_special_tokens=False))))
        return [sum(map(known.__getitem__, ps)) for ps in pieces]

    def __call__(self, texts: list[str | None], chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
        if not self.proven:
            return [len(e.ids) for e in self.tk.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]
        out = self.short([t if t and len(t) <= chunk else "" for t in texts])
        for k, t in enumerate(texts):
            if t and len(t) > chunk:
                out[k] = len(encode_long(self.tk, t, chunk, overlap))
        return out


def counter(path: str) -> Counter:
    from .common import remembered

    return remembered(f"counts of {path}", lambda: Counter(path))


def token_counts(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) of each row; one scan, no shuffle, blocks of about a megabyte in Python."""
    import pyarrow as pa

    from .common import byte_blocks

    kind = dict(df.dtypes)[key]

    def run(batches):
        count = counter(path)
        for b in byte_blocks(batches, BLOCK_BYTES, "__text"):
            texts = b.column(1).to_pylist()
            n = count(texts, chunk, overlap)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t.encode()) if t else 0 for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n])], names=[key, "n_bytes", "n_tokens", "over_limit"])

    return df.selectExpr(f"`{key}`", f"`{text}` AS __text").mapInArrow(run, f"`{key}` {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")


def op1_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .common import table

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
