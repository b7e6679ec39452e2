"""Many patterns at once: which of a table of strings a text contains, the first by priority.

The strings become an Aho-Corasick automaton in flat arrays. A task walks the bytes of its Arrow text buffers, many pieces of
texts side by side: each step reads one byte of every piece, so the cost follows the text and not the number of patterns.
Pieces of one text overlap by the longest pattern, so no match is cut.

Automata are built from at most ``GROUP_BYTES`` of patterns, which bounds what is broadcast (some 40 bytes for each byte of a
pattern); more patterns make several automata, and texts that found nothing so far go on to the next one, in the order of
priority.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F

from ..sources.tables import written

GROUP_BYTES = 4 << 20
#: Entries of a full table of moves, beyond which moves are hashed and failures followed.
DENSE = 8 << 20
#: Bytes of a piece, and rows that are walked side by side.
PIECE, ROWS = 512, 2048
NONE = 1 << 62


class Automaton:
    """States in the order of depth; ``best`` is the least number of the patterns that end at a state or at its suffixes."""

    def __init__(self, patterns: list[bytes], numbers: list[int], dense: int = DENSE):
        import numpy as np

        data = np.frombuffer(b"".join(patterns), np.uint8)
        size = np.array([len(p) for p in patterns], np.int64)
        start = size.cumsum() - size
        self.longest = int(size.max(initial=0))
        node, keys, levels = np.zeros(len(patterns), np.int64), [], [np.zeros(1, np.int64)]
        count = 1
        for d in range(self.longest):
            on = np.flatnonzero(size > d)
            key, which = np.unique(node[on] << 8 | data[start[on] + d], return_inverse=True)
            node[on] = count + which
            keys.append(key)
            levels.append(np.arange(count, count + len(key)))
            count += len(key)
        best = np.full(count, NONE, np.int64)
        np.minimum.at(best, node, np.array(numbers, np.int64))
        edges = np.concatenate([*keys, np.zeros(0, np.int64)])
        self._hash(edges)
        fail = np.zeros(count, np.int64)
        for level, key in zip(levels[2:], keys[1:]):
            fail[level] = self._go(fail[key >> 8], key & 255, fail)
        for level in levels[1:]:
            best[level] = np.minimum(best[level], best[fail[level]])
        self.best, self.fail, self.moves = best, fail, None
        classes = np.unique(data)
        if count * (len(classes) + 1) <= dense:
            self.classes = np.zeros(256, np.int64)
            self.classes[classes] = np.arange(1, len(classes) + 1)
            self.moves = np.zeros((count, len(classes) + 1), np.int32)
            for level, key in zip(levels, [*keys, None]):
                if len(level) and level[0]:
                    self.moves[level] = self.moves[fail[level]]
                if key is not None:
                    self.moves[key >> 8, self.classes[key & 255]] = self._find(key)
            self.slots = self.targets = None

    def _hash(self, edges) -> None:
        """Moves by (state, byte) in a table with open addresses; the state behind the i-th move is i + 1."""
        import numpy as np

        bits = max(4, (2 * len(edges)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.slots, self.targets = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)
        left = np.arange(len(edges))
        at = self._slot(edges)
        while len(left):
            free = self.slots[at] < 0
            _, one = np.unique(np.where(free, at, -1 - np.arange(len(at))), return_index=True)
            one = one[free[one]]
            self.slots[at[one]], self.targets[at[one]] = edges[left[one]], left[one] + 1
            rest = np.ones(len(left), bool)
            rest[one] = False
            left, at = left[rest], (at[rest] + 1) & self.mask

    def _slot(self, keys):
        import numpy as np

        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def _find(self, keys):
        """States behind the moves, -1 where there is none."""
        import numpy as np

        at, out = self._slot(keys), np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        while len(left):
            there = self.slots[at]
            hit = there == keys[left]
            out[left[hit]] = self.targets[at[hit]]
            on = ~hit & (there >= 0)
            left, at = left[on], (at[on] + 1) & self.mask
        return out

    def _go(self, states, byte, fail):
        """States after one byte each."""
        import numpy as np

        out, left, now = np.zeros(len(states), np.int64), np.arange(len(states)), states
        while len(left):
            to = self._find(now << 8 | byte[left])
            done = (to >= 0) | (now == 0)
            out[left[done]] = np.maximum(to[done], 0)
            left, now = left[~done], fail[now[~done]]
        return out

    def first(self, data, offsets):
        """The least pattern number in each text ``data[offsets[i]:offsets[i + 1]]``, ``NONE`` where there is none."""
        import numpy as np

        n = len(offsets) - 1
        out = np.full(n, self.best[0], np.int64)
        if not self.longest or not n:
            return out
        width = max(PIECE, 4 * self.longest)
        size = np.diff(offsets)
        pieces = -(-size // width)
        text = np.repeat(np.arange(n), pieces)
        begin = offsets[text] + (np.arange(len(text)) - (pieces.cumsum() - pieces)[text]) * width
        end = np.minimum(begin + width, offsets[text + 1])
        begin = np.maximum(begin - self.longest + 1, offsets[text])
        order = np.argsort(begin - end, kind="stable")
        text, begin, end = text[order], begin[order], end[order]
        length = end - begin
        state, found = np.zeros(len(text), np.int64), np.full(len(text), NONE, np.int64)
        for k in range(int(length[0]) if len(length) else 0):
            on = int((-length).searchsorted(-k))  # pieces longer than k come first
            byte = data[begin[:on] + k]
            state[:on] = self.moves[state[:on], self.classes[byte]] if self.moves is not None else self._go(state[:on], byte.astype(np.int64), self.fail)
            np.minimum(found[:on], self.best[state[:on]], out=found[:on])
        np.minimum.at(out, text, found)
        return out


def _groups(rows: Iterable, limit: int):
    """Rows (pattern, number) in groups of at most ``limit`` bytes, one row at least."""
    held, size = [], 0
    for pattern, number in rows:
        raw = bytes(pattern)
        if held and size + len(raw) > limit:
            yield held
            held, size = [], 0
        held.append((raw, number))
        size += len(raw)
    if held:
        yield held


def first_contained(df: DataFrame, text: str, patterns: DataFrame, out: str = "rule", limit: int = GROUP_BYTES, dense: int = DENSE) -> DataFrame:
    """Rows with the least ``number`` of the ``patterns`` (pattern, number) that ``text`` contains, null if there is none.

    As SQL's ``contains``: case and accents count, an empty pattern is in every text, a null text or pattern matches nothing.
    """
    import pyarrow as pa
    from pyspark.sql.types import LongType, StructField, StructType

    spark = df.sparkSession
    schema = StructType([*df.schema.fields, StructField(out, LongType())])
    at = df.columns.index(text)
    found = df.withColumn(out, F.lit(None).cast("long"))
    ordered = patterns.filter("pattern IS NOT NULL AND number IS NOT NULL").groupBy("pattern").agg(F.min("number").alias("number")).orderBy("number", "pattern").select(F.encode("pattern", "UTF-8"), "number")
    for i, group in enumerate(_groups(ordered.toLocalIterator(), limit)):
        sent = spark.sparkContext.broadcast(Automaton([p for p, _ in group], [n for _, n in group], dense))

        def run(batches, sent=sent):
            import numpy as np

            automaton = sent.value
            for whole in batches:
                for k in range(0, whole.num_rows, ROWS):
                    b = whole.slice(k, ROWS)
                    old = b.column(b.num_columns - 1)
                    asked = np.flatnonzero(old.is_null().to_numpy(zero_copy_only=False) & b.column(at).is_valid().to_numpy(zero_copy_only=False))
                    values = b.column(at).take(pa.array(asked)).cast(pa.large_string())
                    offsets = np.frombuffer(values.buffers()[1], np.int64, len(values) + 1, values.offset * 8) if len(values) else np.zeros(1, np.int64)
                    data = np.frombuffer(values.buffers()[2] or b"", np.uint8) if len(values) else np.zeros(0, np.uint8)
                    got = np.array(old.fill_null(NONE).to_numpy(zero_copy_only=False), np.int64)
                    got[asked] = automaton.first(data, offsets)
                    yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(got, mask=got == NONE)], schema=b.schema)

        # One automaton's workers at a time.
        found = (written(found, "patterns") if i else found).mapInArrow(run, schema)
    return found
