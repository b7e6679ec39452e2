"""N-gram Jaccard join by signature trees, and the components of its links.

A text's words are ``[^\\x20\\x09-\\x0D]+`` after A-Z are lower-cased; its set are the distinct ``k``-word shingles (fewer
words: all of them as one). Two texts link when ``100 * |A & B| >= percent * |A | B|``.

1. Classes. Equal sets form a class; one text stands for it.
2. Upper tree. The root splits sets by size into nodes of two neighbouring bands, wide enough that any linked pair
   shares one. A node splits the hash space into more segments than a linked pair of its sizes can have differences, so
   such a pair agrees on a whole segment; the node's children are keyed by segment and content. If a set has shingles in
   more segments than there can be differences, one of those is agreed on, and its empty segments are left out: they
   would lead to one child for all. If it has ``t`` more, ``t`` at least are agreed on, and it leaves out its ``t - 1``
   children that most classes have: the rarest agreed child is not among them, on either side. So texts that only share
   passages seldom meet. Children are counted in one sort-based shuffle of hashes (counts beyond ``COUNTED`` are alike,
   ties go by the key), and only those that two classes share go on. Classes that share a child are joined in stars, and
   the stars' components are the leaves' groups: no link crosses two groups.
3. Signature tree. Groups are dealt to buckets of about ``UNIT`` classes; a task builds the signature tree of a bucket,
   whose leaves are its sets by group and size. A node holds the OR of its members' token bitmaps, their range of sizes,
   and the largest count of shingles that share a bit. A dual traversal from the root walks pairs of nodes, a node with
   itself first, and prunes those whose sizes, or whose largest possible overlap, rule out a link, and those inside one
   component. What is left is compared exactly. This alone finds the links; the groups only say which bucket a set is in.
4. Large groups. A group beyond a bucket is searched twice. First it is split into units by size band and hash, each with
   some classes of all units beside its own (``PIVOTS``), which joins most of what is linked. Then only classes of
   different components are left to compare: components are packed into bags, large ones alone, and pairs of bags of the
   same or the next two bands are units. A group that has become one component is done after the first step, so copies
   of one text cost time in proportion; the pairs of bags grow only with different components inside one group.

Edge cases: null texts and texts without words have an empty set and link with nothing; repeated rows and exact copies
are one class; an empty table gives an empty result; only the key and the text are read, so clashing names do no harm.
The component of a document is the smallest key reachable, its own included. Shingles and classes are known by 64-bit
hashes: among 10^10 different sets, about three pairs are expected to share one.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from .common import byte_blocks, likely, named, remembered, stored
from .components import connected_components

SHINGLE, PERCENT = 3, 90
UNIT, UNIT_SHINGLES, PIVOTS = 2000, 2_000_000, 32
FANOUT = 8
REMEMBERED = 500_000
COUNTED = 4096
BLOCK_BYTES = 4 << 20
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(32))) * _M[3]
        h = (h ^ (h >> np.uint64(29))) * _M[1]
    return h ^ (h >> np.uint64(32))


class WordHashes(dict):
    """64-bit hashes of words, computed once each; starts anew beyond its bound."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > REMEMBERED:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def word_hashes() -> WordHashes:
    return remembered("word hashes", WordHashes)


def shingles(text: str | None, k: int) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(word_hashes().__getitem__, words), np.uint64, len(words))
    n = max(len(h) - k + 1, 1)
    with np.errstate(over="ignore"):
        out = np.full(n, min(len(h), k), np.uint64)
        for i in range(min(k, len(h))):
            out = out * _M[0] + h[i : i + n]
    return np.unique(mixed(out))


@lru_cache(8)
def _bands(percent: int) -> np.ndarray:
    """First sizes of bands: a set of one band links only with sets of the same or neighbouring bands."""
    edges = [1]
    while edges[-1] < 1 << 40:
        edges.append(max(edges[-1] + 1, -(-edges[-1] * 100 // percent)))
    return np.array(edges)


def band_of(n: int, percent: int) -> int:
    return int(np.searchsorted(_bands(percent), n, "right")) - 1


def child_keys(s: np.ndarray, percent: int) -> tuple[np.ndarray, list[int]]:
    """Keys of the upper tree's children that a set belongs to, and how many of a node's may be left out, by parity.

    A set's two nodes have different parities, which the lowest bit of a key tells. Which children are left out must
    follow one order of all keys, the last ones first.
    """
    n = len(s)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(s + _M[2]), dtype=np.uint64)])
    own, edges, keys, spare = band_of(n, percent), _bands(percent), [], [0, 0]
    for node in (own, own - 1):
        if node < 0:
            continue
        # The smaller set of a pair has at most this many shingles here; linked sets differ in at most `apart`.
        apart = (int(edges[node + 1]) - 1) * (100 - percent) // percent
        m = apart + 1 + (apart + 1) * (100 - percent) // 65 + 1
        cuts = np.array([(j << 64) // m for j in range(1, m)], np.uint64) if m < 4096 else _cuts(m)
        at = np.concatenate([[0], np.searchsorted(s, cuts), [n]])
        sizes = np.diff(at)
        with np.errstate(over="ignore"):
            content = sums[at[1:]] - sums[at[:-1]]
            name = np.uint64(node + 1) * _M[0] + np.arange(m, dtype=np.uint64) * _M[1] + sizes.astype(np.uint64)
            found = (mixed(content * _M[2] + mixed(name)) & ~np.uint64(1)) | np.uint64(node & 1)
        full = sizes > 0
        # A linked set agrees on all but `apart` of the full segments.
        more = int(full.sum()) - apart
        spare[node & 1] = max(more - 1, 0)
        keys.append(found[full] if more > 0 else found)
    return np.concatenate(keys).view(np.int64), spare


def _cuts(m: int) -> np.ndarray:
    step, rest = divmod(1 << 64, m)
    j = np.arange(1, m, dtype=np.uint64)
    return j * np.uint64(step) + (j.astype(np.float64) * (rest / m)).astype(np.uint64)


def class_name(s: np.ndarray) -> int | None:
    """A hash of a set; None for an empty one."""
    import xxhash

    return xxhash.xxh3_64_intdigest(s.tobytes(), seed=len(s)) - (1 << 63) if len(s) else None


def class_rows(docs: DataFrame, k: int) -> DataFrame:
    """(key, row, mark, n, class) of each document."""
    import pyarrow as pa

    def run(batches):
        for b in byte_blocks(batches, BLOCK_BYTES):
            sets = [shingles(t, k) for t in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(3)), pa.array(map(len, sets), pa.int64()), pa.array(map(class_name, sets), pa.int64())], names=["key", "row", "mark", "n", "class"])

    return docs.mapInArrow(run, f"key {dict(docs.dtypes)['key']}, row bigint, mark bigint, n bigint, class bigint")


def class_keys(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(k, class, spare) of the children of each document's class; again only where a task has long forgotten the class.

    ``spare`` is how many keys of this class and parity may be left out. Nothing is stored here: the sets are cheaper to
    build twice than their keys are to keep.
    """
    import pyarrow as pa

    def run(batches):
        seen: set[int] = set()
        for b in byte_blocks(batches, BLOCK_BYTES):
            if len(seen) > 1_000_000:
                seen = set()
            names, keys, spares = [], [], []
            for t in b.column(0).to_pylist():
                s = shingles(t, k)
                name = class_name(s)
                if name is None or name in seen:
                    continue
                seen.add(name)
                found, spare = child_keys(s, percent)
                keys.append(found)
                names.append(np.full(len(found), name, np.int64))
                spares.append(np.array(spare, np.int32)[found & 1])
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (keys, names, spares)], names=["k", "class", "spare"])

    return docs.select("text").mapInArrow(run, "k bigint, class bigint, spare int")


def shared_keys(keys: DataFrame, counted: int = COUNTED) -> DataFrame:
    """(k, class, spare, df) of keys that two classes have at least; ``df`` counts the classes, up to ``counted``.

    Keys stream by in order. A key's rows are held until ``counted`` of them are known, so a hot key takes no more memory.
    """
    import pyarrow as pa

    names = ["k", "class", "spare", "df"]

    def run(batches):
        held = None
        last = first = 0
        for b in batches:
            if not b.num_rows:
                continue
            rows = np.stack([c.to_numpy().astype(np.int64) for c in b.columns])
            if held is not None:
                rows = np.concatenate([held, rows], axis=1)
            new = np.ones(rows.shape[1], bool)
            new[1:] = (rows[0, 1:] != rows[0, :-1]) | (rows[1, 1:] != rows[1, :-1])
            rows = rows[:, new]
            at = np.flatnonzero(np.concatenate([[True], rows[0, 1:] != rows[0, :-1]]))
            sizes = np.diff(np.concatenate([at, [rows.shape[1]]]))
            # `first` rows of the held key are out already, all but its last, which finds repeats of its class.
            df = np.minimum(sizes, counted)
            if first:
                df[0] = counted
            df = np.repeat(df, sizes)
            end, skip = int(at[-1]), 1 if first else 0
            if df[-1] >= counted:
                held, last, out, first = rows[:, -1:], 1, slice(skip, None), 1
            else:
                held, last, out, first = rows[:, end:], 0, slice(skip, end), 0
            rows, df = rows[:, out], df[out]
            yield record(rows[:, df > 1], df[df > 1])
        if held is not None and not last and held.shape[1] > 1:
            yield record(held, np.full(held.shape[1], held.shape[1]))

    def record(rows, df):
        return pa.RecordBatch.from_arrays([pa.array(rows[0]), pa.array(rows[1]), pa.array(rows[2].astype(np.int32)), pa.array(df.astype(np.int32))], names=names)

    return keys.repartition("k").sortWithinPartitions("k", "class").mapInArrow(run, "k bigint, class bigint, spare int, df int")


def rare_keys(shared: DataFrame) -> DataFrame:
    """(k, class) without the ``spare`` most common keys of each class and parity."""
    order = Window.partitionBy("class", F.col("k").bitwiseAND(1)).orderBy(F.desc("df"), F.desc("k"))
    return shared.repartition("class").withColumn("place", F.row_number().over(order)).filter("place > spare").select("k", "class")


def stars(rows: DataFrame) -> DataFrame:
    """Edges (a, b) from the smallest class of each child to its others; children stream by in order of their keys."""
    import pyarrow as pa

    def run(batches):
        key = first = None
        for b in batches:
            if not b.num_rows:
                continue
            keys, classes = b.column(0).to_numpy(), b.column(1).to_numpy()
            begins = np.concatenate([[keys[0] != key or first is None], keys[1:] != keys[:-1]])
            at = np.maximum.accumulate(np.where(begins, np.arange(len(keys)), -1))
            heads = np.where(at >= 0, classes[at], first if first is not None else 0)
            key, first = keys[-1], heads[-1]
            other = heads != classes
            pairs = np.unique(np.stack([heads[other], classes[other]], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return rows.repartition("k").sortWithinPartitions("k", "class").mapInArrow(run, "a bigint, b bigint")


class SignatureTree:
    """Levels of OR-combined bitmaps and size ranges over sets in the order given; level 0 are the sets.

    Bitmaps have about 32 bits a shingle of a set of mean size, so that a node of unlike sets stays sparse.
    """

    def __init__(self, sets: list[np.ndarray], fanout: int = FANOUT):
        self.sets, self.fanout = sets, fanout
        width = 64
        while width < min(32 * sum(map(len, sets)) // len(sets), 1 << 17):
            width *= 2
        bits = np.zeros((len(sets), width // 64), np.uint64)
        one = np.zeros(width, np.uint8)
        for row, s in zip(bits, sets):
            one[:] = 0
            one[(s & np.uint64(width - 1)).astype(np.int64)] = 1
            row[:] = np.packbits(one).view(np.uint64)
        n = np.array([len(s) for s in sets])
        self.levels = [(bits, n, n, n - np.bitwise_count(bits).sum(1).astype(np.int64))]
        while len(self.levels[-1][1]) > fanout:
            bits, low, high, doubled = self.levels[-1]
            at = np.arange(0, len(low), fanout)
            self.levels.append((np.bitwise_or.reduceat(bits, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(doubled, at)))

    def possible(self, level: int, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
        """Which node pairs may hold a link: sizes in range, and the largest possible overlap is enough."""
        bits, low, high, doubled = self.levels[level]
        out = (100 * high[i] >= percent * low[j]) & (100 * high[j] >= percent * low[i])
        step = max(1, (1 << 18) // bits.shape[1])
        for a in range(0, len(i), step):
            x, y = i[a : a + step], j[a : a + step]
            # A set has at most `doubled` more shingles than bits, so its overlap is at most the common bits and these.
            common = np.bitwise_count(bits[x] & bits[y]).sum(1).astype(np.int64) + np.minimum(doubled[x], doubled[y])
            most = np.minimum(common, np.minimum(high[x], high[y]))
            out[a : a + step] &= most * (100 + percent) >= percent * (low[x] + low[y])
        return out

    def children(self, level: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size, f = len(self.levels[level - 1][1]), self.fanout
        x = (i[:, None, None] * f + np.arange(f)[None, :, None]) + np.zeros((1, 1, f), np.int64)
        y = (j[:, None, None] * f + np.arange(f)[None, None, :]) + np.zeros((1, f, 1), np.int64)
        keep = (x < size) & (y < size) & (x <= y)
        return x[keep], y[keep]


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)


def tree_components(sets: list[np.ndarray], percent: int, groups: list[int] | None = None) -> list[int]:
    """For each set, the place of one that stands for its component. Leaves are ordered by group, then by size."""
    n = len(sets)
    order = sorted(range(n), key=lambda i: (groups[i] if groups else 0, len(sets[i])))
    own = [sets[i] for i in order]
    parent = np.arange(n)

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = int(parent[i])
        return i

    def settle() -> np.ndarray:
        """Roots of all sets; afterwards every set points at its root."""
        p = parent
        while (p[p] != p).any():
            p[:] = p[p]
        return p

    if n > 1:
        tree = SignatureTree(own)
        stack: list[tuple[int, np.ndarray, np.ndarray]] = []

        def push(level: int, i: np.ndarray, j: np.ndarray) -> None:
            """A node with itself comes off before pairs: its members may become one component, which spares pairs."""
            same = i == j
            if level or (~same).any():
                stack.append((level, i[~same], j[~same]))
            if level and same.any():
                stack.append((level, i[same], j[same]))

        push(len(tree.levels) - 1, *np.triu_indices(len(tree.levels[-1][1])))
        while stack:
            level, i, j = stack.pop()
            # Pairs inside one component add nothing; a node counts as inside if all its sets have one root.
            low = high = settle()
            for _ in range(level):
                at = np.arange(0, len(low), tree.fanout)
                low, high = np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)
            keep = ~((low[i] == high[i]) & (low[j] == high[j]) & (low[i] == low[j]))
            i, j = i[keep], j[keep]
            keep = tree.possible(level, i, j, percent)
            i, j = i[keep], j[keep]
            if level:
                for a in range(0, len(i), 1024):
                    push(level - 1, *tree.children(level, i[a : a + 1024], j[a : a + 1024]))
            else:
                for x, y in zip(i.tolist(), j.tolist()):
                    a, b = find(x), find(y)
                    if a != b and linked(own[x], own[y], percent):
                        parent[max(a, b)] = min(a, b)
    roots = parent if n < 2 else settle()
    out = [0] * n
    for place, root in zip(order, roots.tolist()):
        out[place] = order[root]
    return out


def group_links(members: DataFrame, k: int, percent: int, unit: int = UNIT, unit_shingles: int = UNIT_SHINGLES) -> DataFrame:
    """Edges (a, b) between classes of one component, for the groups of (g, class, text) rows: a tree for each bucket."""
    import pyarrow as pa

    def rows(batches):
        for b in batches:
            for i in range(0, b.num_rows, 256):
                yield from zip(*(b.column(c).slice(i, 256).to_pylist() for c in range(3)))

    def edges(held: dict) -> pa.RecordBatch:
        names = [name for _, name in held]
        roots = tree_components(list(held.values()), percent, [g for g, _ in held])
        found = [(name, names[root]) for name, root in zip(names, roots) if names[root] != name]
        return pa.RecordBatch.from_arrays([pa.array([x[c] for x in found], pa.int64()) for c in (0, 1)], names=["a", "b"])

    def run(batches):
        held: dict[tuple[int, int], np.ndarray] = {}
        size, last = 0, None
        for g, name, text in rows(batches):
            if g != last and (len(held) >= unit or size >= unit_shingles):
                yield edges(held)
                held, size = {}, 0
            last = g
            if (g, name) not in held:
                held[g, name] = s = shingles(text, k)
                size += len(s)
        if held:
            yield edges(held)

    return members.repartition("g").sortWithinPartitions("g").mapInArrow(run, "a bigint, b bigint")


def _band(percent: int):
    """Bands as `_bands` has them for large sizes; that linked sets' bands differ by two at most is all that is used."""
    return F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent))).cast("long")


def _parts(unit: int, unit_shingles: int, count, shingles):
    """How many units of half the bound hold so much."""
    return F.greatest(F.ceil(count * 2 / unit), F.ceil(shingles * 2 / unit_shingles), F.lit(1)).cast("long")


def _each(parts: str):
    return F.explode(F.sequence(F.lit(0).cast("long"), F.col(parts) - 1))


def large_links(big: DataFrame, k: int, percent: int, unit: int, unit_shingles: int) -> DataFrame:
    """Edges between classes of groups beyond a bucket; ``big``: (class, root, n, text), step 4 of the module's text."""
    texts = big.select("class", "text")
    bands = stored(big.select("class", "root", "n", _band(percent).alias("band")).distinct(), "bands")
    near = lambda a, b: F.abs(F.col(a) - F.col(b)) <= 2
    per = bands.groupBy("root", "band").agg(_parts(unit, unit_shingles, F.count("*"), F.sum("n")).alias("units"))
    g = F.xxhash64("root", "band", "unit")
    own = bands.join(per, ["root", "band"]).withColumn("unit", F.pmod(F.xxhash64("class"), F.col("units"))).select("class", g.alias("g"))
    first = bands.withColumn("place", F.row_number().over(Window.partitionBy("root", "band").orderBy(F.xxhash64("class", "root"), "class"))).filter(F.col("place") <= PIVOTS)
    pivots = first.select("class", "root", F.col("band").alias("own")).join(per, "root").filter(near("own", "band")).withColumn("unit", _each("units")).select("class", g.alias("g"))
    groups = own.unionByName(pivots).distinct()
    links = stored(group_links(texts.join(groups, "class").select("g", "class", "text"), k, percent, unit, unit_shingles), "links")
    found = connected_components(links)
    left = bands.join(found.select(F.col("node").alias("class"), F.col("root").alias("comp")), "class", "left").withColumn("comp", F.coalesce("comp", "class"))
    several = left.groupBy("root").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x <> y").select("root")
    left = stored(left.join(several, "root", "left_semi"), "left")
    sizes = left.groupBy("root", "band", "comp").agg(F.count("*").alias("c"), F.sum("n").alias("s")).withColumn("parts", _parts(unit, unit_shingles, F.col("c"), F.col("s")))
    # Components that fill a unit are bags of their own, of several parts perhaps; the others are packed together.
    packed = sizes.filter("parts <= 1").groupBy("root", "band").agg(_parts(unit, unit_shingles, F.sum("c"), F.sum("s")).alias("bags"))
    alone = F.col("parts") > 1
    bag = F.when(alone, F.col("comp")).otherwise(F.pmod(F.xxhash64("comp"), F.col("bags")))
    bags = stored(sizes.join(packed, ["root", "band"], "left").select("root", "band", "comp", "parts", alone.alias("alone"), bag.alias("bag")), "bags")
    ends = bags.select("root", "band", "alone", "bag", F.when(F.col("alone"), F.col("parts")).otherwise(1).alias("parts")).distinct()
    other = ends.select("root", *(F.col(c).alias(f"to_{c}") for c in ("band", "alone", "bag", "parts")))
    pairs = ends.join(other, "root").filter("to_band BETWEEN band AND band + 2 AND NOT (alone AND to_alone AND bag = to_bag)")
    pairs = pairs.filter("to_band > band OR struct(alone, bag) <= struct(to_alone, to_bag)").withColumn("part", _each("parts")).withColumn("to_part", _each("to_parts"))
    pairs = pairs.withColumn("g", F.xxhash64("root", "band", "alone", "bag", "part", "to_band", "to_alone", "to_bag", "to_part"))
    both = pairs.select("root", "band", "alone", "bag", "part", "g").unionByName(pairs.select("root", *(F.col(f"to_{c}").alias(c) for c in ("band", "alone", "bag", "part")), "g")).distinct()
    dealt = left.join(bags, ["root", "band", "comp"]).withColumn("part", F.when(F.col("alone"), F.pmod(F.xxhash64("class"), F.col("parts"))).otherwise(0))
    groups = dealt.join(both, ["root", "band", "alone", "bag", "part"]).select("class", "g").distinct()
    return links.unionByName(group_links(texts.join(groups, "class").select("g", "class", "text"), k, percent, unit, unit_shingles))


def jaccard_components(df: DataFrame, key: str = "doc_id", text: str = "text", k: int = SHINGLE, percent: int = PERCENT, unit: int = UNIT, unit_shingles: int = UNIT_SHINGLES) -> DataFrame:
    """(key, n_shingles, component_id) of each row."""
    docs = df.select(named(key).alias("key"), F.xxhash64(named(key)).alias("row"), F.xxhash64(named(text)).alias("mark"), named(text).alias("text"))
    rows = stored(class_rows(docs, k), "classes")
    candidates = connected_components(stars(rare_keys(shared_keys(class_keys(docs, k, percent)))))
    classes = rows.filter("class IS NOT NULL").groupBy("class").agg(F.min("key").alias("least"), F.min(F.struct("row", "mark")).alias("one"), F.max("n").alias("n"))
    clusters = stored(candidates.select(F.col("node").alias("class"), "root").join(classes, "class"), "clusters")
    # Written, like all aggregates that rows are joined to: Spark then can split a root or a text that is very common.
    sizes = stored(clusters.groupBy("root").agg(((F.count("*") > unit) | (F.sum("n") > unit_shingles)).alias("split")), "sizes")
    asked = clusters.join(sizes, "root").select("class", "root", "n", "split", "one.row", "one.mark", F.xxhash64("one.row", "one.mark").alias("name"))
    asked = stored(asked, "asked")
    # Only texts that a cluster may have asked for are shuffled.
    texts = likely(docs.select("row", "mark", "text", F.xxhash64("row", "mark").alias("name")), asked, "name").drop("name")
    members = stored(texts.join(asked.drop("name"), ["row", "mark"]).select("class", "root", "n", "split", "text"), "members")
    links = stored(group_links(members.filter("NOT split").select(F.col("root").alias("g"), "class", "text"), k, percent, unit, unit_shingles), "links")
    big = members.filter("split").drop("split")
    if not sizes.filter("split").isEmpty():
        joined = connected_components(large_links(big, k, percent, unit, unit_shingles))
        links = links.unionAll(joined.select("node", "root").toDF("a", "b").filter("a <> b"))
    # Each class points at one root; the smallest key of a component is that of all classes that point there.
    to_root = clusters.select("class", "least").join(links.select(F.col("a").alias("class"), F.col("b").alias("to")), "class", "left").withColumn("to", F.coalesce("to", "class"))
    to_root = stored(to_root, "to-root")
    least = stored(to_root.groupBy("to").agg(F.min("least").alias("component")), "least")
    found = to_root.join(least, "to").select("class", "component")
    answers = classes.select("class", "least").join(found, "class", "left").select("class", F.coalesce("component", "least").alias("component"))
    # Written, so that the last join shares its shuffle with no aggregate and Spark can split a class of very many copies.
    answers = stored(answers, "named")
    out = rows.select("key", "n", "class").join(answers, "class", "left")
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component", "key").alias("component_id"))


def op4_ngram_join(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLE_SQL = rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT rid, doc_id, array_to_string(list_slice(w, i, i + 2), ' ') AS g
      FROM (SELECT rid, doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
p AS (SELECT a.rid AS x, b.rid AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.rid <> b.rid GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n nx ON nx.rid = x JOIN n ny ON ny.rid = y WHERE 100 * c >= {PERCENT} * (nx.n + ny.n - c)),
r(x, y) AS (SELECT rid, rid FROM d UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(e.doc_id) AS component_id
FROM d LEFT JOIN n USING (rid) JOIN r ON r.x = d.rid JOIN d e ON e.rid = r.y GROUP BY d.rid, d.doc_id, n.n
"""
