"""Spelling variants: words of a corpus, their neighbours by one edit, and the commoner form each leads to.

Two words are near if they differ by exactly one inserted, deleted or replaced code point. Near pairs come from an
inverted index of positional 2-grams with a count filter:

1. Shards. A pair of least length ``m`` has its edit at one place, so what stands before and behind a range of places
   that holds it is the same in both. Each word is dealt by (m, range, what is outside) for both halves of the places,
   once as the shorter (or equal) and once as the longer word of a pair. A shard beyond ``SHARD`` characters is dealt
   anew by the halves of its range, down to single places, so no shard grows with the corpus and no link is lost.
2. Index. A task reads shard by shard; it posts each word under its (2-gram, place), numbered by length and word. A word
   of length ``m`` asks for partners behind itself: those of its own length share a 2-gram at the same place, those one
   longer at the same place or the next. An edit spoils at most two of its 2-grams (one where a code point is inserted),
   so one of its three shortest postings must hold a partner. These are merged by a heap; each candidate's overlap is
   completed by binary search in the long postings, and goes no further where the bound can't be reached.
3. Candidates at the bound are verified. A pair is given by the one shard whose range holds the first difference.

A word's form is its near word of largest ``n`` (ties: smallest in code-point order) if that is ``RATIO`` times its own
``n``; ``root`` follows forms to the last one by pointer doubling. ``n`` grows along forms, so chains are short.

Edge cases: null and empty texts have no words; a null key counts as an empty one in the checksum; repeated rows count
one by one; empty tables give empty results; columns that are not asked for are dropped, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from heapq import merge
from itertools import groupby

from pyspark.sql import Column, DataFrame, functions as F

from .common import discard, stored

LEAST_LENGTH, LEAST_COUNT, RATIO = 6, 5, 5
#: Every how many checksums a code point is deleted.
SPOILT = 199
#: Characters of a shard's words beyond which it is dealt anew, and distinct words that a task counts before it passes them on.
SHARD, COUNTED = 32_000, 300_000
RUNS = re.compile(rf"[a-zÀ-ÿ]{{{LEAST_LENGTH},}}")


def words_of(text: str, key, least: int = LEAST_LENGTH) -> Counter:
    """Words of a text with their numbers: lower-cased runs of letters, a code point deleted where the checksum says so."""
    seen = Counter(RUNS.findall(text.encode().lower().decode()))  # bytes.lower() knows A-Z only
    salt = zlib.crc32(f"{'' if key is None else key}:".encode())
    spoilt = [(run, h) for run in seen if (h := zlib.crc32(run.encode(), salt)) % SPOILT == 0]
    # All are taken out before one goes in: what a deletion leaves may be a run of the text that loses a code point itself.
    for run, h, n in [(run, h, seen.pop(run)) for run, h in spoilt]:
        at = h % len(run)
        word = run[:at] + run[at + 1 :]
        if len(word) >= least:
            seen[word] += n
    return seen


def word_counts(df: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of words with ``least`` occurrences overall; tasks pass on sums, so a word of all texts is a few rows."""
    import pyarrow as pa

    def count(batches):
        seen: Counter = Counter()
        out = lambda: pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], names=["word", "n"])
        for b in batches:
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if t:
                    for w, n in words_of(t, k).items():
                        seen[w] += n
                    if len(seen) > COUNTED:
                        yield out()
                        seen.clear()
        if seen:
            yield out()

    rows = df.selectExpr(f"`{key}` AS k", f"`{text}` AS t").mapInArrow(count, "word string, n bigint")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def _shard(m: Column, lo: Column, hi: Column) -> Column:
    """A word's place in the shard of least length ``m`` and range ``lo`` to ``hi``: the hash of what is outside the range."""
    outside = F.xxhash64(m, lo, hi, F.substring(F.col("word"), F.lit(1), lo), F.substring(F.col("word"), F.length("word") - m + hi + 1, m - hi))
    return F.struct(outside.alias("shard"), m.alias("m"), lo.alias("lo"), hi.alias("hi"))


def sharded(words: DataFrame, limit: int = SHARD) -> DataFrame:
    """(shard, m, lo, hi, word, n): each word in its shards, none of which exceeds ``limit`` characters but those of one place."""
    size = F.length("word")
    half = F.lit(2)
    ms = [size, size - 1]
    parts = [F.when(m >= F.lit(LEAST_LENGTH), _shard(m, lo, hi)) for m in ms for lo, hi in ((F.lit(0), F.floor(m / half).cast("int")), (F.floor(m / half).cast("int"), m))]
    rows = words.select("word", "n", F.explode(F.array_compact(F.array(*parts))).alias("s")).select("s.*", "word", "n")
    done = []
    while True:
        large = stored(rows.filter("hi - lo > 1").groupBy("shard").agg(F.sum(F.length("word")).alias("chars")).filter(F.col("chars") > limit).select("shard"), "large")
        if large.isEmpty():
            discard(large)
            break
        done.append(rows.join(large, "shard", "left_anti"))
        mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        parts = F.array(_shard(F.col("m"), F.col("lo"), mid), _shard(F.col("m"), mid, F.col("hi")))
        rows = stored(rows.join(large, "shard", "left_semi").filter("hi - lo > 1").select("word", "n", F.explode(parts).alias("s")).select("s.*", "word", "n"), "dealt")
    for d in done:
        rows = rows.unionByName(d)
    return rows


def one_edit(x: str, y: str) -> int:
    """First place where ``x`` and ``y``, as long or one longer, differ if one edit leads from one to the other, else -1."""
    i, n = 0, len(x)
    while i < n and x[i] == y[i]:
        i += 1
    if len(y) == n:
        return i if i < n and x[i + 1 :] == y[i + 1 :] else -1
    return i if x[i:] == y[i + 1 :] else -1


def _has(lists, j: int) -> bool:
    """True if ``j`` is in one of the sorted lists."""
    return any((k := bisect_left(q, j)) < len(q) and q[k] == j for q in lists)


def near_in_shard(words: list[str], m: int, lo: int, hi: int):
    """Numbers (i, j) of near words of a shard whose first difference lies in its range; ``words`` by length, then word."""
    post: dict[tuple[str, int], list[int]] = {}
    for i, w in enumerate(words):
        for p in range(len(w) - 1):
            post.setdefault((w[p : p + 2], p), []).append(i)
    none: list[int] = []
    for i, x in enumerate(words):
        if len(x) != m:
            break
        lists = []
        for p in range(m - 1):
            g = x[p : p + 2]
            lists.append((post[g, p], post.get((g, p + 1), none)))
        lists.sort(key=lambda ab: len(ab[0]) + len(ab[1]))
        short, long = lists[:3], lists[3:]
        for j, hits in groupby(merge(*(q[bisect_right(q, i) :] for ab in short for q in ab if q))):
            y = words[j]
            # A 2-gram of x counts once, whether y has it at the same place, the next, or both.
            left = len(y) - 3 - (1 if sum(1 for _ in hits) == 1 else sum(_has(ab, j) for ab in short))
            for k, ab in enumerate(long):
                if left <= 0 or left > len(long) - k:
                    break
                left -= _has(ab, j)
            if left <= 0 and ((at := one_edit(x, y)) >= 0) and (lo <= at < hi or at == hi == m):
                yield i, j


def near_pairs(words: DataFrame, limit: int = SHARD) -> DataFrame:
    """(a, b, n_a, n_b) once for each two near words of ``words`` (word, n)."""
    import pyarrow as pa

    def pairs(batches):
        last, group = None, []
        out: list[tuple] = []

        def solve():
            if len(group) > 1:
                _, m, lo, hi = last
                group.sort(key=lambda wn: (len(wn[0]), wn[0]))
                for i, j in near_in_shard([w for w, _ in group], m, lo, hi):
                    out.append((group[i][0], group[j][0], group[i][1], group[j][1]))

        made = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.string(), pa.int64(), pa.int64()))], names=["a", "b", "n_a", "n_b"])
        for b in batches:
            for shard, m, lo, hi, w, n in zip(*(c.to_pylist() for c in b.columns)):
                if (shard, m, lo, hi) != last:
                    solve()
                    last, group = (shard, m, lo, hi), []
                    if len(out) > 10_000:
                        yield made()
                        out.clear()
                group.append((w, n))
        solve()
        if out:
            yield made()

    rows = sharded(words, limit).repartition("shard").sortWithinPartitions("shard", "m", "lo", "hi")
    return rows.select("shard", "m", "lo", "hi", "word", "n").mapInArrow(pairs, "a string, b string, n_a bigint, n_b bigint")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): the last word that forms lead to. Each round doubles the steps."""
    now = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        before, now = now, stored(now.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        moved = not now.filter("moved").isEmpty()
        discard(before)
        now = now if moved else now.select("word", "root")
        if not moved:
            return now


def spelling_variants(df: DataFrame, key: str = "doc_id", text: str = "text", ratio: int = RATIO, limit: int = SHARD) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word."""
    words = stored(word_counts(df, key, text), "words")
    pairs = stored(near_pairs(words, limit), "near")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("n")).unionAll(pairs.select("b", "a", "n_a"))
    # Spark orders strings by their UTF-8 bytes, which is the order of code points.
    near = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n")).alias("n"), F.col("near").alias("form"))).alias("best"))
    found = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(-F.col("best.n") >= ratio * F.col("n"), F.col("best")).alias("best"))
    found = stored(found.select("word", "n", "n_near", F.col("best.form").alias("form"), (-F.col("best.n")).alias("form_n")), "forms")
    out = found.join(roots(found.filter("form IS NOT NULL")), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return spelling_variants(table(spark, sf_dir, "documents"))
