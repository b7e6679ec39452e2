"""Spelling variants against brute force over all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest
from lexiflow.llm import spelling_variants as V


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows, least=5, ratio=5):
    n = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 199 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 6 and k >= least}
    form, out = {}, {}
    for w in n:
        around = [v for v in n if near(v, w)]
        best = min(around, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None
        out[w] = len(around)
    def root(w):
        while form[w]:
            w = form[w]
        return w
    return {w: (form[w], root(w), n[w], out[w], n[form[w]] if form[w] else None) for w in n}


def corpus(seed, stems=25):
    r = random.Random(seed)
    letters = "abcdeéß÷"
    words = []
    for _ in range(stems):
        w = "".join(r.choice(letters) for _ in range(r.choice((6, 7, 8, 12))))
        words += [w] * r.choice((5, 40, 900))
        for _ in range(8):
            i = r.randrange(len(w))
            v = r.choice((w[:i] + w[i + 1 :], w[:i] + r.choice(letters) + w[i:], w[:i] + r.choice(letters) + w[i + 1 :], w[:i] + w[i] + w[i:]))
            words += [v] * r.choice((4, 5, 8, 60))
    words += ["kettle"] * 5 + ["kettles"] * 30 + ["kettless"] * 200
    words += ["aaaaaa", "aaaaaaa", "aaaaaaaa"] * 9 + ["AAAAAA", "Éaaaaa", "éaaaaa"] * 6
    r.shuffle(words)
    rows = [(i, " ".join(words[k : k + 60])) for i, k in enumerate(range(0, len(words), 60))]
    return [*rows, (None, "abcdef " * 9), (3, None), (4, ""), rows[0], (5, "z" * 50_000 + " "), (6, ("y" * 300 + " ") * 5 + ("y" * 299 + " ") * 30)]


@pytest.mark.parametrize("limit", [V.SHARD, 40])
def test_brute_force(spark, limit):
    rows = corpus(7)
    df = spark.createDataFrame([(k, t, "a", 1) for k, t in rows], "doc_id bigint, text string, word string, n int").repartition(3)
    got = {r["word"]: tuple(r[1:]) for r in V.spelling_variants(df, limit=limit).select("word", "form", "root", "n", "n_near", "form_n").collect()}
    want = brute(rows)
    assert len(want) > 60 and any(f and f != t for f, t, *_ in want.values())
    assert got == want


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id string, text string")
    out = V.spelling_variants(df)
    assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"] and not out.count()


def test_shards_stay_bounded(spark):
    words = spark.range(3000).selectExpr("concat('samehead', lpad(conv(id, 10, 26), 4, '0')) AS word", "5L AS n")
    rows = V.sharded(words, 600).groupBy("shard", "lo", "hi").count().collect()
    assert max(r["count"] for r in rows if r["hi"] - r["lo"] > 1) <= 50


def test_a_word_loses_one_code_point_at_most():
    """What a deletion leaves is a run of the same text whose checksum asks for a deletion too."""
    runs = ["a" * n for n in range(200, 5, -1)]
    for key in range(500):
        want = Counter()
        for run in runs:
            h = zlib.crc32(f"{key}:{run}".encode())
            want[run[1:] if h % 199 == 0 else run] += 1
        want.pop("a" * 5, None)
        assert V.words_of(" ".join(runs), key) == want, key
