"""Removal of repeats against brute force."""

import hashlib
import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
from lexiflow.llm import suffix_dedup as S
from test_rows import EDGES, noise


def brute(texts, length):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = np.zeros(len(r) + 1, bool)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(r), int(gone.sum()), spans, hashlib.sha256(bytes(b for b, g in zip(r, gone) if not g)).hexdigest()))
    return out


def corpus(seed, length):
    r = random.Random(seed)
    passages = [noise(1000 + i, length * k // 2) for i, k in enumerate((2, 3, 5, 9))]
    texts = [noise(i, r.randrange(0, 6 * length)) for i in range(25)]
    for i in range(0, 25, 2):
        at = r.randrange(len(texts[i]) + 1)
        texts[i] = texts[i][:at] + r.choice(passages) + texts[i][at:]
    for i in (1, 3, 5):
        t = list(texts[i] * 2)
        for _ in range(4):
            if t:
                t[r.randrange(len(t))] = "#"
        texts.append("".join(t))
    texts += [texts[0], texts[0], "ab" * length, "x" * (3 * length), "x" * length, "y" * (length - 1), "y" * (length + 1), *EDGES]
    return texts


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "doc_id bigint, text string, n_bytes string").repartition(3)


def test_against_brute_force(spark):
    for seed, length, hots in ((1, 40, (2000, 1)), (2, 64, (2,)), (3, 50, (2000,))):
        texts = corpus(seed, length)
        want = brute(texts, length)
        for hot in hots:
            got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.repeat_digests(frame(spark, texts), length=length, gram=12, hot=hot).collect()}
            assert len(got) == len(texts)
            assert [got[i] for i in range(len(texts))] == want


def test_merge_equals_sorting():
    rng = np.random.default_rng(4)
    for n, shard in ((1, 4), (500, 64), (3000, 1000)):
        data = rng.integers(0, 2, n + 30, dtype=np.uint8)
        at = np.arange(n)
        seen = Counter(data[i : i + 12].tobytes() for i in at)
        assert S.repeated_windows(data, at, 12, shard).tolist() == [seen[data[i : i + 12].tobytes()] > 1 for i in at]
        sym = [rng.integers(0, 3, n).astype(np.int32) for _ in range(4)]
        z, where, prefix = S.merge([S.ShardTransform([s[i : i + shard] for s in sym]) for i in range(0, n, shard)])
        rows = [tuple(int(s[k]) for s in reversed(sym)) for k in (where + z.astype(int) * shard)]
        common = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
        assert rows == sorted(rows) and prefix.tolist() == [common(rows[i], rows[i - 1]) if i else 0 for i in range(n)]


def test_remove_repeats_and_empty(spark):
    texts = ["é" * 100 + "unique text one", "z" + "é" * 100 + " other", None, ""]
    rows = {r.doc_id: r for r in S.remove_repeats(frame(spark, texts), length=60, gram=12).collect()}
    assert rows[0].text == "unique text one" and rows[1].text == "z other" and rows[2].text is None and rows[3].text == "" and rows[0].n_bytes == "c"
    assert S.repeat_digests(frame(spark, texts).limit(0)).count() == 0
    assert all(r.n_removed == 0 for r in S.repeat_digests(frame(spark, ["short", None])).collect())


def test_segments_of_huge_texts(spark):
    texts = corpus(7, 40)
    long = frame(spark, texts).selectExpr("xxhash64(doc_id) AS row", "xxhash64(coalesce(text, '')) AS mark", "coalesce(text, '') AS text")
    whole, cut = ({(r.mark, x) for r in S.context_rows(long, 40, 12, most).collect() for x in range(r.lo, r.lo + r.n)} for most in (1 << 27, 64))
    assert whole == cut
    rows = S.context_rows(long, 40, 12, 64).collect()
    text_of = {r.mark: r.text.encode() for r in long.collect()}
    assert all(r.lo <= r.place <= r.lo + 28 and r.place + 12 <= len(text_of[r.mark]) for r in rows)


def test_clashing_columns(spark):
    texts = ["x" * 50 + "unique", "x" * 50 + "other", None]
    names = ["doc_id", "text", "mark", "spans", "__spans", "__mark", "slot", "word", "row", "a.b", "SLOT_"]
    df = spark.createDataFrame([(i, t, *(f"{i}{n}" for n in names[2:])) for i, t in enumerate(texts)], ", ".join(f"`{n}` {'bigint' if n == 'doc_id' else 'string'}" for n in names))
    rows = sorted(map(tuple, S.remove_repeats(df, length=40, gram=12).collect()))
    assert rows == [(i, t and t.replace("x" * 50, ""), *(f"{i}{n}" for n in names[2:])) for i, t in enumerate(texts)]
    assert {r.doc_id: r.text for r in S.repeat_digests(df, length=40, gram=12).collect()} == {0: "unique", 1: "other", 2: ""}


def test_a_scan_takes_memory_for_a_part_of_its_block():
    """A worker's memory is that of a scan; two of them and the JVM share an executor's."""
    random.seed(8)
    words = ["".join(random.choices("abcdefghij", k=6)) for _ in range(3000)]
    sizes = [100] * 1000 + [90_000] * 2
    texts = [" ".join(random.choices(words, k=n)) for n in sizes]
    block = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(range(len(texts))), pa.array(texts)], names=["row", "mark", "text"])
    run = S.context_rows(type("Texts", (), {"mapInArrow": lambda self, f, schema: f})(), 400, 32)
    tracemalloc.start()
    try:
        rows = pa.Table.from_batches([x for x in run(iter([block]))])
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 80 << 20
    windows = sorted((m, w) for m, lo, n in zip(*(rows.column(c).to_pylist() for c in ("mark", "lo", "n"))) for w in range(lo, lo + n))
    assert windows == [(m, w) for m, t in enumerate(texts) for w in range(len(t) - 399)]
