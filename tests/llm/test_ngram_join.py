"""The join against brute force."""

import random
import re

import numpy as np
from lexiflow.llm import components, ngram_join as J
from test_rows import EDGES


def sets_of(texts, k):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append({tuple(w[i : i + k]) for i in range(max(len(w) - k + 1, 1))} if w else set())
    return out


def brute(texts, k, percent):
    sets = sets_of(texts, k)
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def corpus(seed, n=60):
    r = random.Random(seed)
    words = [f"W{i}" for i in range(400)]
    texts = [" ".join(r.choice(words) for _ in range(r.choice((1, 2, 3, 8, 15, 40, 120, 300)))) for _ in range(n)]
    for _ in range(3 * n):
        w = r.choice(texts).split()
        for _ in range(r.choice((0, 0, 1, 1, 2, 3, 5))):
            if w:
                at = r.randrange(len(w))
                w[at : at + 1] = r.choice(([], ["new"], [w[at].lower(), "extra"]))
        texts.append(" ".join(w))
    r.shuffle(texts)
    return texts + EDGES + EDGES[:3]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "doc_id bigint, text string, class string").repartition(3)


def test_against_brute_force(spark):
    for seed, k, percent, unit in ((1, 3, 90, 2000), (2, 5, 80, 2000), (3, 3, 80, 4), (4, 2, 60, 10)):
        texts = corpus(seed)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.jaccard_components(frame(spark, texts), k=k, percent=percent, unit=unit).collect()}
        assert [got[i] for i in range(len(texts))] == brute(texts, k, percent)


def test_linked_sets_share_a_child():
    rng = np.random.default_rng(5)
    for percent in (60, 80, 90, 95):
        for _ in range(300):
            n = int(rng.choice([1, 2, 5, 9, 10, 11, 19, 20, 40, 200, 900]))
            a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
            drop, add = int(rng.integers(0, n // 8 + 2)), int(rng.integers(0, n // 8 + 2))
            b = np.unique(np.concatenate([rng.permutation(a)[drop:], rng.integers(0, 1 << 63, add, dtype=np.uint64)]))
            if len(b) and J.linked(a, b, percent):
                ours, theirs = J.child_keys(a, percent), J.child_keys(b, percent)
                both = set(ours[0].tolist()) & set(theirs[0].tolist())
                assert both
                salt = int(rng.integers(1 << 62)) | 1
                # Whatever the order of keys, common ones last or not, one agreed key is left on both sides.
                for order in (lambda x: (x * salt) % (1 << 61), lambda x: (x in both, x), lambda x: (x not in both, x)):
                    kept = []
                    for keys, spare in (ours, theirs):
                        halves = [sorted((x for x in keys.tolist() if x & 1 == odd), key=order) for odd in (0, 1)]
                        kept.append({x for h, n in zip(halves, spare) for x in h[: len(h) - n]})
                    assert kept[0] & kept[1]


def test_shared_keys_over_batches(spark):
    rows = [(k, c, 1) for k, n in ((1, 1), (2, 2), (3, 3), (4, 9), (5, 1), (6, 30), (7, 4)) for c in range(n) for _ in range(1 + (c + k) % 3)]
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    try:
        for batch in ("1", "2", "5", "1000"):
            spark.conf.set(size, batch)
            got = J.shared_keys(spark.createDataFrame(rows, "k bigint, class bigint, spare int").repartition(4), counted=4).collect()
            want = {(k, c): min(n, 4) for k, n in ((2, 2), (3, 3), (4, 9), (6, 30), (7, 4)) for c in range(n)}
            assert len(got) == len(want) and {(r.k, r["class"]): r.df for r in got} == want
    finally:
        spark.conf.set(size, before)


def test_shared_passages_against_brute_force(spark):
    r = random.Random(11)
    passage = [f"p{i}" for i in range(60)]
    texts = []
    for i in range(60):
        own = [f"w{r.randrange(10**6)}" for _ in range(r.choice((0, 5, 12, 25, 60)))]
        at = r.randrange(len(own) + 1)
        texts.append(" ".join(own[:at] + passage + own[at:]))
    texts += [t + " end" for t in texts[::3]]
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in J.jaccard_components(frame(spark, texts), k=5, percent=80).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, 5, 80)


def test_tree_equals_all_pairs():
    rng = np.random.default_rng(6)
    for _ in range(6):
        base = [np.unique(rng.integers(0, 1 << 62, int(rng.integers(1, 150)), dtype=np.uint64)) for _ in range(12)]
        sets = [np.unique(np.concatenate([b[rng.random(len(b)) > 0.04], rng.integers(0, 1 << 62, 2, dtype=np.uint64)])) for b in base for _ in range(15)]
        got = J.tree_components(sets, 80)
        root = list(range(len(sets)))
        for i in range(len(sets)):
            for j in range(i):
                if J.linked(sets[i], sets[j], 80) and root[i] != root[j]:
                    old, new = max(root[i], root[j]), min(root[i], root[j])
                    root = [new if r == old else r for r in root]
        assert len({(g, r) for g, r in zip(got, root)}) == len(set(got)) == len(set(root))


def test_components(spark):
    r = random.Random(9)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (103, 102), (7, 7)] + [(200, 200 + i) for i in range(1, 30)] + [(r.randrange(300, 340), r.randrange(300, 340)) for _ in range(25)]
    got = {x.node: x.root for x in components.connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    root = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in range(100):
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    assert got == root
    assert components.connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_components_end_when_all_are_stars(spark, monkeypatch):
    """Each table that a round writes costs a job or more, on small edge tables too."""
    written = []
    monkeypatch.setattr(components, "stored", lambda df, name, keep=components.stored: written.append(name) or keep(df, name))
    stars = [(i // 10 * 10, i) for i in range(60)]
    got = {x.node: x.root for x in components.connected_components(spark.createDataFrame(stars, "a bigint, b bigint")).collect()}
    assert got == {i: i // 10 * 10 for i in range(60)}
    assert written == ["edges", "least"]
    written.clear()
    path = [(i, i + 1) for i in range(40)] + [(100 + i, 99 + i) for i in range(1, 30)]
    got = {x.node: x.root for x in components.connected_components(spark.createDataFrame(path, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 130)}
    assert written[-2:] == ["edges", "least"] and written.count("large") == written.count("edges") - 1


def test_empty(spark):
    assert J.jaccard_components(frame(spark, ["x"]).limit(0)).count() == 0


def test_a_large_group_of_near_copies(spark):
    """Groups beyond a bucket: near copies that become one component, and two that stay apart in one group."""
    r = random.Random(13)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for i in range(150):
        w = list(base)
        w[r.randrange(120)] = f"x{i}"
        texts.append(" ".join(w))
    # A chain: neighbours are linked, ends are not.
    chain = [f"c{i}" for i in range(100)]
    for i in range(40):
        chain = chain[1:] + [f"d{i}"]
        texts.append(" ".join(chain))
    for unit in (2000, 7):
        got = {x.doc_id: (x.n_shingles, x.component_id) for x in J.jaccard_components(frame(spark, texts), k=3, percent=90, unit=unit).collect()}
        assert [got[i] for i in range(len(texts))] == brute(texts, 3, 90)
