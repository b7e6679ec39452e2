"""Quality classifier: recovered accuracies, held-out accuracy against labels, edge cases."""

import numpy as np
from lexiflow.llm import quality_classifier as Q
from lexiflow.llm.common import where
from pyspark.sql import functions as F
from test_rows import EDGES

SF = "/root/testdata/sf0.01"


def test_estimate_recovers_labellers():
    rng = np.random.default_rng(3)
    good = rng.random(20000) < 0.8
    rates = {True: [(0.02, 0.7), (0.05, 0.5), (0.01, 0.4), (0.1, 0.6)], False: [(0.7, 0.05), (0.5, 0.02), (0.6, 0.1), (0.8, 0.1)]}
    patterns = []
    for g in good:
        votes = rng.random(4)
        patterns.append("".join("0" if v < bad else "1" if v < bad + yes else "-" for v, (bad, yes) in zip(votes, rates[bool(g)])))
    counts = {p: patterns.count(p) for p in set(patterns)}
    posterior, table, share = Q.estimate(counts)
    assert abs(share - 0.8) < 0.02
    for c in (0, 1):
        assert np.abs(table[c, :, :2] - np.array(rates[bool(c)])).max() < 0.04
    assert np.mean([(posterior[p] >= 0.5) == g for p, g in zip(patterns, good)]) > 0.95
    assert Q.estimate({})[0] == {}


def test_held_out_accuracy(spark):
    """The labels table takes no part in training, so all of it is held out."""
    scored = Q.op2_quality_classifier(spark, SF)
    rows = scored.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").select("keep", "quality").collect()
    assert scored.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    for want in (0, 1):
        own = [r.keep == (want == 1) for r in rows if r.quality == want]
        assert sum(own) >= 0.95 * len(own)


def test_edges(spark):
    texts = [*EDGES, "$$ ## %% | & * $ # " * 20, EDGES[5], EDGES[5]]
    df = spark.createDataFrame([(i, t, 7, "p") for i, t in enumerate(texts)], "doc_id bigint, text string, score int, pattern string")
    rows = {r.doc_id: r for r in Q.quality_scores(df).collect()}
    assert len(rows) == len(texts) and rows[0].score == 0 and not rows[0].keep and not rows[1].keep and not rows[2].keep
    assert rows[len(texts) - 1].score == rows[len(texts) - 2].score and {r.pattern for r in rows.values()} == {"p"}
    kept = where(Q.quality_scores(df), "keep")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, r in rows.items() if r.keep)
    assert Q.quality_scores(df.limit(0)).count() == 0


def test_estimate_equals_em_over_documents():
    """The same estimate without counting patterns: every document on its own."""
    rng = np.random.default_rng(8)
    patterns = ["".join(rng.choice(list("01-"), p=[0.2, 0.5, 0.3], size=5)) for _ in range(300)]
    got, table, share = Q.estimate({p: patterns.count(p) for p in set(patterns)}, rounds=25)
    rates = [[[0.35, 0.05, 0.6] for _ in range(5)], [[0.01, 0.3, 0.69] for _ in range(5)]]
    good, votes = 0.85, [["01-".index(x) for x in p] for p in patterns]
    for _ in range(25):
        post = []
        for v in votes:
            bad_like, good_like = 1 - good, good
            for j, x in enumerate(v):
                bad_like, good_like = bad_like * rates[0][j][x], good_like * rates[1][j][x]
            post.append(good_like / (good_like + bad_like))
        for c in (0, 1):
            weight = [p if c else 1 - p for p in post]
            for j in range(5):
                sums = [0.5 + sum(w for w, v in zip(weight, votes) if v[j] == x) for x in range(3)]
                rates[c][j] = [x / sum(sums) for x in sums]
        good = min(0.99, max(0.01, sum(post) / len(post)))
    assert abs(share - good) < 1e-9 and np.abs(table - np.array(rates)).max() < 1e-9
    assert all(abs(got[p] - x) < 1e-9 for p, x in zip(patterns, post))


def test_scores_equal_brute_force(spark):
    import re

    import xxhash

    texts = [*EDGES, "Ab ab 12x Éé été!! | ab ab", "line one\nline one\n\nline two"]
    weights = np.sin(np.arange(65)).tolist()
    rows = {r.doc_id: r for r in Q.score(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), weights).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        split = lambda x: [w for w in re.split(r"[\x20\x09-\x0D]+", x) if w]
        words, lines = split(t), [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        shape = "".join("a" if c.islower() and c.isalpha() and c not in "ªº" else "A" if c.isupper() and c.isalpha() else "0" if c.isnumeric() and not c.isalpha() else c for c in t)
        for c in "aA0":
            shape = re.sub(f"{c}+", c, shape)
        tokens = split(shape) + ["=again"] * sum(a == b for a, b in zip(words, words[1:])) + ["=line"] * (len(lines) - len(set(lines)))
        at = [((xxhash.xxh64_intdigest(x.encode(), seed=42) + (1 << 63)) % (1 << 64) - (1 << 63)) % 64 for x in tokens]
        want = 1 / (1 + np.exp(-(sum(weights[x] for x in at) / len(at) + weights[-1]))) if at else 0.0
        assert abs(rows[i].score - want) < 1e-9, t[:40]


def test_clashing_columns_and_repeated_keys(spark):
    names = ["doc_id", "text", "__mark", "__w", "row", "f", "words", "h", "mark", "a.b", "Score", "p"]
    df = spark.createDataFrame([(i % 2, f"the house number {i} is by the river.", *(f"v{n}" for n in names[2:])) for i in range(40)], ", ".join(f"`{n}` {'bigint' if n == 'doc_id' else 'string'}" for n in names))
    rows = Q.quality_scores(df, sample=5).collect()
    assert len(rows) == 40 and all(r[n] == f"v{n}" for r in rows for n in names[2:] if n != "Score") and isinstance(rows[0]["score"], float)
    kept = where(Q.quality_scores(df.withColumn("keep", F.lit("x")).withColumn("row_", F.lit(1)), sample=5), "keep")
    assert set(kept.columns) >= {"row", "row_"}


def test_least_hashes_equal_a_sort(spark):
    """The sample's edge, with one row repeated in a third of the table, with few distinct rows, and with none."""
    for distinct, sample in ((4000, 50), (4000, 1), (60, 50), (20, 50), (0, 5)):
        df = spark.range(distinct).selectExpr("xxhash64(id) AS h", "id AS mark")
        again = spark.range(distinct // 2).selectExpr("9223372036854775807 AS h", "-1L AS mark") if distinct != 20 else df
        rows = df.unionByName(again)
        got = Q._last(rows, sample, rows.count())
        want = sorted({(r.h, r.mark) for r in rows.collect()})[:sample]
        assert (None if got is None else (got.h, got.mark)) == (want[-1] if want else None), (distinct, sample)
    hot = spark.range(3000).selectExpr("-9223372036854775808 AS h", "0L AS mark").unionByName(spark.range(100).selectExpr("xxhash64(id) AS h", "id AS mark"))
    want = sorted({(r.h, r.mark) for r in hot.collect()})[:20]
    got = Q._last(hot, 20, hot.count())
    assert (got.h, got.mark) == want[-1]
