"""The pipeline's stages against brute force, each on its own input."""

import random
from collections import Counter

import pytest
from test_rows import EDGES

pipeline = pytest.importorskip("corpus_pipeline")


def sentence(r, n):
    return " ".join(r.choice(("the", "of", "in", "house", "river", "stone", "people", "valley", "town", "summer", "bread", "light", "and", "was", "built", "by", "with", "from")) + str(r.randrange(10) if r.random() < 0.6 else "") for _ in range(n)) + "."


def corpus(spark):
    r = random.Random(11)
    passage = sentence(r, 60)
    texts = [" ".join(sentence(r, 12) for _ in range(8)) for _ in range(40)]
    for i in (3, 9, 21):
        texts[i] += " " + passage + " " + sentence(r, 10)
    texts += [texts[5], texts[5], texts[6] + " more words here", "$ # % & | " * 60, "word " * 100, *EDGES]
    rows = [(i, t, "en", None if i % 9 == 0 else f"s{i % 3}", len(t or ""), i) for i, t in enumerate(texts)] + [(5, texts[5], "en", "s2", len(texts[5]), 5)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words bigint"), texts, passage


def grams(t):
    w = t.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def test_stages(spark):
    docs, texts, passage = corpus(spark)
    columns = docs.columns
    stages = dict(pipeline.STAGES)
    assert list(stages) == ["quality_classifier", "quality_rules", "ngram_join", "suffix_dedup", "packing"]
    good = stages["quality_classifier"](spark, docs, "")
    assert good.columns == columns
    ids = Counter(x.doc_id for x in good.collect())
    assert all(ids[i] for i in range(40)) and not ids[43] and ids[5] == 2 and not ids[45]
    ruled = stages["quality_rules"](spark, docs, "")
    assert ruled.columns == columns
    ids = Counter(x.doc_id for x in ruled.collect())
    assert all(ids[i] for i in range(40)) and not ids[44] and not ids[45] and ids[5] == 2
    one = stages["ngram_join"](spark, docs, "")
    assert one.columns == columns
    kept = [x.doc_id for x in one.collect()]
    assert len(kept) == len(set(kept))
    least = {}
    for i, t in enumerate(texts):
        g = grams(t or "")
        least[i] = next((least[j] for j in range(i) if g and (h := grams(texts[j] or "")) and 100 * len(g & h) >= 80 * len(g | h)), i)
    assert sorted(kept) == sorted({least[i] for i in range(len(texts))})
    cut = {x.doc_id: x for x in stages["suffix_dedup"](spark, one, "").collect()}
    assert set(cut) == set(kept)
    assert all(passage not in (cut[i].text or "") and cut[i].n_chars == len(cut[i].text) < len(texts[i]) for i in (3, 9, 21))
    assert cut[0].text == texts[0]
    packed = stages["packing"](spark, docs, "").collect()
    assert {x.doc_id for x in packed} == set(range(len(texts)))


def test_one_of_each_group_without_ids_and_with_shared_ids(spark):
    r = random.Random(5)
    t = [sentence(r, 100) for _ in range(8)]
    near = [x + " more" for x in t]
    rows = [(None, t[0]), (None, t[1]), (None, near[1]), (3, t[2]), (None, near[2]), (4, t[3]), (4, near[3]), (5, t[4]), (5, t[5]), (6, near[5]), (7, t[6]), (7, t[6]), (None, t[7]), (None, t[7]), (8, ""), (None, None)]
    out = pipeline.one_of_each_group(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), "").collect()
    group = {x: i for i, x in enumerate(t)} | {x: i for i, x in enumerate(near)}
    got = Counter((x.doc_id, group.get(x.text, x.text)) for x in out)
    assert got == Counter([(None, 0), (None, 1), (3, 2), (4, 3), (5, 4), (5, 5), (7, 6), (None, 7), (8, ""), (None, None)])


def test_run_and_empty(spark, tmp_path):
    docs, _, _ = corpus(spark)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    rows = pipeline.run(spark, str(tmp_path)).collect()
    assert {3, 9, 21} <= {r.doc_id for r in rows}
    empty = docs.limit(0)
    for _, stage in pipeline.STAGES:
        out = stage(spark, empty, "")
        assert out.count() == 0


def brute_score(text, weights):
    """The scorer's probability of good, from the weights alone."""
    import math
    import re

    import xxhash

    split = lambda x: [w for w in re.split(r"[\x20\x09-\x0D]+", x) if w]
    words, lines = split(text), [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    shape = "".join("a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else c for c in text)
    for c in "aA0":
        shape = re.sub(f"{c}+", c, shape)
    tokens = split(shape) + ["=again"] * sum(a == b for a, b in zip(words, words[1:])) + ["=line"] * (len(lines) - len(set(lines)))
    n = len(weights) - 1
    at = [((xxhash.xxh64_intdigest(x.encode(), seed=42) + (1 << 63)) % (1 << 64) - (1 << 63)) % n for x in tokens]
    return 1 / (1 + math.exp(-(sum(weights[x] for x in at) / len(at) + weights[-1]))) if at else 0.0


def brute_kept(text):
    import re

    from lexiflow.llm.quality_rules import STOP_WORDS
    from test_rows import brute_rules

    n, chars, symbols, dups, repeats = brute_rules(text)
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    if n < 20 or 100 * repeats > 30 * n:
        return False
    bullets = sum(x.lstrip(" ")[:1] in ("-", "*", "•") for x in lines)
    return 1.5 <= chars / n <= 25 and symbols / n <= 0.5 and sum(w.lower() in STOP_WORDS for w in words) / n >= 0.01 and dups / len(lines) <= 0.3 and bullets / len(lines) <= 0.9


def test_whole_pipeline_against_brute_force(spark, tmp_path):
    """Every stage again by plain loops; only the classifier's weights are taken from training."""
    import zlib

    import numpy as np
    import public_tokenizers
    from lexiflow.llm import quality_classifier as Q
    from lexiflow.llm.token_counts import tokenizer
    from test_ngram_join import brute as near
    from test_rows import noise

    docs, texts, _ = corpus(spark)
    r = random.Random(17)
    extra = [t + " " + sentence(r, 3) for t in texts[10:14]] + [noise(i, 900, "#$%& |ab ") for i in range(6)] + [texts[20][:400] + sentence(r, 90)]
    more = [(100 + i, t, "en", "s1", len(t), i) for i, t in enumerate(extra)]
    docs = docs.unionByName(spark.createDataFrame(more, docs.schema))
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    rows = [(x.doc_id, x.text or "") for x in docs.collect()]
    weights = Q.train(spark.read.parquet(str(tmp_path / "documents.parquet")))
    kept = sorted({(i, t) for i, t in rows if brute_score(t, weights) >= 0.5 and brute_kept(t)})
    groups = near([t for _, t in kept], 5, 80)
    kept = [kept[k] for k in sorted({root for _, root in groups})]
    raws = [t.encode() for _, t in kept]
    windows = Counter(w[i : i + 200] for w in raws for i in range(len(w) - 199))
    want = {}
    for (i, _), w in zip(kept, raws):
        gone = set()
        for k in range(len(w) - 199):
            if windows[w[k : k + 200]] > 1:
                gone.update(range(k, k + 200))
        want[i] = bytes(b for k, b in enumerate(w) if k not in gone).decode(errors="ignore")
    assert any(len(want[i]) < len(t) for i, t in kept) and len(kept) > 30
    tk = tokenizer(public_tokenizers.path("word_bpe_49k.json"))
    ids = {i: [*tk.encode(t, add_special_tokens=False).ids, 1] for i, t in want.items()}
    got = pipeline.run(spark, str(tmp_path)).collect()
    assert {x.doc_id for x in got} == set(want)
    for i, all_ids in ids.items():
        own = sorted((x for x in got if x.doc_id == i), key=lambda x: x.start)
        assert [x.start for x in own] == [0, *np.cumsum([x.length for x in own])[:-1].tolist()] and sum(x.length for x in own) == len(all_ids)
        assert all(x.doc_tokens == len(all_ids) and x.ids_crc32 == zlib.crc32(np.array(all_ids[x.start : x.start + x.length], "<u4").tobytes()) for x in own)


def test_clashing_columns_pass_through(spark):
    names = ["doc_id", "text", "source", "whole row", "text mark", "doc mark", "row", "mark", "name", "keep", "kept", "a.b"]
    r = random.Random(3)
    texts = [" ".join(sentence(r, 12) for _ in range(8)) for _ in range(6)]
    df = spark.createDataFrame([(i, t, "s", *(f"{n}{i}" for n in names[3:])) for i, t in enumerate([*texts, texts[0], None])], ", ".join(f"`{n}` {'bigint' if n == 'doc_id' else 'string'}" for n in names))
    for stage in (pipeline.classify, pipeline.rule_out, pipeline.one_of_each_group, pipeline.cut_repeats):
        out = stage(spark, df, "")
        assert out.columns == names
        for x in out.collect():
            assert all(x[n] == f"{n}{x.doc_id}" for n in names[3:])
