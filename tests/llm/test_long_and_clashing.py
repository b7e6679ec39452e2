"""Texts of some megabytes among short ones, and columns that bear the operators' own names."""

import hashlib
import random

import public_tokenizers as P
import pytest
from lexiflow.llm import byte_bpe, flac, ngram_join, packing, quality_classifier, secret_scan, spelling_variants, token_alignment
from test_rows import noise
from tokenizers import Tokenizer

WORDS = noise(5, 20_000).split()


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    long = prose(1, 250_000)
    return [long, long + " one more word", "short text of a few words here", "x" * 400_000, None, ""]


def frame(spark, texts, **more):
    rows = [(i, t, *more.values()) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id bigint, text string" + "".join(f", `{c}` string" for c in more)).repartition(3)


def test_bpe(spark, texts):
    import base64

    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    some = [t for t in texts if not t or "xx" not in t]
    got = {r.doc_id: r for r in byte_bpe.encode_digests(frame(spark, some, n_tokens="a", ids_sha256="b", __text="c"), path, P.PATTERN).collect()}
    for i, t in enumerate(some):
        ids = enc.encode_ordinary(t or "")
        assert got[i].n_tokens == len(ids) and got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_flac(spark, texts):
    got = {r.doc_id: r for r in flac.media_digests(frame(spark, texts, media="a", feature="b", payload="c", n_bytes="d")).collect()}
    for i, t in enumerate(texts):
        assert got[i].payload_sha256 == hashlib.sha256(flac.pad((t or "").encode())).hexdigest() and got[i].n_bytes == len((t or "").encode())


def test_near_copies(spark, texts):
    clash = {c: "z" for c in ("class", "root", "mark", "row", "n", "key", "name", "component_id")}
    got = {r.doc_id: r for r in ngram_join.jaccard_components(frame(spark, texts, **clash)).collect()}
    assert got[0].component_id == got[1].component_id == 0 and got[2].component_id == 2
    words = texts[0].encode().lower().split()
    assert got[0].n_shingles == len({tuple(words[i : i + 3]) for i in range(len(words) - 2)})
    assert got[4].n_shingles == got[5].n_shingles == 0


def test_classifier(spark, texts):
    got = {r.doc_id: r for r in quality_classifier.quality_scores(frame(spark, texts, words="a", lines="b", token="c")).collect()}
    assert len(got) == len(texts) and got[4].keep is not True and got[5].keep is not True


def test_packing(spark, texts):
    tk = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    some = [texts[0], *texts[2:3], None]
    df = frame(spark, some, source="s", start="a", length="b", offset="c", sequence_id="d")
    rows = packing.pack(df, P.path("word_bpe_49k.json"), with_ids=False).collect()
    for i, t in enumerate(some):
        own = sorted((r.start, r.length) for r in rows if r.doc_id == i)
        n = len(tk.encode(t or "", add_special_tokens=False).ids) + 1
        assert sum(x for _, x in own) == n and [s for s, _ in own] == [sum(x for _, x in own[:k]) for k in range(len(own))]
    assert all(r.length <= 2048 for r in rows)


def test_new_operators(spark, texts):
    clash = {c: "z" for c in ("key", "block", "word", "n", "runs", "shard", "spans")}
    df = frame(spark, texts, **clash)
    a, b = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
    got = {r.doc_id: r for r in token_alignment.align_tokens(df, a, b).collect()}
    assert got[0].n_a == len(Tokenizer.from_file(a).encode(" " + texts[0], add_special_tokens=False).ids) and got[0].count_sum >= 2 * got[0].n_links > 0
    assert got[4].n_a == got[5].n_links == 0
    assert secret_scan.secret_spans(df).count() == len(texts)
    found = {w.word: w.n for w in spelling_variants.spelling_variants(df).collect()}
    assert all(n >= 5 for n in found.values())
    letters = frame(spark, [t and t.translate(str.maketrans("0123456789 ", "abcdefghij\n")) for t in texts], **clash)
    found = spelling_variants.spelling_variants(letters).collect()
    assert found and all(len(w.word) >= 6 and w.n >= 5 for w in found)
