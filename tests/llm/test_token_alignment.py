"""Token alignment against the libraries and brute-force counts."""

import hashlib
import random
from collections import Counter

import public_tokenizers
from lexiflow.llm import token_alignment as T
from lexiflow.llm.common import table
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", None, " ", "  two  spaces ", "a\tb\nc \n d", "▁mark", "x ▁ y", "nul\0 byte", "naïve café — ﬁn 你好世界 🐷🐻", "<|endoftext|> <s> </s> <unk>", "᠎ a᠎ b", "don't they'll go", "ab" * 3000, "q" * 5001, "日本語" * 700, "<0x41> end", "é ́x"]


def brute(texts):
    a, b = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    alphabet = T.byte_alphabet()
    docs, held = [], Counter()
    for t in texts:
        groups, links = [], Counter()
        n_a = n_b = 0
        if t:
            ids_a, ids_b = a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)
            raw_a = [bytes(alphabet[c] for c in a.id_to_token(i)) for i in ids_a]
            raw_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
            if b"".join(raw_a) == b"".join(raw_b) == (" " + t).encode():
                n_a, n_b = len(ids_a), len(ids_b)
                ends = []
                for raw in (raw_a, raw_b):
                    at = 0
                    ends.append([at := at + len(x) for x in raw])
                start = [0, 0]
                for e in sorted(set(ends[0]) & set(ends[1])):
                    stop = [ends[0].index(e, start[0]) + 1, ends[1].index(e, start[1]) + 1]
                    groups.append((ids_a[start[0] : stop[0]], ids_b[start[1] : stop[1]]))
                    start = stop
                for x, y in groups:
                    links.update((i, j) for i in x for j in y)
        held.update(links.keys())
        docs.append((n_a, n_b, groups, links))
    best = {}
    for (i, _), n in held.items():
        best[i] = max(best.get(i, 0), n)
    out = []
    for n_a, n_b, groups, links in docs:
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((n_a, n_b, len(groups), sum(links.values()), sum(n for p, n in links.items() if held[p] == best[p[0]]), sum(n * held[p] for p, n in links.items()), hashlib.sha256(said.encode()).hexdigest() if n_a else ""))
    return out


def check(spark, rows, kind="bigint"):
    df = spark.createDataFrame([(k, t, 1, "x") for k, t in rows], f"doc_id {kind}, text string, block int, key string").repartition(3)
    got = sorted((tuple(r) for r in T.align_tokens(df, A, B).collect()), key=str)
    want = sorted(((k, *x) for (k, _), x in zip(rows, brute([t for _, t in rows]))), key=str)
    assert got == want


def test_libraries(spark):
    docs = [r["text"] for r in table(spark, "/root/testdata/sf0.001", "documents").limit(60).collect()]
    r = random.Random(3)
    mixed = [" ".join(r.choice([*docs, *map(str, ODD)])[:300] for _ in range(4)) for _ in range(20)]
    texts = [*docs, *mixed, *ODD, *ODD]
    check(spark, list(enumerate(texts)))


def test_cuts():
    r = random.Random(8)
    for _ in range(3000):
        t = "".join(r.choice("ab \n\u00a0\u180e\x1c\u2028é") if r.random() < 0.4 else r.choice("abé ") for _ in range(r.randrange(1, 9)))
        assert T.cut_pieces(t) == T.CUT.split(t), repr(t)


def test_other_keys(spark):
    check(spark, [("a", "one two"), (None, "one"), ("a", "one two"), ("b", None)], "string")


def test_wide_groups():
    al = T.Aligner(A, B)
    usual = [x.tolist() for x in al.links(al(["ab" * 400 + " pool"])[0])]
    wide, T.WIDE = T.WIDE, 0
    try:
        al._forget()
        assert [x.tolist() for x in al.links(al(["ab" * 400 + " pool"])[0])] == usual
    finally:
        T.WIDE = wide


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert T.align_tokens(df, A, B).count() == 0
    assert T.align_tokens(spark.createDataFrame([(1, None)], "doc_id bigint, text string"), A, B).collect()[0].count_sum == 0
