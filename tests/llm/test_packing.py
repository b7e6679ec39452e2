"""Packing: ids against the library, whole coverage, gapless sequences, mixture."""

import random
import zlib

import numpy as np
import public_tokenizers as P
from lexiflow.llm import packing
from lexiflow.llm.token_counts import tokenizer
from test_rows import EDGES, noise

PATH = P.path("word_bpe_49k.json")


def test_piece_encoder_equals_the_library():
    texts = [*EDGES, *(noise(i, 300, "aB1 .,*&|!'<>^\n\té́É…") for i in range(60)), "a<|endoftext|>b", "<|ENDOFTEXT|>", "don't*** it's!! 'S* é*** 5%%% x̸* a*̸"]
    tk, enc = tokenizer(PATH), packing.PieceEncoder(PATH)
    for _ in range(2):
        for t, ids in zip(texts, enc.encode(texts)):
            assert np.frombuffer(ids, "<u4").tolist() == (tk.encode(t, add_special_tokens=False).ids if t else [])


def test_case_and_composition():
    """NFC comes before lower case: some capitals have no composed form where their small letters have one."""
    tk, enc = tokenizer(PATH), packing.PieceEncoder(PATH)
    letters = ["J\u030c", "T\u0308", "H\u0331", "W\u030a", "Y\u030a"]
    marks = [chr(c) for c in (*range(0x300, 0x370), 0x5B0, 0x591, 0x64B, 0x94D, 0x1DC0, 0x20D0, 0x302A, 0x3099, 0x1D165)]
    texts = letters + [f"Aa {x}b, {x.lower()} ZÉ{x}." for x in letters] + [a + m for a in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz" for m in marks]
    assert enc.known and enc.id_bytes == 2
    for t, ids in zip(texts, enc.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == tk.encode(t, add_special_tokens=False).ids


def test_other_tokenizers_and_large_vocabularies(spark, tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    own = Tokenizer(models.WordLevel({f"w{i}": i for i in range(70_000)}, unk_token="w0"))
    own.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    path = str(tmp_path / "own.json")
    own.save(path)
    df = spark.createDataFrame([(i, " ".join(f"w{(i * 7919 + j * 104729) % 70000}" for j in range(i)), f"s{i % 100}") for i in range(200)], "doc_id bigint, text string, source string").repartition(3)
    got = {}
    for r in packing.pack(df, path, sequence=64, block=8).collect():
        got.setdefault(r.doc_id, []).append((r.start, bytes(r.ids)))
    for i in range(200):
        ids = np.frombuffer(b"".join(x for _, x in sorted(got[i])), "<u4").tolist()
        assert ids == [(i * 7919 + j * 104729) % 70000 for j in range(i)] + [1]
    assert not packing.PieceEncoder(path).known and packing.PieceEncoder(path).id_bytes == 4


def test_schedule_is_whole_and_close_to_its_shares():
    r = random.Random(3)
    for totals, shares in (([100000, 3000, 1, 0, 777], None), ([5000, 60000], [3.0, 1.0]), ([10], None), ([r.randrange(1, 9000) for _ in range(60)], None)):
        s = packing.Schedule(totals, shares, 128, 16)
        end = np.zeros(len(totals), np.int64)
        for b in range(s.blocks):
            paid, place = s.block(b)
            assert (paid[0] == end).all() and (np.diff(paid, axis=0) >= 0).all()
            end = paid[-1]
            sums = np.diff(paid, axis=0).sum(1)
            assert (sums[:-1] == 128).all() and (b == s.blocks - 1 or sums[-1] == 128)
            if shares is None:
                want = np.outer(np.arange(len(paid)) + b * 16, np.array(totals) / s.total * 128)[:-1]
                assert np.abs(paid[:-1] - want).max() < 4
        assert (end == s.totals).all()


def check(rows, texts, sequence):
    tk = tokenizer(PATH)
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for i, t in enumerate(texts):
        ids = [*(tk.encode(t, add_special_tokens=False).ids if t else []), 1]
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids)
            raw = np.array(ids[at : at + r.length], "<u4").tobytes()
            assert r.ids_crc32 == zlib.crc32(raw) and bytes(r.ids) == raw
            at += r.length
        assert at == len(ids)
    lengths = []
    for s in sorted(by_seq):
        at = 0
        for r in sorted(by_seq[s], key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert {r.sequence_length for r in by_seq[s]} == {at}
        lengths.append(at)
    assert sorted(by_seq) == list(range(len(lengths))) and all(x == sequence for x in lengths[:-1]) and lengths[-1] <= sequence


def test_pack(spark):
    texts = [*EDGES, *(noise(i, 60 * i) for i in range(40)), *EDGES[:4]]
    rows = [(i, t, None if i % 7 == 0 else f"s{min(i % 5, 2)}", "x") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, offset string").repartition(3)
    check(packing.pack(df, PATH, sequence=64, block=8).collect(), texts, 64)
    check(packing.pack(df, PATH, sequence=64, block=8, shares={"s0": 1.0, "s1": 1.0, "s2": 5.0, "": 1.0}).collect(), texts, 64)
    assert packing.pack(df.limit(0), PATH).count() == 0


def test_sources_of_the_shared_queue_keep_their_shares(spark, monkeypatch):
    monkeypatch.setattr(packing, "FAN", 3)  # a tree of some levels
    texts = [noise(i, 400, "ab cd ") for i in range(160)]
    rows = [(i, t, f"s{i // 4:02}") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(3, "source")
    for shares in (None, {f"s{i:02}": 3.0 if i == 39 else 1.0 for i in range(40)}):
        out = packing.pack(df, PATH, sequence=512, block=4, queues=3, shares=shares).collect()
        check(out, texts, 512)
        tokens = {r.doc_id: r.doc_tokens for r in out}
        totals = np.bincount([i // 4 for i in tokens], list(tokens.values()), 40)
        got = np.zeros((max(r.sequence_id for r in out) + 1, 40))
        for r in out:
            got[r.sequence_id, r.doc_id // 4] += r.length
        part = totals / totals.sum() if shares is None else np.array(list(shares.values())) / sum(shares.values())
        until = len(got) - 1 if shares is None else len(got) // 4
        assert until >= 3 and np.abs(np.cumsum(got, 0)[:until] - np.outer(np.arange(1, until + 1) * 512, part)).max() < 32


def test_pieces_of_the_memory_before_are_not_encoded_again(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 10)
    enc, texts = packing.PieceEncoder(PATH), [" ".join(f"w{chr(97 + i)}e, x{i}" for i in range(20)), "other"]
    want = enc.encode(texts[:1]) + enc.encode(texts[1:])
    monkeypatch.setattr(enc, "words", None)
    assert enc.encode(texts[:1]) == want[:1]
    tk = tokenizer(PATH)
    assert np.frombuffer(want[0], "<u4").tolist() == tk.encode(texts[0], add_special_tokens=False).ids
