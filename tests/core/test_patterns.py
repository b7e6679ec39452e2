"""Many patterns against Python's ``in``."""

import random
import time

import numpy as np
import pytest
from lexiflow.operators import patterns as P


def flat(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)


def by_hand(texts, patterns):
    return [min((n for p, n in patterns if p in t), default=P.NONE) for t in texts]


@pytest.mark.parametrize("dense", [0, P.DENSE])
def test_automaton(dense):
    r = random.Random(dense)
    for letters in ("ab", "abcé🐷 "):
        word = lambda n: "".join(r.choice(letters) for _ in range(n))
        patterns = [(word(r.randrange(1, 9)), r.randrange(1000)) for _ in range(60)] + [(word(700), 0)]
        texts = [word(r.randrange(0, 60)) for _ in range(200)] + ["", word(3000), patterns[-1][0], "x" + patterns[-1][0] * 3, "zzz"]
        rare = [(p, n) for p, n in patterns if len(p) > 4]
        for some in (patterns, rare, [*rare, ("", 990)]):
            a = P.Automaton([p.encode() for p, _ in some], [n for _, n in some], dense)
            assert (a.moves is not None) == bool(dense)
            assert a.first(*flat(texts)).tolist() == by_hand(texts, some)
    assert P.Automaton([], []).first(*flat(["a", ""])).tolist() == [P.NONE] * 2


@pytest.mark.parametrize("limit", [P.GROUP_BYTES, 30])
def test_rows(spark, limit):
    r = random.Random(1)
    word = lambda n: "".join(r.choice("abcdé ") for _ in range(n))
    patterns = [(word(r.randrange(3, 7)), i) for i in r.sample(range(1000), 40)] + [(None, 1), ("abc", None)]
    texts = [word(r.randrange(0, 80)) for _ in range(300)] + [None, "", word(5000)]
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")
    got = {x["id"]: x["rule"] for x in P.first_contained(df, "text", spark.createDataFrame(patterns, "pattern string, number bigint"), limit=limit).collect()}
    known = [(p, n) for p, n in patterns if p is not None and n is not None]
    want = by_hand([t if t is not None else "" for t in texts], known)
    assert got == {i: None if n == P.NONE or texts[i] is None else n for i, n in enumerate(want)}
    assert P.first_contained(df.limit(0), "text", spark.createDataFrame(patterns, "pattern string, number bigint")).count() == 0


def test_cost_follows_the_text():
    r = random.Random(2)
    words = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(3000)]
    text = flat([" ".join(r.choice(words) for _ in range(400)) for _ in range(150)])
    took = []
    for n in (100, 100_000):
        a = P.Automaton([" ".join(r.choice(words) for _ in range(3)).encode() for _ in range(n)], list(range(n)), 0)
        a.first(*text)
        began = time.process_time()
        a.first(*text)
        took.append(time.process_time() - began)
    assert took[1] < 12 * took[0] + 0.5
