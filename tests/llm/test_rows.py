"""Operators that work row by row or turn by turn: brute force, round trips and edge cases."""

import hashlib
import pathlib
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from lexiflow.llm import byte_bpe, chat_template, flac, quality_rules, token_counts, url_reputation

EDGES = [None, "", " ", "\n\n", "a", "été 12ab", "<|endoftext|> x<|startoftext|>", "日本語" * 40, "x" * 3000, "word " * 5000, "Tab\tand\x0bfeed\x0c", "a\x85b\u2003c", "it's we'll 'S don't!!'s", "\U0001f600\u0301e\u0301"]


def noise(seed, n, alphabet="abcdeABC 0123456789 ,.!'\n\té\u0301ßÉ "):
    r = random.Random(seed)
    return "".join(r.choice(alphabet) for _ in range(n))


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "src") for i, t in enumerate(texts)], "doc_id bigint, text string, n_tokens string")


def test_token_counts_equal_the_library(spark):
    path = P.path("word_bpe_49k.json")
    tk = token_counts.tokenizer(path)
    texts = [*EDGES, *(noise(i, 50 * i) for i in range(30)), *EDGES[:3]]
    rows = token_counts.token_counts(docs(spark, texts), path, limit=100, chunk=120, overlap=70).collect()
    assert len(rows) == len(texts)
    for r in rows:
        t = texts[r.doc_id] or ""
        n = len(tk.encode(t, add_special_tokens=False))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), n, n > 100)


def test_long_texts_give_the_same_ids():
    tk = token_counts.tokenizer(P.path("word_bpe_49k.json"))
    for seed in range(12):
        t = noise(seed, 4000) + "letters" * (60 * seed) + noise(seed, 2000)
        for chunk, overlap in ((200, 80), (1000, 100), (300, 299)):
            assert token_counts.encode_long(tk, t, chunk, overlap) == tk.encode(t, add_special_tokens=False).ids


def tiktoken_encoding():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.vocabulary(P.path("byte_bpe_50k.tiktoken")), special_tokens={})


def test_byte_bpe_equals_the_library(spark):
    enc = tiktoken_encoding()
    texts = [*EDGES, *(noise(i, 40 * i) for i in range(40)), "aaaaaaaaaaaaa" * 9]
    rows = byte_bpe.encode_texts(docs(spark, texts).drop("n_tokens"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()
    assert len(rows) == len(texts)
    for r in rows:
        t = texts[r.doc_id] or ""
        ids = enc.encode_ordinary(t)
        assert np.frombuffer(r.ids, "<u4").tolist() == ids and r.n_tokens == len(ids) and bytes(r.decoded) == t.encode()


def test_replay_handles_ranks_that_fall():
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 300, b"abc": 260, b"bc": 310, b"abcabc": 305, b"aa": 320, b"aaa": 270}
    words = [b"abcabc", b"aabcab", b"abab", b"", b"aaaaaaa", b"cabcab" * 4]
    assert byte_bpe.replay(words, ranks) == [byte_bpe.merge_word(w, ranks) for w in words]


def test_words_of_the_memory_before_are_not_replayed(monkeypatch):
    """A full memory is followed by a new one, but its words are taken from it and not merged again."""
    enc, merged = byte_bpe.Encoder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN, remembered=10), []
    own = byte_bpe.replay_bytes
    monkeypatch.setattr(byte_bpe, "replay_bytes", lambda words, *more: merged.append(sorted(words)) or own(words, *more))
    first = " ".join(f"w{chr(97 + i)}" for i in range(20))
    want = enc.encode([first])
    enc.encode(["other"])
    assert enc.encode([first + " new"])[0].startswith(want[0]) and merged[1:] == [[b"other"], [b" new"]]


def test_replay_of_nothing_and_of_bytes_without_rank():
    ranks = {b"a": 0, b"b": 1, b"ab": 2, b"xy": 3}
    assert byte_bpe.replay([], ranks) == [] and byte_bpe.replay([b"", b"ab", b"", b"ba"], ranks) == [[], [2], [], [1, 0]]
    assert byte_bpe.replay([b"xy", b"aab"], ranks) == [[3], [0, 2]]


def test_merge_word_equals_plain_merging():
    """Random words and ranks against a search of the whole word at each merge; a word of 100,000 bytes ends."""
    draw = random.Random(6)
    for _ in range(300):
        ranks = {bytes([c]): 1000 + c for c in b"abc"}
        for r in range(draw.randrange(12)):
            a, b = draw.choice(list(ranks)), draw.choice(list(ranks))
            ranks.setdefault(a + b, draw.randrange(40) * 20 + r)
        word = bytes(draw.choice(b"abc") for _ in range(draw.randrange(40)))
        parts = [word[i : i + 1] for i in range(len(word))]
        while True:
            found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
            if not found:
                break
            i = min(found)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        assert byte_bpe.merge_word(word, ranks) == [ranks[p] for p in parts]
    assert byte_bpe.merge_word(b"ab" * 50_000, {b"a": 3, b"b": 4, b"ab": 2, b"abab": 1}) == [1] * 25_000


def test_encoder_forgets_within_bounds():
    enc = byte_bpe.Encoder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN, remembered=10)
    for i in range(20):
        enc.encode([noise(i, 300)])
    assert len(enc.known) < 400


def test_flac_round_trip_and_digests(spark):
    texts = [*EDGES, *(noise(i, 97 * i) for i in range(20))]
    rows = {r.doc_id: r for r in flac.media_digests(docs(spark, texts)).collect()}
    media = {r.doc_id: bytes(r.media) for r in flac.encode_media(docs(spark, texts)).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        b = (t or "").encode()
        p = flac.pad(b)
        assert len(p) % 192 == 0 and len(p) and p.startswith(b)
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
        assert r.media_sha256 == hashlib.sha256(media[i]).hexdigest() and r.media_bytes == len(media[i])
        x = [v - 128 for v in p]
        crossings = sum((a < 0) != (b < 0) for a, b in zip(x, x[1:]))
        assert r.feature == f"peak={max(map(abs, x))};energy={sum(v * v for v in x) // len(x)};crossings={crossings}"
    # Frames of prose have linear predictors, and the stored form of long prose is smaller than its payload.
    prose = pathlib.Path(flac.__file__).read_text()
    m = flac.encode_many([flac.pad(prose.encode())])[0]
    kinds = [m[at + (6 if n < 128 else 7)] >> 1 for n, (_, at, _) in enumerate(flac.decode_frames(m)) if n < 2048]
    assert sum(k >= 32 for k in kinds) > len(kinds) / 3 and len(m) < len(prose.encode())
    assert flac.media_digests(docs(spark, texts).limit(0)).count() == 0


def test_flac_predictors_and_sequential_decoding():
    rng = np.random.default_rng(1)
    smooth = ((np.sin(np.arange(192 * 30) / 1.2) * 90).astype(int) + rng.integers(-3, 4, 192 * 30) + 128).clip(0, 255).astype(np.uint8).tobytes()
    loud = rng.integers(0, 256, 192 * 5, dtype=np.uint8).tobytes()
    spike = bytearray(b"\x80" * 192 * 3)
    spike[300] = 255
    payloads = [smooth, loud, bytes(spike), bytes(192), b"\xff\xf8\x14\x02\x00" * 192]
    kinds = set()
    for lpc in (None, ((11018, -8192), 13), ((8000, 1000, -900), 13)):
        media = flac.encode_many(payloads, lpc)
        assert flac.decode_many(media) == payloads
        for m, p in zip(media, payloads):
            one = b"".join((x ^ -128).astype(np.int8).tobytes() for _, _, x in flac.decode_frames(m))
            assert one == p
        kinds |= {m[at + 6] >> 1 for m in media for _, at, _ in flac.decode_frames(m)}
    assert any(k >= 32 for k in kinds) and 1 in kinds


def test_flac_seeks_and_finds_damage():
    p = bytes(np.random.default_rng(2).integers(90, 120, 192 * 600, dtype=np.uint8))
    m = flac.encode_many([p])[0]
    first = next(flac.decode_frames(m, sample=192 * 520))
    assert first[0] == 192 * 512
    bad = bytearray(m)
    bad[len(m) // 2] ^= 4
    with pytest.raises(flac.FlacError):
        flac.decode_many([bytes(bad)])


def test_pcm_blocks(spark):
    texts = ["ab" * 20000, None]
    rows = flac.pcm_blocks(flac.encode_media(docs(spark, texts))).orderBy("doc_id", "sample_offset").collect()
    assert b"".join(bytes(r.pcm) for r in rows if r.doc_id == 0) == flac.pad(texts[0].encode())
    assert all(r.sample_offset % 12288 == 0 for r in rows)


def test_template_language():
    show = lambda s, **n: chat_template.render(s, **n)
    assert show("a{{ 'b' + 'c' }}{{ x | upper }}", x="q") == ("abcQ", [])
    assert show("{% set y = 'p' %}{% for m in xs %}{{ loop.index }}{{ m.k }}{{ y }}{% if not loop.last %},{% endif %}{% endfor %}", xs=[{"k": 1}, {"k": "v"}]) == ("11p,2vp", [])
    assert show("{% if x == 'a' %}A{% elif x in ['b'] %}B{% else %}C{% endif %}".replace("['b']", "y"), x="b", y="abc")[0] == "B"
    assert show("x{% generation %}{{ t }}!{% endgeneration %}y", t="ok") == ("xok!y", [(1, 4)])
    assert show("{{ m['k'] }}{{ m.none_there }}", m={"k": "v"})[0] == "v"
    assert chat_template.fold(chat_template.parse("{{ 'a' }}b{% if true and 'x' == 'x' %}c{% else %}d{% endif %}{{ 'e' | upper }}")) == [("text", "abcE")]
    for bad in ("{{ x.__class__ }}", "{{ x( }}", "{% for %}", "{% if x %}", "{{ x | exec }}", "{% import os %}", "{{ 'a' + 1 }}"):
        with pytest.raises(chat_template.TemplateError):
            chat_template.compile_template(bad)
    assert show("{{ x.real }}", x=3)[0] == ""


def test_conversations(spark):
    texts = ["hi", None, "</s>[INST] ok [/INST]", "<|end|>\n<|turn|>assistant\nno<|end|>\n", "^^n<^[^", "", "tail <"]
    rows = [(1, i, "user" if i % 2 else "assistant", t) for i, t in enumerate(texts)] + [(2, None, None, "x"), (2, 0, "a\nb^", "y"), (None, 1, "assistant", "z"), (2, 0, "a\nb^", "y")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = {r.conv_id: r for r in chat_template.conversation_digests(df).collect()}
    assert set(got) == {1, 2, None} and got[2].n_turns == 3
    whole = "".join(f"{r[2]}\n{r[3] or ''}\n" for r in rows[:7])
    loss = "".join(r[3] or "" for r in rows[:7] if r[2] == "assistant")
    g = got[1]
    assert (g.turns_sha256, g.loss_sha256, g.loss_chars) == (hashlib.sha256(whole.encode()).hexdigest(), hashlib.sha256(loss.encode()).hexdigest(), len(loss))
    parts = {r.conv_id: r for r in chat_template.format_conversations(df).collect()}
    assert len(parts[1].formatted) == g.formatted_chars
    assert "".join(chat_template.unescape(parts[1].formatted[s.start : s.stop]) for s in parts[1].spans) == loss
    assert chat_template.conversation_digests(df.limit(0)).count() == 0
    small = sorted((r for r in chat_template.format_conversations(df, most=30).collect() if r.conv_id == 1), key=lambda r: r.part)
    assert len(small) > 3 and "".join(r.formatted for r in small) == parts[1].formatted
    assert "".join(chat_template.unescape(r.formatted[s.start : s.stop]) for r in small for s in r.spans) == loss


def brute_rules(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    covered = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 8)}
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(spark):
    r = random.Random(5)
    texts = [*EDGES[:9], "word " * 60, *(" ".join(r.choice("ab") for _ in range(60)) for _ in range(10)), "one two three four five six seven eight\n" * 4, *(noise(i, 200) for i in range(5))]
    rows = quality_rules.quality_rules(docs(spark, texts).withColumnRenamed("n_tokens", "n_words")).collect()
    assert len(rows) == len(texts)
    for x in rows:
        want = brute_rules(texts[x.doc_id])
        assert tuple(x[c] for c in quality_rules.COUNTS) == want
        assert x.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0]) and not (x.kept and x.base_failed)
    clean = "The house of the town is in a valley and it was built by the people with stone from the river that runs to the sea."
    assert quality_rules.quality_rules(docs(spark, [clean])).first().kept


def test_url_parts(spark):
    """A later ``://`` belongs to the query, fragment or path; by the code and by its SQL."""
    import duckdb

    parts = {
        "http://shop.com?next=http://x/fr/": ("shop.com", ""), "http://A.com#http://x/de/": ("a.com", ""), "http://a?x=http://b/fr/": ("a", ""), "x://a/b://c?d": ("a", "/b://c"), "://": ("", ""), ":///p#q?": ("", "/p"),
        "http://ÄB.com\n/x\ny?z": ("Äb.com\n", "/x\ny"), "//a/b": ("", ""), "": ("", ""), None: ("", ""), "u:p@h:80://z": ("z", ""), "h?://i/j": ("i", "/j"),
    }
    pages = spark.createDataFrame(list(enumerate(parts)), "page_id bigint, url string")
    got = {r.page_id: r for r in url_reputation.url_verdicts(pages, spark.createDataFrame([], "page_id bigint, good int")).collect()}
    assert [(got[i].host, got[i].path) for i in range(len(parts))] == list(parts.values())
    assert got[0].rule is None and got[1].rule is None
    c = duckdb.connect()
    c.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    c.executemany("INSERT INTO pages VALUES (?, ?)", list(enumerate(parts)))
    c.execute("CREATE TABLE labels (doc_id BIGINT, quality INT, toxic INT)")
    sql = {r[0]: r[1:] for r in c.execute(url_reputation.ORACLE_SQL).fetchall()}
    assert sql == {i: (r.host, r.path, r.rule, r.verdict) for i, r in got.items()}


def test_url_rules_and_reputation(spark):
    urls = ["http://A.org/x?y", "https://s.example.org/es/1", "http://example.org/en/12#a", "http://com/fr/", "x://b.com/de/?q", "nourl", None, "http://h.net", "a://b://c/d", "http://xorg/", "http://bad.host.net/1"]
    pages = spark.createDataFrame([(i, u, "r") for i, u in enumerate(urls)] + [(50 + i, "http://bad.host.net/z", "r") for i in range(40)] + [(90 + i, "http://good.net/", "r") for i in range(40)], "page_id bigint, url string, rule string")
    outcomes = spark.createDataFrame([(50 + i, 0) for i in range(40)] + [(90 + i, 1) for i in range(40)] + [(90, None), (None, 1)], "page_id bigint, good int")
    got = {r.page_id: r for r in url_reputation.url_verdicts(pages, outcomes).collect()}
    want = {0: ("a.org", "/x", "org/", "allow"), 1: ("s.example.org", "/es/1", "example.org/es/", "block"), 2: ("example.org", "/en/12", "example.org/en/1", "block"), 3: ("com", "/fr/", "com/fr/", "allow"), 4: ("b.com", "/de/", "com/de/", "block")}
    for k, v in want.items():
        assert tuple(got[k][c] for c in ("host", "path", "rule", "verdict")) == v
    assert (got[5].host, got[5].path, got[6].host, got[7].path, got[8].host, got[8].path, got[9].rule) == ("", "", "", "", "b:", "//c/d", None)
    assert got[10].verdict == "block" and got[90].verdict == "allow" and len(got) == len(urls) + 80
    assert url_reputation.url_verdicts(pages.limit(0), outcomes).count() == 0
    assert url_reputation.url_verdicts(pages, outcomes.limit(0)).count() == len(urls) + 80


def test_registered_domains(spark):
    hosts = {"a.b.co.uk": ("b.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"), "x.y.example.org": ("example.org", "org"), "org": ("org", "org"), "": ("", "")}
    rows = spark.createDataFrame([(h,) for h in hosts], "host string").select("host", *url_reputation.domain_and_suffix()).collect()
    assert {r[0]: (r[1], r[2]) for r in rows} == hosts


def test_very_long_rows(spark):
    """A text of a million words and a URL of a megabyte."""
    t = "the house of stone\n" * 250_000
    r = quality_rules.quality_rules(docs(spark, [t])).first()
    assert (r.n_words, r.n_dup_lines, r.n_repeat_words, r.kept) == (1_000_000, 249_999, 1_000_000, False)
    pages = spark.createDataFrame([(1, "http://h.net/" + "x" * 1_000_000)], "page_id bigint, url string")
    r = url_reputation.url_verdicts(pages, spark.createDataFrame([], "page_id bigint, good int")).first()
    assert r.host == "h.net" and len(r.path) == 1_000_001


def test_empty_tables(spark):
    empty = docs(spark, ["x"]).limit(0)
    assert token_counts.token_counts(empty, P.path("word_bpe_49k.json")).count() == 0
    assert byte_bpe.encode_digests(empty, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0
    assert quality_rules.quality_rules(empty).count() == 0 and flac.encode_media(empty).count() == 0


def test_clashing_columns_of_rules(spark):
    names = ["doc_id", "text", "__l", "__w", "row", "lines", "hashes", "a.b", "N_WORDS", "whole row"]
    df = spark.createDataFrame([(1, "one two three", *(f"v{n}" for n in names[2:]))], ", ".join(f"`{n}` {'bigint' if n == 'doc_id' else 'string'}" for n in names))
    out = quality_rules.quality_rules(df)
    r = out.first()
    assert all(r[n] == f"v{n}" for n in names[2:] if n != "N_WORDS") and r["n_words"] == 3 and "N_WORDS" not in out.columns


def test_token_counts_of_other_tokenizers(spark):
    """A tokenizer without the proven settings gets whole texts."""
    from tokenizers import Tokenizer

    texts = ["two  words\n\nand   spaces ", "x" * 300 + " y" * 200, "", None, " a", "tab\tand é 🐷"]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        tk = Tokenizer.from_file(P.path(name))
        rows = token_counts.token_counts(docs(spark, texts), P.path(name), chunk=120, overlap=70).collect()
        assert sorted(r.n_tokens for r in rows) == sorted(len(tk.encode(t or "", add_special_tokens=False).ids) for t in texts)
    assert not token_counts.proven(Tokenizer.from_file(P.path("byte_bpe_50k.json")))


def test_chat_keys_and_templates(spark):
    rows = [("b", 1, "user", "hi <|end|>"), ("b", 2, "assistant", "a^b[c"), ("b", 2, "assistant", "a^b[c"), ("a", None, None, None), (None, 5, "assistant", ""), ("é", 1, "x\ny", "t" * 40_000)]
    df = spark.createDataFrame([(*r, "z", 1) for r in rows], "conv_id string, turn bigint, role string, text string, n_turns string, chars int")
    whole = chat_template.TURNS.replace("{% for", "{% set unused = 1 %}{% for", 1)
    assert chat_template.by_turn(chat_template.TURNS) and not chat_template.by_turn(whole)
    for t in ("{% for m in messages %}{{ loop.index }}{% endfor %}", "{% for m in messages %}{{ other }}{% endfor %}", "{% for m in messages %}{% set x = m %}{% endfor %}", "{% for m in all %}{{ m }}{% endfor %}", "a{% for m in messages %}{% endfor %}"):
        assert not chat_template.by_turn(t)
    key = lambda r: str(r[0])
    one, other = (sorted(map(tuple, chat_template.conversation_digests(df, t).collect()), key=key) for t in (chat_template.TURNS, whole))
    assert one == other and [r[0] for r in one] == [None, "a", "b", "é"]
    assert {r.conv_id for r in chat_template.format_conversations(df).collect()} == {None, "a", "b", "é"}
    dates = df.selectExpr("date'2024-01-01' AS conv_id", "turn", "role", "text")
    assert chat_template.conversation_digests(dates).first().n_turns == len(rows)
