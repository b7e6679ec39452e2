"""Functions on small cases worked out by hand."""

from lexiflow.functions import text as X, values as V
from lexiflow.operators import matching as M
from lexiflow.sources import catalog as C
from lexiflow.sources import legacy as L, literals as T
from pyspark.sql import functions as F


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first().y


def test_words(spark):
    cases = {"Trois fromages ! Un... deux... trois !": ["Trois", "fromages !", "Un...", "deux...", "trois !"], "Oh !! ? fin … ok ,": ["Oh !! ?", "fin …", "ok ,"], "! ? a": ["! ?", "a"], "": [], None: []}
    for text, want in cases.items():
        assert one(spark, X.tokenize, text) == want
    assert one(spark, X.tokenize, "Bonjour\u00a0! a\u00a0b\u202f? \ufeffc\u2003d") == ["Bonjour !", "a", "b ?", "c", "d"]
    for word, want in {"Chut !": "Chut", "!": "!", "Un...": "Un", "«Bonjour»": "Bonjour", '"a"': "a", "« !": "« !", "…“été”.": "été", "aujourd'hui": "aujourd'hui"}.items():
        assert one(spark, X.spoken, word) == want
    for word, want in {"L'Étoile,": "letoile", "cœur": "cur", "Où": "ou", "Oh !": "oh", "č ő ş": "cos", "Łódź": "odz", "İı": "i", "e\u0301": "e", "Å": "a", None: ""}.items():
        assert one(spark, X.normalize_word, word) == want
    assert one(spark, X.trimmed, "  a b\t") == "a b" and one(spark, X.url_component, "a b/é") == "a%20b%2F%C3%A9"
    assert one(spark, X.url_component, "it's (ok)!~*") == "it's%20(ok)!~*" and one(spark, X.split_space, "a\u00a0 b") == ["a", "b"]
    for url, want in {"https://open.example.org/playlist/abc?si=1": "https://open.example.org/embed/playlist/abc", "https://open.example.org/x/embed/y?z": "https://open.example.org/x/embed/y", "http://other/x?y": "http://other/x?y", "OPEN.example.org/a": "open.example.org/embed/a"}.items():
        assert one(spark, lambda x: X.embed_link(x, "open.example.org"), url) == want
    assert one(spark, lambda x: X.replace_first(x, "b+", "$1\\n"), "abbcb") == "a$1\\ncb"
    assert [one(spark, lambda x: X.is_heic(x, F.lit(None).cast("string")), n) for n in ("a.HEIC", "a.heif", "heic.png")] == [True, True, False]


def test_data_urls(spark):
    cases = {"data:image/png;base64,aGVsbG8=": ("image/png", b"hello"), "data:a,b;base64,": ("a,b", b""), "data:x;base64,aGV sbG8": ("x", b"hello"), "data:x;base64,-_8=zz": ("x", b"\xfb\xff"), "data:x;base64,aGVsb": ("x", b"hel"), "data:;base64,AA": (None, None), "http://x": (None, None), "data:x;base64,a\nb": (None, None), None: (None, None)}
    for url, (mime, payload) in cases.items():
        got = one(spark, X.data_url_bytes, url)
        assert one(spark, X.data_url_mime, url) == mime and (got if got is None else bytes(got)) == payload, url


def test_fixed_decimals(spark):
    from decimal import ROUND_HALF_UP, Decimal

    values = [1.005, 5.55, 0.005, 2.675, 0.125, 0.375, -1.005, -0.001, 0.0, 99.995, 1234567.125, 133.33333333333334, 0.015, 8.345, 5.45]
    for v in values:
        for n in (0, 1, 2):
            want = str(Decimal(abs(v)).quantize(Decimal(1).scaleb(-n), ROUND_HALF_UP))
            assert one(spark, lambda x: X.fixed(x, n), v, "double") == ("-" if v < 0 else "") + want, (v, n)


def test_books_from_files(spark, tmp_path):
    for name, json in (("a", '[{"title": "A", "pages": [{"text": "x"}, {}]}, {"title": "", "pages": [{}]}, {"title": "C", "pages": []}]'), ("b", '[{"title": "B"'), ("c", '{"title": "no list"}')):
        (tmp_path / "local").mkdir(exist_ok=True)
        (tmp_path / "local" / f"{name}.json").write_text(json)
    (tmp_path / "db").mkdir()
    (tmp_path / "db" / "x.json").write_text('[{"title": "D", "accent": "#fff", "coverImage": "", "pages": [{"text": "y", "image": "i"}]}]')
    local, db, store = (str(tmp_path / n) for n in ("local", "db", "store"))
    assert L.migrate(spark, local, db, store) == 2
    rows = sorted(spark.read.parquet(store).collect(), key=lambda r: r.title)
    assert [(r.title, r.accent, r.coverThumb, [tuple(p) for p in r.pages]) for r in rows] == [("A", None, None, [("x", None, True), ("", None, True)]), ("D", "#fff", None, [("y", "i", False)])]
    assert len({r.id for r in rows}) == 2 and all(r.id.startswith("book-") for r in rows)
    assert L.source_rows(L.read_sources(spark, local)).count() == 0 and L.migrate(spark, local, db, str(tmp_path / "again")) == 0


def test_import_reasons(spark):
    r = {x.json: x for x in C.import_books(spark.createDataFrame([("null",), ("{",), ('{"title": "t", "pages": [{"text": null}]}',)], "json string")).collect()}
    assert r["null"].reason == "no title" and r["{"].reason == "not json" and [tuple(p) for p in list(r.values())[2].pages] == [("", None, True, [])]
    assert C.import_books(spark.createDataFrame([(None,)], "json string")).first().reason == "not json"


def test_numbers_and_colours(spark):
    for value, want in {"10": 10.0, "x": 0.0, None: 0.0, "NaN": 0.0, "Infinity": 0.0, "-5": -5.0, "0x1f": 31.0, " 7 ": 7.0, "1d": 0.0, "2F": 0.0, "": 0.0, "1e3": 1000.0}.items():
        assert one(spark, V.number, value) == want
    assert one(spark, lambda x: V.mix(x, F.lit("#ffffff"), 0.55), "#FF6B6B") == "#ffbcbc"
    assert one(spark, lambda x: F.array(*V.channels(x)), "#abc") == [170, 187, 204]
    row = spark.range(1).select(*V.fit(F.lit(4000), F.lit(3000), 1000), V.rectangle(F.lit(5), F.lit(1), F.lit(2), F.lit(9)).alias("r")).first()
    assert (row[0], row[1]) == (1000, 750) and tuple(row.r) == (2, 1, 3, 8)


def test_zones_and_books(spark):
    rows = spark.createDataFrame([([("-5", "10", "150", "20", "  chat "), ("1", "1", "0", "5", "x"), ("1", "1", "2", "9", "y"), ("1", "1", "2", "9", "  "), ("1", "1", "2", "9", None)],)], "z array<struct<left string, top string, width string, height string, label string>>")
    r = rows.select(C.zones_stored(F.col("z")).alias("s"), C.zones_imported(F.col("z")).alias("i"), C.zones_drawn(C.zones_imported(F.col("z"))).alias("d")).first()
    assert [tuple(z) for z in r.s][:2] == [(-5.0, 10.0, 150.0, 20.0, "chat"), (1.0, 1.0, 0.0, 5.0, "x")] and len(r.s) == 3
    assert [z.label for z in r.i] == ["chat", "y"] and tuple(r.i[0])[:4] == (0.0, 10.0, 100.0, 20.0) and [z.label for z in r.d] == ["chat"]


def test_upsert_twice_is_the_same(spark):
    base, changes = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, None), (3, "c")], "k int, v string")
    once = C.upsert_keep_old(base, changes, "k", "v")
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, C.upsert_keep_old(once, changes, "k", "v").collect())) == [(1, "a"), (2, "b"), (3, "c")]


def test_greedy_sets_and_rings(spark):
    parts = [p[0] for p in T.BODY_PARTS]
    assert all(a in T.CONFLICTS[b] for a, bs in T.CONFLICTS.items() for b in bs) and set(T.CONFLICTS) == set(parts)
    for order in (parts, parts[::-1]):
        for target in parts:
            row = spark.createDataFrame([(target,)], "t string")
            got = row.select(M.round_parts(row, "t", F.array(*map(F.lit, order)), T.CONFLICTS).alias("c")).first().c
            assert len(got) == 4 and got[0] == target and not any(b in T.CONFLICTS[a] for a in got for b in got)
    point = lambda x, y: V.point(F.lit(x), F.lit(y))
    e = spark.range(1).select(V.edge_points(point(0.0, 0.0), point(100.0, 0.0), F.lit(1), (0, 1)).alias("e"), V.edge_points(point(0.0, 0.0), point(0.0, 50.0), F.lit(0), (1, 0)).alias("f")).first()
    assert len(e.e) == 19 and len(e.f) == 2 and (e.e[0].x, e.e[-1].x) == (0.0, 100.0) and abs(e.e[9].y - 22.0) < 1e-9 and e.e[6].y == 0.0
    # A board of 2 by 2 on 400: 38 points, and the first piece's box and home.
    signs = {"top": F.lit(0), "left": F.lit(0), "bottom": F.lit(1), "right": F.lit(-1)}
    s = spark.range(1).select(V.piece_shape(F.lit(0), F.lit(0), signs, 200.0, 200.0).alias("s")).first().s
    assert len(s.ring) == 38 and tuple(s.box) == (-46.0, -46.0, 292.0, 292.0) and tuple(s.home) == (100.0, 100.0)


def test_literals(spark):
    t = T.tables(spark)
    assert {n: f.count() for n, f in t.items()} == {"count_objects": 15, "colors": 7, "shapes": 5, "body_parts": 11, "conflicts": 22, "praises": 6, "encourage": 3, "puzzles": 6, "balloons": 23, "balloon_colors": 8, "notes": 8, "families": 3, "games": 10, "prop_labels": 34, "book_accents": 6, "stories": 7}
    props = {e for *_, pages in T.STORIES for _, _, p, _ in pages for e in p or ()}
    assert props == set(T.PROP_LABELS) and sum(len(pages) for *_, pages in T.STORIES) == 34


def test_lists(spark):
    from lexiflow.operators import arrays as A

    r = spark.createDataFrame([([1, 2, 3], None)], "a array<int>, n int").select(
        A.replaced_at(F.col("a"), F.lit(1), lambda x: x * 10).alias("r"), A.replaced_at(F.col("a"), F.lit(7), lambda x: x * 10).alias("same"), A.dropped_at(F.col("a"), F.lit(0)).alias("d"), A.dropped_at(F.col("a"), F.col("n")).alias("all"),
        A.added(F.col("a"), F.lit(3)).alias("has"), A.added(F.col("a"), F.lit(4)).alias("new"), A.index_of(F.col("a"), lambda x: x > 1).alias("i"), A.index_of(F.col("a"), lambda x: x > 9).alias("none"), A.first_where(F.col("a"), lambda x: x > 1).alias("f"),
    ).first()
    assert tuple(r) == ([1, 20, 3], [1, 2, 3], [2, 3], [1, 2, 3], [1, 2, 3], [1, 2, 3, 4], 1, -1, 2)
    base, changes = spark.createDataFrame([(1, "a", 0), (2, "b", 1)], "k int, v string, pos int"), spark.createDataFrame([(3, "n", 5), (2, "x", 6), (2, "y", 7), (4, "m", 9)], "k int, v string, pos int")
    assert [tuple(x) for x in C.upsert_in_place(base, changes, "k", "pos").orderBy("pos").collect()] == [(1, "a", 0), (2, "y", 1), (3, "n", 2), (4, "m", 6)]
    assert sorted(x.v or "" for x in A.without(spark.createDataFrame([(1, "a"), (2, None), (3, "b")], "k int, v string"), "v", "a").collect()) == ["", "b"]


def test_long_data_urls_in_one_pass(spark):
    """A megabyte with marks in it; each step of decoding is computed once, not once for each mention."""
    import base64

    payload = bytes(range(256)) * 4000
    code = base64.b64encode(payload).decode()
    url = "data:a/b\n;base64," + " *".join(code[i : i + 7] for i in range(0, len(code), 7))
    df = spark.createDataFrame([(url,), (url + " ",), ("data:;base64,AA",), ("data:a;base64;base64,AA",)], "u string")
    out = df.select(X.data_url_mime(F.col("u")).alias("m"), X.data_url_bytes(F.col("u")).alias("p"))
    got = [tuple(r) for r in out.collect()]
    assert got[0][0] == "a/b\n" and bytes(got[0][1]) == payload and got[1:] == [(None, None)] * 3
    assert out._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 1
