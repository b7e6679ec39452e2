"""Queries of list edits, lookups, saved pages and older sources."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as X, values as V
from ..operators import arrays as A, matching as M, sampling as S
from ..sources import catalog as C, json_lists as J, legacy as L, literals as T
from ..sources.tables import scratch, table, written


def _names(spark, d):
    """Parts with the words of their names as a list."""
    return table(spark, d, "part").select("p_partkey", "p_size", F.split("p_name", " ").alias("words"))


def replaced_at(spark, d):
    w = A.replaced_at(F.col("words"), F.col("p_size") % 5 - 1, lambda x: F.upper(F.concat(x, F.lit("!"))))
    return _names(spark, d).select("p_partkey", F.array_join(w, " ").alias("words"))


def dropped_at(spark, d):
    return _names(spark, d).select("p_partkey", F.array_join(A.dropped_at(F.col("words"), F.col("p_size") % 4 - 1), " ").alias("words"))


def set_added(spark, d):
    """A set of found items after one more: it grows unless it has the item."""
    found = F.array(*(F.lit(x) for x in ("0", "1", "2")))
    now = A.added(found, (F.col("p_size") % 5).cast("string"))
    return table(spark, d, "part").select("p_partkey", F.array_join(now, ",").alias("found"), (F.size(now) == 4).alias("grew"))


def index_of(spark, d):
    w = F.col("words")
    return _names(spark, d).select("p_partkey", A.index_of(w, lambda x: x.contains("1")).cast("int").alias("place"), A.first_where(w, lambda x: F.length(x) > 4).alias("first_long"))


def card_deck(spark, d):
    """Three items of each brand by hash, each as two cards."""
    three = S.first_of_group(table(spark, d, "part").select("p_brand", "p_partkey"), "p_brand", "p_partkey", 3, "s6")
    return A.twice(three).select("p_brand", "p_partkey", "twin")


def updated_where(spark, d):
    return A.updated_where(table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment"), F.col("c_custkey") % 10 == 3, c_name=F.upper("c_name"), c_mktsegment=F.lit("NEW"))


def drop_by_value(spark, d):
    """Rows without one value; those that have none stay."""
    c = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 4 > 0, F.col("c_mktsegment")).alias("segment"))
    return A.without(c, "segment", "BUILDING")


def lookup_first(spark, d):
    """Each nation with its first customer of negative balance, if there is one."""
    c = table(spark, d, "customer").filter("c_acctbal < 0").select(F.col("c_nationkey").alias("n_nationkey"), "c_custkey", "c_name")
    return M.lookup_first(table(spark, d, "nation").select("n_nationkey"), c, "n_nationkey", "c_custkey").select("n_nationkey", "c_custkey", "c_name")


def tray_pieces(spark, d):
    """Ids of a tray in order, of which only known ones are shown."""
    trays = table(spark, d, "supplier").select("s_suppkey", F.transform(F.sequence(F.lit(1), F.lit(6)), lambda i: (F.col("s_suppkey") * 37 * i) % 400).alias("ids"))
    known = table(spark, d, "part").filter("p_size > 20").select(F.col("p_partkey").alias("id"), "p_name")
    return M.in_order(trays, "ids", known, "id").select("s_suppkey", F.col("pos").cast("int").alias("pos"), "id", "p_name")


def pair_match(spark, d):
    """Parts of one brand and size as pairs of neighbours."""
    p = table(spark, d, "part").select("p_partkey", F.concat_ws("/", "p_brand", "p_size").alias("face"))
    return M.equal_pairs(p, "p_partkey", "face")


def game_screen(spark, d):
    """The screen of each game, by a lookup that knows some events' names only."""
    screens = {i: n for i, _, n in T.GAMES} | {"view": "Reader", "click": "Xylophone"}
    return table(spark, d, "events").select("event_id", M.mapped(F.col("event_type"), screens).alias("screen"))


def body_boxes(spark, d):
    """A figure for each supplier, of one part of the body each."""
    parts = M.modular_rows(table(spark, d, "supplier").select("s_suppkey"), "s_suppkey", T.tables(spark)["body_parts"], len(T.BODY_PARTS))
    return M.boxes(parts.select(F.concat_ws("/", "id", F.col("s_suppkey").cast("string")).alias("id"), "boxes"), "id", "boxes")


def literal_tables(spark, d):
    """For each literal table how many customers are dealt to each of its rows, and the row's length as JSON."""
    from functools import reduce

    c = table(spark, d, "customer").select("c_custkey")
    sizes = {n: f.count() for n, f in T.tables(spark).items()}
    rows = [M.modular_rows(c, "c_custkey", f.select("ord", F.length(F.to_json(F.struct(*f.columns))).alias("chars")), sizes[n]).select(F.lit(n).alias("name"), "ord", "chars") for n, f in T.tables(spark).items()]
    return reduce(lambda a, b: a.unionAll(b), rows).groupBy("name", "ord").agg(F.count("*").alias("n"), F.max("chars").alias("chars"))


def story_words(spark, d):
    """A story for each supplier: every word as it is read aloud, with the labels of its page's props."""
    own = M.modular_rows(table(spark, d, "supplier").select("s_suppkey"), "s_suppkey", T.tables(spark)["stories"], len(T.STORIES))
    s = own.select(F.concat_ws("/", "id", F.col("s_suppkey").cast("string")).alias("id"), F.posexplode("pages").alias("page", "p"))
    labels = F.transform("p.props", lambda e: F.coalesce(M.mapped(e, T.PROP_LABELS), F.lit(T.DEFAULT_LABEL)))
    return s.select("id", "page", F.array_join(labels, ", ").alias("labels"), F.posexplode(X.tokenize(F.col("p.text"))).alias("pos", "w")).select("id", "page", "pos", X.spoken(F.col("w")).alias("word"), "labels")


def zone_counts(spark, d):
    """Buttons with the number of zones of each order."""
    l = table(spark, d, "lineitem").select("l_orderkey", "l_returnflag").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.max("l_returnflag").alias("flag"))
    zones = F.when(F.col("flag") != "R", F.array_repeat(F.lit("z"), F.col("n").cast("int"))).when(F.col("n") > 3, F.array().cast("array<string>"))
    return l.select("l_orderkey", C.zone_count(zones).alias("shown"))


def saved_pages(spark, d):
    """Pages of books as an editor saves them: image by mode, empty ones dropped, and whether the cover is new."""
    p = table(spark, d, "pages").select((F.col("page_id") % 40).alias("book"), "page_id", "url")
    mode = F.element_at(F.array(*map(F.lit, ("none", "new", "existing"))), (F.col("page_id") % 3 + 1).cast("int"))
    rows = p.select("book", "page_id", F.when(F.col("page_id") % 2 == 0, F.lit(" \t")).otherwise(F.concat(F.lit(" "), F.col("url"))).alias("text"), mode.alias("mode"), F.concat(F.lit("img"), F.col("page_id")).alias("image"), F.lit("z").alias("zones"))
    return C.save_pages(rows, "book", "page_id", "text", "mode", "image", "zones")


def access_state(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 5 == 0, "").when(F.col("c_custkey") % 5 == 1, F.lit(None)).otherwise("BUILDING").alias("configured"), F.when(F.col("c_custkey") % 7 > 0, F.col("c_mktsegment")).alias("token"))
    return c.select("c_custkey", C.access(F.col("configured"), F.col("token")).alias("state"))


def photo_kinds(spark, d):
    """Which pages would bring a photo that browsers do not decode, or an image as a data URL."""
    p = table(spark, d, "pages").select("page_id", "url")
    name = F.concat(F.lit("IMG"), F.col("page_id"), F.element_at(F.array(*map(F.lit, (".HEIC", ".heif", ".png", ".heic.jpg"))), (F.col("page_id") % 4 + 1).cast("int")))
    mime = F.when(F.col("page_id") % 5 == 0, "image/heic").when(F.col("page_id") % 5 == 1, "image/png")
    source = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("data:image/png;base64,"), F.base64(F.col("url").cast("binary")))).when(F.col("page_id") % 3 == 1, F.col("url"))
    return p.select("page_id", X.is_heic(name, mime).alias("heic"), X.is_data_image(source).alias("data_image"))


def membership(spark, d):
    """Whether some word of a part's name passes a test, and whether the list of its words holds a value."""
    w = F.col("words")
    return _names(spark, d).select("p_partkey", F.exists(w, lambda x: F.length(x) > 5).alias("some_long"), F.array_contains(w, F.concat(F.lit("Part#"), F.col("p_partkey"))).alias("own_name"), F.array_contains(F.transform(w, lambda x: F.substring(x, 1, 1)), "P").alias("a_p"))


def balloon_phrases(spark, d):
    """What is said when a part's balloon is popped, right or wrong."""
    b = M.modular_rows(table(spark, d, "part").select("p_partkey"), "p_partkey", T.tables(spark)["balloons"], len(T.BALLOONS))
    sound = F.col("sound").isNotNull()
    right = F.when(sound, F.format_string("Bravo ! %s fait %s !", "name", "sound")).otherwise(F.format_string("Bravo ! C'est %s !", "name"))
    wrong = F.when(sound, F.format_string("%s fait %s", "name", "sound")).otherwise(F.format_string("C'est %s", "name"))
    return b.select("p_partkey", right.alias("right"), wrong.alias("wrong"))


def book_ids(spark, d):
    e = table(spark, d, "events").select("event_id", "ts", "user_id")
    return e.select("event_id", X.random_id("book", C.epoch_ms(F.col("ts")), F.col("event_id").cast("string"), F.col("user_id").cast("string")).alias("id"))


def epoch_ms(spark, d):
    """Times as epoch milliseconds, all of which lie before now."""
    ms = C.epoch_ms(F.col("ts"))
    return table(spark, d, "events").select("event_id", ms.alias("ms"), (ms < C.now_ms()).alias("past"))


def random_values(spark, d):
    k = F.col("p_partkey").cast("string")
    v = V.random_velocity(S.unit("vel", k))
    return table(spark, d, "part").select("p_partkey", S.whole_number("n", 1, 3, k).alias("n"), F.round(v, 6).alias("velocity"))


def _sources(spark, d, remainder):
    """Each conversation as a source with one book; some are cut short, so that they don't parse."""
    c = table(spark, d, "conversations").filter(F.col("conv_id") % 2 == remainder)
    book = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    title = F.when(F.col("conv_id") % 5 > 0, F.concat(F.lit("livre "), F.col("conv_id")))
    pages = F.transform("t", lambda x: F.struct(x["text"].alias("text"), F.when(x["turn"] % 2 == 0, F.lit("i")).otherwise("").alias("image")))
    json = F.to_json(F.array(F.struct(title.alias("title"), F.lit("#FFD93C").alias("accent"), pages.alias("pages"), F.lit("c").alias("coverImage"))))
    return book.select("conv_id", F.when(F.col("conv_id") % 7 == 0, F.substring(json, F.lit(1), F.length(json) - 1)).otherwise(json).alias("json"))


def migrated_books(spark, d):
    local, database = (L.source_rows(_sources(spark, d, r)) for r in (0, 1))
    m = L.migrated(L.from_local(local), L.from_database(database))
    images = F.array_join(F.transform("pages", lambda p: F.coalesce(p["image"], F.lit("-"))), "")
    return m.select("id", "title", "accent", F.size("pages").alias("n_pages"), images.alias("images"), F.size(F.filter("pages", lambda p: p["plain"])).alias("plain"), "coverThumb")


def source_elements(spark, d):
    """Elements of every source; those that don't parse have none."""
    return L.source_rows(_sources(spark, d, 0)).select("conv_id", "pos", F.try_variant_get("row", "$.title", "string").alias("title"))


def listed_turns(spark, d):
    """Conversations written as three files of one list each and read back in ranges of 64 kB."""
    c = table(spark, d, "conversations").select(F.to_json(F.struct("conv_id", "turn", "role", "text"), {"ignoreNullFields": "false"}).alias("json"))
    path = f"{scratch(spark)}/lists-{uuid.uuid4().hex}"
    J.write_lists(c, "json", path, 3)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        rows = written(J.list_elements(spark, path), "turns")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    return rows.select(F.from_json("json", "conv_id bigint, turn bigint, role string, text string").alias("r")).select("r.*")


QUERIES = {f.__name__: f for f in (replaced_at, dropped_at, set_added, index_of, card_deck, updated_where, drop_by_value, lookup_first, tray_pieces, pair_match, game_screen, body_boxes, literal_tables, story_words, zone_counts, saved_pages, access_state, photo_kinds, membership, balloon_phrases, book_ids, epoch_ms, random_values, migrated_books, source_elements, listed_turns)}

_q = lambda x: "NULL" if x is None else "'" + str(x).replace("'", "''") + "'"
_unit = lambda seed: f"('0x' || md5('{seed}|' || p_partkey)[1:8])::BIGINT / 4294967296.0::DOUBLE"
_SOURCES = """WITH c AS (SELECT conv_id, conv_id % 2 AS kind, 'livre ' || conv_id AS title, turn, coalesce(text, '') AS text, turn % 2 = 0 AND conv_id % 2 = 1 AS shown FROM conversations WHERE conv_id % 7 <> 0) """
_STORIES = ", ".join(f"({_q(i)}, {k}, {_q(None if not p else ', '.join(T.PROP_LABELS.get(e, T.DEFAULT_LABEL) for e in p))}, {_q(x)})" for i, _, _, _, pages in T.STORIES for k, (_, _, p, x) in enumerate(pages))
_BOXES = ", ".join(f"({_q(i)}, '{i}-{k}', {', '.join(x.rstrip('%') + '::DOUBLE' for x in b)})" for i, _, bs in T.BODY_PARTS for k, b in enumerate(bs))
_PLACES = ", ".join(f"({i}, {_q(p[0])})" for i, p in enumerate(T.BODY_PARTS))
_OWN = ", ".join(f"({i}, {_q(p[0])})" for i, p in enumerate(T.STORIES))
SQL = {
    "replaced_at": "SELECT p_partkey, array_to_string([CASE WHEN i = p_size % 5 - 1 THEN upper(w[i + 1] || '!') ELSE w[i + 1] END for i in range(len(w))], ' ') AS words FROM (SELECT p_partkey, p_size, string_split(p_name, ' ') AS w FROM part)",
    "dropped_at": "SELECT p_partkey, array_to_string([w[i + 1] for i in range(len(w)) if i <> p_size % 4 - 1], ' ') AS words FROM (SELECT p_partkey, p_size, string_split(p_name, ' ') AS w FROM part)",
    "set_added": "SELECT p_partkey, CASE WHEN p_size % 5 > 2 THEN '0,1,2,' || p_size % 5 ELSE '0,1,2' END AS found, p_size % 5 > 2 AS grew FROM part",
    "index_of": "SELECT p_partkey, coalesce(list_position([contains(x, '1') for x in w], true), 0)::INT - 1 AS place, list_filter(w, lambda x: length(x) > 4)[1] AS first_long FROM (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part)",
    "card_deck": "SELECT p_brand, p_partkey, twin::INT AS twin FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY md5('s6|' || p_partkey), p_partkey) AS place FROM part), range(2) t(twin) WHERE place <= 3",
    "updated_where": "SELECT c_custkey, CASE WHEN c_custkey % 10 = 3 THEN upper(c_name) ELSE c_name END AS c_name, CASE WHEN c_custkey % 10 = 3 THEN 'NEW' ELSE c_mktsegment END AS c_mktsegment FROM customer",
    "drop_by_value": "SELECT * FROM (SELECT c_custkey, CASE WHEN c_custkey % 4 > 0 THEN c_mktsegment END AS segment FROM customer) WHERE segment IS DISTINCT FROM 'BUILDING'",
    "lookup_first": "SELECT n_nationkey, c_custkey, c_name FROM nation LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS r FROM customer WHERE c_acctbal < 0) ON c_nationkey = n_nationkey AND r = 1",
    "tray_pieces": "SELECT s_suppkey, i::INT - 1 AS pos, p_partkey AS id, p_name FROM supplier, range(1, 7) t(i) JOIN part ON p_partkey = (s_suppkey * 37 * i) % 400 WHERE p_size > 20",
    "pair_match": "SELECT * FROM (SELECT p_partkey AS first, lead(p_partkey) OVER (PARTITION BY p_brand, p_size ORDER BY p_partkey) AS second, p_brand || '/' || p_size AS face FROM part) WHERE second IS NOT NULL",
    "game_screen": "SELECT event_id, CASE event_type WHEN 'view' THEN 'Reader' WHEN 'click' THEN 'Xylophone' END AS screen FROM events",
    "body_boxes": f"""SELECT b.id || '/' || s_suppkey AS id, b.id || '/' || s_suppkey || substr(box_key, length(b.id) + 1) AS box_key, top, "left", width, height FROM supplier JOIN (VALUES {_PLACES}) p(ord, id) ON ord = s_suppkey % {len(T.BODY_PARTS)} JOIN (VALUES {_BOXES}) b(id, box_key, top, "left", width, height) ON b.id = p.id""",
    "story_words": rf"""WITH s AS (SELECT t.id || '/' || s_suppkey AS id, page, labels, text FROM supplier JOIN (VALUES {_OWN}) o(ord, id) ON ord = s_suppkey % {len(T.STORIES)} JOIN (VALUES {_STORIES}) t(id, page, labels, text) ON t.id = o.id), t AS (SELECT id, page, labels, unnest(w) AS tok, generate_subscripts(w, 1) AS i FROM (SELECT *, regexp_extract_all(text, '[^{X.SPACES}]+') AS w FROM s)),
g AS (SELECT *, sum(CASE WHEN regexp_full_match(tok, '[!?.,;:…]+') AND i > 1 THEN 0 ELSE 1 END) OVER (PARTITION BY id, page ORDER BY i) - 1 AS pos FROM t), k AS (SELECT id, page, pos, labels, string_agg(tok, ' ' ORDER BY i) AS word FROM g GROUP BY ALL)
SELECT id, page::INT AS page, pos::INT AS pos, coalesce(nullif(trim(regexp_replace(regexp_replace(word, '^[!?.,;:…«»"''“”]+', ''), '[!?.,;:…«»"''“”]+$', '')), ''), word) AS word, labels FROM k""",
    "zone_counts": "SELECT l_orderkey, CASE WHEN max(l_returnflag) <> 'R' THEN ' (' || count(*) || ')' ELSE '' END AS shown FROM lineitem GROUP BY l_orderkey",
    "saved_pages": """WITH p AS (SELECT page_id % 40 AS book, page_id, CASE WHEN page_id % 2 = 0 THEN '' ELSE trim(url) END AS text, ['none', 'new', 'existing'][page_id % 3 + 1] AS mode FROM pages), k AS (SELECT * FROM p WHERE text <> '' OR mode <> 'none')
SELECT book, page_id, text, mode, CASE WHEN mode <> 'none' THEN 'img' || page_id END AS image, CASE WHEN mode <> 'none' THEN 'z' END AS zones, row_number() OVER w - 1 AS page, first_value(mode = 'new') OVER w AS cover_new, mode = 'none' AS plain FROM k WINDOW w AS (PARTITION BY book ORDER BY page_id)""",
    "access_state": "SELECT c_custkey, CASE WHEN c_custkey % 5 < 2 THEN 'not-configured' WHEN c_custkey % 7 > 0 AND c_mktsegment = 'BUILDING' THEN 'ok' ELSE 'wrong' END AS state FROM customer",
    "photo_kinds": "SELECT page_id, page_id % 4 < 2 OR page_id % 5 = 0 AS heic, page_id % 3 = 0 AND url IS NOT NULL AS data_image FROM pages",
    "membership": "SELECT p_partkey, len(list_filter(w, lambda x: length(x) > 5)) > 0 AS some_long, list_contains(w, 'Part#' || p_partkey) AS own_name, len(list_filter(w, lambda x: starts_with(x, 'P'))) > 0 AS a_p FROM (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part)",
    "balloon_phrases": f"""SELECT p_partkey, CASE WHEN sound IS NULL THEN 'Bravo ! C''est ' || name || ' !' ELSE 'Bravo ! ' || name || ' fait ' || sound || ' !' END AS right, CASE WHEN sound IS NULL THEN 'C''est ' || name ELSE name || ' fait ' || sound END AS wrong
FROM (VALUES {', '.join(f"({i}::BIGINT, {_q(n)}, {_q(s)})" for i, (_, n, s) in enumerate(T.BALLOONS))}) t(ord, name, sound) JOIN part ON ord = p_partkey % {len(T.BALLOONS)}""",
    "book_ids": "SELECT event_id, 'book-' || epoch_us(ts) // 1000 || '-' || lower(to_base(('0x' || md5(event_id || '|' || user_id)[1:12])::BIGINT, 36)) AS id FROM events",
    "epoch_ms": "SELECT event_id, epoch_us(ts) // 1000 AS ms, true AS past FROM events",
    "random_values": f"SELECT p_partkey, 1 + floor({_unit('n')} * 3)::INT AS n, round(CASE WHEN abs(v) < 45 THEN CASE WHEN v < 0 THEN -55 ELSE 55 END ELSE v END, 6) AS velocity FROM (SELECT p_partkey, ({_unit('vel')} - 0.5) * 150 AS v FROM part)",
    "migrated_books": _SOURCES + """SELECT 'book-' || md5(length(title) || ':' || title || '7:#FFD93C' || string_agg(length(text) || ':' || text || CASE WHEN shown THEN '1:i' ELSE '-' END, '' ORDER BY turn, text)) AS id, title, '#FFD93C' AS accent, count(*)::INT AS n_pages, string_agg(CASE WHEN shown THEN 'i' ELSE '-' END, '' ORDER BY turn, text) AS images, count(*) FILTER (NOT shown)::INT AS plain, CASE WHEN kind = 1 THEN 'c' END AS coverThumb FROM c WHERE conv_id % 5 > 0 GROUP BY conv_id, kind, title""",
    "source_elements": _SOURCES + "SELECT DISTINCT conv_id, 0::INT AS pos, CASE WHEN conv_id % 5 > 0 THEN title END AS title FROM c WHERE kind = 0",
    "listed_turns": "SELECT conv_id, turn, role, text FROM conversations",
}
