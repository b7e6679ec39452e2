"""Queries of texts, matching, sampling, positions and geometry."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions import text as X, values as V
from ..operators import matching as M, positional as P, sampling as S
from ..sources.literals import BODY_PARTS, CHARACTERS, CONFLICTS, DEFAULT_CHARACTER, DEFAULT_LABEL, PROP_LABELS
from ..sources.tables import table

PARTS = tuple(p[0] for p in BODY_PARTS)
SPACE_SQL = X.SPACES


def all_zone_hits(spark, d):
    """Hits of every zone that has any; ``word_zone_hits`` is its twenty largest."""
    return M.word_zone_hits(table(spark, d, "documents"), table(spark, d, "benchmark").withColumnRenamed("text", "label"), "text", "item_id", "label")


def word_zone_hits(spark, d):
    return all_zone_hits(spark, d).orderBy(F.desc("hits"), "item_id").limit(20)


def _marked(spark, d):
    """Documents with each comma as a token of its own."""
    return table(spark, d, "documents").select("doc_id", F.regexp_replace("text", ",", " ,").alias("text"))


def tokenize(spark, d):
    return _marked(spark, d).select("doc_id", F.posexplode(X.tokenize(F.col("text"))).alias("pos", "word")).withColumn("pos", F.col("pos").cast("long"))


def spoken_word(spark, d):
    return tokenize(spark, d).select("doc_id", "pos", X.spoken(F.col("word")).alias("spoken"))


def normalize_word(spark, d):
    return M.counted_words(_marked(spark, d), "text")


def _foreign(spark, d):
    """Documents with no-break spaces, quotes, and letters from beyond Latin-1."""
    t = F.col("text")
    for old, new in ((" de ", "\u00a0! "), (" la ", "\u202f? "), (", ", ",\u2003« "), (". ", "\u201d. "), ("o", "ő"), ("c", "Č"), ("s", "ș"), ("i", "İ")):
        t = F.replace(t, F.lit(old), F.lit(new))
    return table(spark, d, "documents").select("doc_id", t.alias("text"))


def tokenize_foreign(spark, d):
    return _foreign(spark, d).select("doc_id", F.posexplode(X.tokenize(F.col("text"))).alias("pos", "word")).select("doc_id", F.col("pos").cast("long").alias("pos"), X.spoken(F.col("word")).alias("spoken"))


def normalize_foreign(spark, d):
    return M.counted_words(_foreign(spark, d), "text")


def words_of_labels(spark, d):
    """Words of labels split at any white space."""
    return _foreign(spark, d).select("doc_id", F.size(X.split_space(F.col("text"))).alias("words"))


def data_url_decode(spark, d):
    """URLs made of parts' names: of two kinds of image, without a kind, and no data URLs."""
    b = F.base64(F.encode("p_name", "utf-8"))
    kinds = {0: F.concat(F.lit("data:image/png;base64,"), b), 1: F.concat(F.lit("http://"), b), 2: F.concat(F.lit("data:;base64,"), b), 3: F.concat(F.lit("data:image/jpeg;base64,"), b)}
    url = F.lit(None).cast("string")
    for k, u in kinds.items():
        url = F.when(F.col("p_partkey") % 5 == k, u).otherwise(url)
    rows = table(spark, d, "part").select("p_partkey", url.alias("url"))
    mime = X.data_url_mime(F.col("url"))
    return rows.select("p_partkey", mime.alias("mime"), X.data_url_bytes(F.col("url")).cast("string").alias("payload"), X.image_extension(mime).alias("ext"))


def data_url_lenient(spark, d):
    """Payloads of URLs made from texts: lines, marks and padding that strict decoding refuses."""
    # Replaced as a whole: translate makes a string of every character.
    swap = lambda c, old, new: F.replace(c, F.lit(old), F.lit(new))
    b = swap(F.base64(F.encode("text", "utf-8")), "\r\n", "")
    broken = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("data:image/png,x;base64,"), F.regexp_replace(b, "(.{7})", "$1 *"))).when(F.col("doc_id") % 4 == 1, F.concat(F.lit("data:a/b;base64,"), swap(swap(F.rtrim(b, F.lit("=")), "+", "-"), "/", "_"))).when(F.col("doc_id") % 4 == 2, F.lit("data:text/plain;base64,")).otherwise(F.concat(F.lit("data:;base64,"), b))
    u = table(spark, d, "documents").select("doc_id", broken.alias("url"))
    return u.select("doc_id", X.data_url_mime(F.col("url")).alias("mime"), F.hex(X.data_url_bytes(F.col("url"))).alias("payload"))


def url_rewrite(spark, d):
    p = table(spark, d, "pages").select("page_id", "url")
    return p.select("page_id", X.embed_link(F.regexp_replace("url", "example", "Open.example"), "open.example.org").alias("link"), F.when(F.col("url").rlike(r"(?i)example\.org"), "embed").otherwise("audio").alias("type"))


def replace_first_fill(spark, d):
    return table(spark, d, "part").select("p_partkey", X.replace_first(F.format_string('<p fill="%s" id="%s"/><q fill="none"/>', "p_brand", "p_partkey"), 'fill="[^"]+"', 'fill="#123456"').alias("svg"))


def phrases(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_name", "p_size")
    word = F.when(F.col("p_size") == 1, "un").when(F.col("p_size") == 2, "deux").otherwise(F.col("p_size").cast("string"))
    return p.select("p_partkey", F.when(F.col("p_size") % 3 == 0, F.format_string("%s ! il fait %s", "p_name", word)).otherwise(F.format_string("%s !", "p_name")).alias("phrase"), X.key_of(F.col("p_size"), F.col("p_partkey")).alias("key"))


def url_keys(spark, d):
    return table(spark, d, "customer").select("c_custkey", X.url_component(F.concat_ws(" ", "c_name", "c_mktsegment")).alias("key"))


def colour_mix(spark, d):
    c = F.concat(F.lit("#"), F.lpad(F.lower(F.hex((F.col("p_partkey") * 7919) % 16777216)), 6, "0"))
    return table(spark, d, "part").select("p_partkey", V.mix(c, F.lit("#fff"), 0.55).alias("light"))


def fit_dimensions(spark, d):
    w, h = V.fit(F.col("l_partkey") + 1, F.col("l_suppkey") + F.col("l_quantity").cast("long"), 1000)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", w.alias("w"), h.alias("h"))


def label_lookup_default(spark, d):
    keys = F.element_at(F.array(*map(F.lit, [*PROP_LABELS, "🪁"])), (F.col("n_nationkey") * 5 % (len(PROP_LABELS) + 1) + 1).cast("int"))
    labels = spark.createDataFrame(list(PROP_LABELS.items()), "emoji string, label string")
    return M.label_or_default(table(spark, d, "nation").select("n_nationkey", keys.alias("emoji")), labels, "emoji", DEFAULT_LABEL).select("n_nationkey", "label")


# Rules in order, and the default.
CHAIN = (("1", "le lapin"), ("12", "la poule"), ("3", "le renard"), ("5", "Nounours"))


def first_match_label(spark, d):
    return table(spark, d, "part").select("p_partkey", M.first_match(F.col("p_name"), list(CHAIN), "le personnage").alias("label"))


def character_label(spark, d):
    """Labels of two characters side by side: the first rule that fits counts, not the first character."""
    who = F.array(*map(F.lit, [e for e, _ in CHARACTERS] + ["🐭"]))
    at = lambda k: F.element_at(who, (F.pmod(k, F.lit(len(CHARACTERS) + 1)) + 1).cast("int"))
    both = F.concat(at(F.col("p_partkey")), at(F.floor(F.col("p_partkey") / 9)))
    return table(spark, d, "part").select("p_partkey", both.alias("character"), M.first_match(both, list(CHARACTERS), DEFAULT_CHARACTER).alias("label"))


def semi_customers(spark, d):
    return table(spark, d, "customer").select("c_custkey").join(table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi")


def anti_customers(spark, d):
    return table(spark, d, "customer").select("c_custkey").filter("c_custkey <> 7").join(table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


def family_others(spark, d):
    """For each region the nations of all others. Regions are a handful; each nation is written down for the others of them."""
    regions = F.array(*(F.lit(r[0]) for r in table(spark, d, "region").select("r_regionkey").distinct().collect()))
    n = table(spark, d, "nation")
    return n.select(F.explode(F.array_except(regions, F.array("n_regionkey"))).alias("family"), F.col("n_name").alias("item"), F.lit(False).alias("is_target"))


def zip_positional(spark, d):
    n = table(spark, d, "nation")
    colours = F.array(*map(F.lit, ("#ff6b6b", "#4ecdc4", "#ffe66d")))
    # Only the first three of a region are kept, before the shuffle too.
    place = F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_name"))
    return n.withColumn("place", place).filter("place <= 3").select("n_regionkey", F.col("n_name").alias("names"), F.element_at(colours, F.col("place")).alias("colours"))


def modular_lookup(spark, d):
    return M.modular_lookup(table(spark, d, "part").select("p_partkey"), "p_partkey", ["a", "b", "c", "d", "e"])


def grid_neighbours(spark, d):
    """Boards of two to five rows and two to four columns, one for each part."""
    boards = M.grid(table(spark, d, "part").select("p_partkey", "p_size"), F.lit(2) + F.col("p_size") % 4, F.lit(2) + F.col("p_size") % 3)
    own = F.when((F.col("r") * 7 + F.col("c") * 3 + F.col("p_partkey")) % 5 < 2, 1).otherwise(-1)
    return M.edge_signs(boards, own, "p_partkey").select("p_partkey", "r", "c", *(F.col(x).cast("long").alias(x) for x in ("top", "right", "bottom", "left")))


def greedy_independent(spark, d):
    """For each nation a target and the parts shown with it."""
    n = table(spark, d, "nation").select("n_nationkey", F.element_at(F.array(*map(F.lit, PARTS)), (F.col("n_nationkey") % len(PARTS) + 1).cast("int")).alias("target"))
    order = F.transform(F.array_sort(F.transform(F.array(*map(F.lit, PARTS)), lambda p: F.struct(F.md5(F.concat_ws("|", F.col("n_nationkey").cast("string"), p)).alias("h"), p.alias("p")))), lambda x: x["p"])
    return n.select("n_nationkey", F.array_join(M.round_parts(n, "target", order, CONFLICTS, 4), ",").alias("chosen"))


def page_ordinals(spark, d):
    return P.ordinals(table(spark, d, "conversations").select("conv_id", "turn"), "conv_id", "turn")


def next_prev_wrap(spark, d):
    return P.next_and_previous(table(spark, d, "conversations").select("conv_id", "turn"), "conv_id", "turn", "turn")


def play_previous(spark, d):
    """As ``play_next_url``, with the song before."""
    return P.play_next(table(spark, d, "events").select("user_id", "event_id", F.col("props").alias("url")), "user_id", "url", "event_id").select("user_id", "url", "preceding", "following")


def play_next_url(spark, d):
    """Each distinct url of a user at its first position, with the one after it."""
    return P.play_next(table(spark, d, "events").select("user_id", "event_id", F.col("props").alias("url")), "user_id", "url", "event_id").select("user_id", "url", F.col("position").cast("long").alias("position"), "following")


def sample_n(spark, d):
    return S.sample_n(table(spark, d, "part").select("p_partkey", "p_brand"), "p_partkey", 40, "s1")


def pick_with_must(spark, d):
    return S.sample_with(table(spark, d, "part").select("p_partkey", "p_size"), "p_partkey", F.col("p_partkey") == 17, 6, "s2").select("p_partkey", "p_size")


def pick_with_must_shuffled(spark, d):
    """One row of several that may be meant, others that are none of them, and their order."""
    return S.sample_with(table(spark, d, "part").select("p_partkey", "p_size"), "p_partkey", F.col("p_size") == 17, 6, "s2")


def pick_other(spark, d):
    p = table(spark, d, "part").select("p_brand", "p_partkey")
    return S.pick_other(p.groupBy("p_brand").agg(F.min_by("p_partkey", F.md5(F.concat_ws("|", F.lit("s3"), F.col("p_partkey").cast("string")))).alias("previous")), p, "p_brand", "p_partkey", "previous", "s3")


def pick_with_replacement(spark, d):
    return table(spark, d, "customer").select("c_custkey", S.pick_with_replacement(F.col("c_custkey"), ["a", "b", "c"], "s4").alias("picked"))


def round_options(spark, d):
    return S.first_of_group(table(spark, d, "part").select("p_brand", "p_partkey"), "p_brand", "p_partkey", 3, "s5").select("p_brand", "p_partkey", F.col("place").cast("long").alias("place"))


def preference_pick(spark, d):
    rank = F.when(F.col("lang") == "fr", 0).when(F.col("lang").isin("es", "de"), 1).otherwise(2).cast("long")
    return S.preferred(table(spark, d, "documents").select("source", "lang", "doc_id"), "source", rank, "doc_id")


def _pieces(spark, d):
    """For each supplier the pieces of a board of 4 by 3 cells on a square of 400, with seeded signs of their edges."""
    own = F.when(F.pmod(F.col("r") * 7 + F.col("c") * 3 + F.col("s_suppkey"), F.lit(5)) < 2, 1).otherwise(-1)
    g = M.edge_signs(M.grid(table(spark, d, "supplier").select("s_suppkey"), F.lit(3), F.lit(4)), own, "s_suppkey")
    # Signs of an edge are given downwards and to the right, alike for both pieces that share it.
    signs = {"top": -F.col("top"), "bottom": F.col("bottom"), "left": -F.col("left"), "right": F.col("right")}
    return g.select("s_suppkey", "r", "c", V.piece_shape(F.col("r"), F.col("c"), signs, 100.0, 400 / 3).alias("s"))


def jigsaw_ring(spark, d):
    """Every point of each piece's outline."""
    return _pieces(spark, d).select("s_suppkey", "r", "c", F.posexplode("s.ring").alias("pos", "p")).select("s_suppkey", "r", "c", F.col("pos").cast("long").alias("pos"), F.round("p.x", 6).alias("x"), F.round("p.y", 6).alias("y"))


def jigsaw_pieces(spark, d):
    """Key, path, box and home of each piece."""
    b = [F.round(F.col(f"s.box.{c}"), 6).alias(c) for c in "xywh"]
    return _pieces(spark, d).select("s_suppkey", X.key_of(F.col("r"), F.col("c")).alias("id"), V.path_of(F.col("s.ring")).alias("d"), *b, F.round("s.home.x", 6).alias("home_x"), F.round("s.home.y", 6).alias("home_y"))


def fixed_decimals(spark, d):
    l = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") * (F.col("l_discount") - 0.05) / 7).alias("x"))
    return l.select("l_orderkey", "l_linenumber", X.fixed(F.col("x"), 2).alias("two"), X.fixed(F.col("x"), 1).alias("one"))


def layer_delays(spark, d):
    """Where a layer of zones lies on its page, and the delays of list items, balloons and props."""
    l = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_partkey", "l_suppkey")
    rect = lambda *v: F.struct(*(x.cast("double").alias(n) for x, n in zip(v, ("left", "top", "width", "height"))))
    layer = V.zone_layer(rect(F.col("l_partkey"), F.col("l_suppkey"), F.col("l_quantity"), F.col("l_quantity") * 2), rect(F.lit(10), F.col("l_quantity"), F.lit(1), F.lit(1)))
    box = V.rectangle(F.col("l_partkey"), F.col("l_suppkey"), F.col("l_suppkey"), F.col("l_quantity").cast("long"))
    n = F.col("l_linenumber")
    return l.select("l_orderkey", "l_linenumber", layer.alias("z"), box.alias("b"), F.round(V.stagger(n * 3), 6).alias("stagger"), F.round(V.sway(F.col("l_partkey")), 6).alias("sway"), F.round(V.fade_in(n), 6).alias("fade")).select("l_orderkey", "l_linenumber", "z.left", "z.top", "z.width", "z.height", F.col("b.left").alias("box_left"), F.col("b.width").alias("box_width"), F.col("b.height").alias("box_height"), "stagger", "sway", "fade")


def easing(spark, d):
    """Events as moments of a movement of forty steps."""
    s = table(spark, d, "events").select("event_id", (F.col("event_id") % 41).alias("id")).withColumn("t", F.col("id") / 40.0)
    return s.select("event_id", F.round(V.ease_out_back(F.col("t")), 6).alias("ease"), F.round(F.sin(F.col("t")) * 4.0, 6).alias("bob"), F.least(F.col("id"), F.lit(10)).cast("double").alias("steps"), V.percent_of(F.col("id") * 5.0, F.lit(20.0), F.lit(120.0)).alias("pct"), V.placed(F.col("t"), F.lit(2.0), F.lit(1.0)).alias("at"))


QUERIES = {f.__name__: f for f in (word_zone_hits, all_zone_hits, tokenize, spoken_word, normalize_word, tokenize_foreign, normalize_foreign, words_of_labels, data_url_decode, data_url_lenient, url_rewrite, replace_first_fill, phrases, url_keys, colour_mix, fit_dimensions, label_lookup_default, first_match_label, character_label, semi_customers, anti_customers, family_others, zip_positional, modular_lookup, grid_neighbours, greedy_independent, page_ordinals, next_prev_wrap, play_next_url, play_previous, sample_n, pick_with_must, pick_with_must_shuffled, pick_other, pick_with_replacement, round_options, preference_pick, jigsaw_ring, jigsaw_pieces, fixed_decimals, layer_delays, easing)}

_TOKENS = r"""WITH t AS (SELECT doc_id, unnest(w) AS tok, generate_subscripts(w, 1) AS i FROM (SELECT doc_id, regexp_extract_all({0}, '[^{1}]+') AS w FROM documents)),
g AS (SELECT *, sum(CASE WHEN regexp_full_match(tok, '[!?.,;:…]+') AND i > 1 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos FROM t),
k AS (SELECT doc_id, pos::BIGINT AS pos, string_agg(tok, ' ' ORDER BY i) AS word FROM g GROUP BY doc_id, pos) """
_MARKED = _TOKENS.format("replace(text, ',', ' ,')", SPACE_SQL)
_FOREIGN = "replace(replace(replace(replace(replace(replace(replace(replace(text, ' de ', chr(160) || '! '), ' la ', chr(8239) || '? '), ', ', ',' || chr(8195) || '« '), '. ', chr(8221) || '. '), 'o', 'ő'), 'c', 'Č'), 's', 'ș'), 'i', 'İ')"
_SPOKEN = rf"coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(regexp_replace(word, '^[!?.,;:…«»\"''“”]+', ''), '[!?.,;:…«»\"''“”]+$', ''), '^[{SPACE_SQL}]+', ''), '[{SPACE_SQL}]+$', ''), ''), word)"
_PIECES = """WITH g AS (SELECT s_suppkey AS k, r, c, CASE WHEN (r * 7 + c * 3 + s_suppkey) % 5 < 2 THEN 1 ELSE -1 END AS s FROM supplier, range(3) a(r), range(4) b(c)),
e AS (SELECT g.k, g.r, g.c, CASE WHEN g.r = 0 THEN 0 ELSE up.s END AS top, CASE WHEN g.r = 2 THEN 0 ELSE g.s END AS bottom, CASE WHEN g.c = 0 THEN 0 ELSE -before.s END AS "left", CASE WHEN g.c = 3 THEN 0 ELSE -g.s END AS "right",
  g.c * 100.0::DOUBLE AS x, g.r * (400.0::DOUBLE / 3) AS y, 400.0::DOUBLE / 3 AS h FROM g LEFT JOIN g up ON up.k = g.k AND up.r = g.r - 1 AND up.c = g.c LEFT JOIN g before ON before.k = g.k AND before.r = g.r AND before.c = g.c - 1),
-- side, place along the edge, sign, start, direction, length, across
s AS (SELECT k, r, c, 0 AS side, top AS sign, x AS ax, y AS ay, 100.0::DOUBLE AS dx, 0.0::DOUBLE AS dy, 0 AS qx, 1 AS qy FROM e UNION ALL SELECT k, r, c, 1, "right", x + 100, y, 0, h, 1, 0 FROM e
 UNION ALL SELECT k, r, c, 2, bottom, x, y + h, 100, 0, 0, 1 FROM e UNION ALL SELECT k, r, c, 3, "left", x, y, 0, h, 1, 0 FROM e),
p AS (SELECT *, i / 18.0::DOUBLE AS t, CASE WHEN side < 2 THEN i ELSE 18 - i END AS along FROM s, range(19) n(i) WHERE sign <> 0 OR i IN (0, 18)),
q AS (SELECT *, CASE WHEN sign <> 0 AND t > 0.34 AND t < 0.66 THEN sign * 0.22 * (dx + dy) * 0.5 * (1 - cos(2 * pi() * ((t - 0.34) / (0.66 - 0.34)))) ELSE 0 END AS off FROM p WHERE NOT (side > 0 AND along = 0) AND NOT (side = 3 AND along = 18)),
o AS (SELECT k AS s_suppkey, r::BIGINT AS r, c::BIGINT AS c, row_number() OVER (PARTITION BY k, r, c ORDER BY side, along) - 1 AS pos, ax + dx * t + qx * off AS x, ay + dy * t + qy * off AS y FROM q) """
_NORMAL = "regexp_replace(strip_accents(lower(word)), '[^a-z0-9]', '', 'g')"
_EDGES = ", ".join(f"'{a}|{b}'" for a, bs in CONFLICTS.items() for b in bs)
_list = lambda xs: "[" + ", ".join("'" + str(x).replace("'", "''") + "'" for x in xs) + "]"
SQL = {
    "word_zone_hits": rf"""WITH w AS (SELECT regexp_replace(strip_accents(lower(x)), '[^a-z0-9]', '', 'g') AS word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[^\s\x0B]+')) AS x FROM documents) GROUP BY 1),
z AS (SELECT DISTINCT item_id, regexp_replace(strip_accents(lower(x)), '[^a-z0-9]', '', 'g') AS word FROM (SELECT item_id, unnest(regexp_extract_all(text, '[^\s\x0B]+')) AS x FROM benchmark))
SELECT item_id, sum(n)::BIGINT AS hits FROM z JOIN w USING (word) WHERE length(word) >= 3 GROUP BY item_id ORDER BY hits DESC, item_id LIMIT 20""",
    "all_zone_hits": rf"""WITH w AS (SELECT regexp_replace(strip_accents(lower(x)), '[^a-z0-9]', '', 'g') AS word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[^\s\x0B]+')) AS x FROM documents) GROUP BY 1),
z AS (SELECT DISTINCT item_id, regexp_replace(strip_accents(lower(x)), '[^a-z0-9]', '', 'g') AS word FROM (SELECT item_id, unnest(regexp_extract_all(text, '[^\s\x0B]+')) AS x FROM benchmark))
SELECT item_id, sum(n)::BIGINT AS hits FROM z JOIN w USING (word) WHERE length(word) >= 3 GROUP BY item_id""",
    "tokenize": _MARKED + "SELECT * FROM k",
    "spoken_word": _MARKED + f"SELECT doc_id, pos, {_SPOKEN} AS spoken FROM k",
    "normalize_word": _MARKED + f"SELECT {_NORMAL} AS word, count(*)::BIGINT AS count FROM k GROUP BY 1",
    "tokenize_foreign": _TOKENS.format(_FOREIGN, SPACE_SQL) + f"SELECT doc_id, pos, {_SPOKEN} AS spoken FROM k",
    "normalize_foreign": _TOKENS.format(_FOREIGN, SPACE_SQL) + f"SELECT {_NORMAL} AS word, count(*)::BIGINT AS count FROM k GROUP BY 1",
    "words_of_labels": f"SELECT doc_id, len(regexp_split_to_array({_FOREIGN}, '[{SPACE_SQL}]+'))::INT AS words FROM documents",
    "data_url_lenient": """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'image/png,x' WHEN 1 THEN 'a/b' WHEN 2 THEN 'text/plain' END AS mime, CASE WHEN doc_id % 4 < 2 THEN hex(encode(text)) WHEN doc_id % 4 = 2 THEN '' END AS payload FROM documents""",
    "character_label": f"""SELECT p_partkey, ch AS "character", CASE {' '.join("WHEN contains(ch, '%s') THEN '%s'" % (e, n.replace("'", "''")) for e, n in CHARACTERS)} ELSE '{DEFAULT_CHARACTER}' END AS label
FROM (SELECT p_partkey, {_list([*(e for e, _ in CHARACTERS), '🐭'])}[p_partkey % 9 + 1] || {_list([*(e for e, _ in CHARACTERS), '🐭'])}[(p_partkey // 9) % 9 + 1] AS ch FROM part)""",
    "play_previous": "SELECT user_id, url, preceding, following FROM (SELECT user_id, props AS url, lag(props) OVER (PARTITION BY user_id ORDER BY event_id) AS preceding, lead(props) OVER (PARTITION BY user_id ORDER BY event_id) AS following, row_number() OVER (PARTITION BY user_id, props ORDER BY event_id) AS n FROM events) WHERE n = 1",
    "pick_with_must_shuffled": """WITH f AS (SELECT * FROM (SELECT p_partkey, p_size FROM part WHERE p_size = 17 ORDER BY md5('s2|' || p_partkey), p_partkey LIMIT 1)), o AS (SELECT p_partkey, p_size FROM part WHERE p_size <> 17 ORDER BY md5('s2|' || p_partkey), p_partkey LIMIT 6),
a AS (SELECT * FROM (SELECT *, 0 AS k FROM f UNION ALL SELECT *, 1 FROM o) ORDER BY k, md5('s2|' || p_partkey), p_partkey LIMIT 6) SELECT p_partkey, p_size, row_number() OVER (ORDER BY md5('s2|again|' || p_partkey), p_partkey) AS place FROM a""",
    "jigsaw_pieces": _PIECES + """SELECT s_suppkey, r || '-' || c AS id, 'M' || string_agg(printf('%.2f', x) || ' ' || printf('%.2f', y), ' L' ORDER BY pos) || ' Z' AS d, round(c * 100 - (0.22 * (400.0::DOUBLE / 3) + 2), 6) AS x, round(r * (400.0::DOUBLE / 3) - (0.22 * (400.0::DOUBLE / 3) + 2), 6) AS y,
 round(100 + 2 * (0.22 * (400.0::DOUBLE / 3) + 2), 6) AS w, round(400.0::DOUBLE / 3 + 2 * (0.22 * (400.0::DOUBLE / 3) + 2), 6) AS h, c * 100 + 50.0::DOUBLE AS home_x, round(r * (400.0::DOUBLE / 3) + 400.0::DOUBLE / 6, 6) AS home_y FROM o GROUP BY s_suppkey, r, c""",
    # Only eighths and quarters are ties in binary; they go away from zero.
    "fixed_decimals": "SELECT l_orderkey, l_linenumber, printf('%.2f', x + CASE WHEN x * 8 = floor(x * 8) AND (x * 8)::BIGINT % 2 <> 0 THEN sign(x) * 0.001 ELSE 0 END) AS two, printf('%.1f', x + CASE WHEN x * 4 = floor(x * 4) AND (x * 4)::BIGINT % 2 <> 0 THEN sign(x) * 0.01 ELSE 0 END) AS one FROM (SELECT *, l_extendedprice * (l_discount - 0.05::DOUBLE) / 7 AS x FROM lineitem)",
    "layer_delays": """SELECT l_orderkey, l_linenumber, l_partkey - 10.0::DOUBLE AS "left", l_suppkey - l_quantity AS top, l_quantity AS width, l_quantity * 2 AS height, least(l_partkey, l_suppkey) AS box_left, abs(l_suppkey - l_partkey) AS box_width, abs(l_quantity::BIGINT - l_suppkey) AS box_height,
 round(least(l_linenumber * 3, 10) * 0.05::DOUBLE, 6) AS stagger, round((l_partkey % 6) * 0.35::DOUBLE, 6) AS sway, round(0.2::DOUBLE + l_linenumber * 0.15::DOUBLE, 6) AS fade FROM lineitem""",
    "url_rewrite": r"SELECT page_id, CASE WHEN contains(u, 'Open.example.org/') THEN split_part(replace(u, 'Open.example.org/', 'open.example.org/embed/'), '?', 1) ELSE u END AS link, CASE WHEN regexp_matches(url, '(?i)example\.org') THEN 'embed' ELSE 'audio' END AS type FROM (SELECT page_id, url, replace(url, 'example', 'Open.example') AS u FROM pages)",
    "replace_first_fill": "SELECT p_partkey, '<p fill=\"#123456\" id=\"' || p_partkey || '\"/><q fill=\"none\"/>' AS svg FROM part",
    "phrases": "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_name || ' ! il fait ' || CASE p_size WHEN 1 THEN 'un' WHEN 2 THEN 'deux' ELSE p_size::VARCHAR END ELSE p_name || ' !' END AS phrase, p_size || '-' || p_partkey AS key FROM part",
    "url_keys": "SELECT c_custkey, url_encode(c_name || ' ' || c_mktsegment) AS key FROM customer",
    "colour_mix": "SELECT p_partkey, '#' || " + " || ".join(f"lpad(lower(to_hex(floor(((c // {s}) % 256) + (255 - ((c // {s}) % 256)) * 0.55::DOUBLE + 0.5)::BIGINT)), 2, '0')" for s in (65536, 256, 1)) + " AS light FROM (SELECT p_partkey, (p_partkey * 7919) % 16777216 AS c FROM part)",
    "fit_dimensions": "SELECT l_orderkey, l_linenumber, CASE WHEN m > 1000 THEN floor(w * 1000::DOUBLE / m + 0.5) ELSE w END::BIGINT AS w, CASE WHEN m > 1000 THEN floor(h * 1000::DOUBLE / m + 0.5) ELSE h END::BIGINT AS h FROM (SELECT *, greatest(w, h) AS m FROM (SELECT l_orderkey, l_linenumber, l_partkey + 1 AS w, l_suppkey + l_quantity::BIGINT AS h FROM lineitem))",
    "label_lookup_default": f"SELECT n_nationkey, coalesce(list_extract({_list(PROP_LABELS.values())}, (n_nationkey * 5 % {len(PROP_LABELS) + 1} + 1)::INT), '{DEFAULT_LABEL}') AS label FROM nation",
    "first_match_label": "SELECT p_partkey, CASE " + " ".join(f"WHEN contains(p_name, '{a}') THEN '{b}'" for a, b in CHAIN) + " ELSE 'le personnage' END AS label FROM part",
    "semi_customers": "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
    "anti_customers": "SELECT c_custkey FROM customer WHERE c_custkey <> 7 AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')",
    "zip_positional": "SELECT n_regionkey, n_name AS names, ['#ff6b6b', '#4ecdc4', '#ffe66d'][r] AS colours FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) AS r FROM nation) WHERE r <= 3",
    "modular_lookup": "SELECT p_partkey, ['a', 'b', 'c', 'd', 'e'][p_partkey % 5 + 1] AS picked FROM part",
    "grid_neighbours": """WITH b AS (SELECT p_partkey, 2 + p_size % 4 AS nr, 2 + p_size % 3 AS nc FROM part), k AS (SELECT *, unnest(range(nr)) AS r FROM b), l AS (SELECT *, unnest(range(nc)) AS c FROM k),
g AS (SELECT *, CASE WHEN (r * 7 + c * 3 + p_partkey) % 5 < 2 THEN 1 ELSE -1 END AS s FROM l),
e AS (SELECT p_partkey, r, c, CASE WHEN r = nr - 1 THEN 0 ELSE s END AS bottom, CASE WHEN c = nc - 1 THEN 0 ELSE -s END AS "right" FROM g)
SELECT p_partkey, r, c, coalesce(-lag(bottom) OVER (PARTITION BY p_partkey, c ORDER BY r), 0)::BIGINT AS top, "right"::BIGINT AS "right", bottom::BIGINT AS bottom, coalesce(-lag("right") OVER (PARTITION BY p_partkey, r ORDER BY c), 0)::BIGINT AS "left" FROM e""",
    "greedy_independent": f"""WITH RECURSIVE t AS (SELECT n_nationkey, {_list(PARTS)}[n_nationkey % {len(PARTS)} + 1] AS target FROM nation),
o AS (SELECT n_nationkey, p, row_number() OVER (PARTITION BY n_nationkey ORDER BY md5(n_nationkey || '|' || p)) AS i FROM t, (SELECT unnest({_list(PARTS)}) AS p) WHERE p <> target AND NOT list_contains([{_EDGES}], target || '|' || p)),
f(n_nationkey, i, chosen) AS (SELECT n_nationkey, 0::BIGINT, [target] FROM t UNION ALL
  SELECT f.n_nationkey, o.i, CASE WHEN len(chosen) < 4 AND len(list_filter(chosen, lambda y: list_contains([{_EDGES}], o.p || '|' || y))) = 0 THEN list_append(chosen, o.p) ELSE chosen END FROM f JOIN o ON o.n_nationkey = f.n_nationkey AND o.i = f.i + 1)
SELECT n_nationkey, array_to_string(arg_max(chosen, i), ',') AS chosen FROM f GROUP BY n_nationkey""",
    "page_ordinals": "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS page, count(*) OVER (PARTITION BY conv_id) AS pages FROM conversations",
    "next_prev_wrap": "SELECT conv_id, turn, coalesce(lead(turn) OVER w, first_value(turn) OVER w) AS following, coalesce(lag(turn) OVER w, turn) AS previous FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)",
    "play_next_url": "SELECT user_id, url, position, following FROM (SELECT user_id, url, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS position, lead(url) OVER (PARTITION BY user_id ORDER BY event_id) AS following, row_number() OVER (PARTITION BY user_id, url ORDER BY event_id) AS n FROM (SELECT user_id, event_id, props AS url FROM events)) WHERE n = 1",
    "sample_n": "SELECT p_partkey, p_brand FROM part ORDER BY md5('s1|' || p_partkey), p_partkey LIMIT 40",
    "pick_with_must": "SELECT p_partkey, p_size FROM part ORDER BY p_partkey <> 17, md5('s2|' || p_partkey), p_partkey LIMIT 6",
    "pick_other": "SELECT p_brand, min(p_partkey) FILTER (r = 1) AS previous, coalesce(min(p_partkey) FILTER (r = 2), min(p_partkey) FILTER (r = 1)) AS picked FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY md5('s3|' || p_partkey)) AS r FROM part) GROUP BY p_brand",
    "pick_with_replacement": "SELECT c_custkey, ['a', 'b', 'c'][('0x' || md5('s4|' || c_custkey)[1:8])::BIGINT % 3 + 1] AS picked FROM customer",
    "round_options": "SELECT * FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY md5('s5|' || p_partkey), p_partkey) AS place FROM part) WHERE place <= 3",
    "preference_pick": "SELECT source, arg_min(doc_id, (r, doc_id)) AS doc_id, min(r) AS rank FROM (SELECT source, doc_id, CASE WHEN lang = 'fr' THEN 0 WHEN lang IN ('es', 'de') THEN 1 ELSE 2 END::BIGINT AS r FROM documents) GROUP BY source",
    "data_url_decode": """WITH u AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'data:image/png;base64,' WHEN 1 THEN 'http://' WHEN 2 THEN 'data:;base64,' WHEN 3 THEN 'data:image/jpeg;base64,' END || base64(encode(p_name)) AS url FROM part),
m AS (SELECT p_partkey, url, nullif(regexp_extract(coalesce(url, ''), '^data:([^;]+);base64,', 1), '') AS mime FROM u)
SELECT p_partkey, mime, CASE WHEN mime IS NOT NULL THEN decode(from_base64(split_part(url, 'base64,', 2))) END AS payload, CASE WHEN mime = 'image/png' THEN 'png' ELSE 'jpg' END AS ext FROM m""",
    "family_others": "SELECT r_regionkey AS family, n_name AS item, false AS is_target FROM nation JOIN region ON r_regionkey <> n_regionkey",
    "jigsaw_ring": _PIECES + "SELECT s_suppkey, r, c, pos, round(x, 6) AS x, round(y, 6) AS y FROM o",
    "easing": "SELECT event_id, round(1.0 + 2.70158 * pow(t - 1.0, 3) + 1.70158 * pow(t - 1.0, 2), 6) AS ease, round(sin(t) * 4.0, 6) AS bob, least(id, 10)::DOUBLE AS steps, least(greatest((id * 5.0::DOUBLE - 20.0) * 100.0 / 120.0, 0), 100) AS pct, t * 2.0::DOUBLE + 1.0 AS at FROM (SELECT event_id, event_id % 41 AS id, (event_id % 41) / 40.0::DOUBLE AS t FROM events)",
}
