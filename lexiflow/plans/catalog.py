"""Queries of the catalogue: listings, changes, validity, import."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import matching as M
from ..sources import catalog as C
from ..sources.store import Store
from ..sources.tables import literal, scratch, table

STAMP = "yyyy-MM-dd HH:mm:ss"


def list_recent(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    return o.orderBy(F.desc_nulls_first("o_orderdate"), "o_orderkey").limit(50).withColumn("o_orderdate", F.date_format("o_orderdate", STAMP))


def list_all(spark, d):
    """The whole listing, newest first; ``list_recent`` is its first 50 rows."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    return o.orderBy(F.desc_nulls_first("o_orderdate"), "o_orderkey").withColumn("o_orderdate", F.date_format("o_orderdate", STAMP))


def point_lookup(spark, d):
    keys = literal(spark, [42, -1], "o_orderkey bigint").drop("ord")
    found = table(spark, d, "orders").filter(F.col("o_orderkey").isin(42, -1)).select("o_orderkey", "o_custkey")
    return keys.join(found, "o_orderkey", "left").withColumn("status", F.when(F.col("o_custkey").isNull(), 404).otherwise(200))


def meta_projection(spark, d):
    """Orders as stored books: accents, covers and page counts get their defaults, then the listing's columns."""
    o = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("title"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderstatus")).when(F.col("o_orderstatus") == "P", "").alias("accent"),
        F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("u"), F.col("o_orderkey"))).alias("cover_image"), F.array_repeat(F.lit("p"), (F.col("o_orderkey") % 9).cast("int")).alias("pages"), F.col("o_custkey").alias("updated_at"),
    )
    return C.meta(C.stored_row(o)).withColumn("pageCount", F.col("pageCount").cast("long"))


def _customers(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    new = c.filter("c_custkey % 50 = 0").select((F.col("c_custkey") + 1000000000).alias("c_custkey"), "c_name", "c_mktsegment")
    changes = c.filter("c_custkey % 3 = 0").select("c_custkey", F.upper("c_name").alias("c_name"), F.when(F.col("c_custkey") % 2 == 0, F.lit("NEW")).alias("c_mktsegment"))
    return c, changes.unionByName(new)


def upsert_rows(spark, d):
    return C.upsert(*_customers(spark, d), "c_custkey")


def upsert_doubled(spark, d):
    """Orders of a customer as changes to the customer: the last one counts."""
    c = table(spark, d, "customer").select("c_custkey", F.col("c_acctbal").alias("price"), F.lit(0).cast("long").alias("orderkey"))
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_totalprice").alias("price"), F.col("o_orderkey").alias("orderkey"))
    return C.upsert(c, o, "c_custkey", "orderkey")


def stored_versions(spark, d):
    """Orders in a store of 256 buckets: changed by one in a hundred, each change given twice, then some deleted; both versions."""
    store = Store(spark, f"{scratch(spark)}/store-{uuid.uuid4().hex}", "o_orderkey", 256)
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority", F.lit(0).alias("turn"))
    store.create(o)
    changes = o.filter("o_orderkey % 100 = 7").select(F.explode(F.array(F.lit(2), F.lit(1))).alias("turn"), F.when(F.col("o_orderkey") % 200 == 7, F.col("o_orderkey")).otherwise(-F.col("o_orderkey")).alias("o_orderkey"), "o_totalprice", F.lit("changed").alias("o_orderpriority"))
    second = store.upsert(changes, "turn")
    third = store.delete(o.filter("o_orderkey % 300 = 9").select("o_orderkey"))
    return store.read(second).withColumn("version", F.lit(second)).unionByName(store.read(third).withColumn("version", F.lit(third)))


def upsert_keep_old(spark, d):
    return C.upsert_keep_old(*_customers(spark, d), "c_custkey", "c_mktsegment")


def upsert_in_place(spark, d):
    """Customers as a list by key; the changes come in the order of their names."""
    c, changes = _customers(spark, d)
    place = lambda x: x.withColumn("pos", F.col("c_custkey") * 10)
    return C.upsert_in_place(place(c), place(changes), "c_custkey", "pos")


def append_absent(spark, d):
    c, changes = _customers(spark, d)
    return C.append_absent(c, changes, "c_custkey")


def delete_cascade(spark, d):
    o, l = table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), table(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    return C.delete_cascade(o, l, o.filter("o_orderstatus = 'F'"), "o_orderkey", "l_orderkey")[1]


def validity_reason(spark, d):
    t = table(spark, d, "documents").select("doc_id", "text", "lang")
    reason = F.when(~X.non_blank(F.col("text")), "empty").when(F.size(X.split_space(X.trimmed(F.col("text")))) < 5, "short").when(~F.col("lang").isin("en", "fr"), "language").otherwise("ok")
    return t.select("doc_id", reason.alias("reason"))


def cover_precedence(spark, d):
    l, t = table(spark, d, "labels"), table(spark, d, "documents").select("doc_id", "source", "lang")
    j = l.join(t, "doc_id", "left")
    cover = F.coalesce(F.when(F.col("toxic") == 1, F.lit("svg")), F.when(F.col("quality") == 1, F.col("lang")), F.col("source"), F.lit("📖"))
    return j.select("doc_id", cover.alias("cover"))


def page_variant(spark, d):
    p = table(spark, d, "pages").select("page_id", "url", "html")
    kind = F.when(F.col("html").isNull() | (F.col("html") == ""), "none").when(F.col("html").contains("<svg"), "svg").when(F.col("html").contains("<img"), "image").when(F.col("url").contains("?"), "plain").otherwise("scene")
    return p.select("page_id", kind.alias("kind"))


def bag_union(spark, d):
    c, s = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")), table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"))
    return C.bag_union(c, s)


def _rectangles(spark, d):
    l = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_partkey", "l_suppkey", "l_returnflag", "l_shipdate")
    s = lambda c: c.cast("long").cast("string")
    label = F.when(F.col("l_returnflag") == "R", F.lit(" \t ")).otherwise(F.concat(F.lit("  "), F.repeat(F.concat(F.col("l_returnflag"), F.lit("zone")), 15)))
    zone = F.struct(s(F.col("l_quantity") - 5).alias("left"), s(F.col("l_partkey") % 130).alias("top"), s(F.col("l_suppkey") % 110).alias("width"), F.when(F.col("l_partkey") % 7 == 0, "tall").otherwise(s(F.col("l_linenumber"))).alias("height"), label.alias("label"))
    return l.select("l_orderkey", "l_linenumber", F.array(zone).alias("zones"))


def zones_server(spark, d):
    return C.zone_rows(_rectangles(spark, d), "zones", "stored").drop("pos")


def zones_import(spark, d):
    return C.zone_rows(_rectangles(spark, d), "zones", "imported").drop("pos")


def zones_editor(spark, d):
    return C.zone_rows(_rectangles(spark, d), "zones", "drawn").drop("pos")


# Cases of the importer.
BOOKS = (
    '{"title": " Un ", "pages": [{"text": "a", "image": "", "zones": [{"left": -5, "top": "10", "width": 150, "height": 20, "label": "  chat "}, {"left": 1, "top": 1, "width": 0, "height": 5, "label": "x"}]}]}',
    '{"title": "", "pages": [{"text": "a"}]}', '{"title": "t", "pages": [{"text": " ", "image": ""}]}', "not json", '{"title": "t", "pages": [{"image": "u"}, {"text": "b"}]}',
    '{"title": 5, "pages": [{"text": "a"}]}', '{"title": "t", "pages": "a"}', '{"title": "t", "pages": []}', '{"title": "t", "pages": [null]}', '{"title": "t"}', "[]", "null",
    '{"title": "t", "pages": [{"text": 5, "image": "data:image/png;base64,AA", "zones": [{"left": "-5", "top": 10.5, "width": "0x20", "height": true, "label": " chat "}, {"width": 5, "height": 5, "label": 7}, {"width": 5, "height": 5, "label": " "}, null, {"width": "x", "height": 5, "label": "z"}, {"left": 1e3, "top": null, "width": 250, "height": "7.5", "label": "y"}]}, 3, {"text": "b", "image": "data:text/plain,x", "zones": [{"width": 5, "height": 5, "label": "q"}]}]}',
)


def json_import(spark, d):
    """A file for each customer, of a few kinds: a row for each page of its book, one if it is refused; zones as text."""
    files = M.modular_rows(table(spark, d, "customer").select("c_custkey"), "c_custkey", literal(spark, list(BOOKS), "json string"), len(BOOKS))
    b = C.import_books(files.select(F.col("c_custkey").alias("ord"), "json"))
    zone = lambda z: F.concat_ws(",", *(z[c].cast("int").cast("string") for c in ("left", "top", "width", "height")), z["label"])
    p = b.select("ord", "title", "page_count", F.coalesce("reason", F.lit("ok")).alias("reason"), F.posexplode_outer("pages").alias("pos", "p"))
    return p.select("ord", "title", "page_count", "reason", "pos", "p.text", "p.image", "p.plain", F.array_join(F.transform("p.zones", zone), ";").alias("zones"))


def size_gate(spark, d):
    """Documents by their size as JSON, in units of a kilobyte, and whether it is over 5.5."""
    rows = table(spark, d, "documents").select("doc_id", F.translate("text", "\\\"/\t\r\n", "......").alias("a"))
    return rows.select("doc_id", C.size_reason(F.struct("a"), unit=1024).alias("s")).select("doc_id", "s.mb", "s.too_large")


def slot_changes(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    new = c.filter("c_custkey % 5 <> 0").select("c_custkey", F.when(F.col("c_custkey") % 7 == 0, "X").otherwise(F.col("c_mktsegment")).alias("c_mktsegment"))
    return M.slot_changes(c.filter("c_custkey % 3 <> 0"), new, "c_custkey", "c_mktsegment")


def slot_changes_nulls(spark, d):
    """As ``slot_changes``, where some slots have no value before, after or both."""
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    old = c.filter("c_custkey % 3 <> 0").select("c_custkey", F.when(F.col("c_custkey") % 4 > 0, F.col("c_mktsegment")).alias("c_mktsegment"))
    new = c.filter("c_custkey % 5 <> 0").select("c_custkey", F.when(F.col("c_custkey") % 8 > 1, F.col("c_mktsegment")).alias("c_mktsegment"))
    return M.slot_changes(old, new, "c_custkey", "c_mktsegment")


QUERIES = {f.__name__: f for f in (slot_changes_nulls, upsert_doubled, stored_versions, list_recent, list_all, point_lookup, meta_projection, upsert_rows, upsert_keep_old, upsert_in_place, append_absent, delete_cascade, validity_reason, cover_precedence, page_variant, bag_union, zones_server, zones_import, zones_editor, json_import, size_gate, slot_changes)}

_CHANGES = """WITH c AS (SELECT c_custkey, c_name, c_mktsegment FROM customer),
u AS (SELECT c_custkey, upper(c_name) AS c_name, CASE WHEN c_custkey % 2 = 0 THEN 'NEW' END AS c_mktsegment FROM c WHERE c_custkey % 3 = 0
      UNION ALL SELECT c_custkey + 1000000000, c_name, c_mktsegment FROM c WHERE c_custkey % 50 = 0) """
_ZONES = """WITH z AS (SELECT l_orderkey, l_linenumber, (l_quantity - 5)::BIGINT::DOUBLE AS "left", (l_partkey % 130)::DOUBLE AS top, (l_suppkey % 110)::DOUBLE AS width,
  CASE WHEN l_partkey % 7 = 0 THEN 0 ELSE l_linenumber END::DOUBLE AS height, repeat(l_returnflag || 'zone', 15) AS label FROM lineitem WHERE l_returnflag <> 'R'),
i AS (SELECT l_orderkey, l_linenumber, least(greatest("left", 0), 100) AS "left", least(greatest(top, 0), 100) AS top, least(greatest(width, 0), 100) AS width, least(greatest(height, 0), 100) AS height, label FROM z) """
_SPACED = r"regexp_replace(regexp_replace(coalesce(text, ''), '^[\s\x0B\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+', ''), '[\s\x0B\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+$', '')"
SQL = {
    "list_recent": "SELECT o_orderkey, o_custkey, o_orderstatus, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate FROM (SELECT * FROM orders ORDER BY orders.o_orderdate DESC NULLS FIRST, o_orderkey LIMIT 50)",
    "list_all": "SELECT o_orderkey, o_custkey, o_orderstatus, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate FROM orders ORDER BY orders.o_orderdate DESC NULLS FIRST, o_orderkey",
    "point_lookup": "SELECT k AS o_orderkey, o_custkey, CASE WHEN o_custkey IS NULL THEN 404 ELSE 200 END AS status FROM (VALUES (42::BIGINT), (-1::BIGINT)) t(k) LEFT JOIN orders ON o_orderkey = k",
    "meta_projection": "SELECT o_orderkey AS id, o_orderpriority AS title, CASE WHEN o_orderstatus = 'F' THEN o_orderstatus ELSE '#FFD93C' END AS accent, true AS custom, CASE WHEN o_orderkey % 3 = 0 THEN 'u' || o_orderkey END AS coverImage, CASE WHEN o_orderkey % 3 <> 0 THEN '📗' END AS cover, o_orderkey % 9 AS pageCount, o_custkey AS updatedAt FROM orders",
    "upsert_rows": _CHANGES + "SELECT * FROM c WHERE c_custkey NOT IN (SELECT c_custkey FROM u) UNION ALL SELECT * FROM u",
    "upsert_keep_old": _CHANGES + "SELECT * FROM c WHERE c_custkey NOT IN (SELECT c_custkey FROM u) UNION ALL SELECT u.c_custkey, u.c_name, coalesce(u.c_mktsegment, c.c_mktsegment) AS c_mktsegment FROM u LEFT JOIN c USING (c_custkey)",
    "upsert_in_place": _CHANGES + """, n AS (SELECT u.*, c.c_custkey IS NULL AS fresh FROM u LEFT JOIN c USING (c_custkey)), m AS (SELECT max(c_custkey) * 10 + 1 - (SELECT min(c_custkey) * 10 FROM u) AS gap FROM c)
SELECT *, c_custkey * 10 AS pos FROM c WHERE c_custkey NOT IN (SELECT c_custkey FROM u) UNION ALL SELECT c_custkey, c_name, c_mktsegment, CASE WHEN fresh THEN c_custkey * 10 + gap ELSE c_custkey * 10 END FROM n, m""",
    "json_import": f"""WITH b AS (SELECT c_custkey AS ord, raw FROM customer JOIN (VALUES {', '.join(f"({i}::BIGINT, '" + b.replace("'", "''") + "')" for i, b in enumerate(BOOKS))}) t(n, raw) ON n = c_custkey % {len(BOOKS)}),
j AS (SELECT ord, CASE WHEN json_valid(raw) THEN raw::JSON END AS j FROM b),
t AS (SELECT ord, j, CASE WHEN json_type(j, '$.title') = 'VARCHAR' THEN trim(j->>'$.title') ELSE '' END AS title, CASE WHEN json_type(j, '$.pages') = 'ARRAY' THEN (j->'$.pages')::JSON[] END AS ps FROM j),
r AS (SELECT *, CASE WHEN j IS NULL THEN 'not json' WHEN title = '' THEN 'no title' WHEN coalesce(len(ps), 0) = 0 THEN 'no pages' WHEN len(list_filter(ps, lambda p: p IS NULL OR json_type(p) = 'NULL')) > 0 THEN 'bad page' ELSE 'ok' END AS reason FROM t),
p AS (SELECT ord, title, reason, CASE WHEN reason = 'ok' THEN len(ps) ELSE 0 END AS page_count, unnest(CASE WHEN reason = 'ok' THEN range(len(ps)) ELSE [NULL] END) AS pos, ps FROM r),
q AS (SELECT *, ps[pos + 1] AS p, json_type(ps[pos + 1], '$.image') = 'VARCHAR' AND starts_with(ps[pos + 1]->>'$.image', 'data:image') AS has FROM p),
z AS (SELECT ord, pos, generate_subscripts(zs, 1) AS i, unnest(zs) AS z FROM (SELECT ord, pos, (p->'$.zones')::JSON[] AS zs FROM q WHERE has AND json_type(p, '$.zones') = 'ARRAY')),
n AS (SELECT ord, pos, i, trim(z->>'$.label') AS label, list_transform(['left', 'top', 'width', 'height'], lambda c: coalesce(CASE json_type(z, '$.' || c) WHEN 'BOOLEAN' THEN (z->>('$.' || c) = 'true')::INT::DOUBLE
  WHEN 'VARCHAR' THEN CASE WHEN starts_with(z->>('$.' || c), '0x') THEN ('0x' || (z->>('$.' || c))[3:])::BIGINT::DOUBLE ELSE try_cast(z->>('$.' || c) AS DOUBLE) END WHEN 'NULL' THEN 0 ELSE try_cast(z->>('$.' || c) AS DOUBLE) END, 0)) AS v FROM z WHERE json_type(z, '$.label') = 'VARCHAR'),
c AS (SELECT ord, pos, i, label, list_transform(v, lambda x: least(100, greatest(0, x))) AS v FROM n WHERE label <> ''),
s AS (SELECT ord, pos, string_agg(array_to_string(list_transform(v, lambda x: trunc(x)::INT), ',') || ',' || label, ';' ORDER BY i) AS zones FROM c WHERE v[3] > 0 AND v[4] > 0 GROUP BY ALL)
SELECT q.ord, title, page_count::BIGINT AS page_count, reason, q.pos::INT AS pos, CASE WHEN p IS NOT NULL THEN CASE WHEN json_type(p, '$.text') = 'VARCHAR' THEN p->>'$.text' ELSE '' END END AS text,
 CASE WHEN has THEN p->>'$.image' END AS image, CASE WHEN p IS NOT NULL THEN NOT coalesce(has, false) END AS plain, CASE WHEN p IS NOT NULL THEN coalesce(zones, '') END AS zones FROM q LEFT JOIN s ON s.ord = q.ord AND s.pos = q.pos""",
    "append_absent": _CHANGES + "SELECT * FROM c UNION ALL SELECT * FROM u WHERE c_custkey NOT IN (SELECT c_custkey FROM c)",
    "delete_cascade": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')",
    "validity_reason": rf"SELECT doc_id, CASE WHEN length(t) = 0 THEN 'empty' WHEN len(regexp_split_to_array(t, '\s+')) < 5 THEN 'short' WHEN lang NOT IN ('en', 'fr') THEN 'language' ELSE 'ok' END AS reason FROM (SELECT doc_id, lang, {_SPACED} AS t FROM documents)",
    "cover_precedence": "SELECT l.doc_id, coalesce(CASE WHEN toxic = 1 THEN 'svg' END, CASE WHEN quality = 1 THEN lang END, source, '📖') AS cover FROM labels l LEFT JOIN documents d ON d.doc_id = l.doc_id",
    "page_variant": "SELECT page_id, CASE WHEN html IS NULL OR html = '' THEN 'none' WHEN contains(html, '<svg') THEN 'svg' WHEN contains(html, '<img') THEN 'image' WHEN contains(url, '?') THEN 'plain' ELSE 'scene' END AS kind FROM pages",
    "bag_union": "SELECT c_custkey AS key, c_name AS name, c_mktsegment AS segment, 0::BIGINT AS origin FROM customer UNION ALL SELECT s_suppkey, s_name, NULL, 1 FROM supplier",
    "zones_server": _ZONES + 'SELECT l_orderkey, l_linenumber, "left", top, width, height, label[1:60] AS label FROM z',
    "zones_import": _ZONES + "SELECT * FROM i WHERE width > 0 AND height > 0",
    "zones_editor": _ZONES + "SELECT * FROM i WHERE width > 0 AND height > 0 AND width >= 3 AND height >= 3",
    "slot_changes": """SELECT coalesce(o.k, n.k) AS c_custkey, o.v AS before, n.v AS after, CASE WHEN o.k IS NULL THEN 'create' WHEN n.k IS NULL THEN 'dispose' WHEN o.v = n.v THEN 'keep' ELSE 'replace' END AS action
FROM (SELECT c_custkey AS k, c_mktsegment AS v FROM customer WHERE c_custkey % 3 <> 0) o FULL JOIN (SELECT c_custkey AS k, CASE WHEN c_custkey % 7 = 0 THEN 'X' ELSE c_mktsegment END AS v FROM customer WHERE c_custkey % 5 <> 0) n ON o.k = n.k""",
    "slot_changes_nulls": """SELECT coalesce(o.k, n.k) AS c_custkey, o.v AS before, n.v AS after, CASE WHEN o.k IS NULL THEN 'create' WHEN n.k IS NULL THEN 'dispose' WHEN o.v IS NOT DISTINCT FROM n.v THEN 'keep' ELSE 'replace' END AS action
FROM (SELECT c_custkey AS k, CASE WHEN c_custkey % 4 > 0 THEN c_mktsegment END AS v FROM customer WHERE c_custkey % 3 <> 0) o FULL JOIN (SELECT c_custkey AS k, CASE WHEN c_custkey % 8 > 1 THEN c_mktsegment END AS v FROM customer WHERE c_custkey % 5 <> 0) n ON o.k = n.k""",
    "upsert_doubled": "SELECT coalesce(c_custkey, o_custkey) AS c_custkey, coalesce(price, c_acctbal) AS price, coalesce(k, 0) AS orderkey FROM customer FULL JOIN (SELECT o_custkey, arg_max(o_totalprice, o_orderkey) AS price, max(o_orderkey) AS k FROM orders GROUP BY 1) ON o_custkey = c_custkey",
    "stored_versions": """WITH v AS (SELECT o_orderkey, o_totalprice, CASE WHEN o_orderkey % 200 = 7 THEN 'changed' ELSE o_orderpriority END AS o_orderpriority, CASE WHEN o_orderkey % 200 = 7 THEN 2 ELSE 0 END AS turn FROM orders
UNION ALL SELECT -o_orderkey, o_totalprice, 'changed', 2 FROM orders WHERE o_orderkey % 200 = 107)
SELECT *, 2 AS version FROM v UNION ALL SELECT *, 3 FROM v WHERE o_orderkey < 0 OR o_orderkey % 300 <> 9""",
    "size_gate": r"""WITH m AS (SELECT doc_id, CASE WHEN text IS NULL THEN 2 ELSE length(text) + 8 END / 1024.0::DOUBLE AS kb FROM documents)
SELECT doc_id, printf('%.1f', kb + CASE WHEN kb * 4 = floor(kb * 4) AND (kb * 4)::BIGINT % 2 <> 0 THEN 0.01 ELSE 0 END)::DOUBLE AS mb, printf('%.1f', kb + CASE WHEN kb * 4 = floor(kb * 4) AND (kb * 4)::BIGINT % 2 <> 0 THEN 0.01 ELSE 0 END)::DOUBLE > 5.5 AS too_large FROM m""",
}
