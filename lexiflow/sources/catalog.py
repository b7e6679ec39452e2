"""The catalogue store on immutable tables: each change makes a new version from the base and a table of changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import fixed, is_data_image, non_blank, trimmed
from ..functions.values import clamp, number
from .store import last_of_key


def upsert(base: DataFrame, changes: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """Rows of ``changes`` replace those of their key or are added; of several for one key the last by ``order`` counts."""
    changes = last_of_key(changes, key, order).select(*base.columns)
    return base.join(changes.select(key), key, "left_anti").unionByName(changes)


def upsert_keep_old(base: DataFrame, changes: DataFrame, key: str, *kept: str) -> DataFrame:
    """``upsert`` where a null in a ``kept`` column leaves the old value."""
    old = base.select(key, *(F.col(c).alias(f"__{c}") for c in kept))
    merged = changes.join(old, key, "left").withColumns({c: F.coalesce(F.col(c), F.col(f"__{c}")) for c in kept})
    return upsert(base, merged.select(*base.columns), key)


def delete(base: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return base.join(keys.select(key), key, "left_anti")


def delete_cascade(parents: DataFrame, children: DataFrame, keys: DataFrame, key: str, foreign: str) -> tuple[DataFrame, DataFrame]:
    """Both tables without the parents of ``keys`` and without their children."""
    return delete(parents, keys, key), children.join(keys.select(F.col(key).alias(foreign)), foreign, "left_anti")


def upsert_in_place(base: DataFrame, changes: DataFrame, key: str, order: str) -> DataFrame:
    """``upsert`` of a list: rows of a known key keep the place of the first row that has it, new ones go behind the last.

    ``order`` is the place in ``base`` and the order of ``changes`` among themselves; of several changes to one key the
    last counts. New rows keep their distances to each other, so nothing has to be numbered in one task.
    """
    place = base.groupBy(key).agg(F.min(order).alias("old place"))
    latest = changes.groupBy(key).agg(F.max_by(F.struct(*changes.columns), order).alias("r")).select("r.*")
    last, first = base.agg(F.max(order)).first()[0], changes.agg(F.min(order)).first()[0]
    behind = F.col(order) + F.lit((-1 if last is None else last) + 1 - (first or 0))
    known = latest.join(place, key, "left").withColumn(order, F.coalesce("old place", behind).cast(dict(base.dtypes)[order])).select(*base.columns)
    return base.join(latest.select(key), key, "left_anti").unionByName(known)


def append_absent(base: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    return base.unionByName(rows.join(base.select(key), key, "left_anti"))


def bag_union(*frames: DataFrame) -> DataFrame:
    """All rows of all frames; ``origin`` keeps the order of the frames."""
    out = None
    for i, f in enumerate(frames):
        f = f.withColumn("origin", F.lit(i).cast("long"))
        out = f if out is None else out.unionByName(f, allowMissingColumns=True)
    return out


def _numbers(z: Column, limit) -> list[Column]:
    return [limit(number(z[c])).alias(c) for c in ("left", "top", "width", "height")]


def zones_stored(zones: Column) -> Column:
    """Zones as the store takes them: a label that isn't blank, cut to 60 characters (code points); sizes as they are."""
    return F.transform(F.filter(zones, lambda z: non_blank(z["label"])), lambda z: F.struct(*_numbers(z, lambda n: n), F.substring(trimmed(z["label"]), 1, 60).alias("label")))


def zones_imported(zones: Column) -> Column:
    """Zones of a file: clamped to 0..100, of positive area, with a label."""
    clean = F.transform(F.filter(zones, lambda z: non_blank(z["label"])), lambda z: F.struct(*_numbers(z, clamp), trimmed(z["label"]).alias("label")))
    return F.filter(clean, lambda z: (z["width"] > 0) & (z["height"] > 0))


def zones_drawn(zones: Column, least: float = 3.0) -> Column:
    """Zones drawn by hand: at least ``least`` percent on both sides."""
    return F.filter(zones, lambda z: (z["width"] >= least) & (z["height"] >= least))


def zone_rows(df: DataFrame, zones: str, rule: str = "imported", least: float = 3.0) -> DataFrame:
    """A row for each zone that ``zones_stored``, ``zones_imported`` or (on top of that) ``zones_drawn`` keeps, with ``pos``.

    The array is exploded before its zones are judged, so that they go through compiled code as flat columns.
    """
    keys = [F.col(f"`{c}`") for c in df.columns if c != zones]
    names = [F.col(f"`{c}`") for c in df.columns if c != zones]
    # The outer form: for the plain one Spark infers a filter on the array, which would build it twice.
    flat = df.select(*keys, F.posexplode_outer(zones).alias("pos", "z")).filter(non_blank(F.col("z.label")))
    limit = (lambda n: n) if rule == "stored" else clamp
    label = trimmed(F.col("z.label"))
    out = flat.select(*names, "pos", *_numbers(F.col("z"), limit), (F.substring(label, 1, 60) if rule == "stored" else label).alias("label"))
    if rule == "stored":
        return out
    large = (lambda c: F.col(c) >= least) if rule == "drawn" and least > 0 else (lambda c: F.col(c) > 0)
    return out.filter(large("width") & large("height"))


def zone_count(zones: Column) -> Column:
    """How many zones a page has, as its button shows it: nothing for none."""
    n = F.coalesce(F.size(zones), F.lit(0))
    return F.when(n > 0, F.concat(F.lit(" ("), n.cast("string"), F.lit(")"))).otherwise("")


_ZONES = "array<struct<left:double,top:double,width:double,height:double,label:string>>"


def _text_of(v: Column, name: str) -> Column:
    """The field if it is a JSON string, else null."""
    return F.when(F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant")) == "STRING", F.try_variant_get(v, f"$.{name}", "string"))


def _number_of(v: Column, name: str) -> Column:
    """The field as a number: strings are read, true is 1, and all else (null, lists, objects) is 0."""
    true = F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant")) == "BOOLEAN"
    return F.when(true, F.try_variant_get(v, f"$.{name}", "boolean").cast("double")).otherwise(number(F.try_variant_get(v, f"$.{name}", "string")))


def import_books(texts: DataFrame, column: str = "json") -> DataFrame:
    """Books from JSON texts: ``title``, ``pages``, ``page_count``, and a ``reason`` where the file is refused.

    Refused are texts that aren't JSON, without a title that is a non-blank string, without a non-empty list of pages, or
    with a null page. Of a page, texts and images of another type become empty; an image has to be a data URL of an image;
    zones stay only with an image. Empty pages stay: saving drops them.
    """
    v = F.try_parse_json(column)
    title = _text_of(v, "title")
    pages = F.try_variant_get(v, "$.pages", "array<variant>")

    def page(p: Column) -> Column:
        image = _text_of(p, "image")
        has = F.coalesce(is_data_image(image), F.lit(False))
        listed = F.coalesce(F.try_variant_get(p, "$.zones", "array<variant>"), F.array().cast("array<variant>"))
        named = F.filter(listed, lambda z: non_blank(_text_of(z, "label")))
        clean = F.transform(named, lambda z: F.struct(*(clamp(_number_of(z, c)).alias(c) for c in ("left", "top", "width", "height")), trimmed(_text_of(z, "label")).alias("label")))
        kept = F.filter(clean, lambda z: (z["width"] > 0) & (z["height"] > 0))
        return F.struct(F.coalesce(_text_of(p, "text"), F.lit("")).alias("text"), F.when(has, image).alias("image"), (~has).alias("plain"), F.when(has, kept).otherwise(F.array().cast(_ZONES)).alias("zones"))

    bad_page = F.exists(pages, lambda p: F.coalesce(F.schema_of_variant(p) == "VOID", F.lit(True)))
    reason = F.when(v.isNull(), "not json").when(~non_blank(title), "no title").when(F.coalesce(F.size(pages), F.lit(0)) <= 0, "no pages").when(bad_page, "bad page")
    rows = texts.select("*", trimmed(title).alias("title"), reason.alias("reason"), F.when(reason.isNull(), F.transform(pages, page)).alias("pages"))
    return rows.withColumn("page_count", F.coalesce(F.size("pages"), F.lit(0)).cast("long"))


def page_image(mode: Column, fresh: Column, stored: Column) -> Column:
    """The image of an edited page: a new one, the stored one, or none."""
    return F.when(mode == "new", fresh).when(mode == "existing", stored)


def save_pages(pages: DataFrame, book: str, pos: str, text: str, mode: str, image: str, zones: str) -> DataFrame:
    """Edited pages as they are saved: pages without text and image mode are dropped, the rest numbered anew from 0.

    Zones stay only with an image. ``cover_new`` tells on every page whether the first page kept has a new image.
    """
    has = F.col(mode) != "none"
    kept = pages.withColumn(text, trimmed(F.col(text))).filter((F.length(text) > 0) | F.coalesce(has, F.lit(False)))
    w = Window.partitionBy(book).orderBy(pos)
    source = page_image(F.col(mode), F.col(image), F.col(image))
    out = kept.withColumn("page", (F.row_number().over(w) - 1).cast("long")).withColumn("cover_new", F.coalesce(F.first(F.col(mode) == "new").over(w), F.lit(False)))
    return out.withColumn(image, source).withColumn("plain", F.col(image).isNull()).withColumn(zones, F.when(F.col(image).isNull(), F.lit(None)).otherwise(F.col(zones)))


def size_reason(row: Column, most_mb: float = 5.5, unit: int = 1 << 20) -> Column:
    """Megabytes (or other ``unit``) of a row as JSON, rounded to one decimal, and whether that is too large."""
    mb = fixed(F.length(F.to_json(row)) / float(unit), 1).cast("double")
    return F.struct(mb.alias("mb"), (mb > most_mb).alias("too_large"))


def stored_row(payload: DataFrame) -> DataFrame:
    """A payload (id, title, accent, cover_image, pages, updated_at) as the store keeps it: defaults for what is empty."""
    from ..functions.text import or_default
    from .literals import DEFAULT_ACCENT, DEFAULT_COVER

    return payload.withColumns({
        "accent": or_default(F.col("accent"), F.lit(DEFAULT_ACCENT)),
        "cover": F.when(F.col("cover_image").isNull(), F.lit(DEFAULT_COVER)),
        "page_count": F.coalesce(F.size("pages"), F.lit(0)),
    })


def meta(rows: DataFrame) -> DataFrame:
    """What a listing shows of stored books."""
    return rows.select("id", "title", "accent", F.lit(True).alias("custom"), F.col("cover_image").alias("coverImage"), "cover", F.col("page_count").alias("pageCount"), F.col("updated_at").alias("updatedAt"))


def access(configured: Column, token: Column) -> Column:
    """not-configured without a password, ok for the right token, else wrong; empty strings count as none."""
    right = F.coalesce((F.length(token) > 0) & (token == configured), F.lit(False))
    return F.when(F.coalesce(F.length(configured), F.lit(0)) == 0, "not-configured").when(right, "ok").otherwise("wrong")


def now_ms() -> Column:
    return F.unix_millis(F.current_timestamp())


def epoch_ms(ts: Column) -> Column:
    return F.unix_millis(ts.cast("timestamp"))
