"""Older JSON sources of books, and their migration into the store.

A source is one JSON text that holds a list. A source that does not parse, or is no list, has no rows at all; it does not
spoil the others.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import or_default
from .store import Store, files, read_small, write_once


def read_sources(spark: SparkSession, path: str) -> DataFrame:
    """(source, json): every file below ``path`` as one text."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source"), F.col("value").alias("json"))


def source_rows(sources: DataFrame, column: str = "json") -> DataFrame:
    """(the other columns, pos, row): each element of each source's list as a variant."""
    listed = F.try_variant_get(F.try_parse_json(column), "$", "array<variant>")
    return sources.select(*(F.col(f"`{c}`") for c in sources.columns if c != column), F.posexplode(listed).alias("pos", "row"))


def _pages(row: Column, with_images: bool) -> Column:
    listed = F.coalesce(F.try_variant_get(row, "$.pages", "array<variant>"), F.array().cast("array<variant>"))
    image = lambda p: F.nullif(F.try_variant_get(p, "$.image", "string"), F.lit("")) if with_images else F.lit(None).cast("string")
    return F.transform(listed, lambda p: F.struct(F.coalesce(F.try_variant_get(p, "$.text", "string"), F.lit("")).alias("text"), image(p).alias("image"), image(p).isNull().alias("plain")))


def from_local(rows: DataFrame) -> DataFrame:
    """(title, accent, pages) of the local list: no images."""
    get = lambda n: F.try_variant_get("row", f"$.{n}", "string").alias(n)
    return rows.select(get("title"), get("accent"), _pages(F.col("row"), False).alias("pages"))


def from_database(rows: DataFrame) -> DataFrame:
    """(title, accent, pages, coverThumb) of the local database: images, and the cover as a thumbnail."""
    get = lambda n: F.try_variant_get("row", f"$.{n}", "string").alias(n)
    cover = or_default(F.try_variant_get("row", "$.coverImage", "string"), F.lit(None).cast("string"))
    return rows.select(get("title"), get("accent"), _pages(F.col("row"), True).alias("pages"), cover.alias("coverThumb"))


def _sized(x: Column) -> Column:
    """A text with its length in front, so that texts side by side can't be taken for others; ``-`` for null."""
    return F.coalesce(F.concat(F.length(x), F.lit(":"), x), F.lit("-"))


def migrated(local: DataFrame, database: DataFrame) -> DataFrame:
    """Both sources' books that have a title and pages, with an ``id`` that follows from title, accent, texts and images.

    A second run gives the same ids, so an upsert after a failure midway repeats nothing. Books of one id are one book: that
    with a cover is kept, or the first of the sources.
    """
    books = local.unionByName(database, allowMissingColumns=True).filter((F.length("title") > 0) & (F.size("pages") > 0))
    pages = F.array_join(F.transform("pages", lambda p: F.concat(_sized(p["text"]), _sized(p["image"]))), "")
    books = books.withColumn("id", F.concat(F.lit("book-"), F.md5(F.concat(_sized(F.col("title")), _sized(F.col("accent")), pages))))
    one = books.groupBy("id").agg(F.max_by(F.struct(*(F.col(c) for c in books.columns)), F.struct(F.col("coverThumb").isNotNull(), F.col("coverThumb"))).alias("r"))
    return one.select("r.*")


def _books(spark: SparkSession, local_path: str, database_path: str) -> DataFrame:
    return migrated(from_local(source_rows(read_sources(spark, local_path))), from_database(source_rows(read_sources(spark, database_path))))


def migrate(spark: SparkSession, local_path: str, database_path: str, store_path: str) -> int:
    """Write the books of both sources as a table at ``store_path``, then, and only then, empty the sources.

    Returns how many there are. With nothing to migrate nothing is written. After a crash a rerun adds what the table lacks
    by id, so each book is there once.
    """
    books = _books(spark, local_path, database_path)
    n = books.count()
    if n:
        if read_small(spark, f"{store_path}/_SUCCESS") is not None:
            books.join(spark.read.parquet(store_path).select("id"), "id", "left_anti").select(*books.columns).write.mode("append").parquet(store_path)
        else:
            books.write.mode("overwrite").parquet(store_path)
        for path in (local_path, database_path):
            truncate(spark, path)
    return n


def _listing(spark: SparkSession, path: str) -> list[list]:
    """Name, length and time of each file of a source."""
    fs, make = files(spark, path)
    return sorted([f.getPath().getName(), f.getLen(), f.getModificationTime()] for f in fs.listStatus(make(path)) if f.isFile() and not f.getPath().getName().startswith(("_", "."))) if fs.exists(make(path)) else []


#: Steps of a migration, in order; each leaves a note in the journal when it is done.
STEPS = ("books", "stored", "local emptied", "database emptied")


def migrate_into(store: Store, local_path: str, database_path: str, after=lambda step: None) -> int:
    """Move the books of both sources into ``store`` by id; returns how many there were.

    A journal beside the store notes each step: the books are written down with what the sources looked like, upserted,
    then each source is emptied. A rerun goes on behind the last note. Repeating a step changes nothing, so a crash before
    its note does no harm. A source that has changed since its books were written down is not emptied: the journal ends,
    and the next run takes what is new. ``after(step)`` is called behind each note.
    """
    spark, journal = store.spark, f"{store.path}/_migration"
    note = lambda step: f"{journal}/{STEPS.index(step)}.json"
    sources = {"local emptied": local_path, "database emptied": database_path}
    fs, make = files(spark, store.path)
    told = read_small(spark, note("books"))
    if not told:
        seen = {step: _listing(spark, path) for step, path in sources.items()}
        name = f"{journal}/books-{uuid.uuid4().hex}"
        books = _books(spark, local_path, database_path)
        if books.isEmpty():
            return 0
        books.write.parquet(name)
        told = json.dumps({"books": name, "seen": seen, "n": spark.read.parquet(name).count()})
        write_once(spark, note("books"), told)
        after("books")
    told = json.loads(told)
    if read_small(spark, note("stored")) is None:
        store.upsert(spark.read.parquet(told["books"]))
        write_once(spark, note("stored"), "done")
        after("stored")
    for step, path in sources.items():
        if read_small(spark, note(step)) is None:
            now = _listing(spark, path)
            if now == told["seen"][step]:
                truncate(spark, path)
            write_once(spark, note(step), "done")
            after(step)
    fs.delete(make(journal), True)
    return told["n"]


def truncate(spark: SparkSession, path: str) -> None:
    """Leave no rows at ``path``; what is there is only replaced once the empty table is written."""
    spark.createDataFrame([], "value string").write.mode("overwrite").text(path)
