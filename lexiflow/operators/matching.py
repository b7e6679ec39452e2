"""Joins by label, by rule and by position."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import normalize_word, split_space, tokenize


def label_or_default(df: DataFrame, labels: DataFrame, key: str, default: str) -> DataFrame:
    return df.join(labels, key, "left").withColumn("label", F.coalesce("label", F.lit(default)))


def first_match(x: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """Label of the first rule whose string occurs in ``x``."""
    (head, label), *rest = rules
    return reduce(lambda c, r: c.when(x.contains(r[0]), r[1]), rest, F.when(x.contains(head), label)).otherwise(default)


def counted_words(texts: DataFrame, text: str, merge: bool = True) -> DataFrame:
    """(word, count) of normalised words. Tokens are counted as they stand first, so each distinct one is normalised once.

    The count in between is a shuffle of distinct tokens; Spark can't move the normalising below it. Without ``merge``
    lone marks are tokens of their own, whose word is empty; all other words are the same, and found faster.
    """
    words = tokenize(F.col(text)) if merge else split_space(F.col(text))
    tokens = texts.select(F.explode(words).alias("w")).groupBy("w").count()
    return tokens.select(normalize_word(F.col("w")).alias("word"), "count").groupBy("word").agg(F.sum("count").alias("count"))


def word_zone_hits(texts: DataFrame, zones: DataFrame, text: str, zone: str, label: str, least: int = 3) -> DataFrame:
    """(zone, hits): occurrences of words in texts that equal a word of the zone's label, one hit per word and zone.

    Words are counted before the join, so what is shuffled are distinct words, and the join sees each once.
    """
    words = counted_words(texts, text, merge=False).filter(F.length("word") >= least)
    wanted = zones.select(zone, F.explode(split_space(F.col(label))).alias("w")).select(zone, normalize_word(F.col("w")).alias("word")).filter(F.length("word") >= least).distinct()
    return wanted.join(words, "word").groupBy(zone).agg(F.sum("count").cast("long").alias("hits"))


def first_by(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key; one without an order comes last."""
    columns = df.columns
    return df.groupBy(key).agg(F.min_by(F.struct(*columns), F.struct(F.col(order).isNull(), F.col(order))).alias("r")).select("r.*")


def modular_lookup(df: DataFrame, position: str, values: list[str]) -> DataFrame:
    """``picked``: the value at the position modulo their number."""
    return df.withColumn("picked", F.element_at(F.array(*map(F.lit, values)), (F.col(position) % len(values) + 1).cast("int")))


def modular_rows(df: DataFrame, position: str, rows: DataFrame, size: int) -> DataFrame:
    """Each row with the row of a small table of ``size`` rows whose ``ord`` is the position modulo their number."""
    return df.join(F.broadcast(rows), F.col(position) % size == F.col("ord"))


def grid(boards: DataFrame, rows: Column, cols: Column) -> DataFrame:
    """Each board with its cells (r, c)."""
    cell = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1))
    return boards.withColumns({"rows": rows, "cols": cols}).withColumn("r", cell(F.col("rows"))).withColumn("c", cell(F.col("cols")))


def edge_signs(cells: DataFrame, own: Column, board: str) -> DataFrame:
    """``top`` and ``left`` of each cell are the opposite of the ``bottom`` above and the ``right`` before; 0 at the rim.

    ``cells`` come from ``grid``; a board's cells are few, so its windows are.
    """
    d = cells.withColumn("bottom", F.when(F.col("r") == F.col("rows") - 1, 0).otherwise(own)).withColumn("right", F.when(F.col("c") == F.col("cols") - 1, 0).otherwise(-own))
    above, before = Window.partitionBy(board, "c").orderBy("r"), Window.partitionBy(board, "r").orderBy("c")
    return d.withColumn("top", F.coalesce(-F.lag("bottom").over(above), F.lit(0))).withColumn("left", F.coalesce(-F.lag("right").over(before), F.lit(0)))


def independent_set(candidates: Column, edges: Column, size: int) -> Column:
    """The first ``size`` candidates that have no edge to one chosen before; edges are ``a|b`` strings of both directions."""
    free = lambda chosen, x: ~F.exists(chosen, lambda y: F.array_contains(edges, F.concat(x, F.lit("|"), y)))
    return F.aggregate(candidates, F.array().cast("array<string>"), lambda acc, x: F.when((F.size(acc) < size) & free(acc, x), F.concat(acc, F.array(x))).otherwise(acc))


def slot_changes(old: DataFrame, new: DataFrame, slot: str, value: str) -> DataFrame:
    """What has to be done for each slot: create, keep, replace or dispose. A slot whose value is null is a slot."""
    here = lambda df, name, flag: df.select(slot, F.col(value).alias(name), F.lit(True).alias(flag))
    both = here(old, "before", "__old").join(here(new, "after", "__new"), slot, "full")
    action = F.when(F.col("__old").isNull(), "create").when(F.col("__new").isNull(), "dispose").when(F.col("before").eqNullSafe(F.col("after")), "keep").otherwise("replace")
    return both.withColumn("action", action).drop("__old", "__new")


def lookup_first(keys: DataFrame, rows: DataFrame, key: str, order: str) -> DataFrame:
    """Each key with the first row that has it, or nulls; rows are reduced to one a key before the join."""
    return keys.join(first_by(rows, key, order), key, "left")


def in_order(lists: DataFrame, ids: str, rows: DataFrame, key: str) -> DataFrame:
    """A row for each id of the array ``ids`` that ``rows`` has, with its place in the array as ``pos``; others are dropped."""
    columns = [c for c in lists.columns if c != ids]
    return lists.select(*columns, F.posexplode(ids).alias("pos", key)).join(rows, key)


def equal_pairs(df: DataFrame, key: str, value: str) -> DataFrame:
    """(first, second) of rows with equal values, the smaller key first: each row with the next larger one of its value.

    Neighbours link all rows of a value without writing all pairs down. Rows without a value equal nothing.
    """
    w = Window.partitionBy(value).orderBy(key)
    return df.filter(F.col(value).isNotNull()).select(F.col(key).alias("first"), F.lead(key).over(w).alias("second"), F.col(value)).filter("second IS NOT NULL")


def same_value(df: DataFrame, value: str, left: Column, right: Column) -> Column:
    """Whether two chosen rows, given by what identifies them, are different ones of equal value."""
    return (left != right) & (left[value] == right[value])


def mapped(key: Column, table: dict[str, str]) -> Column:
    """The value of ``key`` in a small literal table, null where it has none."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), key)


def boxes(parts: DataFrame, key: str, column: str) -> DataFrame:
    """A row for each box of each part, with the composite key ``part-place`` and numbers for percentages."""
    flat = parts.select(key, F.posexplode(column).alias("pos", "box")).withColumn("box_key", F.concat_ws("-", F.col(key), F.col("pos").cast("string")))
    return flat.select(key, "box_key", *(F.rtrim(F.col(f"box.{c}"), F.lit("%")).try_cast("double").alias(c) for c in ("top", "left", "width", "height")))


def round_parts(targets: DataFrame, target: str, parts: Column, conflicts: dict[str, tuple[str, ...]], size: int = 4) -> Column:
    """The target and parts, ``size`` in all, in the order of ``parts``: none has a conflict with one chosen before.

    Conflicts of the target are left out first, then the list is folded greedily.
    """
    edges = F.array(*(F.lit(f"{a}|{b}") for a, bs in conflicts.items() for b in bs))
    t = F.col(target)
    pool = F.filter(parts, lambda p: (p != t) & ~F.array_contains(edges, F.concat(t, F.lit("|"), p)))
    return independent_set(F.concat(F.array(t), pool), edges, size)
