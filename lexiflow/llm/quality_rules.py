"""Quality rules: a threshold table compiled into one Spark projection.

Words are runs of characters other than space and U+0009 to U+000D. All measures are built-in array and
string functions over one row, so nothing shuffles and no Python runs on executors.

Edge cases: a null or empty text has no words, all counts 0, ``base_failed`` true and ``kept`` false. Repeated
rows are judged one by one. An empty table gives an empty result. Other columns of the input stay as they are in
``quality_rules``; a column that has the name of a measure is replaced by the measure.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .common import carried, named, uncarried

SPACE = r"[\x20\x09-\x0D]+"
NOT_SPACE = r"[^\x20\x09-\x0D]"
WINDOW = 8

# Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "a an and are as at be by for from he in is it of on or that the this to was which with "
    "au dans de des du elle en est et il la le les ou par pas pour que qui sur un une "
    "als auch auf das dem den der die ein eine er es für ich ist mit nicht sich sie und von zu "
    "al como con del el ella las lo los más no por se su sus y"
).split()


@dataclass(frozen=True)
class Rule:
    """``low <= metric <= high`` must hold; a bound of None is open. Rules with a null metric pass."""

    metric: str
    low: float | None = None
    high: float | None = None


#: The threshold table.
RULES = (
    Rule("mean_word_chars", 1.5, 25.0),
    Rule("symbols_per_word", None, 0.5),
    Rule("stop_word_ratio", 0.01, None),
    Rule("dup_line_ratio", None, 0.3),
    Rule("bullet_line_ratio", None, 0.9),
)

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def compile_rules(rules=RULES) -> Column:
    """One boolean expression that is true where every rule of the table holds."""
    verdict = F.lit(True)
    for rule in rules:
        metric = F.col(rule.metric)
        if rule.low is not None:
            verdict = verdict & F.coalesce(metric >= F.lit(float(rule.low)), F.lit(True))
        if rule.high is not None:
            verdict = verdict & F.coalesce(metric <= F.lit(float(rule.high)), F.lit(True))
    return verdict


def _shifted_pairs(hashes: Column, by: int) -> Column:
    """Hash of each element with the one ``by`` places later; ``by`` elements shorter."""
    n = F.greatest(F.size(hashes) - by, F.lit(0))
    return F.zip_with(F.slice(hashes, F.lit(1), n), F.slice(hashes, F.lit(1 + by), n), lambda a, b: F.xxhash64(a, b))


def measures(df: DataFrame, text: str = "text", keep: tuple[str, ...] | None = None) -> DataFrame:
    """Add the counts and ratios of ``text``; ``keep`` names the input columns that stay (default: all)."""
    body = F.coalesce(named(text), F.lit(""))
    row, names = carried(df if keep is None else df.select(*map(named, keep)), (*COUNTS, *DERIVED))
    df = df.select(row, body.alias("text"), F.array_remove(F.split(body, SPACE), "").alias("words"), F.filter(F.split(body, "\n"), lambda x: x.rlike(NOT_SPACE)).alias("lines"))
    df = df.select(
        "row", "lines",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("words", lambda x: F.lower(x).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
        F.size(F.filter("lines", lambda x: F.substring(F.ltrim(x), 1, 1).isin("-", "*", "•"))).cast("long").alias("n_bullet_lines"),
        F.transform("words", lambda x: F.xxhash64(x)).alias("hashes"),
    )
    # Hashes of 2, 4, then 8 words that begin at each place.
    for by in (1, 2, 4):
        df = df.withColumn("hashes", _shifted_pairs(F.col("hashes"), by))
    some = F.size(F.array_distinct("hashes")) < F.size("hashes")
    df = df.withColumn("sorted", F.when(some, F.sort_array(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    s = F.col("sorted")
    twice = F.filter(s, lambda x, i: (x["h"] == F.get(s, i + 1)["h"]) | ((i > 0) & (x["h"] == F.get(s, F.greatest(i - 1, F.lit(0)))["h"])))
    df = df.withColumn("places", F.sort_array(F.transform(twice, lambda x: x["i"])))
    p = F.col("places")
    reach = F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW))).cast("long"))
    n = F.col("n_words")
    lines = F.when(F.size("lines") > 0, F.size("lines"))
    return df.select(
        *uncarried(names), "n_words", "word_chars", "n_symbols", "n_dup_lines",
        F.coalesce(F.aggregate(reach, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0)).cast("long").alias("n_repeat_words"),
        "n_stop_words", "n_bullet_lines",
        F.when(n > 0, F.col("word_chars") / n).alias("mean_word_chars"),
        F.when(n > 0, F.col("n_symbols") / n).alias("symbols_per_word"),
        F.when(n > 0, F.col("n_stop_words") / n).alias("stop_word_ratio"),
        (F.col("n_dup_lines") / lines).alias("dup_line_ratio"),
        (F.col("n_bullet_lines") / lines).alias("bullet_line_ratio"),
    )


DERIVED = ("n_stop_words", "n_bullet_lines", "mean_word_chars", "symbols_per_word", "stop_word_ratio", "dup_line_ratio", "bullet_line_ratio", "base_failed", "kept")


def quality_rules(df: DataFrame, text: str = "text", rules=RULES, keep: tuple[str, ...] | None = None) -> DataFrame:
    """``measures`` with ``base_failed`` and ``kept``."""
    n = F.col("n_words")
    failed = (n < 20) | (100 * F.col("n_repeat_words") > 30 * n)
    return measures(df, text, keep).withColumn("base_failed", failed).withColumn("kept", ~failed & compile_rules(rules))


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    from .common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules(docs, keep=("doc_id",)).select("doc_id", *COUNTS, "base_failed", "kept")


_STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)
ORACLE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
m AS (SELECT rid, doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
             len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
             len(list_filter(ws, lambda x: lower(x) IN ({_STOPS})))::BIGINT AS n_stop,
             len(list_filter(ls, lambda x: ltrim(x)[1:1] IN ('-', '*', '•')))::BIGINT AS n_bullet,
             len(ls) AS n_lines, ws FROM w),
x AS (SELECT rid, i, array_to_string(list_slice(ws, i, i + 7), ' ') AS win
      FROM (SELECT rid, ws, unnest(range(1, len(ws) - 6)) AS i FROM m WHERE len(ws) >= 8)),
y AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS c FROM x),
z AS (SELECT rid, least(8, coalesce(lead(i) OVER (PARTITION BY rid ORDER BY i) - i, 8)) AS r FROM y WHERE c >= 2),
r AS (SELECT rid, sum(r)::BIGINT AS n_repeat_words FROM z GROUP BY rid),
a AS (SELECT m.*, coalesce(r.n_repeat_words, 0)::BIGINT AS n_repeat_words FROM m LEFT JOIN r USING (rid)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND word_chars::DOUBLE / n_words BETWEEN 1.5 AND 25.0 AND n_symbols::DOUBLE / n_words <= 0.5
       AND n_stop::DOUBLE / n_words >= 0.01 AND n_dup_lines::DOUBLE / n_lines <= 0.3
       AND n_bullet::DOUBLE / n_lines <= 0.9 AS kept
FROM b
"""
