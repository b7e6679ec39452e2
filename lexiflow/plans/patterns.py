"""Queries with tables of patterns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.patterns import first_contained
from ..sources.tables import table


def _triples(spark, d):
    """Three neighbouring words of benchmark texts, numbered by item and place."""
    w = table(spark, d, "benchmark").select("item_id", F.split("text", " ").alias("w"))
    rows = w.select("item_id", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 2)).alias("i")).filter("size(w) > 2")
    return rows.select(F.array_join(F.slice("w", F.col("i"), 3), " ").alias("pattern"), (F.col("item_id") * 100_000 + F.col("i")).alias("number"))


def benchmark_triples(spark, d):
    """The first word triple of the benchmark that each whole document contains."""
    return first_contained(table(spark, d, "documents").select("doc_id", "text"), "text", _triples(spark, d)).drop("text")


def name_rules(spark, d):
    """Types and names of parts by the longest word of any name, or brand, that they contain; -1 where there is none."""
    part = table(spark, d, "part")
    words = part.select(F.explode(F.split("p_name", " ")).alias("pattern")).unionByName(part.select(F.col("p_brand").alias("pattern"))).distinct()
    rules = words.select("pattern", (F.length("pattern") * -1_000_000 + F.conv(F.substring(F.md5("pattern"), 1, 4), 16, 10).cast("long")).alias("number"))
    found = first_contained(part.select("p_partkey", F.concat_ws(" / ", "p_type", "p_name").alias("text")), "text", rules)
    return found.select("p_partkey", F.coalesce("rule", F.lit(-1)).alias("rule"))


QUERIES = {f.__name__: f for f in (benchmark_triples, name_rules)}

SQL = {
    "benchmark_triples": """WITH w AS (SELECT item_id, string_split(text, ' ') AS w FROM benchmark),
p AS (SELECT w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS pattern, min(item_id * 100000 + i) AS number FROM (SELECT item_id, w, unnest(range(1, len(w) - 1)) AS i FROM w) GROUP BY 1)
SELECT doc_id, min(number) AS rule FROM documents LEFT JOIN p ON contains(text, pattern) GROUP BY doc_id""",
    "name_rules": """WITH p AS (SELECT DISTINCT pattern FROM (SELECT unnest(string_split(p_name, ' ')) AS pattern FROM part UNION ALL SELECT p_brand FROM part)),
r AS (SELECT pattern, length(pattern) * -1000000 + ('0x' || md5(pattern)[1:4])::BIGINT AS number FROM p)
SELECT p_partkey, coalesce(min(number), -1) AS rule FROM part LEFT JOIN r ON contains(p_type || ' / ' || p_name, pattern) GROUP BY p_partkey""",
}
