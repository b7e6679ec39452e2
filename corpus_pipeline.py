"""The corpus pipeline: five stages, each calling one operator over all rows that the stage before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``docs``. A stage's
output is written as Parquet and read again before the next one begins.

Rows with null or empty texts are rejected by the first stage; ties and repeated rows are judged alike; repeats of one
``doc_id`` with one text become one row in the third stage; empty tables pass through; columns besides ``doc_id``,
``text``, ``source`` and ``n_chars`` are carried as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lexiflow.llm.common import carried, likely, stored, uncarried, where
from lexiflow.llm.ngram_join import jaccard_components
from lexiflow.llm.packing import pack, padded_length
from lexiflow.llm.quality_classifier import quality_scores
from lexiflow.llm.quality_rules import quality_rules
from lexiflow.llm.suffix_dedup import remove_repeats

#: Near copies: word shingles, and the least Jaccard similarity in percent.
SHINGLE, PERCENT = 5, 80
#: Bytes of a repeated passage: what 50 short words take.
PASSAGE = 200


def _kept(docs: DataFrame, judge, verdict: str) -> DataFrame:
    """``docs`` where ``judge`` of (doc_id, text and the row itself) says so; columns that share a name with a measure stay."""
    row, names = carried(docs)
    rows = docs.select("doc_id", "text", row)
    return where(judge(rows), verdict).select(*uncarried(names))


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _kept(docs, quality_scores, "keep")


def rule_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _kept(docs, quality_rules, "kept")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies: that of least ``doc_id`` (null ones last), then of least text mark.

    A document is known by its id and its text's mark, and a null id is an id like others; so rows without an id take
    part, and so do different texts under one id.
    """
    row, names = carried(docs)
    mark = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("text"))
    rows = docs.select(row, "text", mark.alias("mark"))
    groups = stored(jaccard_components(rows.select("mark", "text"), key="mark", k=SHINGLE, percent=PERCENT).groupBy("mark").agg(F.count("*").alias("rows"), F.min("component_id").alias("first")), "groups")
    # Most rows stand for themselves and stay where they are; only those of groups and repeated ones are shuffled.
    others = groups.filter("rows > 1 OR mark <> first").select("mark", (F.col("mark") == F.col("first")).alias("stays"), F.xxhash64("mark.id", "mark.text").alias("name"))
    others = stored(others, "others")
    rows = rows.withColumn("name", F.xxhash64("mark.id", "mark.text")).drop("text")
    judged = likely(rows, others, "name").join(others.select("mark", "stays"), "mark", "left").filter("stays IS NULL OR stays")
    once = judged.filter("stays").dropDuplicates(["mark"]).select("row")
    out = likely(rows, others, "name", without=True).select("row").unionByName(judged.filter("stays IS NULL").select("row")).unionByName(once)
    return out.select(*uncarried(names))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that occur anywhere else; ``n_chars`` follows."""
    out = remove_repeats(docs, length=PASSAGE)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = pack(docs.select("doc_id", "text", "source"), public_tokenizers.path("word_bpe_49k.json"), with_ids=False)
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", padded_length(F.col("sequence_length")).alias("padded_length"))


STAGES = [
    ("quality_classifier", classify),
    ("quality_rules", rule_out),
    ("ngram_join", one_of_each_group),
    ("suffix_dedup", cut_repeats),
    ("packing", pack_sequences),
]

#: Tokens and trained weights are beyond SQL; tests hold the near-copy stage against brute force, the others against planted rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
