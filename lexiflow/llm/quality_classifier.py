"""Quality classifier: a weak-label model and a hashed linear scorer.

1. Labellers. Overlapping heuristics vote good, bad or abstain on every document, in one Spark projection. The documents
   are counted by their pattern of votes; there are at most 3 to the number of labellers patterns, however many documents.
2. Weak labels. Expectation-maximisation over the pattern counts estimates how often each labeller votes what on good
   and on bad documents, and the share of good ones; each pattern gets its posterior.
3. Scorer. A logistic model of hashed word shapes (runs of lower-case letters as ``a``, upper-case ``A``, digits ``0``),
   repeated neighbours and repeated lines is fitted to the posteriors of at most ``SAMPLE`` documents, those with the
   least hashes of their keys. Every document is then scored by built-in functions over its own row.

The labels table is not used for fitting; it is what the tests measure accuracy on.

Rows that are kept are taken with ``common.where``, never with a plain filter on ``keep``.

Edge cases: null texts and texts without words score 0 and are rejected; repeated rows are scored alike; ties at the edge
of the sample all belong to it; an empty table gives an empty result. Other columns stay; a column named ``score`` or
``keep`` is replaced.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from .common import carried, named, stored, uncarried
from .quality_rules import NOT_SPACE, SPACE, STOP_WORDS

DIMENSIONS = 1024
SAMPLE = 8000
KEEP = 0.5
ROUNDS, EPOCHS = 200, 300


def _with_words(df: DataFrame, text: str, but: tuple[str, ...]) -> tuple[DataFrame, list[str]]:
    """(row, text, words, lines), and the names of the row's fields."""
    body = F.coalesce(named(text), F.lit(""))
    row, names = carried(df, but)
    return df.select(row, body.alias("text"), F.array_remove(F.split(body, SPACE), "").alias("words"), F.filter(F.split(body, "\n"), lambda x: x.rlike(NOT_SPACE)).alias("lines")), names


def _neighbours() -> Column:
    """Places of words that equal the word before."""
    w = F.col("words")
    return F.filter(w, lambda x, i: (i > 0) & (x == F.get(w, F.greatest(i - 1, F.lit(0)))))


def votes(df: DataFrame, text: str = "text") -> DataFrame:
    """The input's columns and ``pattern``: one character a labeller, 1 good, 0 bad, - abstain."""
    n = F.greatest(F.size("words"), F.lit(1))
    m = {
        "symbols": F.regexp_count("text", F.lit(r"[#*$%&|<>]")) / n,
        "upper": F.regexp_count("text", F.lit(r"\p{Lu}")) / F.greatest(F.regexp_count("text", F.lit(r"\p{L}")), F.lit(1)),
        "bangs": F.regexp_count("text", F.lit("!!")) / n,
        "bars": F.regexp_count("text", F.lit(r"(?:^|\s)\|")) / n,
        "echo": F.size(_neighbours()) / n,
        "variety": F.size(F.array_distinct("words")) / n,
        "stops": F.size(F.filter("words", lambda x: F.lower(x).isin(STOP_WORDS))) / n,
        "ends": F.regexp_count("text", F.lit(r"\p{Ll}[.?!](?:\s|$)")) / n,
        "repeats": (F.size("lines") - F.size(F.array_distinct("lines"))) / F.greatest(F.size("lines"), F.lit(1)),
    }
    df, names = _with_words(df, text, ("pattern",))
    df = df.select("row", F.size("words").alias("n"), *(e.alias(c) for c, e in m.items()))
    c, long, no = F.col, F.col("n") >= 20, F.lit("-")
    labellers = [
        F.when(c("symbols") > 0.3, "0").when(c("symbols") < 0.02, "1").otherwise(no),
        F.when(c("upper") > 0.5, "0").otherwise(no),
        F.when(c("bangs") > 0.2, "0").otherwise(no),
        F.when(c("bars") > 0.1, "0").otherwise(no),
        F.when(c("echo") > 0.3, "0").otherwise(no),
        F.when((c("n") >= 50) & (c("variety") < 0.25), "0").otherwise(no),
        F.when(long & (c("stops") < 0.02), "0").when(long & (c("stops") > 0.1) & (c("upper") < 0.2), "1").otherwise(no),
        F.when(long & (c("ends") == 0), "0").when((c("ends") > 0.02) & (c("ends") < 0.4), "1").otherwise(no),
        F.when(c("repeats") > 0.3, "0").otherwise(no),
        F.when(c("n") == 0, "0").otherwise(no),
    ]
    return df.select(*uncarried(names), F.concat(*labellers).alias("pattern"))


def estimate(counts: dict[str, int], rounds: int = ROUNDS) -> tuple[dict[str, float], np.ndarray, float]:
    """Posterior of good for each pattern, P(vote | class) of each labeller (class, labeller, vote), and P(good)."""
    patterns = sorted(counts)
    if not patterns:
        return {}, np.zeros((2, 0, 3)), 0.5
    v = np.array([["01-".index(x) for x in p] for p in patterns])
    weight = np.array([counts[p] for p in patterns], float)
    k = v.shape[1]
    table = np.empty((2, k, 3))
    table[0], table[1] = (0.35, 0.05, 0.6), (0.01, 0.3, 0.69)
    good = 0.85
    at = np.arange(k)
    for _ in range(rounds):
        like = [np.log(p) + np.log(table[c, at, v]).sum(1) for c, p in ((0, 1 - good), (1, good))]
        posterior = 1 / (1 + np.exp(np.clip(like[0] - like[1], -500, 500)))
        for c, p in ((0, 1 - posterior), (1, posterior)):
            w = p * weight
            for x in range(3):
                table[c, :, x] = ((v == x) * w[:, None]).sum(0) + 0.5
            table[c] /= table[c].sum(1, keepdims=True)
        good = float(np.clip((posterior * weight).sum() / weight.sum(), 0.01, 0.99))
    return dict(zip(patterns, posterior.tolist())), table, good


def tokens(dimensions: int) -> Column:
    """Hashed tokens of a row that has ``shapes`` (of words), ``words`` and ``lines``: indices from 1."""
    again = F.greatest(F.size("lines") - F.size(F.array_distinct("lines")), F.lit(0))
    names = F.concat(F.col("shapes"), F.transform(_neighbours(), lambda x: F.lit("=again")), F.array_repeat(F.lit("=line"), again))
    return F.transform(names, lambda x: F.pmod(F.xxhash64(x), F.lit(dimensions)).cast("int") + 1)


def hashed(df: DataFrame, text: str = "text", dimensions: int = DIMENSIONS, but: tuple[str, ...] = ()) -> tuple[DataFrame, list[str]]:
    """(row, f): the input's columns but ``but`` as a struct, and the hashed tokens of the text; and the struct's fields."""
    df, names = _with_words(df, text, but)
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", r"\p{Ll}+", "a"), r"\p{Lu}+", "A"), r"\p{N}+", "0")
    df = df.select("row", "words", "lines", F.array_remove(F.split(shape, SPACE), "").alias("shapes"))
    return df.select("row", tokens(dimensions).alias("f")), names


def fit(rows: DataFrame, dimensions: int = DIMENSIONS, epochs: int = EPOCHS) -> list[float]:
    """Weights, the constant last, from (f, p): one task over the bounded sample; rows without tokens don't count."""
    import pyarrow as pa

    def run(batches):
        at, index, values, p = 0, [], [], []
        for b in batches:
            for f, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if not f:
                    continue
                found, n = np.unique(np.array(f, np.int64) - 1, return_counts=True)
                index.append(found + at * dimensions)
                values.append(n / n.sum())
                p.append(y)
                at += 1
        w, c = np.zeros(dimensions), 0.0
        if at:
            index, x, y = np.concatenate(index), np.concatenate(values), np.array(p)
            row, column = index // dimensions, index % dimensions
            m, s = np.zeros(dimensions + 1), np.zeros(dimensions + 1)
            for step in range(1, epochs + 1):
                miss = 1 / (1 + np.exp(-np.clip(np.bincount(row, x * w[column], at) + c, -40, 40))) - y
                g = np.append(np.bincount(column, x * miss[row], dimensions) / at + 1e-5 * w, miss.mean())
                m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
                move = 0.3 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
                w, c = w - move[:-1], c - move[-1]
        yield pa.RecordBatch.from_arrays([pa.array([[*w.tolist(), c]])], names=["weights"])

    return rows.select("f", "p").coalesce(1).mapInArrow(run, "weights array<double>").first()["weights"]


def _last(rows: DataFrame, sample: int, n: int):
    """The last of the ``sample`` least distinct (h, mark) of ``n`` rows, None of none.

    Only hashes in the share of their range that should hold four times the sample are shuffled. Where repeated rows
    leave too few there, all are.
    """
    at = rows.select(F.struct("h", "mark").alias("at"))
    edge = -(1 << 63) + (4 * sample << 64) // max(n, 1)
    for df in ([at.filter(F.col("at.h") < edge)] if edge < 1 << 63 else []) + [at]:
        found = df.distinct().orderBy("at").limit(sample).agg(F.max("at").alias("at"), F.count("*").alias("n")).first()
        if found["n"] >= sample:
            break
    return found["at"]


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE, dimensions: int = DIMENSIONS) -> list[float]:
    """Weights of the scorer: votes and pattern counts over all documents, the fit over ``sample`` of them.

    The sample are the rows with the least hashes of key and text; of equal rows it has one, so it is bounded.
    """
    all_rows = docs.select(F.xxhash64(named(key)).alias("h"), F.xxhash64(named(text)).alias("mark"), named(text).alias("text"))
    counts = {r["pattern"]: r["count"] for r in votes(all_rows.select("text")).groupBy("pattern").count().collect()}
    posterior, _, _ = estimate(counts)
    last = _last(all_rows, sample, sum(counts.values()))
    if last is None:
        return [0.0] * (dimensions + 1)
    least = (F.col("h") < last["h"]) | ((F.col("h") == last["h"]) & (F.col("mark") <= last["mark"]))
    chosen = all_rows.filter(least).groupBy("h", "mark").agg(F.first("text").alias("text")).select("text")
    patterns = docs.sparkSession.createDataFrame(list(posterior.items()), "pattern string, p double")
    rows, _ = hashed(votes(chosen).join(F.broadcast(patterns), "pattern").select("text", "p"), "text", dimensions)
    # Rows without tokens are left out where the model is fitted: a filter here would repeat the hashing below the join.
    return fit(stored(rows.select("f", "row.p"), "sample"), dimensions)


def score(docs: DataFrame, weights: list[float], text: str = "text", keep: float = KEEP) -> DataFrame:
    """The rows with ``score``, the probability of good, and ``keep``."""
    dimensions = len(weights) - 1
    table = F.lit(weights[:-1])
    rows, names = hashed(docs, text, dimensions, ("score", "keep"))
    total = F.aggregate("f", F.lit(0.0), lambda a, i: a + F.element_at(table, i)) / F.size("f") + F.lit(weights[-1])
    value = F.when(F.size("f") > 0, 1 / (1 + F.exp(-total))).otherwise(F.lit(0.0))
    return rows.select("row", value.alias("score")).select(*uncarried(names), "score").withColumn("keep", F.col("score") >= keep)


def quality_scores(docs: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> DataFrame:
    return score(docs, train(docs, key, text, sample), text)


def op2_quality_classifier(spark, sf_dir: str) -> DataFrame:
    from .common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_scores(docs).select("doc_id", "score", "keep")
