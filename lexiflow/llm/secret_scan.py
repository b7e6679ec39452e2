"""Secret scans: fixed patterns, and a battery of randomness tests with length-aware false-discovery control.

Base spans are matches of three patterns, leftmost and non-overlapping per kind, those too short dropped. The method adds
spans of kind ``random``: runs of ``LEAST`` or more characters of ``[A-Za-z0-9+/_-]`` outside base spans that look drawn
by chance.

1. Encoding. A run's alphabet is the first of decimal, hexadecimal (either case), one case of letters, base 32, one case of
   letters with digits, base 62, base 64 and its form for URLs that has all its characters.
2. Battery. Under "each character is drawn evenly from the alphabet": chi-squared of its counts, the number of runs above
   and below the alphabet's middle (Wald and Wolfowitz), and the correlation of neighbours' values, the last two by their
   normal limits, the first by the cube root of Wilson and Hilferty. A run that one of them rejects (``REJECT`` in all) is
   not random.
3. Evidence. What passes may be short or ordinary by luck. Two p-values say how likely ordinary writing in its alphabet is to
   look so: that its sum of squared counts is as small (``ORDINARY``: how often letters of either case, digits and signs
   come; a normal limit with this sum's exact mean and variance for the length), and that it changes as often between
   lower case, upper case, digits and signs (binomial, ``CHANGE`` a place). Fisher's rule combines them. Decimal runs have
   no such evidence: p is 1.
4. Control. Runs are counted by length class and p-value bin over the whole corpus (a table of bounded size), and in each
   class Benjamini and Hochberg's step-up rule at ``FDR`` sets the largest bin that is accepted. A bin's p-value is its
   upper end, which is on the safe side. So short runs need more evidence than the many other short ones, and long ones
   are not judged by short ones' number.

Edge cases: null and empty texts have no spans; repeated rows count one by one; ties of start go by the order of kinds;
empty tables give empty results; columns that are not asked for are dropped, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import re
from statistics import NormalDist

from pyspark.sql import DataFrame, functions as F

from .common import byte_blocks, stored

#: Kinds and patterns; of ``assign`` the second group counts.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile("AKIA[A-Z0-9]{16,}")  # a maximal run of 20 or more
HEX = re.compile("[0-9a-f]{24,}")
KINDS, ASSIGNED = ("assign", "access", "hex", "random"), 6
LEAST, FDR, REJECT = 16, 0.01, 0.01
RUN = re.compile(rf"[A-Za-z0-9+/_-]{{{LEAST},}}")
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Alphabets, tried in this order.
ALPHABETS = (
    DIGITS, DIGITS + "abcdef", DIGITS + "ABCDEF", LOWER, UPPER, UPPER + "234567", DIGITS + LOWER, DIGITS + UPPER, UPPER + LOWER + DIGITS, UPPER + LOWER + DIGITS + "+/",
    UPPER + LOWER + DIGITS + "-_", UPPER + LOWER + DIGITS + "+/-_",
)
#: Weights of ordinary writing: letters by their usual order of frequency, shared out over cases, digits and signs.
LETTERS = "etaoinshrdlcumwfgypbvkjxqz"
ORDINARY = {c: 1 / (i + 2) for i, c in enumerate(LETTERS)} | {c.upper(): 0.15 / (i + 2) for i, c in enumerate(LETTERS)} | dict.fromkeys(DIGITS, 0.06) | dict.fromkeys("+/-_", 0.04)
#: Chance that ordinary writing goes on with a character of another class.
CHANGE = 0.2
#: Bins of a p-value by its binary logarithm, and length classes: four to each doubling.
BINS, PER_BIT, CLASSES = 256, 4, 4
_normal = NormalDist()


class Alphabet:
    """An alphabet's symbols, and the moments of squared counts that ordinary writing in it has."""

    def __init__(self, symbols: str):
        self.symbols, self.k = frozenset(symbols), len(symbols)
        self.value = {c: i for i, c in enumerate(symbols)}
        total = sum(ORDINARY[c] for c in symbols)
        q = [ORDINARY[c] / total for c in symbols]
        self.s2, self.s3 = sum(x * x for x in q), sum(x**3 for x in q)

    def ordinary(self, squares: int, n: int) -> float:
        """Chance that ``n`` ordinary characters have a sum of squared counts of ``squares`` or less."""
        pairs = n * (n - 1)
        mean = n + pairs * self.s2
        var = 2 * pairs * (self.s2 + 2 * (n - 2) * self.s3 - (2 * n - 3) * self.s2**2)
        # The limit is too thin far out, so it is not asked there.
        return max(1e-6, self._below(squares, mean, var))

    @staticmethod
    def _below(squares: int, mean: float, var: float) -> float:
        return _normal.cdf((squares + 0.5 - mean) / math.sqrt(var)) if var > 1e-9 else 1.0


_alphabets = [Alphabet(x) for x in ALPHABETS]


def alphabet_of(run: str) -> Alphabet:
    seen = set(run)
    return next(a for a in _alphabets if seen <= a.symbols)


def battery(run: str, a: Alphabet) -> tuple[float, float, float, int]:
    """p-values of evenness, runs and correlation of neighbours under chance, and the sum of squared counts."""
    v = [a.value[c] for c in run]
    n, k = len(v), a.k
    counts: dict[int, int] = {}
    for x in v:
        counts[x] = counts.get(x, 0) + 1
    squares = sum(c * c for c in counts.values())
    chi, df = squares * k / n - n, k - 1
    t = 2 / (9 * df)
    even = _normal.cdf((1 - t - (max(chi, 0) / df) ** (1 / 3)) / math.sqrt(t))
    high = [2 * x >= k for x in v]
    up = sum(high)
    down = n - up
    turns = 1 + sum(x != y for x, y in zip(high, high[1:]))
    mean = 1 + 2 * up * down / n
    var = (mean - 1) * (mean - 2) / (n - 1)
    runs = 2 * _normal.cdf(-abs(turns - mean) / math.sqrt(var)) if var > 1e-9 else 0.0
    m = sum(v) / n
    spread = sum((x - m) ** 2 for x in v)
    r = sum((x - m) * (y - m) for x, y in zip(v, v[1:])) / spread if spread else 1.0
    serial = 2 * _normal.cdf(-abs(r + 1 / n) * math.sqrt(n))
    return even, runs, serial, squares


def class_changes(run: str) -> float:
    """Chance that ordinary writing changes its class of characters as often."""
    kinds = ["a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else "-" for c in run]
    n, k = len(run) - 1, sum(x != y for x, y in zip(kinds, kinds[1:]))
    if k <= n * CHANGE:
        return 1.0
    term = lambda i: math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(CHANGE) + (n - i) * math.log(1 - CHANGE))
    p = 0.0
    for i in range(k, n + 1):
        p += (t := term(i))
        if t < p * 1e-12 or t == 0.0:  # terms fall from here on
            break
    return max(p, 1e-300)


def evidence(run: str) -> float:
    """p-value of a run against ordinary writing; 1 if it is not random at all."""
    a = alphabet_of(run)
    if a.k == len(DIGITS):
        return 1.0
    even, runs, serial, squares = battery(run, a)
    if min(even, runs, serial) < REJECT / 3:
        return 1.0
    both = math.log(a.ordinary(squares, len(run))) + math.log(class_changes(run))
    return math.exp(both) * (1 - both)


def bin_of(p: float) -> int:
    """Bin ``b`` holds p-values up to ``2 ** (-b / PER_BIT)``."""
    return min(BINS - 1, int(-math.log2(max(p, 1e-300)) * PER_BIT))


def class_of(n: int) -> int:
    return int(math.log2(n) * CLASSES)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns' matches."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGNED]
    for kind, pattern in ((1, ACCESS), (2, HEX)):
        found += [(m.start(), kind, m.end()) for m in pattern.finditer(text)]
    return sorted(found)


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Runs that no base span touches."""
    out, i, reach = [], 0, 0
    for m in RUN.finditer(text):
        while i < len(base) and base[i][0] < m.end():
            reach = max(reach, base[i][2])
            i += 1
        if reach <= m.start():
            out.append(m.span())
    return out


def said(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _scanned(df: DataFrame, key: str, text: str) -> DataFrame:
    """Base spans of each row, and candidates as (start, stop, bin, length class)."""
    import pyarrow as pa

    span = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("stop", pa.int32())]))
    tried = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("bin", pa.int32()), ("class", pa.int32())]))

    def run(batches):
        for b in byte_blocks(batches, 4 << 20, "__text"):
            base, runs = [], []
            for t in b.column(1).to_pylist():
                spans = base_spans(t) if t else []
                base.append([{"start": a, "kind": k, "stop": z} for a, k, z in spans])
                runs.append([{"start": a, "stop": z, "bin": bin_of(evidence(t[a:z])), "class": class_of(z - a)} for a, z in (candidates(t, spans) if t else [])])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(base, span), pa.array(runs, tried)], names=["key", "base", "runs"])

    kinds = f"key {dict(df.dtypes)[key]}, base array<struct<start: int, kind: int, stop: int>>, runs array<struct<start: int, stop: int, bin: int, class: int>>"
    return df.selectExpr(f"`{key}` AS key", f"`{text}` AS __text").mapInArrow(run, kinds)


def accepted(counts: dict[int, dict[int, int]], rate: float = FDR) -> dict[int, int]:
    """For each length class the least bin (largest p-value) that the step-up rule accepts; ``counts``: class, bin, runs."""
    out = {}
    for c, bins in counts.items():
        total, below = sum(bins.values()), 0
        for b in sorted(bins, reverse=True):
            below += bins[b]
            if b and 2 ** (-b / PER_BIT) <= rate * below / total:
                out[c] = b
    return out


def secret_spans(df: DataFrame, key: str = "doc_id", text: str = "text", rate: float = FDR) -> DataFrame:
    """(key, n_assign, n_access, n_hex, base_sha256, spans) of each row; ``spans`` is kind:start:end, comma-joined."""
    import pyarrow as pa

    rows = stored(_scanned(df, key, text), "scanned")
    counts: dict[int, dict[int, int]] = {}
    # At most a row for each length class and bin.
    for r in rows.select(F.explode("runs").alias("r")).groupBy("r.class", "r.bin").count().collect():
        counts.setdefault(r[0], {})[r[1]] = r[2]
    least = accepted(counts, rate)

    def run(batches):
        for b in batches:
            base = [[(x["start"], x["kind"], x["stop"]) for x in xs] for xs in b.column(1).to_pylist()]
            more = [[(x["start"], 3, x["stop"]) for x in xs if x["bin"] >= least.get(x["class"], BINS)] for xs in b.column(2).to_pylist()]
            n = [pa.array([sum(x[1] == k for x in xs) for xs in base], pa.int64()) for k in range(3)]
            digests = [hashlib.sha256(said(xs).encode()).hexdigest() for xs in base]
            yield pa.RecordBatch.from_arrays([b.column(0), *n, pa.array(digests, pa.string()), pa.array([said(sorted(x + y)) for x, y in zip(base, more)], pa.string())], names=[key, "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return rows.mapInArrow(run, f"`{key}` {dict(df.dtypes)[key]}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string")


def op12_secret_scan(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return secret_spans(table(spark, sf_dir, "documents"))
