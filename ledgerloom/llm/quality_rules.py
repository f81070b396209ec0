"""Quality rules with risk-controlled thresholds.

Each rule has a score (higher is worse) and a fixed list of cutoffs from lenient to strict; none of it is learned. On the
labelled documents of good quality, per stratum, an exact binomial bound says which cutoffs reject no more than a stated
share of good documents. Cutoffs are tested in their order and the first that isn't proven ends a rule (fixed-sequence
testing), so a rule takes one share of the error probability whatever its number of cutoffs; rules and strata share it by
Bonferroni. With too few labels nothing is proven and nothing is rejected.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import arrow_map, materialize, numbered, texts_of

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
#: Rules and their cutoffs, lenient to strict; scores are whole numbers, so that every engine compares them alike: symbols,
#: repeated words and repeated lines by thousandths, word lengths by hundredths.
CUTOFFS: dict[str, tuple[int, ...]] = {
    "symbols": (200, 150, 100, 75, 50, 40, 30, 20),
    "repeats": (200, 175, 150, 125, 100, 75, 50),
    "lines": (700, 600, 500, 400, 300, 200, 100),
    "long_words": (2000, 1500, 1200, 1100, 1000, 900),
    "short_words": (-150, -200, -250, -300, -350),
}
#: Share of good documents that all rules together may reject in a stratum, and the probability that any stratum breaks it.
ALPHA, DELTA = 0.05, 0.05
#: Copies of a stratum's thresholds, so that documents of one stratum are spread when thresholds are joined to them.
SALTS = 32


def scores() -> dict[str, Column]:
    """Score of each rule from the counts; 0 (or less) where there is nothing to measure."""
    c = F.col
    per = lambda n, of, scale: F.when(c(of) > 0, F.expr(f"({n} * {scale}L) div {of}")).otherwise(F.lit(0))
    return {
        "symbols": per("n_symbols", "word_chars", 1000),
        "repeats": per("n_repeat_words", "n_words", 1000),
        "lines": per("n_dup_lines", "n_lines", 1000),
        "long_words": per("word_chars", "n_words", 100),
        "short_words": F.when(c("n_words") > 0, -F.expr("(word_chars * 100L) div n_words")).otherwise(F.lit(-(10**6))),
    }


def repeated_words(words: list[bytes], width: int = 5) -> int:
    """How many words stand in windows of `width` words that are found twice or more in the text. Exact: words, then ever
    longer windows, are numbered by their rank among the distinct ones."""
    n = len(words)
    if n <= width:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)
    if len(known) == n:
        return 0
    window, size = ids, n
    for k in range(1, width):
        _, window = np.unique(window[: n - k] * size + ids[k:], return_inverse=True)
    hit = np.bincount(window)[window] > 1
    if not hit.any():
        return 0
    edge = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(hit)
    edge[at] += 1
    edge[at + width] -= 1
    return int(np.count_nonzero(np.cumsum(edge[:-1])))


def counts_of(text: bytes) -> tuple[int, ...]:
    """COUNTS of a text; n_lines are lines with a word."""
    words = text.split()
    if not words:
        return 0, 0, 0, 0, 0, 0
    points = sum(map(len, words)) - np.count_nonzero((np.frombuffer(text, np.uint8) & 0xC0) == 0x80)
    symbols = sum(map(text.count, (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">")))
    lines = [line for line in text.split(b"\n") if line and not line.isspace()]
    return len(words), int(points), symbols, len(lines) - len(set(lines)), repeated_words(words), len(lines)


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns of docs but the text, and its COUNTS. Null text: no words. Columns of these names are replaced."""
    rest = [c for c in docs.columns if c != text and c not in COUNTS]
    rows, own = numbered(docs)
    narrow = rows.select(*[own[c] for c in rest], F.col(own[text]).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = np.array([counts_of(t or b"") for t in texts_of(b.column(b.num_columns - 1))], np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *[pa.array(got[:, i]) for i in range(len(COUNTS))]], names=[*b.schema.names[:-1], *COUNTS])

    fields = narrow.select(*[own[c] for c in rest]).schema
    for c in COUNTS:
        fields = fields.add(c, "long")
    return arrow_map(narrow, run, fields).toDF(*rest, *COUNTS)


def base_failed(least_words: int = 10, most_repeats: int = 20) -> Column:
    return (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeats * F.col("n_words"))


def chance_of_at_most(k: int, n: int, p: float) -> float:
    """P(Bin(n, p) <= k) for k below the mean, term by term from k down, where they only get smaller."""
    term = math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p))
    total, i = term, k
    while i > 0 and term > total * 1e-18:
        term *= i * (1 - p) / ((n - i + 1) * p)
        total += term
        i -= 1
    return total


def most_rejected(n: int, p: float, error: float) -> int:
    """The largest k with P(Bin(n, p) <= k) <= error; -1 if there is none. The exact bound of a share that rejected k of n
    good documents is at most p if and only if k is at most this."""
    if n <= 0 or n * math.log1p(-p) > math.log(error):
        return -1
    low, high = 0, math.floor(n * p)  # at the mean the chance is far above any error asked for
    while low + 1 < high:
        mid = (low + high) // 2
        low, high = (mid, high) if chance_of_at_most(mid, n, p) <= error else (low, mid)
    return low


def certify(held: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(stratum, rule, cutoff): the strictest proven cutoff of each rule; none, no row. held: one row per labelled good
    document with `stratum` and the COUNTS. Documents are reduced to one row per stratum, rule and step of the cutoffs
    (map-side first), and only these rows are compared; strata, however many, stay rows."""
    steps = []
    for rule, score in scores().items():
        # the first cutoff, by its number from 1, that rejects the document; all later ones do too
        steps.append(F.struct(F.lit(rule).alias("rule"), (1 + sum((score <= c).cast("int") for c in CUTOFFS[rule])).alias("step")))
    counted = held.select("stratum", F.explode(F.array(*steps)).alias("x")).groupBy("stratum", "x.rule", "x.step").agg(F.count("*").alias("m"))
    total = counted.groupBy("stratum", "rule").agg(F.sum("m").alias("n"), F.map_from_entries(F.collect_list(F.struct("step", "m"))).alias("by_step"))
    grid = F.explode(F.array(*[F.struct(F.lit(rule).alias("r"), F.lit(i + 1).alias("step"), F.lit(c).alias("cutoff")) for rule, cs in CUTOFFS.items() for i, c in enumerate(cs)]))
    rejected = F.aggregate(F.map_keys("by_step"), F.lit(0).cast("long"), lambda s, k: s + F.when(k <= F.col("g.step"), F.element_at("by_step", k)).otherwise(0))
    tests = total.withColumn("g", grid).where("g.r = rule").select("stratum", "rule", "g.step", "g.cutoff", "n", rejected.alias("k"))
    strata = tests.agg(F.count_distinct("stratum").alias("strata"))  # one row
    share = alpha / len(CUTOFFS)

    @F.pandas_udf("long")
    def bound(n: pd.Series, strata: pd.Series) -> pd.Series:
        known = {x: most_rejected(x[0], share, delta / (len(CUTOFFS) * x[1])) for x in set(zip(n, strata, strict=True))}
        return pd.Series([known[x] for x in zip(n, strata, strict=True)])

    judged = tests.join(F.broadcast(strata)).withColumn("ok", F.col("k") <= bound("n", "strata"))
    upto = judged.withColumn("all_ok", F.min("ok").over(Window.partitionBy("stratum", "rule").orderBy("step")))
    return upto.where("all_ok").groupBy("stratum", "rule").agg(F.max_by("cutoff", "step").alias("cutoff"))


def judge(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", stratum: str = "lang", good: Column | None = None, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """One row per document: the key, COUNTS, base_failed, stratum, rejected_by (the rules whose proven cutoff the document
    is beyond, in the order of CUTOFFS) and kept.

    A label counts if `good` holds for it (quality = 1); the document with its key then is a good one of its stratum, unless
    it fails the base rules, which no cutoff can help. A key that several labels speak of is good if any says so; repeated
    documents each count. Null strata are the stratum `und`; null keys have no label. Null and empty texts have no words
    and fail the base rules. Whole texts are measured, whatever their length. An empty table gives an empty one; empty
    labels prove nothing, and only the base rules reject. Other columns aren't returned, whatever they are called.
    """
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{stratum}`").cast("string"), F.lit("und")).alias("stratum"), F.col(f"`{text}`").alias("text"))
    found = materialize(measure(rows).withColumn("base_failed", base_failed()), "measured")
    is_good = F.col("quality") == 1 if good is None else good
    known = labels.where(is_good).select(F.col(f"`{key}`").alias("__k")).distinct()
    held = found.where("not base_failed").join(known, F.col("key") == F.col("__k"), "left_semi")
    limits = certify(held, alpha, delta).groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("limits"))
    salted = limits.select(F.col("stratum").alias("__s"), "limits", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__salt"))
    dealt = found.withColumn("__own", F.pmod(F.xxhash64("key", "n_words", "word_chars"), F.lit(SALTS)).cast("int"))
    both = dealt.join(salted, (F.col("stratum") == F.col("__s")) & (F.col("__own") == F.col("__salt")), "left")
    beyond = [F.when(score > F.element_at("limits", rule), F.lit(rule)) for rule, score in scores().items()]
    out = both.withColumn("rejected_by", F.filter(F.array(*beyond), lambda r: r.isNotNull()))
    return out.select(F.col("key").alias(key), *COUNTS, "base_failed", "stratum", "rejected_by", (~F.col("base_failed") & (F.size("rejected_by") == 0)).alias("kept"))
