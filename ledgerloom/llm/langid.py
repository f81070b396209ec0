"""Language identification by the nearest of several centroids per language."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerloom.llm.common import arrow_map, materialize, numbered

#: A letter, for Spark's `rlike`; numbers that Unicode has as characters (½, Ⅷ) are none.
HAS_LETTER = r"\p{L}"
#: Languages whose centroids reach the driver and the executors at once.
LANG_BLOCK = 256
#: What separates letters, in UTF-8: ASCII other than letters becomes a space, upper case lower case.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))
_RUNS = re.compile(rb" {2,}")


def ngram_counts(text: str, dim: int) -> np.ndarray:
    """Counts of the byte trigrams and pairs of a text, hashed to `dim` (a power of two) features. Case of letters
    counts as lower, and all that stands between words as one space."""
    data = _RUNS.sub(b" ", b" %b " % text.lower().encode("utf-8", "replace").translate(_FOLD))
    b = np.frombuffer(data, np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(dim, np.float32)
    shift = np.uint32(32 - dim.bit_length() + 1)
    two = (b[:-1] << np.uint32(8)) | b[1:]
    three = (two[:-1] << np.uint32(8)) | b[2:]
    codes = np.concatenate([three * np.uint32(2654435761) >> shift, (two + np.uint32(1 << 24)) * np.uint32(2654435761) >> shift])
    return np.bincount(codes, minlength=dim).astype(np.float32)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def tf_idf(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit TF-IDF vectors of rows of counts, which are overwritten."""
    x = np.log1p(counts, out=counts)
    x *= idf
    x /= np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)
    return x


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


def spherical_kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    """k unit centroids of the unit rows of x; the first is the mean, each next starts at the row that all fit worst."""
    c = unit(x.mean(axis=0, keepdims=True))
    while len(c) < min(k, len(x)):
        c = np.vstack([c, x[np.argmin((x @ c.T).max(axis=1))]])
    for _ in range(rounds):
        near = (x @ c.T).argmax(axis=1)
        new = np.vstack([x[near == i].mean(axis=0) if (near == i).any() else c[i] for i in range(len(c))])
        new = unit(new)
        if np.allclose(new, c):
            break
        c = new
    return c


class Block:
    """Some languages of a model: unit centroids as rows, the language of each, and the lowest cosine that is still
    taken for it."""

    def __init__(self, rows: list, dim: int):
        parts = [np.frombuffer(bytes(r.centroids), np.float32).reshape(-1, dim) for r in rows]
        self.centroids = np.vstack(parts)
        self.langs = [r.lang for r, c in zip(rows, parts, strict=True) for _ in c]
        self.floor = {r.lang: r.floor for r in rows}

    def nearest(self, x: np.ndarray) -> tuple[str, float, bool]:
        """Language of the nearest centroid, cosine, and whether that is too far; of equal ones the first counts."""
        cos = self.centroids @ x
        i = int(cos.argmax())
        score = float(min(1.0, max(0.0, cos[i])))
        return self.langs[i], score, score < self.floor[self.langs[i]]


class Model:
    """idf: weight of each feature; table: a stored row (lang, floor, centroids) for each language."""

    def __init__(self, idf: np.ndarray, table: DataFrame, langs: list[str]):
        self.idf, self.table, self.langs = idf, table, langs

    def blocks(self) -> Iterator[Block]:
        """The languages by name, LANG_BLOCK at a time, so that the driver holds the centroids of these only."""
        for i in range(0, len(self.langs), LANG_BLOCK):
            names = self.langs[i : i + LANG_BLOCK]
            yield Block(self.table.where(F.col("lang").between(names[0], names[-1])).orderBy("lang").collect(), len(self.idf))


def fit(docs: DataFrame, per_lang: int = 600, centroids: int = 4, dim: int = 8192, slack: float = 0.25, text: str = "text", lang: str = "lang", key: str = "doc_id") -> Model:
    """Learns from a bounded sample: of each language the `per_lang` labelled rows with the smallest hash of key and
    text. Only rows with a letter count, and rows of the same key and text as one. Every label is learned, however many
    there are.

    Clustering runs on the executors, a language (at most per_lang sparse vectors of `dim` features) a group. The driver
    gets the names of the languages, `dim` counts and, block by block, the finished centroids.

    Labels and keys may be null (null labels aren't used); texts that are null or without a letter neither. With no
    row to learn from, the model knows no language and rejects every text. A language's rejection floor is `slack`
    times the lowest cosine to its centroids that was seen among its sampled texts.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{key}`").cast("string").alias("key"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").rlike(HAS_LETTER)).select("text", "lang", F.xxhash64("key", "text", F.lit("langid")).alias("h"))
    # hashes below a language's limit are about twice as many as asked for; the window then sorts only these
    share = F.least(F.lit(1.0), F.lit(2.0 * per_lang) / F.col("d"))
    limits = rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("d")).select(F.col("lang").alias("l"), (share * 2.0**64 - 2.0**63).alias("most"))
    limits = materialize(limits, "limits")  # one short row for each language
    near = rows.join(limits, F.col("lang") == F.col("l")).where(F.col("h") < F.col("most")).groupBy("lang", "h").agg(F.first("text").alias("text"))
    order = Window.partitionBy("lang").orderBy("h")
    sample = near.withColumn("r", F.row_number().over(order)).where(F.col("r") <= per_lang).select("lang", "h", "text")

    def features(batches):
        for b in batches:
            keep = [(name, h, ngram_counts(t, dim)) for name, h, t in zip(*(c.to_pylist() for c in b.columns), strict=True) if has_letter(t)]
            at = [np.flatnonzero(v).astype(np.int32) for _, _, v in keep]
            cols = [pa.array([k[0] for k in keep], pa.string()), pa.array([k[1] for k in keep], pa.int64()), pa.array([x.tobytes() for x in at], pa.binary()), pa.array([k[2][x].tobytes() for k, x in zip(keep, at, strict=True)], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["lang", "h", "at", "v"])

    vectors = materialize(arrow_map(sample, features, "lang string, h long, at binary, v binary"), "vectors")

    def seen_in(batches):
        seen = np.zeros(dim + 1, np.int64)  # the last one counts the vectors
        for b in batches:
            seen[dim] += b.num_rows
            for at in b.column(0).to_pylist():
                seen[np.frombuffer(at, np.int32)] += 1
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(seen[some])], names=["f", "n"])

    seen = np.zeros(dim + 1, np.int64)
    for r in arrow_map(vectors.select("at"), seen_in, "f int, n long").groupBy("f").agg(F.sum("n").alias("n")).collect():
        seen[r.f] = r.n
    idf = (np.log((1 + seen[dim]) / (1 + seen[:dim])) + 1).astype(np.float32)

    def cluster(own: pa.Table) -> pa.Table:
        own = own.sort_by("h")
        x = np.zeros((own.num_rows, dim), np.float32)
        for row, at, v in zip(x, own.column("at").to_pylist(), own.column("v").to_pylist(), strict=True):
            row[np.frombuffer(at, np.int32)] = np.frombuffer(v, np.float32)
        x = tf_idf(x, idf)
        c = spherical_kmeans(x, centroids, 0).astype(np.float32)
        floor = slack * float((x @ c.T).max(axis=1).min())
        return pa.table({"lang": own.column("lang").slice(0, 1).cast(pa.string()), "floor": pa.array([floor], pa.float64()), "centroids": pa.array([c.tobytes()], pa.binary())})

    table = materialize(vectors.groupBy("lang").applyInArrow(cluster, "lang string, floor double, centroids binary"), "centroids")
    return Model(idf, table, [r.lang for r in table.select("lang").orderBy("lang").collect()])


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with lang_pred, score (cosine to the nearest centroid, 0 to 1) and rejected.

    Only the text is looked at, all of it. Null texts and texts without a letter: `und`, 0, rejected. A text whose
    nearest centroid is further than that language's floor keeps the name of the language and is marked rejected.
    Other columns are carried along; ones that bear the names of the new columns are replaced. LANG_BLOCK languages are
    compared in one pass over docs; the best of all passes counts.
    """
    new = ("lang_pred", "score", "rejected")
    kept = docs.drop(*new)
    at = kept.columns.index(text)
    rows, _ = numbered(kept)
    out = rows.select("*", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"))
    fields = StructType([*rows.schema.fields]).add("lang_pred", "string").add("score", "double").add("rejected", "boolean")
    idf = model.idf
    for block in model.blocks():
        shared = kept.sparkSession.sparkContext.broadcast(block)  # LANG_BLOCK * centroids * dim floats at most

        def run(batches, shared=shared):
            nearest = shared.value.nearest
            for b in batches:
                rows = zip(b.column(at).to_pylist(), *(c.to_pylist() for c in b.columns[-3:]), strict=True)
                got = []
                for t, *best in rows:
                    if t is not None and has_letter(t):
                        now = nearest(tf_idf(ngram_counts(t, len(idf)), idf))
                        best = now if best[0] == "und" or now[1] > best[1] else best
                    got.append(best)
                more = [pa.array([g[i] for g in got], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
                yield pa.RecordBatch.from_arrays([*b.columns[:-3], *more], names=b.schema.names)

        out = arrow_map(out, run, fields)
    return out.toDF(*kept.columns, *new)
