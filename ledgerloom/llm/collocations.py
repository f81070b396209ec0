"""Phrase collocation mining with Rabin-Karp fingerprints.

A task writes the words of its documents once, as blocks of word numbers with their dictionary. NumPy prefix polynomials
hash every n-gram of a block; its distinct fingerprints go to the counting tasks as sorted packed runs, where an entry's
place is its pointer back to the occurrences in its block. A counting task adds up a range of fingerprints over all blocks
and answers each block with a bit per entry: found often enough or not. Pairs and single words go first; triples only where
both their pairs are frequent. Fingerprints are candidates only: a block then spells the frequent ones from its text, each
occurrence compared word by word with the first one of its fingerprint, and Spark adds up the spelled phrases.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.alignment import pack, unpack
from ledgerloom.llm.common import RollingHash, WordIds, arrow_map, materialize, mix64, partitions, texts_of

#: ASCII characters that end a piece, all turned into one that is set apart as a word of its own, number 0 of each block.
ENDS = bytes.maketrans(b",;:!?\n\x0b\x0c\r", b"." * 9)
#: Bytes of text in a block, words whose n-grams fall in a range of fingerprints, entries in a packed frame.
BLOCK_BYTES, RANGE_WORDS, FRAME = 8 << 20, 4_000_000, 1 << 18
#: Parts that a language's candidates are ranked in before its best ones meet.
PARTS = 64


class Block:
    """The words of documents of several languages: ids (0: a piece ends) by language, and the dictionary."""

    SCHEMA = pa.schema([("langs", pa.list_(pa.string())), ("ends", pa.list_(pa.int64())), ("n", pa.list_(pa.int64())), ("ids", pa.binary()), ("words", pa.binary())])
    DDL = "langs array<string>, ends array<long>, n array<long>, ids binary, words binary"

    def __init__(self):
        self.known: dict[bytes, int] = {b".": 0}
        self.of: dict[str, list[np.ndarray]] = {}
        self.size = 0

    def add(self, lang: str, text: bytes) -> None:
        known = self.known
        words = text.lower().translate(ENDS).replace(b".", b" . ").split()
        ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int32, len(words))
        self.of.setdefault(lang, []).append(np.append(ids, np.int32(0)))
        self.size += len(text)

    def row(self) -> pa.RecordBatch:
        parts = {lang: np.concatenate(x) for lang, x in self.of.items()}
        ends, n = np.cumsum([len(x) for x in parts.values()]), [int(np.count_nonzero(x)) for x in parts.values()]
        ids, words = (zstandard.compress(x, 1) for x in (np.concatenate(list(parts.values())).tobytes(), b"\n".join(self.known)))
        cols = [[list(parts)], [ends.tolist()], [n], [ids], [words]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, self.SCHEMA.types, strict=True)], schema=self.SCHEMA)


class Grams:
    """The n-grams of a stored block. prints(k): the fingerprint of every n-gram of k words that doesn't go over the end of
    a piece, and where it starts; the language is part of it."""

    def __init__(self, langs: list[str], ends: list[int], ids: bytes, words: bytes):
        self.ids = np.frombuffer(zstandard.decompress(ids), np.int32)
        self.words = zstandard.decompress(words).split(b"\n")
        own, roll = WordIds(b"phrases"), RollingHash()
        self.hashes, self.roll = own.of(self.words)[self.ids], roll
        self.salts = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8, key=b"language").digest(), "little") for x in langs], np.uint64)
        self.lang = np.repeat(np.arange(len(langs), dtype=np.int32), np.diff(ends, prepend=0))
        self.stops = np.concatenate([np.zeros(1, np.int32), np.cumsum(self.ids == 0, dtype=np.int32)])

    def prints(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.ids) < k:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        at = np.flatnonzero(self.stops[k:] == self.stops[:-k])
        return mix64(self.roll.windows(self.hashes, k)[at] ^ self.salts[self.lang[at]] ^ np.uint64(k)), at

    def spelled(self, at: np.ndarray, prints: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """First occurrence of each distinct phrase of k words among those that start at `at`, and how often it is there.
        Equal fingerprints are checked against the words of the first one; where these differ, the words decide."""
        _, first, place, n = np.unique(prints, return_index=True, return_inverse=True, return_counts=True)
        same = np.ones(len(at), bool)
        for j in range(k):
            same &= self.ids[at + j] == self.ids[at[first][place] + j]
        if same.all():
            return at[first], n
        rows = np.stack([self.lang[at], *[self.ids[at + j] for j in range(k)]], axis=1)
        _, first, n = np.unique(rows, axis=0, return_index=True, return_counts=True)
        return at[first], n

    def phrases(self, at: np.ndarray, k: int) -> list[str]:
        spelled = [[self.words[i] for i in self.ids[at + j].tolist()] for j in range(k)]
        return [b" ".join(x).decode() for x in zip(*spelled, strict=True)]


def ranges_of(prints: np.ndarray, ranges: int) -> list[int]:
    """Where each equal range of fingerprints starts among sorted ones, and where the last one ends."""
    edges = np.array([-(-(i << 64) // ranges) for i in range(1, ranges)], np.uint64)
    return [0, *np.searchsorted(prints, edges).tolist(), len(prints)]


def run_of(prints: np.ndarray, n: np.ndarray) -> list[bytes]:
    """Sorted fingerprints and their counts in frames."""
    steps = np.diff(prints, prepend=np.uint64(0)).view(np.int64)
    return [pack(steps[i : i + FRAME], n[i : i + FRAME]) for i in range(0, len(prints), FRAME)]


def out_of(frames: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    steps, n = np.concatenate([unpack(f, 2) for f in frames], axis=1)
    return np.cumsum(steps.view(np.uint64), dtype=np.uint64), n


class Sent:
    """What a block sends for n-grams of the lengths `ks`: distinct fingerprints in order, counts, and where each range of
    them starts. Made again, the same, when the answers come."""

    def __init__(self, grams: Grams, ks: tuple[int, ...], ranges: int, often: np.ndarray | None = None):
        self.ks, found = ks, {}
        for k in ks:
            prints, at = grams.prints(k)
            if often is not None:  # a triple counts where both its pairs are frequent
                pair = np.zeros(len(grams.ids) + 1, bool)
                pair[often] = True
                keep = pair[at] & pair[at + 1]
                prints, at = prints[keep], at[keep]
            found[k] = prints, at
        self.found = found
        self.prints, self.n = np.unique(np.concatenate([p for p, _ in found.values()]), return_counts=True)
        self.edges = ranges_of(self.prints, ranges)

    def rows(self, block: int) -> pa.RecordBatch:
        full = [i for i in range(len(self.edges) - 1) if self.edges[i] < self.edges[i + 1]]
        runs = [run_of(self.prints[self.edges[i] : self.edges[i + 1]], self.n[self.edges[i] : self.edges[i + 1]]) for i in full]
        return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([block] * len(full), pa.int64()), pa.array(runs, pa.list_(pa.binary()))], names=["range", "block", "run"])

    def frequent(self, answers: dict[int, bytes]) -> np.ndarray:
        """The fingerprints that the answers call frequent, in order."""
        often = np.zeros(len(self.prints), bool)
        for i, bits in answers.items():
            s, e = self.edges[i], self.edges[i + 1]
            often[s:e] = np.unpackbits(np.frombuffer(bits, np.uint8), count=e - s).astype(bool)
        return self.prints[often]

    def where(self, k: int, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences of k words whose fingerprint is frequent: (where they start, fingerprints)."""
        prints, at = self.found[k]
        if len(frequent) == 0:
            return at[:0], prints[:0]
        keep = frequent[np.minimum(np.searchsorted(frequent, prints), len(frequent) - 1)] == prints
        return at[keep], prints[keep]


def phrase_counts(docs: DataFrame, least: int = 10, lang: str = "lang", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(lang, k, phrase, f) of all phrases of 1 to 3 words with f >= least in their language, exact; and (lang, n), its
    words. See `collocations`."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text}`").alias("text"))

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block()
        for b in batches:
            for of, t in zip(b.column(0).to_pylist(), texts_of(b.column(1)), strict=True):
                block.add(of, t or b"")
                if block.size >= BLOCK_BYTES:
                    yield block.row()
                    block = Block()
        if block.of:
            yield block.row()

    blocks = materialize(arrow_map(rows, store, Block.DDL).withColumn("block", F.monotonically_increasing_id()), "blocks")
    words = blocks.select(F.explode(F.arrays_zip("langs", "n")).alias("x")).groupBy(F.col("x.langs").alias("lang")).agg(F.sum("x.n").alias("n"))
    size = words.agg(F.sum("n")).first()[0] or 0
    ranges = max(2 * partitions(spark), -(-size // RANGE_WORDS))

    def loaded(own: pa.Table) -> tuple[int, Grams]:
        return own.column("block")[0].as_py(), Grams(*[own.column(c)[0].as_py() for c in ("langs", "ends", "ids", "words")])

    def told(answers: pa.Table) -> dict[int, bytes]:
        return dict(zip(answers.column("range").to_pylist(), answers.column("bits").to_pylist(), strict=True))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                number, grams = loaded(pa.Table.from_batches([b.slice(i, 1)]))
                yield Sent(grams, (1, 2), ranges).rows(number)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, runs, which = [], [], None
        for b in batches:
            which = b.column("range")[0].as_py()
            blocks += b.column("block").to_pylist()
            runs += [out_of(x) for x in b.column("run").to_pylist()]
        prints, total = summed_prints([p for p, _ in runs], [n for _, n in runs])
        often = total >= least
        bits = [np.packbits(often[np.searchsorted(prints, p)]).tobytes() for p, _ in runs]
        yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array([which] * len(bits), pa.int32()), pa.array(bits, pa.binary())], names=["block", "range", "bits"])

    def send_triples(own: pa.Table, answers: pa.Table) -> pa.Table:
        number, grams = loaded(own)
        shorter = Sent(grams, (1, 2), ranges)
        pairs, _ = shorter.where(2, shorter.frequent(told(answers)))
        return pa.Table.from_batches([Sent(grams, (3,), ranges, pairs).rows(number)])

    def spell(own: pa.Table, answers: pa.Table) -> pa.Table:
        _, grams = loaded(own)
        mine = {k: answers.filter(pc.equal(answers.column("k"), k)) for k in (2, 3)}
        shorter = Sent(grams, (1, 2), ranges)
        frequent = shorter.frequent(told(mine[2]))
        found = [(k, *shorter.where(k, frequent)) for k in (1, 2)]
        del shorter
        longer = Sent(grams, (3,), ranges, found[1][1])
        found.append((3, *longer.where(3, longer.frequent(told(mine[3])))))
        del longer
        out, langs = [], np.array(own.column("langs")[0].as_py() or [""], object)
        for k, at, prints in found:
            at, n = grams.spelled(at, prints, k)
            out.append(pa.table({"lang": pa.array(langs[grams.lang[at]].tolist(), pa.string()), "k": pa.array([k] * len(at), pa.int32()), "phrase": pa.array(grams.phrases(at, k), pa.string()), "n": pa.array(n, pa.int64())}))
        return pa.concat_tables(out)

    reply, sent = "block long, range int, bits binary", "range int, block long, run array<binary>"
    pairs = materialize(arrow_map(blocks, send, sent).groupBy("range").applyInArrow(count, reply), "pairs")
    by_block = blocks.groupBy("block")
    triples = by_block.cogroup(pairs.groupBy("block")).applyInArrow(send_triples, sent).groupBy("range").applyInArrow(count, reply)
    answers = pairs.withColumn("k", F.lit(2)).unionByName(triples.withColumn("k", F.lit(3)))
    found = by_block.cogroup(answers.groupBy("block")).applyInArrow(spell, "lang string, k int, phrase string, n long")
    return found.groupBy("lang", "k", "phrase").agg(F.sum("n").alias("f")).where(F.col("f") >= least), words


def summed_prints(prints: list[np.ndarray], n: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct fingerprints of several runs in order, and the sum of their counts."""
    every, times = np.concatenate(prints), np.concatenate(n)
    order = np.argsort(every)
    every, times = every[order], times[order]
    new = np.ones(len(every), bool)
    new[1:] = every[1:] != every[:-1]
    at = np.flatnonzero(new)
    return every[at], np.add.reduceat(times, at)


def collocations(docs: DataFrame, least: int = 10, covered: int = 50, top: int = 2000, lang: str = "lang", text: str = "text") -> DataFrame:
    """The best phrases of 2 or 3 words of each language: lang, rank, phrase, a, l, r, n, score.

    ASCII letters are lower-cased; texts are cut at `. , ; : ! ?` and line ends into pieces, these at spaces and tabs into
    words. a is how often the phrase is found in pieces of its language, overlaps included, and at least `least`; cut after
    its first words, l and r are the same of the two parts, and score is 1,000,000 a² / (l r), rounded down, of the
    cut with the lowest score (of equal ones the earliest). A phrase of two words goes if a candidate of three that holds it
    is found at least `covered` hundredths as often. n: all words of the language. The first `top` by score, a (both
    descending) and phrase. Arithmetic is in 38-digit decimals; l and r are never below a, so scores stay within a million.

    Null texts are empty and have no phrases; a null language is `und`. Whole texts are read, whatever their length; a text
    of one endless word is one word. Repeated rows count each. An empty table gives an empty result. Other columns don't
    matter, whatever they are called.
    """
    counts, words = phrase_counts(docs, least, lang, text)
    f = materialize(counts, "phrases")
    part = f.select(F.col("lang").alias("pl"), F.col("phrase").alias("part"), F.col("f").alias("pf"))
    cut = F.split("phrase", " ")
    cuts = f.where("k > 1").select("lang", "phrase", F.col("f").alias("a"), F.col("k").alias("of"), F.explode(F.expr("sequence(1, k - 1)")).alias("k"), cut.alias("w"))
    cuts = cuts.select("lang", "phrase", "a", "of", "k", F.array_join(F.expr("slice(w, 1, k)"), " ").alias("first"), F.array_join(F.expr("slice(w, k + 1, of - k)"), " ").alias("rest"))
    left = cuts.join(part.withColumnRenamed("pf", "l"), (F.col("lang") == F.col("pl")) & (F.col("first") == F.col("part"))).drop("pl", "part")
    both = left.join(part.withColumnRenamed("pf", "r"), (F.col("lang") == F.col("pl")) & (F.col("rest") == F.col("part"))).drop("pl", "part")
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    score = F.call_function("div", F.lit(1_000_000).cast("decimal(38,0)") * wide("a") * wide("a"), wide("l") * wide("r"))
    best = both.withColumn("score", score).groupBy("lang", "phrase", "a", "of").agg(F.min(F.struct("score", "k", "l", "r")).alias("m"))
    inner = f.where("k = 3").select("lang", "f", F.explode(F.array(F.array_join(F.slice(cut, 1, 2), " "), F.array_join(F.slice(cut, 2, 2), " "))).alias("phrase"))
    inner = inner.groupBy(F.col("lang").alias("il"), F.col("phrase").alias("ip")).agg(F.max("f").alias("longer"))
    gone = (F.col("lang") == F.col("il")) & (F.col("phrase") == F.col("ip")) & (100 * F.col("longer") >= covered * F.col("a"))
    kept = best.join(inner, gone, "left_anti").select("lang", "phrase", "a", "m.l", "m.r", "m.score")
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    # scores are counted by thousands first, so that only those that can be among the best are ranked
    kept = materialize(kept.withColumn("step", F.expr("score div 1000")), "scored")
    better = F.coalesce(F.sum("m").over(Window.partitionBy("lang").orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    least_step = kept.groupBy("lang", "step").agg(F.count("*").alias("m")).withColumn("better", better).where(F.col("better") < top)
    least_step = least_step.groupBy(F.col("lang").alias("sl")).agg(F.min("step").alias("least"))
    kept = kept.join(least_step, (F.col("lang") == F.col("sl")) & (F.col("step") >= F.col("least"))).drop("sl", "least", "step")
    some = kept.withColumn("__part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "__part").orderBy(*order))).where(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    n = words.select(F.col("lang").alias("wl"), "n")
    return ranked.join(n, F.col("lang") == F.col("wl")).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
