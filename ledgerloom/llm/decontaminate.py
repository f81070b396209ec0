"""Benchmark decontamination by pigeonhole pieces and bit-parallel edit distance, over words.

If a text holds a passage within k edits of an item of n words, and the item is split into k + 1 pieces, at least one
piece occurs in the passage unchanged. So: find exact occurrences of pieces by their rolling hashes, and verify only
around these with Myers' bit-vector algorithm, whose alphabet here is the words.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import RollingHash, WordIds, arrow_map, numbered, texts_of

#: Case of ASCII letters and ASCII punctuation don't count.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else 32 if c < 48 or 57 < c < 65 or 90 < c < 97 or 122 < c < 128 else c for c in range(256))
KEY = b"decontaminate"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def distance_within(pattern: np.ndarray, text: np.ndarray, most: int) -> tuple[int, int] | None:
    """The best match of the whole pattern anywhere in the text: (edits, end index), the first such, or None if it
    takes more than `most`. One step of the bit vectors per text word, whatever the pattern's length."""
    m = len(pattern)
    if m == 0:
        return None
    peq: dict[int, int] = defaultdict(int)
    for i, w in enumerate(pattern.tolist()):
        peq[w] |= 1 << i
    ones, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best = ones, 0, m, None
    for j, w in enumerate(text.tolist()):
        eq = peq.get(w, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph = (minus | ~(xh | plus)) & ones
        mh = plus & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1) & ones  # the text may start anywhere: row 0 stays 0
        mh = (mh << 1) & ones
        plus = (mh | ~(xv | ph)) & ones
        minus = ph & xv
        if score <= most and (best is None or score < best[0]):
            best = (score, j + 1)
    return best


class Items:
    """The query set: words of each item, the hashes of their pieces by length, and, for pieces that many items share,
    an index from words to these items. All are plain arrays, so that a block of items is some tens of bytes a word."""

    #: A piece of more items than this is followed up by way of the index.
    FEW = 4

    def __init__(self, rows: list[tuple[int, str]], similarity: float, least_words: int):
        ids, roll = WordIds(KEY), RollingHash()
        self.items: list[tuple[int, np.ndarray, int]] = []
        found: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for item_id, text in rows:
            words = ids.of(words_of(text.encode("utf-8", "replace")))
            if len(words) < max(1, least_words):
                continue
            budget = int(len(words) * (1 - similarity) + 1e-9)
            k = len(self.items)
            self.items.append((item_id, words, budget))
            cuts = np.linspace(0, len(words), budget + 2).astype(int)
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                found[int(b - a)].append((int(roll.windows(words[a:b], b - a)[0]), k, int(a)))
        #: (words of a piece, distinct hashes, where each one's rows begin, item and place of each row)
        self.pieces: list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        shared: list[np.ndarray] = []
        for n, rows_of in sorted(found.items()):
            h, k, a = (np.array(x, kind) for x, kind in zip(zip(*rows_of, strict=True), (np.uint64, np.int32, np.int32), strict=True))
            order = np.argsort(h, kind="stable")
            h, k, a = h[order], k[order], a[order]
            known, first = np.unique(h, return_index=True)
            edge = np.append(first, len(h))
            self.pieces.append((n, known, edge, k, a))
            shared += [k[edge[i] : edge[i + 1]] for i in np.flatnonzero(np.diff(edge) > self.FEW)]
        distinct = {int(i): np.unique(self.items[i][1]) for i in np.unique(np.concatenate([*shared, np.empty(0, np.int32)]))}
        #: how many of its distinct words each shared item must meet near a match: an edit takes one away at most
        self.need = np.zeros(len(self.items), np.int32)
        for i, w in distinct.items():
            self.need[i] = len(w) - self.items[i][2]
        word, item = np.concatenate([*distinct.values(), np.empty(0, np.uint64)]), np.repeat(np.array(list(distinct), np.int32), [len(w) for w in distinct.values()])
        order = np.argsort(word, kind="stable")
        self.word, self.holder = word[order], item[order]
        self.reach = np.array([len(w) + budget for _, w, budget in self.items], np.int32)

    def likely(self, items: np.ndarray, words: np.ndarray, i: int) -> np.ndarray:
        """Which of the items, that share the piece at words[i], may match around it: enough of their words are there."""
        reach = int(self.reach[items].max())
        near = np.unique(words[max(0, i - reach) : i + reach])
        a, b = np.searchsorted(self.word, near), np.searchsorted(self.word, near, side="right")
        met = [self.holder[x:y] for x, y in zip(a.tolist(), b.tolist(), strict=True) if x < y]
        count = np.bincount(np.concatenate(met), minlength=len(self.items)) if met else np.zeros(len(self.items), np.int64)
        return count[items] >= self.need[items]


def stretches(starts: set[int], budget: int, m: int, n: int) -> list[tuple[int, int]]:
    """Where matches that begin near `starts` can lie in n words; stretches that overlap are one, so no word is
    verified twice for an item."""
    found: list[tuple[int, int]] = []
    for s in sorted(starts):
        a, b = max(0, s - budget), min(n, s + m + budget)
        if found and a <= found[-1][1]:
            found[-1] = (found[-1][0], max(b, found[-1][1]))
        elif a < b:
            found.append((a, b))
    return found


class Finder:
    def __init__(self, items: Items):
        self.items, self.ids, self.roll = items, WordIds(KEY), RollingHash()

    def find(self, text: bytes | None, once: bool = False) -> list[tuple[int, int, int, int]]:
        """(item_id, edits, words of the item, index of the word after the match), one per item that the text holds;
        with `once`, any one of them will do."""
        if not text:
            return []
        words = self.ids.of(words_of(text))
        at: dict[int, set[int]] = defaultdict(set)
        for n, known, edge, item, place in self.items.pieces:
            h = self.roll.windows(words, n)
            if len(h) == 0:
                continue
            spot = np.searchsorted(known, h)
            spot[spot == len(known)] = 0
            for i in np.flatnonzero(known[spot] == h).tolist():
                rows = slice(edge[spot[i]], edge[spot[i] + 1])
                k, a = item[rows], place[rows]
                if len(k) > self.items.FEW:
                    ok = self.items.likely(k, words, i)
                    k, a = k[ok], a[ok]
                for one, start in zip(k.tolist(), a.tolist(), strict=True):
                    at[one].add(i - start)
        found = []
        for k, starts in at.items():
            item_id, pattern, budget = self.items.items[k]
            best = None
            for a, b in stretches(starts, budget, len(pattern), len(words)):
                got = distance_within(pattern, words[a:b], budget)
                if got and (best is None or got[0] < best[0]):
                    best = (got[0], a + got[1])
            if best:
                found.append((item_id, best[0], len(pattern), best[1]))
                if once:
                    break
        return sorted(found)


#: Characters of items in a block, unless a single item has more.
BLOCK_CHARS = 32 << 20


def query_blocks(benchmark: DataFrame, key: str, text: str, block: int) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of at most `block` and BLOCK_CHARS characters, in order of the key; null keys and texts are
    no items."""
    rows = benchmark.select(F.col(f"`{key}`").cast("long"), F.col(f"`{text}`")).dropna().orderBy(key)
    found: list[tuple[int, str]] = []
    size = 0
    for r in rows.toLocalIterator():
        if found and (len(found) == block or size + len(r[1]) > BLOCK_CHARS):
            yield found
            found, size = [], 0
        found.append((r[0], r[1]))
        size += len(r[1])
    if found:
        yield found


def find_leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, block: int = 100_000, least_words: int = 3, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document and item that it holds: doc_id, item_id, edits, item_words, end_word (the word after the
    match, by words of the folded text), over whole texts.

    A document holds an item if some stretch of its words is within floor((1 - similarity) * n) word edits of the
    item's n words; case of ASCII letters and ASCII punctuation don't count. Items of fewer than `least_words` words are
    no passages (a single common word would flag every document); `short_items` lists them. The items are the stated
    query set: they reach the executors in blocks of at most `block` items and BLOCK_CHARS characters, each one pass over
    docs. A piece that many items share is followed up only for those whose other words are near, so a phrase that
    thousands of items have costs no comparison with each. Null, empty or punctuation-only texts and items hold or are
    nothing. A null key comes back as null. Repeated rows give their own results, repeated items (one key each) too.
    Empty tables: no row. Other columns of docs don't matter.
    """
    narrow = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    spark = docs.sparkSession
    out = spark.createDataFrame([], "doc_id long, item_id long, edits int, item_words int, end_word int")
    for rows in query_blocks(benchmark, item_key, item_text, block):
        shared = spark.sparkContext.broadcast(Items(rows, similarity, least_words))

        def run(batches, shared=shared):
            finder = Finder(shared.value)
            for b in batches:
                got = [(d, *hit) for d, t in zip(b.column(0).to_pylist(), texts_of(b.column(1)), strict=True) for hit in finder.find(t)]
                cols = list(zip(*got, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i < 2 else pa.int32()) for i, c in enumerate(cols)], names=["doc_id", "item_id", "edits", "item_words", "end_word"])

        out = out.unionByName(arrow_map(narrow, run, "doc_id long, item_id long, edits int, item_words int, end_word int"))
    return out


def short_items(benchmark: DataFrame, least_words: int = 3, item_text: str = "text") -> DataFrame:
    """The rows of the benchmark that are too short to be looked for; null texts count as such."""
    letters = "".join(chr(c) for c in range(128) if _FOLD[c] == 32)
    words = F.filter(F.split(F.translate(F.coalesce(F.col(f"`{item_text}`"), F.lit("")), letters, " " * len(letters)), " "), lambda w: w != "")
    return benchmark.where(F.size(words) < least_words)


def remove_leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, block: int = 100_000, least_words: int = 3, text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs without the rows whose text holds an item (see find_leaks); all columns, no shuffle. Rows with a null, empty
    or very long text, a null key, or that repeat others are judged by their text alone; an empty docs or benchmark
    changes nothing."""
    at = docs.columns.index(text)
    out, _ = numbered(docs)
    fields = out.schema
    for rows in query_blocks(benchmark, item_key, item_text, block):
        shared = docs.sparkSession.sparkContext.broadcast(Items(rows, similarity, least_words))

        def run(batches, shared=shared):
            finder = Finder(shared.value)
            for b in batches:
                yield b.filter(pa.array([not finder.find(t, once=True) for t in texts_of(b.column(at))], pa.bool_()))

        out = arrow_map(out, run, fields)
    return out.toDF(*docs.columns)
