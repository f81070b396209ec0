"""Substring dedup: Rabin-Karp hashes of every fixed-length word window, counted in Spark.

Documents are dealt into blocks of bounded size. Each block sends the leading bits of the distinct window hashes that it
holds, as sorted packed runs, one per hash bucket; each bucket, which holds a range of hashes, finds those sent by more
than one block and answers each block with a bit per value. These are candidates only: for them the block sends 128
bits per distinct window, from two independent hashes, and the bucket answers again. The block, which has its documents
each time, then knows which windows repeat, and merges them into maximal removal intervals. A window repeated in a
million places costs a bucket one entry per block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import RollingHash, WordIds, materialize, partitions, texts_of

#: Leading bits of a hash that the first round compares; it only picks candidates, so these will do.
LEAD_BITS = 48
#: Bytes of text in a block, and bytes of text whose windows fall in a bucket; both bound what one task holds.
BLOCK_BYTES, BUCKET_BYTES = 16 << 20, 64 << 20


def pack(sorted_hashes: np.ndarray) -> bytes:
    """Sorted hashes as differences, byte plane by byte plane, so that the leading bytes, mostly zero, compress well."""
    steps = np.diff(sorted_hashes, prepend=np.uint64(0))
    return np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes()


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def leads(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The leading bits of hashes."""
    return hashes >> np.uint64(64 - bits)


def cuts(leads: np.ndarray, buckets: int, bits: int) -> list[int]:
    """Where each bucket, an equal range of leading bits, starts among sorted leading bits, and where the last one ends."""
    edges = np.array([-(-(i << bits) // buckets) for i in range(1, buckets)], np.uint64)
    return [0, *np.searchsorted(leads, edges).tolist(), len(leads)]


def member(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values of x the sorted values hold."""
    if len(known) == 0 or len(x) == 0:
        return np.zeros(len(x), bool)
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x


def distinct_pairs(h: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs in order, how often each is there, and the place of each given pair among them."""
    order = np.lexsort((g, h))
    h, g = h[order], g[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
    at, place = np.flatnonzero(new), np.empty(len(h), np.int64)
    place[order] = np.cumsum(new) - 1
    return h[at], g[at], np.diff(at, append=len(h)), place


class Windows:
    """Window hashes: one for all, and a second one, from other word ids, for candidates."""

    def __init__(self, width: int):
        self.width, self.roll, self.ids, self.other_ids = width, RollingHash(), WordIds(b"substring"), WordIds(b"substring, other")

    def of(self, text: bytes) -> np.ndarray:
        return self.roll.windows(self.ids.of(text.split()), self.width)

    def other(self, text: bytes) -> np.ndarray:
        return self.roll.windows(self.other_ids.of(text.split()), self.width)


class Candidates:
    """The windows of a block that the first round leaves: leading bits met in another block (`met`: a bit per value, by bucket), or twice
    in this one. at: where they are among all windows; h, g: their distinct hashes; times: how often each is in the
    block; place: of each window at `at`, among these; abroad: places of those met in another block."""

    def __init__(self, texts: list[bytes], width: int, buckets: int, lead_bits: int, met: dict[int, bytes]):
        w = Windows(width)
        hashes = [w.of(t) for t in texts]
        self.ends = np.cumsum([len(x) for x in hashes], dtype=np.int64)
        every = np.concatenate([*hashes, np.empty(0, np.uint64)])
        del hashes
        mine, times = np.unique(leads(every, lead_bits), return_counts=True)
        edge, abroad = cuts(mine, buckets, lead_bits), np.zeros(len(mine), bool)
        for k, b in met.items():
            abroad[edge[k] : edge[k + 1]] = np.unpackbits(np.frombuffer(b, np.uint8), count=edge[k + 1] - edge[k]).astype(bool)
        abroad, mine = mine[abroad], mine[abroad | (times > 1)]
        self.at = np.flatnonzero(member(leads(every, lead_bits), mine))
        starts = np.concatenate([[0], self.ends])
        part = np.searchsorted(self.at, starts)
        other = [w.other(t)[self.at[a:b] - start] for t, a, b, start in zip(texts, part[:-1], part[1:], starts[:-1], strict=True) if b > a]
        self.h, self.g, self.times, self.place = distinct_pairs(every[self.at], np.concatenate([*other, np.empty(0, np.uint64)]))
        self.abroad = np.flatnonzero(member(leads(self.h, lead_bits), abroad))
        self.edge = cuts(leads(self.h[self.abroad], lead_bits), buckets, lead_bits)


def covered(starts: np.ndarray, words: int, width: int) -> np.ndarray:
    """Per word, whether a window that starts at one of `starts` covers it."""
    edge = np.zeros(words + 1, np.int32)
    edge[starts] += 1
    edge[starts + width] -= 1
    return np.cumsum(edge[:-1]) > 0


def intervals(mask: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of True as (start, end)."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def texts_in(table: pa.Table) -> list[bytes]:
    return [t or b"" for c in table.column("text").chunks for t in texts_of(c)]


def find_repeats(docs: DataFrame, width: int = 35, key: str = "doc_id", text: str = "text", lead_bits: int = LEAD_BITS) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, removed (array of {start, end} in words, maximal intervals),
    kept_sha256, kept (the words that stay, joined by one space).

    Words are runs of other than ASCII white space, unchanged. A word goes if a window of `width` words covers it whose
    word sequence also starts anywhere else, in this document or another; windows are judged on the input. Two window
    sequences count as equal if their two independent 64-bit hashes are: among 10^13 distinct windows a wrong pair is
    expected once in some 10^12 runs. Null text: no words. Texts below `width` words lose nothing. Null keys: each such
    row is a document. Repeated rows repeat each other's windows. Empty table: empty result. Other columns aren't returned.
    """
    spark = docs.sparkSession
    # written first, each row with a number of its own: rows that are all alike spread over the blocks too, and a row's
    # block is the same whenever a lost task runs again
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"), F.monotonically_increasing_id().alias("row"))
    rows = materialize(rows, "texts")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    least = 2 * partitions(spark)
    blocks, buckets = max(least, -(-size // BLOCK_BYTES)), max(least, -(-size // BUCKET_BYTES))
    dealt = rows.select("doc_id", "text", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("block"))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, parts, block = Windows(width), [], None
        for b in batches:
            block = b.column("block")[0].as_py() if block is None and b.num_rows else block
            parts += [leads(w.of(t), lead_bits) for t in texts_of(b.column("text")) if t]
        mine = np.unique(np.concatenate([*parts, np.empty(0, np.uint64)]))
        edge = cuts(mine, buckets, lead_bits)
        full = [k for k in range(buckets) if edge[k] < edge[k + 1]]
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([block] * len(full), pa.int32()), pa.array([pack(mine[edge[k] : edge[k + 1]]) for k in full], pa.binary())], names=["bucket", "block", "data"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        senders, runs = [], []
        for b in batches:
            senders += b.column("block").to_pylist()
            runs += [unpack(x) for x in b.column("data").to_pylist()]
        bucket = b.column("bucket")[0].as_py()
        every = np.sort(np.concatenate(runs))
        often = np.unique(every[1:][every[1:] == every[:-1]])
        if len(often) == 0:
            return
        bits = [np.packbits(member(r, often)).tobytes() for r in runs]
        yield pa.RecordBatch.from_arrays([pa.array(senders, pa.int32()), pa.array([bucket] * len(bits), pa.int32()), pa.array(bits, pa.binary())], names=["block", "bucket", "bits"])

    def send_pairs(own: pa.Table, answers: pa.Table) -> pa.Table:
        bits = dict(zip(answers.column("bucket").to_pylist(), answers.column("bits").to_pylist(), strict=True))
        rows = []
        if bits:
            c = Candidates(texts_in(own), width, buckets, lead_bits, bits)
            h, g, block = c.h[c.abroad], c.g[c.abroad], answers.column("block")[0].as_py()
            # the answer of the first round goes along and comes back, so the block needs no other message later
            rows = [(k, block, b, pack(h[c.edge[k] : c.edge[k + 1]]), g[c.edge[k] : c.edge[k + 1]].tobytes()) for k, b in bits.items()]
        kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
        return pa.Table.from_arrays([pa.array(x, kind) for x, kind in zip(list(zip(*rows, strict=True)) or [()] * 5, kinds, strict=True)], names=["bucket", "block", "bits", "h", "g"])

    def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, hs, gs = [], [], []
        for b in batches:
            kept.append(b.select(["block", "bucket", "bits"]))
            hs += [unpack(x) for x in b.column("h").to_pylist()]
            gs += [np.frombuffer(x, np.uint64) for x in b.column("g").to_pylist()]
        _, _, times, place = distinct_pairs(np.concatenate(hs), np.concatenate(gs))
        ends = np.cumsum([len(x) for x in hs])[:-1]
        same = [np.packbits(x).tobytes() for x in np.split(times[place] > 1, ends)]
        for b in kept:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(same[: b.num_rows], pa.binary())], names=["block", "bucket", "bits", "same"])
            same = same[b.num_rows :]

    def cut(own: pa.Table, answers: pa.Table) -> pa.Table:
        texts, told = texts_in(own), answers.column("bucket").to_pylist()
        c = Candidates(texts, width, buckets, lead_bits, dict(zip(told, answers.column("bits").to_pylist(), strict=True)))
        repeated = c.times > 1
        for k, bits in zip(told, answers.column("same").to_pylist(), strict=True):
            a, b = c.edge[k], c.edge[k + 1]
            repeated[c.abroad[a:b]] |= np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a).astype(bool)
        hits = c.at[repeated[c.place]]
        part, out = np.searchsorted(hits, np.concatenate([[0], c.ends])), []
        for i, t in enumerate(texts):
            x = t.split()
            first = c.ends[i - 1] if i else 0
            gone, kept, n, last = [], [], 0, 0
            if part[i + 1] > part[i]:
                gone = intervals(covered(hits[part[i] : part[i + 1]] - first, len(x), width))
            for s, e in gone:
                kept += x[last:s]
                n, last = n + e - s, e
            kept += x[last:]
            body = b" ".join(kept)
            out.append((len(x), n, [{"start": s, "end": e} for s, e in gone], hashlib.sha256(body).hexdigest(), body))
        cols = list(zip(*out, strict=True)) or [()] * 5
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        kinds = (pa.int64(), pa.int64(), span, pa.string(), pa.binary())
        arrays = [pa.array(c, kind) for c, kind in zip(cols, kinds, strict=True)]
        return pa.Table.from_arrays([own.column("doc_id"), *arrays[:4], arrays[4].cast(pa.string())], names=["doc_id", "n_words", "n_removed", "removed", "kept_sha256", "kept"])

    blocked = dealt.groupBy("block")
    met = blocked.applyInArrow(send, "bucket int, block int, data binary").groupBy("bucket").applyInArrow(count, "block int, bucket int, bits binary")
    pairs = blocked.cogroup(met.groupBy("block")).applyInArrow(send_pairs, "bucket int, block int, bits binary, h binary, g binary")
    answers = pairs.groupBy("bucket").applyInArrow(count_pairs, "block int, bucket int, bits binary, same binary")
    return blocked.cogroup(answers.groupBy("block")).applyInArrow(cut, "doc_id long, n_words long, n_removed long, removed array<struct<start:int,end:int>>, kept_sha256 string, kept string")
