"""Cross-tokenizer alignment with external spill counting.

Both tokenizers cut a text between a word and the space after it, whatever stands around, so a text is aligned stretch by
stretch, and a stretch that was met before isn't encoded again. Tokens that end at the same byte are linked. A task gathers
the pair-document records of a run of documents, sorts them side-major (by B id, then A id, then document) and keeps them
as zstd frames; the distinct pairs of the run, with their sums, go radix-partitioned by B id to the counting tasks. There
a k-way heap merge over the frames brings all runs' pairs of a B id together, so a pair's count and its B id's maximum are
known at once, and each run gets them back, frame by frame, in its own order. The run then adds them up per document.
A pair in every document costs a counting task one entry a run, so no frequent token is a hot key.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import arrow_map, materialize, partitions

#: Bytes of text in a run, and records in a zstd frame; both bound what a task holds.
RUN_BYTES, FRAME = 24 << 20, 1 << 16
#: Stretches that a task remembers, and their bytes.
STRETCHES, STRETCH_BYTES = 400_000, 64 << 20
#: Where a space stands that is not a stretch's start for both tokenizers, and where stretches start in such texts.
UNEVEN, STRETCH = re.compile(r"\s (?:\s|\Z)"), re.compile(r"(?<=\S)(?= )")


def bytes_of_byte_level() -> dict[str, int]:
    """The characters that byte-level vocabularies write bytes with: printable Latin-1 ones stand for themselves, the other
    bytes take the characters from U+0100 on, in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(b for b in range(256) if b not in own)}


class Aligner:
    """Encodes stretches with both tokenizers and links tokens that end together. What it has met is kept by number:
    `shown` (the stretch's groups as text), and in flat arrays its pairs."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=path_b)
        back, vocab = bytes_of_byte_level(), self.a.get_vocab()
        added = {t.content for t in self.a.get_added_tokens_decoder().values()}
        self.bytes_a = [b""] * (1 + max(vocab.values()))
        for entry, i in vocab.items():
            self.bytes_a[i] = entry.encode() if entry in added else bytes(map(back.__getitem__, entry))
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(map(self.b.id_to_piece, range(self.b.get_piece_size())))]
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.held, self.shown, self.sizes, self.a_of, self.b_of, self.wrong = 0, [], [], [], [], set()
        self.flat = None

    def align(self, text: bytes, a: list[int], b: list[int]) -> tuple[list[int], list[int], str] | None:
        """A and B ids of the links of a text (space included), and its groups; None if the bytes aren't the text's."""
        bytes_a, bytes_b = self.bytes_a, self.bytes_b
        if b"".join([bytes_a[i] for i in a]) != text or b"".join([bytes_b[i] for i in b]) != text:
            return None
        left, right, groups, j, at, end, start = [], [], [], 0, 0, 0, 0
        for i, x in enumerate(a):
            end += len(bytes_a[x])
            while at < end:
                at += len(bytes_b[b[j]])
                j += 1
            if at == end:
                left.append(x)
                right.append(b[j - 1])
                groups.append((start, i + 1, j))
                start = i + 1
        shown, last = [], 0
        for s, e, j in groups:
            shown.append(",".join(map(str, a[s:e])) + "|" + ",".join(map(str, b[last:j])))
            last = j
        return left, right, ";".join(shown)

    def learn(self, new: list[str]) -> None:
        """Encodes stretches (given without the space before them) that haven't been met."""
        many_a = self.a.encode_batch_fast([" " + s for s in new], add_special_tokens=False)
        many_b = self.b.encode(new, num_threads=1)
        for s, a, b in zip(new, (e.ids for e in many_a), many_b, strict=True):
            found = self.align(b" " + s.encode(), a, b)
            if found is None:
                self.wrong.add(len(self.shown))
            left, right, shown = found or ([], [], "")
            self.number[s] = len(self.shown)
            self.held += len(s)
            self.shown.append(shown)
            self.sizes.append((len(a), len(b), len(left)))
            self.a_of += left
            self.b_of += right
        self.flat = None

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """sizes (tokens of A, of B, links) per stretch, where its links start, and the links' ids."""
        if self.flat is None:
            sizes = np.array(self.sizes, np.int64).reshape(-1, 3)
            self.flat = sizes, np.cumsum(sizes[:, 2]) - sizes[:, 2], np.array(self.a_of, np.int64), np.array(self.b_of, np.int64)
        return self.flat

    def stretches(self, text: str) -> list[str]:
        """A text cut into stretches, each without the space that it starts with."""
        spaced = " " + text
        if "  " in spaced or UNEVEN.search(spaced):
            parts = [s[1:] for s in STRETCH.split(spaced)]
        else:
            parts = text.split(" ")
        if len(parts) > 1 and parts[-1] == "":  # a space at the end is encoded with what is before it
            parts[-2:] = [parts[-2] + " "]
        return parts

    def texts(self, texts: list[str]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, str]]:
        """Per text: tokens of A and of B, the links' A and B ids and how often each is there, and the groups."""
        if len(self.number) > STRETCHES or self.held > STRETCH_BYTES:
            self.forget()
        cut = [self.stretches(t) if t else [] for t in texts]
        known = self.number
        new = list(dict.fromkeys(s for parts in cut for s in parts if s not in known))
        if new:
            self.learn(new)
        sizes, first, a_of, b_of = self.arrays()
        none = np.empty(0, np.int64)
        for text, parts in zip(texts, cut, strict=True):
            ids = [known[s] for s in parts]
            if self.wrong and not self.wrong.isdisjoint(ids):
                a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
                found = self.align(b" " + text.encode(), a, b)
                if found is None:
                    yield 0, 0, none, none, none, ""
                else:
                    yield len(a), len(b), np.array(found[0], np.int64), np.array(found[1], np.int64), np.ones(len(found[0]), np.int64), found[2]
                continue
            which, times = np.unique(np.array(ids, np.int64), return_counts=True)
            n_a, n_b, n = (sizes[which] * times[:, None]).sum(axis=0).tolist()[:3] if len(ids) else (0, 0, 0)
            width = sizes[which, 2]
            at = np.repeat(first[which] - np.cumsum(width) + width, width) + np.arange(width.sum())
            yield n_a, n_b, a_of[at], b_of[at], np.repeat(times, width), ";".join([self.shown[i] for i in ids])


@functools.cache
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


def pack(*columns: np.ndarray) -> bytes:
    """Columns of non-negative integers as a zstd frame, byte plane by byte plane, so that leading zero bytes cost little."""
    planes = np.stack([np.asarray(c).astype(np.int64) for c in columns]).view(np.uint8).reshape(len(columns), -1, 8)
    return zstandard.compress(np.ascontiguousarray(planes.transpose(0, 2, 1)).tobytes(), 1)


def unpack(frame: bytes, columns: int) -> list[np.ndarray]:
    planes = np.frombuffer(zstandard.decompress(frame), np.uint8).reshape(columns, 8, -1)
    return list(np.ascontiguousarray(planes.transpose(0, 2, 1)).view(np.int64)[:, :, 0])


def frames(*columns: np.ndarray) -> list[bytes]:
    """Columns, the first one sorted and sent as differences, in frames of bounded size."""
    return [pack(np.diff(columns[0][i : i + FRAME], prepend=0), *[c[i : i + FRAME] for c in columns[1:]]) for i in range(0, len(columns[0]), FRAME)]


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of n of each."""
    order = np.argsort(keys)
    keys = keys[order]
    at = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[at], np.add.reduceat(n[order], at) if len(at) else n[:0]


class Run:
    """Documents whose records are gathered, and the rows that stand for them."""

    DOC = pa.struct([("doc_id", pa.int64()), *[(c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")], ("groups_sha256", pa.string())])
    SCHEMA = pa.schema([("run", pa.int64()), ("part", pa.int32()), ("docs", pa.list_(DOC)), ("records", pa.list_(pa.binary())), ("pairs", pa.list_(pa.binary()))])
    DDL = "run long, part int, docs array<struct<doc_id:long,n_a:long,n_b:long,n_groups:long,n_links:long,groups_sha256:string>>, records array<binary>, pairs array<binary>"

    def __init__(self, parts: int, width_a: int, width_b: int):
        # B ids are renumbered by their radix, so that a part's codes are one stretch of all, in side-major order
        self.parts, self.width_a, self.digits = parts, width_a, -(-width_b // parts)
        self.docs, self.codes, self.of, self.times, self.size = [], [], [], [], 0

    def add(self, doc: dict, a: np.ndarray, b: np.ndarray, times: np.ndarray, size: int) -> None:
        code, n = summed((b % self.parts * self.digits + b // self.parts) * self.width_a + a, times)
        self.codes.append(code)
        self.times.append(n)
        self.of.append(np.full(len(code), len(self.docs), np.int64))
        self.docs.append(doc)
        self.size += size

    def rows(self, run: int) -> pa.RecordBatch:
        code, of, n = (np.concatenate(x) for x in (self.codes, self.of, self.times))
        order = np.argsort(code, kind="stable")  # documents were added in order
        code, of, n = code[order], of[order], n[order]
        first = np.flatnonzero(np.diff(code, prepend=-1))
        place = np.zeros(len(code), np.int64)
        place[first[1:]] = 1
        distinct, total = code[first], np.add.reduceat(n, first) if len(first) else n[:0]
        edges = np.searchsorted(distinct, np.arange(self.parts + 1) * self.digits * self.width_a)
        sent = [(p, frames(distinct[s:e], total[s:e])) for p, (s, e) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if e > s]
        columns = [
            [run] * (1 + len(sent)), [None, *[p for p, _ in sent]], [self.docs, *[None] * len(sent)],
            [frames(np.cumsum(place), of, n), *[None] * len(sent)], [None, *[f for _, f in sent]],
        ]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, self.SCHEMA.types, strict=True)], schema=self.SCHEMA)


def sides(pairs: list[bytes], width_a: int, run: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(B side, run, codes, sums) of a run's frames, in order; a side that goes on in the next frame comes twice."""
    for frame in pairs:
        steps, sums = unpack(frame, 2)
        codes = np.cumsum(steps)
        side = codes // width_a
        at = np.flatnonzero(np.diff(side, prepend=-1)).tolist()
        for s, e in zip(at, [*at[1:], len(codes)], strict=True):
            yield int(side[s]), run, codes[s:e], sums[s:e]


def count_pairs(runs: list[list[bytes]], width_a: int) -> list[list[bytes]]:
    """K-way merge of the runs' pairs by B side: for each run, frames with the count of each of its pairs over all runs, and
    whether that is the highest of the pair's B id."""
    back: list[list[bytes]] = [[] for _ in runs]
    waiting: list[list[np.ndarray]] = [[] for _ in runs]
    sizes = [0] * len(runs)

    def flush(run: int) -> None:
        counts, best = np.concatenate(waiting[run], axis=1)
        back[run].append(pack(counts, best))
        waiting[run].clear()
        sizes[run] = 0

    def settle(group: list[tuple[int, int, np.ndarray, np.ndarray]]) -> None:
        codes, counts = summed(np.concatenate([g[2] for g in group]), np.concatenate([g[3] for g in group]))
        best = counts == counts.max()
        for _, run, own, _ in group:
            at = np.searchsorted(codes, own)
            waiting[run].append(np.stack([counts[at], best[at].astype(np.int64)]))
            sizes[run] += len(own)
            if sizes[run] >= FRAME:
                flush(run)

    group: list[tuple[int, int, np.ndarray, np.ndarray]] = []
    for entry in heapq.merge(*[sides(pairs, width_a, i) for i, pairs in enumerate(runs)], key=lambda e: e[:2]):
        if group and entry[0] != group[0][0]:
            settle(group)
            group = []
        group.append(entry)
    if group:
        settle(group)
    for i, w in enumerate(waiting):
        if w:
            flush(i)
    return back


def align_tokens(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    `path_a` is a byte-level tokenizers file, `path_b` a sentencepiece model, both readable on every executor; A encodes
    space + text, B the text, whose space it adds itself; special tokens' strings are plain text. Token bytes are those of
    the vocabularies' entries. Groups end where tokens of both end, and these two tokens are a link; a pair's count is the
    number of its links in all documents. n_best counts the links whose pair has the highest count of all with its B id,
    ties included; count_sum adds the counts of all links. groups_sha256 hashes `a1,a2|b1;a3|b2,b3`.

    Null and empty texts, and texts that either tokenizer doesn't give back byte by byte, have no tokens: zeros and ''.
    Whole texts are read, whatever their length. Null keys: each such row is a document. Repeated rows each give a row and
    count each. An empty table gives an empty one. Other columns aren't returned, whatever they are called.
    """
    spark = docs.sparkSession
    parts = partitions(spark)
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(path_a, path_b)
        make = lambda: Run(parts, len(both.bytes_a), len(both.bytes_b))
        run, number = make(), TaskContext.get().partitionId() << 32
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for i, t, (n_a, n_b, a, b, times, groups) in zip(ids, texts, both.texts(texts), strict=True):
                n = int(times.sum())
                shown = hashlib.sha256(groups.encode()).hexdigest() if n_a or n_b else ""
                run.add({"doc_id": i, "n_a": n_a, "n_b": n_b, "n_groups": n, "n_links": n, "groups_sha256": shown}, a, b, times, len(t) + 64)
                if run.size >= RUN_BYTES:
                    yield run.rows(number)
                    run, number = make(), number + 1
        if run.docs:
            yield run.rows(number)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, runs, part = [], [], None
        for b in batches:
            numbers += b.column("run").to_pylist()
            runs += b.column("pairs").to_pylist()
            part = b.column("part")[0].as_py()
        for n, back in zip(numbers, count_pairs(runs, width_a), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([part], pa.int32()), pa.array([back], pa.list_(pa.binary()))], names=["run", "part", "counted"])

    def add_up(own: pa.Table, answers: pa.Table) -> pa.Table:
        told = sorted(zip(answers.column("part").to_pylist(), answers.column("counted").to_pylist(), strict=True))
        counted = [unpack(f, 2) for _, fs in told for f in fs]
        counts, best = (np.concatenate([c[i] for c in counted] or [np.empty(0, np.int64)]) for i in (0, 1))
        out = pa.Table.from_batches([pa.RecordBatch.from_struct_array(c.flatten()) for c in own.column("docs").chunks])
        n_best, count_sum = np.zeros(out.num_rows, np.int64), np.zeros(out.num_rows, np.int64)
        for frame in own.column("records")[0].as_py():
            steps, of, n = unpack(frame, 3)
            place = np.cumsum(steps)
            np.add.at(n_best, of, best[place] * n)
            np.add.at(count_sum, of, counts[place] * n)
        return out.append_column("n_best", pa.array(n_best)).append_column("count_sum", pa.array(count_sum))

    width_a = len(aligner(path_a, path_b).bytes_a)
    runs = materialize(arrow_map(rows, gather, Run.DDL), "runs")
    answers = runs.where("part is not null").select("run", "part", "pairs").groupBy("part").applyInArrow(count, "run long, part int, counted array<binary>")
    own = runs.where("part is null").select("run", "docs", "records")
    kinds = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    return own.groupBy("run").cogroup(answers.groupBy("run")).applyInArrow(add_up, kinds).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
