"""Dealing large groups out in pairs of bounded blocks, and walking sorted groups in Python."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import arrow_map, partitions

#: Rows of a group whose pairs are formed together with those of other groups; larger ones are walked one by one.
SMALL = 64


def block_pairs(df: DataFrame, blocks: Column, ident: Column, inner: bool) -> DataFrame:
    """df with __i and __j: the pairs of blocks that a row takes part in, when its group is cut into `blocks` blocks
    by the hash of `ident`. Every two rows of a group meet in one pair at least. With `inner`, the pairs (b, b) come
    as well, for the rows within a block, and others are for rows of different blocks only."""
    own = F.pmod(F.xxhash64(ident), blocks).cast("int")
    other = F.sequence(F.lit(0), (blocks - 1).cast("int"))
    if not inner:
        other = F.when(blocks > 1, F.filter(other, lambda x: x != own)).otherwise(other)
    dealt = df.withColumns({"__own": own, "__other": F.explode(other)})
    return dealt.withColumns({"__i": F.least("__own", "__other"), "__j": F.greatest("__own", "__other")}).drop("__other")


def starts_of(table: pa.Table | pa.RecordBatch, keys: int) -> np.ndarray:
    """Where a row differs from the one before in the first `keys` columns, which are integers without nulls."""
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for i in range(keys):
        k = table.column(i).to_numpy()
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def per_stretch(df: DataFrame, keys: list[str], fn: Callable[[pa.Table, np.ndarray], pa.RecordBatch], schema: str, order: list[str] | None = None) -> DataFrame:
    """fn(rows, starts) for stretches of whole groups, in the order of the keys (integers, and the first columns of df),
    within groups in that of `order`; starts are the places where a group begins. What is held at a time is one Arrow
    batch and the group that goes on into the next. Rows are dealt by the keys, as for a group-by."""
    width = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None

        def done() -> Iterator[pa.RecordBatch]:
            if held:
                table = pa.Table.from_batches(held).combine_chunks()
                got = fn(table, starts_of(table, width))
                if got.num_rows:
                    yield got
            held.clear()

        for b in batches:
            if b.num_rows == 0:
                continue
            at = starts_of(b, width)
            first, cut = tuple(b.column(i)[0].as_py() for i in range(width)), int(at[-1])
            if cut == 0 and first == last:  # the group goes on
                held.append(b)
                continue
            if first != last:
                yield from done()
            if cut:
                held.append(b.slice(0, cut))
                yield from done()
            held.append(b.slice(cut))
            last = tuple(b.column(i)[cut].as_py() for i in range(width))
        yield from done()

    # a stated number of partitions, as the work grows with the pairs in a group and not with the few bytes shuffled
    dealt = df.repartition(partitions(df.sparkSession), *keys).sortWithinPartitions(*keys, *(order or []))
    return arrow_map(dealt, run, schema)


def pairs_within(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers (i, j), i < j, of all pairs within the groups that begin at `starts`."""
    end = np.repeat(starts + sizes, sizes)
    row = np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
    count = end - row - 1
    i = np.repeat(row, count)
    return i, i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count)


def least_of_part(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of n rows the smallest row that each is connected to by the links (a, b)."""
    label = np.arange(n)
    while True:
        m = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, m)
        np.minimum.at(label, b, m)
        label = label[label]
        if (label == before).all():
            return label


def link_batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
