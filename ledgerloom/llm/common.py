"""Helpers shared by the training-data operators."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ledgerloom.sources.scratch import scratch_path

#: Upper bound on the bytes that Spark hands to Python in one Arrow batch, so that very long texts don't pile up.
BATCH_BYTES = 16 << 20


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: writes df as Parquet in the shared folder and reads it back, so a lost executor costs no rerun
    of what stands before, and a value that depends on the order of rows stays as it was first computed."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """mapInArrow with batches of bounded size."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    return df.mapInArrow(fn, schema)


def numbered(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """df with its columns named by their places, and the new name of each: an operator that carries columns along works
    on these, so that none can clash with a column of its own, whatever it is called. `toDF` gives the names back."""
    new = [f"__in{i}" for i in range(len(df.columns))]
    return df.toDF(*new), dict(zip(df.columns, new, strict=True))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class WordIds(dict):
    """Word (bytes) -> 64-bit id, from a keyed hash; the same on every executor. Holds the words met so far, up to a
    bound, so that each distinct word is hashed about once a task."""

    LIMIT = 400_000

    def __init__(self, key: bytes):
        super().__init__()
        self.key = key

    def __missing__(self, word: bytes) -> int:
        value = int.from_bytes(hashlib.blake2b(word, digest_size=8, key=self.key).digest(), "little")
        if len(self) < self.LIMIT:
            self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values: spreads every input bit over all output bits."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class RollingHash:
    """Rabin-Karp hashes modulo 2^64 of all windows of a sequence of word ids, by prefix sums: with S the running sum
    of id[i] * B^i, the window at i of length w hashes to (S[i+w] - S[i]) * B^-i. B is odd, so B^-1 exists."""

    BASE = 0x9E3779B97F4A7C15

    def __init__(self):
        self.pow = self.inv = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.pow) < n:
            n = max(n, 2 * len(self.pow))
            step, back = np.full(n, self.BASE, np.uint64), np.full(n, pow(self.BASE, -1, 1 << 64), np.uint64)
            step[0] = back[0] = 1
            self.pow, self.inv = np.multiply.accumulate(step), np.multiply.accumulate(back)

    def windows(self, ids: np.ndarray, width: int) -> np.ndarray:
        n = len(ids)
        if n < width:
            return np.empty(0, np.uint64)
        self._grow(n)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(ids * self.pow[:n], out=sums[1:])
        return mix64((sums[width:] - sums[:-width]) * self.inv[: n - width + 1])


def texts_of(column: pa.Array) -> Iterator[bytes | None]:
    """UTF-8 bytes of each text of a string column; null stays None."""
    yield from column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist()
