"""Chain reorganisations in the stream: headers are followed with keyed state, and what a fork takes back is taken back from
stored tables, live results and views in the batch that notices it."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from ledgerloom.operators import maintain
from ledgerloom.plans.views import View, ViewStore

_STATE = "nums array<long>, hashes array<binary>, parents array<binary>, waiting array<struct<num:long,hash:binary,parent:binary>>"
_OUT = "chain_id long, kind string, num long, hash binary"


class Headers:
    """The newest canonical headers of a chain, and headers that wait for their parent."""

    def __init__(self, depth: int, chain: dict[int, tuple[bytes, bytes]], waiting: list[tuple[int, bytes, bytes]]):
        self.depth, self.chain, self.waiting = depth, chain, waiting
        self.fork: int | None = None
        self.new: dict[int, bytes] = {}

    def _fits(self, num: int, digest: bytes, parent: bytes, known: bool) -> bool:
        """Takes a header in, if its parent is canonical, or, unless it must be `known`, if there is no block before it. A
        block of the same number, or one above with another parent, are a fork then, as what is delivered later is what the
        node now holds for right. Blocks above the fork may belong to the new branch, so they wait for their parent."""
        chain = self.chain
        if num in chain and chain[num][0] == digest:
            return True
        before, after = chain.get(num - 1), chain.get(num + 1)
        if known if before is None else before[0] != parent:
            return False
        if num in chain or (after is not None and after[1] != digest):
            self.fork = num - 1 if self.fork is None else min(self.fork, num - 1)
            self.waiting += [(n, *chain[n]) for n in chain if n > num]
            for n in [n for n in chain if n >= num]:
                del chain[n]
                self.new.pop(n, None)
        chain[num], self.new[num] = (digest, parent), digest
        return True

    def deliver(self, num: int, digest: bytes, parent: bytes) -> None:
        if not self._fits(num, digest, parent, known=False):
            self.waiting.append((num, digest, parent))
        else:  # a header that is taken in may be what others wait for, the lowest first
            while taken := next((h for h in sorted(self.waiting) if self._fits(*h, known=True)), None):
                self.waiting.remove(taken)
        top = max(self.chain, default=0)
        for n in [n for n in self.chain if n <= top - self.depth]:
            del self.chain[n]
        self.waiting = [h for h in self.waiting if h[0] > top - self.depth]


def follow_headers(headers: DataFrame, depth: int = 128) -> DataFrame:
    """A stream of headers (chain_id, num, hash, parent_hash, seq) as what changes: one row `fork` with the highest block that
    stays, if blocks that were canonical before aren't any more, and a row `head` for each block that has become canonical.

    Within a micro-batch headers are taken in the order of `seq`, then num. A header whose parent isn't the canonical block
    before it waits until that block comes, as the lower blocks of a new branch may be delivered later; a header that comes
    where there is no block before it is taken as it is. State holds the newest `depth` headers of a chain and those that wait; headers that
    wait deeper than that belong to no branch that can still win and go. A batch that runs again says the same."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        chain, waiting = {}, []
        if state.exists:
            nums, hashes, parents, held = state.get
            chain = {n: (bytes(h), bytes(p)) for n, h, p in zip(nums, hashes, parents, strict=True)}
            waiting = [(h[0], bytes(h[1]), bytes(h[2])) for h in held]
        before, h = set(chain), Headers(depth, chain, waiting)
        top = max(before, default=-1)
        for r in pd.concat(list(frames)).sort_values(["seq", "num"]).itertuples():
            h.deliver(r.num, bytes(r.hash), bytes(r.parent_hash))
        order = sorted(h.chain)
        state.update((order, [h.chain[n][0] for n in order], [h.chain[n][1] for n in order], h.waiting))
        rows = [(key[0], "fork", h.fork, None)] if h.fork is not None and h.fork < top else []
        rows += [(key[0], "head", n, digest) for n, digest in sorted(h.new.items())]
        yield pd.DataFrame(rows, columns=["chain_id", "kind", "num", "hash"])

    keyed = headers.select("chain_id", "num", "hash", "parent_hash", "seq").groupBy("chain_id")
    return keyed.applyInPandasWithState(step, _OUT, _STATE, "append", GroupStateTimeout.NoTimeout)


@dataclass
class Followed:
    """What hangs on one chain's blocks. tables: name -> (delivered rows with `block_hash`, block column, schema); live:
    name -> (a query that keeps the block column, the table it reads); views: (view with `bucket` among its keys, table)."""

    root: str
    store: ViewStore | None = None
    tables: Mapping[str, tuple[DataFrame, str, StructType]] = field(default_factory=dict)
    live: Mapping[str, tuple[Callable[[DataFrame], DataFrame], str]] = field(default_factory=dict)
    views: tuple[tuple[View, str], ...] = ()
    size: int = maintain.BUCKET

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, spark: SparkSession, name: str, touched: set[int] | None = None) -> DataFrame:
        """A stored table, or its rows in the buckets touched. Where these are most of it, one folder is listed and not each."""
        path, schema = self.path(name), self.tables[name][2]
        if touched is None:
            return maintain.stored(spark, path, schema)
        had = maintain.stored_buckets(spark, path)
        if len(had & touched) > len(had) // 2:
            return maintain.stored(spark, path, schema).where(F.col("bucket").isin(touched))
        return maintain.stored(spark, path, schema, had & touched)

    def apply(self, spark: SparkSession, fork: int | None, heads: DataFrame) -> None:
        """Takes back all blocks above the fork and adds the new heads' rows, in the buckets that either touches. Everything
        is worked out again for whole buckets from delivered rows, so a batch that broke off and comes again ends alike."""
        work = self.path("_work")
        mine = heads.select(F.col("num").alias("__n"), F.col("hash").alias("__h"))
        bucket = lambda c: maintain.bucket(c, self.size)
        touched = {r.b for r in heads.select(bucket("num").alias("b")).distinct().collect()}  # a number for each bucket touched
        low = None if fork is None else (fork + 1) // self.size
        for name, (delivered, block, schema) in self.tables.items():
            if low is not None:
                touched |= {b for b in maintain.stored_buckets(spark, self.path(name)) if b >= low}
        for name, (delivered, block, schema) in self.tables.items():
            old = self.table(spark, name, touched)
            kept = old.drop("bucket").join(mine, F.col(block) == F.col("__n"), "left_anti")
            kept = kept if fork is None else kept.where(F.col(block) <= fork)
            fresh = delivered.join(mine, (F.col(block) == F.col("__n")) & (F.col("block_hash") == F.col("__h")), "left_semi").select(*schema.names)
            maintain.rewrite(old, kept.select(*schema.names).unionByName(fresh), self.path(name), block, self.size, work, maintain.stored_buckets(spark, self.path(name)) & touched)
        left = {name: self.table(spark, name, touched) for name in self.tables}
        for name, (query, table) in self.live.items():
            block = self.tables[table][1]
            old = maintain.stored_buckets(spark, self.path(table))
            maintain.save_buckets(query(left[table].drop("bucket")), self.path(name), block, self.size, len(touched))
            maintain.drop_buckets(spark, self.path(name), [b for b in touched if b not in old])
        for view, table in self.views:
            old = maintain.stored_buckets(spark, self.path(table))
            self.store.replace(view, left[table], "chain", F.col("bucket"), [str(b) for b in touched if b not in old], len(touched))


def follow_chain(headers: DataFrame, followed: Followed, checkpoint: str, depth: int = 128, forever: bool = False):
    """Follows a stream of headers of one chain and keeps tables, live results and views those of the canonical chain alone.
    Ends when there is nothing new; with `forever` it stays open and the running query is returned.

    What a batch changes is written down and read by the session that the stream was made in, as the one of a stateful stream
    has no adaptive execution: its tables would be many small files."""
    spark = headers.sparkSession

    def step(changes: DataFrame, _: int) -> None:
        noted = f"{followed.path('_work')}/changes-{uuid.uuid4().hex}"
        changes.write.parquet(noted)
        found = spark.read.schema(changes.schema).parquet(noted)
        fork = found.where("kind = 'fork'").agg(F.min("num")).first()[0]
        heads = found.where("kind = 'head'")
        if fork is not None or not heads.isEmpty():
            followed.apply(spark, fork, heads)

    writer = follow_headers(headers, depth).writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    if forever:
        return writer.start()
    writer.trigger(availableNow=True).start().awaitTermination()
    return None
