"""Keeping the chain tables right: idempotent replacement, rollback, copying, all-or-nothing batches.

Tables on disk are plain Parquet, partitioned by `bucket`, a stretch of block numbers. A change writes new files for
the buckets it touches, computed from a copy, and leaves the others alone.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Mapping
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerloom.schema import BLOCK_COLUMN, TABLES, extended
from ledgerloom.sources.tables import repair_txs

#: Blocks in one bucket of a stored table.
BUCKET = 10_000


def replace_blocks(target: DataFrame, batch: DataFrame, delivered: DataFrame | None = None, block: str = "block_num") -> DataFrame:
    """target without the block numbers of the batch (and those delivered, if listed: such a block may be empty now),
    plus the batch. Other blocks in between stay."""
    numbers = batch.select(F.col(block).alias("__b"))
    if delivered is not None:
        numbers = numbers.unionByName(delivered.select(F.col(delivered.columns[0]).alias("__b")))
    return target.join(numbers.distinct(), F.col(block) == F.col("__b"), "left_anti").unionByName(batch)


def insert_ignore(target: DataFrame, batch: DataFrame, keys: list[str], order: Column | None = None) -> DataFrame:
    """The first write of a key wins: target, plus the batch's rows with new keys, one a key (by `order`, if given). With
    an order, a task's rows are sorted by key and reduced to one a key before the shuffle."""
    once = batch.dropDuplicates(keys) if order is None else batch.groupBy(*keys).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in batch.columns]), order).alias("__r")).select("__r.*")
    had = target.select(*[F.col(f"`{k}`").alias(f"__{k}") for k in keys]).distinct()
    cond = [F.col(f"`{k}`").eqNullSafe(F.col(f"__{k}")) for k in keys]
    return target.unionByName(once.join(had, cond, "left_anti"))


def dedup_latest(df: DataFrame, keys: list[str], version: Column) -> DataFrame:
    """One row per key, that of the highest version. Rows are sorted by key within tasks and reduced to one a key before
    the shuffle, so what is shuffled and sorted again are the tasks' best rows only."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in df.columns]), version).alias("__r")).select("__r.*")


def bucket(block: str, size: int | None = None) -> Column:
    return F.floor(F.col(block) / F.lit(size or BUCKET)).cast("long")


def stored(spark: SparkSession, path: str, schema: StructType, buckets: set[int] | None = None) -> DataFrame:
    """A stored table, empty before its first write; of `buckets`, which must be there, only these folders are listed."""
    if buckets:
        return spark.read.schema(extended(schema, "bucket long")).option("basePath", path).parquet(*[f"{path}/bucket={b}" for b in sorted(buckets)])
    if buckets is not None:
        return spark.createDataFrame([], extended(schema, "bucket long"))
    try:
        return spark.read.schema(extended(schema, "bucket long")).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], extended(schema, "bucket long"))


def by_files(df: DataFrame, files: int, column: str) -> DataFrame:
    """Small rows that become a file for each value of the column, dealt so that no task is left to write all files."""
    return df.repartition(max(1, min(files, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))), column)


def save_buckets(df: DataFrame, path: str, block: str, size: int | None = None, small: int | None = None) -> None:
    """Overwrites the buckets that df has rows in, and no others. Rows are dealt by bucket, so a small bucket is a file;
    adaptive execution splits large ones, and where a session has none, a bucket is dealt to eight tasks. With `small`, the number of buckets,
    rows are few, like aggregates, and tasks share the files evenly and not the bytes."""
    placed = df.withColumn("bucket", bucket(block, size))
    adaptive = df.sparkSession.conf.get("spark.sql.adaptive.enabled") == "true"
    if small is not None:
        dealt = by_files(placed, small, "bucket")
    else:
        dealt = placed.hint("rebalance", F.col("bucket")) if adaptive else placed.repartition("bucket", F.pmod(F.xxhash64(block), F.lit(8)))
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def stored_buckets(spark: SparkSession, path: str) -> set[int]:
    """The buckets of a stored table, by the names of its folders: no file is opened."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in files.listStatus(root)] if files.exists(root) else []
    return {int(n.removeprefix("bucket=")) for n in names if re.fullmatch(r"bucket=-?\d+", n)}


def drop_buckets(spark: SparkSession, path: str, buckets: list[int]) -> None:
    """Deletes the files of whole buckets, which an overwrite without rows would leave as they are."""

    def drop(b: int) -> None:
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/bucket={b}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)

    with ThreadPoolExecutor(16) as pool:
        list(pool.map(drop, buckets))


def rewrite(old: DataFrame, new: DataFrame, path: str, block: str, size: int | None, work: str, had: Iterable[int] | None = None) -> None:
    """Puts `new` in place of `old`, the rows of some whole buckets of a stored table (`had`, if the caller knows them): first
    to a copy under `work`, from there over the buckets; buckets that have no row any more go. Whoever runs it again gets the
    same table. Where nothing was stored, nothing is read that is written over, so no copy is made."""
    spark, copy = old.sparkSession, f"{work}/{uuid.uuid4().hex}"
    if had is None:
        had = [r.bucket for r in old.select("bucket").distinct().collect()]  # one number for each bucket touched
    if not had:
        save_buckets(new, path, block, size)
        return
    new.write.parquet(copy)
    kept = spark.read.schema(new.schema).parquet(copy)
    left = {r.bucket for r in kept.select(bucket(block, size).alias("bucket")).distinct().collect()}
    if left:
        save_buckets(kept, path, block, size)
    drop_buckets(spark, path, [b for b in had if b not in left])


def store_replace(spark: SparkSession, path: str, batch: DataFrame, block: str, work: str, delivered: DataFrame | None = None, size: int | None = None) -> None:
    """replace_blocks on disk, within the buckets that the batch and the delivered blocks (which may be empty now) touch."""
    old = stored(spark, path, batch.schema)
    numbers = batch.select(F.col(block).alias("__n"))
    if delivered is not None:
        numbers = numbers.unionByName(delivered.select(F.col(delivered.columns[0]).alias("__n")))
    touched = old.join(numbers.select(bucket("__n", size).alias("bucket")).distinct(), "bucket", "left_semi")
    rewrite(touched, replace_blocks(touched.drop("bucket"), batch, delivered, block).select(*batch.columns), path, block, size, work)


def store_rollback(spark: SparkSession, path: str, schema: StructType, block: str, n: int, work: str, size: int | None = None) -> int:
    """Takes back all blocks from n on: the bucket that holds n is written again, later ones go. Returns how many block
    numbers were removed."""
    low = n // (size or BUCKET)
    above = stored(spark, path, schema).where(F.col("bucket") >= low)
    taken = F.count_distinct(F.when(F.col(block) >= n, F.col(block)))
    found = above.groupBy("bucket").agg(taken.alias("n")).collect()  # a row for each bucket touched
    rewrite(above, above.where((F.col("bucket") == low) & (F.col(block) < n)).drop("bucket"), path, block, size, work, [r.bucket for r in found])
    return sum(r.n for r in found)


def store_repair(spark: SparkSession, path: str, receipts: DataFrame, lo: int, hi: int, work: str, size: int | None = None) -> None:
    """repair_txs on disk: the buckets of blocks lo to hi are written again."""
    old = stored(spark, path, TABLES["txs"]).where(F.col("bucket").between(lo // (size or BUCKET), hi // (size or BUCKET)))
    rewrite(old, repair_txs(old.drop("bucket"), receipts, lo, hi).select(*TABLES["txs"].names), path, "block_num", size, work)


def rollback_from(tables: Mapping[str, DataFrame], n: int) -> tuple[dict[str, DataFrame], DataFrame]:
    """The tables without blocks from n on, and one row with the number of blocks removed."""
    kept = {name: df.where(F.col(BLOCK_COLUMN[name]) < n) for name, df in tables.items()}
    removed = tables["blocks"].where(F.col("num") >= n).agg(F.count_distinct("num").alias("removed"))
    return kept, removed


def write_batch(root: str, batch: str | Column, tables: Mapping[str, DataFrame]) -> None:
    """All tables or none: one job writes them as one dataset with the partitions (table, batch), so a task that fails
    anywhere ends it before its commit, and nothing of it is to be seen. A batch written again replaces its own; with a
    column as the batch (like the stretch of blocks), each of its values is one."""
    batch = F.lit(batch) if isinstance(batch, str) else batch
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumns({"table": F.lit(name), "batch": batch}) for name, df in tables.items()])
    every.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("table", "batch").parquet(root)


def read_committed(spark: SparkSession, root: str, name: str, schema: StructType | None = None) -> DataFrame:
    """The rows of a table in all batches that are whole; a partition filter leaves the other tables unread."""
    schema = schema or TABLES[name]
    try:
        rows = spark.read.schema(extended(schema, "table string, batch string")).parquet(root)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    return rows.where(F.col("table") == name).select(*schema.names)


def copied(spark: SparkSession, root: str) -> int | None:
    """The highest block of a copy."""
    return read_committed(spark, root, "blocks").agg(F.max("num")).first()[0]


def copy_range(spark: SparkSession, source: str, root: str, checkpoint: str, after: int = -1, files: int = 100) -> int | None:
    """Copies all tables stored under `source` (in buckets, see `save_buckets`), from block after + 1 on, as far as there is
    something new, and returns the highest block of the copy.

    The files of the blocks table are a stream, `files` of them a step, and Spark's checkpoint is the cursor. A step writes
    the buckets that its blocks are in, whole and with all tables in one job, in place of what the copy had of them. So
    steps that run again, or a new checkpoint that begins anew, end with the same copy, and a bucket that grew is whole."""
    blocks = spark.readStream.schema(extended(TABLES["blocks"], "bucket long")).option("maxFilesPerTrigger", files).parquet(f"{source}/blocks")

    def step(rows: DataFrame, _: int) -> None:
        touched = [r.bucket for r in rows.select("bucket").distinct().collect()]  # a number for each bucket of the step
        part = {name: stored(spark, f"{source}/{name}", TABLES[name]).where(F.col("bucket").isin(touched) & (F.col(BLOCK_COLUMN[name]) > after)) for name in TABLES}
        write_batch(root, F.concat(F.lit("bucket-"), F.col("bucket").cast("string")), {name: df for name, df in part.items()})

    blocks.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return copied(spark, root)


def write_clustered(df: DataFrame, path: str, time: str, sort: list[str], bloom: list[str], files: int = 8) -> None:
    """Monthly partitions, rows in the order of `sort` across and inside files, bloom filters on `bloom` columns."""
    month = df.withColumn("month", F.date_format(time, "yyyy-MM"))
    w = month.repartitionByRange(files, "month", *sort).sortWithinPartitions("month", *sort).write.mode("overwrite").partitionBy("month")
    for c in bloom:
        w = w.option(f"parquet.bloom.filter.enabled#{c}", "true")
    w.parquet(path)


def cut_points(df: DataFrame, columns: list[str], bits: int, sample: int = 10_000) -> dict[str, list]:
    """Up to 2^bits - 1 values of each column that cut it into parts of about equal size, from a sample of `sample` rows."""
    rows = df.select(*columns).orderBy(F.rand(7)).limit(sample).collect()
    found = {}
    for c in columns:
        values = sorted(bytes(r[c]) if isinstance(r[c], bytearray) else r[c] for r in rows if r[c] is not None)
        found[c] = sorted({values[i * len(values) >> bits] for i in range(1, 1 << bits)}) if values else []
    return found


def interleaved(points: dict[str, list], bits: int) -> Column:
    """A number that orders rows along several columns at once: the part of each column that a row is in, as bits, the
    first bits of all columns first (Z-order). Nulls are in a column's first part. Plain comparisons and shifts."""
    place, out = len(points) * bits, F.lit(0).cast("long")
    parts = {c: sum([F.coalesce((F.col(c) >= F.lit(v)).cast("long"), F.lit(0)) for v in values], F.lit(0).cast("long")) for c, values in points.items()}
    for b in reversed(range(bits)):
        for part in parts.values():
            place -= 1
            out = out + F.shiftleft(F.shiftright(part, b).bitwiseAND(F.lit(1).cast("long")), place)
    return out


def write_interleaved(df: DataFrame, path: str, columns: list[str], files: int = 64, bits: int = 4) -> None:
    """Files of rows that are near one another in each of the columns, so that a filter on any of them skips files and row
    groups by their least and greatest values, and by bloom filters what these don't tell."""
    z = df.withColumn("__z", interleaved(cut_points(df, columns, bits), bits))
    w = z.repartitionByRange(files, "__z").sortWithinPartitions("__z").drop("__z").write.mode("overwrite")
    for c in columns:
        w = w.option(f"parquet.bloom.filter.enabled#{c}", "true")
    w.parquet(path)


#: The columns that transactions, logs and receipts are joined by.
JOIN_KEYS = {"txs": ["block_num", "idx"], "logs": ["block_num", "tx_idx"], "receipts": ["block_num", "tx_idx"]}


def save_colocated(df: DataFrame, table: str, name: str, path: str, buckets: int) -> None:
    """Stores transactions, logs or receipts as a table of Spark's catalog, bucketed and sorted by block and place in the
    block, so that joins of such tables with equally many buckets need no shuffle. Rows are dealt before they are written,
    so there is one file a bucket."""
    keys = JOIN_KEYS[name]
    dealt = df.repartition(buckets, *keys).write.mode("overwrite").option("path", path)
    dealt.bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(table)


def merge_state(old: DataFrame, new: DataFrame) -> DataFrame:
    """Sync state per chain: the greatest head, synced, tip and copy cursor; the newest backfill and rate that aren't
    null; the oldest start; the newest update."""
    every = old.unionByName(new)
    known = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c)
    top = [F.max(c).alias(c) for c in ("head_num", "synced_num", "tip_num")]
    return every.groupBy("chain_id").agg(*top, known("backfill_num"), known("sync_rate"), F.min("started_at").alias("started_at"), F.max("updated_at").alias("updated_at"), F.max("copied_num").alias("copied_num"), F.max("seq").alias("seq"))


def conform(df: DataFrame, schema: StructType, defaults: Mapping[str, object] | None = None) -> DataFrame:
    """df with the columns of the schema in its order, missing ones at their default (null if none is given); columns
    that the schema doesn't know go. Conforming twice changes nothing."""
    defaults = defaults or {}
    return df.select(*[(F.col(f"`{f.name}`") if f.name in df.columns else F.lit(defaults.get(f.name))).cast(f.dataType).alias(f.name) for f in schema.fields])
