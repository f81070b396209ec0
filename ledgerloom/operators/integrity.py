"""What is missing or inconsistent. Block numbers are held as bitmaps, one row for each bucket of numbers: a task sends one
row per bucket and not one per number, bitmaps of several tables or batches merge by OR, and only one row per bucket meets
in one task."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, DataFrameReader, Row, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.schema import BLOCK_COLUMN

#: Block numbers in a bucket, a power of two; a bitmap holds 32,768 bits.
BUCKET = 32_768
#: The bits of each hexadecimal digit.
NIBBLES = {f"{i:X}": f"{i:04b}" for i in range(16)}


def block_bitmaps(nums: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, bucket, bits): which numbers of the bucket are there, the lowest in the highest bit of the first byte. Numbers
    are those of the column outside `by`, integers of any sign; nulls are left out, repeated ones count once. Block numbers
    are dense: scattered ones cost a bitmap of 4 kB for each bucket that they touch."""
    num = F.col(next(c for c in nums.columns if c not in by)).cast("long")
    place = F.pmod(num, F.lit(BUCKET))
    bit = place - place % 8 + 7 - place % 8
    n = nums.where(num.isNotNull()).select(*by, F.shiftright(num, BUCKET.bit_length() - 1).alias("bucket"), bit.alias("bit"))
    return n.groupBy(*by, "bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))


def merge_bitmaps(parts: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Bitmaps of several tables, partitions or batches as one: (*by, bucket, bits)."""
    return parts.groupBy(*by, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def bit_text(bits: Column) -> Column:
    """The bitmap as 0s and 1s, lowest number first. Digits become letters first, so that no 0 or 1 is replaced twice."""
    letters = "abcdefghijklmnop"
    text = F.translate(F.hex(bits), "".join(NIBBLES), letters)
    for letter, four in zip(letters, NIBBLES.values(), strict=True):
        text = F.replace(text, F.lit(letter), F.lit(four))
    return F.substring(text, 1, BUCKET)


def bucket_ends(maps: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, bucket, text, lo, hi, before): least and greatest number of each bucket, the text of the bits between them,
    and the greatest number of the bucket before (null for the first)."""
    t = maps.withColumn("text", bit_text(F.col("bits"))).select(*by, "bucket", "text", (F.col("bucket") * BUCKET).alias("base"))
    lo = F.col("base") + F.instr("text", "1") - 1
    hi = F.col("base") + F.length("text") - F.instr(F.reverse("text"), "1")
    ends = t.select(*by, "bucket", F.btrim("text", F.lit("0")).alias("text"), lo.alias("lo"), hi.alias("hi"))
    before = ends.select(*by, "bucket", "lo", "hi").withColumn("before", F.lag("hi").over((Window.partitionBy(*by) if by else Window).orderBy("bucket")))
    before = before.select(*[F.col(c).alias(f"e_{c}") for c in by], F.col("bucket").alias("e_bucket"), "before")
    same = F.col("bucket") == F.col("e_bucket")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"e_{c}"))
    return ends.join(before, same).select(*by, "bucket", "text", "lo", "hi", "before")


def runs_within(ends: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, bucket, before, there, first, last): runs of numbers that are there or aren't, between the ends of a bucket."""
    each = ends.select(*by, "bucket", "lo", "before", F.posexplode(F.split("text", "(?<=1)(?=0)|(?<=0)(?=1)")).alias("i", "run"))
    end = F.col("lo") + F.sum(F.length("run")).over(Window.partitionBy(*by, "bucket").orderBy("i")) - 1
    return each.withColumn("last", end).select(*by, "bucket", "before", F.col("run").startswith("1").alias("there"), (F.col("last") - F.length("run") + 1).alias("first"), "last")


def gaps_of(maps: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, gap_start, gap_end) between existing numbers, from bitmaps."""
    ends = bucket_ends(maps, by)
    across = ends.where("lo > before + 1").select(*by, (F.col("before") + 1).alias("gap_start"), (F.col("lo") - 1).alias("gap_end"))
    inside = runs_within(ends.where(F.col("text").contains("0")), by).where("not there").select(*by, F.col("first").alias("gap_start"), F.col("last").alias("gap_end"))
    return inside.unionByName(across)


def detect_gaps(blocks: DataFrame, below: int | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """(gap_start, gap_end) between existing blocks up to `below`, for each value of the columns `by`."""
    b = blocks.select(*by, "num") if below is None else blocks.select(*by, "num").where(F.col("num") <= below)
    return gaps_of(block_bitmaps(b, by), by)


def detect_all_gaps(blocks: DataFrame, tip: int) -> DataFrame:
    """Gaps up to the tip, newest first: also before the first block, and 1 to tip if there is none; not after the last."""
    first = blocks.agg(F.min("num").alias("m"))
    leading = first.select(F.lit(1).cast("long").alias("gap_start"), F.when(F.col("m").isNull(), F.lit(tip)).otherwise(F.col("m") - 1).cast("long").alias("gap_end")).where("gap_end >= gap_start")
    return detect_gaps(blocks).unionByName(leading).where(F.col("gap_end") <= tip).orderBy(F.desc("gap_end"))


def has_gaps(blocks: DataFrame, lo: int, hi: int) -> DataFrame:
    """One row: whether some number from lo to hi has no block; false if hi < lo."""
    n = block_bitmaps(blocks.select("num").where(F.col("num").between(lo, hi))).agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).alias("n"))
    return n.select((F.lit(hi >= lo) & (F.col("n") != hi - lo + 1)).alias("has_gaps"))


def blocks_missing_receipts(blocks: DataFrame, receipts: DataFrame, k: int) -> DataFrame:
    """The k newest blocks that no receipt mentions."""
    return blocks.join(receipts.select(F.col("block_num").alias("__b")).distinct(), F.col("num") == F.col("__b"), "left_anti").select("num").orderBy(F.desc("num")).limit(k)


def group_ranges(nums: DataFrame, max_size: int = 10) -> DataFrame:
    """(range_start, range_end): runs of consecutive numbers, cut every max_size from their start.

    A run's start carries over from bucket to bucket by one running maximum over the bucket rows: the latest start in
    a bucket, or, if a bucket goes on from the one before without a break, that one's.
    """
    runs = runs_within(bucket_ends(block_bitmaps(nums))).where("there")
    goes_on = F.col("before").isNotNull() & (F.col("first") == F.col("before") + 1)
    runs = runs.withColumn("own", F.when(~goes_on, F.col("first")))
    last = runs.groupBy("bucket").agg(F.max("own").alias("last_own"))
    carried = last.select(F.col("bucket").alias("cb"), F.max("last_own").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)).alias("carry"))
    runs = runs.join(carried, F.col("bucket") == F.col("cb")).withColumn("start", F.coalesce("own", "carry"))
    chunk = lambda c: F.floor((F.col(c) - F.col("start")) / F.lit(max_size)).cast("long")
    cut = runs.withColumn("chunk", F.explode(F.sequence(chunk("first"), chunk("last"))))
    low = F.col("start") + F.col("chunk") * max_size
    ends = cut.groupBy("start", "chunk").agg(F.min(F.greatest("first", low)).alias("range_start"), F.max(F.least(F.col("last"), low + max_size - 1)).alias("range_end"))
    return ends.select("range_start", "range_end")


def plan_batches(gaps: DataFrame, size: int) -> DataFrame:
    """Each gap cut from its top end down into batches of `size`: (batch_start, batch_end), newest first."""
    k = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("gap_end") - F.col("gap_start")) / F.lit(size)).cast("long")))
    cut = gaps.withColumn("k", k).withColumn("batch_end", F.col("gap_end") - F.col("k") * size)
    return cut.select(F.greatest(F.col("batch_end") - size + 1, F.col("gap_start")).alias("batch_start"), "batch_end").orderBy(F.desc("batch_end"))


def parent_breaks(blocks: DataFrame) -> DataFrame:
    """Blocks whose parent_hash isn't the hash of block num - 1; without that block there is no break."""
    parent = blocks.select((F.col("num") + 1).alias("__n"), F.col("hash").alias("expected"))
    return blocks.join(parent, F.col("num") == F.col("__n")).where(F.col("parent_hash") != F.col("expected")).select("num", "parent_hash", "expected")


def fork_point(stored: DataFrame, canonical: DataFrame, mismatch: int, depth: int = 128) -> DataFrame:
    """One row: the highest block below `mismatch`, within depth and from 1 on, whose stored hash is the canonical one
    or which isn't stored; null if there is none. Of several stored blocks of a number the latest counts."""
    lo = max(1, mismatch - depth)
    span = canonical.sparkSession.range(lo, max(mismatch, lo)).withColumnRenamed("id", "num")
    near = F.col("num").between(lo, mismatch - 1)
    s = stored.where(near).groupBy("num").agg(F.max_by("hash", "timestamp").alias("own"))
    c = canonical.where(near).groupBy("num").agg(F.max_by("hash", "timestamp").alias("theirs"))
    both = span.join(s, "num", "left").join(c, "num", "left")
    return both.agg(F.max(F.when(F.col("own").isNull() | (F.col("own") == F.col("theirs")), F.col("num"))).alias("fork_point"))


def watermarks(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table_name, max_block, n_rows) of each table."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.max(BLOCK_COLUMN[name]).alias("max_block"), F.count("*").alias("n_rows")).select(F.lit(name).alias("table_name"), "max_block", "n_rows")
        out = one if out is None else out.unionByName(one)
    return out


def from_footers(df: DataFrame, aggregates: list[Column]) -> Row:
    """Aggregates (counts, least and greatest values) over all rows of stored Parquet, which Spark takes from the files'
    footers: no row is read. df must come from `footer_reader`."""
    return df.agg(*aggregates).first()


@contextmanager
def footer_reader(spark: SparkSession) -> Iterator[DataFrameReader]:
    """A reader whose Parquet aggregates are pushed into the footers, as long as the block lasts: that is a setting of
    Spark's newer Parquet source, which is turned on here and set back."""
    settings = {"spark.sql.sources.useV1SourceList": "avro,csv,json,kafka,orc,text", "spark.sql.parquet.aggregatePushdown": "true"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        yield spark.read
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def stored_watermarks(spark: SparkSession, paths: Mapping[str, str]) -> DataFrame:
    """`watermarks` of tables stored as Parquet, at the cost of opening their files."""
    rows = []
    with footer_reader(spark) as reader:
        for name, path in paths.items():
            r = from_footers(reader.parquet(path), [F.max(BLOCK_COLUMN[name]).alias("m"), F.count("*").alias("n")])
            rows.append((name, r.m, r.n))
    return spark.createDataFrame(rows, "table_name string, max_block long, n_rows long")


def _up_to_tip(state: DataFrame, blocks: DataFrame) -> DataFrame:
    """(chain_id, num) of the blocks of each chain of the state, up to that chain's tip."""
    tips = state.select(F.col("chain_id").alias("__c"), F.col("tip_num").alias("__tip"))
    return blocks.select("chain_id", "num").join(tips, (F.col("chain_id") == F.col("__c")) & (F.col("num") <= F.col("__tip"))).select("chain_id", "num")


def sync_gaps(state: DataFrame, blocks: DataFrame) -> DataFrame:
    """(chain_id, gap_start, gap_end), a row for each gap between blocks (chain_id, num) of one chain, up to its tip."""
    return detect_gaps(_up_to_tip(state, blocks), by=("chain_id",))


def sync_status(state: DataFrame, blocks: DataFrame, now: Column) -> DataFrame:
    """One row per chain of the state: lag, gap_blocks (negative if synced leads), backfill_remaining (not begun:
    synced - 1), rate, eta_secs, coverage_pct (of the chain's own blocks, whole, 100 at most), and how many gaps there are
    between its blocks up to its tip (n_gaps) and blocks in them (missing). The gaps themselves are the rows of
    `sync_gaps`. blocks: (chain_id, num)."""
    gaps = sync_gaps(state, blocks).groupBy(F.col("chain_id").alias("__g")).agg(F.count("*").alias("n_gaps"), F.sum(F.col("gap_end") - F.col("gap_start") + 1).alias("missing"))
    rows = blocks.groupBy(F.col("chain_id").alias("__b")).agg(F.count_distinct("num").alias("n_blocks"))
    c = F.col
    left = F.when(c("backfill_num").isNull(), c("synced_num") - 1).otherwise(c("backfill_num"))
    done = F.when(c("backfill_num").isNull(), F.lit(1)).otherwise(c("synced_num") - c("backfill_num") + 1)
    elapsed = F.unix_timestamp(now) - F.unix_timestamp("started_at")
    s = state.withColumns({"backfill_remaining": left, "rate": F.when(elapsed > 0, done / elapsed)})
    none = F.lit(0).cast("long")
    out = s.join(gaps, c("chain_id") == c("__g"), "left").join(rows, c("chain_id") == c("__b"), "left")
    return out.select(
        "chain_id", (c("head_num") - c("tip_num")).alias("lag"), (c("tip_num") - c("synced_num")).alias("gap_blocks"), "backfill_remaining", "rate", F.when(c("rate") > 0, c("backfill_remaining") / c("rate")).alias("eta_secs"),
        F.when(c("head_num") > 0, F.least(F.lit(100), F.floor(F.lit(100) * F.coalesce("n_blocks", none) / c("head_num")))).otherwise(F.lit(0)).cast("long").alias("coverage_pct"), F.coalesce("n_gaps", none).alias("n_gaps"), F.coalesce("missing", none).alias("missing"),
    )
