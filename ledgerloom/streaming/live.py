"""Live queries over new blocks, as Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def live_query(stream: DataFrame, query: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, block: str = "block_num", newest: int | None = None, table: DataFrame | None = None, forever: bool = False):
    """Runs `query`, which groups by the block column or selects rows with it, over each micro-batch: the results of
    all its new blocks in one job. They are written under out/results/batch=<id>, so a batch that runs again replaces
    its own. With `table`, the blocks that there are before the stream, the first call answers these in full, as batch
    -1. With `newest`, a batch that holds more blocks than that is served from its newest ones only, and a row
    (skipped) under out/lagged/batch=<id> says how many were left out. Ends when the stream has no more for now; a
    later call with the same checkpoint goes on. With `forever` it stays open for what comes, and the running streaming query
    is returned: its `stop()` ends it.
    """

    def serve(rows: DataFrame, batch: int) -> None:
        if newest is not None:
            top = rows.agg(F.max(block).alias("top"), F.min(block).alias("low")).first()
            if top.top is None:
                return
            skipped = max(0, top.top - newest - top.low + 1)
            rows = rows.where(F.col(block) > top.top - newest)
            if skipped:
                rows.sparkSession.createDataFrame([(skipped,)], "skipped long").write.mode("overwrite").parquet(f"{out}/lagged/batch={batch}")
        query(rows).write.mode("overwrite").parquet(f"{out}/results/batch={batch}")

    if table is not None:
        query(table).write.mode("ignore").parquet(f"{out}/results/batch=-1")
    writer = stream.writeStream.foreachBatch(serve).option("checkpointLocation", checkpoint)
    if forever:
        return writer.start()
    writer.trigger(availableNow=True).start().awaitTermination()
    return None


def _written(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.parquet(path).drop("batch")
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return spark.createDataFrame([], schema)


def results(spark: SparkSession, out: str, schema: str = "block_num long") -> DataFrame:
    """What has been answered; before the first answer, no rows of the given schema."""
    return _written(spark, f"{out}/results", schema)


def lagged(spark: SparkSession, out: str) -> DataFrame:
    """(skipped) of each batch that left blocks out; none, if none did."""
    return _written(spark, f"{out}/lagged", "skipped long")


def block_updates(blocks: DataFrame, txs: DataFrame, logs: DataFrame, chain_id: int) -> DataFrame:
    """Per block: chain_id, num, hash, tx_count, log_count (0 without any), timestamp."""
    t = txs.groupBy(F.col("block_num").alias("__t")).agg(F.count("*").alias("tx_count"))
    g = logs.groupBy(F.col("block_num").alias("__g")).agg(F.count("*").alias("log_count"))
    both = blocks.join(t, F.col("num") == F.col("__t"), "left").join(g, F.col("num") == F.col("__g"), "left")
    return both.select(F.lit(chain_id).cast("long").alias("chain_id"), "num", "hash", F.coalesce("tx_count", F.lit(0)).alias("tx_count"), F.coalesce("log_count", F.lit(0)).alias("log_count"), "timestamp")


def progress_rate(rows: DataFrame, time: str, seconds: int = 5, late: str = "1 minute", block: str | None = None, target: int | None = None) -> DataFrame:
    """(window_start, n, per_second): how many rows each window of event time holds, as a rate. With a block column and the
    block that is to be reached, from below or above, also `remaining`, the blocks between it and the window's nearest one,
    and eta_seconds at the window's rate of blocks."""
    keys = [F.count("*").alias("n")]
    if block is not None:
        keys += [F.min(F.abs(F.lit(target) - F.col(block))).alias("remaining"), F.max(block).alias("__hi"), F.min(block).alias("__lo")]
    w = rows.withWatermark(time, late).groupBy(F.window(time, f"{seconds} seconds").alias("w")).agg(*keys)
    out = [F.col("w.start").alias("window_start"), "n", (F.col("n") / F.lit(float(seconds))).alias("per_second")]
    if block is not None:
        blocks = F.col("__hi") - F.col("__lo") + 1
        out += ["remaining", (F.col("remaining") * F.lit(float(seconds)) / blocks).alias("eta_seconds")]
    return w.select(*out)
