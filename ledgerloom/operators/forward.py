"""Two-hop forwarding transfers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.abi import TRANSFER

MAGIC = b"\xfd" * 10


def is_virtual(address: Column) -> Column:
    """Whether bytes 4 to 13 of the 20-byte address are all 0xFD."""
    return (F.octet_length(address) == 20) & (F.substring(address, 5, 10) == F.lit(MAGIC))


def virtual_parts(address: Column) -> Column:
    """struct<master_id, user_tag> of a virtual address, else null."""
    return F.when(is_virtual(address), F.struct(F.substring(address, 1, 4).alias("master_id"), F.substring(address, 15, 6).alias("user_tag")))


def mark_forward_hops(logs: DataFrame) -> DataFrame:
    """logs with is_virtual_forward.

    A Transfer to a virtual address is an attribution, one from it a forward; both fall in the bucket of transaction,
    token, virtual address and amount. A bucket counts if it has as many of each and its forwards go to one place. In
    log order each forward then takes one earlier attribution that none has taken, and is marked; one that finds none
    is not. With +1 for an attribution, -1 for a forward and the running sum S, one is waiting iff S, before the row,
    is above the running minimum of S (0 at most). A log from a virtual address to another is in both buckets but acts
    as an attribution only. Only candidates are shuffled: marks are joined to the logs that could bear one, transfers from
    a virtual address to another kind, and all other logs pass by the join. Logs must be unique by (block_num, log_idx).
    """
    word = lambda c: (F.octet_length(c) == 32) & (F.substring(c, 1, 12) == F.lit(bytes(12)))
    candidate = (F.col("topic0") == F.lit(TRANSFER.topic)) & word("topic1") & word("topic2") & (F.octet_length("data") == 32) & (F.octet_length("tx_hash") == 32) & (F.octet_length("address") == 20)
    t = logs.where(candidate).select("block_num", "log_idx", "tx_hash", "address", "data", F.substring("topic1", 13, 20).alias("src"), F.substring("topic2", 13, 20).alias("dst"))
    role = lambda kind, who, acts: F.struct(F.lit(kind).alias("role"), who.alias("who"), acts.alias("acts"))
    src, dst = F.col("src"), F.col("dst")
    both = F.array(F.when(is_virtual(dst), role("A", dst, F.lit(True))), F.when(is_virtual(src), role("F", src, ~is_virtual(dst))))
    t = t.withColumn("r", F.explode(F.filter(both, lambda x: x.isNotNull()))).select("block_num", "log_idx", "tx_hash", "address", "data", "dst", "r.*")
    bucket = Window.partitionBy("tx_hash", "address", "who", "data")
    forward = F.col("role") == "F"
    t = t.withColumns({
        "n_a": F.sum(F.when(~forward, 1).otherwise(0)).over(bucket), "n_f": F.sum(F.when(forward, 1).otherwise(0)).over(bucket),
        "lo": F.min(F.when(forward, F.col("dst"))).over(bucket), "hi": F.max(F.when(forward, F.col("dst"))).over(bucket),
    }).where("n_a = n_f and n_f > 0 and lo = hi")
    step = F.when(~forward, 1).when(F.col("acts"), -1).otherwise(0)
    before = bucket.orderBy("block_num", "log_idx", "role").rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("s", F.sum(step).over(bucket.orderBy("block_num", "log_idx", "role").rowsBetween(Window.unboundedPreceding, 0)))
    t = t.withColumns({"was": F.coalesce(F.lag("s").over(bucket.orderBy("block_num", "log_idx", "role")), F.lit(0)), "low": F.least(F.lit(0), F.coalesce(F.min("s").over(before), F.lit(0)))})
    marks = t.where(forward & F.col("acts") & (F.col("was") > F.col("low"))).select("block_num", "log_idx", F.lit(True).alias("__mark"))
    could = F.coalesce(candidate & is_virtual(F.substring("topic1", 13, 20)) & ~is_virtual(F.substring("topic2", 13, 20)), F.lit(False))
    plain = logs.drop("is_virtual_forward")
    marked = plain.where(could).join(marks, ["block_num", "log_idx"], "left").select(*plain.columns, F.coalesce("__mark", F.lit(False)).alias("is_virtual_forward"))
    return marked.unionByName(plain.where(~could).withColumn("is_virtual_forward", F.lit(False)))
