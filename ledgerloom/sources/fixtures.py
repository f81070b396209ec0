"""Chain tables derived from the star-schema and event tables, in built-in functions: encode here, decode in queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.abi import APPROVAL, SWAP, TRANSFER, parse_signature
from ledgerloom.functions.words import address_of_long, word_of_long

EVENT_TYPES = ("click", "error", "purchase", "signup", "view")
#: The call that the A3 transactions carry.
TRANSFER_FUNCTION = parse_signature("transfer(address receiver, uint256 amount)")


def null_bytes() -> Column:
    return F.lit(None).cast("binary")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(x: Column) -> Column:
    return F.round(x * 100).cast("long")


def type_code(column: str = "event_type") -> Column:
    return (F.array_position(F.array(*[F.lit(t) for t in EVENT_TYPES]), F.col(column)) - 1).cast("short")


def block_of(event: Column) -> Column:
    return F.floor(event / F.lit(100)).cast("long")


def stamp(c: str) -> Column:
    return F.col(c).cast("timestamp")


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1: a block per order; hash = word(num + 1), parent_hash = word(num)."""
    o = read(spark, sf_dir, "orders")
    num = F.col("o_orderkey")
    return o.select(
        num.alias("num"), word_of_long(num + 1).alias("hash"), word_of_long(num).alias("parent_hash"), stamp("o_orderdate").alias("timestamp"),
        F.unix_millis(stamp("o_orderdate")).alias("timestamp_ms"), F.lit(1_000_000_000).cast("long").alias("gas_limit"), cents(F.col("o_totalprice")).alias("gas_used"),
        address_of_long(F.col("o_custkey")).alias("miner"), null_bytes().alias("extra_data"), null_bytes().alias("consensus_proposer"),
    )


def gapped_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2: the order keys that occur in lineitem; natural gaps."""
    return read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("num")).distinct()


def _sender() -> Column:
    return F.col("user_id")


def _receiver() -> Column:
    return (F.col("user_id") * 7 + F.col("event_id")) % 151


def txs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3: a transaction per event, 100 a block; gas_used is missing in every third."""
    e, i = read(spark, sf_dir, "events"), F.col("event_id")
    zero = F.lit(bytes(32))
    return e.select(
        block_of(i).alias("block_num"), stamp("ts").alias("block_timestamp"), (i % 100).cast("int").alias("idx"), word_of_long(i).alias("hash"), type_code().alias("type"),
        address_of_long(_sender()).alias("from"), address_of_long(_receiver()).alias("to"), cents(F.col("value")).cast("string").alias("value"),
        F.concat(F.lit(TRANSFER_FUNCTION.selector), word_of_long(_receiver()), word_of_long(cents(F.col("value")))).alias("input"), F.lit(100_000).cast("long").alias("gas_limit"),
        F.lit("7").alias("max_fee_per_gas"), F.lit("0").alias("max_priority_fee_per_gas"), F.when(i % 3 != 0, 20_000 + F.col("user_id")).alias("gas_used"), zero.alias("nonce_key"),
        i.alias("nonce"), null_bytes().alias("fee_token"), null_bytes().alias("fee_payer"), F.array(F.struct(F.lit(None).cast("string").alias("to"), F.lit("0x0").alias("value"), F.col("props").alias("input"))).alias("calls"),
        (F.lit(1) + (i % 4 == 0).cast("int")).cast("short").alias("call_count"), F.lit(None).cast("long").alias("valid_before"), F.lit(None).cast("long").alias("valid_after"), F.lit(0).cast("short").alias("signature_type"),
    )


def receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4: receipts of six events in seven."""
    e, i = read(spark, sf_dir, "events").where("event_id % 7 <> 0"), F.col("event_id")
    gas = 21_000 + F.col("user_id")
    return e.select(
        block_of(i).alias("block_num"), stamp("ts").alias("block_timestamp"), (i % 100).cast("int").alias("tx_idx"), word_of_long(i).alias("tx_hash"), address_of_long(_sender()).alias("from"),
        address_of_long(_receiver()).alias("to"), null_bytes().alias("contract_address"), gas.alias("gas_used"), gas.alias("cumulative_gas_used"), F.lit("7").alias("effective_gas_price"),
        (i % 10 != 0).cast("short").alias("status"), address_of_long(F.col("user_id")).alias("fee_payer"),
    )


def _log(block: Column, ts: Column, log_idx: Column, tx_hash: Column, address: Column, topics: list[Column], data: Column) -> list[Column]:
    topics = [*topics, *[null_bytes()] * (4 - len(topics))]
    return [
        block.alias("block_num"), ts.alias("block_timestamp"), log_idx.cast("int").alias("log_idx"), log_idx.cast("int").alias("tx_idx"), tx_hash.alias("tx_hash"), address.alias("address"),
        topics[0].alias("selector"), *[t.alias(f"topic{k}") for k, t in enumerate(topics)], data.alias("data"), F.lit(False).alias("is_virtual_forward"),
    ]


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5: a Transfer log per event."""
    i = F.col("event_id")
    return read(spark, sf_dir, "events").select(*_log(block_of(i), stamp("ts"), i % 100, word_of_long(i), address_of_long(1 + type_code().cast("long")), [F.lit(TRANSFER.topic), word_of_long(_sender()), word_of_long(_receiver())], word_of_long(cents(F.col("value")))))


def transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A6: a Transfer log per line item; log_idx isn't unique."""
    token = F.array_position(F.array(*[F.lit(x) for x in "ANR"]), F.col("l_returnflag"))
    return read(spark, sf_dir, "lineitem").select(*_log(F.col("l_orderkey"), stamp("l_shipdate"), F.col("l_linenumber"), word_of_long(F.col("l_orderkey")), address_of_long(token), [F.lit(TRANSFER.topic), word_of_long(F.col("l_suppkey")), word_of_long(100_000 + F.col("l_partkey"))], word_of_long(cents(F.col("l_extendedprice")))))


def swaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A7: a Swap log per line item; the pair is the supplier."""
    amounts = [word_of_long(cents(F.col(c))) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")]
    return read(spark, sf_dir, "lineitem").select(*_log(F.col("l_orderkey"), stamp("l_shipdate"), F.col("l_linenumber"), word_of_long(F.col("l_orderkey")), address_of_long(F.col("l_suppkey") % 10), [F.lit(SWAP.topic), word_of_long(F.col("l_suppkey")), word_of_long(F.col("l_partkey"))], F.concat(*amounts)))


def event_swaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A7 over events, whose timestamps have hours: pair by type, amounts in cents and a multiple of the user."""
    i = F.col("event_id")
    amounts = [word_of_long(cents(F.col("value"))), word_of_long(F.col("user_id")), word_of_long(F.col("user_id") * 3), word_of_long(i)]
    return read(spark, sf_dir, "events").select(*_log(block_of(i), stamp("ts"), i % 100, word_of_long(i), address_of_long(1 + type_code().cast("long")), [F.lit(SWAP.topic), word_of_long(_sender()), word_of_long(_receiver())], F.concat(*amounts)))


def approvals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A8: an Approval log per event."""
    i = F.col("event_id")
    return read(spark, sf_dir, "events").select(*_log(block_of(i), stamp("ts"), i % 100, word_of_long(i), address_of_long(F.lit(9)), [F.lit(APPROVAL.topic), word_of_long(F.col("user_id")), word_of_long(type_code().cast("long"))], word_of_long(cents(F.col("value")))))


def _hex(b: Column) -> Column:
    return F.concat(F.lit("0x"), F.lower(F.hex(b)))


def _quantity(k: Column) -> Column:
    return F.concat(F.lit("0x"), F.lower(F.hex(k.cast("long"))))


def block_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A9: a JSON block per 100 events, with its transactions in order."""
    t = txs(spark, sf_dir)
    one = F.struct(
        _hex(F.col("hash")).alias("hash"), _quantity(F.col("type")).alias("type"), _hex(F.col("from")).alias("from"), _hex(F.col("to")).alias("to"), _quantity(F.col("value").cast("long")).alias("value"), _hex(F.col("input")).alias("input"),
        _quantity(F.col("gas_limit")).alias("gas"), F.lit("0x7").alias("maxFeePerGas"), _quantity(F.col("nonce")).alias("nonce"),
    )
    per = t.groupBy("block_num").agg(F.array_sort(F.collect_list(F.struct("idx", one.alias("tx")))).alias("txs"), F.min("block_timestamp").alias("ts"))
    body = F.struct(
        _quantity(F.col("block_num")).alias("number"), _hex(word_of_long(F.col("block_num") + 1)).alias("hash"), _hex(word_of_long(F.col("block_num"))).alias("parentHash"), _quantity(F.unix_seconds("ts")).alias("timestamp"),
        F.lit("0x3b9aca00").alias("gasLimit"), _quantity(F.col("block_num") * 10).alias("gasUsed"), _hex(address_of_long(F.col("block_num") % 7)).alias("miner"), F.transform("txs", lambda x: x["tx"]).alias("transactions"),
    )
    return per.select(F.to_json(body).alias("payload"))


def receipt_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A9: a JSON list of receipts per block, each with the log of its event."""
    r, log = receipts(spark, sf_dir), logs(spark, sf_dir).select("block_num", "log_idx", "address", F.array("topic0", "topic1", "topic2").alias("topics"), "data")
    both = r.join(log, (r.block_num == log.block_num) & (r.tx_idx == log.log_idx)).select(r["*"], "address", "topics", "data", "log_idx")
    entry = F.struct(_quantity(F.col("log_idx")).alias("logIndex"), _hex(F.col("address")).alias("address"), F.transform("topics", _hex).alias("topics"), _hex(F.col("data")).alias("data"))
    one = F.struct(
        _quantity(F.col("block_num")).alias("blockNumber"), _quantity(F.col("tx_idx")).alias("transactionIndex"), _hex(F.col("tx_hash")).alias("transactionHash"), _hex(F.col("from")).alias("from"), _hex(F.col("to")).alias("to"), _quantity(F.col("gas_used")).alias("gasUsed"),
        _quantity(F.col("cumulative_gas_used")).alias("cumulativeGasUsed"), F.lit("0x7").alias("effectiveGasPrice"), _quantity(F.col("status")).alias("status"), _hex(F.col("fee_payer")).alias("feePayer"), F.array(entry).alias("logs"),
    )
    return both.groupBy("block_num").agg(F.to_json(F.array_sort(F.collect_list(one))).alias("payload")).select("payload")


def forwarding_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10: Transfer logs of one transaction per event. By event_id % 5: 0 a valid pair, 1 two destinations, 2 a count
    that doesn't match, 3 the forward first, 4 a plain transfer."""
    e = read(spark, sf_dir, "events").select("event_id", "ts", (F.col("event_id") % 5).alias("c"))
    tag = F.unhex(F.lpad(F.hex(F.col("event_id")), 12, "0"))
    virtual = F.concat(F.lit(bytes(12) + b"\0\0\0\x01" + b"\xfd" * 10), tag)
    a, b, m1, m2 = (word_of_long(F.lit(k)) for k in (7, 8, 101, 102))

    def hop(i: int, src: Column, dst: Column):
        return F.struct(F.lit(i).alias("i"), src.alias("src"), dst.alias("dst"))

    hops = (
        F.when(F.col("c") == 0, F.array(hop(0, a, virtual), hop(1, virtual, m1))).when(F.col("c") == 1, F.array(hop(0, a, virtual), hop(1, b, virtual), hop(2, virtual, m1), hop(3, virtual, m2)))
        .when(F.col("c") == 2, F.array(hop(0, a, virtual), hop(1, b, virtual), hop(2, virtual, m1))).when(F.col("c") == 3, F.array(hop(0, virtual, m1), hop(1, a, virtual))).otherwise(F.array(hop(0, a, b)))
    )
    x = e.withColumn("h", F.explode(hops))
    i = F.col("event_id")
    return x.select(*_log(block_of(i), stamp("ts"), (i % 100) * 4 + F.col("h.i"), word_of_long(i), address_of_long(F.lit(1)), [F.lit(TRANSFER.topic), F.col("h.src"), F.col("h.dst")], word_of_long(F.lit(500))))


def forked(blocks_df: DataFrame, depth: int = 40) -> DataFrame:
    """A11: the same chain with other hashes in its last `depth` blocks."""
    top = blocks_df.agg(F.max("num")).first()[0] or 0
    return blocks_df.withColumn("hash", F.when(F.col("num") > top - depth, F.concat(F.lit(b"\x01"), F.substring("hash", 2, 31))).otherwise(F.col("hash")))
