"""Reading the chain tables, normalising payloads into them, and showing them as hex."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from ledgerloom.schema import TABLES, extended

_TX = "hash:string,type:string,`from`:string,`to`:string,value:string,input:string,gas:string,maxFeePerGas:string,maxPriorityFeePerGas:string,nonceKey:string,nonce:string,feeToken:string,calls:array<struct<to:string,value:string,input:string>>,validBefore:string,validAfter:string,signatureType:string"
BLOCK_PAYLOAD = f"struct<number:string,hash:string,parentHash:string,timestamp:string,gasLimit:string,gasUsed:string,miner:string,extraData:string,consensusProposer:string,transactions:array<struct<{_TX}>>>"
_LOG = "logIndex:string,address:string,topics:array<string>,data:string"
RECEIPT_PAYLOAD = f"array<struct<blockNumber:string,transactionIndex:string,transactionHash:string,`from`:string,`to`:string,contractAddress:string,gasUsed:string,cumulativeGasUsed:string,effectiveGasPrice:string,status:string,feePayer:string,logs:array<struct<{_LOG}>>>>"


def read_table(spark: SparkSession, path: str, name: str, chain_id: int | None = None) -> DataFrame:
    """One of the four tables with its schema enforced; with chain_id, one chain of a table partitioned by it."""
    df = spark.read.schema(TABLES[name] if chain_id is None else extended(TABLES[name], "chain_id long")).parquet(path)
    return df if chain_id is None else df.where(F.col("chain_id") == chain_id).select(*TABLES[name].names)


def digits(q: Column) -> Column:
    """The hex digits of a `0x` quantity without zeros before them; '' for zero."""
    return F.ltrim(F.substring(q, 3, 1 << 30), F.lit("0"))


def quantity(q: Column, kind: str = "long") -> Column:
    """A `0x` quantity as an integer; null from 2^63 on, or where it doesn't fit the kind, as nothing bounds what a
    payload says."""
    hex_digits = digits(q)
    return F.when(F.octet_length(hex_digits) <= 16, F.conv(F.concat(F.lit("0"), hex_digits), 16, 10).try_cast("long").try_cast(kind))


def raw(h: Column) -> Column:
    """`0x` hex as bytes; `0x` alone is empty, not null."""
    return F.unhex(F.substring(h, 3, 1 << 30))


def decimal_text(q: Column) -> Column:
    """A `0x` quantity of up to 256 bits as decimal text; null above."""
    from ledgerloom.functions.words import uint_to_text

    hex_digits = digits(q)
    return uint_to_text(F.when(F.octet_length(hex_digits) <= 64, F.unhex(F.lpad(hex_digits, 64, "0"))))


def parse_blocks(payloads: DataFrame) -> DataFrame:
    return payloads.select(F.from_json("payload", BLOCK_PAYLOAD).alias("b")).where("b.number is not null")


def _time(q: Column) -> Column:
    """Seconds as a timestamp; null after the year 9999."""
    seconds = quantity(q)
    return F.timestamp_seconds(F.when(seconds < 253_402_300_800, seconds))


def normalize_blocks(payloads: DataFrame) -> DataFrame:
    """JSON blocks -> blocks."""
    b = parse_blocks(payloads).select("b.*")
    c = F.col
    return b.select(quantity(c("number")).alias("num"), raw(c("hash")).alias("hash"), raw(c("parentHash")).alias("parent_hash"), _time(c("timestamp")).alias("timestamp"), F.unix_millis(_time(c("timestamp"))).alias("timestamp_ms"), quantity(c("gasLimit")).alias("gas_limit"), quantity(c("gasUsed")).alias("gas_used"), raw(c("miner")).alias("miner"), raw(c("extraData")).alias("extra_data"), raw(c("consensusProposer")).alias("consensus_proposer"))


def normalize_txs(payloads: DataFrame) -> DataFrame:
    """The transactions of JSON blocks in order; gas_used and fee_payer come with the receipts."""
    b = parse_blocks(payloads).select(quantity(F.col("b.number")).alias("block_num"), _time(F.col("b.timestamp")).alias("block_timestamp"), F.posexplode("b.transactions").alias("idx", "t"))
    t = lambda name: F.col(f"t.`{name}`")
    return b.select(
        "block_num", "block_timestamp", "idx", raw(t("hash")).alias("hash"), quantity(t("type"), "short").alias("type"), raw(t("from")).alias("from"), raw(t("to")).alias("to"), decimal_text(t("value")).alias("value"), raw(t("input")).alias("input"),
        quantity(t("gas")).alias("gas_limit"), decimal_text(t("maxFeePerGas")).alias("max_fee_per_gas"), F.coalesce(decimal_text(t("maxPriorityFeePerGas")), F.lit("0")).alias("max_priority_fee_per_gas"), F.lit(None).cast("long").alias("gas_used"),
        F.coalesce(F.unhex(F.lpad(F.substring(t("nonceKey"), 3, 64), 64, "0")), F.lit(bytes(32))).alias("nonce_key"), quantity(t("nonce")).alias("nonce"), raw(t("feeToken")).alias("fee_token"), F.lit(None).cast("binary").alias("fee_payer"), t("calls").alias("calls"),
        F.coalesce(F.when(t("calls").isNotNull(), F.size(t("calls"))), F.lit(1)).cast("short").alias("call_count"), quantity(t("validBefore")).alias("valid_before"), quantity(t("validAfter")).alias("valid_after"), F.coalesce(quantity(t("signatureType"), "short"), F.lit(0).cast("short")).alias("signature_type"),
    )


def _receipts(payloads: DataFrame, blocks: DataFrame) -> DataFrame:
    """Each receipt with its block's time; those without a block are dropped."""
    r = payloads.select(F.explode(F.from_json("payload", RECEIPT_PAYLOAD)).alias("r")).withColumn("block_num", quantity(F.col("r.blockNumber")))
    return r.join(blocks.select(F.col("num").alias("block_num"), F.col("timestamp").alias("block_timestamp")), "block_num")


def normalize_receipts(payloads: DataFrame, blocks: DataFrame) -> DataFrame:
    r = lambda name: F.col(f"r.`{name}`")
    return _receipts(payloads, blocks).select(
        "block_num", "block_timestamp", quantity(r("transactionIndex"), "int").alias("tx_idx"), raw(r("transactionHash")).alias("tx_hash"), raw(r("from")).alias("from"), raw(r("to")).alias("to"), raw(r("contractAddress")).alias("contract_address"),
        quantity(r("gasUsed")).alias("gas_used"), quantity(r("cumulativeGasUsed")).alias("cumulative_gas_used"), decimal_text(r("effectiveGasPrice")).alias("effective_gas_price"), quantity(r("status"), "short").alias("status"), raw(r("feePayer")).alias("fee_payer"),
    )


def normalize_logs(payloads: DataFrame, blocks: DataFrame) -> DataFrame:
    """The logs of JSON receipts; selector is topic0, missing topics are null."""
    e = _receipts(payloads, blocks).select("block_num", "block_timestamp", quantity(F.col("r.transactionIndex"), "int").alias("tx_idx"), raw(F.col("r.transactionHash")).alias("tx_hash"), F.explode("r.logs").alias("l"))
    topic = [raw(F.get("l.topics", F.lit(i))) for i in range(4)]
    return e.select("block_num", "block_timestamp", quantity(F.col("l.logIndex"), "int").alias("log_idx"), "tx_idx", "tx_hash", raw(F.col("l.address")).alias("address"), topic[0].alias("selector"), *[t.alias(f"topic{i}") for i, t in enumerate(topic)], raw(F.col("l.data")).alias("data"), F.lit(False).alias("is_virtual_forward"))


def enrich_txs(txs: DataFrame, receipts: DataFrame) -> DataFrame:
    """gas_used and fee_payer from the receipt of (block_num, idx), nulls included; without one, values stay."""
    r = receipts.select(F.col("block_num").alias("__b"), F.col("tx_idx").alias("__i"), F.col("gas_used").alias("__g"), F.col("fee_payer").alias("__f"), F.lit(True).alias("__hit"))
    both = txs.join(r, (F.col("block_num") == F.col("__b")) & (F.col("idx") == F.col("__i")), "left")
    return both.withColumns({"gas_used": F.when(F.col("__hit"), F.col("__g")).otherwise(F.col("gas_used")), "fee_payer": F.when(F.col("__hit"), F.col("__f")).otherwise(F.col("fee_payer"))}).select(*txs.columns)


def repair_txs(txs: DataFrame, receipts: DataFrame, lo: int, hi: int) -> DataFrame:
    """enrich_txs for the rows of blocks lo to hi that have no gas_used; all other rows pass by the join."""
    broken = F.col("block_num").between(lo, hi) & F.col("gas_used").isNull()
    return enrich_txs(txs.where(broken), receipts.where(F.col("block_num").between(lo, hi))).unionByName(txs.where(~F.coalesce(broken, F.lit(False))))


def hex_view(df: DataFrame) -> DataFrame:
    """Every binary column as `0x` lower-case hex; null stays null, but a null selector is ''."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        shown = F.concat(F.lit("0x"), F.lower(F.hex(c))) if isinstance(f.dataType, BinaryType) else c
        out.append((F.coalesce(shown, F.lit("")) if f.name == "selector" else shown).alias(f.name))
    return df.select(*out)


def hex_lit(text: str) -> Column:
    """A literal for comparisons: `0x` and 40 hex digits or more as bytes, all else as the text it is."""
    if re.fullmatch(r"0x(?:[0-9a-fA-F]{2}){20,}", text):
        return F.lit(bytes.fromhex(text[2:]))
    return F.lit(text)
