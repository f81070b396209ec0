"""Schemas of the chain tables. Bytes are binary; hex appears at the edge only."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, BinaryType, BooleanType, DoubleType, IntegerType, LongType, ShortType, StringType, StructField, StructType, TimestampType

_CALL = StructType([StructField(n, StringType()) for n in ("to", "value", "input")])
_KINDS = {"long": LongType(), "int": IntegerType(), "short": ShortType(), "binary": BinaryType(), "string": StringType(), "boolean": BooleanType(), "double": DoubleType(), "timestamp": TimestampType(), "calls": ArrayType(_CALL)}


def columns(text: str) -> StructType:
    """A schema from `name kind, ...`."""
    return StructType([StructField(name, _KINDS[kind]) for name, kind in (c.split() for c in text.split(","))])


def extended(schema: StructType, text: str) -> StructType:
    """A new schema with more columns at its end."""
    return StructType(schema.fields + columns(text).fields)


_COLUMNS = {
    "blocks": "num long, hash binary, parent_hash binary, timestamp timestamp, timestamp_ms long, gas_limit long, gas_used long, miner binary, extra_data binary, consensus_proposer binary",
    "txs": "block_num long, block_timestamp timestamp, idx int, hash binary, type short, from binary, to binary, value string, input binary, gas_limit long, max_fee_per_gas string, max_priority_fee_per_gas string, gas_used long, nonce_key binary, nonce long, fee_token binary, fee_payer binary, calls calls, call_count short, valid_before long, valid_after long, signature_type short",
    "logs": "block_num long, block_timestamp timestamp, log_idx int, tx_idx int, tx_hash binary, address binary, selector binary, topic0 binary, topic1 binary, topic2 binary, topic3 binary, data binary, is_virtual_forward boolean",
    "receipts": "block_num long, block_timestamp timestamp, tx_idx int, tx_hash binary, from binary, to binary, contract_address binary, gas_used long, cumulative_gas_used long, effective_gas_price string, status short, fee_payer binary",
}

TABLES: dict[str, StructType] = {name: columns(text) for name, text in _COLUMNS.items()}
#: The key of a row in each table; the first column is the block number.
KEYS = {"blocks": ["num"], "txs": ["block_num", "idx"], "logs": ["block_num", "log_idx"], "receipts": ["block_num", "tx_idx"]}
BLOCK_COLUMN = {name: keys[0] for name, keys in KEYS.items()}
SYNC_STATE = columns("chain_id long, head_num long, synced_num long, tip_num long, backfill_num long, sync_rate double, started_at timestamp, updated_at timestamp, copied_num long, seq long")
