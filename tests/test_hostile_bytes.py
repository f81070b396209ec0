"""Decoding never ends a job, whatever the bytes are, and says null where they don't fit."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import words
from ledgerloom.functions.abi import parse_signature
from ledgerloom.operators import decode
from ledgerloom.sources import tables

EXTREME = [0, 1, 31, 32, 33, 64, 96, 2**31 - 1, 2**31, 2**32, 2**55, 2**56, 2**63 - 33, 2**63 - 1, 2**63, 2**64 - 1, 2**111, 2**112, 2**119, 2**120, 2**200, 2**255 - 1, 2**255, 2**256 - 2**63, 2**256 - 2**55, 2**256 - 2**119 - 1, 2**256 - 1]
TYPES = [f"{k}{b}" for k in ("uint", "int") for b in (8, 24, 56, 64, 112, 120, 128, 256)] + ["bool", "address", "bytes4", "bytes32", "bytes", "string", "uint256[]", "uint8[3]", "string[]", "bytes[2]", "uint112[][]", "string[][]", "uint8[0][]", "int24[2][]"]


def word(k):
    return k.to_bytes(32, "big")


def logs(spark, payloads):
    return spark.createDataFrame([(i, bytearray(p)) for i, p in enumerate(payloads)], "block_num long, data binary")


@pytest.fixture(scope="module")
def payloads():
    r = random.Random(9)
    made = [b"", b"\x00", bytes(31), *[word(k) for k in EXTREME]]
    for _ in range(250):
        made.append(b"".join(word(r.choice(EXTREME)) for _ in range(r.randrange(1, 7))) + r.randbytes(r.choice((0, 0, 5))))
    return made


def test_no_bytes_end_a_job(spark, payloads):
    df = logs(spark, payloads)
    s = parse_signature("E(" + ", ".join(f"{t} p{i}" for i, t in enumerate(TYPES)) + ")")
    for p in s.parameters:  # each alone at the head, where the words are extreme
        one = parse_signature(f"E({p.type.name} b)")
        got = df.select("block_num", *[v.alias(k) for k, v in decode.parameter_columns(one).items()]).collect()
        assert len(got) == len(payloads)
    call = spark.createDataFrame([(i, bytearray(one.selector + p)) for i, p in enumerate(payloads)], "block_num long, input binary").withColumn("idx", F.lit(0)).withColumn("hash", F.lit(b""))
    assert decode.decode_calldata(call, one).count() == len(payloads)


@pytest.mark.parametrize("bits", [8, 24, 56, 64, 112, 120, 128, 256])
def test_wide_words_are_null_and_others_exact(spark, bits):
    values = sorted({*EXTREME, 2 ** (bits - 1) - 1, 2 ** (bits - 1), 2**bits - 1, 2**bits % 2**256, 2**256 - 2 ** (bits - 1), 2**256 - 2 ** (bits - 1) - 1, 123456789 * 10**8, 10**76, 2**256 - 10**70})
    df = logs(spark, [word(v) for v in values])
    rows = df.select("block_num", decode.abi_uint(F.col("data"), bits).cast("string").alias("u"), decode.abi_int(F.col("data"), bits).cast("string").alias("i")).collect()
    for r in rows:
        v = values[r.block_num]
        signed = v - 2**256 if v >= 2**255 else v
        assert r.u == (str(v) if v < 2**bits else None)
        assert r.i == (str(signed) if -(2 ** (bits - 1)) <= signed < 2 ** (bits - 1) else None)


def test_random_words_are_exact(spark):
    r = random.Random(4)
    values = [r.getrandbits(r.randrange(1, 257)) for _ in range(500)] + [2**256 - r.getrandbits(r.randrange(1, 255)) - 1 for _ in range(500)]
    got = logs(spark, [word(v) for v in values]).select("block_num", words.uint_to_text(F.col("data")).alias("u"), words.int_to_text(F.col("data")).alias("i")).collect()
    assert all((x.u, x.i) == (str(values[x.block_num]), str(values[x.block_num] - (2**256 if values[x.block_num] >= 2**255 else 0))) for x in got)


def test_pointers_and_lengths(spark):
    body = word(3) + b"abc" + bytes(29)
    cases = [(word(32) + body, b"abc"), (word(32) + word(4) + b"abc", None), (word(2**63 - 1) + body, None), (word(2**63 - 33) + body, None), (word(64) + bytes(32) + word(0), b""), (word(96) + bytes(64), None), (word(33) + b"\0" + body, b"abc"), (word(32) + word(2**63 - 1), None)]
    got = logs(spark, [c for c, _ in cases]).select("block_num", decode.abi_bytes(F.col("data"), 0).alias("b")).collect()
    assert [None if x.b is None else bytes(x.b) for x in sorted(got)] == [b for _, b in cases]


def test_quantities_beyond_their_kind(spark):
    payload = '{"number":"0x1","hash":"0x01","parentHash":"0x00","timestamp":"%s","gasLimit":"%s","gasUsed":"0x0000000000000000005","transactions":[{"hash":"0x02","type":"0xfffff","value":"0x1%s","nonce":"0xffffffffffffffff","gas":"0x7fffffffffffffff","validBefore":"0xffffffffffffffffff"}]}'
    df = spark.createDataFrame([(payload % ("0x5", "0x8000000000000000", "0" * 64),), (payload % ("0xffffffffffff", "0x", "0" * 63),)], "payload string")
    blocks = [tuple(r) for r in tables.normalize_blocks(df).select("num", "gas_limit", "gas_used", "timestamp_ms").collect()]
    assert blocks == [(1, None, 5, 5000), (1, 0, 5, None)]
    txs = tables.normalize_txs(df).select("type", "value", "nonce", "gas_limit", "valid_before").collect()
    assert [tuple(r) for r in txs] == [(None, None, None, 2**63 - 1, None), (None, str(16**63), None, 2**63 - 1, None)]


def test_overloads_stand_side_by_side(spark):
    a, b = parse_signature("E(uint256 b)"), parse_signature("E(address b)")
    rows = [(i, bytearray(s.topic), bytearray(word(7)), 1) for i, s in enumerate((a, b, b))]
    df = spark.createDataFrame(rows, "block_num long, selector binary, data binary, log_idx int")
    assert {k: v.count() for k, v in decode.decode_many(df, [a, b]).items()} == {"E(uint256)": 1, "E(address)": 2}
    union = decode.decode_union(df, [a, b, "F(uint256 b)"])
    got = sorted((r.block_num, r.event, r.b_string, None if r.b_binary is None else bytes(r.b_binary)) for r in union.collect())
    assert got == [(0, "E(uint256)", "7", None), (1, "E(address)", None, bytes(19) + b"\7"), (2, "E(address)", None, bytes(19) + b"\7")]
    assert decode.register_events(df, [a, b]) == ["logs", "E(uint256)", "E(address)"]
    assert spark.sql("SELECT count(*) AS n FROM `E(address)` x JOIN `E(uint256)` y ON x.block_num > y.block_num").first().n == 2
