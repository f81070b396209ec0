import random

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom.functions import words
from ledgerloom.functions.abi import APPROVAL, TRANSFER, Abi, encode_word, keccak256, parse_signature, parse_type
from ledgerloom.operators import decode

EDGES = [0, 1, 2**31, 2**32 - 1, 2**32, 2**63 - 1, 2**63, 2**64, 10**18, 10**27, 2**127, 2**128, 2**255 - 1, 2**255, 2**256 - 1]


def frame(spark, values):
    return spark.createDataFrame([(i, bytearray((v % 2**256).to_bytes(32, "big"))) for i, v in enumerate(values)], "i long, w binary")


def test_decimal_text_of_unsigned_and_signed_words(spark):
    rng = random.Random(1)
    values = EDGES + [rng.getrandbits(rng.randrange(1, 257)) for _ in range(200)]
    got = {r.i: r for r in frame(spark, values).select("i", words.uint_to_text(F.col("w")).alias("u"), words.int_to_text(F.col("w")).alias("s")).collect()}
    for i, v in enumerate(values):
        assert got[i].u == str(v)
        assert got[i].s == str(v - 2**256 if v >= 2**255 else v)


def test_sums_with_signs_are_exact(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(12), rng.getrandbits(250), rng.choice((1, -1))) for _ in range(600)]
    df = spark.createDataFrame([(g, bytearray(v.to_bytes(32, "big")), s) for g, v, s in rows], "g int, w binary, s int")
    t = df.groupBy("g").agg(*words.sum_limbs(F.col("w"), F.col("s"))).select("g", words.limbs_to_text(words.summed()).alias("t"), words.total_is_positive().alias("p"))
    for r in t.collect():
        total = sum(v * s for g, v, s in rows if g == r.g)
        assert (r.t, r.p) == (str(total), total > 0)


def test_sums_far_beyond_256_bits(spark):
    df = spark.range(5000).select(F.lit(b"\xff" * 32).alias("w"), F.when(F.col("id") < 0, 1).otherwise(-1).alias("s"))
    for sign, want in ((None, 5000 * (2**256 - 1)), ("s", -5000 * (2**256 - 1))):
        t = df.agg(*words.sum_limbs(F.col("w"), F.col(sign) if sign else None)).select(words.limbs_to_text(words.summed()).alias("t"))
        assert t.first().t == str(want)


def test_limbs_of_zeros_need_no_digits(spark):
    """Words with zero limbs anywhere, short ones and null give the limbs they gave; longs become the words they became."""
    data = [bytes(32), b"\1" + bytes(31), bytes(27) + b"\1" + bytes(4), bytes(28) + b"\xff" * 4, b"\xff" * 32, None]
    df = spark.createDataFrame([(i, w) for i, w in enumerate(data)], "i int, w binary")
    got = [r.x for r in df.orderBy("i").select(words.limbs(F.col("w")).alias("x")).collect()]
    assert got == [[None] * 8 if w is None else [int.from_bytes(w[28 - 4 * k : 32 - 4 * k], "big") for k in range(8)] for w in data]
    longs = [0, 1, 255, 2**32, 2**63 - 1, None]
    made = spark.createDataFrame([(k,) for k in longs], "k long").select("k", words.word_of_long(F.col("k")).alias("w"), words.address_of_long(F.col("k")).alias("a")).collect()
    assert all((r.w, r.a) == ((None, None) if r.k is None else (r.k.to_bytes(32, "big"), r.k.to_bytes(20, "big"))) for r in made)
    assert all("CASE WHEN" in c._jc.toString() for c in words.sum_limbs(F.col("w")))


def test_null_words_stay_null(spark):
    df = spark.createDataFrame([(None,)], "w binary")
    assert df.select(words.uint_to_text(F.col("w")), words.int_to_text(F.col("w")), words.to_long(F.col("w"))).first() == (None, None, None)


def test_signed_order(spark):
    values = [-5, 3, -(2**200), 0, 2**200, -1]
    got = frame(spark, values).orderBy(words.signed_order(F.col("w"))).select("i").collect()
    assert [values[r.i] for r in got] == sorted(values)


def test_golden_hashes():
    assert keccak256(b"").hex() == "c5d2460186f7233c927e7db2dcc703c0e500b653ca82273b7bfad8045d85a470"
    assert TRANSFER.topic.hex().startswith("ddf252ad") and APPROVAL.topic.hex().startswith("8c5be1e5")
    s = parse_signature("TransferBatch(address indexed operator, address indexed from, address indexed to, uint256[] ids, uint256[] values)")
    assert s.topic.hex().startswith("4a39dc06")
    assert keccak256(b"a" * 136) != keccak256(b"a" * 135) and len(keccak256(b"x" * 500)) == 32


def test_signatures():
    s = parse_signature("Thing(uint, int indexed x, bytes4[2] y)")
    assert s.canonical == "Thing(uint256,int256,bytes4[2])"
    assert [p.name for p in s.parameters] == ["arg0", "x", "y"]
    assert s.topic_column("x") == "topic1"
    assert parse_signature("Nothing()").canonical == "Nothing()"
    for bad in ("No", "F(uint7)", "F(bytes33)", "F(thing a)", "F(uint a, uint a)", "F(uint indexed a, uint indexed b, uint indexed c, uint indexed d)", "F(uint a b)", "F(uint a,)"):
        with pytest.raises(ValueError):
            parse_signature(bad)


@given(st.integers(-(2**255), 2**255 - 1))
def test_encode_integers_to_full_width(v):
    assert int.from_bytes(encode_word(Abi("int", 256), v), "big") == v % 2**256
    if v < 0:
        with pytest.raises(ValueError):
            encode_word(Abi("uint", 256), v)


def test_static_array_widens_the_head():
    assert parse_type("uint8[3]").head_bytes == 96
    assert parse_type("uint8[]").head_bytes == 32 and parse_type("string[2]").dynamic


def test_indexed_int_is_signed_and_bytes_n_is_cut(spark):
    s = parse_signature("E(int256 indexed a, bytes4 indexed b, bool c)")
    row = [(bytearray(s.topic), bytearray(encode_word(Abi("int", 256), -7)), bytearray(b"\xde\xad\xbe\xef" + bytes(28)), bytearray(31) + b"\x02")]
    logs = spark.createDataFrame(row, "selector binary, topic1 binary, topic2 binary, data binary")
    r = decode.decode_events(logs, s).first()
    assert (r.a, bytes(r.b), r.c) == ("-7", b"\xde\xad\xbe\xef", True)


def test_strings_in_arrays_and_short_data(spark):
    w = lambda k: k.to_bytes(32, "big")
    text = lambda t: w(len(t)) + t.ljust(32, b"\0")
    data = w(32) + w(2) + w(64) + w(128) + text(b"one") + text(b"two")
    df = spark.createDataFrame([(bytearray(data),), (bytearray(data[:-64]),), (bytearray(w(2**200)),), (bytearray(b""),)], "data binary")
    got = [r[0] for r in df.select(decode.decode_at(parse_type("string[]"), F.col("data"), 0)).collect()]
    assert got == [["one", "two"], ["one", None], None, None]


def test_topic_equality_reaches_the_scan(spark, sf, tmp_path):
    from ledgerloom.sources import fixtures, tables

    fixtures.logs(spark, sf).write.parquet(str(tmp_path / "logs"))
    hit = decode.where_parameter(tables.read_table(spark, str(tmp_path / "logs"), "logs"), TRANSFER, {"from": "0x" + "8".rjust(40, "0")})
    plan = hit._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(topic1" in plan and "EqualTo(selector" in plan
