"""256-bit integers as 32-byte big-endian words, in built-in functions.

A word is binary, and Spark orders binary as unsigned bytes, so unsigned words compare as they are. Sums go by eight
32-bit limbs: one `sum` for each (exact to 2^31 rows a group), and one carry pass over the summed row. Decimal text comes
from limbs without any long division: each group of eight digits is a sum of limbs times constants, plus a carry.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

LIMBS = 8
_BASE = 1 << 32
#: A group of eight digits: nine limbs times such a group stay below 2^63. Three groups at a time make a decimal, and the
#: widest number, a sum of 2^31 words, has four such.
_GROUP, GROUPS = 100_000_000, 4
SIGN = bytes([0x80]) + bytes(31)


def let(value: Column, body) -> Column:
    """body(value), with the value worked out once for each row however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def unsigned(b: Column) -> Column:
    """Up to 8 big-endian bytes as a long; raises under ANSI from 2^63."""
    return F.conv(F.hex(b), 16, 10).cast("long")


def _padded(k: Column, size: int) -> Column:
    """A long in so many big-endian bytes; only its own eight go by hex digits."""
    return F.concat(F.lit(bytes(size - 8)), F.unhex(F.lpad(F.hex(k), 16, "0")))


def word_of_long(k: Column) -> Column:
    """A non-negative long as a word."""
    return _padded(k, 32)


def address_of_long(k: Column) -> Column:
    return _padded(k, 20)


def is_negative(word: Column) -> Column:
    return F.substring(word, 1, 1) >= F.lit(bytes([0x80]))


def signed_order(word: Column) -> Column:
    """A word whose unsigned order is the signed order of the original: the first bit is turned over."""
    first = unsigned(F.substring(word, 1, 1))
    turned = F.unhex(F.lpad(F.hex(first.bitwiseXOR(F.lit(0x80))), 2, "0"))
    return F.concat(turned, F.substring(word, 2, 31))


def fits_long(word: Column) -> Column:
    return (F.substring(word, 1, 24) == F.lit(bytes(24))) & (F.substring(word, 25, 1) < F.lit(bytes([0x80])))


def to_long(word: Column) -> Column:
    """The unsigned value, or null from 2^63 on."""
    return F.when(fits_long(word), F.conv(F.hex(F.substring(word, 25, 8)), 16, 10).cast("long"))


def _carry(low_first: Column) -> Column:
    """struct<c: carry out of the top limb, out: limbs in 0 .. 2^32 - 1, low first>."""
    start = F.struct(F.lit(0).cast("long").alias("c"), F.array().cast("array<bigint>").alias("out"))

    def step(acc, x):
        t = x + acc["c"]
        return F.struct(F.shiftright(t, 32).alias("c"), F.concat(acc["out"], F.array(t.bitwiseAND(F.lit(_BASE - 1)))).alias("out"))

    return F.aggregate(low_first, start, step)


def limb(word: Column, k: int) -> Column:
    """The limb k (0 is the low one) as a long. Most are zero, and those are told without digits."""
    b = F.substring(word, 4 * (LIMBS - 1 - k) + 1, 4)
    return F.when(b == F.lit(bytes(4)), F.lit(0).cast("long")).otherwise(unsigned(b))


def limbs(word: Column) -> Column:
    """Eight longs, low limb first."""
    return F.array(*[limb(word, k) for k in range(LIMBS)])


def _listed(x: Column) -> list[Column]:
    return [F.get(x, F.lit(k)) for k in range(LIMBS)]


def _decimal(low_first: Column, take) -> Column:
    """Decimal text of the limbs, up to nine of at most 2^32, that `take` makes of a column: first the sums of limbs times
    constants that stand for eight digits each, then three of these as a decimal of up to 38 digits, and between those a
    carry. Each step is a flat expression over the last one's result, as lambdas in lambdas take long to plan."""
    wide = lambda x: x.cast("decimal(38,0)")

    def groups(x: Column) -> Column:
        low = take(x)
        factors = [[(1 << 32 * i) // _GROUP**j % _GROUP for i in range(len(low))] for j in range(3 * GROUPS)]
        return F.array(*[reduce(add, [q * F.lit(f).cast("long") for q, f in zip(low, fs, strict=True) if f] or [F.lit(0).cast("long")]) for fs in factors])

    def joined(x: Column) -> Column:
        return F.array(*[wide(reduce(add, [wide(F.get(x, F.lit(3 * k + i)).cast("decimal(19,0)") * F.lit(_GROUP**i).cast("decimal(17,0)")) for i in range(3)])) for k in range(GROUPS)])

    def text(x: Column) -> Column:
        whole, shown, part = F.lit(str(_GROUP**3)).cast("decimal(38,0)"), [], F.get(x, F.lit(0))
        for k in range(GROUPS):
            shown.append(F.lpad((part % whole).cast("string"), 24, "0"))
            part = F.get(x, F.lit(k + 1)) + F.call_function("div", part, whole).cast("decimal(20,0)")
        return F.coalesce(F.nullif(F.ltrim(F.concat(*reversed(shown)), F.lit("0")), F.lit("")), F.lit("0"))

    return let(let(let(low_first, groups), joined), text)


def _turned(low_first: list[Column], negative: Column) -> list[Column]:
    """Limbs of the magnitude of a two's complement number: those of a negative one are turned over, plus one."""
    return [F.when(negative, F.lit(_BASE - (i > 0)) - x).otherwise(x) for i, x in enumerate(low_first)]


def limbs_to_text(low_first: Column) -> Column:
    """Decimal text of summed limbs, which may be negative and unnormalised; null for null."""

    def seen(c: Column) -> Column:
        out = _listed(c["out"])
        # a total that fits 63 bits, as most do, needs no groups of digits
        small = (c["c"] == 0) & (reduce(add, out[2:]) == 0) & (out[1] < F.lit(1 << 31))
        return F.struct(c["out"].alias("out"), c["c"].alias("c"), F.when(small, (out[1] * F.lit(_BASE) + out[0]).cast("string")).alias("short"))

    def magnitude(s: Column) -> list[Column]:
        return [*_turned(_listed(s["out"]), s["c"] < 0), F.when(s["c"] < 0, -s["c"] - 1).otherwise(s["c"])]

    def show(s: Column) -> Column:
        return F.coalesce(s["short"], F.concat(F.when(s["c"] < 0, F.lit("-")).otherwise(F.lit("")), _decimal(s, magnitude)))

    return F.when(low_first.isNotNull(), let(let(_carry(low_first), seen), show))


def uint_to_text(word: Column) -> Column:
    """Decimal text of an unsigned word."""
    short = F.conv(F.hex(F.substring(word, 25, 8)), 16, 10)
    return F.when(fits_long(word), short).otherwise(F.when(word.isNotNull(), _decimal(limbs(word), _listed)))


def fits_signed_long(word: Column) -> Column:
    return fits_long(word) | ((F.substring(word, 1, 24) == F.lit(b"\xff" * 24)) & (F.substring(word, 25, 1) >= F.lit(bytes([0x80]))))


def to_signed_long(word: Column) -> Column:
    """The two's complement value, or null outside 64 bits."""
    return F.when(fits_signed_long(word), F.conv(F.hex(F.substring(word, 25, 8)), 16, -10).cast("long"))


def int_to_text(word: Column) -> Column:
    """Decimal text of a two's complement word."""
    sign = F.when(is_negative(word), F.lit("-")).otherwise(F.lit(""))
    long = _decimal(limbs(word), lambda x: _turned(_listed(x), F.get(x, F.lit(LIMBS - 1)) >= F.lit(1 << 31)))
    return F.when(fits_signed_long(word), F.conv(F.hex(F.substring(word, 25, 8)), 16, -10)).otherwise(F.when(word.isNotNull(), F.concat(sign, long)))


def within(word: Column, bits: int, signed: bool = False) -> Column:
    """Whether a word holds no more than an integer of so many bits: the bytes above are zero, or, of a negative one, 0xFF."""
    upper = 32 - bits // 8
    if upper == 0:
        return word.isNotNull()
    above = F.substring(word, 1, upper)
    if not signed:
        return above == F.lit(bytes(upper))
    high = F.substring(word, upper + 1, 1) >= F.lit(bytes([0x80]))
    return F.when(high, above == F.lit(b"\xff" * upper)).otherwise(above == F.lit(bytes(upper)))


def sum_limbs(word: Column, sign: Column | None = None) -> list[Column]:
    """The aggregate columns of a 256-bit sum, l0 (low) to l7; sign (1 or -1) multiplies each value."""
    each = [limb(word, k) for k in range(LIMBS)]
    return [F.sum(x if sign is None else x * sign).alias(f"l{k}") for k, x in enumerate(each)]


def limb_columns() -> list[str]:
    return [f"l{k}" for k in range(LIMBS)]


def summed() -> Column:
    """The limb array of the columns that sum_limbs made."""
    return F.array(*limb_columns())


def total_is_positive() -> Column:
    """Whether the sum in the limb columns is above zero."""
    return let(_carry(summed()), lambda c: (c["c"] > 0) | ((c["c"] == 0) & F.exists(c["out"], lambda x: x != 0)))
