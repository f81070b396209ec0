"""Event logs decoded on read: a signature becomes a filter and Column expressions inside the scan."""

from __future__ import annotations

import re
from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import words
from ledgerloom.functions.abi import Abi, Parameter, Signature, encode_word, parse_signature

LOG_COLUMNS = ("block_num", "block_timestamp", "log_idx", "tx_idx", "tx_hash", "address")


def as_signature(signature: str | Signature) -> Signature:
    return parse_signature(signature) if isinstance(signature, str) else signature


def word_at(data: Column, offset: Column | int) -> Column:
    """The 32-byte word at a byte offset, null if the data ends before it does."""
    at = F.lit(offset).cast("int") if isinstance(offset, int) else offset.cast("int")
    return F.when(F.octet_length(data) >= at + 32, F.substring(data, at + 1, F.lit(32)))


def abi_uint(word: Column, bits: int = 256) -> Column:
    """bigint up to 56 bits, decimal(38,0) up to 120, above that decimal text. Null where the word is wider than its type,
    as whoever writes a log may write any bytes."""
    if bits <= 56:
        return F.when(words.within(word, bits), words.to_long(word))
    text = F.when(words.within(word, bits), words.uint_to_text(word))
    return text.try_cast("decimal(38,0)") if bits <= 120 else text


def abi_int(word: Column, bits: int = 256) -> Column:
    """As abi_uint, in two's complement."""
    if bits <= 56:
        return F.when(words.within(word, bits, signed=True), words.to_signed_long(word))
    text = F.when(words.within(word, bits, signed=True), words.int_to_text(word))
    return text.try_cast("decimal(38,0)") if bits <= 120 else text


def abi_address(word: Column) -> Column:
    return F.substring(word, 13, 20)


def abi_bool(word: Column) -> Column:
    return F.substring(word, 32, 1) != F.lit(b"\0")


def abi_fixed(word: Column, n: int) -> Column:
    return F.substring(word, 1, n)


def pointed(data: Column, head: Column | int, base: Column | int) -> Column:
    """The place, as an int, that the word at `head` points to, from `base`, if a word can stand there; else null. The
    pointer is bounded before anything is added to it, so none is too large."""
    base = F.lit(base) if isinstance(base, int) else base
    pointer = words.to_long(word_at(data, head))
    return (F.when(pointer <= F.octet_length(data) - 32 - base, pointer) + base).cast("int")


def abi_bytes(data: Column, head: Column | int, base: Column | int = 0) -> Column:
    """The payload that the word at `head` points to, from `base`; null where it would end outside the data."""
    at = pointed(data, head, base)
    size = words.to_long(word_at(data, at))
    return F.substring(data, at + 33, F.when(size <= F.octet_length(data) - at - 32, size).cast("int"))


def abi_string(data: Column, head: Column | int, base: Column | int = 0) -> Column:
    """UTF-8 of abi_bytes, null if it isn't UTF-8."""
    return F.try_validate_utf8(abi_bytes(data, head, base).cast("string"))


def decode_word(kind: Abi, word: Column) -> Column:
    if kind.kind in ("uint", "int"):  # the word, a cut at a computed place, is used several times
        return words.let(word, lambda w: (abi_uint if kind.kind == "uint" else abi_int)(w, kind.size))
    match kind.kind:
        case "address":
            return abi_address(word)
        case "bool":
            return abi_bool(word)
        case "fixed":
            return abi_fixed(word, kind.size)
    raise ValueError(f"{kind.name} doesn't fit a word")


def decode_at(kind: Abi, data: Column, head: Column | int, base: Column | int = 0) -> Column:
    """The value whose head is at `head`; pointers count from `base`. Null where the data is too short."""
    if kind.kind == "bytes":
        return abi_bytes(data, head, base)
    if kind.kind == "string":
        return abi_string(data, head, base)
    if kind.kind != "array":
        return decode_word(kind, word_at(data, head))
    if kind.dynamic:  # the place and the number of items are worked out once for each row
        found = pointed(data, head, base)
        if kind.size is None:
            found = words.let(found, lambda at: F.struct((at + 32).alias("start"), words.to_long(word_at(data, at)).alias("n")))
        else:
            found = F.struct(found.alias("start"), F.lit(kind.size).cast("long").alias("n"))
        return words.let(found, lambda x: _items(kind, data, x["start"], x["n"]))
    return _items(kind, data, F.lit(head) if isinstance(head, int) else head, F.lit(kind.size).cast("long"))


def _items(kind: Abi, data: Column, start: Column, n: Column) -> Column:
    """The items of an array whose heads begin at `start`; null where the data can't hold n of them."""
    step = 32 if kind.item.dynamic else kind.item.head_bytes
    # items without a width, like those of uint8[0][], count as a word each, or a short log could ask for any number
    n = F.when(n <= F.floor((F.octet_length(data) - start) / F.lit(step or 32)), n)
    numbers = F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)).when(n == 0, F.array().cast("array<bigint>"))
    return F.transform(numbers, lambda i: decode_at(kind.item, data, start + i * step, start))


def parameter_columns(signature: Signature, data: Column | None = None, first: int = 0) -> dict[str, Column]:
    """Name -> value of each parameter. Indexed ones come from their topics (dynamic ones are hashed there: the raw
    word), the others from the data, whose head takes as many bytes as each type needs."""
    data = F.col("data") if data is None else data
    out, offset = {}, first
    for p in signature.parameters:
        if p.indexed:
            topic = F.col(signature.topic_column(p.name))
            out[p.name] = topic if p.type.dynamic or p.type.kind == "array" else decode_word(p.type, topic)
        else:
            out[p.name] = decode_at(p.type, data, offset, first)
            offset += p.type.head_bytes
    return out


def decode_events(logs: DataFrame, signature: str | Signature, columns: list[str] | None = None) -> DataFrame:
    """The logs of an event: the log's own columns and one per parameter (those in `columns`, if given). A parameter
    named like a column of the log takes its place."""
    s = as_signature(signature)
    found = logs.where(F.col("selector") == F.lit(s.topic))
    named = {k: v for k, v in parameter_columns(s).items() if columns is None or k in columns}
    own = [c for c in logs.columns if c in LOG_COLUMNS and c not in named]
    return found.select(*own, *[v.alias(k) for k, v in named.items()])


def where_parameter(logs: DataFrame, signature: str | Signature, values: dict[str, object]) -> DataFrame:
    """Logs of the event whose indexed parameters have the given values, as equalities on the topics, which reach the
    scan. A value of a parameter that isn't indexed, or is dynamic, is compared after decoding."""
    s = as_signature(signature)

    def test(name: str, value) -> Column:
        p: Parameter = s.parameter(name)
        if p.indexed and not p.type.dynamic and p.type.kind != "array":
            return F.col(s.topic_column(name)) == F.lit(encode_word(p.type, value))
        decoded = parameter_columns(s)[name]
        if p.type.kind in ("uint", "int"):
            return decoded.cast("string") == str(value)
        return decoded == F.lit(bytes.fromhex(value[2:]) if isinstance(value, str) and p.type.kind in ("address", "fixed", "bytes") else value)

    return logs.where(F.col("selector") == F.lit(s.topic)).where(reduce(lambda a, b: a & b, [test(k, v) for k, v in values.items()], F.lit(True)))


def decode_many(logs: DataFrame, signatures: list[str | Signature]) -> dict[str, DataFrame]:
    """One relation per signature over the same logs, by event name; events that share a name go by name and types, like
    `E(uint256)`. Signatures that differ in names or `indexed` only are one event, of which the last is taken."""
    by_topic = {s.canonical: s for s in map(as_signature, signatures)}
    names = Counter(s.name for s in by_topic.values())
    return {s.name if names[s.name] == 1 else text: decode_events(logs, s) for text, s in by_topic.items()}


def register_events(logs: DataFrame, signatures: list[str | Signature]) -> list[str]:
    """Makes each event a temporary view under its name in `decode_many`, so that SQL can select from and join events like
    tables (overloaded ones as `E(uint256)`, in backticks); the logs themselves are the view `logs`. Returns the names."""
    found = {"logs": logs, **decode_many(logs, signatures)}
    for name, df in found.items():
        df.createOrReplaceTempView(f"`{name}`")
    return list(found)


def decode_union(logs: DataFrame, signatures: list[str | Signature]) -> DataFrame:
    """All events of the signatures with an `event` column (the name in `decode_many`); parameters that an event lacks are
    null. A parameter whose type isn't the same in all events is one column a type, like `b_string` and `b_binary`."""
    found = decode_many(logs, signatures)
    types: dict[str, set[str]] = {}
    for df in found.values():
        for c, kind in df.dtypes:
            types.setdefault(c, set()).add(kind)

    def apart(df: DataFrame) -> DataFrame:
        return df.select(*[F.col(f"`{c}`").alias(c if len(types[c]) == 1 else f"{c}_{re.sub('[^a-z0-9]+', '_', kind).strip('_')}") for c, kind in df.dtypes])

    parts = [apart(df).withColumn("event", F.lit(name)) for name, df in found.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def decode_calldata(txs: DataFrame, signature: str | Signature) -> DataFrame:
    """Transactions that call a function: key columns and one per argument."""
    s = as_signature(signature)
    found = txs.where(F.substring("input", 1, 4) == F.lit(s.selector))
    named = parameter_columns(Signature(s.name, tuple(Parameter(p.name, p.type, False) for p in s.parameters)), F.col("input"), 4)
    own = [c for c in ("block_num", "idx", "hash") if c not in named]
    return found.select(*own, *[v.alias(k) for k, v in named.items()])
