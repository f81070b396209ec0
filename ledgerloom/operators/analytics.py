"""The analytic queries, as functions of the chain tables. Sums of token amounts are 256 bits wide; grouping goes by
the raw topic, and values are shown as text after the aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import words
from ledgerloom.functions.abi import APPROVAL, SWAP, TRANSFER, Signature
from ledgerloom.operators.decode import word_at

ZERO = bytes(32)


def of_event(logs: DataFrame, signature: Signature) -> DataFrame:
    return logs.where(F.col("selector") == F.lit(signature.topic))


def address_of(topic: str) -> Column:
    return F.substring(topic, 13, 20)


def _total(df: DataFrame, keys: list[str], sign: Column | None = None, value: str = "data") -> DataFrame:
    return df.groupBy(*keys).agg(*words.sum_limbs(F.substring(value, 1, 32), sign))


def balances(logs: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """Limb sums per (token, holder topic) and the columns in `extra`: what came in less what went out, from one pass
    over the transfers."""
    sides = F.array(F.struct(F.col("topic2").alias("holder"), F.lit(1).alias("sign")), F.struct(F.col("topic1").alias("holder"), F.lit(-1).alias("sign")))
    moves = of_event(logs, TRANSFER).select("address", "data", *extra, F.explode(sides).alias("m")).select("address", "data", *extra, "m.*")
    return _total(moves, ["address", "holder", *extra], F.col("sign"))


def token_holders(logs: DataFrame) -> DataFrame:
    """(token, holder, balance) with a balance above zero."""
    return balances(logs).where(words.total_is_positive()).select(F.col("address").alias("token"), address_of("holder").alias("holder"), words.limbs_to_text(words.summed()).alias("balance"))


def token_inflow(logs: DataFrame, token: Column) -> DataFrame:
    """(holder, received) of one token."""
    t = _total(of_event(logs, TRANSFER).where(F.col("address") == token), ["topic2"])
    return t.select(address_of("topic2").alias("holder"), words.limbs_to_text(words.summed()).alias("received"))


def token_supply(logs: DataFrame) -> DataFrame:
    """(token, supply): mints from the zero address less burns to it."""
    zero = F.lit(ZERO)
    sign = F.when(F.col("topic1") == zero, 1).otherwise(0) - F.when(F.col("topic2") == zero, 1).otherwise(0)
    t = _total(of_event(logs, TRANSFER).where((F.col("topic1") == zero) | (F.col("topic2") == zero)), ["address"], sign)
    return t.select(F.col("address").alias("token"), words.limbs_to_text(words.summed()).alias("supply"))


def transfer_counts(logs: DataFrame) -> DataFrame:
    """(address, sent, received)."""
    sides = F.array(F.struct(F.col("topic1").alias("who"), F.lit(1).alias("s"), F.lit(0).alias("r")), F.struct(F.col("topic2").alias("who"), F.lit(0).alias("s"), F.lit(1).alias("r")))
    c = of_event(logs, TRANSFER).select(F.explode(sides).alias("m")).groupBy("m.who").agg(F.sum("m.s").alias("sent"), F.sum("m.r").alias("received"))
    return c.select(address_of("who").alias("address"), "sent", "received")


def swap_volume(logs: DataFrame, unit: str = "hour") -> DataFrame:
    """(pair, hour, swaps, volume0, volume1): amounts in and out of each side."""
    s = of_event(logs, SWAP).withColumn("hour", F.date_trunc(unit, "block_timestamp"))
    sums = []
    for side, (i, o) in enumerate(((0, 64), (32, 96))):
        a, b = words.limbs(word_at(F.col("data"), i)), words.limbs(word_at(F.col("data"), o))
        sums += [F.sum(F.element_at(a, k + 1) + F.element_at(b, k + 1)).alias(f"v{side}_{k}") for k in range(words.LIMBS)]
    t = s.groupBy("address", "hour").agg(F.count("*").alias("swaps"), *sums)
    text = [words.limbs_to_text(F.array(*[f"v{side}_{k}" for k in range(words.LIMBS)])).alias(f"volume{side}") for side in (0, 1)]
    return t.select(F.col("address").alias("pair"), "hour", "swaps", *text)


def latest_allowance(logs: DataFrame) -> DataFrame:
    """(token, owner, spender, allowance): the last approval by block and log."""
    a = of_event(logs, APPROVAL).groupBy("address", "topic1", "topic2").agg(F.max_by("data", F.struct("block_num", "log_idx")).alias("data"))
    return a.select(F.col("address").alias("token"), address_of("topic1").alias("owner"), address_of("topic2").alias("spender"), words.uint_to_text(F.substring("data", 1, 32)).alias("allowance"))


def daily_stats(logs: DataFrame) -> DataFrame:
    """(day, transfers, senders, receivers, volume)."""
    t = of_event(logs, TRANSFER).withColumn("day", F.to_date("block_timestamp"))
    d = t.groupBy("day").agg(F.count("*").alias("transfers"), F.count_distinct("topic1").alias("senders"), F.count_distinct("topic2").alias("receivers"))
    v = _total(t, ["day"]).select(F.col("day").alias("__day"), words.limbs_to_text(words.summed()).alias("volume"))
    return d.join(v, F.col("day") == F.col("__day")).drop("__day")


def daily_partials(logs: DataFrame) -> DataFrame:
    """The state of daily_totals, which adds up: per (day, sent, who) the number n of transfers that an address sent or
    received, and per day eight rows without a side, whose `who` is the number of a limb and n its sum. Each address is one row
    of a day and side however many batches and writers meet it, so distinct counts stay exact without a dictionary of
    addresses, which only one writer at a time could extend. There are nearly as many such rows as transfers, so sums are none
    of their columns."""
    t = of_event(logs, TRANSFER).select(F.to_date("block_timestamp").alias("day"), "topic1", "topic2", "data")
    sides = F.array(F.struct(F.lit(True).alias("sent"), F.col("topic1").alias("who")), F.struct(F.lit(False).alias("sent"), F.col("topic2").alias("who")))
    ends = t.select("day", F.explode(sides).alias("m")).groupBy("day", "m.sent", "m.who").agg(F.count("*").alias("n"))
    sums = F.array(*[F.struct(F.lit(None).cast("boolean").alias("sent"), F.lit(bytes([k])).alias("who"), F.col(c).alias("n")) for k, c in enumerate(words.limb_columns())])
    return ends.unionByName(_total(t, ["day"]).select("day", F.explode(sums).alias("m")).select("day", "m.*"))


def daily_totals(state: DataFrame) -> DataFrame:
    """daily_stats from merged daily_partials: first a row per day and side or limb, so that the many rows of addresses meet two
    sums only. A missing topic is no sender or receiver, as in daily_stats."""
    sent, limb = F.col("sent"), F.col("limb")
    per = state.groupBy("day", "sent", F.when(sent.isNull(), F.col("who")).alias("limb")).agg(F.sum("n").alias("n"), F.count("who").alias("whos"))
    of = lambda side, c: F.sum(F.when(side, F.col(c)).otherwise(0))
    sums = [F.sum(F.when(limb == F.lit(bytes([k])), F.col("n"))).alias(c) for k, c in enumerate(words.limb_columns())]
    days = per.groupBy("day").agg(of(sent, "n").alias("transfers"), of(sent, "whos").alias("senders"), of(~sent, "whos").alias("receivers"), *sums)
    return days.select("day", "transfers", "senders", "receivers", words.limbs_to_text(words.summed()).alias("volume"))


def whale_transfers(logs: DataFrame, threshold: int) -> DataFrame:
    """Transfers of at least the threshold, largest first: words compare as they are."""
    t = of_event(logs, TRANSFER).where(F.substring("data", 1, 32) >= F.lit(threshold.to_bytes(32, "big")))
    return t.select("block_num", "log_idx", F.col("address").alias("token"), address_of("topic1").alias("sender"), address_of("topic2").alias("receiver"), "data").orderBy(F.desc("data"), "block_num", "log_idx").select("block_num", "log_idx", "token", "sender", "receiver", words.uint_to_text(F.substring("data", 1, 32)).alias("amount"))


def top_recipients(logs: DataFrame, k: int) -> DataFrame:
    c = of_event(logs, TRANSFER).groupBy("topic2").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "topic2").limit(k)
    return c.select(address_of("topic2").alias("recipient"), "n")


def block_by_num(blocks: DataFrame, num: int) -> DataFrame:
    return blocks.where(F.col("num") == num)


def block_by_hash(blocks: DataFrame, block_hash: bytes) -> DataFrame:
    """The latest block of that hash."""
    return blocks.where(F.col("hash") == F.lit(block_hash)).orderBy(F.desc("timestamp"), F.desc("num")).limit(1)


def txs_by_block(txs: DataFrame, num: int) -> DataFrame:
    return txs.where(F.col("block_num") == num)


def tx_by_hash(txs: DataFrame, tx_hash: bytes) -> DataFrame:
    return txs.where(F.col("hash") == F.lit(tx_hash))


def recent_blocks(blocks: DataFrame, k: int) -> DataFrame:
    return blocks.orderBy(F.desc("num")).limit(k)


def logs_by_selector(logs: DataFrame, selector: bytes, k: int = 100) -> DataFrame:
    return logs.where(F.col("selector") == F.lit(selector)).orderBy("block_num", "log_idx").limit(k)


def table_counts(blocks: DataFrame, txs: DataFrame) -> DataFrame:
    """(table_name, n)."""
    one = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n")
    return one(blocks, "blocks").unionByName(one(txs, "txs"))


def txs_by_type(txs: DataFrame) -> DataFrame:
    return txs.groupBy("type").agg(F.count("*").alias("n"))


def gas_stats_recent(blocks: DataFrame, last: int = 1000) -> DataFrame:
    """Gas of the last blocks by number; the average in whole units, rounded down."""
    top = blocks.agg(F.max("num").alias("top"))
    near = blocks.join(F.broadcast(top)).where(F.col("num") > F.col("top") - last)  # one row
    g = near.agg(F.count("*").alias("n"), F.sum("gas_used").alias("total"), F.max("gas_used").alias("most"), F.min("gas_used").alias("least"))
    return g.select("n", "total", "most", "least", F.floor(F.col("total").cast("decimal(38,0)") / F.col("n")).cast("long").alias("average"))


def top_senders(txs: DataFrame, k: int) -> DataFrame:
    return txs.groupBy("from").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "from").limit(k)


def unique_senders(txs: DataFrame, approximate: bool = False) -> DataFrame:
    count = F.approx_count_distinct if approximate else F.count_distinct
    return txs.agg(count("from").alias("senders"))


def top_events(logs: DataFrame, k: int) -> DataFrame:
    return logs.where("selector is not null").groupBy("selector").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "selector").limit(k)


def blocks_same_gas(blocks: DataFrame, num: int) -> DataFrame:
    """Blocks whose gas_used is that of a given block, which may occur more than once."""
    gas = blocks.where(F.col("num") == num).select(F.col("gas_used").alias("__g")).distinct()
    return blocks.join(gas, F.col("gas_used") == F.col("__g"), "left_semi")


def data_profile(txs: DataFrame, logs: DataFrame) -> DataFrame:
    """One row: transactions, multicalls, distinct ends, blocks, logs, averages times 1000 as whole numbers, span."""
    t = txs.agg(F.count("*").alias("n_txs"), F.count_if(F.col("call_count") > 1).alias("multicalls"), F.count_distinct("from").alias("senders"), F.count_distinct("to").alias("receivers"), F.count_distinct("block_num").alias("n_blocks"), F.min("block_timestamp").alias("first_at"), F.max("block_timestamp").alias("last_at"))
    n = logs.agg(F.count("*").alias("n_logs"))
    both = t.join(F.broadcast(n))  # one row each
    milli = lambda a, b: F.floor(F.try_divide(F.col(a) * 1000, F.col(b)))
    return both.select("*", milli("n_txs", "n_blocks").alias("milli_txs_per_block"), milli("n_logs", "n_txs").alias("milli_logs_per_tx"))


def receipt_mismatch(txs: DataFrame, receipts: DataFrame) -> DataFrame:
    """One row: pairs of (block, index), those whose hashes differ, and receipts by status."""
    r = receipts.select(F.col("block_num").alias("__b"), "tx_idx", "tx_hash", "status")
    both = txs.join(r, (F.col("block_num") == F.col("__b")) & (F.col("idx") == F.col("tx_idx")))
    return both.agg(F.count("*").alias("pairs"), F.count_if(F.col("hash") != F.col("tx_hash")).alias("mismatches"), F.count_if(F.col("status") == 1).alias("succeeded"), F.count_if(F.col("status") == 0).alias("failed"))


def blocks_by_miner(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("miner").agg(F.count("*").alias("n"))
