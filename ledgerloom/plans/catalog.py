"""All chain queries over the given tables, with the SQL that states each answer directly on the source columns."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import words
from ledgerloom.functions.abi import APPROVAL, SWAP, TRANSFER, parse_signature
from ledgerloom.operators import analytics, decode, forward, integrity, maintain
from ledgerloom.plans import views
from ledgerloom.schema import SYNC_STATE, TABLES, extended
from ledgerloom.sources import export, fixtures, tables
from ledgerloom.sources.scratch import scratch_path
from ledgerloom.streaming import live, reorg

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str, stamps: tuple[str, ...] = ()):
    """Registers a query under its function's name. The columns in `stamps` are compared as text, as the two engines
    return timestamps of different kinds."""

    def register(fn):
        def shown(spark: SparkSession, sf: str) -> DataFrame:
            return fn(spark, sf).withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS") for c in stamps})

        replaced = ", ".join(f"strftime({c}, '%Y-%m-%d %H:%M:%S.%f') AS {c}" for c in stamps)
        QUERIES[fn.__name__] = shown if stamps else fn
        ORACLE_SQL[fn.__name__] = f"SELECT * REPLACE ({replaced}) FROM ({sql})" if stamps else sql
        return fn

    return register


def a(k: str) -> str:
    """SQL: k shown as an address."""
    return f"'0x' || lpad(lower(to_hex(CAST({k} AS BIGINT))), 40, '0')"


def w(k: str) -> str:
    """SQL: k shown as a word."""
    return f"'0x' || lpad(lower(to_hex(CAST({k} AS BIGINT))), 64, '0')"


def cents(x: str) -> str:
    return f"CAST(round({x} * 100) AS BIGINT)"


def hexlit(b: bytes) -> str:
    return f"'0x{b.hex()}'"


TYPE = "CAST(list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type) - 1 AS SMALLINT)"
RECEIVER = "(user_id * 7 + event_id) % 151"
BLOCK, IDX = "event_id // 100", "CAST(event_id % 100 AS INTEGER)"
VALUE = cents("value")
TS = "CAST(ts AS TIMESTAMP)"
TOKEN6 = "list_position(['A', 'N', 'R'], l_returnflag)"
PRICE = cents("l_extendedprice")


# ---- sources and normalisation


@query(f"SELECT {BLOCK} AS block_num, {IDX} AS tx_idx, {w('event_id')} AS tx_hash, CAST(21000 + user_id AS BIGINT) AS gas_used, CAST(CASE WHEN event_id % 10 <> 0 THEN 1 ELSE 0 END AS SMALLINT) AS status FROM events WHERE event_id % 7 <> 0")
def read_table(spark, sf):
    """A4 written by chain, read back as one of them with its schema enforced."""
    path = scratch_path(spark, "receipts")
    r = fixtures.receipts(spark, sf)
    r.withColumn("chain_id", F.explode(F.array(F.lit(1), F.lit(2)))).write.partitionBy("chain_id").parquet(path)
    return tables.hex_view(tables.read_table(spark, path, "receipts", 2).select("block_num", "tx_idx", "tx_hash", "gas_used", "status"))


@query(f"SELECT b AS num, {w('b + 1')} AS hash, {w('b')} AS parent_hash, date_trunc('second', t) AS timestamp, CAST(epoch(date_trunc('second', t)) * 1000 AS BIGINT) AS timestamp_ms, CAST(1000000000 AS BIGINT) AS gas_limit, b * 10 AS gas_used, {a('b % 7')} AS miner FROM (SELECT {BLOCK} AS b, min({TS}) AS t FROM events GROUP BY 1)", stamps=("timestamp",))
def normalize_blocks(spark, sf):
    return tables.hex_view(tables.normalize_blocks(fixtures.block_payloads(spark, sf)).drop("extra_data", "consensus_proposer"))


@query(f"""SELECT e.event_id // 100 AS block_num, {IDX} AS idx, {w('event_id')} AS hash, {TYPE} AS type, {a('user_id')} AS "from", {a(RECEIVER)} AS "to", CAST({VALUE} AS VARCHAR) AS value, event_id AS nonce, '0' AS max_priority_fee_per_gas, '7' AS max_fee_per_gas,
        '0x' || repeat('0', 64) AS nonce_key, CAST(1 AS SMALLINT) AS call_count, CAST(0 AS SMALLINT) AS signature_type, CAST(NULL AS BIGINT) AS gas_used FROM events e""")
def normalize_txs(spark, sf):
    t = tables.normalize_txs(fixtures.block_payloads(spark, sf))
    return tables.hex_view(t.select("block_num", "idx", "hash", "type", "from", "to", "value", "nonce", "max_priority_fee_per_gas", "max_fee_per_gas", "nonce_key", "call_count", "signature_type", "gas_used"))


@query(f"""SELECT {BLOCK} AS block_num, b.t AS block_timestamp, {IDX} AS tx_idx, {w('event_id')} AS tx_hash, {a('user_id')} AS "from", {a(RECEIVER)} AS "to", 21000 + user_id AS gas_used, 21000 + user_id AS cumulative_gas_used, '7' AS effective_gas_price,
        CAST(CASE WHEN event_id % 10 <> 0 THEN 1 ELSE 0 END AS SMALLINT) AS status, {a('user_id')} AS fee_payer
        FROM events JOIN (SELECT event_id // 100 AS b, date_trunc('second', min({TS})) AS t FROM events GROUP BY 1) b ON b.b = event_id // 100 WHERE event_id % 7 <> 0 AND b.b % 2 = 0""", stamps=("block_timestamp",))
def normalize_receipts(spark, sf):
    """Only even blocks are known: receipts of the others are dropped."""
    blocks = tables.normalize_blocks(fixtures.block_payloads(spark, sf)).where("num % 2 = 0")
    return tables.hex_view(tables.normalize_receipts(fixtures.receipt_payloads(spark, sf), blocks).drop("contract_address"))


@query(f"""SELECT {BLOCK} AS block_num, {IDX} AS log_idx, {IDX} AS tx_idx, {w('event_id')} AS tx_hash, {a('1 + ' + TYPE)} AS address, {hexlit(TRANSFER.topic)} AS selector, {hexlit(TRANSFER.topic)} AS topic0, {w('user_id')} AS topic1, {w(RECEIVER)} AS topic2,
        CAST(NULL AS VARCHAR) AS topic3, {w(VALUE)} AS data FROM events WHERE event_id % 7 <> 0""")
def normalize_logs(spark, sf):
    blocks = tables.normalize_blocks(fixtures.block_payloads(spark, sf))
    return tables.hex_view(tables.normalize_logs(fixtures.receipt_payloads(spark, sf), blocks).drop("block_timestamp", "is_virtual_forward"))


ENRICHED = f"CASE WHEN event_id % 7 <> 0 THEN 21000 + user_id WHEN event_id % 3 <> 0 THEN 20000 + user_id END AS gas_used, CASE WHEN event_id % 7 <> 0 THEN {a('user_id')} END AS fee_payer"


@query(f"SELECT {BLOCK} AS block_num, {IDX} AS idx, {ENRICHED} FROM events")
def enrich_txs(spark, sf):
    return tables.hex_view(tables.enrich_txs(fixtures.txs(spark, sf), fixtures.receipts(spark, sf)).select("block_num", "idx", "gas_used", "fee_payer"))


def _colocated(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Transactions and receipts as tables bucketed alike"""
    found = []
    for name, df in (("txs", fixtures.txs(spark, sf)), ("receipts", fixtures.receipts(spark, sf))):
        path = scratch_path(spark, name)
        table = "t" + path.rsplit("-", 1)[1]
        maintain.save_colocated(df, table, name, path, 8)
        found.append(spark.table(table))
    return tuple(found)


@query(f"SELECT {BLOCK} AS block_num, {IDX} AS idx, {ENRICHED} FROM events")
def enrich_colocated(spark, sf):
    """The same rows from bucketed tables, joined without a shuffle."""
    txs, receipts = _colocated(spark, sf)
    return tables.hex_view(tables.enrich_txs(txs, receipts).select("block_num", "idx", "gas_used", "fee_payer"))


@query(f"""SELECT {BLOCK} AS block_num, {IDX} AS idx, CASE WHEN event_id % 3 <> 0 THEN 20000 + user_id WHEN event_id % 7 <> 0 AND {BLOCK} BETWEEN 2 AND 50 THEN 21000 + user_id END AS gas_used,
        CASE WHEN event_id % 3 = 0 AND event_id % 7 <> 0 AND {BLOCK} BETWEEN 2 AND 50 THEN {a('user_id')} END AS fee_payer FROM events""")
def repair_txs(spark, sf):
    """On disk: the buckets of these blocks are written again."""
    path, work = scratch_path(spark, "txs"), scratch_path(spark, "work")
    maintain.save_buckets(maintain.conform(fixtures.txs(spark, sf), TABLES["txs"]), path, "block_num", 100)
    maintain.store_repair(spark, path, fixtures.receipts(spark, sf), 2, 50, work, 100)
    return tables.hex_view(maintain.stored(spark, path, TABLES["txs"]).select("block_num", "idx", "gas_used", "fee_payer"))


@query(f"SELECT {BLOCK} AS block_num, {IDX} AS log_idx, {a('1 + ' + TYPE)} AS address, CASE WHEN event_id % 2 = 0 THEN {hexlit(TRANSFER.topic)} ELSE '' END AS selector, {w('user_id')} AS topic1, CAST(NULL AS VARCHAR) AS topic3, {w(VALUE)} AS data FROM events")
def hex_view(spark, sf):
    logs = fixtures.logs(spark, sf).withColumn("selector", F.when((F.col("block_num") * 100 + F.col("log_idx")) % 2 == 0, F.col("selector")))
    return tables.hex_view(logs.select("block_num", "log_idx", "address", "selector", "topic1", "topic3", "data"))


@query(f"SELECT {BLOCK} AS block_num, {IDX} AS log_idx, {a('1 + ' + TYPE)} AS address FROM events WHERE event_type = 'error'")
def filter_hex(spark, sf):
    return tables.hex_view(fixtures.logs(spark, sf).where(F.col("address") == tables.hex_lit("0x" + "2".rjust(40, "0"))).select("block_num", "log_idx", "address"))


# ---- table maintenance


@query(f"""SELECT {BLOCK} AS block_num, {IDX} AS idx, CAST({VALUE} + CASE WHEN {BLOCK} IN (3, 5) THEN 1 ELSE 0 END AS VARCHAR) AS value FROM events WHERE {BLOCK} <> 7""")
def replace_blocks(spark, sf):
    """On disk: blocks 3 and 5 come again with other values, 7 comes again empty; 4 and 6 stay."""
    path, work = scratch_path(spark, "txs"), scratch_path(spark, "work")
    t = fixtures.txs(spark, sf).select("block_num", "idx", "value")
    maintain.store_replace(spark, path, t, "block_num", work, size=100)
    batch = t.where("block_num in (3, 5)").withColumn("value", (F.col("value").cast("long") + 1).cast("string"))
    maintain.store_replace(spark, path, batch, "block_num", work, spark.createDataFrame([(3,), (5,), (7,)], "block_num long"), 100)
    return maintain.stored(spark, path, t.schema).select(*t.columns)


@query("SELECT o_orderkey AS num, CAST(o_orderdate AS TIMESTAMP) AS timestamp, CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 2 END AS origin FROM orders", stamps=("timestamp",))
def insert_ignore(spark, sf):
    b = fixtures.blocks(spark, sf).select("num", "timestamp")
    had = b.where("num % 2 = 0").withColumn("origin", F.lit(1))
    batch = b.withColumn("origin", F.lit(2))
    return maintain.insert_ignore(had, batch.unionByName(batch.withColumn("origin", F.lit(3))), ["num", "timestamp"], F.col("origin"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_shipdate AS TIMESTAMP) AS l_shipdate, l_extendedprice FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) = 1", stamps=("l_shipdate",))
def dedup_latest(spark, sf):
    li = fixtures.read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_shipdate").cast("timestamp").alias("l_shipdate"), "l_extendedprice")
    return maintain.dedup_latest(li, ["l_orderkey", "l_linenumber"], F.struct("l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice"))


def _four(spark, sf) -> dict[str, DataFrame]:
    b = fixtures.txs(spark, sf).groupBy(F.col("block_num").alias("num")).agg(F.min("block_timestamp").alias("timestamp")).withColumn("hash", words.word_of_long(F.col("num") + 1))
    found = {"blocks": b, "txs": fixtures.txs(spark, sf), "logs": fixtures.logs(spark, sf), "receipts": fixtures.receipts(spark, sf)}
    return {name: maintain.conform(df, TABLES[name]) for name, df in found.items()}


def _marks(found: dict[str, DataFrame]) -> DataFrame:
    return integrity.watermarks(found)


def _marks_sql(where: str = "true") -> str:
    one = lambda name, cond: f"SELECT '{name}' AS table_name, max({BLOCK}) AS max_block, count(*) AS n_rows FROM events WHERE {where} AND {cond}"
    return f"SELECT 'blocks' AS table_name, max({BLOCK}) AS max_block, count(DISTINCT {BLOCK}) AS n_rows FROM events WHERE {where} UNION ALL {one('txs', 'true')} UNION ALL {one('logs', 'true')} UNION ALL {one('receipts', 'event_id % 7 <> 0')}"


@query(_marks_sql(f"{BLOCK} % 2 = 0"))
def write_batch(spark, sf):
    """Even blocks are written; the job that writes odd ones breaks off in its last table, so none of its tables is seen."""
    root, found = scratch_path(spark, "batches"), _four(spark, sf)
    part = lambda k: {name: df.where(F.col(maintain.BLOCK_COLUMN[name]) % 2 == k) for name, df in found.items()}
    maintain.write_batch(root, "even", part(0))
    odd = part(1)
    odd["receipts"] = odd["receipts"].withColumn("status", F.when(F.col("tx_idx") >= 0, F.raise_error(F.lit("broken off")).cast("short")))
    try:
        maintain.write_batch(root, "odd", odd)
    except PySparkException as e:
        if "broken off" not in str(e):
            raise
    return _marks({name: maintain.read_committed(spark, root, name) for name in found})


@query(_marks_sql(f"{BLOCK} < 6") + f" UNION ALL SELECT 'removed', CAST(NULL AS BIGINT), count(DISTINCT {BLOCK}) FROM events WHERE {BLOCK} >= 6")
def rollback_from(spark, sf):
    """On disk: the bucket of block 6 is written again, later ones go; all four tables at once."""
    root, work = scratch_path(spark, "chain"), scratch_path(spark, "work")

    def take_back(name: str, df: DataFrame) -> int:
        path, block = f"{root}/{name}", maintain.BLOCK_COLUMN[name]
        maintain.save_buckets(df, path, block, 100)
        return maintain.store_rollback(spark, path, TABLES[name], block, 6, work, 100)

    found = _four(spark, sf)
    with ThreadPoolExecutor(4) as pool:
        removed = dict(zip(found, pool.map(take_back, found, found.values()), strict=True))["blocks"]
    kept = {name: maintain.stored(spark, f"{root}/{name}", TABLES[name]).drop("bucket") for name in found}
    return _marks(kept).unionByName(spark.createDataFrame([("removed", None, removed)], "table_name string, max_block long, n_rows long"))


@query(_marks_sql(f"{BLOCK} > 1"))
def copy_range(spark, sf):
    """Copies from block 2 on while the source ends early, goes on when it has grown, also in a bucket that was copied
    before, and is then copied once more from the start by a new checkpoint."""
    source, root, found = scratch_path(spark, "chain"), scratch_path(spark, "copy"), _four(spark, sf)
    top = found["blocks"].agg(F.max("num")).first()[0]
    low, size = 2 * top // 3, max(1, top // 8)

    def save(which) -> None:
        one = lambda name, block: maintain.save_buckets(found[name].where(which(F.col(block))), f"{source}/{name}", block, size)
        with ThreadPoolExecutor(4) as pool:
            list(pool.map(one, found, [maintain.BLOCK_COLUMN[name] for name in found]))

    save(lambda block: block <= low)
    maintain.copy_range(spark, source, root, f"{root}-offsets", 1)
    save(lambda block: block >= low // size * size)
    for checkpoint in ("offsets", "again"):
        if maintain.copy_range(spark, source, root, f"{root}-{checkpoint}", 1) != top:
            raise RuntimeError("the copy doesn't reach the tip")
    return _marks({name: maintain.read_committed(spark, root, name) for name in found})


@query(f"SELECT strftime({TS}, '%Y-%m') AS month, count(*) AS n, min({a('1 + ' + TYPE)}) AS least FROM events GROUP BY 1")
def write_clustered(spark, sf):
    path = scratch_path(spark, "clustered")
    maintain.write_clustered(fixtures.logs(spark, sf), path, "block_timestamp", ["address", "selector", "block_num", "log_idx"], ["selector", "address", "topic1", "topic2"])
    return tables.hex_view(spark.read.schema(extended(TABLES["logs"], "month string")).parquet(path).groupBy("month").agg(F.count("*").alias("n"), F.min("address").alias("least")))


@query(f"""SELECT 'address' AS filtered, count(*) AS n, CAST(sum(event_id % 100) AS BIGINT) AS total FROM events WHERE {TYPE} = 1 UNION ALL SELECT 'topic1', count(*), CAST(sum(event_id % 100) AS BIGINT) FROM events WHERE user_id = 8
        UNION ALL SELECT 'topic2', count(*), CAST(sum(event_id % 100) AS BIGINT) FROM events WHERE {RECEIVER} = 8 UNION ALL SELECT 'selector', count(*), CAST(sum(event_id % 100) AS BIGINT) FROM events""")
def write_interleaved(spark, sf):
    """Logs of two events, stored in Z-order of four columns and read with a filter on each of them."""
    path, transfer = scratch_path(spark, "interleaved"), F.col("selector") == F.lit(TRANSFER.topic)
    logs = fixtures.logs(spark, sf).unionByName(fixtures.approvals(spark, sf))
    maintain.write_interleaved(logs, path, ["selector", "address", "topic1", "topic2"])
    stored, eight = tables.read_table(spark, path, "logs"), F.lit((8).to_bytes(32, "big"))
    hits = {"address": transfer & (F.col("address") == F.lit((2).to_bytes(20, "big"))), "topic1": transfer & (F.col("topic1") == eight), "topic2": transfer & (F.col("topic2") == eight), "selector": transfer}
    one = lambda name, hit: stored.where(hit).agg(F.count("*").alias("n"), F.sum("log_idx").alias("total")).select(F.lit(name).alias("filtered"), "n", "total")
    return reduce(DataFrame.unionByName, [one(*x) for x in hits.items()])


_STATE = [(1, 100, 90, 95, None, 1.5, "2024-01-01 00:00:00", "2024-01-02 00:00:00", 10, 1), (1, 98, 92, 96, 7, None, "2024-01-01 06:00:00", "2024-01-03 00:00:00", 40, 2), (1, 120, 91, 94, None, None, "2024-01-01 07:00:00", "2024-01-04 00:00:00", 30, 3)]


def _state(spark, rows) -> DataFrame:
    df = spark.createDataFrame([tuple(r) for r in rows], "chain_id long, head_num long, synced_num long, tip_num long, backfill_num long, sync_rate double, started_at string, updated_at string, copied_num long, seq long")
    return maintain.conform(df, SYNC_STATE)


def _tops(spark, sf):
    """Chain 2's rows come from the tables: one state per block of A3, in order."""
    b = fixtures.txs(spark, sf).groupBy("block_num").agg(F.min("block_timestamp").alias("ts"))
    n = F.col("block_num")
    return maintain.conform(b.select(F.lit(2).alias("chain_id"), (n + 5).alias("head_num"), (n % 50).alias("synced_num"), n.alias("tip_num"), F.when(n % 3 == 0, n).alias("backfill_num"), F.lit(None).cast("double").alias("sync_rate"), F.col("ts").alias("started_at"), F.col("ts").alias("updated_at"), n.alias("copied_num"), n.alias("seq")), SYNC_STATE)


@query(f"""SELECT 1 AS chain_id, 120 AS head_num, 92 AS synced_num, 96 AS tip_num, 7 AS backfill_num, 40 AS copied_num, TIMESTAMP '2024-01-01' AS started_at
        UNION ALL SELECT 2, max(b) + 5, max(b % 50), max(b), max(b) FILTER (WHERE b % 3 = 0), max(b), min(t) FROM (SELECT {BLOCK} AS b, min({TS}) AS t FROM events GROUP BY 1)""", stamps=("started_at",))
def merge_state(spark, sf):
    every = _state(spark, _STATE).unionByName(_tops(spark, sf))
    merged = maintain.merge_state(every.where("seq % 2 = 0"), every.where("seq % 2 = 1"))
    return merged.select("chain_id", "head_num", "synced_num", "tip_num", "backfill_num", "copied_num", "started_at")


@query(f"SELECT {BLOCK} AS block_num, {IDX} AS tx_idx, CAST(1 AS SMALLINT) AS status, CAST(NULL AS VARCHAR) AS contract_address FROM events WHERE event_id % 7 <> 0")
def conform(spark, sf):
    """Receipts of an older kind, without status and contract address."""
    old = fixtures.receipts(spark, sf).drop("status", "contract_address")
    once = maintain.conform(old, TABLES["receipts"], {"status": 1})
    return tables.hex_view(maintain.conform(once, TABLES["receipts"], {"status": 9}).select("block_num", "tx_idx", "status", "contract_address"))


# ---- completeness and integrity

GAPS = "SELECT prev + 1 AS gap_start, num - 1 AS gap_end FROM (SELECT num, lag(num) OVER (ORDER BY num) AS prev FROM (SELECT DISTINCT l_orderkey AS num FROM lineitem{})) WHERE num > prev + 1"


def _tip(blocks: DataFrame) -> int:
    return blocks.agg(F.max("num")).first()[0] or 0


@query(GAPS.format(""))
def detect_gaps(spark, sf):
    b = fixtures.gapped_blocks(spark, sf)
    return integrity.detect_gaps(b, _tip(b))


ALL_GAPS = f"SELECT * FROM ({GAPS.format('')} UNION ALL SELECT 1, min(l_orderkey) - 1 FROM lineitem HAVING min(l_orderkey) > 1)"


@query(ALL_GAPS)
def detect_all_gaps(spark, sf):
    b = fixtures.gapped_blocks(spark, sf)
    return integrity.detect_all_gaps(b, _tip(b))


@query("SELECT count(DISTINCT l_orderkey) <> max(l_orderkey) AS has_gaps FROM lineitem WHERE l_orderkey >= 1")
def has_gaps(spark, sf):
    b = fixtures.gapped_blocks(spark, sf)
    return integrity.has_gaps(b, 1, _tip(b))


@query("SELECT o_orderkey AS num FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) ORDER BY 1 DESC LIMIT 20")
def missing_receipts(spark, sf):
    return integrity.blocks_missing_receipts(fixtures.blocks(spark, sf), fixtures.read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("block_num")), 20)


@query("""SELECT min(num) AS range_start, max(num) AS range_end FROM (SELECT num, isle, (num - min(num) OVER (PARTITION BY isle)) // 10 AS chunk FROM
        (SELECT num, num - row_number() OVER (ORDER BY num) AS isle FROM (SELECT DISTINCT l_orderkey AS num FROM lineitem))) GROUP BY isle, chunk""")
def group_ranges(spark, sf):
    return integrity.group_ranges(fixtures.gapped_blocks(spark, sf), 10)


@query("""WITH g AS (SELECT l_orderkey * 100 AS gap_start, l_orderkey * 100 + l_quantity AS gap_end FROM (SELECT l_orderkey, CAST(max(l_quantity) AS BIGINT) AS l_quantity FROM lineitem GROUP BY 1)),
        k AS (SELECT gap_start, gap_end, unnest(range(0, (gap_end - gap_start) // 7 + 1)) AS k FROM g) SELECT greatest(gap_end - k * 7 - 6, gap_start) AS batch_start, gap_end - k * 7 AS batch_end FROM k""")
def plan_batches(spark, sf):
    g = fixtures.read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.max("l_quantity").cast("long").alias("q"))
    return integrity.plan_batches(g.select((F.col("l_orderkey") * 100).alias("gap_start"), (F.col("l_orderkey") * 100 + F.col("q")).alias("gap_end")), 7)


@query(f"SELECT o_orderkey AS num, {w('o_orderkey')} AS parent_hash, {w('o_orderkey + 1000000')} AS expected FROM orders WHERE o_orderkey > 0 AND (o_orderkey - 1) % 97 = 5")
def parent_breaks(spark, sf):
    """Every 97th block has another hash than its child says."""
    b = fixtures.blocks(spark, sf).withColumn("hash", F.when(F.col("num") % 97 == 5, words.word_of_long(F.col("num") + 1_000_001)).otherwise(F.col("hash")))
    return tables.hex_view(integrity.parent_breaks(b))


@query("SELECT max(o_orderkey) - 40 AS fork_point FROM orders")
def fork_point(spark, sf):
    b = fixtures.blocks(spark, sf)
    return integrity.fork_point(b, fixtures.forked(b, 40), b.agg(F.max("num")).first()[0])


@query(_marks_sql())
def watermarks(spark, sf):
    return integrity.watermarks(_four(spark, sf))


@query(_marks_sql())
def stored_watermarks(spark, sf):
    """The same from the footers of stored tables."""
    root, paths = scratch_path(spark, "chain"), {}
    for name, df in _four(spark, sf).items():
        paths[name] = f"{root}/{name}"
        df.write.parquet(paths[name])
    return integrity.stored_watermarks(spark, paths)


_CHAINS = "SELECT 1 AS c, l_orderkey AS num FROM lineitem UNION SELECT 2, l_orderkey FROM lineitem WHERE l_orderkey % 10 <> 0 UNION SELECT 3, l_orderkey FROM lineitem WHERE l_orderkey % 2 = 1"


def _chains(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Three chains of the gapped blocks, of which the second and third lack some more, and their state: tips from the
    blocks, and one chain each with a backfill under way, not begun and done."""
    num, c = F.col("num"), F.col("chain_id")
    b = fixtures.gapped_blocks(spark, sf).withColumn("chain_id", F.explode(F.array(*[F.lit(i) for i in (1, 2, 3)])))
    b = b.where((c == 1) | ((c == 2) & (num % 10 != 0)) | ((c == 3) & (num % 2 == 1)))
    tip, at = F.max("num"), F.to_timestamp(F.lit("2024-01-01 00:00:00"))
    state = b.groupBy("chain_id").agg((tip + c * 100).alias("head_num"), (tip - 10).alias("synced_num"), tip.alias("tip_num"), F.when(c == 1, F.lit(10)).when(c == 3, F.lit(0)).alias("backfill_num"), F.lit(None).cast("double").alias("sync_rate"), at.alias("started_at"), at.alias("updated_at"), F.lit(0).alias("copied_num"), F.lit(1).alias("seq"))
    return b, maintain.conform(state, SYNC_STATE)


@query(f"""WITH b AS ({_CHAINS}), p AS (SELECT c, num, lag(num) OVER (PARTITION BY c ORDER BY num) AS prev FROM b),
        g AS (SELECT c, count(*) AS n_gaps, CAST(sum(num - prev - 1) AS BIGINT) AS missing FROM p WHERE num > prev + 1 GROUP BY c),
        v AS (SELECT c, max(num) + c * 100 AS h, max(num) - 10 AS s, max(num) AS t, CASE c WHEN 1 THEN 10 WHEN 3 THEN 0 END AS b, count(*) AS n FROM b GROUP BY c)
        SELECT CAST(v.c AS BIGINT) AS chain_id, CAST(h - t AS BIGINT) AS lag, CAST(t - s AS BIGINT) AS gap_blocks, CAST(CASE WHEN b IS NULL THEN s - 1 ELSE b END AS BIGINT) AS backfill_remaining,
               CASE WHEN b IS NULL THEN 1 ELSE s - b + 1 END / 3600.0 AS rate, CASE WHEN b IS NULL THEN s - 1 ELSE b END / (CASE WHEN b IS NULL THEN 1 ELSE s - b + 1 END / 3600.0) AS eta_secs,
               CAST(least(100, 100 * n // h) AS BIGINT) AS coverage_pct, n_gaps, missing FROM v JOIN g ON v.c = g.c""")
def sync_status(spark, sf):
    blocks, state = _chains(spark, sf)
    return integrity.sync_status(state, blocks, F.to_timestamp(F.lit("2024-01-01 01:00:00")))


@query(f"SELECT CAST(c AS BIGINT) AS chain_id, prev + 1 AS gap_start, num - 1 AS gap_end FROM (SELECT c, num, lag(num) OVER (PARTITION BY c ORDER BY num) AS prev FROM ({_CHAINS})) WHERE num > prev + 1")
def sync_gaps(spark, sf):
    blocks, state = _chains(spark, sf)
    return integrity.sync_gaps(state, blocks)


# ---- decoding on read


@query(f"""SELECT {BLOCK} AS block_num, {IDX} AS log_idx, {a('user_id')} AS "from", {a(RECEIVER)} AS "to", CAST({VALUE} AS VARCHAR) AS value FROM events""")
def decode_transfer(spark, sf):
    return tables.hex_view(decode.decode_events(fixtures.logs(spark, sf), TRANSFER).select("block_num", "log_idx", "from", "to", "value"))


@query(f"""SELECT l_orderkey AS block_num, l_linenumber AS log_idx, {a('l_suppkey % 10')} AS address, {a('l_suppkey')} AS sender, CAST({cents('l_quantity')} AS VARCHAR) AS "amount0In", CAST({PRICE} AS VARCHAR) AS "amount1In",
        CAST({cents('l_discount')} AS VARCHAR) AS "amount0Out", CAST({cents('l_tax')} AS VARCHAR) AS "amount1Out", {a('l_partkey')} AS "to" FROM lineitem""")
def decode_swap(spark, sf):
    return tables.hex_view(decode.decode_events(fixtures.swaps(spark, sf), SWAP).drop("block_timestamp", "tx_idx", "tx_hash"))


@query(f"""SELECT {BLOCK} AS block_num, {a('user_id')} AS arg0, {a(RECEIVER)} AS arg1, CAST({VALUE} AS VARCHAR) AS arg2 FROM events""")
def decode_unnamed(spark, sf):
    return tables.hex_view(decode.decode_events(fixtures.logs(spark, sf), "Transfer(address indexed, address indexed, uint256)").select("block_num", "arg0", "arg1", "arg2"))


def _events(spark, sf) -> DataFrame:
    return fixtures.read(spark, sf, "events").withColumn("cents", fixtures.cents(F.col("value")))


@query(f"SELECT event_id, user_id AS small, CAST(CAST({VALUE} AS HUGEINT) * 18014398509481984 AS DECIMAL(38,0)) AS middle, CAST(CAST({VALUE} AS HUGEINT) * 18014398509481984 AS VARCHAR) AS wide FROM events")
def abi_uint(spark, sf):
    """cents * 2^54 is wider than 64 bits."""
    e = _events(spark, sf)
    shifted = F.unhex(F.lpad(F.concat(F.hex(F.col("cents") * 4), F.lit("0" * 13)), 64, "0"))
    return e.select("event_id", decode.abi_uint(words.word_of_long(F.col("user_id")), 32).alias("small"), decode.abi_uint(shifted, 120).alias("middle"), decode.abi_uint(shifted).alias("wide"))


@query(f"SELECT event_id, CASE WHEN event_id % 2 = 0 THEN user_id ELSE -user_id END AS small, CAST(CASE WHEN event_id % 2 = 0 THEN {VALUE} ELSE -{VALUE} END AS VARCHAR) AS wide FROM events")
def abi_int(spark, sf):
    signed = lambda k: F.unhex(F.when((F.col("event_id") % 2 == 0) | (k == 0), F.lpad(F.hex(k), 64, "0")).otherwise(F.lpad(F.hex(-k), 64, "F")))
    return _events(spark, sf).select("event_id", decode.abi_int(signed(F.col("user_id")), 32).alias("small"), decode.abi_int(signed(F.col("cents"))).alias("wide"))


@query(f"SELECT event_id, {a('user_id')} AS who FROM events")
def abi_address(spark, sf):
    return tables.hex_view(_events(spark, sf).select("event_id", decode.abi_address(words.word_of_long(F.col("user_id"))).alias("who")))


@query("SELECT event_id, event_id % 3 <> 0 AS flag FROM events")
def abi_bool(spark, sf):
    return _events(spark, sf).select("event_id", decode.abi_bool(words.word_of_long(F.col("event_id") % 3)).alias("flag"))


def _dynamic(text):
    """A head word that points to a length and a payload, padded to words."""
    body = F.encode(text, "utf-8")
    pad = F.pmod(-F.octet_length(body), F.lit(32))
    return F.concat(words.word_of_long(F.lit(32)), words.word_of_long(F.octet_length(body).cast("long")), body, F.substring(F.lit(bytes(32)), F.lit(1), pad))


@query(f"""SELECT event_id, CASE WHEN event_id % 3 <> 1 THEN user_id END AS narrow, CASE WHEN event_id % 3 = 0 THEN user_id WHEN event_id % 3 = 2 THEN -1 - user_id END AS signed, CASE WHEN event_id % 3 = 0 THEN CAST({VALUE} AS VARCHAR) END AS wide,
        CASE WHEN event_id % 3 = 0 THEN '0x' || lower(hex(event_type)) END AS payload FROM events""")
def hostile_words(spark, sf):
    """Every third word is wider than its type, or a pointer near 2^63, or a negative number: null, and no error."""
    e, third = _events(spark, sf), F.col("event_id") % 3
    word = lambda k, high: F.unhex(F.concat(F.lit(high), F.lpad(F.hex(k), 64 - len(high), high[-1])))
    user, cents = F.col("user_id"), F.col("cents")
    unsigned = F.when(third == 1, word(user, "8")).otherwise(word(user, "0"))
    signed = F.when(third == 1, word(user, "7")).when(third == 2, word(-1 - user, "F")).otherwise(word(user, "0"))
    wide = F.when(third == 0, word(cents, "0")).otherwise(word(cents, "01"))
    body = _dynamic(F.col("event_type"))
    data = F.when(third == 0, body).otherwise(F.concat(words.word_of_long(F.lit((1 << 63) - 1) - third), F.substring(body, F.lit(33), F.octet_length(body))))
    return tables.hex_view(e.select("event_id", decode.abi_uint(unsigned, 40).alias("narrow"), decode.abi_int(signed, 40).alias("signed"), decode.abi_uint(wide, 128).alias("wide"), decode.abi_bytes(data, 0).alias("payload")))


@query(f"""SELECT 'Moved(uint256)' AS event, event_id AS block_num, CAST({VALUE} AS VARCHAR) AS amount, NULL AS who FROM events WHERE event_id % 2 = 0
        UNION ALL SELECT 'Moved(address)', event_id, NULL, {a('user_id')} FROM events WHERE event_id % 2 = 1""")
def decode_overloads(spark, sf):
    """Two events of one name over the same logs."""
    one, two = parse_signature("Moved(uint256 x)"), parse_signature("Moved(address x)")
    even = F.col("event_id") % 2 == 0
    logs = _events(spark, sf).select(F.col("event_id").alias("block_num"), F.when(even, F.lit(one.topic)).otherwise(F.lit(two.topic)).alias("selector"), words.word_of_long(F.when(even, F.col("cents")).otherwise(F.col("user_id"))).alias("data"))
    found = decode.decode_union(logs, [one, two])
    return tables.hex_view(found.select("event", "block_num", F.col("x_string").alias("amount"), F.col("x_binary").alias("who")))


@query("SELECT event_id, '0x' || lower(hex(event_type)) AS payload, CASE WHEN event_id % 4 <> 0 THEN '0x' || lower(hex(props)) END AS cut FROM events")
def abi_bytes(spark, sf):
    """Every fourth row of `cut` has lost its last word."""
    whole = _dynamic(F.col("props"))
    cut = F.when(F.col("event_id") % 4 == 0, F.substring(whole, F.lit(1), F.octet_length(whole) - 32)).otherwise(whole)
    return tables.hex_view(_events(spark, sf).select("event_id", decode.abi_bytes(_dynamic(F.col("event_type")), 0).alias("payload"), decode.abi_bytes(cut, 0).alias("cut")))


@query("SELECT event_id, props || 'é' AS text FROM events")
def abi_string(spark, sf):
    return _events(spark, sf).select("event_id", decode.abi_string(_dynamic(F.concat(F.col("props"), F.lit("é"))), 0).alias("text"))


@query(f"SELECT event_id, {w('event_id')} AS whole, substr({w('event_id')}, 1, 10) AS four FROM events")
def abi_bytes32(spark, sf):
    word = words.word_of_long(F.col("event_id"))
    return tables.hex_view(_events(spark, sf).select("event_id", decode.abi_fixed(word, 32).alias("whole"), decode.abi_fixed(word, 4).alias("four")))


@query(f"SELECT event_id, CAST({VALUE} AS VARCHAR) AS plain, CAST(CAST({VALUE} AS HUGEINT) * 4294967296 * 4294967296 AS VARCHAR) AS wide, CASE WHEN event_id % 2 = 0 THEN '115792089237316195423570985008687907853269984665640564039457584007913129639935' ELSE '0' END AS edge FROM events")
def format_uint(spark, sf):
    c = F.col("cents")
    wide = F.unhex(F.lpad(F.concat(F.hex(c), F.lit("0" * 16)), 64, "0"))
    edge = F.when(F.col("event_id") % 2 == 0, F.lit(b"\xff" * 32)).otherwise(F.lit(bytes(32)))
    return _events(spark, sf).select("event_id", words.uint_to_text(words.word_of_long(c)).alias("plain"), words.uint_to_text(wide).alias("wide"), words.uint_to_text(edge).alias("edge"))


@query(f"SELECT event_id, CASE WHEN event_id % 4 = 0 THEN '' WHEN event_id % 4 = 1 THEN CAST(user_id AS VARCHAR) WHEN event_id % 4 = 2 THEN user_id || ',' || event_id ELSE user_id || ',' || event_id || ',' || {VALUE} END AS items, user_id || ',' || event_id AS pair, event_id AS after FROM events")
def decode_array(spark, sf):
    """uint40[] with 0 to 3 items, uint40[2] and a uint40 after it, whose place depends on the array's width."""
    e = _events(spark, sf).withColumn("n", F.col("event_id") % 4)
    item = [words.word_of_long(F.col(c)) for c in ("user_id", "event_id", "cents")]
    tail = F.when(F.col("n") == 0, F.lit(b"")).when(F.col("n") == 1, item[0]).when(F.col("n") == 2, F.concat(*item[:2])).otherwise(F.concat(*item))
    data = F.concat(words.word_of_long(F.lit(128)), item[0], item[1], item[1], words.word_of_long(F.col("n")), tail)
    s = parse_signature("Listed(uint40[] items, uint40[2] pair, uint40 after)")
    logs = e.select("event_id", F.lit(s.topic).alias("selector"), data.alias("data"))
    cols = decode.parameter_columns(s)
    show = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return logs.where(F.col("selector") == F.lit(s.topic)).select("event_id", show(cols["items"]).alias("items"), show(cols["pair"]).alias("pair"), cols["after"].alias("after"))


@query(f"""SELECT 'Transfer' AS event, {BLOCK} AS block_num, {IDX} AS log_idx, CAST({VALUE} AS VARCHAR) AS value, {a('user_id')} AS "from", {a(RECEIVER)} AS "to", NULL AS owner, NULL AS spender FROM events
        UNION ALL SELECT 'Approval', {BLOCK}, {IDX}, CAST({VALUE} AS VARCHAR), NULL, NULL, {a('user_id')}, {a(TYPE)} FROM events""")
def decode_union(spark, sf):
    logs = fixtures.logs(spark, sf).unionByName(fixtures.approvals(spark, sf))
    return tables.hex_view(decode.decode_union(logs, [TRANSFER, APPROVAL]).select("event", "block_num", "log_idx", "value", "from", "to", "owner", "spender"))


@query(f"""SELECT t.event_id // 100 AS block_num, {a('t.user_id')} AS sender, count(*) AS pairs, CAST(sum(CAST(round(p.value * 100) AS BIGINT)) AS BIGINT) AS approved
        FROM events t JOIN events p ON t.event_id // 100 = p.event_id // 100 AND t.user_id = p.user_id GROUP BY 1, 2""")
def sql_over_events(spark, sf):
    """SQL that joins two events by name: for each block and sender, the approvals beside each transfer."""
    decode.register_events(fixtures.logs(spark, sf).unionByName(fixtures.approvals(spark, sf)), [TRANSFER, APPROVAL])
    found = spark.sql("""
        SELECT t.block_num, t.`from` AS sender, count(*) AS pairs, sum(CAST(p.value AS BIGINT)) AS approved
        FROM Transfer t JOIN Approval p ON t.block_num = p.block_num AND t.`from` = p.owner GROUP BY t.block_num, t.`from`""")
    return tables.hex_view(found)


@query(f"""SELECT {BLOCK} AS block_num, {IDX} AS log_idx, {a(RECEIVER)} AS "to", CAST({VALUE} AS VARCHAR) AS value FROM events WHERE user_id = 8""")
def pushdown_topic(spark, sf):
    """Logs stored as Parquet; the parameter's equality becomes one on topic1, which reaches the scan."""
    path = scratch_path(spark, "logs")
    fixtures.logs(spark, sf).write.parquet(path)
    hit = decode.where_parameter(tables.read_table(spark, path, "logs"), TRANSFER, {"from": "0x" + "8".rjust(40, "0")})
    return tables.hex_view(decode.decode_events(hit, TRANSFER).select("block_num", "log_idx", "to", "value"))


@query(f"SELECT {BLOCK} AS block_num, {IDX} AS idx, {a(RECEIVER)} AS receiver, CAST({VALUE} AS VARCHAR) AS amount FROM events")
def decode_calldata(spark, sf):
    return tables.hex_view(decode.decode_calldata(fixtures.txs(spark, sf), fixtures.TRANSFER_FUNCTION).drop("hash"))


# ---- forwarding transfers


@query("""SELECT event_id // 100 AS block_num, CAST((event_id % 100) * 4 + i AS INTEGER) AS log_idx, event_id % 5 = 0 AND i = 1 AS is_virtual_forward
        FROM (SELECT event_id, unnest(range(0, [2, 4, 3, 2, 1][event_id % 5 + 1])) AS i FROM events)""")
def mark_forward_hops(spark, sf):
    return forward.mark_forward_hops(fixtures.forwarding_logs(spark, sf)).select("block_num", "log_idx", "is_virtual_forward")


@query("SELECT event_id // 100 AS block_num, count(*) AS virtual, '0x00000001' AS master, '0x' || lpad(lower(to_hex(max(event_id))), 12, '0') AS last_tag FROM events WHERE event_id % 5 = 0 GROUP BY 1")
def virtual_parts(spark, sf):
    to = F.substring("topic2", 13, 20)
    v = fixtures.forwarding_logs(spark, sf).select("block_num", forward.virtual_parts(to).alias("p")).where("p is not null")
    first = v.groupBy("block_num").agg(F.count_if((F.conv(F.hex("p.user_tag"), 16, 10).cast("long") % 5) == 0).alias("virtual"), F.max("p.master_id").alias("master"), F.max(F.when(F.conv(F.hex("p.user_tag"), 16, 10).cast("long") % 5 == 0, F.col("p.user_tag"))).alias("last_tag"))
    return tables.hex_view(first)


# ---- analytics


@query(f"""SELECT token, holder, CAST(CAST(sum(v) AS BIGINT) AS VARCHAR) AS balance FROM (SELECT {a(TOKEN6)} AS token, {a('100000 + l_partkey')} AS holder, {PRICE} AS v FROM lineitem
        UNION ALL SELECT {a(TOKEN6)}, {a('l_suppkey')}, -{PRICE} FROM lineitem) GROUP BY 1, 2 HAVING sum(v) > 0""")
def token_holders(spark, sf):
    return tables.hex_view(analytics.token_holders(fixtures.transfers(spark, sf)))


@query(f"SELECT {a('100000 + l_partkey')} AS holder, CAST(CAST(sum({PRICE}) AS BIGINT) AS VARCHAR) AS received FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1")
def token_inflow(spark, sf):
    return tables.hex_view(analytics.token_inflow(fixtures.transfers(spark, sf), tables.hex_lit("0x" + "2".rjust(40, "0"))))


@query(f"""SELECT {a('1 + ' + TYPE)} AS token, CAST(CAST(sum(CASE WHEN user_id = 0 THEN {VALUE} ELSE 0 END - CASE WHEN {RECEIVER} = 0 THEN {VALUE} ELSE 0 END) AS BIGINT) AS VARCHAR) AS supply FROM events WHERE user_id = 0 OR {RECEIVER} = 0 GROUP BY 1""")
def token_supply(spark, sf):
    return tables.hex_view(analytics.token_supply(fixtures.logs(spark, sf)))


@query(f"SELECT address, CAST(sum(s) AS BIGINT) AS sent, CAST(sum(r) AS BIGINT) AS received FROM (SELECT {a('l_suppkey')} AS address, 1 AS s, 0 AS r FROM lineitem UNION ALL SELECT {a('100000 + l_partkey')}, 0, 1 FROM lineitem) GROUP BY 1")
def transfer_counts(spark, sf):
    return tables.hex_view(analytics.transfer_counts(fixtures.transfers(spark, sf)))


@query(f"SELECT {a('1 + ' + TYPE)} AS pair, date_trunc('hour', {TS}) AS hour, count(*) AS swaps, CAST(CAST(sum({VALUE} + user_id * 3) AS BIGINT) AS VARCHAR) AS volume0, CAST(CAST(sum(user_id + event_id) AS BIGINT) AS VARCHAR) AS volume1 FROM events GROUP BY 1, 2", stamps=("hour",))
def swap_volume_hourly(spark, sf):
    return tables.hex_view(analytics.swap_volume(fixtures.event_swaps(spark, sf)))


@query(f"SELECT {a('9')} AS token, {a('user_id')} AS owner, {a(TYPE)} AS spender, CAST(max_by({VALUE}, event_id) AS VARCHAR) AS allowance FROM events GROUP BY 1, 2, 3")
def latest_allowance(spark, sf):
    return tables.hex_view(analytics.latest_allowance(fixtures.approvals(spark, sf)))


@query(f"SELECT CAST(l_shipdate AS DATE) AS day, count(*) AS transfers, count(DISTINCT l_suppkey) AS senders, count(DISTINCT l_partkey) AS receivers, CAST(CAST(sum({PRICE}) AS BIGINT) AS VARCHAR) AS volume FROM lineitem GROUP BY 1")
def daily_stats(spark, sf):
    return analytics.daily_stats(fixtures.transfers(spark, sf))


@query(f"SELECT l_orderkey AS block_num, l_linenumber AS log_idx, {a(TOKEN6)} AS token, {a('l_suppkey')} AS sender, {a('100000 + l_partkey')} AS receiver, CAST({PRICE} AS VARCHAR) AS amount FROM lineitem WHERE {PRICE} >= 9000000")
def whale_transfers(spark, sf):
    return tables.hex_view(analytics.whale_transfers(fixtures.transfers(spark, sf), 9_000_000))


@query(f"SELECT {a('100000 + l_partkey')} AS recipient, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, recipient LIMIT 20")
def top_recipients(spark, sf):
    return tables.hex_view(analytics.top_recipients(fixtures.transfers(spark, sf), 20))


_B = f"o_orderkey AS num, {w('o_orderkey + 1')} AS hash, {cents('o_totalprice')} AS gas_used, {a('o_custkey')} AS miner"


def _block_view(df: DataFrame) -> DataFrame:
    return tables.hex_view(df.select("num", "hash", "gas_used", "miner"))


@query(f"SELECT {_B} FROM orders WHERE o_orderkey = 77")
def block_by_num(spark, sf):
    return _block_view(analytics.block_by_num(fixtures.blocks(spark, sf), 77))


@query(f"SELECT {_B} FROM orders WHERE o_orderkey = 41")
def block_by_hash(spark, sf):
    return _block_view(analytics.block_by_hash(fixtures.blocks(spark, sf), (42).to_bytes(32, "big")))


_T = f"""{BLOCK} AS block_num, {IDX} AS idx, {w('event_id')} AS hash, {a('user_id')} AS "from" """


def _tx_view(df: DataFrame) -> DataFrame:
    return tables.hex_view(df.select("block_num", "idx", "hash", "from"))


@query(f"SELECT {_T} FROM events WHERE event_id // 100 = 3")
def txs_by_block(spark, sf):
    return _tx_view(analytics.txs_by_block(fixtures.txs(spark, sf), 3))


@query(f"SELECT {_T} FROM events WHERE event_id = 321")
def tx_by_hash(spark, sf):
    return _tx_view(analytics.tx_by_hash(fixtures.txs(spark, sf), (321).to_bytes(32, "big")))


@query(f"SELECT {_B} FROM orders ORDER BY o_orderkey DESC LIMIT 100")
def recent_blocks(spark, sf):
    return _block_view(analytics.recent_blocks(fixtures.blocks(spark, sf), 100))


@query(f"SELECT {BLOCK} AS block_num, {IDX} AS log_idx, {a('1 + ' + TYPE)} AS address FROM events ORDER BY event_id LIMIT 100")
def logs_by_selector(spark, sf):
    return tables.hex_view(analytics.logs_by_selector(fixtures.logs(spark, sf), TRANSFER.topic).select("block_num", "log_idx", "address"))


@query("SELECT 'blocks' AS table_name, count(*) AS n FROM orders UNION ALL SELECT 'txs', count(*) FROM events")
def table_counts(spark, sf):
    return analytics.table_counts(fixtures.blocks(spark, sf), fixtures.txs(spark, sf))


@query(f"SELECT {TYPE} AS type, count(*) AS n FROM events GROUP BY 1")
def txs_by_type(spark, sf):
    return analytics.txs_by_type(fixtures.txs(spark, sf))


@query(f"SELECT count(*) AS n, CAST(sum(g) AS BIGINT) AS total, max(g) AS most, min(g) AS least, CAST(sum(g) // count(*) AS BIGINT) AS average FROM (SELECT {cents('o_totalprice')} AS g FROM orders WHERE o_orderkey > (SELECT max(o_orderkey) FROM orders) - 1000)")
def gas_stats_recent(spark, sf):
    return analytics.gas_stats_recent(fixtures.blocks(spark, sf), 1000)


@query(f"""SELECT {a('user_id')} AS "from", count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10""")
def top_senders(spark, sf):
    return tables.hex_view(analytics.top_senders(fixtures.txs(spark, sf), 10))


@query("SELECT count(DISTINCT user_id) AS senders FROM events")
def unique_senders(spark, sf):
    return analytics.unique_senders(fixtures.txs(spark, sf))


@query(f"SELECT * FROM (SELECT {hexlit(TRANSFER.topic)} AS selector, count(*) AS n FROM events UNION ALL SELECT {hexlit(APPROVAL.topic)}, count(*) FROM events UNION ALL SELECT {hexlit(SWAP.topic)}, count(*) FROM lineitem)")
def top_events(spark, sf):
    logs = fixtures.logs(spark, sf).unionByName(fixtures.approvals(spark, sf)).unionByName(fixtures.swaps(spark, sf))
    return tables.hex_view(analytics.top_events(logs, 10))


@query(f"SELECT {_B} FROM orders WHERE {cents('o_totalprice')} = (SELECT {cents('o_totalprice')} FROM orders WHERE o_orderkey = 55)")
def blocks_same_gas(spark, sf):
    return _block_view(analytics.blocks_same_gas(fixtures.blocks(spark, sf), 55))


@query(f"""SELECT count(*) AS n_txs, count(*) FILTER (WHERE event_id % 4 = 0) AS multicalls, count(DISTINCT user_id) AS senders, count(DISTINCT {RECEIVER}) AS receivers, count(DISTINCT {BLOCK}) AS n_blocks, min({TS}) AS first_at, max({TS}) AS last_at,
        count(*) AS n_logs, count(*) * 1000 // count(DISTINCT {BLOCK}) AS milli_txs_per_block, CAST(1000 AS BIGINT) AS milli_logs_per_tx FROM events""", stamps=("first_at", "last_at"))
def data_profile(spark, sf):
    return analytics.data_profile(fixtures.txs(spark, sf), fixtures.logs(spark, sf))


@query("SELECT count(*) AS pairs, count(*) FILTER (WHERE event_id % 11 = 0) AS mismatches, count(*) FILTER (WHERE event_id % 10 <> 0) AS succeeded, count(*) FILTER (WHERE event_id % 10 = 0) AS failed FROM events WHERE event_id % 7 <> 0")
def receipt_mismatch(spark, sf):
    r = fixtures.receipts(spark, sf)
    i = F.col("block_num") * 100 + F.col("tx_idx")
    return analytics.receipt_mismatch(fixtures.txs(spark, sf), r.withColumn("tx_hash", F.when(i % 11 == 0, F.lit(b"\x01" * 32)).otherwise(F.col("tx_hash"))))


@query(f"SELECT {a('o_custkey')} AS miner, count(*) AS n FROM orders GROUP BY 1")
def blocks_by_miner(spark, sf):
    return tables.hex_view(analytics.blocks_by_miner(fixtures.blocks(spark, sf)))


# ---- incrementally maintained views

BALANCES = views.View(
    "holders", analytics.balances, ["address", "holder"],
    finish=lambda df: df.where(words.total_is_positive()).select(F.col("address").alias("token"), analytics.address_of("holder").alias("holder"), words.limbs_to_text(words.summed()).alias("balance")),
    definition="token_holders",
)


def _halves(spark, sf) -> tuple[DataFrame, DataFrame]:
    t = fixtures.transfers(spark, sf)
    return t.where("block_num % 2 = 0"), t.where("block_num % 2 = 1")


@query(ORACLE_SQL["token_holders"])
def view_incremental(spark, sf):
    """A backfill, then two streams of a quarter of the transfers each; the second is followed once more."""
    store, (old, new) = views.ViewStore(spark, scratch_path(spark, "views")), _halves(spark, sf)
    store.create(BALANCES, old)
    for part in (new.where("block_num % 4 = 1"), new.where("block_num % 4 = 3")):
        path, offsets = scratch_path(spark, "arrivals"), scratch_path(spark, "offsets")
        part.write.parquet(path)
        store.follow(BALANCES, spark.readStream.schema(new.schema).parquet(path), offsets)
    store.follow(BALANCES, spark.readStream.schema(new.schema).parquet(path), offsets)
    return tables.hex_view(store.read(BALANCES))


DAILY = views.View("daily", analytics.daily_partials, ["day", "sent", "who"], finish=analytics.daily_totals, definition="daily_stats")


@query(ORACLE_SQL["daily_stats"])
def view_daily_stats(spark, sf):
    """Exact distinct counts as a view: a backfill of one half, and two streams at once with a quarter of the transfers each,
    so most addresses are met by all three."""
    store, (old, new) = views.ViewStore(spark, scratch_path(spark, "views")), _halves(spark, sf)
    store.create(DAILY, old)
    new = new.select("block_num", "block_timestamp", "selector", "topic1", "topic2", "data")  # what the view reads, of every transfer
    arrivals = []
    for part in (new.where("block_num % 4 = 1"), new.where("block_num % 4 = 3")):
        arrivals.append((scratch_path(spark, "arrivals"), scratch_path(spark, "offsets")))
        part.write.parquet(arrivals[-1][0])
    with ThreadPoolExecutor(2) as pool:
        list(pool.map(lambda at: store.follow(DAILY, spark.readStream.schema(new.schema).parquet(at[0]), at[1]), arrivals))
    return store.read(DAILY)


@query(f"""SELECT count(*) AS rows, CAST(sum(v) AS BIGINT) AS total FROM (SELECT l_returnflag, h, sum(v) AS v FROM (SELECT l_returnflag, 100000 + l_partkey AS h, {PRICE} AS v FROM lineitem
        UNION ALL SELECT l_returnflag, l_suppkey, -{PRICE} FROM lineitem) GROUP BY 1, 2)""")
def view_backfill(spark, sf):
    store = views.ViewStore(spark, scratch_path(spark, "views"))
    n = store.create(BALANCES, fixtures.transfers(spark, sf))
    total = store.state(BALANCES).agg(F.sum(F.col("l0") + F.col("l1") * (1 << 32)).alias("total"))
    return total.select(F.lit(n).cast("long").alias("rows"), "total")


def _bucketed_balances(size: int) -> views.View:
    """Balances with a partial per stretch of blocks, so that blocks can be taken back."""
    sums = [F.sum(c).alias(c) for c in words.limb_columns()]
    return views.View(
        "bucketed", lambda df: analytics.balances(df.withColumn("bucket", F.floor(F.col("block_num") / size)), ("bucket",)), ["address", "holder", "bucket"],
        finish=lambda df: BALANCES.finish(df.groupBy("address", "holder").agg(*sums)), definition="token_holders by stretch of blocks",
    )


@query(f"""SELECT token, holder, CAST(CAST(sum(v) AS BIGINT) AS VARCHAR) AS balance FROM (SELECT {a(TOKEN6)} AS token, {a('100000 + l_partkey')} AS holder, {PRICE} AS v FROM lineitem WHERE l_orderkey < 777
        UNION ALL SELECT {a(TOKEN6)}, {a('l_suppkey')}, -{PRICE} FROM lineitem WHERE l_orderkey < 777) GROUP BY 1, 2 HAVING sum(v) > 0""")
def view_rollback(spark, sf):
    """All transfers in two batches, then the blocks from 777 on are taken back."""
    view, (old, new) = _bucketed_balances(500), _halves(spark, sf)
    store = views.ViewStore(spark, scratch_path(spark, "views"))
    store.create(view, old)
    store.update(view, new, "1")
    store.rollback(view, fixtures.transfers(spark, sf), 777, 500)
    return tables.hex_view(store.read(view))


def _type_state(df: DataFrame) -> DataFrame:
    return df.groupBy("type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("long")).alias("total"))


@query(f"SELECT {TYPE} AS type, count(*) AS n, CAST(sum({VALUE}) AS BIGINT) AS total FROM events GROUP BY 1")
def merge_summing(spark, sf):
    t = fixtures.txs(spark, sf)
    return views.merge_summing([_type_state(t.where("block_num < 3")), _type_state(t.where("block_num >= 3"))], ["type"])


@query(f"SELECT {TYPE} AS type, count(*) AS n, min({VALUE}) AS least, max({VALUE}) AS most, count(DISTINCT user_id) AS senders, true AS near FROM events GROUP BY 1")
def merge_aggregating(spark, sf):
    """The sketch of distinct senders must be within a tenth of the exact count."""
    t = fixtures.txs(spark, sf)

    def part(df):
        v = F.col("value").cast("long")
        return df.groupBy("type").agg(F.count("*").alias("n"), F.min(v).alias("least"), F.max(v).alias("most"), F.hll_sketch_agg("from").alias("senders"))

    merged = views.merge_aggregating({"n": "sum", "least": "min", "most": "max", "senders": "sketch"})([part(t.where("block_num < 3")), part(t.where("block_num >= 3"))], ["type"])
    exact = t.groupBy(F.col("type").alias("__t")).agg(F.count_distinct("from").alias("e"))
    both = merged.join(exact, F.col("type") == F.col("__t"))
    return both.select("type", "n", "least", "most", F.col("e").alias("senders"), (F.abs(F.hll_sketch_estimate("senders") - F.col("e")) <= F.col("e") / 10).alias("near"))


@query(f"""SELECT user_id, max(event_id) AS last_event FROM events GROUP BY 1""")
def merge_replacing(spark, sf):
    e = fixtures.read(spark, sf, "events")
    last = lambda df: df.groupBy("user_id").agg(F.max("event_id").alias("last_event"))
    return views.merge_replacing([last(e.where("event_id < 500")), last(e.where("event_id >= 500"))], ["user_id"])


@query(f"SELECT {BLOCK} AS block_num, count(*) AS n FROM events GROUP BY 1")
def merge_append(spark, sf):
    t = fixtures.txs(spark, sf)
    per = lambda df: df.groupBy("block_num").agg(F.count("*").alias("n"))
    return views.merge_append([per(t.where("block_num < 3")), per(t.where("block_num >= 3"))], ["block_num"])


@query(f"SELECT {TYPE} AS type, count(*) AS n FROM events GROUP BY 1")
def view_refresh(spark, sf):
    """A snapshot view of too few rows, then recomputed from all."""
    view, t = views.View("by_type", analytics.txs_by_type, ["type"], definition="txs_by_type"), fixtures.txs(spark, sf)
    store = views.ViewStore(spark, scratch_path(spark, "views"))
    store.create(view, t.where("block_num = 0"))
    store.refresh(view, t, "nightly")
    return store.read(view)


@query(f"SELECT 'by_type' AS name, 'txs_by_type' AS definition, '[\"type\"]' AS keys, count(DISTINCT event_type) AS rows FROM events")
def list_views(spark, sf):
    """Two views are made and one is dropped."""
    t = fixtures.txs(spark, sf)
    one, two = views.View("by_type", analytics.txs_by_type, ["type"], definition="txs_by_type"), views.View("senders", analytics.unique_senders, [])
    store = views.ViewStore(spark, scratch_path(spark, "views"))
    store.create(one, t)
    store.create(two, t)
    store.drop(two)
    return store.list_views().select("name", "definition", "keys", "rows")


# ---- streaming


def _arrivals(spark, sf, after: int = -1) -> DataFrame:
    """A3 (from the block after `after` on) in files by stretch of blocks, as a stream of one file a micro-batch."""
    path = scratch_path(spark, "txs")
    t = fixtures.txs(spark, sf).select("block_num", "block_timestamp", "idx", "type").where(F.col("block_num") > after)
    t.repartitionByRange(4, "block_num").write.parquet(path)
    return spark.readStream.schema(t.schema).option("maxFilesPerTrigger", 1).parquet(path)


@query(f"SELECT {BLOCK} AS block_num, {TYPE} AS type, count(*) AS n FROM events GROUP BY 1, 2")
def live_query(spark, sf):
    """The blocks that are there are answered in full at first, the others as they arrive."""
    out, t = scratch_path(spark, "live"), fixtures.txs(spark, sf)
    half = (t.agg(F.max("block_num")).first()[0] or 0) // 2
    live.live_query(_arrivals(spark, sf, half), lambda rows: rows.groupBy("block_num", "type").agg(F.count("*").alias("n")), out, out + "-offsets", table=t.where(F.col("block_num") <= half))
    return live.results(spark, out)


@query(f"""WITH b AS (SELECT {BLOCK} AS block_num, count(*) AS n, max({BLOCK}) OVER () AS top FROM events GROUP BY 1) SELECT 'block' AS kind, block_num, n FROM b WHERE block_num > top - 4
        UNION ALL SELECT 'lagged', NULL, max(top) - 4 + 1 FROM b""")
def live_catchup(spark, sf):
    """All blocks arrive in one batch; the newest four are served, and a row says how many were left out."""
    path, out = scratch_path(spark, "txs"), scratch_path(spark, "live")
    t = fixtures.txs(spark, sf).select("block_num", "idx")
    t.write.parquet(path)
    live.live_query(spark.readStream.schema(t.schema).parquet(path), lambda rows: rows.groupBy("block_num").agg(F.count("*").alias("n")), out, out + "-offsets", newest=4)
    served = live.results(spark, out).select(F.lit("block").alias("kind"), "block_num", "n")
    return served.unionByName(live.lagged(spark, out).select(F.lit("lagged").alias("kind"), F.lit(None).cast("long").alias("block_num"), F.col("skipped").alias("n")))


@query(f"""SELECT CAST(5 AS BIGINT) AS chain_id, o_orderkey AS num, {w('o_orderkey + 1')} AS hash, coalesce(n, 0) AS tx_count, coalesce(n, 0) AS log_count, CAST(o_orderdate AS TIMESTAMP) AS timestamp
        FROM orders LEFT JOIN (SELECT {BLOCK} AS b, count(*) AS n FROM events GROUP BY 1) ON b = o_orderkey""", stamps=("timestamp",))
def block_updates(spark, sf):
    return tables.hex_view(live.block_updates(fixtures.blocks(spark, sf), fixtures.txs(spark, sf), fixtures.logs(spark, sf), 5))


@query(f"SELECT time_bucket(INTERVAL 1 HOUR, {TS}) AS window_start, count(*) AS n, count(*) / 3600.0 AS per_second FROM events GROUP BY 1", stamps=("window_start",))
def progress_rate(spark, sf):
    """Hourly windows over the stream; each micro-batch updates the windows it touches, and the last update counts."""
    out = scratch_path(spark, "rate")
    rate = live.progress_rate(_arrivals(spark, sf), "block_timestamp", 3600, late="60 days")

    def keep(rows: DataFrame, batch: int) -> None:
        rows.withColumn("version", F.lit(batch)).write.mode("overwrite").parquet(f"{out}/batch={batch}")

    rate.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", out + "-offsets").trigger(availableNow=True).start().awaitTermination()
    return maintain.dedup_latest(spark.read.parquet(out).drop("batch"), ["window_start"], F.col("version")).drop("version")


def _reorganised(spark, sf) -> reorg.Followed:
    """The transactions of all blocks, of which the last three are delivered twice: first on a branch that loses, then, with
    other hashes and values, on the one that wins. Their headers come as three files, a micro-batch each; the winning ones
    from the top down."""
    landed, t = scratch_path(spark, "landed"), fixtures.txs(spark, sf).select("block_num", "idx", "type", "value")
    top = t.agg(F.max("block_num")).first()[0] or 0
    n, lost, won = F.col("block_num"), F.lit(b"\x01"), F.lit(b"\x02")
    digest = lambda c, by: F.concat(by, F.substring(words.word_of_long(c), 2, 31))
    other = t.where(n > top - 3).withColumn("value", (F.col("value").cast("long") + 1).cast("string")).withColumn("block_hash", digest(n, won))
    t.withColumn("block_hash", digest(n, lost)).unionByName(other).write.parquet(f"{landed}/txs")
    delivered = spark.read.parquet(f"{landed}/txs")
    for seq, (low, by) in enumerate([(0, lost), (max(0, top - 5), lost), (top - 2, won)]):
        high = max(0, top - 5) - 1 if seq == 0 else top
        numbers = t.select("block_num").distinct().where(n.between(low, high))
        parent = digest(n - 1, F.when(n - 1 > top - 3, by).otherwise(lost))
        header = numbers.select(F.lit(1).cast("long").alias("chain_id"), n.alias("num"), digest(n, by).alias("hash"), parent.alias("parent_hash"), (F.lit(seq * 10**9) - (n if seq == 2 else F.lit(0))).cast("long").alias("seq"))
        header.coalesce(1).write.mode("append").parquet(f"{landed}/headers")
    stream = spark.readStream.schema("chain_id long, num long, hash binary, parent_hash binary, seq long").option("maxFilesPerTrigger", 1).parquet(f"{landed}/headers")
    store, size = views.ViewStore(spark, scratch_path(spark, "views")), 100
    schema = t.schema
    totals = views.View("totals", lambda df: df.groupBy("bucket", "type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("long")).alias("total")), ["bucket", "type"], definition="txs by type and stretch of blocks")
    followed = reorg.Followed(scratch_path(spark, "followed"), store, {"txs": (delivered, "block_num", schema)}, {"counts": (lambda df: df.groupBy("block_num").agg(F.count("*").alias("n")), "txs")}, ((totals, "txs"),), size)
    store.create(totals, maintain.stored(spark, followed.path("txs"), schema))
    reorg.follow_chain(stream, followed, scratch_path(spark, "offsets"))
    return followed


_WON = f"{VALUE} + CASE WHEN {BLOCK} > (SELECT max({BLOCK}) FROM events) - 3 THEN 1 ELSE 0 END"


@query(f"SELECT {BLOCK} AS block_num, count(*) AS n, CAST(sum({_WON}) AS BIGINT) AS total, count(*) AS live FROM events GROUP BY 1")
def reorg_stream(spark, sf):
    """Stored transactions and live counts after a fork of depth 3 are those of the winning chain alone."""
    followed = _reorganised(spark, sf)
    kept = followed.table(spark, "txs").groupBy("block_num").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("long")).alias("total"))
    counts = spark.read.parquet(followed.path("counts")).select(F.col("block_num").alias("b"), F.col("n").alias("live"))
    return kept.join(counts, F.col("block_num") == F.col("b"), "full").drop("b")


@query(f"SELECT {TYPE} AS type, count(*) AS n, CAST(sum({_WON}) AS BIGINT) AS total FROM events GROUP BY 1")
def reorg_view(spark, sf):
    """The view that the same stream keeps."""
    followed = _reorganised(spark, sf)
    return followed.store.read(followed.views[0][0]).groupBy("type").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


@query(f"""WITH w AS (SELECT time_bucket(INTERVAL 1 HOUR, {TS}) AS window_start, count(*) AS n, min({BLOCK}) AS lo, max({BLOCK}) AS hi FROM events GROUP BY 1)
        SELECT window_start, n, n / 3600.0 AS per_second, 1000000 - hi AS remaining, (1000000 - hi) * 3600.0 / (hi - lo + 1) AS eta_seconds FROM w""", stamps=("window_start",))
def progress_eta(spark, sf):
    """Hourly rates with the time that is left to block 1,000,000."""
    out = scratch_path(spark, "rate")
    rate = live.progress_rate(_arrivals(spark, sf), "block_timestamp", 3600, late="60 days", block="block_num", target=1_000_000)

    def keep(rows: DataFrame, batch: int) -> None:
        rows.withColumn("version", F.lit(batch)).write.mode("overwrite").parquet(f"{out}/batch={batch}")

    rate.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", out + "-offsets").trigger(availableNow=True).start().awaitTermination()
    return maintain.dedup_latest(spark.read.parquet(out).drop("batch"), ["window_start"], F.col("version")).drop("version")


# ---- export


@query(f"""SELECT o_orderkey AS num, '{{"num":' || o_orderkey || ',"hash":"' || {w('o_orderkey + 1')} || '","timestamp":"' || strftime(CAST(o_orderdate AS TIMESTAMP), '%Y-%m-%dT%H:%M:%S.000Z') || '","gas":"' || {cents('o_totalprice')} || '","extra_data":null}}' AS json FROM orders""")
def export_json(spark, sf):
    b = fixtures.blocks(spark, sf).select("num", "hash", "timestamp", F.col("gas_used").cast("decimal(38,0)").alias("gas"), "extra_data")
    return export.export_json(b).select(F.get_json_object("json", "$.num").cast("long").alias("num"), "json")


@query(f"""SELECT CAST(o_orderkey AS VARCHAR) AS num, {w('o_orderkey + 1')} AS hash, 'a "b", ' || o_orderpriority AS note, 'NULL' AS extra FROM orders""")
def export_csv(spark, sf):
    path = scratch_path(spark, "csv")
    b = fixtures.read(spark, sf, "orders").select(F.col("o_orderkey").alias("num"), words.word_of_long(F.col("o_orderkey") + 1).alias("hash"), F.concat(F.lit('a "b", '), F.col("o_orderpriority")).alias("note"), F.lit(None).cast("binary").alias("extra"))
    export.export_csv(b, path)
    return spark.read.schema("num string, hash string, note string, extra string").option("header", "true").option("escape", '"').csv(path)


@query(f"SELECT {a('o_custkey')} AS miner, count(*) AS n, true AS refused FROM orders GROUP BY 1")
def row_cap(spark, sf):
    """All blocks are one too many for a cap below their number, and reading them is refused; the blocks of each miner fit."""
    b = fixtures.blocks(spark, sf)
    try:
        export.row_cap(b, b.count() - 1).write.format("noop").mode("overwrite").save()
        refused = False
    except PySparkException as e:
        if "more than" not in str(e):
            raise
        refused = True
    miners = analytics.blocks_by_miner(b)
    return tables.hex_view(export.row_cap(miners, miners.count()).withColumn("refused", F.lit(refused)))
