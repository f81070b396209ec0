import datetime

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions.abi import TRANSFER
from ledgerloom.operators import analytics, maintain
from ledgerloom.plans import views
from ledgerloom.schema import TABLES
from ledgerloom.sources import export, fixtures, tables
from ledgerloom.streaming import live


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_replace_touches_only_delivered_blocks(spark):
    t = spark.createDataFrame([(b, i, "old") for b in range(1, 8) for i in range(2)], "block_num long, idx int, v string")
    batch = spark.createDataFrame([(2, 0, "new"), (5, 0, "new")], t.schema)
    out = maintain.replace_blocks(t, batch, spark.createDataFrame([(6,)], "block_num long"))
    assert rows(out.where("v = 'new'")) == [(2, 0, "new"), (5, 0, "new")]
    assert {r.block_num for r in out.where("v = 'old'").collect()} == {1, 3, 4, 7}
    assert rows(maintain.replace_blocks(out, batch)) == rows(out)


def test_stored_replace_leaves_other_buckets(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(maintain, "BUCKET", 10)
    path, work = str(tmp_path / "t"), str(tmp_path / "w")
    first = spark.createDataFrame([(b, 0) for b in range(40)], "block_num long, v int")
    maintain.store_replace(spark, path, first, "block_num", work)
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "t").rglob("*.parquet") if "bucket=3" in str(p)}
    maintain.store_replace(spark, path, spark.createDataFrame([(12, 1)], first.schema), "block_num", work)
    assert rows(maintain.stored(spark, path, first.schema).drop("bucket")) == [(b, int(b == 12)) for b in range(40)]
    assert before and all(p.stat().st_mtime_ns == t for p, t in before.items())


def test_stored_blocks_that_come_again_empty(spark, tmp_path):
    path, work = str(tmp_path / "t"), str(tmp_path / "w")
    t = spark.createDataFrame([(b, 0) for b in range(40)], "block_num long, v int")
    maintain.store_replace(spark, path, t, "block_num", work, size=10)
    gone = spark.createDataFrame([(b,) for b in [3, *range(20, 30)]], "n long")
    for _ in range(2):
        maintain.store_replace(spark, path, spark.createDataFrame([(12, 1)], t.schema), "block_num", work, gone, size=10)
        assert rows(maintain.stored(spark, path, t.schema).drop("bucket")) == [(b, int(b == 12)) for b in range(40) if b != 3 and not 20 <= b < 30]
    assert not (tmp_path / "t" / "bucket=2").exists()


def test_stored_rollback_and_reinsert(spark, tmp_path):
    path, work = str(tmp_path / "t"), str(tmp_path / "w")
    t = spark.createDataFrame([(b, i) for b in range(40) for i in range(2)], "num long, i int")
    maintain.save_buckets(t, path, "num", 10)
    assert maintain.store_rollback(spark, path, t.schema, "num", 15, work, 10) == 25
    assert rows(maintain.stored(spark, path, t.schema).drop("bucket")) == [(b, i) for b in range(15) for i in range(2)]
    assert maintain.store_rollback(spark, path, t.schema, "num", 15, work, 10) == 0
    maintain.store_replace(spark, path, t.where("num >= 15"), "num", work, size=10)
    assert rows(maintain.stored(spark, path, t.schema).drop("bucket")) == rows(t)
    assert maintain.store_rollback(spark, path, t.schema, "num", 0, work, 10) == 40
    assert not list((tmp_path / "t").glob("bucket=*"))


def test_a_copy_converges_under_replays(spark, tmp_path):
    source, root = str(tmp_path / "chain"), str(tmp_path / "copy")
    there = lambda: sorted(r.num for r in maintain.read_committed(spark, root, "blocks").collect())

    def grow(lo, hi):
        for name in TABLES:
            df = maintain.conform(spark.range(lo, hi + 1).withColumnRenamed("id", maintain.BLOCK_COLUMN[name]), TABLES[name])
            maintain.save_buckets(df, f"{source}/{name}", maintain.BLOCK_COLUMN[name], 5)

    copy = lambda checkpoint, **k: maintain.copy_range(spark, source, root, str(tmp_path / checkpoint), **k)
    grow(1, 7)
    assert copy("a", after=0) == 7 and there() == list(range(1, 8))
    grow(5, 10)  # the bucket of 5 to 9 has grown
    assert copy("a", after=0, files=1) == 10 and there() == list(range(1, 11))
    assert copy("a", after=0) == 10 and copy("b", after=0) == 10  # nothing new, and all of it anew
    grow(10, 13)
    assert copy("b", after=0) == 13 and there() == list(range(1, 14))
    assert maintain.read_committed(spark, root, "logs").count() == 13


def test_a_batch_is_seen_in_all_tables_or_none(spark, tmp_path):
    root = str(tmp_path / "r")
    assert maintain.read_committed(spark, root, "receipts").count() == 0
    rows = spark.createDataFrame([(1,)], "block_num long")
    batch = {name: maintain.conform(rows, TABLES[name]) for name in ("receipts", "txs")}
    maintain.write_batch(root, "one", batch)
    broken = dict(batch, txs=batch["txs"].withColumn("value", F.raise_error(F.lit("no")).cast("string")))
    with pytest.raises(Exception, match="no"):
        maintain.write_batch(root, "two", broken)
    assert maintain.read_committed(spark, root, "receipts").count() == 1
    maintain.write_batch(root, "one", batch)  # again: no second copy
    assert maintain.read_committed(spark, root, "receipts").count() == maintain.read_committed(spark, root, "txs").count() == 1


def test_clustered_files_prune_by_month(spark, sf, tmp_path):
    path = str(tmp_path / "c")
    maintain.write_clustered(fixtures.transfers(spark, sf), path, "block_timestamp", ["address", "block_num"], ["selector"])
    plan = spark.read.parquet(path).where("month = '1998-01'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan


def test_interleaved_files_are_skipped_on_every_column(spark, tmp_path):
    """Rows that the scan reads, by its own metric, against all: a filter on any of the four columns reads a part only, also
    on one whose values have no order, where only bloom filters can tell."""
    from ledgerloom.functions.words import word_of_long

    n, path = 40_000, str(tmp_path / "z")
    k = F.col("id")
    mix = lambda m: word_of_long(F.pmod(F.xxhash64(k, F.lit(m)), F.lit(1000)))
    df = spark.range(n).select(*[mix(i).alias(c) for i, c in enumerate(("selector", "address", "topic1"))], F.unhex(F.sha2(k.cast("string"), 256)).alias("topic2"), k.alias("log_idx"))
    maintain.write_interleaved(df, path, ["selector", "address", "topic1", "topic2"])
    row = df.where("log_idx = 777").first()
    for c in ("selector", "address", "topic1", "topic2"):
        hit = spark.read.parquet(path).where(F.col(c) == F.lit(bytes(row[c])))
        got = hit.collect()
        read = hit._jdf.queryExecution().executedPlan().collectLeaves().apply(0).metrics().apply("numOutputRows").value()
        assert row in got and len(got) == df.where(F.col(c) == F.lit(bytes(row[c]))).count()
        assert read <= n / (2 if c != "topic2" else 10), (c, read)


def test_colocated_tables_join_without_exchange(spark, sf):
    from ledgerloom.plans import catalog

    had = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        txs, receipts = catalog._colocated(spark, sf)
        for both in (tables.enrich_txs(txs, receipts), analytics.receipt_mismatch(txs, receipts)):
            plan = both._jdf.queryExecution().executedPlan().toString()
            below = plan[plan.index("SortMergeJoin"):]
            assert "Exchange" not in below and below.count("Bucketed: true") == 2, plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", had)


def test_interleaving_takes_nulls_and_ties(spark):
    df = spark.createDataFrame([(None, 1), (bytearray(b"a"), None), (bytearray(b"a"), 2), (bytearray(b"b"), 3)], "x binary, y int")
    points = maintain.cut_points(df, ["x", "y"], 2)
    got = [r.z for r in df.select(maintain.interleaved(points, 2).alias("z")).collect()]
    assert len(got) == 4 and min(got) >= 0 and max(got) < 16 and got[3] == max(got)
    assert maintain.cut_points(df.where("false"), ["x"], 2) == {"x": []}


def test_rollback_and_reinsert(spark, sf):
    b = fixtures.blocks(spark, sf)
    kept, removed = maintain.rollback_from({"blocks": b}, 1000)
    assert removed.first()[0] == b.where("num >= 1000").count() and kept["blocks"].agg(F.max("num")).first()[0] == 999
    again = maintain.insert_ignore(kept["blocks"], b, ["num"])
    assert again.count() == b.count()


def test_enrich_overwrites_with_a_matched_null(spark):
    t = spark.createDataFrame([(1, 0, 5, bytearray(b"a")), (1, 1, 6, bytearray(b"b"))], "block_num long, idx int, gas_used long, fee_payer binary")
    r = spark.createDataFrame([(1, 0, 9, None)], "block_num long, tx_idx int, gas_used long, fee_payer binary")
    assert rows(tables.enrich_txs(t, r)) == [(1, 0, 9, None), (1, 1, 6, bytearray(b"b"))]


def test_short_topics_and_receipts_without_block(spark):
    payload = '[{"blockNumber":"0x1","transactionIndex":"0x0","transactionHash":"0x01","logs":[{"logIndex":"0x0","address":"0x02","topics":["0x03"],"data":"0x"}]},{"blockNumber":"0x9","transactionIndex":"0x0","transactionHash":"0x01","logs":[]}]'
    p = spark.createDataFrame([(payload,)], "payload string")
    b = spark.createDataFrame([(1,)], "num long").withColumn("timestamp", F.timestamp_seconds(F.lit(5)))
    log = tables.normalize_logs(p, b).collect()
    assert len(log) == 1 and (bytes(log[0].selector), log[0].topic1, bytes(log[0].data)) == (b"\3", None, b"")
    assert tables.normalize_receipts(p, b).count() == 1


def test_supply_beyond_64_bits(spark):
    from ledgerloom.functions.abi import TRANSFER

    w = lambda k: bytearray(k.to_bytes(32, "big"))
    one = 10**18
    data = [(w(0), w(5), w(1000 * one)), (w(5), w(0), w(100 * one)), (w(5), w(6), w(7))]
    logs = spark.createDataFrame([(bytearray(b"t" * 20), bytearray(TRANSFER.topic), a, b, d) for a, b, d in data], "address binary, selector binary, topic1 binary, topic2 binary, data binary")
    assert analytics.token_supply(logs).first().supply == str(900 * one)


def test_views_are_idempotent_and_keep_negative_deltas(spark, tmp_path):
    store = views.ViewStore(spark, str(tmp_path))
    view = views.View("net", lambda df: df.groupBy("k").agg(F.sum("v").alias("v")), ["k"], finish=lambda df: df.where("v > 0"))
    batch = lambda *x: spark.createDataFrame(list(x), "k string, v long")
    assert store.create(view, batch(("a", 5), ("b", -3))) == 2
    with pytest.raises(ValueError):
        store.create(view, batch())
    assert rows(store.read(view)) == [("a", 5)]
    assert store.update(view, batch(("b", 7), ("a", -5)), "1") and not store.update(view, batch(("b", 7)), "1")
    assert rows(store.read(view)) == [("b", 4)]
    assert store.describe("net").first().rows == 2
    store.drop(view)
    assert store.list_views().isEmpty()
    with pytest.raises(KeyError):
        store.read(view)
    assert store.create(view, batch(("c", 1))) == 1 and store.update(view, batch(("c", 1)), "1")
    assert rows(store.read(view)) == [("c", 2)]


def test_distinct_counts_are_exact_as_state(spark, tmp_path):
    """Addresses that several batches and writers meet, on both sides and on two days, count once a day and side; a missing
    topic counts for nobody; the state may be folded in between."""
    day = lambda d: datetime.datetime(2024, 5, d)
    w = lambda n: None if n is None else bytearray(n.to_bytes(32, "big"))
    schema = "block_timestamp timestamp, selector binary, topic1 binary, topic2 binary, data binary"
    batch = lambda *x: spark.createDataFrame([(day(d), bytearray(TRANSFER.topic), w(a), w(b), w(v)) for d, a, b, v in x], schema)
    first, second, third = batch((1, 7, 8, 2**255), (1, 8, 7, 1)), batch((1, 7, 9, 2**255), (2, 7, 7, 5)), batch((1, 7, 8, 3), (2, 9, None, 0))
    store = views.ViewStore(spark, str(tmp_path))
    view = views.View("daily", analytics.daily_partials, ["day", "sent", "who"], finish=analytics.daily_totals)
    store.create(view, first)
    assert store.update(view, second, "one") and store.update(view, third, "two") and not store.update(view, third, "two")
    want = [(datetime.date(2024, 5, 1), 4, 2, 3, str(2**256 + 4)), (datetime.date(2024, 5, 2), 2, 2, 1, "5")]
    assert rows(store.read(view)) == want == rows(analytics.daily_stats(first.union(second).union(third)))
    store.fold(view)
    assert rows(store.read(view)) == want
    assert rows(analytics.daily_totals(analytics.daily_partials(first.limit(0)))) == []


def test_daily_state_has_one_number_a_row(spark):
    """Addresses are nearly as many as transfers, so they carry no sums; those of a day are eight rows of their own."""
    w = lambda n: bytearray(n.to_bytes(32, "big"))
    logs = spark.createDataFrame([(datetime.datetime(2024, 5, 1), bytearray(TRANSFER.topic), w(7), w(k % 5), w(2**224 + 2**32 * k)) for k in range(40)], "block_timestamp timestamp, selector binary, topic1 binary, topic2 binary, data binary")
    state = analytics.daily_partials(logs)
    assert state.columns == ["day", "sent", "who", "n"] and state.where("sent is null").count() == 8 and state.count() == 8 + 1 + 5
    assert rows(analytics.daily_totals(state)) == rows(analytics.daily_stats(logs)) == [(datetime.date(2024, 5, 1), 40, 1, 5, str(40 * 2**224 + 2**32 * 780))]


def test_many_stored_rows_are_dealt_before_they_are_merged(spark, tmp_path, monkeypatch):
    store = views.ViewStore(spark, str(tmp_path))
    view = views.View("net", lambda df: df.groupBy("k").agg(F.sum("v").alias("v")), ["k"])
    batch = lambda lo, hi: spark.range(lo, hi).select(F.nullif("id", F.lit(7)).alias("k"), F.lit(1).cast("long").alias("v"))
    store.create(view, batch(0, 60))
    store.update(view, batch(0, 40), "1")
    whole = rows(store.read(view).fillna(-1))
    plan = lambda: store.state(view)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" not in plan()
    monkeypatch.setattr(views, "MERGED", 30)
    assert plan().count("Exchange") == 1 and "REPARTITION_BY_NUM" in plan()
    assert rows(store.read(view).fillna(-1)) == whole and len(whole) == 60 and sum(v for _, v in whole) == 100


def test_a_view_follows_two_streams(spark, tmp_path):
    store = views.ViewStore(spark, str(tmp_path / "v"))
    view = views.View("net", lambda df: df.groupBy("k").agg(F.sum("v").alias("v")), ["k"])
    batch = lambda v: spark.createDataFrame([("a", v)], "k string, v long")
    store.create(view, batch(1))
    for name, v in (("one", 10), ("two", 20)):
        batch(v).write.parquet(str(tmp_path / name))
    for name in ("one", "two", "one"):
        store.follow(view, spark.readStream.schema("k string, v long").parquet(str(tmp_path / name)), str(tmp_path / f"{name}-offsets"))
    assert rows(store.read(view)) == [("a", 31)]


def test_partials_are_folded_and_batches_in_them_stay_known(spark, tmp_path):
    store = views.ViewStore(spark, str(tmp_path))
    view = views.View("net", lambda df: df.groupBy("k").agg(F.sum("v").alias("v")), ["k"], definition="it's \\ quoted")
    one = lambda v: spark.createDataFrame([("a", v)], "k string, v long")
    store.create(view, one(1))
    for i in range(3):
        store.update(view, one(10 ** (i + 1)), "stream", i)
    store.fold(view)
    assert rows(store.read(view)) == [("a", 1111)]
    assert spark.table(f"{store.db}.net").count() == 1
    assert not store.update(view, one(1000), "stream", 2) and store.update(view, one(10000), "stream", 3)
    store.fold(view)
    assert rows(store.read(view)) == [("a", 11111)]
    assert store.describe("net").first().definition == "it's \\ quoted"
    store.refresh(view, one(5), "nightly")
    assert rows(store.read(view)) == [("a", 5)] and len(list(tmp_path.glob("net-*"))) == 1


def test_writers_at_once(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    store = views.ViewStore(spark, str(tmp_path / "v"))
    view = views.View("net", lambda df: df.groupBy("k").agg(F.sum("v").alias("v")), ["k"])
    store.create(view, spark.createDataFrame([("a", 0)], "k string, v long"))
    frames = [spark.createDataFrame([("a", 10**i)], "k string, v long") for i in range(3)]
    with ThreadPoolExecutor(3) as pool:
        assert all(pool.map(lambda x: store.update(view, x[1], f"writer{x[0]}"), enumerate(frames)))
    assert rows(store.read(view)) == [("a", 111)]


def test_the_later_row_replaces_in_a_view(spark, tmp_path):
    store = views.ViewStore(spark, str(tmp_path))
    view = views.View("last", lambda df: df, ["k"], merge=views.merge_replacing)
    store.create(view, spark.createDataFrame([("a", 9), ("b", 1)], "k string, v int"))
    store.update(view, spark.createDataFrame([("a", 2)], "k string, v int"), "1")
    assert rows(store.read(view)) == [("a", 2), ("b", 1)]


def test_replacing_takes_the_new_row(spark):
    old = spark.createDataFrame([("a", 9), ("b", 1)], "k string, v int")
    assert rows(views.merge_replacing([old, spark.createDataFrame([("a", 2)], old.schema)], ["k"])) == [("a", 2), ("b", 1)]


def test_live_query_goes_on_from_its_checkpoint(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    df = lambda blocks: spark.createDataFrame([(b, i) for b in blocks for i in range(b)], "block_num long, i int")
    run = lambda: live.live_query(spark.readStream.schema("block_num long, i int").parquet(src), lambda x: x.groupBy("block_num").count(), out, out + "-c")
    df([1, 2]).write.parquet(src)
    run()
    run()
    assert rows(live.results(spark, out)) == [(1, 1), (2, 2)]
    df([3]).write.mode("append").parquet(src)
    run()
    assert rows(live.results(spark, out)) == [(1, 1), (2, 2), (3, 3)]


def test_live_query_begins_with_its_full_result(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    df = lambda blocks: spark.createDataFrame([(b, i) for b in blocks for i in range(b)], "block_num long, i int")
    df([3]).write.parquet(src)
    for table in ([1, 2], [9]):  # what is there counts at the first call only
        live.live_query(spark.readStream.schema("block_num long, i int").parquet(src), lambda x: x.groupBy("block_num").count(), out, out + "-c", table=df(table))
    assert rows(live.results(spark, out)) == [(1, 1), (2, 2), (3, 3)]


def test_scratch_needs_a_shared_folder_on_a_cluster():
    from types import SimpleNamespace

    from ledgerloom.sources.scratch import shared_dir

    conf = SimpleNamespace(get=lambda k, d: None)
    with pytest.raises(RuntimeError):
        shared_dir(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://host:7077")))


def test_nothing_is_answered_yet(spark, tmp_path):
    assert live.results(spark, str(tmp_path), "block_num long, n long").collect() == live.lagged(spark, str(tmp_path)).collect() == []


def test_a_live_query_stays_open(spark, tmp_path):
    import time

    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    df = lambda b: spark.createDataFrame([(b, 0)], "block_num long, i int")
    df(1).write.parquet(src)
    running = live.live_query(spark.readStream.schema("block_num long, i int").parquet(src), lambda x: x.groupBy("block_num").count(), out, out + "-c", forever=True)
    try:
        running.processAllAvailable()
        assert rows(live.results(spark, out)) == [(1, 1)]
        df(2).write.mode("append").parquet(src)
        for _ in range(60):
            running.processAllAvailable()
            if live.results(spark, out).count() == 2:
                break
            time.sleep(0.5)
        assert rows(live.results(spark, out)) == [(1, 1), (2, 1)] and running.isActive
    finally:
        running.stop()


def test_export_and_cap(spark):
    df = spark.createDataFrame([(bytearray(b"\1"), None)], "b binary, n long")
    assert export.export_json(df).first()[0] == '{"b":"0x01","n":null}'
    with pytest.raises(Exception, match="more than 10 rows"):
        export.row_cap(spark.range(11), 10).collect()
    assert export.row_cap(spark.range(10), 10).count() == 10 and export.row_cap(spark.range(3), 10).columns == ["id"]
    assert export.limited(spark.range(20_000)).count() == 10_000 and export.limited(spark.range(20), 7).count() == 7 and export.limited(spark.range(20_000), 20_000).count() == 10_000


def test_the_cap_reads_its_source_once(spark, sf):
    plan = export.row_cap(fixtures.read(spark, sf, "orders"), 10)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1


def test_a_large_cap_leaves_rows_dealt(spark, monkeypatch):
    monkeypatch.setattr(export, "STRETCH", 64)
    df = spark.range(0, 1000, 1, 3).select(F.col("id"), F.lit("x").alias("a.b"))
    capped = export.row_cap(df, 1000)
    assert "SinglePartition" not in capped._jdf.queryExecution().executedPlan().toString() and capped.columns == df.columns
    assert sorted(r.id for r in capped.collect()) == list(range(1000)) and export.row_cap(spark.range(65), 65).count() == 65
    for cap in (100, 334, 999):  # a task alone has more, or all of them together
        with pytest.raises(Exception, match=f"more than {cap} rows"):
            export.row_cap(df, cap).collect()
    assert [r.id for r in export.row_cap(spark.range(60).orderBy(F.desc("id")), 64).collect()] == list(range(59, -1, -1))


def test_a_small_bucket_is_one_file(spark, tmp_path):
    rows = spark.range(0, 4000, 1, 4).select(F.col("id").alias("n"))
    for name, small in (("t", None), ("s", 40)):
        path = str(tmp_path / name)
        maintain.save_buckets(rows, path, "n", 100, small)
        assert sorted(len(list(b.glob("*.parquet"))) for b in (tmp_path / name).glob("bucket=*")) == [1] * 40
        assert maintain.stored_buckets(spark, path) == set(range(40)) and spark.read.parquet(path).count() == 4000
    assert len({f.name for f in (tmp_path / "s").glob("*/*.parquet")}) > 1  # tasks share the files
    maintain.drop_buckets(spark, path, list(range(39)))
    assert maintain.stored_buckets(spark, path) == {39} and maintain.stored_buckets(spark, str(tmp_path / "none")) == set()


def test_hex_literal():
    assert tables.hex_lit("0x" + "ab" * 20)._jc.toString() != tables.hex_lit("0xab")._jc.toString()
