import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions.abi import TRANSFER
from ledgerloom.operators import forward, integrity


def nums(spark, values):
    return spark.createDataFrame([(v,) for v in values], "num long")


GAPS = [([], 0, []), ([], 9, [(1, 9)]), (range(5, 11), 10, [(1, 4)]), ([5, 6, 10, 11, 15, 16], 16, [(12, 14), (7, 9), (1, 4)]), ([0], 10, []), ([1, 2, 3], 3, []), ([1, 5], 3, []), ([2, 2, 4], 4, [(3, 3), (1, 1)])]


@pytest.mark.parametrize(("have", "tip", "want"), GAPS)
def test_all_gaps(spark, have, tip, want):
    assert [tuple(r) for r in integrity.detect_all_gaps(nums(spark, have), tip).collect()] == want


def test_gaps_and_ranges_across_buckets(spark, monkeypatch):
    monkeypatch.setattr(integrity, "BUCKET", 4)
    rng = random.Random(3)
    have = sorted(rng.sample(range(1, 200), 150))
    gaps = {tuple(r) for r in integrity.detect_gaps(nums(spark, have + have[:5])).collect()}
    assert gaps == {(a + 1, b - 1) for a, b in zip(have, have[1:]) if b > a + 1}
    want, start = set(), None
    for i, v in enumerate(have):
        if i == 0 or have[i - 1] != v - 1 or v - start == 10:
            start = v
        want = {x for x in want if x[0] != start} | {(start, v)}
    assert {tuple(r) for r in integrity.group_ranges(nums(spark, have)).collect()} == want


def test_bitmaps_of_parts_merge_and_shuffle_a_row_per_bucket(spark):
    rng = random.Random(7)
    have = sorted({*rng.sample(range(-70_000, 140_000), 50_000), *range(150_000, 300_000), 32_767, 32_768, 10**12})
    df = nums(spark, [*have, *have[:100], None]).repartition(3)
    odd = F.col("num") % 2 != 0
    parts = integrity.block_bitmaps(df.where(odd)).unionByName(integrity.block_bitmaps(df.where(~odd)))
    whole = integrity.merge_bitmaps(parts)
    want = {(a + 1, b - 1) for a, b in zip(have, have[1:]) if b > a + 1}
    assert {tuple(r) for r in integrity.gaps_of(whole).collect()} == want
    assert {tuple(r) for r in integrity.detect_gaps(df).collect()} == want
    ranges = {tuple(r) for r in integrity.group_ranges(df, 1000).collect()}
    assert sum(b - a + 1 for a, b in ranges) == len(have) and max(b - a for a, b in ranges) == 999
    assert {a for a, _ in ranges} >= {b + 1 for _, b in want} and {b for _, b in ranges} >= {a - 1 for a, _ in want}
    assert whole.agg(F.sum(F.bitmap_count("bits"))).first()[0] == len(have)
    # the only exchange below the first aggregate is of its partials
    plan = integrity.block_bitmaps(df.select("num"))._jdf.queryExecution().sparkPlan().toString()
    assert "partial_bitmap_construct_agg" in plan and "distinct" not in plan


def test_bitmaps_by_a_column_with_nulls(spark):
    df = spark.createDataFrame([("a", 1), ("a", 4), (None, 2), (None, 4), (None, 70_000), ("b", None)], "c string, num long")
    got = {tuple(r) for r in integrity.detect_gaps(df, by=("c",)).collect()}
    assert got == {("a", 2, 3), (None, 3, 3), (None, 5, 69_999)}


@pytest.mark.parametrize(("lo", "hi", "want"), [(1, 3, False), (1, 4, True), (5, 4, False), (3, 9, True)])
def test_has_gaps(spark, lo, hi, want):
    assert integrity.has_gaps(nums(spark, [1, 2, 3]), lo, hi).first()[0] is want


def test_batches_from_the_top(spark):
    g = spark.createDataFrame([(1, 25), (40, 42)], "gap_start long, gap_end long")
    assert [tuple(r) for r in integrity.plan_batches(g, 10).collect()] == [(40, 42), (16, 25), (6, 15), (1, 5)]


def test_sync_status_and_gaps_are_per_chain(spark):
    names = "chain_id long, head_num long, synced_num long, tip_num long, backfill_num long, started_at timestamp"
    state = spark.createDataFrame([(1, 10**7, 5, 9 * 10**6, None, None), (2, 20, 5, 8, 3, None), (3, 10, 1, 9, None, None)], names)
    first, second = [1, 2, 5, 3_000_000, 3_000_001, 9_000_000, 9_500_000], [1, 4, 8, 12]
    blocks = spark.createDataFrame([(1, n) for n in first] + [(2, n) for n in second] + [(2, 4), (9, 1), (9, 7)], "chain_id long, num long")
    want = {1: [(3, 4), (6, 2_999_999), (3_000_002, 8_999_999)], 2: [(2, 3), (5, 7)]}
    assert sorted(map(tuple, integrity.sync_gaps(state, blocks).collect())) == sorted((c, *g) for c, gaps in want.items() for g in gaps)
    status = integrity.sync_status(state, blocks, F.current_timestamp())
    got = {r.chain_id: (r.n_gaps, r.missing, r.coverage_pct) for r in status.collect()}
    assert got == {1: (3, sum(b - a + 1 for a, b in want[1]), 0), 2: (2, 5, 20), 3: (0, 0, 0)}
    assert "collect_list" not in status._jdf.queryExecution().executedPlan().toString()


def test_fork_point_takes_what_is_not_stored(spark):
    h = lambda rows: spark.createDataFrame([(n, bytearray([x]), t) for n, x, t in rows], "num long, hash binary, timestamp int")
    canonical = h([(n, n, 0) for n in range(1, 10)])
    assert integrity.fork_point(h([(7, 99, 0), (8, 99, 0)]), canonical, 9).first()[0] == 6
    assert integrity.fork_point(h([(8, 99, 0), (8, 8, 1)]), canonical, 9).first()[0] == 8
    assert integrity.fork_point(h([(n, 99, 0) for n in range(1, 9)]), canonical, 9).first()[0] is None


def sequential(rows):
    """The rule, log by log."""
    buckets, marked = {}, set()
    virtual = lambda a: a[4:14] == b"\xfd" * 10
    for tx, i, src, dst, amount in rows:
        if virtual(dst):
            buckets.setdefault((tx, dst, amount), []).append(("A", i, dst))
        if virtual(src):
            buckets.setdefault((tx, src, amount), []).append(("F" if not virtual(dst) else "N", i, dst))
    for entries in buckets.values():
        forwards = [e for e in entries if e[0] != "A"]
        if not forwards or len(forwards) != len(entries) - len(forwards) or len({e[2] for e in forwards}) > 1:
            continue
        waiting = 0
        for kind, i, _ in sorted(entries, key=lambda e: (e[1], e[0] != "A")):
            if kind == "A":
                waiting += 1
            elif kind == "F" and waiting:
                waiting -= 1
                marked.add(i)
    return marked


def test_forward_hops_equal_the_sequential_rule(spark):
    rng = random.Random(4)
    v = [b"\0\0\0" + bytes([k]) + b"\xfd" * 10 + bytes(6) for k in range(2)]
    m = [bytes([k + 1]) * 20 for k in range(2)]
    rows, i = [], 0
    for tx in range(150):
        for _ in range(rng.randrange(1, 7)):
            src, dst = rng.choice([(rng.choice(m), rng.choice(v)), (rng.choice(v), m[0]), (rng.choice(v), rng.choice(v + m)), (m[0], m[1])])
            rows.append((tx, i, src, dst, rng.randrange(1, 3)))
            i += 1
    df = spark.createDataFrame(
        [(t // 10, n, bytearray(t.to_bytes(32, "big")), bytearray(m[0]), bytearray(TRANSFER.topic), bytearray(s.rjust(32, b"\0")), bytearray(d.rjust(32, b"\0")), bytearray(a.to_bytes(32, "big")), False) for t, n, s, d, a in rows],
        "block_num long, log_idx int, tx_hash binary, address binary, topic0 binary, topic1 binary, topic2 binary, data binary, is_virtual_forward boolean",
    )
    got = {r.log_idx for r in forward.mark_forward_hops(df).where("is_virtual_forward").select("log_idx").collect()}
    assert got == sequential(rows) and got


def test_virtual_parts(spark):
    a = b"\1\2\3\4" + b"\xfd" * 10 + b"abcdef"
    df = spark.createDataFrame([(bytearray(a),), (bytearray(20),), (bytearray(a[:19]),), (None,)], "a binary")
    got = [r.p and (bytes(r.p.master_id), bytes(r.p.user_tag)) for r in df.select(forward.virtual_parts(F.col("a")).alias("p")).collect()]
    assert got == [(b"\1\2\3\4", b"abcdef"), None, None, None]


def test_only_candidates_are_shuffled_for_marks(spark, sf):
    """Logs that can't bear a mark go by every exchange."""
    from ledgerloom.operators.forward import mark_forward_hops
    from ledgerloom.sources import fixtures

    had = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = mark_forward_hops(fixtures.logs(spark, sf))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", had)
    rest = plan[plan.index("Union"):].split("\n")
    level = lambda line: len(line) - len(line.lstrip(" :+-"))
    last = [i for i, line in enumerate(rest) if level(line) == level(rest[1])][-1]
    assert not any("Exchange" in line for line in rest[last:]) and "Exchange" in plan


def test_watermarks_come_from_footers(spark, tmp_path):
    from ledgerloom.operators import integrity

    path = str(tmp_path / "b")
    spark.range(100).withColumnRenamed("id", "num").repartition(3).write.parquet(path)
    had = spark.conf.get("spark.sql.sources.useV1SourceList")
    with integrity.footer_reader(spark) as reader:
        plan = reader.parquet(path).agg(F.max("num"), F.count("*"))._jdf.queryExecution().executedPlan().toString()
    assert "PushedAggregation: [MAX(num), COUNT(*)]" in plan
    assert spark.conf.get("spark.sql.sources.useV1SourceList") == had
    assert [tuple(r) for r in integrity.stored_watermarks(spark, {"blocks": path}).collect()] == [("blocks", 99, 100)]
