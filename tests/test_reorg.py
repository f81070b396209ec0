"""Headers of forking chains: the state against a plain model, and the stream against the canonical chain alone."""

import glob
import random

from pyspark.sql import functions as F

from ledgerloom.operators import maintain
from ledgerloom.plans import catalog, views
from ledgerloom.schema import columns
from ledgerloom.streaming import reorg


def digest(branch, n):
    return f"{branch}:{n}".encode()


def branch_headers(branch, low, high, stem):
    """Blocks low to high of a branch that leaves `stem` before low."""
    return [(n, digest(branch, n), digest(branch if n > low else stem, n - 1)) for n in range(low, high + 1)]


def follow(chain, waiting, headers, depth=128):
    h = reorg.Headers(depth, dict(chain), list(waiting))
    for x in headers:
        h.deliver(*x)
    return h


def test_branches_in_any_order_end_with_the_last_one_whole():
    r = random.Random(6)
    for _ in range(300):
        top, cut = r.randrange(3, 12), r.randrange(1, 3)
        stem = branch_headers("a", 1, top, "a")
        h = follow({}, [], stem)
        other = branch_headers("b", top - cut + 1, top + r.randrange(3), "a")
        r.shuffle(other)
        h = follow(h.chain, h.waiting, [*r.choices(stem[: top - cut], k=2), *other])
        want = {n: d for n, d, _ in stem if n <= top - cut} | {n: d for n, d, _ in other}
        assert {n: x[0] for n, x in h.chain.items()} == want
        assert h.fork == top - cut and h.new == {n: d for n, d, _ in other} and {d[:1] for _, d, _ in h.waiting} <= {b"a"}


def test_gaps_duplicates_and_orphans():
    h = follow({}, [], branch_headers("a", 1, 3, "a") + branch_headers("a", 6, 8, "a"))
    assert h.fork is None and sorted(h.chain) == [1, 2, 3, 6, 7, 8]
    h = follow(h.chain, h.waiting, branch_headers("a", 4, 5, "a") + branch_headers("a", 2, 3, "a"))
    assert h.fork is None and sorted(h.new) == [4, 5]
    h = follow(h.chain, h.waiting, [(8, digest("c", 8), digest("c", 7))])  # its parent never comes
    assert h.fork is None and len(h.waiting) == 1 and h.new == {}
    h = follow(h.chain, h.waiting, branch_headers("a", 9, 30, "a"), depth=10)
    assert h.waiting == [] and min(h.chain) == 21


def test_a_fork_is_taken_back_everywhere(spark, tmp_path):
    """Blocks 1 to 20, a fork of depth 3 that is longer, then one that is shorter; each a micro-batch; the last is seen again
    by a new run of the same checkpoint. Tables, live results and the view are those of the canonical chain alone."""
    branches = [branch_headers("a", 1, 20, "a"), branch_headers("b", 18, 22, "a"), branch_headers("c", 19, 19, "b")]
    landed = [(n, d, i, n * 100 + k) for k, part in enumerate(branches) for n, d, _ in part for i in range(2)]
    rows = spark.createDataFrame([(n, bytearray(d), i, v) for n, d, i, v in landed], "block_num long, block_hash binary, i int, v long")
    view = views.View("sums", lambda df: df.groupBy("bucket").agg(F.sum("v").alias("v")), ["bucket"])
    store = views.ViewStore(spark, str(tmp_path / "views"))
    schema = columns("block_num long, i int, v long")
    f = reorg.Followed(str(tmp_path / "t"), store, {"rows": (rows, "block_num", schema)}, {"counts": (lambda df: df.groupBy("block_num").agg(F.sum("v").alias("n")), "rows")}, ((view, "rows"),), 4)
    store.create(view, maintain.stored(spark, f.path("rows"), schema))
    src = str(tmp_path / "headers")
    for k, part in enumerate(branches):
        df = spark.createDataFrame([(7, n, bytearray(d), bytearray(p), k) for n, d, p in part], "chain_id long, num long, hash binary, parent_hash binary, seq long")
        df.coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(df.schema).parquet(src)
        reorg.follow_chain(stream, f, str(tmp_path / "c"))
        canonical = {n: m for m, p in enumerate(branches[: k + 1]) for n, _, _ in p}
        top = max(n for n, _, _ in branches[k])
        want = {n: n * 100 + m for n, m in canonical.items() if n <= top}
        assert {(r.block_num, r.i, r.v) for r in f.table(spark, "rows").collect()} == {(n, i, v) for n, v in want.items() for i in range(2)}
        assert {r.block_num: r.n for r in spark.read.parquet(f.path("counts")).collect()} == {n: 2 * v for n, v in want.items()}
        assert store.read(view).agg(F.sum("v")).first()[0] == 2 * sum(want.values())
        heads = df.select("num", "hash")
        f.apply(spark, min(n for n, _, _ in part) - 1, heads)  # the batch breaks off and comes again
        assert store.read(view).agg(F.sum("v")).first()[0] == 2 * sum(want.values())
        assert f.table(spark, "rows").count() == 2 * len(want)


def test_stored_results_of_a_followed_chain_are_few_files(spark, sf):
    followed = catalog._reorganised(spark, sf)
    for name in ("txs", "counts"):
        folder = followed.path(name).removeprefix("file://")
        assert [len(glob.glob(f"{b}/*.parquet")) for b in glob.glob(f"{folder}/bucket=*")] == [1]


def test_a_first_write_makes_no_copy_and_few_buckets_are_listed(spark, tmp_path):
    path, work, t = str(tmp_path / "t"), str(tmp_path / "w"), spark.range(400).select(F.col("id").alias("n"))
    maintain.store_replace(spark, path, t, "n", work, size=10)
    assert not (tmp_path / "w").exists() and maintain.stored_buckets(spark, path) == set(range(40))
    f = reorg.Followed(str(tmp_path), tables={"t": (t, "n", t.schema)}, size=10)
    few = f.table(spark, "t", {3, 5, 99})
    assert sorted(p.split("/")[-2] for p in few.inputFiles()) == ["bucket=3", "bucket=5"]
    assert sorted((r.n, r.bucket) for r in few.collect()) == [(n, n // 10) for n in [*range(30, 40), *range(50, 60)]]
    assert f.table(spark, "t", set(range(30))).count() == 300 and f.table(spark, "t", {99}).count() == 0
    maintain.store_replace(spark, path, spark.createDataFrame([(12,), (900,)], t.schema), "n", work, size=10)  # one bucket is there, one is new
    assert sorted(r.n for r in maintain.stored(spark, path, t.schema).collect()) == [*range(400), 900]
