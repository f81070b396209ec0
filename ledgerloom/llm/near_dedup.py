"""MinHash near-dedup with SetSketch registers.

A register is the truncated, exponentially spaced minimum floor(1 - log_b min x) of exponential variates over the
shingles of a document: sketches merge by maximum and agree, register by register, about as often as the sets do.
Bands of registers propose; the joint likelihood of two sketches, given both set sizes, discards; the full sets decide.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import RollingHash, WordIds, arrow_map, materialize, mix64, numbered, texts_of
from ledgerloom.llm.components import components
from ledgerloom.llm.grouping import SMALL, least_of_part, link_batch, pairs_within, per_stretch, starts_of

KEY = b"near"
WIDTH = 5
#: Registers: bands times rows; base and rate of the exponential variates.
BANDS, ROWS, BASE, RATE = 20, 4, 1.1, 20.0
#: Rows of a band value, and sets of a candidate group, that meet in one task; more are cut into block pairs.
BAND_BLOCK, SET_BLOCK = 1024, 256

_rng = np.random.default_rng(20)
_XOR = _rng.integers(0, 1 << 63, BANDS * ROWS, np.uint64)[:, None]
_MUL = (_rng.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1))[:, None]


def sketch(shingles: np.ndarray) -> np.ndarray:
    """The registers of a non-empty set of 64-bit hashes, as bytes."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for i in range(0, len(shingles), 4096):
        np.minimum(least, ((shingles[None, i : i + 4096] ^ _XOR) * _MUL).min(axis=1), out=least)
    x = -np.log1p(-((least >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53) / RATE
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, 255).astype(np.uint8)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union of the two sets."""
    return np.maximum(a, b)


def likelihood(up: np.ndarray, down: np.ndarray, u: np.ndarray, jaccard: np.ndarray) -> np.ndarray:
    """Log-likelihood of a Jaccard value from how many registers of the first sketch are above and below the second's,
    where u is the first set's share of the two sizes."""
    v = 1 - u

    def p(x):
        return -np.log1p(-np.maximum(x, 0) * (BASE - 1) / BASE) / np.log(BASE)

    above, below = p(u - v * jaccard), p(v - u * jaccard)
    tiny = 1e-12
    same = np.maximum(1 - above - below, tiny)
    return up * np.log(np.maximum(above, tiny)) + down * np.log(np.maximum(below, tiny)) + (BANDS * ROWS - up - down) * np.log(same)


#: Steps of the size ratio in link_table.
RATIOS = 64


@functools.lru_cache(maxsize=8)
def link_table(least: float, slack: float = 14.0) -> np.ndarray:
    """Whether two sets can be linked, by size ratio (smaller to larger, from `least` to 1 in RATIOS steps), registers of
    the smaller above and below the larger's: of all Jaccard values some one of `least` or more must be within `slack`
    of the likeliest, in log-likelihood (a real link falls short about once in a million times)."""
    up, down = np.meshgrid(np.arange(BANDS * ROWS + 1.0), np.arange(BANDS * ROWS + 1.0), indexing="ij")
    table = np.zeros((RATIOS + 1, *up.shape), bool)
    for k, ratio in enumerate(np.linspace(least, 1, RATIOS + 1)):
        u = ratio / (1 + ratio)
        grid = np.max([likelihood(up, down, u, ratio * f) for f in np.linspace(0.2, 1, 17)], axis=0)
        good = np.max([likelihood(up, down, u, least + (ratio - least) * f) for f in np.linspace(0, 1, 5)], axis=0)
        table[k] = good >= grid - slack
    return table


def may_link(n: np.ndarray, regs: np.ndarray, other_n: np.ndarray, other_regs: np.ndarray, least: float) -> np.ndarray:
    """Row by row, whether two sets can be linked: their sizes allow it (exact) and so does the joint likelihood of
    their sketches, at one of the two ratios in the table next to theirs."""
    small, big = np.minimum(n, other_n), np.maximum(n, other_n)
    ok = small >= least * big
    if ok.any():
        above, below = (regs > other_regs).sum(axis=1), (regs < other_regs).sum(axis=1)
        first = n <= other_n
        up, down = np.where(first, above, below), np.where(first, below, above)
        table = link_table(least)
        step = np.clip((small / big - least) / (1 - least) * RATIOS, 0, RATIOS) if least < 1 else np.zeros(len(ok))
        ok &= table[np.floor(step).astype(int), up, down] | table[np.ceil(step).astype(int), up, down]
    return ok


def stars(rows: np.ndarray, test) -> list[tuple[int, int]]:
    """Links (member, smallest of its part) that connect what test(i, others) connects; each i is tested once, against
    those that nothing has reached yet."""
    left, found = rows, []
    while len(left):
        root, left = left[0], left[1:]
        front = [root]
        while front and len(left):
            hit = test(front.pop(), left)
            if hit.any():
                new = left[hit]
                left = left[~hit]
                front += new.tolist()
                found += [(int(m), int(root)) for m in new]
    return found


class Shingles:
    """Sorted distinct 64-bit hashes of a text's word 5-grams; of all its words where there are fewer."""

    def __init__(self):
        self.ids, self.roll = WordIds(KEY), RollingHash()

    def of(self, text: bytes | None) -> np.ndarray:
        words = (text or b"").lower().split()
        if not words:
            return np.empty(0, np.uint64)
        ids = self.ids.of(words)
        if len(ids) < WIDTH:
            return mix64(self.roll.windows(ids, len(ids)) + np.uint64(len(ids)))
        return np.unique(self.roll.windows(ids, WIDTH))


def digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def features(docs: DataFrame, key: str, text: str) -> DataFrame:
    """doc_id, n, digest and regs of each row; digest and regs are null for an empty set."""
    narrow = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))

    def run(batches):
        shingles = Shingles()
        for b in batches:
            sets = [shingles.of(t) for t in texts_of(b.column(1))]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([digest(s) if len(s) else None for s in sets], pa.binary()), pa.array([sketch(s).tobytes() if len(s) else None for s in sets], pa.binary())],
                names=["doc_id", "n", "digest", "regs"],
            )

    return arrow_map(narrow, run, "doc_id long, n long, digest binary, regs binary")


def compare_all(t: pa.Table, starts: np.ndarray, least: float) -> pa.RecordBatch:
    """(band, a, b): links that connect, within each group of (band, .., node, n, regs), all rows whose sketches allow a link. b
    is the smallest row of its part, and no part has another such."""
    node, n, regs = registers_of(t)
    sizes = np.diff(starts, append=len(node))
    small = sizes <= SMALL
    x, y = pairs_within(starts[small], sizes[small])
    ok = may_link(n[x], regs[x], n[y], regs[y], least)
    root = least_of_part(len(node), x[ok], y[ok])
    for s, m in zip(starts[~small].tolist(), sizes[~small].tolist(), strict=True):
        for member, first in stars(np.arange(s, s + m), lambda k, others: may_link(np.full(len(others), n[k]), regs[k], n[others], regs[others], least)):
            root[member] = first
    at = np.flatnonzero(root != np.arange(len(node)))
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (t.column("band").to_numpy()[at], node[at], node[root[at]])], names=["band", "a", "b"])


def compare_apart(t: pa.Table, starts: np.ndarray, least: float) -> pa.RecordBatch:
    """Links between different clusters of each group of (.., node, cluster, n, regs)."""
    (node, n, regs), cluster = registers_of(t), t.column("cluster").to_numpy()
    found = [(node[s + x], node[s + y]) for s, e in zip(starts.tolist(), np.append(starts[1:], len(node)).tolist(), strict=True)
             for x, y in between_clusters(cluster[s:e], lambda k, s=s, e=e: may_link(np.full(e - s, n[s + k]), regs[s + k], n[s:e], regs[s:e], least))]
    return link_batch(*np.array(found, np.int64).reshape(-1, 2).T)


def registers_of(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return t.column("node").to_numpy(), t.column("n").to_numpy(), np.frombuffer(b"".join(t.column("regs").to_pylist()), np.uint8).reshape(t.num_rows, -1)


def between_clusters(cluster: np.ndarray, test) -> Iterator[tuple[int, int]]:
    """Pairs of rows that connect the clusters as test(row), a mask of all rows, does; one for each cluster that a row meets.
    Rows of the cluster with most rows are met by others, but not tested."""
    part = cluster.copy()
    names, counts = np.unique(part, return_counts=True)
    for x in np.flatnonzero(part != names[counts.argmax()]).tolist():
        hit = np.flatnonzero(test(x) & (part != part[x]))
        for y in hit[np.unique(part[hit], return_index=True)[1]].tolist():
            yield x, y
            part[part == part[y]] = part[x]


def cells_of_rest(named: DataFrame, block: int) -> DataFrame:
    """named (group, node, cluster) as (group, __i, __j, of, cluster), the pairs of blocks in which a row meets others, such
    that every two rows of one group and different clusters meet. The rows outside a group's largest cluster meet one
    another and those of the largest; the largest isn't compared with itself, and a group that is one cluster is left out."""
    sizes = named.groupBy("group", "cluster").agg(F.count("*").alias("m"))
    largest = sizes.groupBy("group").agg(F.max_by("cluster", F.struct("m", "cluster")).alias("top"), F.max("m").alias("inside"), F.sum("m").alias("every")).where("every > inside")
    blocks = lambda n: F.ceil(F.col(n) / F.lit(block)).cast("int")
    open_groups = materialize(largest.withColumn("outside", F.col("every") - F.col("inside")).select(F.col("group").alias("g"), "top", blocks("inside").alias("ins"), blocks("outside").alias("outs")), "open")
    rows = named.join(open_groups, F.col("group") == F.col("g"))
    # blocks of the largest cluster are numbered from 0, the others after them
    inside, ident = F.col("cluster") == F.col("top"), F.xxhash64("node")
    own = F.when(inside, F.pmod(ident, "ins")).otherwise(F.col("ins") + F.pmod(ident, "outs")).cast("int")
    others = F.sequence(F.col("ins"), F.col("ins") + F.col("outs") - 1)
    rows = rows.withColumns({"__own": own, "__other": F.explode(F.when(inside, others).otherwise(F.sequence(F.lit(0), F.col("ins") + F.col("outs") - 1)))})
    return materialize(rows.select("group", F.least("__own", "__other").alias("__i"), F.greatest("__own", "__other").alias("__j"), F.col("node").alias("of"), "cluster"), "cells")


def blocks_of_band(met: DataFrame, sketches: DataFrame, least: float, salt: int = 0) -> DataFrame:
    """(band, a, b): links that connect what may link among the rows of met (band, node, c of its value) that share a value,
    for values of up to BAND_BLOCK rows; those of others are dealt into blocks by the hash of row and `salt`, and rows of
    different blocks don't meet."""
    block = F.pmod(F.xxhash64("node", F.lit(salt)), F.ceil(F.col("c") / F.lit(BAND_BLOCK))).cast("int")
    dealt = met.withColumn("block", block).join(sketches, "node").select("band", "block", "node", "n", "regs")
    return per_stretch(dealt, ["band", "block"], functools.partial(compare_all, least=least), "band long, a long, b long", ["node"])


def across_blocks(large: DataFrame, sketches: DataFrame, least: float) -> DataFrame:
    """Links (a, b) that connect what may link among the rows of large (band, node, c) that share a value, where values have
    more than BAND_BLOCK rows.

    Each block is connected within itself first. Then the smallest row of each part of a value stands for it; these are dealt
    into blocks anew until they have all met in one, or a round leaves more than half of them. At last the rows outside a
    value's largest part meet all of other parts. So a value that m near copies share costs some m rows, and not m for each
    of its blocks; only rows that stay apart are sent to all blocks."""
    links, named, met, salt, before = None, large.select(F.col("band").alias("group"), "node", F.col("node").alias("cluster")), large, 0, None
    while True:
        found = materialize(blocks_of_band(met, sketches, least, salt), "links")
        links = found if links is None else links.unionByName(found)
        up = named.join(found, (F.col("group") == F.col("band")) & (F.col("cluster") == F.col("a")), "left")
        named = materialize(up.select("group", "node", F.coalesce("b", "cluster").alias("cluster")), "named")
        heads = named.where("node = cluster").select(F.col("group").alias("band"), "node")
        several = heads.groupBy("band").agg(F.count("*").alias("c")).where("c > 1")
        all_met = salt > 0 and met.where(F.col("c") > BAND_BLOCK).isEmpty()
        met = materialize(heads.join(several, "band").select("band", "node", "c"), "heads")
        left, salt = met.count(), salt + 1
        if left == 0:
            return links.select("a", "b")
        if all_met or (before is not None and 2 * left > before):
            break
        before = left
    cells = cells_of_rest(named, BAND_BLOCK)
    full = cells.join(sketches, F.col("of") == F.col("node")).select("group", "__i", "__j", "node", "cluster", "n", "regs")
    apart = per_stretch(full, ["group", "__i", "__j"], functools.partial(compare_apart, least=least), "a long, b long", ["node"])
    return links.select("a", "b").unionByName(apart)


def propose(classes: DataFrame, least: float) -> DataFrame:
    """Links (a, b) that connect all classes whose sketches allow a link and which share a band value."""
    i = F.sequence(F.lit(0), F.lit(BANDS - 1))
    bands = classes.select("node", F.explode(F.transform(i, lambda k: F.xxhash64(k, F.substring("regs", k * ROWS + 1, ROWS)))).alias("band"))
    shared = materialize(bands.groupBy("band").agg(F.count("*").alias("c")).where("c > 1"), "bands")
    met = materialize(bands.join(shared, "band").select("band", "node", "c"), "met")
    sketches, large = classes.select("node", "n", "regs"), F.col("c") > BAND_BLOCK
    links = blocks_of_band(met.where(~large), sketches, least).select("a", "b")
    if shared.where(large).isEmpty():
        return links
    return links.unionByName(across_blocks(met.where(large), sketches, least))


class Sets:
    """Exact comparison of one set with others, by shingles numbered within the group."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.n, self.percent = np.array([len(s) for s in sets]), percent
        self.flat = np.unique(np.concatenate(sets), return_inverse=True)[1]
        self.start = np.concatenate([[0], np.cumsum(self.n)])
        self.mask = np.zeros(int(self.flat.max()) + 1, bool)

    def test(self, x: int) -> np.ndarray:
        """Which of all sets fit set x."""
        own = self.flat[self.start[x] : self.start[x + 1]]
        self.mask[own] = True
        common = np.add.reduceat(self.mask[self.flat], self.start[:-1], dtype=np.int64)
        self.mask[own] = False
        return 100 * common >= self.percent * (self.n[x] + self.n - common)


def distinct_nodes(t: pa.Table, keys: int) -> tuple[pa.Table, np.ndarray]:
    """The rows without those that repeat the node before (as rows do that repeat a key and text), and where groups by
    the first `keys` columns begin then. The node is the column named so, and rows are in its order."""
    t = t.take(pa.array(starts_of(t, t.column_names.index("node") + 1)))
    return t, starts_of(t, keys)


def groups_of_sets(t: pa.Table, starts: np.ndarray, percent: int) -> Iterator[tuple[int, Sets]]:
    """(first row, sets) of each group of two rows and more."""
    data, ends = t.column("shingles").to_pylist(), np.append(starts[1:], t.num_rows)
    for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
        if e - s > 1:
            yield s, Sets([np.frombuffer(x, np.uint64) for x in data[s:e]], percent)


def read_sets(docs: DataFrame, classes: DataFrame, parts: DataFrame, key: str, text: str) -> DataFrame:
    """node, component, shingles: the full set of each class that is in a candidate part."""
    members = parts.join(classes.select(F.col("node").alias("__n"), "rep", "digest"), F.col("node") == F.col("__n")).select("node", "component", "rep", "digest")
    members = materialize(members, "members")
    texts = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    # members grow with the corpus, so they are never broadcast, however few there are: the texts are always shuffled
    found = texts.join(members.hint("merge"), F.col("doc_id") == F.col("rep")).select("node", "component", "digest", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles()
        for b in batches:
            got = [shingles.of(t) for t in texts_of(b.column("text"))]
            same = pa.array([digest(s) == d for s, d in zip(got, b.column("digest").to_pylist(), strict=True)], pa.bool_())  # else a row that only shares the key
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array([s.tobytes() for s in got], pa.binary())], names=["node", "component", "shingles"]).filter(same)

    return materialize(arrow_map(found, sets, "node long, component long, shingles binary"), "sets")


def confirm(sets: DataFrame, links: DataFrame, percent: int) -> DataFrame:
    """Those of the proposed links (a, b) that the full sets bear out. Each b meets its a's, dealt in parts of bounded
    size with a copy of b each, so the work goes with the links."""
    once = materialize(links.distinct(), "proposed")
    roots = materialize(once.groupBy("b").agg(F.ceil(F.count("*") / F.lit(SET_BLOCK)).cast("int").alias("salts")).withColumnRenamed("b", "root"), "roots")
    sides = once.join(roots, F.col("b") == F.col("root")).select("root", F.pmod(F.xxhash64("a"), "salts").cast("int").alias("salt"), F.lit(1).alias("side"), F.col("a").alias("of"))
    sides = sides.unionByName(roots.select("root", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("side"), F.col("root").alias("of")))
    full = materialize(sides, "sides").join(sets.select("node", "shingles"), F.col("of") == F.col("node")).select("root", "salt", "side", "node", "shingles")

    def compare(t: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        t, starts = distinct_nodes(t, 2)
        node, a, b = t.column("node").to_numpy(), [], []
        for s, exact in groups_of_sets(t, starts, percent):
            fits = np.flatnonzero(exact.test(0))[1:]  # the root comes first, and fits itself
            a += node[s + fits].tolist()
            b += [node[s]] * len(fits)
        return link_batch(np.array(a, np.int64), np.array(b, np.int64))

    return per_stretch(full, ["root", "salt"], compare, "a long, b long", ["side", "node"])


def search_rest(sets: DataFrame, kept: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between confirmed clusters of one candidate part, by cells_of_rest: a part that is one cluster is done,
    and nothing within a cluster is compared.

    kept: (node, cluster)."""
    named = sets.select("node", "component").join(kept.withColumnRenamed("node", "__n"), F.col("node") == F.col("__n"), "left").select(F.col("component").alias("group"), "node", F.coalesce("cluster", "node").alias("cluster"))
    cells = cells_of_rest(materialize(named, "clusters"), SET_BLOCK)
    full = cells.join(sets.select("node", "shingles"), F.col("of") == F.col("node")).select("group", "__i", "__j", "node", "cluster", "shingles")

    def compare(t: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        t, starts = distinct_nodes(t, 3)
        node, cluster = t.column("node").to_numpy(), t.column("cluster").to_numpy()
        ends = dict(zip(starts.tolist(), np.append(starts[1:], len(node)).tolist(), strict=True))
        found = [(node[s + x], node[s + y]) for s, exact in groups_of_sets(t, starts, percent) for x, y in between_clusters(cluster[s : ends[s]], exact.test)]
        return link_batch(*np.array(found, np.int64).reshape(-1, 2).T)

    return per_stretch(full, ["group", "__i", "__j"], compare, "a long, b long", ["node"])


def verify(docs: DataFrame, classes: DataFrame, proposed: DataFrame, percent: int, key: str, text: str) -> DataFrame:
    """(node, component) by exact links: the proposed links are checked on full sets first, which settles most groups in
    proportion to their size; what they leave apart is then searched in full."""
    sets = read_sets(docs, classes, components(proposed), key, text)
    sure = materialize(confirm(sets, proposed, percent), "confirmed")
    rest = search_rest(sets, components(sure).withColumnRenamed("component", "cluster"), percent)
    return components(sure.unionByName(rest))


def near_duplicates(docs: DataFrame, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Two documents are linked if 100 * |A & B| >= percent * |A | B| for their sets of distinct word 5-grams (A-Z
    lower-cased, words between ASCII white space; with fewer words, the whole sequence as one). component_id is the
    smallest doc_id reachable by links. Equal sets form one class first, so copies are never paired. Bands miss a pair
    at 80 % with a probability of about 1e-5, at 85 % of 2e-7; every link is confirmed on the full sets.

    Null, empty or blank texts: no shingle, linked with nothing. Null keys: linked with nothing, component_id null,
    kept. Rows that share a key are judged one by one and share a component id if they are linked. An empty table gives
    an empty result; other columns aren't returned.
    """
    rows = materialize(features(docs, key, text), "features")
    usable = rows.where("n > 0 and doc_id is not null")
    classes = usable.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("regs").alias("regs"))
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    named = verify(docs, classes, materialize(propose(classes, percent / 100), "links"), percent, key, text)
    linked = materialize(classes.select("digest", "rep", "node").join(named.withColumnRenamed("node", "__n"), F.col("node") == F.col("__n")), "linked")
    first = linked.groupBy("component").agg(F.min("rep").alias("component_id"))
    alone = classes.join(named, "node", "left_anti").select("digest", F.col("rep").alias("component_id"))
    of_class = materialize(linked.join(first, "component").select("digest", "component_id").unionByName(alone).withColumnRenamed("digest", "d"), "named")
    out = rows.join(of_class, (F.col("digest") == F.col("d")) & F.col("doc_id").isNotNull(), "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def deduplicate(docs: DataFrame, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one document of each group of near_duplicates, that with the smallest key. Rows with a null key stay;
    rows that repeat a key stay or go together. Other columns are carried, whatever they are called."""
    gone = materialize(near_duplicates(docs, percent, key, text).where("not kept").select(F.col("doc_id").alias("__gone")).distinct(), "gone")
    # the keys to drop grow with the corpus, so they are never broadcast
    rows, own = numbered(docs)
    return rows.join(gone.hint("merge"), F.col(own[key]) == F.col("__gone"), "left_anti").toDF(*docs.columns)
