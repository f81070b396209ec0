"""Embedding near-dedup by spherical-cap filters from structured random product codes.

A code turns a vector by a random rotation and cuts it in parts, each with its own list of random unit directions; a
filter is one direction of each part. The score of a filter is the sum of its parts' scores, so the best filters are
decoded part by part, without walking the product. Every vector goes to as many filters, its best. Before that the mean
of all vectors is taken away, as it would send all of them to the same filters. What is left of a vector near the mean is
short, and its partners may lie in any direction from there, where no cap tells them from others: such vectors are
compared with all of their label, in pairs of blocks. A small label needs no filters: it meets as one group.

To a filter goes no vector but a sketch of it, four bits a number, with the length of what the sketch lacks. That bounds
how far the cosine by two sketches is from that of the vectors, so no pair that may be linked is passed over. Where few
pairs may, they are listed; where many may (copies with little changes), the group is tied together, and all pairs within
what is tied are compared in blocks, once. Both are judged on the full vectors, which only rows with a candidate send.
"""

from __future__ import annotations

import functools
import hashlib
from statistics import NormalDist
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import arrow_map, materialize, mix64
from ledgerloom.llm.components import components
from ledgerloom.llm.grouping import SMALL, block_pairs, least_of_part, pairs_within, per_stretch

#: Codes, and the filters that a vector is in at least.
CODES, FLOOR = 4, 8
#: Vectors that meet in a filter by chance and cost as much as the row sent; the part of all pairs that may meet by chance.
LOAD, CHANCE = 256, 0.05
#: Directions of a part, and filters of a vector, at most: codes of more parts or fewer directions are taken beyond.
MOST_DIRECTIONS, MOST_FILTERS = 1024, 2048
#: Vectors of a label that meet as one group, without filters; vectors of a filter, beyond which it is cut into block pairs.
FEW, HEAVY = 2048, 8192
#: Pairs that may be linked, for each vector of a group, beyond which the group is tied together and not listed.
DENSE = 4
#: Vectors of what is tied that one task compares with one another; more are cut into block pairs.
BLOCK = 4096
#: Least cosine, of what the mean leaves of a pair, that a code is planned for; gain for which the shortest are left out.
LEAST_COSINE, GAIN = 0.5, 0.01
#: Numbers that a block of vectors compared with all holds at most, and vectors of it.
BLOCK_NUMBERS, BLOCK_VECTORS = 1 << 20, 4096
#: Vectors of a block whose links are held at a time; parts that the rows of a label are dealt in for a join.
STRIP, SALTS = 256, 32
#: Rows of an Arrow batch of filters.
BATCH_ROWS = 1 << 15


class Code(NamedTuple):
    """What determines the filters: dimension, parts, directions of each, the score that they must exceed, and how many a
    vector takes, the best ones (0: all that exceed)."""

    dim: int
    parts: int
    directions: int
    level: float
    most: int = 0


@functools.lru_cache(maxsize=64)
def directions_of(number: int, dim: int, parts: int, directions: int) -> list[np.ndarray]:
    """Directions of each part of a code in the space before the rotation: (dim, directions) each. A filter's direction,
    the sum of its parts', has unit length."""
    rng = np.random.default_rng([number, dim, parts, directions])
    turn = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
    out = []
    for rows in np.array_split(turn, parts, axis=1):
        d = rng.standard_normal((rows.shape[1], directions))
        out.append(rows @ (d / np.maximum(np.linalg.norm(d, axis=0), 1e-12)) / np.sqrt(parts))
    return out


def exceeding(x: np.ndarray, number: int, code: Code, level: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, filters and scores of all filters of a code whose score with unit vectors x exceeds the row's level.

    Partial choices are carried on as long as the best of the remaining parts could still lift them above the level."""
    n = len(x)
    scores = [x @ part for part in directions_of(number, code.dim, code.parts, code.directions)]
    best = [s.max(axis=1) for s in scores]
    row, at, total = np.arange(n), np.zeros(n, np.int64), np.zeros(n)
    for k, s in enumerate(scores):
        # directions of this part that can reach the level at all, by row and falling score
        r, j = np.nonzero(s > (level - sum(best) + best[k])[:, None])
        # the scores of one row after another as one rising list: a search finds how many of a row's exceed a bound
        rising = r * 4.0 - s[r, j]
        by = np.argsort(rising, kind="stable")
        rising, j = rising[by], j[by]
        start = np.searchsorted(r, np.arange(n))
        rest = sum(best[k + 1 :], np.zeros(n))
        count = np.searchsorted(rising, row * 4.0 - (level[row] - rest[row] - total), side="left") - start[row]
        count = np.clip(count, 0, np.bincount(r, minlength=n)[row])
        pick = np.repeat(np.arange(len(row)), count)
        place = start[row[pick]] + np.arange(len(pick)) - np.repeat(np.cumsum(count) - count, count)
        row, at, total = row[pick], at[pick] * code.directions + j[place], total[pick] + s[row[pick], j[place]]
    return row, at, total


def ranked(x: np.ndarray, code: Code, codes: int = CODES, floor: int = FLOOR) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(rows, filters, scores, ranks), by row and falling score: the filters whose score with unit vectors x exceeds the
    code's level, or the best of these. A vector that has fewer than it is to take, or than `floor`, takes the highest
    level, in steps of a tenth, that gives it as many."""
    level, todo, found, floor = np.full(len(x), code.level), np.arange(len(x)), [], code.most or floor
    while len(todo):
        got = [exceeding(x[todo], c, code, level[todo]) for c in range(codes)]
        row, score = (np.concatenate([g[i] for g in got]) for i in (0, 2))
        at = np.concatenate([g[1] + c * code.directions**code.parts for c, g in enumerate(got)])
        few = (np.bincount(row, minlength=len(todo)) < floor) & (level[todo] > -1)
        ok = ~few[row]
        found.append((todo[row[ok]], at[ok], score[ok]))
        todo = todo[few]
        level[todo] = np.where(level[todo] > 0.05, level[todo] * 0.9, -1.1)
    row, at, score = (np.concatenate([f[i] for f in found]) if found else np.empty(0, kind) for i, kind in enumerate((np.int64, np.int64, float)))
    by = np.lexsort((at, -score, row))
    row, at, score = row[by], at[by], score[by]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    best = rank < (code.most or len(row))
    return row[best], at[best], score[best], rank[best]


def decode(x: np.ndarray, code: Code, codes: int = CODES, floor: int = FLOOR) -> tuple[np.ndarray, np.ndarray]:
    """(rows, filters), by row and then filter: the filters of unit vectors x (see ranked)."""
    row, at = ranked(x, code, codes, floor)[:2]
    by = np.lexsort((at, row))
    return row[by], at[by]


def pairs_at(cosine: float, dim: int, n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """n random pairs of unit vectors with a given cosine."""
    rng = np.random.default_rng([seed, dim])
    x, z = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in rng.standard_normal((2, n, dim)))
    z -= (z * x).sum(axis=1, keepdims=True) * x
    return x, cosine * x + np.sqrt(1 - cosine**2) * z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)


def needed(x: np.ndarray, y: np.ndarray, code: Code, codes: int) -> tuple[int, float]:
    """How many of their best filters pairs must take, so that each pair shares one, and a quarter more, as other pairs may
    need more; the score that nine in ten of x then exceed. MOST_FILTERS, if these aren't enough."""
    law, size, n = NormalDist(), codes * code.directions**code.parts, len(x)
    for most in (64, 512, MOST_FILTERS):
        most = min(most, size)
        tried = code._replace(most=most, level=law.inv_cdf(1 - min(0.4, most / size)) / np.sqrt(code.dim))
        (r, f, s, k), (r2, f2, _, k2) = (ranked(v, tried, codes) for v in (x, y))
        _, i, j = np.intersect1d(r * size + f, r2 * size + f2, assume_unique=True, return_indices=True)
        take = np.full(n, most)
        np.minimum.at(take, r[i], np.maximum(k[i], k2[j]))
        worst = int(take.max())
        if worst < most or most in (size, MOST_FILTERS):
            break
    take = min(max(worst + 1 + max(4, worst // 4), FLOOR), most)
    return take, float(np.quantile(s[k == take - 1], 0.1))


@functools.lru_cache(maxsize=64)
def plan_code(n: int, dim: int, cosine: float, codes: int = CODES, trials: int = 1000) -> Code:
    """A code for n vectors that are to meet at a cosine.

    Of finer codes, filters hold fewer vectors that meet by chance, but a pair must take more of them. How many is found
    on random pairs at that cosine, all of which are to share one. Taken is the code that costs least, a row
    of a filter and LOAD vectors met by chance counting alike, of those by which no more than CHANCE of all pairs meet by
    chance; if there is none, that by which the fewest meet."""
    x, y = pairs_at(min(cosine, 0.9999), dim, trials, 0)
    best, least, rising = None, np.inf, 0
    for parts in range(min(2, dim), min(4, dim) + 1):
        for directions in (4 << k for k in range(MOST_DIRECTIONS.bit_length() - 2)):
            size = codes * directions**parts
            if parts > 2 and size <= codes * MOST_DIRECTIONS ** (parts - 1) or n * FLOOR / size > 16 * LOAD and size < codes * MOST_DIRECTIONS ** min(2, dim):
                continue
            take, level = needed(x, y, Code(dim, parts, directions, 0.0), codes)
            load = n * take / size
            cost = take * (1 + load / LOAD) + (0 if take * load <= CHANCE * n else 1e6 * (1 + take * load / n))
            if cost < least:
                best, least, rising = Code(dim, parts, directions, level, take), cost, 0
            elif (rising := rising + 1) > 1:
                return best
    return best


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of x, none of them zero, at unit length; a row comes out alike whatever stands beside it."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def usable(values: list | None) -> np.ndarray | None:
    """The vector in double precision and of unit length; None if it is null, empty, zero or holds null or non-finite."""
    if not values or None in values:
        return None
    x = np.asarray(values, np.float64)
    return unit(x[None])[0] if np.isfinite(x).all() and x.any() else None


def packed(x: np.ndarray) -> list[bytes]:
    """The numbers of each row, in single precision where that is exact."""
    with np.errstate(over="ignore"):
        short = x.astype(np.float32)
    exact = (short == x).all(axis=1)
    return [(short[i] if e else x[i]).tobytes() for i, e in enumerate(exact.tolist())]


def residual(x: np.ndarray, mean: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What the mean leaves of unit vectors x, as unit vectors, and its length; a vector at the mean keeps its own
    direction."""
    r = x - mean
    size = np.linalg.norm(r, axis=1)
    return np.where(size[:, None] > 1e-9, r / np.maximum(size, 1e-12)[:, None], x), size


def by_dim(data: list[bytes], dims: np.ndarray):
    """(dimension, positions, unit vectors) for each dimension among packed vectors."""
    wide = np.array([len(x) for x in data]) == 8 * dims
    for dim in np.unique(dims).tolist():
        at = np.flatnonzero(dims == dim)
        x = np.empty((len(at), dim))
        for kind, some in ((np.float32, ~wide[at]), (np.float64, wide[at])):
            x[some] = np.frombuffer(b"".join([data[i] for i in at[some].tolist()]), kind).reshape(-1, dim)
        yield dim, at, unit(x)


def vectors_of(b: pa.RecordBatch):
    return by_dim(b.column("vector").to_pylist(), b.column("dim").to_numpy())


@functools.lru_cache(maxsize=16)
def turn_of(dim: int) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng([dim, 1]).standard_normal((dim, dim)))[0]


def sketches(x: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """A row of bytes for each unit vector: the step and the error, half precision, what the mean adds to a cosine, single
    precision, then four bits for each number of what the mean leaves of the vector, turned. The error is the length of
    what the sketch lacks, or a little more."""
    adds = (x @ mean - mean @ mean / 2).astype(np.float32)
    z = np.pad(x - mean, ((0, 0), (0, x.shape[1] % 2)))
    z = z @ turn_of(z.shape[1])
    step = np.maximum(np.abs(z).max(axis=1) / 8, 1e-6).astype(np.float16)
    q = np.clip(np.floor(z / step.astype(float)[:, None]), -8, 7)
    error = np.linalg.norm(z - (q + 0.5) * step.astype(float)[:, None], axis=1)
    error = np.nextafter(error.astype(np.float16), np.float16(4))
    q = (q + 8).astype(np.uint8)
    return np.concatenate([*(k[:, None].view(np.uint8) for k in (step, error, adds)), q[:, ::2] | q[:, 1::2] << 4], axis=1)


class Sketched(NamedTuple):
    """What sketches stand for: vectors, their errors and lengths, and what the mean adds to a cosine."""

    x: np.ndarray
    error: np.ndarray
    length: np.ndarray
    adds: np.ndarray

    def of(self, rows) -> Sketched:
        return Sketched(*(k[rows] for k in self))

    def least(self, other: Sketched, threshold: float, across: bool) -> np.ndarray:
        """The least product of sketches that vectors whose cosine is the threshold may have: for rows of self and of
        other one by one, or each with each."""
        e, n, h = (k[:, None] if across else k for k in self[1:])
        return threshold - h - other.adds - e * (other.length + other.error) - n * other.error - np.float32(1e-4)


def sketched(rows: np.ndarray) -> Sketched:
    step, error = (rows[:, k : k + 2].copy().view(np.float16).astype(np.float32) for k in (0, 2))
    q = np.empty((len(rows), 2 * (rows.shape[1] - 8)), np.float32)
    q[:, ::2], q[:, 1::2] = rows[:, 8:] & 15, rows[:, 8:] >> 4
    x = (q - 7.5) * step
    return Sketched(x, error[:, 0], np.linalg.norm(x, axis=1), rows[:, 4:8].copy().view(np.float32)[:, 0])


def means_of(classes: DataFrame) -> dict[int, np.ndarray]:
    """The mean of the distinct vectors of each dimension: partial sums of each task, added up in Spark."""

    def sums(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for dim, at, x in vectors_of(b):
                total[dim] = total.get(dim, np.zeros(dim + 1)) + np.append(x.sum(axis=0), len(at))
        for dim, v in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([dim] * len(v), pa.int32()), pa.array(range(len(v)), pa.int32()), pa.array(v)], names=["dim", "i", "v"])

    found: dict[int, np.ndarray] = {}
    for r in arrow_map(classes.select("dim", "vector"), sums, "dim int, i int, v double").groupBy("dim", "i").agg(F.sum("v").alias("v")).collect():
        found.setdefault(r.dim, np.zeros(r.dim + 1))[r.i] = r.v
    return {dim: v[:-1] / v[-1] for dim, v in found.items()}


def among(b: pa.RecordBatch, large: dict[tuple[int, int, int], int]) -> np.ndarray:
    """Whether a row's label is one of the large."""
    return np.array([k in large for k in zip(*(b.column(c).to_pylist() for c in ("lab0", "lab1", "dim")), strict=True)], bool)


def plan(classes: DataFrame, means: dict[int, np.ndarray], large: dict[tuple[int, int, int], int], threshold: float) -> tuple[dict[int, Code], dict[int, float], bool]:
    """For each dimension a code for its large labels, and the length below which vectors are short and compared with all
    of their label; whether any are.

    With g the squared distance of a pair at the threshold, what the mean leaves of two linked vectors, the shorter one of
    length a, has a cosine of at least 1 - g / (2 a^2). The code is planned for that cosine at the least length that isn't
    short, so no pair of long vectors lies below it, and for as many vectors as the largest label has. As few are short as
    keeps that cosine at LEAST_COSINE or more; where it is higher anyway, the shortest hundredth, at most MOST_FILTERS
    vectors, if that raises the cosine by GAIN. Lengths are counted in thousandths."""

    def lengths(batches):
        for b in batches:
            many = among(b, large)
            for dim, at, x in vectors_of(b):
                step, n = np.unique(np.floor(residual(x[many[at]], means[dim])[1] * 1000).astype(np.int32), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([dim] * len(n), pa.int32()), pa.array(step), pa.array(n)], names=["dim", "step", "n"])

    gap, floor = 2 * (1 - threshold), max(0.0, min(LEAST_COSINE, 0.8 * threshold))
    least = np.sqrt(gap / 2 / (1 - floor))
    steps: dict[int, list[tuple[int, int]]] = {}
    for r in arrow_map(classes.select("lab0", "lab1", "dim", "vector"), lengths, "dim int, step int, n long").groupBy("dim", "step").agg(F.sum("n").alias("n")).collect():
        steps.setdefault(r.dim, []).append((r.step, r.n))
    codes, short, some = {}, {}, False
    for dim, counts in steps.items():
        step, n = np.array(sorted(counts)).T
        below = np.cumsum(n) - n
        tail = step[np.flatnonzero(below <= min(n.sum() // 100, MOST_FILTERS))[-1]] / 1000
        every = max(least, step[0] / 1000)
        short[dim] = float(tail if tail > every and gap / 2 / every**2 - gap / 2 / tail**2 > GAIN else every)
        some |= bool(step[0] / 1000 < short[dim])
        if step[-1] / 1000 + 0.001 < short[dim]:  # no vector is long
            continue
        cosine = min(1 - gap / 2 / short[dim] ** 2, threshold, 0.9999)
        most = max(n for (*_, d), n in large.items() if d == dim)
        codes[dim] = plan_code(1 << max(6, int(most - 1).bit_length()), dim, float(np.floor(cosine * 1000) / 1000))
    return codes, short, some


def at_least(x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Whether the cosine of each row of x with each of y is the threshold or more. Products that are too near to it are
    summed again as those of single pairs are, so that a pair is judged alike wherever it meets."""
    cosine = x @ y.T
    linked = cosine >= threshold
    i, j = np.nonzero(np.abs(cosine - threshold) < 1e-9)
    linked[i, j] = judged(x, y, i, j, threshold)
    return linked


def judged(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """The same for pairs of a row of x and one of y."""
    step = max(1, (4 << 20) // x.shape[1])
    return np.concatenate([np.einsum("ij,ij->i", x[i[k : k + step]], y[j[k : k + step]]) >= threshold for k in range(0, len(i), step)] or [np.empty(0, bool)])


LABEL = ["lab0", "lab1", "dim"]


def short_links(classes: DataFrame, means: dict[int, np.ndarray], short: dict[int, float], large: dict[tuple[int, int, int], int], threshold: float) -> DataFrame:
    """(a, links, b) of every pair with a short end in a large label: each short vector meets all of its label and
    dimension, in pairs of a block of short ones and a block of all. Rows sent: a vector once per block of the other side.
    A pair of two short ones meets twice and counts for either end once; one row per vector and block pair says what it is
    linked to there."""

    def flag(batches):
        for b in batches:
            many = among(b, large)
            is_short = np.zeros(b.num_rows, bool)
            for dim, at, x in vectors_of(b):
                if many[at].any():
                    is_short[at] = residual(x, means[dim])[1] < short[dim]
            b = pa.RecordBatch.from_arrays([*b.columns, pa.array(is_short)], names=[*b.schema.names, "short"])
            yield b.filter(pa.array(many))

    rows = arrow_map(classes.select(*LABEL, "node", "c", "vector"), flag, "lab0 long, lab1 long, dim int, node long, c long, vector binary, short boolean")
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
    keys = LABEL
    per = rows.groupBy(*keys).agg(F.count_if("short").alias("s"), F.count("*").alias("m")).where("s > 0 and m > 1")
    block = F.greatest(F.lit(1), F.least(F.lit(BLOCK_VECTORS), F.floor(F.lit(BLOCK_NUMBERS) / F.col("dim"))))
    blocks = lambda n: F.ceil(F.col(n) / block).cast("int")
    per = per.select(*keys, blocks("s").alias("sb"), blocks("m").alias("mb"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    met = rows.join(per, [*keys, "salt"])
    own = lambda n: F.pmod(F.xxhash64(F.col("node"), F.lit(1)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    queries = met.where("short").select(*keys, own("sb").alias("__i"), every("mb").alias("__j"), F.lit(True).alias("query"), "node", "c", "vector", "short")
    others = met.select(*keys, every("sb").alias("__i"), own("mb").alias("__j"), F.lit(False).alias("query"), "node", "c", "vector", "short")
    keys = [*keys, "__i", "__j"]

    def compare(t: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        node, weight, query, is_short = (t.column(c).to_numpy() for c in ("node", "c", "query", "short"))
        data, dims, root, links = t.column("vector"), t.column("dim").to_numpy(), np.arange(len(node)), np.zeros(len(node), np.int64)
        for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(node)], strict=True):
            q, o = s + np.flatnonzero(query[s:e]), s + np.flatnonzero(~query[s:e])
            if not len(q) or not len(o):
                continue
            (_, _, x), (_, _, y) = (next(by_dim(data.take(pa.array(k)).to_pylist(), dims[k])) for k in (q, o))
            ties: list[tuple[np.ndarray, np.ndarray]] = []
            for k in range(0, len(q), STRIP):
                rows_of = q[k : k + STRIP]
                linked = at_least(x[k : k + STRIP], y, threshold) & (node[rows_of, None] != node[None, o])
                links[rows_of] += linked @ weight[o]
                links[o] += np.where(is_short[o], 0, weight[rows_of] @ linked)
                i, j = np.nonzero(linked)
                part = least_of_part(e - s, rows_of[i] - s, o[j] - s)
                tied = np.flatnonzero(part != np.arange(e - s))
                ties.append((tied, part[tied]))
            root[s:e] = s + least_of_part(e - s, *(np.concatenate([t[i] for t in ties]) for i in range(2)))
        some = np.flatnonzero((links > 0) | (node[root] != node))
        return pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(links[some]), pa.array(node[root[some]])], names=["a", "links", "b"])

    return per_stretch(queries.unionByName(others).select(*keys, "query", "node", "c", "vector", "short"), keys, compare, "a long, links long, b long")


def candidates(classes: DataFrame, means: dict[int, np.ndarray], codes: dict[int, Code], short: dict[int, float], large: dict[tuple[int, int, int], int], threshold: float) -> DataFrame:
    """(a, b, dense) of the pairs a < b that may be linked: listed, or, where dense, links that tie together what holds
    them. To each filter, or small label, goes a vector's sketch. A filter of more than HEAVY vectors, or nearly, is cut
    into pairs of blocks. Which ones these are is told by the tasks that have at least their share of HEAVY of it: others
    hold no more than HEAVY of it in all."""

    def keyed(b):
        """For each dimension: it, places in the batch, vectors, and (place among these, key) of each filter of theirs."""
        lab, many = (np.stack([b.column(c).to_numpy() for c in ("lab0", "lab1")], axis=1).view(np.uint64)), among(b, large)
        for dim, at, x in vectors_of(b):
            row = np.flatnonzero(~many[at])
            f = np.zeros(len(row), np.int64)
            if dim in codes:
                some = np.flatnonzero(many[at])
                r, size = residual(x[some], means[dim])
                some, r = some[size >= short[dim]], r[size >= short[dim]]
                i, own = decode(r, codes[dim])
                row, f = np.concatenate([row, some[i]]), np.concatenate([f, own + 1])
            key = mix64(mix64(f.view(np.uint64) * np.uint64(1 << 16) + np.uint64(dim)) + lab[at, 0][row])
            yield dim, at, x, row, mix64(key + lab[at, 1][row])

    def counts(batches):
        own = [key for b in batches for *_, key in keyed(b)]
        key, n = np.unique(np.concatenate([*own, np.empty(0, np.uint64)]), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(key[n >= share].view(np.int64)), pa.array(n[n >= share])], names=["key", "n"])

    heavy, blocks = np.empty(0, np.uint64), np.empty(0, np.int64)
    if max(large.values(), default=0) > 2 * HEAVY:
        share = max(1, HEAVY // classes.rdd.getNumPartitions())
        told = arrow_map(classes, counts, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") > HEAVY).collect()
        heavy = np.array([r.key for r in told], np.int64).view(np.uint64)
        blocks = np.array([-(-(r.n + HEAVY) // HEAVY) for r in told], np.int64)[np.argsort(heavy)]
        heavy = np.sort(heavy)

    def rows(batches):
        for b in batches:
            for dim, at, x, row, key in keyed(b):
                node = b.column("node").to_numpy()[at]
                if len(heavy):
                    place = np.minimum(np.searchsorted(heavy, key), len(heavy) - 1)
                    cut = heavy[place] == key
                    n, node_of, base = blocks[place[cut]], row[cut], key[cut]
                    own = (mix64(node[node_of].view(np.uint64)) % n.view(np.uint64)).astype(np.int64)
                    pick = np.repeat(np.arange(len(n)), n - 1)
                    other = np.arange(len(pick)) - np.repeat(np.cumsum(n - 1) - (n - 1), n - 1)
                    other += other >= own[pick]
                    i, j = np.minimum(own[pick], other), np.maximum(own[pick], other)
                    row = np.concatenate([row[~cut], node_of[pick]])
                    key = np.concatenate([key[~cut], mix64(base[pick] + mix64((i * n[pick] + j + 1).view(np.uint64)))])
                data = pa.array([r.tobytes() for r in sketches(x, means.get(dim, np.zeros(dim)))], pa.binary())
                for k in range(0, len(row), BATCH_ROWS):
                    part = row[k : k + BATCH_ROWS]
                    yield pa.RecordBatch.from_arrays([pa.array(key[k : k + BATCH_ROWS].view(np.int64)), pa.array(node[part]), data.take(pa.array(part))], names=["key", "node", "sketch"])

    def compare(t: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        node, data, sizes = t.column("node").to_numpy(), t.column("sketch").to_pylist(), np.diff(starts, append=t.num_rows)
        of, width = np.repeat(np.arange(len(starts)), sizes), np.array([len(d) for d in data])
        found: list[tuple[np.ndarray, np.ndarray]] = []
        ties: list[tuple[np.ndarray, np.ndarray]] = []
        for w in np.unique(width).tolist():
            rows_of = np.flatnonzero(width == w)
            every = sketched(np.frombuffer(b"".join([data[k] for k in rows_of.tolist()]), np.uint8).reshape(-1, w))
            group, first, m = np.unique(of[rows_of], return_index=True, return_counts=True)
            i, j = pairs_within(first[m <= SMALL], m[m <= SMALL])
            near, step = [np.empty(0, bool)], max(1, (2 << 20) // w)
            for k in range(0, len(i), step):
                one, other = every.of(i[k : k + step]), every.of(j[k : k + step])
                near.append(np.einsum("ij,ij->i", one.x, other.x) >= one.least(other, threshold, False))
            near = np.concatenate(near)
            i, j = i[near], j[near]
            in_group = np.searchsorted(first, i, side="right") - 1
            dense = (np.bincount(in_group, minlength=len(first)) > DENSE * m)[in_group]
            found.append((rows_of[i[~dense]], rows_of[j[~dense]]))
            part = least_of_part(len(rows_of), i[dense], j[dense])
            tied = np.flatnonzero(part != np.arange(len(rows_of)))
            ties.append((rows_of[part[tied]], rows_of[tied]))
            for s, n in zip(first[m > SMALL].tolist(), m[m > SMALL].tolist(), strict=True):
                part, total, listed = np.arange(n), 0, []
                for k in range(0, n, STRIP):
                    one, other = every.of(slice(s + k, min(s + k + STRIP, s + n))), every.of(slice(s + k, s + n))
                    near = np.triu(one.x @ other.x.T >= one.least(other, threshold, True), 1)
                    total += int(near.sum())
                    if total <= DENSE * n:
                        i, j = np.nonzero(near)
                        listed.append((i + k, j + k))
                    i, j = np.nonzero(near & (part[k : k + STRIP, None] != part[None, k:]))
                    part = least_of_part(n, np.concatenate([np.arange(n), i + k]), np.concatenate([part, j + k]))
                if total <= DENSE * n:
                    found += [(rows_of[s + i], rows_of[s + j]) for i, j in listed]
                else:
                    tied = np.flatnonzero(part != np.arange(n))
                    ties.append((rows_of[s + part[tied]], rows_of[s + tied]))
        (i, j), (p, q) = [[np.concatenate([z[k] for z in pairs]) for k in range(2)] for pairs in (found, ties)]
        a, b = node[np.concatenate([i, p])], node[np.concatenate([j, q])]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(np.arange(len(a)) >= len(i))], names=["a", "b", "dense"])

    dealt = arrow_map(classes.select(*LABEL, "node", "vector"), rows, "key long, node long, sketch binary")
    return per_stretch(dealt, ["key"], compare, "a long, b long, dense boolean")


def pair_links(pairs: DataFrame, held: DataFrame, threshold: float) -> DataFrame:
    """(a, links, b) for either end of the listed pairs that are linked."""

    def judge(batches):
        for b in batches:
            links = np.zeros(b.num_rows, bool)
            data, dims = (pa.concat_arrays([b.column("va"), b.column("vb")]).to_pylist(), np.tile(b.column("dim").to_numpy(), 2))
            for _, at, x in by_dim(data, dims):
                n = len(at) // 2  # the first ends, then the second ones, in the same order
                links[at[:n]] = judged(x, x, np.arange(n), np.arange(n, 2 * n), threshold)
            yield b.select(["a", "b", "ca", "cb"]).filter(pa.array(links))

    ends = [held.select(F.col("node").alias(k), F.col("c").alias(f"c{k}"), F.col("vector").alias(f"v{k}"), *[F.col(c).alias(c if k == "a" else f"{c}b") for c in LABEL]) for k in "ab"]
    met = pairs.join(ends[0], "a").join(ends[1], "b").where(" AND ".join(f"{c} = {c}b" for c in LABEL))
    linked = arrow_map(met.select("a", "b", "ca", "cb", "dim", "va", "vb"), judge, "a long, b long, ca long, cb long")
    both = F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("cb").alias("links"), F.col("b").alias("b")), F.struct(F.col("b").alias("a"), F.col("ca").alias("links"), F.col("a").alias("b"))))
    return linked.select(both.alias("x")).select("x.*")


def dense_links(held: DataFrame, threshold: float) -> DataFrame:
    """(a, links, b) of every pair within what is tied together, in pairs of blocks."""
    per = held.where("component is not null").groupBy("component", *LABEL).agg(F.count("*").alias("m"))
    size = F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.floor(F.lit(BLOCK_NUMBERS) / F.col("dim"))))
    dealt = block_pairs(held.join(per, ["component", *LABEL]), F.ceil(F.col("m") / size), F.col("node"), inner=True)

    def compare(t: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        node, own, weight, dims = (t.column(c).to_numpy() for c in ("node", "__own", "c", "dim"))
        across = t.column("__i").to_numpy() != t.column("__j").to_numpy()
        data, sizes = t.column("vector").to_pylist(), np.diff(starts, append=len(node))
        root, links = np.arange(len(node)), np.zeros(len(node), np.int64)
        for dim in np.unique(dims[starts]).tolist():
            some = (sizes <= SMALL) & (dims[starts] == dim)
            i, j = pairs_within(starts[some], sizes[some])
            ok = ~across[i] | (own[i] != own[j])
            i, j = i[ok], j[ok]
            at = np.flatnonzero(dims == dim)
            place = np.cumsum(dims == dim) - 1
            if len(i):
                x = next(by_dim([data[k] for k in at.tolist()], dims[at]))[2]
                near = judged(x, x, place[i], place[j], threshold)
                i, j = i[near], j[near]
                np.add.at(links, i, weight[j])
                np.add.at(links, j, weight[i])
                root = np.minimum(root, least_of_part(len(node), i, j))
        for s, m in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist(), strict=True):
            x, part = next(by_dim(data[s : s + m], dims[s : s + m]))[2], np.arange(m)
            for k in range(0, m, STRIP):
                linked = at_least(x[k : k + STRIP], x, threshold)
                linked[np.arange(len(linked)), k + np.arange(len(linked))] = False
                if across[s]:
                    linked &= own[s + k : s + k + len(linked), None] != own[None, s : s + m]
                links[s + k : s + k + len(linked)] += linked @ weight[s : s + m]
                i, j = np.nonzero(linked & (part[k : k + STRIP, None] != part[None]))
                part = least_of_part(m, np.concatenate([np.arange(m), i + k]), np.concatenate([part, j]))
            root[s : s + m] = s + part
        some = np.flatnonzero((links > 0) | (root != np.arange(len(node))))
        return pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(links[some]), pa.array(node[root[some]])], names=["a", "links", "b"])

    keys = ["component", *LABEL, "__i", "__j"]
    return per_stretch(dealt.select(*keys, "__own", "node", "c", "vector"), keys, compare, "a long, links long, b long", ["node"])


def near_vectors(vectors: DataFrame, threshold: float = 0.93, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """One row per vector: vec_id, n_links (other vectors linked directly), component_id (smallest vec_id reachable by
    links, itself included), kept (vec_id = component_id).

    Vectors of one non-null label and one dimension are linked if their cosine, in double precision, is at least
    `threshold`. Null, empty and zero vectors, ones that hold null or non-finite values, and rows with a null key or
    label link with nothing; without a key, component_id is null and the row is kept. Equal vectors are one class with
    a weight, so copies are never paired. Rows that repeat a key count as vectors of their own. Empty table: empty
    result. Other columns aren't returned. The table is read twice and must be the same both times. Codes are planned from
    the size of the largest label (see plan_code); a pair at the threshold in a label of more than FEW vectors, of which
    neither end is short (see plan), shares some filter in all but one case in a thousand; in smaller ones none is lost. Pairs with a short end are all found, by comparison with the whole label:
    few where vectors have no strong common direction, all where they are concentrated (common cosines above 0.86 at a
    threshold of 0.93), and the work is then the square of the label's size, in bounded blocks.
    """
    rows = vectors.select(F.col(f"`{key}`").cast("long").alias("vec_id"), F.unhex(F.md5(F.encode(F.col(f"`{label}`").cast("string"), "utf-8"))).alias("lab"), F.col(f"`{vector}`").cast("array<double>").alias("v"))

    # vectors are told apart by 128-bit digests, labels by 112 bits of one
    def units(batches):
        for b in batches:
            v, labs = b.column("v"), b.column("lab").to_pylist()
            edge, numbers = v.offsets.to_numpy(), v.values.fill_null(float("nan")).to_numpy(zero_copy_only=False)
            ok = np.array([lab is not None for lab in labs], bool) & ~b.column("vec_id").is_null().to_numpy(zero_copy_only=False) & ~v.is_null().to_numpy(zero_copy_only=False)
            size, data, digest = np.diff(edge), [None] * b.num_rows, [None] * b.num_rows
            for dim in np.unique(size[ok & (size > 0)]).tolist():
                at = np.flatnonzero(ok & (size == dim))
                x = numbers[edge[at, None] + np.arange(dim)]
                good = np.isfinite(x).all(axis=1) & x.any(axis=1)
                at, x = at[good], x[good]
                for i, own, u in zip(at.tolist(), packed(x), unit(x), strict=True):
                    data[i], digest[i] = own, hashlib.md5(labs[i] + u.tobytes(), usedforsecurity=False).digest()
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("lab"), pa.array(size.astype(np.int32)), pa.array(data, pa.binary()), pa.array(digest, pa.binary())], names=["vec_id", "lab", "dim", "vector", "class"])

    every = arrow_map(rows, units, "vec_id long, lab binary, dim int, vector binary, class binary")
    part = lambda i: F.conv(F.hex(F.substring("lab", 1 + 8 * i, 7)), 16, 10).cast("long")
    classes = every.where("class is not null").groupBy("class").agg(F.first("lab").alias("lab"), F.first("dim").alias("dim"), F.first("vector").alias("vector"), F.min("vec_id").alias("first"), F.count("*").alias("c"))
    classes = materialize(classes.select(F.monotonically_increasing_id().alias("node"), part(0).alias("lab0"), part(1).alias("lab1"), "dim", "c", "first", "class", "vector"), "classes")
    large = {(r.lab0, r.lab1, r.dim): r.n for r in classes.groupBy(*LABEL).agg(F.count("*").alias("n")).where(F.col("n") > FEW).collect()}
    means = means_of(classes) if large else {}
    codes, short, some_short = plan(classes, means, large, threshold) if large else ({}, {}, False)

    found = materialize(candidates(classes, means, codes, short, large, threshold), "candidates")
    tied = components(found.where("dense").select("a", "b"))
    pairs = found.where("not dense").select("a", "b").distinct()
    for end in "ab":
        pairs = pairs.join(tied.select(F.col("node").alias(end), F.col("component").alias(f"in_{end}")), end, "left")
    pairs = materialize(pairs.where("in_a is null or in_b is null or in_a <> in_b").select("a", "b"), "pairs")
    ends = tied.unionByName(pairs.select(F.explode(F.array("a", "b")).alias("node"), F.lit(None).cast("long").alias("component")))
    ends = ends.groupBy("node").agg(F.max("component").alias("component")).withColumnRenamed("node", "k")
    held = materialize(classes.select("node", *LABEL, "c", "vector").join(ends, F.col("node") == F.col("k")).drop("k"), "held")
    linked = pair_links(pairs, held, threshold).unionByName(dense_links(held, threshold))
    if some_short:
        linked = linked.unionByName(short_links(classes, means, short, large, threshold))
    linked = materialize(linked, "linked")
    named = components(linked.select("a", "b")).withColumnRenamed("node", "k")
    per = linked.groupBy("a").agg(F.sum("links").alias("links")).join(named, F.col("a") == F.col("k"), "left").select("a", "links", "component")
    known = classes.select("node", "class", "first", "c").join(per, F.col("node") == F.col("a"), "left").where("c > 1 or a is not null")
    known = materialize(known.select("class", "first", F.coalesce("component", "node").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("c") - 1).alias("n_links")), "known")
    least = known.groupBy("component").agg(F.min("first").alias("component_id"))
    of_class = materialize(known.join(least, "component").select(F.col("class").alias("k"), "n_links", "component_id"), "of-class")
    out = every.select("vec_id", "class").join(of_class, F.col("class") == F.col("k"), "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
