"""Most similar vectors by multiprobe p-stable hashing.

Every vector is scaled to unit length and projected on M Gaussian directions; floor((a.v + b) / w) per
direction is its home cell. A query also visits perturbed cells, in the order of the estimated
probability that a vector at the target distance lies there, until that probability adds up to
`success`. Cells are the shuffle keys; inside a cell, finer tables of the same family (again with
perturbed buckets) or a scan in blocks give candidates. Vectors travel as 16-bit fixed-point numbers,
which keep cosines to EPS; lists in which that could change the result are ranked again by the
cosines of the given vectors. The lists of all cells are merged to the k best of each query.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratakb.session import cut

#: Components are rounded to 1/32767, so a cosine of 64 of them is off by less than this.
EPS = 2.5e-4
#: Ids (8 bytes each) that may be broadcast; more are joined by a shuffle.
BROADCAST = 2_000_000
NEAR = np.dtype([("c", "<i8"), ("s", "<f4")])


def usable_units(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of usable vectors (dim finite values, not all zero) and their unit vectors (float32)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.asarray(column.value_lengths().fill_null(0))
    at = np.flatnonzero(lengths == dim)
    if not len(at):
        return at, np.empty((0, dim), np.float32)
    flat = column.take(pa.array(at)).flatten()
    x = np.asarray(flat.cast(pa.float64()).fill_null(math.nan)).reshape(-1, dim)
    with np.errstate(all="ignore"):
        norm = np.sqrt((x * x).sum(1))
    good = np.isfinite(x).all(1) & (x != 0).any(1) & (norm > 0) & np.isfinite(norm)
    return at[good], (x[good] / norm[good, None]).astype(np.float32)


def _normal_cdf(x: np.ndarray) -> np.ndarray:
    """The logistic form is within 1e-4 of the normal distribution, enough to rank cells."""
    return 1.0 / (1.0 + np.exp(-np.clip(x * (1.5976 + 0.07056 * (x * x)), -60, 60)))


@lru_cache(maxsize=16)
def _family(seed: int, dim: int, m: int, w: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng([seed, m])
    mix = rng.integers(1, 2**62, m, dtype=np.int64) * 2 + 1
    return rng.standard_normal((dim, m)), rng.uniform(0, w, m), mix


@lru_cache(maxsize=16)
def _subsets(n: int, most: int) -> list[tuple[int, ...]]:
    return [c for r in range(most + 1) for c in itertools.combinations(range(n), r)]


class Cells:
    """One p-stable hash table: home cells and the perturbed cells in estimated success order."""

    def __init__(self, seed: int, dim: int, m: int, w: float):
        self.m, self.w = m, w
        self.a, self.b, self.mix = _family(seed, dim, m, w)

    def _sum(self, h: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (h.astype(np.int64) * self.mix).sum(-1)

    def _code(self, h: np.ndarray) -> np.ndarray:
        c = self._sum(h)
        return c ^ (c >> np.int64(31))

    def home(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        p = (x.astype(np.float64) @ self.a + self.b) / self.w
        h = np.floor(p)
        return self._code(h), h, (p - h) * self.w

    def probes(self, x: np.ndarray, distance: float, success: float, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) of the cells to visit, the home cell among them: until the success adds up, or the first `most`."""
        if most == 1 or not len(x):
            return np.arange(len(x)), self.home(x)[0]
        few = most in (2, 3) and self._most_of_two(distance) < success
        step = 8192 if self.m < 5 or few else 1024  # the scores of a block of rows stay in the cache
        blocks = (x[i : i + step] for i in range(0, len(x), step))
        parts = [self._nearest(b, most) if few else self._probes(b, distance, success, most) for b in blocks]
        return np.concatenate([r + i * step for i, (r, _) in enumerate(parts)]), np.concatenate([c for _, c in parts])

    def _most_of_two(self, distance: float) -> float:
        """No home cell and one beside it hold more of the probability than this."""
        one, two = (2 * _normal_cdf(np.float64(z * self.w / distance)) - 1 for z in (0.5, 1.0))
        return float(one ** (self.m - 1) * two)

    def _nearest(self, x: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """The first two or three cells where the success doesn't add up before: home and those behind the nearest borders.

        The likelihood of a step falls with the distance of its border, two borders of a direction are never nearer than
        the one on its other side, and two changes are never likelier than each of them.
        """
        _, h, inside = self.home(x)
        code, n = self._sum(h), np.arange(len(x))
        border = np.concatenate([inside, self.w - inside], 1)
        step = np.concatenate([-self.mix, self.mix])
        cells = [code]
        for _ in range(most - 1):
            at = border.argmin(1)
            with np.errstate(over="ignore"):
                cells.append(code + step[at])
            border[n, at] = np.inf
        c = np.concatenate(cells)
        return np.tile(n, most), c ^ (c >> np.int64(31))

    def _probes(self, x: np.ndarray, distance: float, success: float, most: int | None) -> tuple[np.ndarray, np.ndarray]:
        code, h, inside = self.home(x)
        n, m = h.shape
        offsets = np.array([-2, -1, 1, 2])
        edges = [_normal_cdf((i * self.w - inside) / distance) for i in range(-2, 4)]
        mass = {o: np.maximum(edges[o + 3] - edges[o + 2], 1e-12) for o in (-2, -1, 0, 1, 2)}
        ratio = np.stack([mass[o] / mass[0] for o in offsets], 2).reshape(n, m * 4)  # of leaving the home cell along a direction
        # what is likely to be left of the probability lies in few changes of the likeliest directions
        j = min(8 if m < 5 or most else 14, 4 * m)
        best = np.argsort(-ratio, axis=1)[:, :j]
        gain = np.log(np.take_along_axis(ratio, best, 1))
        dims, steps = best // 4, offsets[best % 4]
        stay = np.log(mass[0]).sum(1)
        sets = _subsets(j, min(3 if m < 5 or most else 4, m))
        score = np.full((n, len(sets)), -np.inf)
        for s, chosen in enumerate(sets):
            value = stay + gain[:, list(chosen)].sum(1) if chosen else stay
            clash = np.zeros(n, bool)
            for p, q in itertools.combinations(chosen, 2):
                clash |= dims[:, p] == dims[:, q]
            score[:, s] = np.where(clash, -np.inf, value)
        score[:, 0] = np.maximum(score[:, 0], score.max(1) + 1e-9)  # the home cell comes first
        order = np.argsort(-score, axis=1, kind="stable")[:, :most]
        chance = np.exp(np.take_along_axis(score, order, 1))
        before = np.cumsum(chance, 1) - chance
        keep = (before < success) & (chance > 0)
        keep[:, 0] = True
        rows, cells = [], []
        for rank in range(order.shape[1]):
            r = np.flatnonzero(keep[:, rank])
            if not len(r):
                continue
            g = h[r].copy()
            for s in np.unique(order[r, rank]):
                of = np.flatnonzero(order[r, rank] == s)
                for p in sets[s]:
                    g[of, dims[r[of], p]] += steps[r[of], p]
            rows.append(r)
            cells.append(self._code(g))
        return np.concatenate(rows), np.concatenate(cells)


COPY = pa.schema([("key", pa.int64()), ("cell", pa.int64()), ("home", pa.bool_()), ("query", pa.bool_()), ("v", pa.binary())])


def _units(v: pa.Array, dim: int) -> np.ndarray:
    """Unit vectors (float32) of packed 16-bit numbers."""
    v = v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v
    v = v.chunk(0) if isinstance(v, pa.ChunkedArray) else v
    x = np.frombuffer(v.buffers()[2], "<i2", len(v) * dim, int(np.frombuffer(v.buffers()[1], "<i4")[v.offset])).reshape(len(v), dim).astype(np.float32)
    x /= np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
    return x


def _packed(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[pa.RecordBatch]:
    """The usable vectors as unit vectors in 16-bit fixed point."""
    for batch in batches:
        at, x = usable_units(batch.column("vec"), dim)
        if not len(at):
            continue
        at = pa.array(at)
        ends = pa.py_buffer((np.arange(len(at) + 1) * 2 * dim).astype(np.int32))
        v = pa.Array.from_buffers(pa.binary(), len(at), [None, ends, pa.py_buffer(np.rint(x * 32767).astype("<i2").tobytes())])
        yield pa.record_batch([batch.column("key").take(at), batch.column("query").fill_null(False).take(at), v], names=["key", "query", "v"])


def _copies(batches: Iterator[pa.RecordBatch], dim: int, m: int, w: float, seed: int, distance: float, success: float, vectors: bool) -> Iterator[pa.RecordBatch]:
    """Rows with the cells they lie in or ask; without vectors, how many rows of each cell do so."""
    table = Cells(seed, dim, m, w)
    for batch in batches:
        if not batch.num_rows:
            continue
        x = _units(batch.column("v"), dim)
        key, query = np.asarray(batch.column("key")), np.asarray(batch.column("query"))
        home, _, _ = table.home(x)
        asks = np.flatnonzero(query)
        r, c = table.probes(x[asks], distance, success)
        if not vectors:
            cells, at = np.unique(np.concatenate([home, c]), return_inverse=True)
            lie, ask = np.bincount(at[: len(home)], minlength=len(cells)), np.bincount(at[len(home) :], minlength=len(cells))
            yield pa.record_batch([pa.array(cells), pa.array(lie), pa.array(ask)], names=["cell", "lie", "ask"])
            continue
        r = asks[r]
        away = c != home[r]
        rows = np.concatenate([np.arange(len(x)), r[away]])
        cells = np.concatenate([home, c[away]])
        first = np.arange(len(rows)) < len(x)
        yield pa.record_batch([pa.array(key[rows]), pa.array(cells), pa.array(first), pa.array(query[rows]), batch.column("v").take(pa.array(rows))], schema=COPY)


def _best(q: np.ndarray, c: np.ndarray, s: np.ndarray, qkey: np.ndarray, ckey: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each q, each c once with its best cosine; ties by the candidate's key."""
    if not len(q):
        return q, c, s
    pair = q.astype(np.int64) * (int(c.max()) + 1) + c
    order = np.argsort(pair)
    pair = pair[order]
    start = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
    del pair
    s = np.maximum.reduceat(s[order], start)
    order = order[start]
    q, c = q[order], c[order]
    bits = (s.astype(np.float32) + np.float32(0)).view(np.int32)  # whole numbers in the order of the cosines
    rank = (q.astype(np.int64) << 32) + (0x7FFFFFFF - (bits ^ ((bits >> 31) & 0x7FFFFFFF)).astype(np.int64))
    order = np.argsort(rank)
    rank = rank[order]
    same = rank[1:] == rank[:-1]
    tied = np.flatnonzero(np.r_[same, False] | np.r_[False, same])
    order[tied] = order[tied][np.lexsort((ckey[c[order[tied]]], rank[tied]))]
    q, c, s = q[order], c[order], s[order]
    start = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
    rank = np.arange(len(q)) - np.repeat(start, np.diff(np.r_[start, len(q)]))
    top = rank < k
    return q[top], c[top], s[top]


def search_cell(key: np.ndarray, home: np.ndarray, query: np.ndarray, x: np.ndarray, k: int, min_sim: float, tables: int, probes: int, distance: float, scan: bool, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, candidate row, cosine) of one cell: queries against home rows, each key once."""
    index, asks = (np.flatnonzero(z).astype(np.int32) for z in (home, query))
    got: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    best: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # what was folded so far
    most, held = k + 4, 0
    if not len(index) or not len(asks):
        return np.array([], int), np.array([], int), np.array([], np.float32)

    def taken() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What was got, without the pairs of one key; got is empty then."""
        q, c, s = (np.concatenate(z) for z in zip(*got))
        got.clear()
        other = key[q] != key[c]
        return q[other], c[other], s[other]

    def fold() -> None:
        """Keep the best of each query of what was got; memory stays bounded however many pairs are close."""
        best.append(taken())
        if min_sim > -1:  # the cosine is symmetric: what a query finds holds for its candidate too
            q, c, s = best[-1]
            back = query[c]
            best.append((c[back], q[back], s[back]))
            del q, c, s
        q, c, s = (np.concatenate(z) for z in zip(*best))
        best.clear()
        best.append(_best(q, c, s, key, key, most))

    def compare(q: np.ndarray, c: np.ndarray) -> None:
        nonlocal held
        step = max(1, 2_000_000 // max(1, len(c)))
        for i in range(0, len(q), step):
            sim = x[q[i : i + step]] @ x[c].T
            if min_sim <= -1 and sim.shape[1] > most + 1:
                at = np.argpartition(-sim, most, axis=1)[:, : most + 1]
                a = np.repeat(np.arange(len(sim)), at.shape[1])
                b = at.ravel()
            else:
                close = sim >= min_sim
                if np.count_nonzero(close) > 4 * most * sum(sim.shape):  # the best of each row and of each column
                    top = np.zeros(sim.shape, bool)
                    for axis in (0, 1):
                        n = min(most + 1, sim.shape[axis])
                        np.put_along_axis(top, np.argpartition(-sim, n - 1, axis=axis).take(range(n), axis), True, axis)
                    close &= top
                at = np.flatnonzero(close)  # much faster than nonzero of a table
                a = at // sim.shape[1]
                b = at - a * sim.shape[1]
            got.append((q[i : i + step][a], c[b], sim[a, b]))
            held += len(a)
            if held > 2_000_000:
                fold()
                held = 0

    if scan or len(index) * len(asks) <= 250_000:
        compare(asks, index)
    else:
        m = max(2, math.ceil(math.log(max(len(index) / 320, 2)) / math.log(2.4)))
        for t in range(tables):
            fine = Cells(seed + 101 + t, x.shape[1], m, 1.5)
            codes = np.concatenate([fine.home(x[index[i : i + 8192]])[0] for i in range(0, len(index), 8192)])
            order = np.argsort(codes, kind="stable")
            codes, rows = codes[order], index[order]
            parts = [(i, *fine.probes(x[asks[i : i + 8192]], distance, 0.98, probes)) for i in range(0, len(asks), 8192)]
            r, c = np.concatenate([r + i for i, r, _ in parts]), np.concatenate([c for _, _, c in parts])
            by = np.argsort(c, kind="stable")
            r, c = asks[r[by]], c[by]
            cells, start = np.unique(c, return_index=True)
            end = np.r_[start[1:], len(c)]
            lo, hi = np.searchsorted(codes, cells, "left"), np.searchsorted(codes, cells, "right")
            for i in np.flatnonzero(hi > lo):
                if hi[i] - lo[i] > 1 or end[i] - start[i] > 1 or rows[lo[i]] != r[start[i]]:
                    compare(r[start[i] : end[i]], rows[lo[i] : hi[i]])
            if got:  # what the tables have in common is held once
                q, c2, s = taken()
                pair = q * np.int64(len(x)) + c2
                order = np.argsort(pair)
                pair = pair[order]
                order = np.r_[order[:1], order[1:][pair[1:] != pair[:-1]]]
                got.append((q[order], c2[order], s[order]))
                held = len(order)
    if best and got:
        fold()
    if best:
        return best[0]
    q, c, s = taken() if got else (np.array([], int),) * 2 + (np.array([], np.float32),)
    if min_sim > -1:
        back = query[c]
        q, c, s = np.r_[q, c[back]], np.r_[c, q[back]], np.r_[s, s[back]]
    return q, c, s


def _members_best(near: DataFrame, members: DataFrame, k: int, min_sim: float) -> DataFrame:
    """(key, near, sim) by key, of lists by class: members has the keys of each class of equal vectors.

    Of a class only its first k + 1 keys can be in a list, and only the k + 1 best of a list can be wanted by a member.
    """
    salted = members.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(64)))
    for by in (["cls", "salt"], ["cls"]):
        salted = salted.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy("key"))).where(F.col("n") <= k + 1)
    shown = salted.select("cls", F.col("key").alias("shown"))
    asked = members.where("query").select(F.col("cls").alias("id"), F.col("key").alias("asker"))
    near = near.select(F.col("key").alias("id"), "near", "sim")
    others = near.join(shown, near["near"] == shown["cls"], "left").select("id", F.coalesce("shown", "near").alias("near"), F.least("sim", F.lit(1.0)).alias("sim"))
    own = shown.join(asked.select(F.col("id").alias("cls")).distinct(), "cls", "left_semi").select(F.col("cls").alias("id"), F.col("shown").alias("near"), F.lit(1.0).alias("sim"))
    lists = others.unionByName(own.where(F.lit(min_sim <= 1)))
    for by, n in (("id", k + 1), ("key", k)):
        best = lists.repartition(by).groupBy(by, "near").agg(F.max("sim").alias("sim"))
        best = best.withColumn("n", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("sim"), "near"))).where(F.col("n") <= n).drop("n")
        if by == "key":
            return best
        lists = best.join(asked, "id", "left").select(F.coalesce("asker", "id").alias("key"), "near", "sim").where("key <> near")


def _full(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[pa.RecordBatch]:
    """The usable vectors in fixed point and as unit vectors in double precision."""
    for batch in batches:
        at, x = usable_units(batch.column("vec"), dim)
        if len(at):
            full = [row.tobytes() for row in np.asarray(batch.column("vec").take(pa.array(at)).flatten().cast(pa.float64())).reshape(-1, dim)]
            v = [row.tobytes() for row in np.rint(x * 32767).astype("<i2")]
            yield pa.record_batch([batch.column("key").take(pa.array(at)), pa.array(v, pa.binary()), pa.array(full, pa.binary())], names=["key", "v", "full"])


def _exact(pairs: DataFrame, vectors: DataFrame, min_sim: float, dim: int) -> DataFrame:
    """(key, near, sim) of those pairs (key, near, slots) that stay: the best `slots` of each key by the cosines of the given vectors (key, vec).

    An id is a key or a class of equal vectors; of several vectors of one key the best pair counts. The
    ids are broadcast only up to BROADCAST of them, so that the vectors needn't be shuffled for a few.
    """
    ids = cut(pairs.select(F.explode(F.array("key", "near")).alias("id")).distinct(), "ids")
    full = vectors.mapInArrow(lambda b: _full(b, dim), "key long, v binary, full binary")
    full = full.select(F.explode(F.array_distinct(F.array("key", F.xxhash64("v")))).alias("id"), "full")
    full = full.join(F.broadcast(ids) if ids.count() <= BROADCAST else ids, "id").distinct()

    def cosines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.float64).reshape(-1, dim) for c in ("x", "y"))
            x, y = (z / np.maximum(np.abs(z).max(1, initial=0), 1e-300)[:, None] for z in (x, y))
            sims = (x * y).sum(1) / np.sqrt((x * x).sum(1) * (y * y).sum(1))
            yield pa.record_batch([batch.column("key"), batch.column("near"), batch.column("slots"), pa.array(sims)], names=["key", "near", "slots", "sim"])

    a, b = full.select(F.col("id").alias("key"), F.col("full").alias("x")), full.select(F.col("id").alias("near"), F.col("full").alias("y"))
    both = pairs.select("key", "near", "slots").join(a, "key").join(b, "near").select("key", "near", "slots", "x", "y")
    sims = both.mapInArrow(cosines, "key long, near long, slots int, sim double").groupBy("key", "near", "slots").agg(F.max("sim").alias("sim")).where(F.col("sim") >= min_sim)
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("sim"), "near"))
    return sims.withColumn("n", rank).where("n <= slots").select("key", "near", "sim")


def most_similar(df: DataFrame, k: int = 10, min_sim: float = -1.0, dim: int = 64, cell_rows: int = 150_000, distance: float = 0.45, success: float = 0.97, tables: int = 6, probes: int = 3, scan: bool = False, seed: int = 20) -> DataFrame:
    """(key, near, sim): the k most similar other keys of every query row of df (key, vec, query).

    Vectors of another length than dim, with null or non-finite values, or all zero are left out; rows
    of one key with the same vector count once; ties are ordered by key; an empty table gives an empty
    result. Equal vectors are one class that is searched once; a table of its keys gives each its list.
    The number of directions follows the row count so that cells stay near cell_rows. A cell with over
    twice that many rows, or asked by over four times as many, is split on a grid: its rows in one
    direction and its queries in the other, so no task holds more than that of either, and every query
    still meets every row. min_sim drops candidates below that cosine. A query visits cells until the
    estimated success for a neighbour at `distance` reaches `success`, however many they are: recall
    stays where it is as cells multiply, and the copies of a query grow (README has both by directions).
    """
    rows = df.count()
    given = df.select("key", "vec", "query")
    m = max(1, math.ceil(math.log(max(rows / cell_rows, 1.5)) / math.log(2.7)))
    w, held, asked = 1.5, 2 * cell_rows, 4 * cell_rows
    packed = given.mapInArrow(lambda b: _packed(b, dim), "key long, query boolean, v binary").withColumn("cls", F.xxhash64("v"))
    repeated = cut(packed.groupBy("cls").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi")).where("n > 1").select("cls", "lo", "hi"), "repeated")
    shared = repeated.where("lo < hi").select("cls")
    once = packed.join(repeated, "cls").groupBy("cls").agg(F.first("lo").alias("lo"), F.first("hi").alias("hi"), F.max("query").alias("query"), F.first("v").alias("v"))
    once = once.select(F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(F.col("cls")).alias("key"), "query", "v")
    df = packed.join(repeated, "cls", "left_anti").select("key", "query", "v").unionByName(once)
    members = None if shared.isEmpty() else cut(packed.join(shared, "cls").groupBy("cls", "key").agg(F.max("query").alias("query")), "members")
    k2 = k if members is None else k + 4
    k1 = k2 + 4  # what rounding could bring in
    count = df.mapInArrow(lambda b: _copies(b, dim, m, w, seed, distance, success, False), "cell long, lie long, ask long").groupBy("cell").agg(F.sum("lie").alias("lie"), F.sum("ask").alias("ask"))
    split = lambda n, most: F.greatest(F.ceil(F.col(n) / most), F.lit(1)).cast("int")
    hot = F.broadcast(count.select("cell", split("lie", held).alias("ni"), split("ask", asked).alias("nq")).where("ni * nq > 1"))  # at most rows / held + copies / asked rows
    copies = df.mapInArrow(lambda b: _copies(b, dim, m, w, seed, distance, success, True), "key long, cell long, home boolean, query boolean, v binary")
    copies = copies.join(hot, "cell", "left").withColumns({"ni": F.coalesce("ni", F.lit(1)), "nq": F.coalesce("nq", F.lit(1))})
    copies = copies.withColumns({"i": F.pmod(F.xxhash64("key"), "ni").cast("int"), "q": F.pmod(F.xxhash64("key", F.lit(1)), "nq").cast("int")})
    lies = F.when(F.col("home"), F.transform(F.sequence(F.lit(0), F.col("nq") - 1), lambda q: F.col("i") * F.col("nq") + q)).otherwise(F.array().cast("array<int>"))
    asks = F.when(F.col("query"), F.transform(F.sequence(F.lit(0), F.col("ni") - 1), lambda i: i * F.col("nq") + F.col("q"))).otherwise(F.array().cast("array<int>"))
    copies = copies.withColumn("part", F.explode(F.array_union(lies, asks)))
    own_i, own_q = F.floor(F.col("part") / F.col("nq")) == F.col("i"), F.col("part") % F.col("nq") == F.col("q")
    copies = copies.select("key", "cell", "part", (F.col("home") & own_i).alias("home"), (F.col("query") & own_q).alias("query"), "v")
    low = max(min_sim - EPS, -1.0)

    def one(group: pa.Table) -> pa.Table:
        key = np.asarray(group.column("key"))
        x = _units(group.column("v"), dim)
        home, query = np.asarray(group.column("home")), np.asarray(group.column("query"))
        q, c, s = search_cell(key, home, query, x, k1, low, tables, probes, distance, scan, seed)
        _, dense = np.unique(key, return_inverse=True)  # rows repeated under one key count once
        first = np.zeros(dense.max() + 1, int)
        first[dense[::-1]] = np.arange(len(key))[::-1]
        q, c, s = _best(dense[q], dense[c], s, key[first], key[first], k1)
        near = np.empty(len(q), NEAR)
        near["c"], near["s"] = key[first[c]], s
        start = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.array([], int)
        ends = np.r_[start[1:], len(q)] if len(q) else start
        return pa.table({"key": pa.array(key[first[q[start]]] if len(q) else np.array([], np.int64)), "near": pa.array([near[a:b].tobytes() for a, b in zip(start, ends)], pa.binary())})

    lists = copies.groupBy("cell", "part").applyInArrow(one, "key long, near binary")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = np.asarray(batch.column("key"))
            joined = [b"".join(x) for x in batch.column("lists").to_pylist()]
            near = np.frombuffer(b"".join(joined), NEAR)
            q = np.repeat(np.arange(len(key)), [len(x) // NEAR.itemsize for x in joined])
            cand, c = np.unique(near["c"], return_inverse=True)
            q, c, s = _best(q, c, near["s"], key, cand, k1)
            start = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.array([], int)
            size = np.diff(np.r_[start, len(q)])
            rank = np.arange(len(q)) - np.repeat(start, size)
            long = size > k2
            in_, out = np.full(len(start), -2.0), np.full(len(start), -2.0)  # cosines of the last in the list and the first behind it
            in_[long], out[long] = s[start[long] + k2 - 1], s[start[long] + k2]
            in_, out = np.repeat(in_, size), np.repeat(out, size)
            # what could change places with the other side of the boundary, or of min_sim
            doubt = np.where(rank < k2, s - out <= 2 * EPS, in_ - s <= 2 * EPS) & np.repeat(long, size) | (s - min_sim <= EPS)
            doubt &= s - min_sim > -EPS
            sure = ~doubt & (rank < k2) & (s >= min_sim)
            slots = k2 - np.repeat(np.add.reduceat(sure, start, dtype=np.int32) if len(q) else np.array([], np.int32), size)
            if not min_sim > -1:  # of a few queries all cosines are exact
                doubt, sure, slots = np.ones(len(q), bool), np.zeros(len(q), bool), np.full(len(q), k2)
            keep = doubt | sure
            yield pa.record_batch([pa.array(key[q[keep]]), pa.array(cand[c[keep]]), pa.array(s[keep]), pa.array(np.where(sure, 0, slots)[keep].astype(np.int32))], names=["key", "near", "sim", "slots"])

    near = cut(lists.groupBy("key").agg(F.collect_list("near").alias("lists")).mapInArrow(merge, "key long, near long, sim float, slots int"), "near")
    near = near.where("slots = 0").select("key", "near", F.col("sim").cast("double").alias("sim")).unionByName(_exact(near.where("slots > 0"), given, min_sim, dim))
    return near if members is None else _members_best(near, members, k, min_sim)
