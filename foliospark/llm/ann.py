"""Approximate nearest neighbours by multiprobe p-stable hashing.

A table hashes a vector by ``floor((a_j . x + b_j) / w)`` for a few Gaussian (2-stable) ``a_j``; ``w`` follows the spread of
all projections and the number of hashes that of the rows. For a neighbour at distance r of a query, the difference of their projections is
normal with deviation r, so each bucket around the query, perturbed in one hash or more, has an estimated probability of holding it. Buckets
are visited in the order of that estimate until the visited ones together reach ``SUCCESS`` for a table: where the order ends follows from
the distribution of the log-probabilities, a convolution over the hashes. r is no guess: the k-th distance in a sample of ``SAMPLE`` vectors, and then
in the query's own bucket, bounds that of the k-th neighbour. Close neighbours take few probes, and far ones many.

All rows are indexed. The first few hashes of a table say in which shard a vector is; a query goes to the shards that buckets it visits
may be in. Large shards are cut into parts. A task holds the vectors of one part and lets the queries stream by; exact distances rank the candidates there,
and the lists of parts and tables are merged by query.
"""

from __future__ import annotations

from functools import lru_cache
from math import erf, log, sqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.llm.arrow import runs
from foliospark.runtime import discard, materialise

K = 10
TABLES = 2
#: Of a table; that of all tables is 1 - (1 - SUCCESS) ** TABLES.
SUCCESS = 0.85
#: Vectors of a bucket, about, and width of a bucket in deviations of a projection.
BUCKET_ROWS, WIDTH = 256, 1.5
#: Vectors of a part, about: what a task holds in memory.
SHARD_ROWS = 25_000
#: Vectors of each length from which first bounds and the number of parts are taken; the index holds all.
SAMPLE = 2048
SEED = 20_25
_BLOCK = 512
#: Log-probabilities are told apart by steps of this, down to exp(-_STEP * _STEPS).
_STEP, _STEPS = 0.05, 800


@lru_cache(8)
def _planes(dim: int, hashes: int, tables: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(directions, offsets in widths): [tables, dim, hashes] and [tables, hashes]."""
    rng = np.random.default_rng(seed)
    return rng.standard_normal((tables, dim, hashes)), rng.random((tables, hashes))


def hashes_for(rows: int, each: int = BUCKET_ROWS) -> int:
    """Enough for about ``each`` rows in a bucket, at 1.3 bits of a hash."""
    return max(0, round(log(max(1.0, rows / each), 2) / 1.3))


_GRID = np.vectorize(erf)(np.linspace(-4, 4, 8193))


def _fast_erf(x: np.ndarray) -> np.ndarray:
    at = np.clip((x + 4) * 1024, 0, 8192)
    low = np.minimum(at.astype(np.int64), 8191)
    return _GRID[low] + (at - low) * (_GRID[low + 1] - _GRID[low])


def cell_logs(place: np.ndarray, spread: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first cell, log-probabilities of it and the following ones) for each of place, in widths, and deviation spread, in widths, too."""
    reach = max(1, int(np.ceil(float(spread.max()) * 4.3))) if len(spread) else 1
    cells = np.floor(place)[..., None] + np.arange(-reach, reach + 1)
    s = np.maximum(spread, 1e-9)[:, None, None] * sqrt(2)
    left, right = (cells - place[..., None]) / s, (cells + 1 - place[..., None]) / s
    mass = 0.5 * (_fast_erf(right) - _fast_erf(left))
    return cells[..., 0].astype(np.int64), np.log(np.maximum(mass, 1e-30))


def last_visited(logs: np.ndarray, success: float) -> np.ndarray:
    """For each query the log-probability, to within a step, of the last bucket it visits; logs is [queries, hashes, cells].

    Buckets visited in descending order of probability add up to ``success`` there. How the probability is spread over log-probabilities
    is the convolution of the hashes' own distributions, so no bucket is made to find out.
    """
    n, hashes, cells = logs.shape
    mass = np.zeros((n, _STEPS))
    mass[:, 0] = 1.0
    cost = np.minimum(np.rint(-logs / _STEP), _STEPS).astype(np.int64)
    steps = np.arange(_STEPS)
    for j in range(hashes):
        # One more column, always empty, is what shifts before the first step read.
        padded = np.concatenate([mass, np.zeros((n, 1))], 1)
        mass = np.zeros((n, _STEPS))
        for c in range(cells):
            if (cost[:, j, c] < _STEPS).any():
                at = steps[None] - cost[:, j, c, None]
                mass += np.exp(logs[:, j, c])[:, None] * np.take_along_axis(padded, np.where(at < 0, _STEPS, at), 1)
    found = np.cumsum(mass, 1)
    # What lies beyond the last step counts as out of reach.
    upto = (found < np.minimum(success, found[:, -1:] - 1e-12)).sum(1)
    return -(np.minimum(upto, _STEPS - 1) + 0.5) * _STEP


def _spread_bits(key: np.ndarray, cell: np.ndarray) -> np.ndarray:
    h = (key.view(np.uint64) ^ cell.astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    return (h ^ (h >> np.uint64(29))).view(np.int64)


class Hashing:
    """The hash tables of vectors of one length: their planes, widths and shards."""

    def __init__(self, dim: int, rows: int, spread: float, tables: int = TABLES, seed: int = SEED, shard_rows: int = SHARD_ROWS):
        self.dim, self.rows, self.tables, self.seed = dim, rows, tables, seed
        self.hashes = max(1, hashes_for(rows))
        self.width = WIDTH * (spread or 1.0)
        self.leading = min(self.hashes, hashes_for(rows, shard_rows))
        self.parts: list[dict[int, int]] = [{} for _ in range(tables)]

    def fit(self, sample: np.ndarray, shard_rows: int) -> None:
        """How many parts the sample's shards are cut into; others are one."""
        for t in range(self.tables if len(sample) else 0):
            keys, n = np.unique(self.shards(sample, t), return_counts=True)
            self.parts[t] = {int(s): p for s, c in zip(keys, n, strict=True) if (p := -(-int(c) * self.rows // (len(sample) * shard_rows))) > 1}

    def places(self, x: np.ndarray, table: int) -> np.ndarray:
        a, b = _planes(self.dim, self.hashes, self.tables, self.seed)
        return x @ a[table] / self.width + b[table]

    def shards(self, x: np.ndarray, table: int) -> np.ndarray:
        """The shard of each vector, named by a hash of its leading cells. Where two have the same name, they are one."""
        key = np.zeros(len(x), np.int64)
        cells = np.floor(self.places(x, table)).astype(np.int64)
        for j in range(self.leading):
            key = _spread_bits(key, cells[:, j])
        return key

    def n_parts(self, keys: np.ndarray, table: int) -> np.ndarray:
        known = self.parts[table]
        return np.array([known.get(k, 1) for k in keys.tolist()], np.int64)

    def visits(self, x: np.ndarray, reach: np.ndarray, table: int, success: float):
        """(position, shard, last log-probability) for each shard that may hold a bucket that a query with a k-th candidate at distance reach visits.

        A query with an infinite reach, for which there are not k others, visits all there is.
        """
        place, out = self.places(x, table), []
        # The cells on offer depend on the largest spread of a block, so blocks are of queries with like spreads.
        order = np.argsort(reach, kind="stable")
        order = order[np.isfinite(reach[order])]
        for at in range(0, len(order), _BLOCK):
            some = order[at : at + _BLOCK]
            first, logs = cell_logs(place[some], reach[some] / self.width)
            last = last_visited(logs, success)
            best = logs.max(2)
            q, key, score = np.arange(len(some)), np.zeros(len(some), np.int64), best.sum(1)
            for j in range(self.leading):
                longer = (score - best[q, j])[:, None] + logs[q, j]
                row, cell = np.nonzero(longer >= last[q, None] - 1e-9)
                key, score = _spread_bits(key[row], first[q[row], j] + cell), longer[row, cell]
                q = q[row]
            q, key = np.unique(np.stack([q, key], 1), axis=0).T if len(q) else (q, key)
            out.append((some[q], key, last[q]))
        rest = np.flatnonzero(~np.isfinite(reach))
        # There are few rows then, and one shard.
        out.append((rest, np.zeros(len(rest), np.int64), np.full(len(rest), -np.inf)))
        return tuple(np.concatenate(o) for o in zip(*out, strict=True))


def _vectors(column, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


class Best:
    """The k nearest so far of each query, by (distance, id)."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.d = np.full((queries, k), np.inf)
        self.i = np.full((queries, k), np.iinfo(np.int64).max)

    def offer(self, rows: np.ndarray, d: np.ndarray, ids: np.ndarray) -> None:
        """d[j, c]: squared distance of query rows[j] and candidate ids[c]; infinite for none."""
        k = self.k
        if d.shape[1] > 4 * k:
            # Only what may be among the k best takes part, ties of the last one with it.
            bound = np.minimum(np.partition(d, k - 1, axis=1)[:, k - 1], self.d[rows, k - 1])
            most = int((d <= bound[:, None]).sum(1).max())
            if most < d.shape[1]:
                some = np.argpartition(d, max(most - 1, 0), axis=1)[:, : max(most, 1)]
                d, ids = np.take_along_axis(d, some, 1), ids[some]
        both_d = np.concatenate([self.d[rows], d], 1)
        both_i = np.concatenate([self.i[rows], np.broadcast_to(ids, d.shape)], 1)
        order = np.lexsort((both_i, both_d), axis=1)[:, :k]
        self.d[rows] = np.take_along_axis(both_d, order, 1)
        self.i[rows] = np.take_along_axis(both_i, order, 1)


def _square(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.maximum((q * q).sum(1)[:, None] + (x * x).sum(1)[None] - 2 * (q @ x.T), 0)


class Part:
    """The vectors a task holds, by bucket of one table."""

    def __init__(self, h: Hashing, table: int, ids: np.ndarray, x: np.ndarray):
        cells = np.floor(h.places(x, table)).astype(np.int64)
        order = np.lexsort((ids, *cells.T[::-1]))
        self.h, self.table, self.ids, self.x = h, table, ids[order], x[order]
        cells = cells[order]
        new = np.ones(len(cells), bool)
        new[1:] = (cells[1:] != cells[:-1]).any(1)
        self.starts, self.cells = np.append(np.flatnonzero(new), len(cells)), cells[new]
        # Buckets are looked at a few together, of so many vectors that the products pay.
        self.groups, at = [], 0
        while at < len(self.cells):
            to = max(at + 1, int(np.searchsorted(self.starts, self.starts[at] + 2 * _BLOCK, "right")) - 1)
            self.groups.append((at, to))
            at = to

    def _visited(self, q: np.ndarray, reach: np.ndarray, last: np.ndarray) -> np.ndarray:
        """[queries, buckets]: whether each query visits each bucket."""
        place = self.h.places(q, self.table)
        if not len(q) or not np.isfinite(reach).all():
            return np.repeat(~np.isfinite(reach)[:, None], len(self.cells), 1)
        first, logs = cell_logs(place, reach / self.h.width)
        score = np.zeros((len(q), len(self.cells)))
        for j in range(self.h.hashes):
            rel = self.cells[None, :, j] - first[:, j, None]
            inside = (rel >= 0) & (rel < logs.shape[2])
            score += np.where(inside, np.take_along_axis(logs[:, j], np.where(inside, rel, 0), 1), -np.inf)
        return score >= last[:, None] - 1e-9

    def own(self, q: np.ndarray) -> np.ndarray:
        """[queries, buckets]: the bucket each is in itself."""
        return (np.floor(self.h.places(q, self.table)).astype(np.int64)[:, None] == self.cells[None]).all(2)

    def search(self, ids: np.ndarray, q: np.ndarray, reach: np.ndarray | None, last: np.ndarray | None, k: int) -> Best:
        """Exact distances of each query to the vectors of the buckets it visits; where reach is None, of its own bucket."""
        best = Best(len(q), k)
        order = np.argsort(reach, kind="stable") if reach is not None else np.arange(len(q))
        bounded = int(np.isfinite(reach).sum()) if reach is not None else len(q)
        for some in [order[a : min(a + _BLOCK, e)] for s, e in ((0, bounded), (bounded, len(q))) for a in range(s, e, _BLOCK)]:
            seen = self.own(q[some]) if reach is None else self._visited(q[some], reach[some], last[some])
            for a, b in self.groups:
                rows = np.flatnonzero(seen[:, a:b].any(1))
                for c in range(self.starts[a], self.starts[b], 4 * _BLOCK) if len(rows) else ():
                    e = min(c + 4 * _BLOCK, self.starts[b])
                    here = np.repeat(np.arange(a, b), np.diff(self.starts[a : b + 1]))[c - self.starts[a] : e - self.starts[a]]
                    d = _square(q[some[rows]], self.x[c:e])
                    d[~seen[rows][:, here] | (ids[some[rows]][:, None] == self.ids[c:e][None])] = np.inf
                    best.offer(some[rows], d, self.ids[c:e])
        return best


_ROW = "dim int, shard_table int, shard long, part int, query int, id long, v array<float>, reach double, last double"


def _rows(dim: int, table: int, shard: np.ndarray, part: np.ndarray, query: int, ids, v, reach=None, last=None) -> pa.RecordBatch:
    n = len(shard)
    same = lambda x: pa.array(np.full(n, x), pa.int32())
    none = np.zeros(n)
    return pa.RecordBatch.from_arrays([same(dim), same(table), pa.array(shard, pa.int64()), pa.array(part, pa.int32()), same(query), ids, v, pa.array(none if reach is None else reach), pa.array(none if last is None else last)], [c.split()[0] for c in _ROW.split(", ")])


def nearest(vectors: DataFrame, queries: Column | str | None = None, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", tables: int = TABLES, success: float = SUCCESS, seed: int = SEED, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(vec_id, neighbour_id, rank, distance): for each query its k nearest others among all rows, by distance, then id.

    queries is a condition on the rows of vectors; without it each row is one. Vectors of each length are searched by themselves. Rows with a null id, a null
    or empty vector, or a null or not finite component have no neighbours and are none. Of rows that share an id the one with the least vector counts, and it
    is a query if any of them is. With k others or fewer each query gets
    all that are found. An empty table gives an empty result; other columns are ignored. Equal vectors are neighbours at distance 0.
    """
    spark = vectors.sparkSession
    v = F.col(vector_col).cast("array<float>")
    asks = F.lit(True) if queries is None else F.coalesce(F.expr(queries) if isinstance(queries, str) else queries, F.lit(False))
    good = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v"), asks.alias("query")).filter("id is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < float('inf'))")
    points = materialise(good.groupBy("id").agg(F.min("v").alias("v"), F.max("query").alias("query")), "vectors")

    def sums(batches):
        total: dict[int, list] = {}
        for batch in batches:
            for dim, some in _by_length(batch.column(0)):
                x = _vectors(batch.column(0).take(pa.array(some)), dim)
                t = total.setdefault(dim, [0, np.zeros(dim), np.zeros(dim)])
                total[dim] = [t[0] + len(x), t[1] + x.sum(0), t[2] + (x * x).sum(0)]
        for dim, (n, s, ss) in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(dim, dim), pa.int32()), pa.array(np.arange(dim), pa.int32()), pa.array(np.full(dim, n)), pa.array(s), pa.array(ss)], ["dim", "pos", "n", "s", "ss"])

    # The spread of a projection on a Gaussian direction is the root of the total variance, from sums over all rows. One row for each length comes to the driver.
    parts = points.select("v").mapInArrow(sums, "dim int, pos int, n long, s double, ss double").groupBy("dim", "pos").agg(*(F.sum(c).alias(c) for c in ("n", "s", "ss")))
    spread = parts.groupBy("dim").agg(F.max("n").alias("n"), F.sum(F.col("ss") / F.col("n") - F.pow(F.col("s") / F.col("n"), 2)).alias("var")).collect()
    # Nine digits, so that the order of summation doesn't show.
    known = {r.dim: Hashing(r.dim, r.n, float(f"{sqrt(max(r['var'], 0.0)):.9g}"), tables, seed, shard_rows) for r in spread}
    first = Window.partitionBy(F.size("v")).orderBy(F.xxhash64("id"), "id")
    drawn = points.select("id", "v", F.row_number().over(first).alias("n")).filter(F.col("n") <= SAMPLE).orderBy("n", "id").toArrow()
    sample = {dim: (drawn.column("id").to_numpy()[some], _vectors(drawn.column("v").take(pa.array(some)), dim)) for dim, some in _by_length(drawn.column("v"))}
    for dim, h in known.items():
        h.fit(sample[dim][1], shard_rows)

    def index(batch, n_tables):
        for dim, some in _by_length(batch.column("v")):
            h, take = known[dim], pa.array(some)
            ids, column = batch.column("id").take(take), batch.column("v").take(take)
            x, i = _vectors(column, dim), ids.to_numpy(zero_copy_only=False).view(np.uint64)
            for t in range(n_tables):
                shard = h.shards(x, t)
                part = (((i * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) % h.n_parts(shard, t).astype(np.uint64)).astype(np.int32)
                yield _rows(dim, t, shard, part, 0, ids, column)

    def ask(dim, t, at, shard, ids, column, reach, last):
        """Rows of queries for all parts of the shards they go to."""
        n = known[dim].n_parts(shard, t)
        part = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at, shard = np.repeat(at, n), np.repeat(shard, n)
        return _rows(dim, t, shard, part, 1, ids.take(pa.array(at)), column.take(pa.array(at)), reach[at], None if last is None else np.repeat(last, n))

    def route_own(batches):
        for batch in batches:
            yield from index(batch, 1)
            batch = batch.filter(batch.column("query"))
            for dim, some in _by_length(batch.column("v")):
                h, take = known[dim], pa.array(some)
                ids, column = batch.column("id").take(take), batch.column("v").take(take)
                x = _vectors(column, dim)
                seen, others = sample[dim]
                reach = np.full(len(x), np.inf)
                for a in range(0, len(x), _BLOCK):
                    d = _square(x[a : a + _BLOCK], others)
                    d[ids.to_numpy(zero_copy_only=False)[a : a + _BLOCK, None] == seen[None]] = np.inf
                    if d.shape[1] >= k:
                        reach[a : a + _BLOCK] = np.sqrt(np.partition(d, k - 1, axis=1)[:, k - 1])
                yield ask(dim, 0, np.arange(len(x)), h.shards(x, 0), ids, column, reach, None)

    def route(batches):
        for batch in batches:
            yield from index(batch, tables)
            batch = batch.filter(batch.column("query"))
            for dim, some in _by_length(batch.column("v")):
                h, take = known[dim], pa.array(some)
                ids, column, reach = (batch.column(c).take(take) for c in ("id", "v", "reach"))
                x, reach = _vectors(column, dim), reach.to_numpy(zero_copy_only=False).astype(np.float64)
                reach = np.where(np.isfinite(reach), np.maximum(reach, 1e-9), np.inf)
                for t in range(tables):
                    at, shard, last = h.visits(x, reach, t, success)
                    yield ask(dim, t, at, shard, ids, column, reach, last)

    def searched(own: bool):
        def run(batches):
            key, held, part = None, [], None
            for (dim, t, shard, number, query), rows in runs(batches, 5):
                if (dim, t, shard, number) != key:
                    key, held, part = (dim, t, shard, number), [], None
                if not query:
                    held.append(rows)
                    continue
                if part is None:
                    both = pa.Table.from_batches(held) if held else rows.slice(0, 0)
                    part = Part(known[dim], t, np.asarray(both.column("id")), _vectors(both.column("v"), dim))
                ids, reach, last = (np.asarray(rows.column(c)) for c in ("id", "reach", "last"))
                found = part.search(ids, _vectors(rows.column("v"), dim), None if own else reach, last, k)
                if own:
                    bound = np.minimum(np.sqrt(found.d[:, k - 1]), reach)
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(bound)], ["vec_id", "reach"])
                else:
                    q, r = np.nonzero(np.isfinite(found.d))
                    yield pa.RecordBatch.from_arrays([pa.array(ids[q], pa.int64()), pa.array(found.i[q, r], pa.int64()), pa.array(found.d[q, r])], ["vec_id", "neighbour_id", "d"])

        return run

    place = ("dim", "shard_table", "shard", "part")
    tiled = lambda rows: rows.repartition(*place).sortWithinPartitions(*place, "query")
    reach = tiled(points.mapInArrow(route_own, _ROW)).mapInArrow(searched(True), "vec_id long, reach double").groupBy("vec_id").agg(F.min("reach").alias("reach"))
    asked = materialise(points.join(reach, points["id"] == reach["vec_id"], "left").select("id", "v", "query", "reach"), "queries")
    discard(points)
    w = Window.partitionBy("vec_id").orderBy("d", "neighbour_id")
    lists = tiled(asked.mapInArrow(route, _ROW)).mapInArrow(searched(False), "vec_id long, neighbour_id long, d double")
    found = lists.groupBy("vec_id", "neighbour_id").agg(F.min("d").alias("d")).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return found.select("vec_id", "neighbour_id", F.col("rank").cast("int").alias("rank"), F.round(F.sqrt("d"), 6).alias("distance"))


def _by_length(column) -> list[tuple[int, np.ndarray]]:
    """(length, positions) for each length of the vectors in an Arrow column."""
    sizes = np.asarray(pc.list_value_length(column))
    return [(int(n), np.flatnonzero(sizes == n)) for n in np.unique(sizes)]
