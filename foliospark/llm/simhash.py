"""SimHash near-duplicate groups, searched through vantage-point trees.

Fingerprint: 128 bits. Every distinct word (lower case, punctuation ignored) votes on each bit with the
weight ``sqrt(len(word)) * (1 + log2(count))``, every distinct pair of words in a row with a quarter of that. The root
keeps an edit of a few long words from moving a copy far away; the pairs keep documents apart that share no more than
their language's words. Weights are integers, so a fingerprint doesn't depend on the order of summation.

Search: all pairs within ``radius`` bits (23 of 128), exactly. A vantage-point tree over whole fingerprints
prunes nothing at such a radius, since distances of unrelated fingerprints crowd around 64. So the metric is
that of one 16-bit block at a time: distance ``<= 23`` over eight blocks means distance ``<= 2`` in one block
at least, and the Hamming distance of a block is a pseudo-metric of the fingerprints, for which the triangle
bounds hold. The tree over a block's values has its cells as shards. A fingerprint lives in the shard of its
cell and also visits every shard that its ball reaches over a boundary (of two shards only the
lower one is visited, so a pair meets once per block). Within a shard, the values in a visitor's ball are
looked up one by one and whole fingerprints compared.

Shards are of any size, tasks are not: a shard is a grid of tiles, each for so many residents and so many visitors at most. A task
holds the residents of one tile and lets its visitors stream by. Each tile returns a spanning forest instead of all its pairs, so thousands
of copies give thousands of edges, not millions. Large-star/small-star rounds then join the forests into groups.
"""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.llm.arrow import slices, utf8
from foliospark.runtime import discard, materialise

BLOCKS, BLOCK_BITS = 8, 16
#: Beyond three bits in a block its balls become large.
MAX_RADIUS = BLOCKS * 4 - 1
RADIUS = 23
#: Levels of a block's tree: at 16 shards a fingerprint visits about four, however many there are.
DEPTH = 4
#: Of a tile. Residents are held in memory (about 40 bytes each), visitors stream.
TILE_RESIDENTS, TILE_VISITORS = 1_000_000, 4_000_000
#: Bits that tell which rows may be among those that go, 8 MB in buckets of 4 KB, whatever their number.
MARKS, _BUCKET = 1 << 26, 1 << 15
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float64)
_WORD = re.compile(r"\w+")
_SLICE = 1 << 20
#: Pairs and visitors looked at together: what fits a core's cache.
_PAIRS, _VISITORS = 1 << 16, 1 << 16


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads each bit over all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprints_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(has one, low, high) of each text. Null and wordless texts have none."""
    found = [_WORD.findall(t.lower()) if t else [] for t in texts]
    sizes = np.array([len(f) for f in found], np.int64)
    n, none = len(texts), sizes == 0
    if none.all():
        return ~none, np.zeros(n, np.int64), np.zeros(n, np.int64)
    coded = pa.array(list(chain.from_iterable(found)), pa.string()).dictionary_encode()
    del found
    code, doc = coded.indices.to_numpy().astype(np.int64), np.repeat(np.arange(n), sizes)
    words = len(coded.dictionary)
    digest = np.frombuffer(b"".join([xxhash.xxh3_128_digest(w) for w in coded.dictionary.to_pylist()]), np.uint64).reshape(-1, 2)
    length = pc.utf8_length(coded.dictionary).to_numpy().astype(np.float64)
    key, count = np.unique(doc * words + code, return_counts=True)
    at, w = np.divmod(key, words)
    docs, votes = [at], [np.rint(16 * np.sqrt(length[w]) * (1 + np.log2(count)))]
    hashes = [digest[w]]
    near = doc[1:] == doc[:-1]
    key, count = np.unique(((doc[1:] * words + code[:-1]) * words + code[1:])[near], return_counts=True)
    key, right = np.divmod(key, words)
    at, left = np.divmod(key, words)
    docs.append(at)
    votes.append(np.rint(4 * np.sqrt(length[left] + length[right] + 1) * (1 + np.log2(count))))
    hashes.append(_mix(digest[left] * np.uint64(0x9E3779B97F4A7C15) + _mix(digest[right])))
    at, weight, raw = np.concatenate(docs), np.concatenate(votes), np.concatenate(hashes).view(np.uint8)
    total = np.bincount(at, weight, n)
    # Weights are summed by byte value first: far fewer steps than 128 for each word.
    bits = np.concatenate([np.bincount(at * 256 + raw[:, k], weight, n * 256).reshape(n, 256) @ _BITS for k in range(16)], 1)
    low, high = np.packbits(bits * 2 > total[:, None], axis=1).view(np.int64).T
    return ~none, low, high


def fingerprint(text: str | None) -> tuple[int, int] | None:
    """The 128 bits as two signed 64-bit numbers; None for null and for a text without a word."""
    has, low, high = fingerprints_of([text])
    return (int(low[0]), int(high[0])) if has[0] else None


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, low, high) for each row; low and high are null where there is no fingerprint."""

    def run(batches):
        for batch in batches:
            for first, end in slices(utf8(batch.column(1))[1], _SLICE):
                has, low, high = fingerprints_of(batch.column(1).slice(first, end - first).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), pa.array(low, pa.int64(), mask=~has), pa.array(high, pa.int64(), mask=~has)], ["id", "low", "high"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, low long, high long")


class BlockTree:
    """A vantage-point tree over all values of a block, ``depth`` levels deep; its leaves are numbered from 0."""

    def __init__(self, depth: int):
        self.nodes: dict[int, tuple[int, int]] = {}
        self.depth, values = depth, np.arange(1 << BLOCK_BITS, dtype=np.uint32)
        self.home = np.zeros(1 << BLOCK_BITS, np.int32)
        self._build(1, depth, values)

    def _build(self, node: int, levels: int, values: np.ndarray) -> None:
        if not levels:
            self.home[values] = node - (1 << self.depth)
            return
        best = None
        for vantage in values[:: max(1, len(values) // 16)][:16] if len(values) else [np.uint32(0)]:
            far = np.bitwise_count(values ^ vantage)
            for radius in range(BLOCK_BITS):
                skew = abs(2 * int((far <= radius).sum()) - len(values))
                if best is None or skew < best[0]:
                    best = skew, int(vantage), radius
        _, vantage, radius = best
        self.nodes[node] = vantage, radius
        inside = np.bitwise_count(values ^ np.uint32(vantage)) <= radius
        self._build(2 * node, levels - 1, values[inside])
        self._build(2 * node + 1, levels - 1, values[~inside])

    def visits(self, values: np.ndarray, reach: int = 2) -> tuple[np.ndarray, np.ndarray]:
        """(position in values, leaf) for each leaf that may hold a value within reach of it, by the triangle bounds."""
        at, node = np.arange(len(values)), np.ones(len(values), np.int64)
        for _ in range(self.depth):
            low, high = (node.min(), node.max()) if len(node) else (1, 1)
            vantage, radius = np.array([self.nodes[n] for n in range(low, high + 1)], np.int64).reshape(-1, 2)[node - low].T
            far = np.bitwise_count(values[at].astype(np.uint32) ^ vantage.astype(np.uint32)).astype(np.int64)
            inner, outer = far - reach <= radius, far + reach > radius
            at, node = np.concatenate([at[inner], at[outer]]), np.concatenate([2 * node[inner], 2 * node[outer] + 1])
        return at, node - (1 << self.depth)


@lru_cache(4)
def block_tree(depth: int) -> BlockTree:
    return BlockTree(depth)


def reaches(radius: int) -> list[int]:
    """The distance within which pairs meet in each block, -1 for blocks without need: a pair within radius is so near in one of them, since the distances plus one add up to radius + 1."""
    each, more = divmod(radius + 1, BLOCKS)
    return [each - (k >= more) for k in range(BLOCKS)]


def _block(low: np.ndarray, high: np.ndarray, block: int) -> np.ndarray:
    word = (low if block < 4 else high).view(np.uint64)
    return ((word >> np.uint64(16 * (block % 4))) & np.uint64(0xFFFF)).astype(np.int32)


@lru_cache(4)
def _ball(reach: int) -> np.ndarray:
    return np.array([sum(1 << b for b in some) for n in range(reach + 1) for some in combinations(range(BLOCK_BITS), n)], np.int32)


def _join(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Union by the smaller position, all edges at once."""
    while len(a):
        a, b = parent[a], parent[b]
        while not ((up := parent[a]) == a).all():
            a = up
        while not ((up := parent[b]) == b).all():
            b = up
        apart = a != b
        a, b = np.minimum(a[apart], b[apart]), np.maximum(a[apart], b[apart])
        np.minimum.at(parent, b, a)


class Residents:
    """Fingerprints of a tile, by their values of one block, and what is known of their being connected."""

    def __init__(self, ids: np.ndarray, low: np.ndarray, high: np.ndarray, block: int, radius: int):
        key = _block(low, high, block)
        order = np.lexsort((ids, key))
        self.ids, self.block, self.radius, self.reach = ids[order], block, radius, reaches(radius)[block]
        self.words = [w[order].view(np.uint64) for w in (low, high)]
        self.count = np.bincount(key, minlength=1 << BLOCK_BITS).astype(np.int32)
        self.start = np.cumsum(self.count, dtype=np.int64).astype(np.int32) - self.count
        self.parent = np.arange(len(ids))
        self.by_id = np.argsort(self.ids)

    def visit(self, ids: np.ndarray, low: np.ndarray, high: np.ndarray, at_home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Edges that join what wasn't joined, of all pairs within radius of a visitor and a resident; two of the same shard meet once, at the visit of the greater id."""
        n, key = len(self.ids), _block(low, high, self.block)
        words = [low.view(np.uint64), high.view(np.uint64)]
        # A visitor that lives here is the same point.
        seat = self.by_id[np.minimum(np.searchsorted(self.ids, ids, sorter=self.by_id), n - 1)]
        point = np.where(self.ids[seat] == ids, seat, n + np.arange(len(ids)))
        parent = np.concatenate([self.parent, n + np.arange(len(ids))])
        names = np.concatenate([self.ids, ids])
        before = parent.copy()
        first, second = (1, 0) if self.block < 4 else (0, 1)
        for mask in _ball(self.reach):
            value = key ^ mask
            count = self.count[value]
            asks = np.flatnonzero(count)
            count, start = count[asks], self.start[value[asks]]
            ends = np.cumsum(count, dtype=np.int64)
            at = 0
            while at < len(asks):
                done = int(ends[at - 1]) if at else 0
                to = max(at + 1, int(np.searchsorted(ends, done + _PAIRS, "right")))
                c = count[at:to]
                a = np.repeat(asks[at:to].astype(np.int32), c)
                b = np.arange(len(a), dtype=np.int32) + np.repeat((start[at:to] - (ends[at:to] - c - done)).astype(np.int32), c)
                # The half without the block tells most pairs apart.
                far = np.bitwise_count(words[first][a] ^ self.words[first][b])
                near = np.flatnonzero(far <= self.radius)
                if len(near):
                    a, b = a[near], b[near]
                    near = np.bitwise_count(words[second][a] ^ self.words[second][b]) + far[near] <= self.radius
                    near &= ~at_home[a] | (self.ids[b] < ids[a])
                    _join(parent, point[a[near]], b[near].astype(np.int64))
                at = to
        while not ((up := parent[parent]) == parent).all():
            parent = up
        self.parent = parent[:n].copy()
        new = np.flatnonzero(parent != before)
        return names[new], names[parent[new]]


def near_edges(points: DataFrame, radius: int, depth: int = DEPTH, tile_residents: int = TILE_RESIDENTS, tile_visitors: int = TILE_VISITORS) -> DataFrame:
    """(a, b): edges between points (id, low, high), ids distinct, with the same connected parts as all pairs within radius bits."""
    if not 0 <= radius <= MAX_RADIUS:
        raise ValueError(f"radius must be between 0 and {MAX_RADIUS}")
    reach, leaves = reaches(radius), 1 << depth

    def shards(low: np.ndarray, high: np.ndarray):
        """For each block in use: (block, home leaf of each point, positions of visitors, leaves they visit)."""
        tree = block_tree(depth)
        for block in (k for k in range(BLOCKS) if reach[k] >= 0):
            values = _block(low, high, block)
            home = tree.home[values]
            at, leaf = tree.visits(values, reach[block])
            lower = leaf <= home[at]
            yield block, home, at[lower], leaf[lower]

    def count(batches):
        n = np.zeros((2, BLOCKS * leaves), np.int64)
        for batch in batches:
            low, high = (batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2))
            for block, home, _, leaf in shards(low, high):
                for row, of in enumerate((home, leaf)):
                    n[row, block * leaves : (block + 1) * leaves] += np.bincount(of, minlength=leaves)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BLOCKS * leaves), pa.int32()), pa.array(n[0]), pa.array(n[1])], ["shard", "residents", "visitors"])

    points = points.select("id", "low", "high")
    # A row for each of BLOCKS * 2 ** depth shards comes to the driver.
    parts = {r[0]: (max(1, -(-r[1] // tile_residents)), max(1, -(-r[2] // tile_visitors))) for r in points.mapInArrow(count, "shard int, residents long, visitors long").groupBy("shard").agg(F.sum("residents"), F.sum("visitors")).collect()}
    grid = np.array([parts.get(k, (1, 1)) for k in range(BLOCKS * leaves)], np.int64)
    offset = np.cumsum(grid.prod(1)) - grid.prod(1)

    def route(batches):
        for batch in batches:
            ids, low, high = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            share = _mix(ids.view(np.uint64))
            for block, home, at, leaf in shards(low, high):
                for resident, who, shard in ((True, np.arange(len(ids)), block * leaves + home.astype(np.int64)), (False, at, block * leaves + leaf)):
                    mine, copies = (0, 1) if resident else (1, 0)
                    part = (share[who] % grid[shard, mine].astype(np.uint64)).astype(np.int64)
                    n = grid[shard, copies]
                    who, shard, part = np.repeat(who, n), np.repeat(shard, n), np.repeat(part, n)
                    other = np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n)
                    row, column = (part, other) if resident else (other, part)
                    tile = offset[shard] + row * grid[shard, 1] + column
                    kind = np.zeros(len(who), np.int8) if resident else np.where(home[who] == shard - block * leaves, 1, 2).astype(np.int8)
                    yield pa.RecordBatch.from_arrays([pa.array(tile), pa.array(kind), pa.array(np.full(len(who), block, np.int8)), pa.array(ids[who]), pa.array(low[who]), pa.array(high[who])], ["tile", "kind", "block", "id", "low", "high"])

    def search(batches):
        tile, here, held, waiting, many = None, None, [], [], 0

        def visit():
            nonlocal here, waiting, many
            a = b = np.zeros(0, np.int64)
            if held and here is None:
                here = Residents(*(np.concatenate([h[k] for h in held]) for k in (1, 2, 3)), held[0][0], radius)
            if here is not None and waiting:
                ids, low, high, kind = (np.concatenate([w[k] for w in waiting]) for k in (1, 2, 3, 4))
                a, b = here.visit(ids, low, high, kind == 1)
            waiting, many = [], 0
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            tiles, kinds, blocks, ids, low, high = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(6))
            cuts = np.flatnonzero(np.diff(tiles) | np.diff(kinds == 0)) + 1
            for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(tiles)], strict=True):
                if s == e:
                    continue
                if tiles[s] != tile:
                    yield visit()
                    tile, here, held = tiles[s], None, []
                # Of the batch's memory nothing may be kept.
                rows = int(blocks[s]), ids[s:e].copy(), low[s:e].copy(), high[s:e].copy(), kinds[s:e].copy()
                if kinds[s] == 0:
                    held.append(rows)
                else:
                    waiting.append(rows)
                    many += e - s
                    if many >= _VISITORS:
                        yield visit()
        yield visit()

    routed = points.mapInArrow(route, "tile long, kind byte, block byte, id long, low long, high long")
    return routed.repartition("tile").sortWithinPartitions("tile", "kind").mapInArrow(search, "a long, b long")


def connected(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(id, root): the smallest id that each id of edges (a, b) is connected with; roots themselves aren't listed.

    Alternates large-star and small-star until the edges form stars. Minima are taken by windows, which spill, so a
    hub with many neighbours needs no list in memory.
    """
    edges = materialise(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mine = Window.partitionBy("u")
    for _ in range(rounds):
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = both.withColumn("m", F.least(F.min("v").over(mine), "u")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        small = large.withColumn("m", F.min("v").over(mine))
        after = materialise(small.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(small.select(F.col("u").alias("a"), F.col("m").alias("b"))).filter("a <> b").distinct(), "edges")
        # Stars: nobody has two centres and no centre has a centre.
        bad = after.groupBy("a").agg(F.count("*").alias("n")).filter("n > 1").select("a").unionByName(after.alias("x").join(after.select(F.col("a").alias("c")), F.col("b") == F.col("c"), "left_semi").select("a"))
        done = bad.isEmpty()
        discard(edges)
        edges = after
        if done:
            return edges.select(F.col("a").alias("id"), F.col("b").alias("root"))
    raise RuntimeError(f"the groups are not joined after {rounds} rounds")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """(doc_id, low, high, group_id, keep): each row of docs with its group, named by its smallest doc_id, which is kept.

    Groups are what pairs of fingerprints within ``radius`` bits connect. Null or wordless texts have no fingerprint:
    they are groups of their own and kept. Rows without a doc_id take no part: group_id is null, and they are kept. Rows that share
    a doc_id and text are one document and share its fate; where texts differ under one doc_id, each has its own group,
    and the group named so keeps its rows. An empty table gives an empty result; other columns are ignored.
    """
    prints = materialise(fingerprints(docs, id_col, text_col), "fingerprints")
    # Points are numbered in order of id, then fingerprint, since one doc_id can be the least of several fingerprints.
    points = prints.filter("id is not null and low is not null").groupBy("low", "high").agg(F.min("id").alias("doc_id")).sort("doc_id", "low", "high")
    points = materialise(points.withColumn("id", F.monotonically_increasing_id()), "points")
    roots = connected(near_edges(points, radius))
    heads = points.select(F.col("id").alias("root"), F.col("doc_id").alias("group_id"), F.col("low").alias("__low"), F.col("high").alias("__high"))
    named = points.join(roots, "id", "left").select("low", "high", F.coalesce("root", "id").alias("root")).join(heads, "root").drop("root")
    known = prints.join(named, ["low", "high"], "left")
    group = F.coalesce("group_id", "id")
    first = F.coalesce((F.col("low") == F.col("__low")) & (F.col("high") == F.col("__high")), F.lit(True))
    return known.select(F.col("id").alias("doc_id"), "low", "high", group.alias("group_id"), (F.col("id").isNull() | ((F.col("id") == group) & first)).alias("keep"))


def _hashed(ids: Column) -> tuple[Column, Column]:
    """(bucket, place in it) of an id in a bitmap of MARKS bits."""
    h = F.pmod(F.xxhash64(ids), F.lit(MARKS))
    return F.floor(h / _BUCKET).cast("int"), (h % _BUCKET).cast("int")


def _marked(docs: DataFrame, ids: Column, bits: DataFrame) -> DataFrame:
    """docs with a column ``__marked``: whether the bit of its id is set."""
    bucket, place = _hashed(ids)
    rows = docs.join(F.broadcast(bits), bucket == F.col("__bucket"), "left")
    byte = F.conv(F.hex(F.substring("__bits", F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.call_function("shiftright", byte, place % 8).bitwiseAND(F.lit(1))
    return rows.withColumn("__marked", F.coalesce(bit == 1, F.lit(False))).drop("__bucket", "__bits")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """The rows of docs, all columns as they are, without those that :func:`near_groups` doesn't keep.

    Texts of documents that stay aren't shuffled: a bitmap of the ids that go, of a fixed size and so broadcast, tells most rows that they aren't
    among them. Only the rest are joined with those ids.
    """
    groups = materialise(near_groups(docs, id_col, text_col, radius), "groups")
    gone = groups.filter("not keep").select("doc_id", "low", "high").distinct()
    bucket, place = _hashed(F.col("doc_id"))
    bits = gone.select(bucket.alias("__bucket"), place.alias("__place")).groupBy("__bucket").agg(F.bitmap_construct_agg("__place").alias("__bits"))
    own = F.col(f"`{id_col}`").cast("long")
    sure, rows = (_marked(docs, own, bits).filter(F.col("__marked") == m).drop("__marked") for m in (False, True))
    # Only where a doc_id has rows of both kinds must fingerprints tell them apart. Joins are the same at any size.
    mixed = gone.select("doc_id").distinct().join(groups.filter("keep").select("doc_id").hint("merge"), "doc_id", "left_semi").select(F.col("doc_id").alias("__mixed"))
    some = F.col("__mixed").isNotNull()
    gone = gone.join(mixed.hint("merge"), F.col("doc_id") == F.col("__mixed"), "left").select(F.col("doc_id").alias("__gone_id"), F.when(some, F.col("low")).alias("__low"), F.when(some, F.col("high")).alias("__high")).distinct()
    rows = rows.join(mixed.hint("merge"), own == F.col("__mixed"), "left").withColumn("__print", F.udf(fingerprint, "low long, high long")(F.when(some, F.col(f"`{text_col}`").cast("string"))))
    same = (own == F.col("__gone_id")) & F.col("__print.low").eqNullSafe(F.col("__low")) & F.col("__print.high").eqNullSafe(F.col("__high"))
    return sure.unionByName(rows.join(gone.hint("merge"), same, "left_anti").drop("__mixed", "__print"))
