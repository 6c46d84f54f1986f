"""Hierarchical packing of documents into windows of several context sizes.

Documents are cut at the largest window, and each piece goes to the smallest tier that holds it. Tiers are packed from the
longest down, by best fit in decreasing order: a piece goes where it leaves the least room. When a tier's own pieces are
placed, the gaps of its windows are filled from the shorter tiers, again the largest piece that fits first, so that
only what is left over opens windows of its own tier. Windows of a tier are then dealt to step groups that hold
as many tokens each, in order of attention cost back and forth, so that groups cost about the same.

Documents are packed in shards by a hash of their id, whose number follows that of the rows: a shard's last windows
of each tier are all that is lost by not packing everything at once, and shards need nothing of each other.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TIERS = (1024, 4096, 16384)
#: Tokens of a step group: so many windows of each tier as hold them.
STEP_TOKENS = 65536
SHARD_ROWS = 50_000


@dataclass
class Bins:
    """Windows of one size, found by the room they have left."""

    size: int
    content: list[list[int]] = field(default_factory=list)
    room: list[int] = field(default_factory=list)
    by_room: dict[int, list[int]] = field(default_factory=dict)
    mask: int = 0

    def _put(self, window: int, left: int) -> None:
        self.room[window] = left
        if left:
            self.by_room.setdefault(left, []).append(window)
            self.mask |= 1 << left

    def add(self, item: int, n: int, may_open: bool) -> bool:
        """Into the window that it leaves the least room; into a new one if none holds it and may_open."""
        fits = self.mask >> n
        if fits:
            left = n + (fits & -fits).bit_length() - 1
            same = self.by_room[left]
            window = same.pop()
            if not same:
                self.mask ^= 1 << left
        elif may_open:
            window, left = len(self.room), self.size
            self.content.append([])
            self.room.append(left)
        else:
            return False
        self.content[window].append(item)
        self._put(window, left - n)
        return True


def pack_pieces(sizes: np.ndarray, tiers: tuple[int, ...] = TIERS) -> dict[int, list[list[int]]]:
    """Windows of each tier, as lists of positions in sizes; sizes, from 1 to the largest tier, must be in decreasing order."""
    home = np.searchsorted(np.array(tiers), sizes)
    waiting = {t: np.flatnonzero(home == k).tolist() for k, t in enumerate(tiers)}
    out = {}
    for k in range(len(tiers) - 1, -1, -1):
        bins = Bins(tiers[k])
        for i in waiting[tiers[k]]:
            bins.add(i, int(sizes[i]), True)
        for shorter in reversed(tiers[:k]):
            waiting[shorter] = [i for i in waiting[shorter] if not bins.add(i, int(sizes[i]), False)] if bins.mask else waiting[shorter]
        out[tiers[k]] = bins.content
    return out


def deal(costs: np.ndarray, per_group: int) -> np.ndarray:
    """The group of each window: the costliest first, dealt back and forth to as few groups as hold per_group windows each."""
    n = len(costs)
    groups = max(1, -(-n // per_group))
    order = np.lexsort((np.arange(n), -costs))
    lap, at = np.divmod(np.arange(n), groups)
    out = np.empty(n, np.int64)
    out[order] = np.where(lap % 2 == 0, at, groups - 1 - at)
    return out


def pack_shard(ids: list, lengths: np.ndarray, tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS) -> dict[str, list]:
    """Columns doc_id, piece, start, n_tokens, tier, window, offset, step of a shard's documents."""
    top = tiers[-1]
    # Null ids come first; equal documents can stand for each other.
    order = sorted(range(len(ids)), key=lambda i: (-int(lengths[i]), ids[i] is not None, ids[i] or 0))
    doc, piece, size = [], [], []
    empty = []
    for i in order:
        n = int(lengths[i])
        if not n:
            empty.append(i)
        for k in range(-(-n // top)):
            doc.append(i)
            piece.append(k)
            size.append(min(top, n - k * top))
    by_size = np.argsort(-np.array(size, np.int64), kind="stable") if size else np.zeros(0, np.int64)
    sizes = np.array(size, np.int64)[by_size]
    out: dict[str, list] = {c: [] for c in ("doc_id", "piece", "start", "n_tokens", "tier", "window", "offset", "step")}
    for tier, windows in sorted(pack_pieces(sizes, tiers).items()):
        steps = deal(np.array([float((sizes[w].astype(float) ** 2).sum()) for w in windows]), max(1, step_tokens // tier))
        for number, (window, step) in enumerate(zip(windows, steps.tolist(), strict=True)):
            offset = 0
            for at in window:
                p = int(by_size[at])
                n = int(sizes[at])
                for c, value in zip(out, (ids[doc[p]], piece[p], piece[p] * top, n, tier, number, offset, step), strict=True):
                    out[c].append(value)
                offset += n
    for i in empty:
        for c, value in zip(out, (ids[i], 0, 0, 0, None, None, None, None), strict=True):
            out[c].append(value)
    return out


def pack(lengths: DataFrame, n_rows: int, id_col: str = "doc_id", length_col: str = "n_tokens", tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(doc_id, piece, start, n_tokens, tier, shard, window, offset, step): where each piece of each document goes.

    n_rows, about the number of rows, sets the number of shards. tier, shard and window name a window, tier, shard and step a step group; start is the piece's first token in its
    document, offset its place in the window. Documents of no tokens, or an unknown number, have one row without a
    window. Rows that repeat are packed each; rows without a doc_id too. An empty table gives an empty result; other columns are ignored.
    """
    if list(tiers) != sorted(set(tiers)) or not tiers or tiers[0] < 1 or step_tokens < tiers[-1]:
        raise ValueError("tiers must rise from 1 at least, and a step hold a window of the largest")
    shards = max(1, -(-n_rows // shard_rows))

    def run(key, table):
        found = pack_shard(table.column("id").to_pylist(), table.column("n").to_numpy(), tiers, step_tokens)
        arrays = {c: pa.array(v, pa.int64() if c in ("doc_id", "start", "window") else pa.int32()) for c, v in found.items()}
        arrays["shard"] = pa.array(np.full(len(found["piece"]), key[0].as_py()), pa.int32())
        return pa.table({c: arrays[c] for c in ("doc_id", "piece", "start", "n_tokens", "tier", "shard", "window", "offset", "step")})

    rows = lengths.select(F.col(id_col).cast("long").alias("id"), F.greatest(F.coalesce(F.col(length_col).cast("long"), F.lit(0)), F.lit(0)).alias("n"))
    # The length takes part, so that many rows without an id, or with the same, don't meet in one shard.
    keyed = rows.withColumn("shard", F.pmod(F.xxhash64("id", "n"), F.lit(shards)).cast("int"))
    return keyed.groupBy("shard").applyInArrow(run, "doc_id long, piece int, start long, n_tokens int, tier int, shard int, window long, offset int, step int")
