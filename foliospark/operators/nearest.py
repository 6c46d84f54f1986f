"""The best box of a page for each of its points, found without pairs of them as rows.

Rows are hashed and sorted by page once, boxes before points. A page's boxes are held as numbers, in tiles that lie close together;
points come by batches, and chunks of neighbours look into the tiles that can still hold something better.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_TILE, _AT_ONCE, _CHUNK = 64, 8, 256


def _near_order(xy: np.ndarray, size: int) -> np.ndarray:
    """Rows by strips of x, in each by y, so that runs of ``size`` rows lie close together."""
    n = len(xy)
    strip = max(1, int(np.ceil(np.sqrt(n / size)))) * size
    at = np.empty(n, np.int64)
    at[np.argsort(xy[:, 0], kind="stable")] = np.arange(n) // strip
    return np.lexsort((xy[:, 1], at))


class Tiles:
    """Boxes (x0, y0, x1, y1), of which the earlier wins between equals; those without all four numbers lie infinitely far."""

    def __init__(self, boxes: np.ndarray):
        known = np.flatnonzero(np.isfinite(boxes).all(axis=1))
        mid = (boxes[known][:, :2] + boxes[known][:, 2:]) / 2
        self.rank = known[_near_order(mid, _TILE)]
        self.boxes = boxes[self.rank]
        self.starts = np.arange(0, len(self.rank), _TILE)
        bounds = np.column_stack([self.boxes, self._centres(self.boxes), self.rank]) if len(self.rank) else np.empty((0, 7))
        some = len(self.starts) > 0
        self.low = np.minimum.reduceat(bounds, self.starts) if some else bounds
        self.high = np.maximum.reduceat(bounds, self.starts) if some else bounds

    @staticmethod
    def _centres(b: np.ndarray) -> np.ndarray:
        return np.column_stack([(b[:, 0] + b[:, 2]) / 2, (b[:, 1] + b[:, 3]) / 2])

    def best(self, points: np.ndarray, least: Callable, score: Callable) -> tuple[np.ndarray, np.ndarray]:
        """(score, number of the box) for each point box (x0, y0, x1, y1, cx, cy); infinity and the first box where nothing has a score.

        least(low, high, tiles) is what no box of a tile can go below for points between low and high; score(points, boxes, ranks) are all their scores.
        """
        value, found = np.full(len(points), np.inf), np.zeros(len(points), np.int64)
        usable = np.flatnonzero(np.isfinite(points).all(axis=1))
        usable = usable[_near_order(points[usable][:, 4:], _CHUNK)]
        for at in range(0, len(usable), _CHUNK):
            live = usable[at : at + _CHUNK]
            bound = least(points[live].min(axis=0), points[live].max(axis=0), self)
            # Sums in another order differ by their last digits.
            known = np.isfinite(bound)
            bound[known] -= 1e-9 * (1 + np.abs(bound[known]))
            order = np.argsort(bound, kind="stable")
            for k in range(0, len(order), _AT_ONCE):
                live = live[value[live] >= bound[order[k]]]
                if not len(live) or bound[order[k]] == np.inf:
                    break
                rows = (self.starts[order[k : k + _AT_ONCE], None] + np.arange(_TILE)).ravel()
                rows = rows[rows < len(self.rank)]
                rows = rows[np.argsort(self.rank[rows], kind="stable")]
                s = score(points[live], self.boxes[rows], self.rank[rows])
                first = np.argmin(s, axis=1)
                s, r = s[np.arange(len(live)), first], self.rank[rows[first]]
                better = (s < value[live]) | (s == value[live]) & (r < found[live])
                value[live[better]], found[live[better]] = s[better], r[better]
        return value, found


def _title_least(low, high, t: Tiles) -> np.ndarray:
    aside = np.maximum(np.maximum(t.low[:, 4] - high[4], low[4] - t.high[:, 4]), 0.0)
    above = np.maximum(low[1] - t.high[:, 3], -20.0)
    below = t.low[:, 3] - high[1]
    return np.where(below > 20.0 + 1e-6 * (1 + abs(high[1])), below + 500.0, above) + 0.3 * aside


def _title_score(p, b, _) -> np.ndarray:
    y, x = p[:, 1, None], p[:, 4, None]
    apart = y - b[:, 3]
    return np.where(b[:, 3] <= y + 20, apart, np.abs(apart) + 500) + 0.3 * np.abs(x - (b[:, 0] + b[:, 2]) / 2)


def figure_above(points: np.ndarray, t: Tiles) -> np.ndarray:
    """The number of the figure that each title belongs to: by distance, and one that isn't above it is 500 points further away."""
    return t.best(points, _title_least, _title_score)[1]


def _within_least(low, high, t: Tiles) -> np.ndarray:
    meet = (t.low[:, 0] <= high[4]) & (t.high[:, 2] >= low[4]) & (t.low[:, 1] <= high[5]) & (t.high[:, 3] >= low[5])
    return np.where(meet, t.low[:, 6], np.inf)


def _within_score(p, b, rank) -> np.ndarray:
    x, y = p[:, 4, None], p[:, 5, None]
    return np.where((b[:, 0] <= x) & (x <= b[:, 2]) & (b[:, 1] <= y) & (y <= b[:, 3]), rank, np.inf)


def _centre_least(low, high, t: Tiles) -> np.ndarray:
    aside = np.maximum(np.maximum(t.low[:, 4] - high[4], low[4] - t.high[:, 4]), 0.0)
    apart = np.maximum(np.maximum(t.low[:, 5] - high[5], low[5] - t.high[:, 5]), 0.0)
    return np.sqrt(aside * aside + apart * apart)


def _centre_score(p, b, _) -> np.ndarray:
    dx, dy = p[:, 4, None] - (b[:, 0] + b[:, 2]) / 2, p[:, 5, None] - (b[:, 1] + b[:, 3]) / 2
    return np.sqrt(dx * dx + dy * dy)


def holding_or_nearest(points: np.ndarray, t: Tiles) -> np.ndarray:
    """The number of the first box that holds each point's centre, else of the one whose centre is nearest."""
    value, found = t.best(points, _within_least, _within_score)
    rest = np.flatnonzero(value == np.inf)
    found[rest] = t.best(points[rest], _centre_least, _centre_score)[1]
    return found


def best_boxes(points: DataFrame, boxes: DataFrame, order: list[str], value: str, choose: Callable[[np.ndarray, Tiles], np.ndarray], on: tuple[str, ...] = ("doc_id", "page_number")) -> DataFrame:
    """points (on, bbox, and more) of pages that have boxes (on, bbox, order, value), with the value of the box that choose() takes; the first by order wins between equals."""
    own = [c for c in points.columns if c not in (*on, "bbox")]
    ranks = [f"__o{k}" for k in range(len(order))]
    keyed = lambda df: df.dropna(subset=list(on))
    corner = [F.col(f"bbox.{c}").cast("double").alias(f"__{c}") for c in ("x0", "y0", "x1", "y1")]
    null = lambda df, c, n: F.lit(None).cast(df.schema[c].dataType).alias(n)
    struct = lambda cols: F.struct(*cols, F.lit(0).alias("__one"))
    a = keyed(boxes).select(*on, F.lit(False).alias("__p"), *(F.col(o).alias(r) for o, r in zip(order, ranks, strict=True)), *corner, F.col(value).alias("__v"), struct([null(points, c, c) for c in own]).alias("__own"))
    b = keyed(points).select(*on, F.lit(True).alias("__p"), *(null(boxes, o, r) for o, r in zip(order, ranks, strict=True)), *corner, null(boxes, value, "__v"), struct([_col(c) for c in own]).alias("__own"))
    rows = a.unionByName(b)
    out = StructType([*(rows.schema[c] for c in (*on, "__own", "__v"))])

    def run(batches):
        at = tiles = None
        held: list[tuple[np.ndarray, pa.Array]] = []
        for batch in batches:
            keys = [batch.column(c) for c in on]
            new = np.zeros(batch.num_rows, bool)
            new[:1] = True
            for k in (*keys, batch.column("__p")):
                v = k.to_numpy(zero_copy_only=False)
                new[1:] |= v[1:] != v[:-1]
            starts = [*np.flatnonzero(new).tolist(), batch.num_rows]
            for s, e in zip(starts, starts[1:], strict=False):
                part = batch.slice(s, e - s)
                key = tuple(k[s].as_py() for k in keys)
                if key != at:
                    at, tiles, held = key, None, []
                xy = np.column_stack([part.column(f"__{c}").to_numpy(zero_copy_only=False).astype(float) for c in ("x0", "y0", "x1", "y1")])
                if not part.column("__p")[0].as_py():
                    held.append((xy, part.column("__v")))
                    continue
                if tiles is None and held:
                    tiles, values = Tiles(np.concatenate([h[0] for h in held])), pa.concat_arrays([h[1] for h in held])
                    held = []
                if tiles is not None:
                    with np.errstate(invalid="ignore"):
                        found = choose(np.column_stack([xy, Tiles._centres(xy)]), tiles)
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in (*on, "__own")), values.take(pa.array(found))], [*on, "__own", "__v"])

    best = rows.repartition(*on).sortWithinPartitions(*on, "__p", *ranks, "__v").mapInArrow(run, out)
    return best.select(*on, *(F.col(f"__own.`{c}`").alias(c) for c in own), F.col("__v").alias(value))


def _col(name: str) -> Column:
    return F.col(f"`{name}`")
