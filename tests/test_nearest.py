import math
import random

import numpy as np
import pytest

from foliospark.operators.nearest import Tiles, figure_above, holding_or_nearest
from foliospark.operators.ocr import assign_regions, nearest_figures

WIDE = "doc_id long, page_number int, seq double, elem_id string, type string, content string, layout_type string, vector_figure boolean, bbox struct<x0: double, y0: double, x1: double, y1: double>"


def _boxes(r, n, size):
    # Whole numbers, so that many are equally far.
    return [(x := r.randrange(size), y := r.randrange(size), x + r.randrange(1, 60), y + r.randrange(1, 60)) for _ in range(n)]


def _title(p, f):
    apart = p[1] - f[3]
    return (apart if f[3] <= p[1] + 20 else abs(apart) + 500) + 0.3 * abs((p[0] + p[2]) / 2 - (f[0] + f[2]) / 2)


def _region(p, f):
    x, y = (p[0] + p[2]) / 2, (p[1] + p[3]) / 2
    dx, dy = x - (f[0] + f[2]) / 2, y - (f[1] + f[3]) / 2
    return (0, 0.0) if f[0] <= x <= f[2] and f[1] <= y <= f[3] else (1, math.sqrt(dx * dx + dy * dy))


def _points(boxes):
    p = np.array(boxes, float).reshape(-1, 4)
    return np.column_stack([p, (p[:, 0] + p[:, 2]) / 2, (p[:, 1] + p[:, 3]) / 2])


@pytest.mark.parametrize("size", [40, 900, 20000])
@pytest.mark.parametrize(("choose", "far"), [(figure_above, _title), (holding_or_nearest, _region)])
def test_tiles_find_what_all_pairs_do(choose, far, size):
    r = random.Random(size)
    boxes, points = _boxes(r, 700, size), _boxes(r, 600, size)
    want = [min(range(len(boxes)), key=lambda k: (far(p, boxes[k]), k)) for p in points]
    assert choose(_points(points), Tiles(np.array(boxes, float))).tolist() == want


def test_boxes_without_numbers_come_last():
    boxes = np.array([[np.nan, 0, 1, 1], [0, 0, 10, 10]], float)
    for choose in (figure_above, holding_or_nearest):
        assert choose(_points([(0, 12, 9, 20), (np.nan, 0, 1, 1)]), Tiles(boxes)).tolist() == [1, 0]
        assert choose(_points([(0, 12, 9, 20)]), Tiles(boxes[:1])).tolist() == [0]


def _rows(spark, pages=3, n=40):
    r, rows = random.Random(5), []
    for page in range(1, pages + 1):
        for k, b in enumerate(_boxes(r, n, 300)):
            figure = k % 2 == 0 and page < pages
            rows.append((1, page, float(k), f"{page}-{k}", "image" if figure else "text", " t ", None if figure else "figure_title", figure, tuple(map(float, b))))
    return rows, spark.createDataFrame(rows, WIDE)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_titles_and_figures_never_meet_as_rows(spark):
    rows, e = _rows(spark)
    found = nearest_figures(e)
    assert "Join" not in _plan(found)
    want = {(1, t[3]): min((f for f in rows if f[7] and f[1] == t[1]), key=lambda f: (_title(t[8], f[8]), f[2]))[3] for t in rows if not t[7] and t[1] < 3}
    got = found.collect()
    assert {(x.doc_id, x.cap_id): x.fig_id for x in got} == want and len(got) == len(want) and {x.caption for x in got} == {"t"}


def test_lines_and_regions_never_meet_as_rows(spark):
    rows, e = _rows(spark)
    found = assign_regions(e.filter("type = 'text'"), e.filter("vector_figure").selectExpr("doc_id", "page_number", "cast(seq as long) region", "bbox"))
    assert "Join" not in _plan(found)
    want = {(1, t[1], t[3]): int(min((f for f in rows if f[7] and f[1] == t[1]), key=lambda f: (_region(t[8], f[8]), f[2]))[2]) for t in rows if not t[7] and t[1] < 3}
    got = found.collect()
    assert {(x.doc_id, x.page_number, x.elem_id): x.region for x in got} == want and len(got) == len(want)
