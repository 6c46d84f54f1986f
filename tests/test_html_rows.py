import pyarrow as pa

from foliospark.functions.arrow import ROWS
from foliospark.sources.text import html_rows


def test_pages_are_read_by_slices():
    n = 2 * ROWS + 1
    pages = pa.RecordBatch.from_pydict({"doc_id": list(range(n)), "html": ["<h2>A</h2><p>b</p><img src=c alt=d>"] * (n - 1) + [None]})
    out = list(html_rows([pages]))
    assert [b.num_rows for b in out] == [3 * ROWS, 3 * ROWS, 0]
    assert out[0].to_pylist()[:3] == [
        {"doc_id": 0, "page_number": 1, "seq": float(k), "type": t, "content": c, "heading_level": h, "saved_path": s, "description": d}
        for k, (t, c, h, s, d) in enumerate([("text", "A", 2, None, None), ("text", "b", None, None, None), ("image", "", None, "c", "d")])
    ]
