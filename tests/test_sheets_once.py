"""Sheet operators at scale: cells are read once, folds run over many sheets together."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sheaf.operators import sheets as S

CELL = "file_id long, sheet_ord int, row long, col long, v string"


def test_dense_rows_read_their_cells_once(spark):
    """Width and gaps come from a window over the rows; sheets without a file id keep their cells."""
    rows = [(None, 0, 1, 1, "x"), (1, 0, 0, 0, "a"), (1, 0, 0, 1, "b"), (1, 0, 3, 0, "c"), (2, 0, 0, 2, "z")]
    out = S.dense_rows(spark.createDataFrame(rows, CELL), "v")
    got = {(r.file_id, r.row): r["values"] for r in out.collect()}
    assert got[None, 0] == ["", ""] and got[None, 1] == ["", "x"]
    assert [got[1, r] for r in range(4)] == [["a", "b"], ["", ""], ["", ""], ["c", ""]]
    assert got[2, 0] == ["", "", "z"] and len(got) == 7
    assert out._jdf.queryExecution().sparkPlan().toString().count("Scan ExistingRDD") == 1


def test_pages_of_many_sheets_are_packed_together(spark):
    """Long and short sheets, one without rows, one with a row higher than a page; packed as one by one."""
    rng = random.Random(21)
    sizes = {k: [rng.choice((12.0, 20.1, 33.3, 71.9)) for _ in range(n)] for k, n in enumerate((0, 1, 900, 3, 40, 41, 900))}
    sizes[3] = [5.0, 800.0, 5.0]
    want = {}
    for k, heights in sizes.items():
        starts, used = [], 0.0
        for i, h in enumerate(heights):
            if not starts:
                starts, used = [0], h
            elif used + h > 733.0:
                starts, used = [*starts, i], h + heights[0]
            else:
                used += h
        want[k] = starts
    df = spark.createDataFrame([*sizes.items(), (9, None)], "k int, heights array<double>").coalesce(1)
    packed = df.select("k", S._pack(F.col("heights"), F.lit(733.0), header=True).alias("starts"))
    assert {r.k: r.starts or [] for r in packed.collect()} == want | {9: []}
    # Not a fold of boxed numbers in the row.
    assert "aggregate(" not in packed._jdf.queryExecution().optimizedPlan().toString()


def test_window_merges_make_the_layout_once(spark):
    """Sizes outside their bounds, two windows and two pages; sizes, widths, heights and merges are read once."""
    sizes = spark.createDataFrame([(1, 0, 60, 40)], "file_id long, sheet_ord int, rows long, cols long")
    widths = spark.createDataFrame([(1, 0, 1, 99.0), (1, 0, 45, 9.0)], "file_id long, sheet_ord int, col long, width double")
    heights = spark.createDataFrame([(1, 0, 2, 1.0), (1, 0, 0, 500.0)], "file_id long, sheet_ord int, row long, height double")
    merges = spark.createDataFrame([(1, 0, 1, 0, 0, 1, 2), (1, 0, 2, 50, 2, 3, 1), (1, 0, 3, 4, 0, 1, 40)], "file_id long, sheet_ord int, ord int, row long, col long, rowspan long, colspan long")
    layout = S.sheet_layout(sizes, widths, heights)
    got = layout.first()
    assert got.widths == [84.0, 196.0] + [84.0] * 38 and got.heights == [72.0, 20.0, 12.0] + [20.0] * 57
    pages = [tuple(r)[2:] for r in S.row_pages(layout).collect()]
    windows = [tuple(r)[2:5] for r in S.column_windows(layout).collect()]
    want = set()
    for o, row, col, colspan in ((1, 0, 0, 2), (2, 50, 2, 1), (3, 4, 0, 40)):
        for w, first, last in windows:
            for p, top, bottom in pages:
                if first <= col and col + colspan - 1 <= last and (top <= row <= bottom or row == 0):
                    want.add((o, p, w, 0 if row == 0 else row - top + (p > 0), col - first))
    out = S.window_merges(merges, layout)
    assert {(r.ord, r.page, r.window, r.row, r.col) for r in out.collect()} == want and len(pages) > 1 and len(windows) > 1
    assert out._jdf.queryExecution().sparkPlan().toString().count("Scan ExistingRDD") == 4


def test_merges_of_many_tiles_are_painted_together(spark, monkeypatch):
    """Tiles that go on over batches, cells that come twice, sheets without ids; not one step a tile."""
    rng = random.Random(4)
    files = [None, *range(12)]
    merges = [(f, 0, o, rng.randrange(70), rng.randrange(40), rng.randint(1, 6), rng.randint(1, 40)) for f in files for o in range(rng.choice((0, 3, 25)))]
    cells = [(f, 0, rng.randrange(75), rng.randrange(45)) for f in files for _ in range(200)]
    want = set()
    for f, _, row, col in cells:
        over = next((m for m in merges if m[0] == f and m[3] <= row < m[3] + m[5] and m[4] <= col < m[4] + m[6]), None)
        if over is None:
            want.add((f, row, col, "none", 1))
        elif over[4] == col:
            want.add((f, row, col, "continue" if row > over[3] else "restart" if over[5] > 1 else "none", over[6]))
    cell_df = spark.createDataFrame(cells, "file_id int, sheet_ord int, row long, col long")
    merge_df = spark.createDataFrame(merges, "file_id int, sheet_ord int, ord int, row long, col long, rowspan long, colspan long")
    for size in ("3", "50", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        got = [tuple(r)[:1] + tuple(r)[2:] for r in S.merge_state(cell_df, merge_df).collect()]
        assert len(got) == len(want) and set(got) == want
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")

    calls, unique = [], np.unique
    monkeypatch.setattr(np, "unique", lambda *a, **k: calls.append(1) or unique(*a, **k))
    n = 500
    rows = {"file_id": range(n), "sheet_ord": [0] * n, "_tr": [0] * n, "_tc": [0] * n, "_kind": [1] * n, "_at": [1] * n, "row": [1] * n, "col": [2] * n, "rowspan": [None] * n, "colspan": [None] * n}
    batch = pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) for k, v in rows.items()})
    assert sum(b.num_rows for b in S._painted(iter([batch]))) == n and len(calls) < 5


def test_only_cells_that_point_are_dealt_to_the_strings(spark):
    cells = spark.createDataFrame(
        [(1, "A1", "s", "1"), (1, "B1", "s", "9"), (1, "C1", None, "1"), (1, "D1", "b", "1"), (1, "E1", "s", "x"), (None, "F1", "s", "1")], "file_id long, ref string, t string, v string"
    )
    strings = spark.createDataFrame([(1, 0, "zero"), (1, 1, "one")], "file_id long, idx int, text string")
    out = S.shared_strings(cells, strings)
    assert out.columns == [*cells.columns, "shared"]
    assert {r.ref: r.shared for r in out.collect()} == {"A1": "one", "B1": "", "C1": None, "D1": None, "E1": "zero", "F1": ""}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lstrip().startswith("Union") and plan.count("Join ") == 1
