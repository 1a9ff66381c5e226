"""Ranks and order statistics: rows are dealt and sorted once, and groups without a key stay."""

from __future__ import annotations

from sheaf.operators import ordering as O
from sheaf.operators import pages as P


def test_order_statistics_sort_values_once(spark):
    rows = [(g, v) for g in (None, 1, 2) for v in (5.0, 1.0, 1.0, 9.0, 4.0)] + [(3, float("nan")), (3, None), (4, 2.0)]
    out = O.upper_median(spark.createDataFrame(rows, "g int, v double"), ["g"], "v")
    assert {(r.g, r.n, r.median) for r in out.collect()} == {(None, 5, 4.0), (1, 5, 4.0), (2, 5, 4.0), (4, 1, 2.0)}
    assert "Join" not in out._jdf.queryExecution().sparkPlan().toString()


def test_pages_of_a_batch_are_sorted_once(spark):
    rows = [(b, f, p) for b in (None, 7) for f in (2, 3) for p in (1, 2, 1030, 1030)]
    out = P.merge_order(spark.createDataFrame(rows, "batch_id int, file_pos long, page long"), block=512)
    got = sorted((r.batch_id or 0, r.out_page, r.file_pos, r.page, r.label) for r in out.collect())
    want = [(b, i + 1, f, p, f"{i + 1} / 8") for b in (0, 7) for i, (f, p) in enumerate((f, p) for f in (2, 3) for p in (1, 2, 1030, 1030))]
    assert got == want
    assert "out_pages" in out.columns and "_pb" not in out.columns
