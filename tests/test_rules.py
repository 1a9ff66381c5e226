"""Small literal cases: input and expected rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheaf.functions import cells as C
from sheaf.functions import html as H
from sheaf.functions import links as L
from sheaf.functions import text as X
from sheaf.operators import batch as B
from sheaf.operators import inspect as I
from sheaf.operators import markdown as M
from sheaf.operators import pages as P
from sheaf.operators import textflow as T


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("v"))).collect()]


def test_page_ranges(spark):
    cases = {
        ("1-3,5,8-10", 10): [1, 2, 3, 5, 8, 9, 10],
        (" 5 , 3-4, 3 ,1-2 ", 6): [1, 2, 3, 4, 5],
        ("8-", 10): [8, 9, 10],
        ("5", 10): [5],
        ("   ", 10): "blank",
        ("1", 0): "no-pages",
        ("5-2", 10): "reversed",
        ("11", 10): "outside",
        ("1-11", 10): "outside",
        ("0", 10): "start",
        ("abc", 10): "syntax",
        ("1--2", 10): "syntax",
        ("1,,2", 10): "empty-part",
        ("1, ,2", 10): "empty-part",
        ("9-2,abc", 10): "reversed",
        ("3-0", 10): "end",
        ("\u00a02\u00a0", 3): [2],
    }
    rows = [(i, spec, count) for i, (spec, count) in enumerate(cases)]
    out = P.expand_page_ranges(spark.createDataFrame(rows, "request_id long, spec string, page_count long")).collect()
    for i, want in enumerate(cases.values()):
        mine = [r for r in out if r.request_id == i]
        if isinstance(want, str):
            assert [(r.page, r.error_code) for r in mine] == [(None, want)]
        else:
            assert [r.page for r in mine] == want


def test_page_runs_across_blocks(spark):
    rows = [(1, p) for p in (1, 2, 3, 5)] + [(2, 4)] + [(3, p) for p in range(1, 40)] + [(4, 7), (4, 8)]
    pages = spark.createDataFrame(rows, "doc long, page long")
    for block in (2, 3, 1 << 16):
        out = {r.doc: r.summary for r in P.page_runs(pages, block=block).collect()}
        assert out == {1: "4 pages (1–3, 5)", 2: "1 page (4)", 3: "39 pages (1–39)", 4: "2 pages (7–8)"}


def test_sizes_and_changes(spark):
    sizes = [0, 1023, 2048, 5 * 1024**2, 1536, 10_752, 100 * 1024 + 512, 3 * 1024**3 + 1, -1, 1024**5]
    want = ["0 B", "1023 B", "2 KB", "5 MB", "1.50 KB", "10.5 KB", "101 KB", "3.00 GB", "0 B", "1048576 GB"]
    assert column(spark, sizes, X.format_bytes, "long") == want
    df = spark.createDataFrame([(1000, 800), (1000, 1000), (800, 1000), (0, 5)], "a long, b long")
    assert [r[0] for r in df.select(X.percent_change(F.col("a"), F.col("b"))).collect()] == ["-20.0%", "0.0%", "+25.0%", "—"]


def test_names(spark):
    names = ["a/b\\Report.final.pdf", "...", "  x  y?.docx", "..\\..\\evil", "no-ext"]
    assert column(spark, names, X.safe_file_name) == ["Report.final", "output", "x  y", "evil", "no-ext"]
    assert column(spark, ["..hidden.pdf", "\x01a.pdf", "a/b/"], X.safe_request_name) == ["hidden.pdf", "a.pdf", "document"]
    assert column(spark, ["A.PDF", "x.tar.gz", "none", "a.b c"], X.file_extension) == [".pdf", ".gz", "", ""]
    assert column(spark, ["A.PDF", "a.b c", "none"], X.loose_extension) == [".pdf", ".b c", ""]


def test_white_space_is_unicode(spark):
    blanks = ["\u00a0\u3000\t", " x ", "", "\ufeff"]
    assert column(spark, blanks, X.is_blank) == [True, False, True, True]
    assert column(spark, ["a\u00a0 b", " one "], X.collapse_spaces) == ["a b", "one"]


def test_detect(spark):
    rows = [
        (1, b"%PDF-1.7 x %%EOF", "renamed.jpg", "", 10, "pdf"),
        (2, b"%PDF-1.7 x", "a.pdf", "", 10, "pdf"),
        (3, b"\xff\xd8\xff\xe0..\xff\xd9", "a.jpg", "image/jpeg", 10, "jpeg"),
        (4, b"hello", "a.md", "", 5, "markdown"),
        (5, b"\xff\xfe", "a.md", "", 5, "markdown"),
        (6, b"", "a.pdf", "", 0, "empty"),
        (7, b"x", "a.pdf", "", 200 * 1024 * 1024, "too-large"),
        (8, b"PK\x03\x04..", "a.pages", "", 6, "zip"),
        (9, b"plain", "a.bin", "", 5, "unknown"),
    ]
    df = spark.createDataFrame([r[:5] for r in rows], "file_id long, content binary, name string, mime string, size long")
    out = {r.file_id: r for r in I.inspect_files(df).collect()}
    assert {i: r.step for i, r in out.items()} == {r[0]: r[5] for r in rows}
    assert out[1].valid and out[1].warnings == "extension-mismatch"
    assert not out[2].valid and out[2].warnings == "malformed-content" and out[2].safety == "rejected"
    assert out[3].valid and out[3].mime_match and out[3].warnings == ""
    assert out[4].valid and not out[5].valid
    assert out[8].kind == "unknown" and out[8].is_container
    assert out[9].safety == "safe" and out[9].confidence == "none"


def test_batch_actions(spark):
    batches = {
        "a": (["pdf", "pdf"], False, "merge-pdf"),
        "b": (["docx"] * 3, False, "docx-to-pdf"),
        "c": (["jpeg", "png"], False, "image-to-pdf"),
        "d": (["pdf", "docx", "markdown", "png"], False, "combine-to-pdf"),
        "e": (["pages"], True, "embedded-pdf,pages-to-pdf,pages-to-word"),
        "f": (["numbers"], False, "numbers-to-xlsx,numbers-to-pdf"),
        "g": (["pptx", "pdf"], False, ""),
        "h": (["markdown"], False, "markdown-to-pdf"),
        "i": (["markdown", "markdown"], False, "combine-to-pdf"),
        "j": (["xlsx"], False, "excel-to-pdf"),
        "k": (["keynote", "keynote"], False, ""),
    }
    rows = [(b, k, p) for b, (kinds, p, _) in batches.items() for k in kinds]
    out = B.batch_actions(spark.createDataFrame(rows, "batch_id string, kind string, has_preview boolean")).collect()
    assert {r.batch_id: r.actions for r in out} == {b: want for b, (_, _, want) in batches.items()}


def test_accept_files(spark):
    def files(name, entries):
        return [(name, i, n, m, s, "merge-pdf") for i, (n, m, s) in enumerate(entries)]

    mib = 1024 * 1024
    rows = (
        files("types", [("a.pdf", "application/pdf", 1000), ("b.png", "image/png", 1000), ("scan.pdf", "", 5), ("b.bin", "application/pdf", 1)])
        + files("bad", [("e.pdf", "application/pdf", 0), ("h.pdf", "application/pdf", 100 * mib + 1)])
        + files("many", [(f"f{i}.pdf", "application/pdf", 100) for i in range(25)])
        + files("bytes", [("a.pdf", "", 90 * mib), ("b.pdf", "", 90 * mib), ("c.pdf", "", 90 * mib), ("d.pdf", "", 20 * mib)])
    )
    df = spark.createDataFrame(rows, "batch_id string, pos long, name string, mime string, size long, slug string")
    out = B.accept_files(df).collect()
    got = {b: [r.reason for r in sorted(out, key=lambda r: r.pos) if r.batch_id == b] for b in ("types", "bad", "many", "bytes")}
    assert got["types"] == [None, "type", None, None]
    assert got["bad"] == ["empty", "file-size"]
    assert got["many"] == [None] * 20 + ["count"] * 5
    assert got["bytes"] == [None, None, "total", None]
    prior = df.where("batch_id = 'bytes'").withColumn("first_count", F.lit(19)).withColumn("first_bytes", F.lit(150 * mib))
    assert [r.reason for r in sorted(B.accept_files(prior).collect(), key=lambda r: r.pos)] == ["total", "total", "total", None]


def test_sanitize(spark):
    html = [
        "<script>alert(1)</script><p onclick=\"x()\" class='a'>t</p>",
        "<style>p{}</style><iframe src=x></iframe><b onload = go()>b</b>",
        "<a href=\" JavaScript:x\">a</a><a href='https://e.example'>k</a>",
        "<a title=\"x href='javascript:1'\" href=vbscript:z>q</a>",
        "<h1>keep</h1><strong>s</strong><ul><li>1</li></ul><table></table>",
    ]
    out = column(spark, html, H.sanitize)
    assert out[0] == "<p class='a'>t</p>"
    assert out[1] == "<b>b</b>"
    assert out[2] == "<a href=\"#\">a</a><a href='https://e.example'>k</a>"
    assert out[3] == "<a title=\"x href=\"#\"\" href=\"#\">q</a>" or 'href="#">q' in out[3]
    assert out[4] == html[4]
    assert column(spark, out, H.sanitize) == out


def test_links(spark):
    urls = ["https://e.example", "mailto:a@b", "#x", "/p", "//cdn", "javascript:1", " /q "]
    assert column(spark, urls, L.safe_href) == ["https://e.example", "mailto:a@b", "#x", "/p", None, None, "/q"]
    origins = ["https://a.example", "https://x.prev.example", "http://x.prev.example", "https://.prev.example", "https://u@x.prev.example/p", None]
    allowed = column(spark, origins, lambda c: L.is_allowed_origin(c, ["https://a.example"], ".prev.example"))
    assert allowed == [True, True, False, False, True, False]


def test_cells(spark):
    refs = ["$AB$12", "a1", "XFD1048576", "1A", "", "A0"]
    out = column(spark, refs, C.a1_to_rowcol)
    assert [tuple(r) if r else None for r in out] == [(11, 27), (0, 0), (1048575, 16383), None, None, (0, 0)]
    assert column(spark, ["B3:A1", "C2", "A1:x"], C.range_to_box)[:2] == [(0, 0, 3, 2), (1, 2, 1, 1)]
    df = spark.range(0, 18_000, 7).select(C.rowcol_to_a1(F.lit(4), F.col("id")).alias("ref"), "id")
    assert df.where(C.a1_to_rowcol(F.col("ref"))["col"] != F.col("id")).isEmpty()
    dates = spark.createDataFrame(
        [(46276.0, "yyyy-mm-dd"), (46276.5, "m/d/yy"), (1.0, '0.00"day"'), (1.0, "[Red]0"), (60.0, "d-mmm")], "v double, f string"
    )
    got = [r[0] for r in dates.select(C.excel_date(F.col("v"), F.col("f"))).collect()]
    assert got == ["2026-09-11", "2026-09-11", None, None, "1900-02-28"]


def test_markdown_blocks(spark):
    source = "\n".join(
        ["# Title #", "", "para one", "  para two  ", "- a", "  - b", "1. x", "> q1", ">q2", "| h | k |", "|---|:---:|", "| a\\|b | `c|d` |", "| only |", "",
         "```py", "# not a heading", "```", "---", "text", "```", "still text", "", "~~~", "open"]
    )
    rows = M.md_blocks(spark.createDataFrame([(1, "\ufeff" + source.replace("\n", "\r\n"))], "doc long, text string")).orderBy("block").collect()
    assert [r.kind for r in rows] == [
        "heading", "paragraph", "list", "list", "blockquote", "table", "code", "rule", "paragraph", "code",
    ]
    assert (rows[0].level, rows[0].text) == (1, "Title")
    assert rows[1].text == "para one\npara two"
    assert [(i.text, i.level) for i in rows[2]["items"]] == [("a", 0), ("b", 1)] and rows[3].ordered
    assert rows[4].text == "q1\nq2"
    assert rows[5].headers == ["h", "k"] and rows[5].rows == [["a|b", "`c|d`"], ["only"]]
    assert (rows[6].language, rows[6].text) == ("py", "# not a heading")
    assert rows[8].text == "text\n```\nstill text"
    assert rows[9].text == "open"


def test_paginate(spark):
    docs = spark.createDataFrame([(1, [3, 3, 3, 9, 1]), (2, [9, 1]), (3, [5] * 9), (4, [])], "doc long, heights array<int>")
    out = {}
    for r in M.paginate_blocks(docs, page_height=7, max_pages=4).collect():
        out.setdefault(r.doc, []).append((r.page, r.first_block, r.last_block, r.used, r.error))
    assert out[1] == [(1, 0, 1, 6, None), (2, 2, 2, 3, None), (3, 3, 3, 9, None), (4, 4, 4, 1, None)]
    assert out[2] == [(None, None, None, None, "block-too-large")]
    assert out[3] == [(None, None, None, None, "too-many-pages")]
    assert out[4] == [(None, None, None, None, "no-content")]


def test_lines_use_the_tolerance_of_the_item(spark):
    items = [
        (1, 1, 0, "Head", 0.0, 100.0, 40.0, 20.0),
        (1, 1, 1, "big", 50.0, 94.0, 30.0, 20.0),  # 6 below, tolerance 7: same line
        (1, 1, 2, "small", 90.0, 94.0, 30.0, 10.0),  # 6 below, tolerance 3.5: new line
        (1, 1, 3, "tail", 130.0, 93.0, 30.0, 10.0),  # joins the second line
        (1, 1, 4, " ", 200.0, 93.0, 3.0, 10.0),
        (1, 1, 5, ",", 200.0, 93.0, 3.0, 10.0),
    ]
    df = spark.createDataFrame(items, "doc long, page long, ord long, str string, x double, y double, width double, font_size double")
    lines = T.line_gaps(T.join_items(T.group_lines(df))).orderBy("seq").collect()
    assert [(r.text, r.y, r.font_size, r.gap_above) for r in lines] == [("Head big", 100.0, 20.0, 0.0), ("small tail,", 94.0, 10.0, 6.0)]


def test_hex_and_units(spark):
    assert column(spark, ["#a1B2c3", "red", None], X.hex_colour) == ["A1B2C3", "111827", "111827"]
    assert column(spark, [1.0, 100.0, 5000.0], X.points_to_twips, "double") == [1440, 2000, 31680]
    assert column(spark, ["12700", "x", "-5"], X.emu_to_points) == [1.0, 0.0, 0.0]


def test_document_limits(spark):
    from sheaf.plans.document_text import document_markdown

    schema = "doc long, page long, ord long, str string, x double, y double, width double, font_size double"
    items = [
        (1, 1, 0, "Title", 0.0, 700.0, 30.0, 24.0),
        (1, 1, 1, "one two", 0.0, 650.0, 40.0, 12.0),
        (1, 1, 2, "three", 0.0, 636.0, 30.0, 12.0),
        (1, 2, 3, "• item", 0.0, 700.0, 30.0, 12.0),
        (1, 2, 4, "next", 0.0, 600.0, 30.0, 12.0),
        (2, 1, 0, "  ", 0.0, 0.0, 1.0, 12.0),
        (3, 301, 0, "x", 0.0, 0.0, 1.0, 12.0),
        (4, 1, 0, "y" * (5 * 1024 * 1024 + 1), 0.0, 0.0, 1.0, 12.0),
    ]
    notes = spark.createDataFrame([], "doc long, page long, ord long, url string, y1 double, y2 double")
    out = {r.doc: (r.markdown, r.error_code) for r in document_markdown(spark.createDataFrame(items, schema), notes).collect()}
    assert out == {
        1: ("# Title\none two three\n\n- item\nnext\n", None),
        2: (None, "scanned"),
        3: (None, "too-many-pages"),
        4: (None, "too-much-text"),
    }
