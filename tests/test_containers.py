"""ZIP and Office fixtures built here, hostile ones included."""

from __future__ import annotations

import io
import json
import struct
import zipfile

from pyspark.sql import functions as F

from sheaf.operators import archive as A
from sheaf.operators import inspect as I
from sheaf.sources import files as S
from sheaf.sources import office as O
from sheaf.sources import sinks as K
from sheaf.sources.archive import scan_archive_entries, scan_archive_parts


def pack(parts: dict[str, str | bytes], method=zipfile.ZIP_DEFLATED) -> bytes:
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", method) as archive:
        for path, body in parts.items():
            archive.writestr(zipfile.ZipInfo(path, (1980, 1, 1, 0, 0, 0)), body, compress_type=method)
    return buffer.getvalue()


def patched(data: bytes, mark: bytes, offset: int, value: bytes) -> bytes:
    at = data.index(mark) + offset
    return data[:at] + value + data[at + len(value) :]


def frame(spark, rows):
    return spark.createDataFrame(rows, "file_id long, name string, content binary")


def test_limits(spark):
    good = pack({"a.txt": "hello", "dir/": "", "b.txt": "x"})
    twice = io.BytesIO()
    with zipfile.ZipFile(twice, "w") as archive:
        archive.writestr("a.txt", "1")
        archive.writestr("b.txt", "2")
    cases = {
        1: (good, None),
        2: (pack({"../evil": "x"}), "ARCHIVE_UNSAFE_PATH"),
        3: (pack({"a\tb": "x"}), "ARCHIVE_UNSAFE_PATH"),
        4: (pack({"/abs": "x"}), "ARCHIVE_UNSAFE_PATH"),
        5: (twice.getvalue().replace(b"b.txt", b"a.txt"), "ARCHIVE_DUPLICATE_PATH"),
        6: (patched(good, b"PK\x01\x02", 24, struct.pack("<L", 65 * 1024 * 1024)), "ARCHIVE_ENTRY_TOO_LARGE"),
        7: (pack({"z": "0" * 500_000}), "ARCHIVE_COMPRESSION_RATIO"),
        8: (good[:-4], "ARCHIVE_MALFORMED"),
        9: (b"PK\x03\x04", "ARCHIVE_MALFORMED"),
        10: (patched(good, b"PK\x01\x02", 10, struct.pack("<H", 12)), "ARCHIVE_UNSUPPORTED_COMPRESSION"),
        11: (patched(good, b"PK\x01\x02", 8, struct.pack("<H", 1)), "ARCHIVE_ENCRYPTED"),
        12: (patched(good, b"PK\x05\x06", 4, struct.pack("<H", 1)), "ARCHIVE_ZIP64_UNSUPPORTED"),
        13: (pack({}), "ARCHIVE_MALFORMED"),
        14: (pack({"C:/x": "1"}), "ARCHIVE_UNSAFE_PATH"),
        15: (patched(good, b"PK\x05\x06", 8, struct.pack("<HH", 2, 2)), "ARCHIVE_MALFORMED"),
    }
    out = A.archive_limits(frame(spark, [(i, "x.zip", c) for i, (c, _) in cases.items()]).select("file_id", "content")).collect()
    assert {r.file_id: r.archive_error for r in out} == {i: e for i, (_, e) in cases.items()}


def test_aggregate_and_count_limits(spark):
    data = pack({f"p{i}": "x" * 100 for i in range(5)}, zipfile.ZIP_STORED)
    df = frame(spark, [(1, "a.zip", data)]).select("file_id", "content")
    base = {"input_bytes": 10_000, "entries": 10, "entry_bytes": 1_000, "total_bytes": 10_000, "ratio": 200}
    for change, code in (({"total_bytes": 450}, "ARCHIVE_TOO_COMPLEX"), ({"entries": 4}, "ARCHIVE_TOO_COMPLEX"), ({"input_bytes": 50}, "ARCHIVE_TOO_LARGE")):
        assert A.archive_limits(df, {**base, **change}).first().archive_error == code
    assert A.archive_limits(df, base).first().archive_error is None


def test_parts_and_checksums(spark):
    good = pack({"a.txt": "hello" * 50, "b.txt": "other"})
    broken = patched(good, b"PK\x01\x02", 16, b"\x00\x00\x00\x00")
    df = frame(spark, [(1, "a", good), (2, "b", broken), (3, "c", b"none")]).select("file_id", "content")
    out = {r.file_id: r for r in scan_archive_parts(df, lambda e: e["path"] == "a.txt").collect()}
    assert bytes(out[1].data) == b"hello" * 50 and out[1].error is None
    assert out[2].data is None and out[2].error == "ARCHIVE_MALFORMED"
    assert 3 not in out
    assert sorted(r.path for r in scan_archive_entries(df).where("file_id = 1").collect()) == ["a.txt", "b.txt"]


def test_kinds(spark):
    types = "<Types/>"
    legacy = {"index.xml": "<x/>", "QuickLook/Preview.pdf": "%PDF-1 %%EOF"}
    rows = [
        (1, "a.docx", pack({"[Content_Types].xml": types, "WORD/document.xml": "<d/>"}), "docx", True),
        (2, "a.docm", pack({"[Content_Types].xml": types, "word/document.xml": "<d/>"}), "docx", False),
        (3, "a.pages", pack({"x.txt": "no structure"}), "unknown", False),
        (4, "a.pages", pack(legacy), "pages", True),
        (5, "a.key", pack({"Index/Document.iwa": "x"}), "unknown", False),
        (6, "a.bin", pack({"Index/Document.iwa": "x", "Metadata/p": "com.apple.keynote"}), "keynote", True),
        (7, "a.xlsx", pack({"[Content_Types].xml": types, "xl/workbook.xml": "<w/>", "xl/vbaProject.bin": "v"}), "xlsx", False),
        (8, "a.pptx", b"PK\x03\x04 broken", "unknown", False),
    ]
    out = {r.file_id: r for r in A.container_kind(frame(spark, [r[:3] for r in rows])).collect()}
    assert {i: (r.kind, r.valid) for i, r in out.items()} == {r[0]: (r[3], r[4]) for r in rows}
    assert out[4].has_preview and out[4].generation == "legacy" and out[4].confidence == "high"
    assert out[6].confidence == "medium" and out[5].generation == "modern" and out[5].confidence == "low"
    files = frame(spark, [r[:3] for r in rows]).withColumn("mime", F.lit("")).withColumn("size", F.octet_length("content"))
    inspected = {r.file_id: r for r in I.inspect_files(files, A.container_kind(files.select("file_id", "name", "content"))).collect()}
    assert inspected[7].warnings == "macro-enabled" and inspected[8].archive_error == "ARCHIVE_MALFORMED"
    assert inspected[2].warnings == "macro-enabled,extension-mismatch"


def test_relationships_and_names(spark):
    rels = [
        (1, "xl/workbook.xml", "r1", "t", "worksheets/sheet1.xml", None),
        (1, "xl/workbook.xml", "r2", "t", "../../../x", None),
        (1, "xl/workbook.xml", "r3", "t", "http://e.example", None),
        (1, "xl/workbook.xml", "r4", "t", "gone.xml", None),
        (1, "a.xml", "r5", "t", "./b/../c.xml#frag", None),
    ]
    df = spark.createDataFrame(rels, "file_id long, source_part string, rel_id string, type string, target string, mode string")
    parts = spark.createDataFrame([(1, "xl/Worksheets/sheet1.xml"), (1, "c.xml")], "file_id long, path string")
    out = {r.rel_id: r.status for r in A.resolve_relationships(df, parts).collect()}
    assert out == {"r1": "ok", "r2": "outside-package", "r3": "external", "r4": "missing-part", "r5": "ok"}
    names = ["A", "A", "A 2", "A", "", "x" * 40, "x" * 40, "a/b*c"]
    sheets = spark.createDataFrame([(1, i, n) for i, n in enumerate(names)], "file_id long, ord long, name string")
    got = [r.sheet_name for r in A.unique_sheet_names(sheets).orderBy("ord").collect()]
    assert got == ["A", "A 2", "A 2 2", "A 3", "Sheet 5", "x" * 31, "x" * 29 + " 2", "a b c"]


def test_xml_parts(spark):
    bad = ["<a/>", "<a>", "<!DOCTYPE a><a/>", "<a>\x00</a>", "<a>&x;</a>", "<a><!-- <b> --></a>", "", "<a></b></a></a>"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(bad)], "i int, xml string")
    got = [r[0] for r in df.orderBy("i").select(O.xml_guard(F.col("xml"))).collect()]
    assert got == [None, "malformed", "dtd-or-entity", "control-character", "undeclared-entity", None, "malformed", "malformed"]
    more = ['<a b="x>y"/>', "<a><v>1</w></a>", "<a b=c/>", '<a b="1" c="2" b="3"/>', "<a/><b/>", "<a><b></a></b>", "<a>1 < 2</a>", "<a b='1' ab='2'><c d=\"'\"/></a>"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(more)], "i int, xml string")
    got = [r[0] for r in df.orderBy("i").select(O.xml_guard(F.col("xml"))).collect()]
    assert got == [None, *["malformed"] * 6, None]
    rels = '<Relationships xmlns="urn:r"><Relationship Id="rId1" Type="t/hyperlink" Target="http://e.example" TargetMode="External"/></Relationships>'
    out = O.scan_relationships(spark.createDataFrame([(1, "word/document.xml", rels)], "file_id long, source_part string, xml string")).first()
    assert (out.rel_id, out.target, out.mode) == ("rId1", "http://e.example", "External")
    sheet = (
        '<worksheet xmlns="urn:s"><cols><col min="1" max="3" width="99"/></cols><sheetData><row r="2" ht="500"><c r="B2" s="2"><f t="shared">A1</f><v>7</v></c>'
        '<c r="C2" t="inlineStr"><is><r><t>a</t></r><r><t>b</t></r></is></c><c r="ZZZ1"><v>1</v></c></row></sheetData><mergeCells><mergeCell ref="A1:B2"/><mergeCell ref="?"/></mergeCells></worksheet>'
    )
    parts = spark.createDataFrame([(1, 0, sheet)], "file_id long, sheet_ord int, xml string")
    cells = O.scan_sheet_cells(parts).orderBy("col").collect()
    assert [(c.row, c.col, c.t, c.v, c.f, c.style_idx) for c in cells] == [(1, 1, None, "7", "A1", 2), (1, 2, "inlineStr", "ab", None, 0)]
    cols, rows, merges = O.scan_sheet_dims(parts)
    assert (rows.first().row, rows.first().height) == (1, 120.0)
    assert [tuple(m)[3:] for m in merges.collect()] == [(0, 0, 2, 2)] and cols.first().max_col == 3.0


def test_dimensions_off_the_grid(spark):
    """Heights beyond the grid stay apart, and whatever the grid leaves out has a row."""
    sheet = (
        '<worksheet xmlns="urn:s"><cols><col min="1" max="2" width="9"/><col min="400" max="900" width="9"/><col min="501" max="502"/><col min="7" max="3"/></cols>'
        '<sheetData><row r="20000" ht="30"/><row r="20001" ht="40"/><row r="90000" ht="50"/><row ht="60"/></sheetData>'
        '<mergeCells><mergeCell ref="A1:B2"/><mergeCell ref="nonsense"/><mergeCell/><mergeCell ref="A20001"/><mergeCell ref="SF20000:SG20001"/></mergeCells></worksheet>'
    )
    rows = [(1, 0, sheet), (2, 0, None), (3, 0, '<worksheet xmlns="urn:s"/>')]
    parts = spark.createDataFrame(rows, "file_id long, sheet_ord int, xml string")
    cols, heights, merges = O.scan_sheet_dims(parts)
    assert sorted((r.row, r.height) for r in heights.collect()) == [(3, 60.0), (19_999, 30.0)]
    assert cols.count() == 4 and merges.count() == 3
    got = sorted((r.dim, r.ref or "", r.reason) for r in O.scan_dim_rejects(parts).collect())
    assert got == [
        ("col", "400:900", "cut"), ("col", "501:502", "off-grid"), ("col", "7:3", "empty"),
        ("merge", "", "bad-reference"), ("merge", "A20001", "off-grid"), ("merge", "SF20000:SG20001", "cut"), ("merge", "nonsense", "bad-reference"),
        ("row", "20001", "off-grid"), ("row", "90000", "off-grid"),
    ]
    assert O.scan_dim_rejects(parts.limit(0)).count() == 0


def test_image_sizes(spark):
    png = b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + struct.pack(">II", 5000, 5000) + b"\x08\x06\0\0\0crc4IEND"
    jpeg = b"\xff\xd8\xff\xe1" + struct.pack(">H", 40_002) + b"x" * 40_000 + b"\xff\xc0\0\x0b\x08" + struct.pack(">HH", 300, 200) + b"\x01\x01\x11\0\xff\xd9 padding"
    df = spark.createDataFrame([(1, png), (2, jpeg), (3, b"\xff\xd8\xff\xd9")], "file_id long, content binary")
    out = {r.file_id: r for r in I.image_pixel_audit(df).collect()}
    assert (out[1].width, out[1].over_pdf_cap, out[1].over_office_cap, out[1].over_stamp_cap) == (5000, True, False, True)
    assert (out[2].width, out[2].height, out[2].over_stamp_cap) == (200, 300, False)
    assert out[3].width is None and out[3].over_pdf_cap


def test_files_manifests_sinks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a b.md").write_bytes(b"# hi")
    (tmp_path / "in" / "big.pdf").write_bytes(b"%PDF-" + b"x" * 100 + b"%%EOF")
    files = S.scan_files(spark, str(tmp_path / "in"), max_bytes=50)
    assert [(r.size, bytes(r.content)) for r in files.collect()] == [(4, b"# hi")]
    listed = {"fixtures": [{"kind": "k", "name": "n", "path": "p/n", "bytes": 3, "features": ["a"]}]}
    mapped = {"fixtures": {"pages/x.pages": {"bytes": 9, "features": []}}}
    for name, body in (("l", listed), ("m", mapped)):
        (tmp_path / f"{name}.json").write_text(json.dumps(body, indent=1))
    rows = S.scan_manifest(spark, [str(tmp_path / "l.json"), str(tmp_path / "m.json")]).orderBy("kind").collect()
    assert [(r.kind, r.name, r.path, r.bytes) for r in rows] == [("k", "n", "p/n", 3), ("pages", "x.pages", "pages/x.pages", 9)]
    docs = spark.createDataFrame([(1, "one"), (2, None)], "doc long, text string")
    K.write_text_docs(docs, str(tmp_path / "out"))
    assert K.read_text_docs(spark, str(tmp_path / "out")).count() == 1
    results = spark.createDataFrame([(1, True), (2, False)], "doc long, ok boolean")
    assert not K.write_report(results, str(tmp_path / "r1"), "t")
    assert K.write_report(results.where("ok"), str(tmp_path / "r2"), "t")


def test_scan_files_in_parts(spark, tmp_path):
    """A source is many files that no task or value holds together; a null source is a name."""
    import hashlib

    from sheaf.catalog import package_queries as P

    rows = [(i * 7919 % 1000, ("even", "odd", None)[i % 3], f"text {i} é") for i in range(1000)]
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    seen, scan = [], P.S.scan_files
    P.S.scan_files = lambda *a: seen.append(scan(*a)) or seen[-1]
    try:
        got = {r["name"]: r for r in P.scan_files(spark, str(tmp_path)).collect()}
    finally:
        P.S.scan_files = scan
    assert set(got) == {"even", "odd", None}
    for name, r in got.items():
        data = "".join(t + "\n" for _, s, t in sorted(rows, key=lambda x: x[0]) if s == name).encode()
        assert (r["mime"], r["size"], r["digest"]) == ("text/plain" if name == "even" else "", len(data), hashlib.md5(data).hexdigest())
    assert max(r["size"] for r in seen[0].select("size").collect()) <= P.FILE_DOCS * max(len(t.encode()) + 1 for _, _, t in rows)


def test_packed_documents_keep_the_verdict_of_their_shape(spark):
    """A text of little but repeats deflates beyond the ratio; the package stores it."""
    from sheaf.catalog.packages import build

    rows = [(i, "x.zip", build(i, "the same words again and again\n" * 20_000)) for i in (0, 4, 6, 11)]
    out = A.archive_limits(frame(spark, rows).select("file_id", "content")).collect()
    assert {r.file_id: r.archive_error for r in out} == {0: None, 4: None, 6: None, 11: "ARCHIVE_COMPRESSION_RATIO"}


def test_kind_of_a_package_with_a_text_of_repeats(spark):
    from sheaf.catalog.packages import build

    rows = [(i, f"x{i}.pages", build(i, "a b c d e f g h\n" * 30_000)) for i in (0, 1, 4)]
    out = A.container_kind(frame(spark, rows)).collect()
    assert {r.file_id: (r.kind, r.valid, r.safety) for r in out} == {0: ("docx", True, "safe"), 1: ("pptx", True, "safe"), 4: ("pages", True, "safe")}


def test_guard_folds_a_text_once(spark):
    """Each use of the folded tags worked them out again, cleaned text and all."""
    df = spark.createDataFrame([("<a><b/></a>",)], "xml string").select(O.xml_guard(F.col("xml")).alias("g"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    # The count of nodes is an extraction of its own.
    assert plan.count("aggregate(") == 1 and plan.count("regexp_extract_all(") == 2
    assert df.first().g is None


def test_rejects_and_facts_read_a_sheet_once(spark):
    xml = '<worksheet><cols><col min="9" max="8"/></cols><sheetData><row r="30000"><c r="7up"/><c r="A1"><f>[1]B!A1</f></c></row></sheetData></worksheet>'
    parts = spark.createDataFrame([(1, 0, xml), (2, 0, None), (3, 0, "<worksheet><sheetData/></worksheet>")], "file_id long, sheet_ord int, xml string")
    cells, dims_ = O.scan_sheet_rejects(parts), O.scan_dim_rejects(parts)
    for df in (cells, dims_, O.scan_sheet_facts(parts)):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("from_xml(") == 1
    assert {(r.file_id, r.ref, r.reason) for r in cells.collect()} == {(1, "7up", "bad-reference"), (2, None, "malformed")}
    assert {(r.file_id, r.dim, r.ref, r.reason) for r in dims_.collect()} == {(1, "row", "30000", "off-grid"), (1, "col", "9:8", "empty")}
    assert {(r.file_id, r.unread, r.external, r.filled) for r in O.scan_sheet_facts(parts).collect()} == {(1, False, True, True), (2, True, False, False), (3, False, False, False)}


def test_package_plan_makes_its_packages_once(spark):
    from sheaf.catalog import QUERIES

    plan = QUERIES["package_plan"](spark, "/root/testdata/sf0.001")
    assert "_pack(" not in plan._jdf.queryExecution().optimizedPlan().toString() and plan.count() > 0


def test_guard_needs_no_fold_for_plain_texts(spark):
    deep = "<a>" * 40 + "</a>" * 40
    texts = {
        '<w><r n="1"><c/>x</r> <r n=\'2\' m="it\'s">&amp;</r ></w>': (True, None),
        "<r/>": (True, None),
        deep: (False, None),
        "<a>" * 129 + "</a>" * 129: (False, "too-deep"),
        "<a></a><b/>": (False, "malformed"),
        "<a><b x='1' y='2' x='3'/></a>": (False, "malformed"),
        "<a><b c/></a>": (False, "malformed"),
        "<a><b></a></b>": (False, "malformed"),
        "<a></a b='1'>": (False, "malformed"),
        "<a x='<'></a>": (False, "malformed"),
        "<a>publication, ecosystems</a>": (True, None),
        "<a>Public</a>": (True, "dtd-or-entity"),
    }
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r["t"]: (r["plain"], r["refused"]) for r in rows.select("t", O.plainly_formed(F.col("t")).alias("plain"), O.xml_guard(F.col("t")).alias("refused")).collect()}
    assert got == texts


def test_crowded_workbooks_are_read_once_a_part(spark):
    """Every name of a part was a reading of its own, 101 of them in a workbook refused for their number."""
    from sheaf.catalog.packages import WORKBOOK_PARTS
    from sheaf.plans import workbook as W

    read, names = [], '<sheet name="x" r:id="rId7"/>'
    sheet = '<worksheet><sheetData><row r="1"><c r="A1"><v>1</v></c></row></sheetData></worksheet>'

    def book(n):
        parts = {**WORKBOOK_PARTS, "xl/worksheets/sheet1.xml": sheet}
        parts["xl/workbook.xml"] = parts["xl/workbook.xml"].replace("<sheets>", "<sheets>" + names * n)
        return pack(parts)

    files = spark.createDataFrame([(1, book(1)), (2, book(100))], "file_id long, content binary")
    real = W.kept
    W.kept = lambda df: read.append(real(df)) or read[-1]
    try:
        cells, refused = W.workbook_cells(files)
        assert [(r.file_id, r.problem) for r in refused.collect()] == [(2, "too-many-sheets")]
        assert sorted((r.file_id, r.sheet_ord, r.ref) for r in cells.collect()) == [(1, 0, "A1"), (1, 1, "A1")]
    finally:
        W.kept = real
    assert [df.where("file_id = 2").count() for df in read if "unread" in df.columns] == [1]
