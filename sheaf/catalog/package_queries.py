"""Queries over containers, XML parts, relationships, sources and sinks."""

from __future__ import annotations

import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import functions as F

from ..functions.text import escape_xml
from ..operators import archive as A
from ..operators.ordering import kept
from ..plans.intake import batch_plan
from ..plans.workbook import workbook_cells
from ..session import checkpoint_dir
from ..sources import files as S
from ..sources import office as O
from ..sources import sinks as K
from ..sources.archive import scan_archive_entries, scan_archive_parts
from . import recipes as R
from .packages import BROKEN_WORKBOOKS, PARTS, SHAPES, TEXT_PART, pack_workbook, packages
from .registry import query, table, wide_table

# Expected parts per shape, as rows.
_PART_ROWS = ", ".join(
    f"({shape}, {i}, '{path}', {len(body)})" for shape, parts in PARTS.items() for i, (path, body) in enumerate(parts.items())
)
_ENTRIES_DUCK = f"""SELECT d.doc_id AS file_id, p.ord, p.path, CAST(p.usize AS BIGINT) AS usize FROM documents AS d JOIN (VALUES {_PART_ROWS}) AS p(shape, ord, path, usize)
    ON p.shape = d.doc_id % {SHAPES} WHERE d.doc_id % {SHAPES} <> 8
  UNION ALL SELECT d.doc_id, n.n, '{TEXT_PART}', octet_length(encode(d.text)) FROM documents AS d JOIN (SELECT shape, count(*) AS n FROM (VALUES {_PART_ROWS}) AS p(shape, ord, path, usize) GROUP BY shape) AS n
    ON n.shape = d.doc_id % {SHAPES} WHERE d.doc_id % {SHAPES} <> 8"""


@query("scan_archive_entries", f"SELECT file_id, CAST(ord AS BIGINT) AS ord, path, usize, usize >= 64 AND NOT (path = '{TEXT_PART}') AS packed FROM ({_ENTRIES_DUCK})")
def scan_archive_entries_query(spark, sf):
    entries = scan_archive_entries(packages(spark, sf).select("file_id", "content"))
    return entries.select(
        "file_id", F.col("ord").cast("long").alias("ord"), "path", "usize", ((F.col("method") == 8) & (F.col("path") != TEXT_PART)).alias("packed")
    )


@query(
    "scan_archive_parts",
    f"SELECT doc_id AS file_id, '{TEXT_PART}' AS path, md5(text) AS digest, length(text) AS chars, CAST(NULL AS VARCHAR) AS error FROM documents WHERE doc_id % {SHAPES} <> 8",
)
def scan_archive_parts_query(spark, sf):
    parts = scan_archive_parts(packages(spark, sf).select("file_id", "content"), lambda e: e["path"] == TEXT_PART)
    return parts.select(
        "file_id", "path", F.md5("data").alias("digest"), F.length(F.decode("data", "UTF-8")).cast("long").alias("chars"), "error"
    )


_VERDICT = f"CASE doc_id % {SHAPES} WHEN 7 THEN 'ARCHIVE_UNSAFE_PATH' WHEN 8 THEN 'ARCHIVE_MALFORMED' WHEN 9 THEN 'ARCHIVE_ENCRYPTED' WHEN 11 THEN 'ARCHIVE_COMPRESSION_RATIO' END"


@query("archive_limits", f"SELECT doc_id AS file_id, {_VERDICT} AS archive_error FROM documents")
def archive_limits(spark, sf):
    return A.archive_limits(packages(spark, sf).select("file_id", "content")).select("file_id", "archive_error")


_KIND = f"""CASE doc_id % {SHAPES} WHEN 0 THEN 'docx' WHEN 1 THEN 'pptx' WHEN 2 THEN 'xlsx' WHEN 3 THEN 'docx' WHEN 4 THEN 'pages' WHEN 5 THEN 'keynote' WHEN 10 THEN 'docx'
  WHEN 13 THEN 'numbers' ELSE 'unknown' END"""
_CONTAINERS = f"""SELECT doc_id AS file_id, {_KIND} AS kind, doc_id % {SHAPES} IN (0, 1, 4, 5, 10, 13) AS valid,
  CASE WHEN doc_id % {SHAPES} IN (2, 3, 7, 8, 9, 11) THEN 'rejected' ELSE 'safe' END AS safety,
  CASE WHEN doc_id % {SHAPES} IN (0, 1, 2, 3, 4, 10, 12, 13) THEN 'modern' WHEN doc_id % {SHAPES} = 5 THEN 'legacy' ELSE 'unknown' END AS generation,
  CASE doc_id % {SHAPES} WHEN 4 THEN 'high' WHEN 5 THEN 'medium' WHEN 13 THEN 'medium' WHEN 6 THEN 'low' WHEN 12 THEN 'low' WHEN 7 THEN 'none' WHEN 8 THEN 'none' WHEN 9 THEN 'none'
    WHEN 11 THEN 'none' ELSE 'high' END AS confidence,
  CASE doc_id % {SHAPES} WHEN 2 THEN 'macro-enabled' WHEN 3 THEN 'macro-enabled' WHEN 4 THEN 'renderer-evaluation-pending' WHEN 5 THEN 'renderer-evaluation-pending'
    WHEN 13 THEN 'renderer-evaluation-pending' WHEN 6 THEN 'unsupported-container' WHEN 12 THEN 'unsupported-container' WHEN 7 THEN 'unsafe-container' WHEN 8 THEN 'malformed-content'
    WHEN 9 THEN 'malformed-content' WHEN 11 THEN 'malformed-content' END AS warning,
  {_VERDICT} AS archive_error, doc_id % {SHAPES} = 4 AS has_preview FROM documents"""


@query("container_kind", _CONTAINERS)
def container_kind(spark, sf):
    return A.container_kind(packages(spark, sf).select("file_id", "name", "content"))


@query(
    "embedded_policy",
    f"SELECT doc_id AS file_id, doc_id % {SHAPES} IN (2, 10, 11) AS office_blocked, doc_id % {SHAPES} IN (0, 10, 11) AS word_blocked FROM documents",
)
def embedded_policy(spark, sf):
    return A.embedded_policy(packages(spark, sf).select("file_id", "content"))


@query(
    "package_plan",
    f"""WITH f AS (SELECT source AS batch_id, doc_id, c.kind, c.valid, c.safety, c.has_preview, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn
      FROM documents AS d JOIN ({_CONTAINERS}) AS c ON c.file_id = d.doc_id)
    SELECT batch_id, count(*) AS file_count, array_to_string(list_sort(list(DISTINCT kind)), ',') AS kinds, bool_and(valid AND kind = 'docx') AS batch_ok FROM f WHERE rn <= 20 GROUP BY batch_id""",
)
def package_plan(spark, sf):
    # Admission, inspection and the look into containers read the same packages: made once.
    files = kept(packages(spark, sf))
    plan = batch_plan(files, A.container_kind(files.select("file_id", "name", "content")))
    return plan.select("batch_id", "file_count", "kinds", "batch_ok")


# ---- relationships, names ---------------------------------------------------------------

_RELS = """SELECT doc_id AS file_id, 'ppt/slides/slide1.xml' AS source_part, 'rId' || CAST(doc_id AS STRING) AS rel_id,
  CASE WHEN doc_id % 3 = 0 THEN 'http://e.example/hyperlink' ELSE 'http://e.example/image' END AS type,
  CASE doc_id % 9 WHEN 0 THEN '../media/image1.png' WHEN 1 THEN 'notes/n1.xml#top' WHEN 2 THEN '../../../x.xml' WHEN 3 THEN 'https://e.example/a' WHEN 4 THEN './../Media//image1.PNG'
    WHEN 5 THEN '../theme/none.xml' WHEN 6 THEN '' WHEN 7 THEN '../../root.xml' ELSE '../media/image1.png' END AS target,
  CASE WHEN doc_id % 9 = 8 THEN 'External' ELSE NULL END AS mode FROM <documents>"""
_KNOWN = ["ppt/media/image1.png", "ppt/slides/notes/n1.xml", "root.xml"]


@query(
    "resolve_relationships",
    """SELECT doc_id AS file_id, CASE doc_id % 9 WHEN 0 THEN 'ppt/media/image1.png' WHEN 1 THEN 'ppt/slides/notes/n1.xml' WHEN 4 THEN 'ppt/Media/image1.PNG' WHEN 5 THEN 'ppt/theme/none.xml'
      WHEN 7 THEN 'root.xml' WHEN 6 THEN 'ppt/slides' END AS resolved, CASE doc_id % 9 WHEN 2 THEN 'outside-package' WHEN 3 THEN 'external' WHEN 5 THEN 'missing-part' WHEN 6 THEN 'incomplete'
      WHEN 8 THEN 'external' ELSE 'ok' END AS status FROM documents""",
)
def resolve_relationships(spark, sf):
    rels = R.run(spark, sf, _RELS, "documents")
    parts = rels.select("file_id", F.explode(F.array(*[F.lit(p) for p in _KNOWN])).alias("path"))
    return A.resolve_relationships(rels, parts).select("file_id", "resolved", "status")


@query(
    "external_relationships",
    "SELECT doc_id AS file_id, count(*) AS external FROM documents WHERE doc_id % 9 IN (3, 8) AND doc_id % 3 <> 0 GROUP BY doc_id",
)
def external_relationships(spark, sf):
    return A.external_relationships(R.run(spark, sf, _RELS, "documents"))


@query(
    "unique_sheet_names",
    """SELECT l_orderkey AS file_id, CAST(l_linenumber - 1 AS BIGINT) AS ord, CASE WHEN l_linenumber = 4 THEN 'Totals: 4'
        WHEN l_linenumber IN (2, 3) AND l_orderkey % 2 = 0 THEN 'Order ' || l_orderkey || CASE WHEN l_linenumber = 2 AND NOT has1 THEN '' WHEN l_linenumber = 2 OR NOT (has1 AND has2) AND (has1 OR has2) THEN ' 2'
          WHEN has1 AND has2 THEN ' 3' ELSE '' END
        WHEN l_linenumber = 1 AND l_orderkey % 2 = 0 THEN 'Order ' || l_orderkey ELSE 'Sheet ' || l_linenumber END AS sheet_name
    FROM (SELECT DISTINCT l_orderkey, l_linenumber, bool_or(l_linenumber = 1) OVER w AS has1, bool_or(l_linenumber = 2) OVER w AS has2 FROM lineitem WINDOW w AS (PARTITION BY l_orderkey))""".replace("'Totals: 4'", "'Totals  4'"),
)
def unique_sheet_names(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    line, order = F.col("l_linenumber"), F.col("l_orderkey")
    name = (
        F.when(line == 4, F.lit(" Totals: 4"))
        .when((line <= 3) & (order % 2 == 0), F.concat(F.lit("Order/"), order.cast("string")))
        .otherwise("")
    )
    sheets = rows.select(order.alias("file_id"), (line - 1).cast("long").alias("ord"), name.alias("name"))
    return A.unique_sheet_names(sheets)


# ---- XML parts made of the texts -----------------------------------------------------------

# Licence lines hold a word that is refused anywhere in XML.
_PUBLIC = "regexp_matches(text, '(?i)\\b(SYSTEM|PUBLIC)\\b')"
_GUARDED = f"""CASE WHEN doc_id % 8 = 1 THEN 'control-character' WHEN doc_id % 8 = 0 OR {_PUBLIC} THEN 'dtd-or-entity' WHEN doc_id % 8 = 2 THEN 'undeclared-entity'
  WHEN doc_id % 8 = 3 THEN 'too-deep' WHEN doc_id % 8 = 4 THEN 'malformed' END"""


@query("xml_guard", f"SELECT doc_id, {_GUARDED} AS refused FROM documents")
def xml_guard(spark, sf):
    docs = table(spark, sf, "documents")
    k = F.col("doc_id") % 8
    deep = F.concat(F.repeat(F.lit("<a>"), 130), F.repeat(F.lit("</a>"), 130))
    extra = (
        F.when(k == 0, "<!DOCTYPE x>")
        .when(k == 1, "\x07")
        .when(k == 2, "&nbsp;")
        .when(k == 3, deep)
        .when(k == 4, "<b>")
        .when(k == 5, "<!-- <b> &x; --><b/>")
        .otherwise("<b c='1'>&amp;&#65;</b>")
    )
    xml = F.concat(F.lit("<?xml version='1.0'?><r>"), escape_xml(F.col("text")), extra, F.lit("</r>"))
    return docs.select("doc_id", O.xml_guard(xml).alias("refused"))


def _lines():
    return F.split("text", "\n", -1)


@query(
    "scan_sheet_cells",
    """SELECT doc_id AS file_id, i - 1 AS row, CAST(c AS BIGINT) AS col, CASE c WHEN 0 THEN CAST(NULL AS VARCHAR) WHEN 1 THEN 'inlineStr' ELSE 's' END AS t,
      CASE c WHEN 0 THEN CAST(length(l) AS VARCHAR) WHEN 1 THEN trim(l) ELSE CAST(i AS VARCHAR) END AS v, CASE WHEN c = 0 THEN 'SUM(A1:A' || i || ')' END AS f, CAST(CASE WHEN c = 2 THEN 3 ELSE 0 END AS BIGINT) AS style_idx
    FROM (SELECT doc_id, l, i, unnest([0, 1, 2]) AS c FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, unnest(generate_series(1, len(string_split(text, chr(10))))) AS i FROM documents))""",
)
def scan_sheet_cells(spark, sf):
    return O.scan_sheet_cells(_sheet_parts(spark, sf)).select("file_id", "row", "col", "t", "v", "f", "style_idx")


def _sheet_parts(spark, sf):
    def row(line, i):
        n = (i + 1).cast("string")
        return F.concat(
            F.lit('<row r="'), n, F.lit('" ht="15"><c r="A'), n, F.lit('"><f>SUM(A1:A'), n, F.lit(")</f><v>"), F.length(line).cast("string"),
            F.lit('</v></c><c r="B'), n, F.lit('" t="inlineStr"><is><t>'), escape_xml(line), F.lit('</t></is></c><c r="C'), n,
            F.lit('" t="s" s="3"><v>'), n, F.lit("</v></c></row>"),
        )

    xml = F.concat(
        F.lit('<worksheet xmlns="http://e.example/main"><cols><col min="1" max="2" width="9.5"/></cols><sheetData>'),
        F.array_join(F.transform(_lines(), row), ""),
        F.lit('</sheetData><mergeCells count="1"><mergeCell ref="A1:B2"/></mergeCells></worksheet>'),
    )
    return wide_table(spark, sf, "documents").select(F.col("doc_id").alias("file_id"), F.lit(0).alias("sheet_ord"), xml.alias("xml"))


@query(
    "scan_sheet_dims",
    """SELECT doc_id AS file_id, 'row' AS dim, i - 1 AS at, CAST(15 AS DOUBLE) AS size FROM (SELECT doc_id, unnest(generate_series(1, len(string_split(text, chr(10))))) AS i FROM documents)
    UNION ALL SELECT doc_id, 'col', 1, CAST(9.5 AS DOUBLE) FROM documents UNION ALL SELECT doc_id, 'merge', 0, CAST(4 AS DOUBLE) FROM documents""",
)
def scan_sheet_dims(spark, sf):
    cols, rows, merges = O.scan_sheet_dims(_sheet_parts(spark, sf))
    return (
        rows.select("file_id", F.lit("row").alias("dim"), F.col("row").alias("at"), F.col("height").alias("size"))
        .unionByName(cols.select("file_id", F.lit("col").alias("dim"), F.col("min_col").cast("long").alias("at"), F.col("width").alias("size")))
        .unionByName(
            merges.select("file_id", F.lit("merge").alias("dim"), F.col("row").alias("at"), (F.col("rowspan") * F.col("colspan")).cast("double").alias("size"))
        )
    )


@query(
    "scan_slide_items",
    f"""SELECT doc_id AS doc, CAST(NULL AS VARCHAR) AS error, CAST(i AS BIGINT) AS z, CASE WHEN i % 5 = 4 THEN 'table' WHEN trim(l) = '' THEN 'shape' ELSE 'text' END AS item_kind,
      CAST(i AS DOUBLE) AS x, CAST(2 AS DOUBLE) AS width, CASE WHEN trim(l) = '' THEN '' ELSE l END AS text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, unnest(generate_series(0, len(string_split(text, chr(10))) - 1)) AS i
      FROM documents WHERE doc_id % 10 <> 7 AND NOT {_PUBLIC})
    UNION ALL SELECT doc_id, CASE WHEN {_PUBLIC} THEN 'dtd-or-entity' ELSE 'unsupported-grpSp' END, NULL, NULL, NULL, NULL, NULL FROM documents WHERE doc_id % 10 = 7 OR {_PUBLIC}""",
)
def scan_slide_items(spark, sf):
    def body(line):
        return F.concat(F.lit("<a:p><a:r><a:t>"), escape_xml(line), F.lit("</a:t></a:r></a:p>"))

    def item(line, i):
        frame = F.concat(
            F.lit('<a:xfrm><a:off x="'), (i * 12700).cast("string"), F.lit('" y="0"/><a:ext cx="25400" cy="12700"/></a:xfrm>')
        )
        shape = F.concat(F.lit("<p:sp><p:spPr>"), frame, F.lit('<a:prstGeom prst="rect"/></p:spPr><p:txBody>'), body(line), F.lit("</p:txBody></p:sp>"))
        grid = F.concat(
            F.lit("<p:graphicFrame>"), frame, F.lit("<a:graphicData><a:tbl><a:tr><a:tc><a:txBody>"), body(line),
            F.lit("</a:txBody></a:tc></a:tr></a:tbl></a:graphicData></p:graphicFrame>"),
        )
        return F.when(i % 5 == 4, grid).otherwise(shape)

    group = F.when(F.col("doc_id") % 10 == 7, "<p:grpSp/>").otherwise("")
    xml = F.concat(
        F.lit('<p:sld xmlns:p="urn:p" xmlns:a="urn:a"><p:cSld><p:spTree><p:nvGrpSpPr/><p:grpSpPr/>'),
        F.array_join(F.transform(_lines(), item), ""), group, F.lit("</p:spTree></p:cSld></p:sld>"),
    )
    parts = wide_table(spark, sf, "documents").select(F.col("doc_id").alias("doc"), F.lit(1).alias("scene"), xml.alias("xml"))
    return O.scan_slide_items(parts).select("doc", "error", F.col("z").cast("long").alias("z"), "item_kind", "x", "width", "text")


# ---- files in, texts and reports out ------------------------------------------------------------


FILE_DOCS = 200  # documents a file


def digests(batches):
    """Size and MD5 of each key's parts, in the order they come; no part is held with another."""
    key, size, digest = None, 0, None
    for batch in batches:
        for k, content in zip(batch.column("key"), batch.column("content")):
            if k.as_py() != key:
                if digest:
                    yield pa.RecordBatch.from_pydict({"key": [key], "size": [size], "digest": [digest.hexdigest()]})
                key, size, digest = k.as_py(), 0, hashlib.md5()
            data = content.as_buffer()
            digest.update(data)
            size += data.size
    if digest:
        yield pa.RecordBatch.from_pydict({"key": [key], "size": [size], "digest": [digest.hexdigest()]})


@query(
    "scan_files",
    """SELECT source AS name, CASE WHEN length(source) % 2 = 0 THEN 'text/plain' ELSE '' END AS mime, sum(strlen(text) + 1)::BIGINT AS size,
      md5(string_agg(text || chr(10), '' ORDER BY doc_id)) AS digest FROM documents GROUP BY source""",
)
def scan_files(spark, sf):
    """The documents as files of a few hundred each, scanned as a file table, told together by
    source and given the types of a manifest."""
    source, order = F.col("source"), F.asc_nulls_last("doc_id")
    # A folder's name can be neither null nor of any length.
    key = F.md5(F.coalesce(F.concat(F.lit("s"), source), F.lit("n")).cast("binary")).alias("key")
    docs = table(spark, sf, "documents").select("doc_id", "source", key, F.col("text").alias("value"))
    path = f"{checkpoint_dir(spark)}/files-{uuid.uuid4().hex}"
    dealt = docs.repartitionByRange("key", order).sortWithinPartitions("key", order).select("key", "value")
    dealt.write.option("maxRecordsPerFile", FILE_DOCS).partitionBy("key").text(path)
    place = r"key=(\w+)/part-(\d+)-.*[-.]c(\d+)\.txt$"
    parts = S.scan_files(spark, path, "*.txt").select(
        F.regexp_extract("path", place, 1).alias("key"), *[F.regexp_extract("path", place, k).cast("int").alias(c) for k, c in ((2, "task"), (3, "file"))], "content"
    )
    whole = parts.repartition("key").sortWithinPartitions("key", "task", "file").select("key", "content").mapInArrow(digests, "key string, size long, digest string")
    files = whole.join(docs.select("key", source.alias("name")).distinct(), "key")
    names = docs.select(source.alias("name")).distinct().where(F.length("name") % 2 == 0)
    typed = S.with_manifest(files, names.withColumn("mime", F.lit("text/plain")))
    return typed.select("name", "mime", "size", "digest")


@query(
    "scan_manifest",
    """SELECT source AS corpus, CASE WHEN length(source) % 2 = 0 THEN lang ELSE lang || ' kind' END AS kind, 'f' || doc_id || '.bin' AS name, lang || '/f' || doc_id || '.bin' AS path, n_chars AS bytes, CAST(2 AS BIGINT) AS features FROM documents""",
)
def scan_manifest(spark, sf):
    docs = table(spark, sf, "documents")
    name = F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.lit(".bin"))
    path = F.concat("lang", F.lit("/"), name)
    kind, both = F.concat("lang", F.lit(" kind")), F.array(F.lit("a"), F.lit("b"))
    # One manifest per document here: in the list form for half of the sources, in the map form for the rest.
    listed = F.to_json(F.struct(F.array(F.struct(kind.alias("kind"), name.alias("name"), path.alias("path"), F.col("n_chars").alias("bytes"), both.alias("features"))).alias("fixtures")))
    mapped = F.to_json(F.struct(F.create_map(path, F.struct(F.col("n_chars").alias("bytes"), both.alias("features"))).alias("fixtures")))
    odd = F.length("source") % 2 == 1
    manifests = docs.select(F.when(odd, listed).otherwise(mapped).alias("json"))
    fixtures = S.parse_manifest(manifests)
    owner = docs.select(path.alias("path"), F.col("source").alias("corpus"))
    return fixtures.join(owner, "path").select("corpus", "kind", "name", "path", "bytes", F.size("features").cast("long").alias("features"))


@query("write_text_docs", "SELECT doc_id AS doc, md5(text) AS digest FROM documents WHERE doc_id % 9 <> 0")
def write_text_docs(spark, sf):
    docs = table(spark, sf, "documents").select(
        F.col("doc_id").alias("doc"), F.when(F.col("doc_id") % 9 != 0, F.col("text")).alias("text")
    )
    path = f"{checkpoint_dir(spark)}/texts-{uuid.uuid4().hex}"
    K.write_text_docs(docs, path)
    return K.read_text_docs(spark, path).select("doc", F.md5(F.encode("text", "UTF-8")).alias("digest"))


@query("write_report", "SELECT doc_id AS doc, n_chars > 500 AS ok, '2026-01-01T00:00:00Z' AS generated_at, bool_and(n_chars > 500) OVER () AS strict FROM documents")
def write_report(spark, sf):
    results = table(spark, sf, "documents").select(F.col("doc_id").alias("doc"), (F.col("n_chars") > 500).alias("ok"))
    path = f"{checkpoint_dir(spark)}/report-{uuid.uuid4().hex}"
    strict = K.write_report(results, path, "2026-01-01T00:00:00Z")
    return spark.read.schema("doc long, ok boolean, generated_at string").json(path).withColumn("strict", F.lit(strict))


# ---- whole workbooks: text lines → worksheet → package → cells -------------------------------------


def _workbooks(spark, sf):
    def row(line, i):
        n = (i + 1).cast("string")
        return F.concat(
            F.lit('<row r="'), n, F.lit('"><c r="A'), n, F.lit('" s="1"><v>'), (F.length(line) + 40_000).cast("string"),
            F.lit('</v></c><c r="B'), n, F.lit('" t="inlineStr"><is><t>'), escape_xml(line), F.lit('</t></is></c><c r="C'), n,
            F.lit('" t="s"><v>'), n, F.lit('</v></c><c r="D'), n, F.lit('" t="b"><v>1</v></c></row>'),
        )

    ext = F.when(F.col("doc_id") % 50 == 0, '<row r="999"><c r="A999"><f>[1]Other!A1</f><v>1</v></c></row>').otherwise("")
    xml = F.concat(
        F.lit('<worksheet xmlns="urn:s"><sheetData>'), F.array_join(F.transform(_lines(), row), ""), ext, F.lit("</sheetData></worksheet>")
    )
    docs = wide_table(spark, sf, "documents").select(F.col("doc_id").alias("file_id"), xml.alias("xml"))
    return docs.select("file_id", pack_workbook("file_id", "xml").alias("content"))


_WB_LINES = f"""SELECT doc_id, l, i FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, unnest(generate_series(1, len(string_split(text, chr(10))))) AS i
  FROM documents WHERE NOT {_PUBLIC} AND doc_id % 50 NOT IN (0, {", ".join(map(str, BROKEN_WORKBOOKS))}))"""
# Codes of the whole package come before what its first sheet says.
_WHOLE = ("missing-content-types", "macros", "embedded-content", "no-sheets", "blank-sheet", "missing-relationships")
_BROKEN = " ".join(f"WHEN {k} THEN '{code}'" for k, (code, *_) in BROKEN_WORKBOOKS.items())


@query(
    "workbook_cells",
    f"""SELECT doc_id AS file_id, i - 1 AS row, CAST(c AS BIGINT) AS col, CASE c WHEN 0 THEN 'double' WHEN 3 THEN 'bool' ELSE 'string' END AS value_type, CASE WHEN c = 0 THEN 'center' END AS align, c > 0 AS bold,
      CASE c WHEN 0 THEN strftime(DATE '1899-12-30' + CAST(length(l) + 40000 AS INT), '%Y-%m-%d') WHEN 1 THEN trim(l) WHEN 2 THEN CASE i WHEN 1 THEN 'one' WHEN 2 THEN 'two' ELSE '' END ELSE 'true' END AS shown
    FROM (SELECT *, unnest([0, 1, 2, 3]) AS c FROM ({_WB_LINES}))""",
)
def workbook_cells_query(spark, sf):
    cells, _ = workbook_cells(_workbooks(spark, sf))
    return cells.select("file_id", "row", "col", "value_type", "align", "bold", "shown")


@query(
    "sheet_rejects",
    """SELECT doc_id AS file_id, ref, reason FROM documents, (VALUES ('A20001', 'off-grid'), ('SG3', 'off-grid'), ('7up', 'bad-reference')) r(ref, reason)
      WHERE NOT """
    + _PUBLIC
    + " UNION ALL SELECT doc_id, NULL, 'malformed' FROM documents WHERE "
    + _PUBLIC,
)
def sheet_rejects(spark, sf):
    off = '<row><c r="A20001"/><c r="SG3"><v>1</v></c><c r="7up"/></row></sheetData>'
    parts = _sheet_parts(spark, sf).withColumn("xml", F.replace("xml", F.lit("</sheetData>"), F.lit(off)))
    # A part that the guard refuses is no worksheet.
    parts = parts.withColumn("xml", F.when(O.xml_guard(F.col("xml")).isNull(), F.col("xml")))
    return O.scan_sheet_rejects(parts).select("file_id", "ref", "reason")


_DIM_REJECTS = (
    ("row", "20001", "off-grid"), ("row", "30000", "off-grid"), ("col", "499:501", "cut"), ("col", "501:600", "off-grid"), ("col", "9:8", "empty"),
    ("merge", "A20001:B20002", "off-grid"), ("merge", "SF1:SG2", "cut"), ("merge", "A19999:A20001", "cut"), ("merge", "B2:?", "bad-reference"),
)


@query(
    "sheet_dim_rejects",
    f"""SELECT doc_id AS file_id, dim, ref, reason FROM documents, (VALUES {", ".join(map(str, _DIM_REJECTS))}) r(dim, ref, reason) WHERE NOT {_PUBLIC}
      UNION ALL SELECT doc_id, 'row', CAST(i AS VARCHAR), 'off-grid' FROM (SELECT doc_id, unnest(generate_series(20001, len(string_split(text, chr(10))))) AS i FROM documents WHERE NOT {_PUBLIC})""",
)
def sheet_dim_rejects(spark, sf):
    # Every sheet gets rows, spans and merges that the grid cannot hold, next to those it can.
    off = {
        "</cols>": '<col min="499" max="501" width="9"/><col min="501" max="600" width="9"/><col min="9" max="8"/></cols>',
        "</sheetData>": '<row r="20001" ht="30"/><row r="30000"/></sheetData>',
        "</mergeCells>": "".join(f'<mergeCell ref="{ref}"/>' for dim, ref, _ in _DIM_REJECTS if dim == "merge") + "</mergeCells>",
    }
    parts = _sheet_parts(spark, sf)
    for end, more in off.items():
        parts = parts.withColumn("xml", F.replace("xml", F.lit(end), F.lit(more)))
    parts = parts.withColumn("xml", F.when(O.xml_guard(F.col("xml")).isNull(), F.col("xml")))
    return O.scan_dim_rejects(parts).select("file_id", "dim", "ref", "reason")


@query(
    "workbook_refusals",
    f"""SELECT file_id, problem FROM (SELECT doc_id AS file_id, CASE WHEN b IN {_WHOLE} THEN b WHEN {_PUBLIC} THEN 'dtd-or-entity'
      WHEN doc_id % 50 = 0 THEN 'external-formula' ELSE b END AS problem FROM (SELECT *, CASE doc_id % 50 {_BROKEN} END AS b FROM documents)) WHERE problem IS NOT NULL""",
)
def workbook_refusals(spark, sf):
    _, refused = workbook_cells(_workbooks(spark, sf))
    return refused
