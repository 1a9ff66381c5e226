"""Office parts: XML guard, worksheets, relationships, slides."""

from __future__ import annotations

import xml.etree.ElementTree as ET

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import dims
from ..functions.cells import a1_to_rowcol, is_external_formula, range_to_box
from ..functions.html import UNDECLARED
from ..functions.text import EMU_PER_POINT, clamp

# What is refused before any XML is read.
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F]"
DANGEROUS = r"(?i)<!DOCTYPE|<!ENTITY|\b(?:SYSTEM|PUBLIC)\b|\[\s*<!"
ASIDE = r"(?s)<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>"
NAME = r"[A-Za-z_:][\w:.\-]*"
QUOTED = r"""(?:"[^"<]*"|'[^'<]*')"""
# A tag ends at the first ``>`` outside quotes.
TAG = r"""</?[A-Za-z_:](?:[^<>"']|"[^"]*"|'[^']*')*>"""
WHOLE_TAG = rf"^(?:<{NAME}(?:\s+{NAME}\s*=\s*{QUOTED})*\s*/?>|</{NAME}\s*>)\z"
REPEATED = r"\s([\w:.\-]+)\s*=.*\s\1\s*="
# A whole tag, no attribute twice, with the text behind it; an element of nothing inside another; a root of nothing.
ATTRIBUTE = rf"\s+{NAME}\s*=\s*{QUOTED}"
TWICE = rf"(?:{ATTRIBUTE})*?\s+({NAME})\s*=\s*{QUOTED}(?:{ATTRIBUTE})*?\s+\2\s*="
BARE_TAG = rf"<(?:({NAME})(?!{TWICE})(?:{ATTRIBUTE})*+\s*+(/?)|(/{NAME})\s*+)>[^<]*+"
LEAF = rf"(?<=>)<(?:({NAME})></\1|{NAME}/)>(?=<)"
BARE_ROOT = rf"^<(?:({NAME})></\1|{NAME}/)>\z"
PLAIN_DEPTH = 16


def plainly_formed(bare: Column) -> Column:
    """Surely well-formed, without a fold over the tags: of the names alone, elements without
    content vanish level by level until the root is left.  False also for what is deeper."""
    names = F.regexp_replace(bare, BARE_TAG, "<$1$3$4>")
    for _ in range(min(PLAIN_DEPTH, dims.MAX_XML_DEPTH) - 1):
        names = F.regexp_replace(names, LEAF, "")
    return names.rlike(BARE_ROOT)


def xml_guard(text: Column) -> Column:
    """Reason to refuse an XML text, null when it may be parsed.

    Well-formed means: every tag is whole, its attributes quoted and named once, tags
    close in the order they opened, and there is one root.
    """
    def once(value: Column, then) -> Column:
        """``then`` of a value that is worked out a single time, however often it is used."""
        return F.get(F.transform(F.array(value), then), F.lit(0))

    start = F.struct(
        F.expr("cast(array() as array<string>)").alias("open"), F.lit(0).alias("deepest"), F.lit(0).alias("roots"), F.lit(False).alias("torn")
    )

    def mark(tag: Column) -> Column:
        """``name`` of what opens, ``/name`` of what closes, nothing for what does both."""
        return F.when(tag.endswith("/>") & ~tag.startswith("</"), "").otherwise(F.regexp_extract(tag, r"^<(/?[^\s/>]+)", 1))

    def step(s: Column, mark: Column) -> Column:
        closes, depth = mark.startswith("/"), F.size(s["open"])
        return F.when(
            closes,
            F.struct(
                F.slice(s["open"], 1, F.greatest(depth - 1, F.lit(0))).alias("open"),
                F.greatest(s["deepest"], depth).alias("deepest"),
                s["roots"].alias("roots"),
                (s["torn"] | ~F.coalesce(F.concat(F.lit("/"), F.get(s["open"], depth - 1)).eqNullSafe(mark), F.lit(False))).alias("torn"),
            ),
        ).otherwise(
            F.struct(
                F.when(mark == "", s["open"]).otherwise(F.concat(s["open"], F.array(mark))).alias("open"),
                F.greatest(s["deepest"], depth + 1).alias("deepest"),
                (s["roots"] + F.when(depth == 0, 1).otherwise(0)).alias("roots"),
                s["torn"].alias("torn"),
            )
        )

    def broken(tag: Column) -> Column:
        twice = F.when(tag.rlike("=[^=]*="), F.regexp_replace(tag, QUOTED, '""').rlike(REPEATED)).otherwise(False)
        return ~tag.rlike(WHOLE_TAG) | twice

    def by_tags(bare: Column, tags: Column) -> Column:
        stray = F.regexp_replace(bare, TAG, "").contains("<")
        return once(
            F.aggregate(F.transform(tags, mark), start, step),
            lambda shape: F.when(shape["deepest"] > dims.MAX_XML_DEPTH, "too-deep").when(
                shape["torn"] | (F.size(shape["open"]) != 0) | (shape["roots"] != 1) | F.exists(tags, broken) | stray, "malformed"
            ),
        )

    def by_text(bare: Column) -> Column:
        # Counted before any fold: neither nodes nor depth may cost more than their caps.
        return (
            F.when(bare.rlike(UNDECLARED), "undeclared-entity")
            .when((F.length(bare) > 2 * dims.MAX_XML_NODES) & (F.regexp_count(bare, F.lit("<[A-Za-z_]")) > dims.MAX_XML_NODES), "too-many-nodes")
            .when(~plainly_formed(bare), once(F.regexp_extract_all(bare, F.lit(TAG), F.lit(0)), lambda tags: by_tags(bare, tags)))
        )

    # What DANGEROUS finds holds one of these.
    suspect = text.contains("<!") | F.upper(text).contains("SYSTEM") | F.upper(text).contains("PUBLIC")
    return (
        F.when(F.length(text) > dims.MAX_XML_BYTES, "too-large")
        .when(text.rlike(CONTROL), "control-character")
        .when(suspect & text.rlike(DANGEROUS), "dtd-or-entity")
        .when(text.isNotNull(), once(F.when(text.contains("<!") | text.contains("<?"), F.regexp_replace(text, ASIDE, "")).otherwise(text), by_text))
    )


NO_NS = {"ignoreNamespace": "true"}

# ---- worksheets ---------------------------------------------------------------------------

SHEET_SCHEMA = """struct<
  cols: struct<col: array<struct<_min: string, _max: string, _width: string>>>,
  sheetData: struct<row: array<struct<_r: string, _ht: string,
    c: array<struct<_r: string, _t: string, _s: string, f: string, v: string, is: struct<t: string, r: array<struct<t: string>>>>>>>>,
  mergeCells: struct<mergeCell: array<struct<_ref: string>>>>"""


def _sheet(parts: DataFrame) -> DataFrame:
    """``parts``: file_id, sheet_ord, xml (guarded)."""
    return parts.select("file_id", "sheet_ord", F.from_xml("xml", SHEET_SCHEMA, NO_NS).alias("x"))


def _all_cells(parts: DataFrame) -> DataFrame:
    """Cells, and a row without one for what has none; ``unread`` marks what is no worksheet."""
    rows = _sheet(parts).select("file_id", "sheet_ord", F.col("x").isNull().alias("unread"), F.explode_outer("x.sheetData.row").alias("r"))
    cells = rows.select("file_id", "sheet_ord", "unread", F.explode_outer("r.c").alias("c"))
    on_grid = (F.col("at.row") < dims.MAX_SHEET_ROWS) & (F.col("at.col") < dims.MAX_SHEET_COLUMNS)
    placed = cells.withColumn("at", F.when(F.col("c").isNotNull(), a1_to_rowcol(F.coalesce("c._r", F.lit("")))))
    return placed.withColumn("on_grid", F.coalesce(on_grid, F.lit(False)))


def _value_of() -> tuple[Column, Column]:
    """Value and formula of a cell ``c``."""
    inline = F.coalesce("c.is.t", F.array_join(F.transform("c.is.r", lambda r: r["t"]), ""), F.lit(""))
    value = F.trim(F.when(F.col("c._t") == "inlineStr", inline).otherwise(F.coalesce("c.v", F.lit(""))))
    return value, F.nullif(F.trim("c.f"), F.lit(""))


def scan_sheet_rows(parts: DataFrame) -> DataFrame:
    """What ``sheet_facts`` and ``sheet_cells`` tell of, from one reading of each part: its
    cells, on the grid or not, or a row without one; ``unread`` marks what is no worksheet."""
    value, formula = _value_of()
    return _all_cells(parts).select(
        "file_id",
        "sheet_ord",
        "unread",
        "on_grid",
        F.col("at.row").alias("row"),
        F.col("at.col").alias("col"),
        F.col("c._r").alias("ref"),
        F.col("c._t").alias("t"),
        value.alias("v"),
        formula.alias("f"),
        F.coalesce(F.floor(F.col("c._s").try_cast("double")), F.lit(0)).cast("long").alias("style_idx"),
    )


def sheet_facts(rows: DataFrame) -> DataFrame:
    def some(what: Column) -> Column:
        return F.coalesce(F.bool_or(F.col("on_grid") & what), F.lit(False))

    return rows.groupBy("file_id", "sheet_ord").agg(
        F.bool_or("unread").alias("unread"),
        some(is_external_formula(F.col("f"))).alias("external"),
        some((F.col("v") != "") | F.col("f").isNotNull()).alias("filled"),
    )


def sheet_cells(rows: DataFrame) -> DataFrame:
    return rows.where("on_grid").drop("unread", "on_grid")


def scan_sheet_facts(parts: DataFrame) -> DataFrame:
    """file_id, sheet_ord, unread, external, filled: whether a part is no worksheet, and
    whether its cells on the grid hold an outside formula, and anything at all; one pass."""
    return sheet_facts(scan_sheet_rows(parts))


def scan_sheet_cells(parts: DataFrame) -> DataFrame:
    """file_id, sheet_ord, row, col, ref, t, v, f, style_idx of the cells on the grid;
    ``scan_sheet_rejects`` has the others."""
    return sheet_cells(scan_sheet_rows(parts))


def scan_sheet_rejects(parts: DataFrame) -> DataFrame:
    """What a sheet holds and the grid does not: file_id, sheet_ord, ref, reason (bad
    reference, or row or column beyond the grid's size); one row without a reference for
    a part that is no worksheet."""
    off = _all_cells(parts).where(F.col("unread") | (F.col("c").isNotNull() & ~F.col("on_grid")))
    known = F.col("at.row").isNotNull() & F.col("at.col").isNotNull()
    reason = F.when(F.col("unread"), "malformed").when(known, "off-grid").otherwise("bad-reference")
    return off.select("file_id", "sheet_ord", F.col("c._r").alias("ref"), reason.alias("reason"))


def _spans(parts: DataFrame) -> DataFrame:
    cols = _sheet(parts).select("file_id", "sheet_ord", F.posexplode_outer("x.cols.col").alias("ord", "c")).where(F.col("ord").isNotNull())
    return cols.select("file_id", "sheet_ord", "ord", *[F.col(f"c._{a}").try_cast("double").alias(b) for a, b in (("min", "min_col"), ("max", "max_col"), ("width", "width"))])


def _row_number(r: Column, at: Column) -> Column:
    number = F.floor(F.coalesce(r["_r"].try_cast("double"), at + 1)) - 1
    return F.greatest(F.lit(0), number).cast("long")


def _heights(parts: DataFrame) -> DataFrame:
    """Rows with their index; one without a number follows its place in the file."""
    rows = _sheet(parts).select("file_id", "sheet_ord", F.posexplode_outer("x.sheetData.row").alias("at", "r")).where(F.col("at").isNotNull())
    return rows.withColumn("row", _row_number(F.col("r"), F.col("at")))


def _merges(parts: DataFrame) -> DataFrame:
    merges = _sheet(parts).select("file_id", "sheet_ord", F.posexplode_outer("x.mergeCells.mergeCell").alias("ord", "m")).where(F.col("ord").isNotNull())
    return merges.withColumn("box", range_to_box(F.coalesce("m._ref", F.lit(""))))


def scan_sheet_dims(parts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Column spans, row heights and merges of worksheets; ``scan_dim_rejects`` has what
    lies beyond the grid or cannot be read."""
    rows = _heights(parts).where(F.col("row") < dims.MAX_SHEET_ROWS).select(
        "file_id", "sheet_ord", "row", clamp(F.col("r._ht").try_cast("double"), 10, 120, 20).alias("height")
    )
    merges = _merges(parts).where(F.col("box").isNotNull()).select("file_id", "sheet_ord", "ord", "box.*")
    return _spans(parts), rows, merges


def scan_dim_rejects(parts: DataFrame) -> DataFrame:
    """What scan_sheet_dims, expand_col_widths and the merge operators leave out, a row
    each: file_id, sheet_ord, dim (col, row, merge), ref, reason.

    ``off-grid``: a row, a span's columns or a merge's anchor beyond the grid; ``cut``: a
    span or merge that begins on the grid and ends beyond it (its part on the grid
    counts); ``bad-reference``: a merge without a range; ``empty``: a span that ends
    before it begins.
    """
    high, wide = F.lit(dims.MAX_SHEET_ROWS), F.lit(dims.MAX_SHEET_COLUMNS)

    def reject(dim: str, ref: Column, reason: Column) -> Column:
        return F.struct(F.lit(dim).alias("dim"), ref.alias("ref"), reason.alias("reason"))

    def row(r: Column, at: Column) -> Column:
        number = _row_number(r, at)
        return reject("row", (number + 1).cast("string"), F.when(number >= high, "off-grid"))

    def span(c: Column) -> Column:
        # Bounds of a span as expand_col_widths takes them.
        low = F.greatest(F.lit(1), F.floor(F.coalesce(c["_min"].try_cast("double"), F.lit(1)))).cast("long")
        last = F.floor(F.coalesce(c["_max"].try_cast("double"), low)).cast("long")
        return reject("col", F.concat_ws(":", low, last), F.when(last < low, "empty").when(low > wide, "off-grid").when(last > wide, "cut"))

    def merge(m: Column) -> Column:
        box = range_to_box(F.coalesce(m["_ref"], F.lit("")))
        bottom, right = box["row"] + box["rowspan"], box["col"] + box["colspan"]
        off = (box["row"] >= high) | (box["col"] >= wide)
        return reject("merge", m["_ref"], F.when(box.isNull(), "bad-reference").when(off, "off-grid").when((bottom > high) | (right > wide), "cut"))

    # All three kinds leave the sheet in one pass over its text.
    lists = [F.transform(F.col(f"x.{path}"), why) for path, why in (("sheetData.row", row), ("cols.col", span), ("mergeCells.mergeCell", merge))]
    told = F.concat(*[F.coalesce(F.filter(each, lambda w: w["reason"].isNotNull()), F.filter(F.array(reject("", F.lit(""), F.lit(""))), lambda w: F.lit(False))) for each in lists])
    return _sheet(parts).select("file_id", "sheet_ord", F.inline_outer(told)).where(F.col("dim").isNotNull())


RELS_SCHEMA = "struct<Relationship: array<struct<_Id: string, _Type: string, _Target: string, _TargetMode: string>>>"


def scan_relationships(parts: DataFrame) -> DataFrame:
    """``parts``: file_id, source_part, xml → one row per relationship."""
    rels = parts.select(
        "file_id", "source_part", F.explode_outer(F.from_xml("xml", RELS_SCHEMA, NO_NS)["Relationship"]).alias("r")
    ).where(F.col("r").isNotNull())
    return rels.select(
        "file_id",
        "source_part",
        F.col("r._Id").alias("rel_id"),
        F.col("r._Type").alias("type"),
        F.col("r._Target").alias("target"),
        F.col("r._TargetMode").alias("mode"),
    )


# ---- slides ------------------------------------------------------------------------------------

SLIDE_ITEM = T.StructType(
    [
        T.StructField("z", T.IntegerType()),
        T.StructField("item_kind", T.StringType()),
        T.StructField("preset", T.StringType()),
        T.StructField("x", T.DoubleType()),
        T.StructField("y", T.DoubleType()),
        T.StructField("width", T.DoubleType()),
        T.StructField("height", T.DoubleType()),
        T.StructField("text", T.StringType()),
        T.StructField("table_rows", T.IntegerType()),
    ]
)
SLIDE = T.StructType([T.StructField("error", T.StringType()), T.StructField("items", T.ArrayType(SLIDE_ITEM))])
ITEM_ARROW = pa.struct(
    [("z", pa.int32()), ("item_kind", pa.string()), ("preset", pa.string()), ("x", pa.float64()), ("y", pa.float64()),
     ("width", pa.float64()), ("height", pa.float64()), ("text", pa.string()), ("table_rows", pa.int32())]
)
SLIDE_ARROW = pa.struct([("error", pa.string()), ("items", pa.list_(ITEM_ARROW))])

# Tree children that are skipped, that reject the deck, shapes known.
SKIPPED = {"nvGrpSpPr", "grpSpPr"}
REJECTED = {"grpSp", "cxnSp", "oleObj", "media", "video", "audio"}
PRESETS = {"rect", "roundRect", "ellipse", "oval", "line"}


def _local(node: ET.Element) -> str:
    return node.tag.rpartition("}")[2]


def _first(node: ET.Element | None, name: str) -> ET.Element | None:
    return None if node is None else next((n for n in node.iter() if n is not node and _local(n) == name), None)


def _points(node: ET.Element | None, name: str, low: float, fallback: float) -> float:
    try:
        emu = float(node.get(name)) if node is not None and node.get(name) is not None else 0.0
    except ValueError:
        emu = 0.0
    value = max(0.0, emu) / EMU_PER_POINT
    return min(100_000.0, max(low, value)) if value == value else fallback


def _paragraph_text(body: ET.Element | None) -> str:
    lines = []
    for paragraph in body if body is not None else ():
        if _local(paragraph) == "p":
            runs = [c for c in paragraph if _local(c) in ("r", "fld")]
            texts = ["".join(t.itertext()) for run in runs if (t := _first(run, "t")) is not None]
            line = "".join(texts) or "".join(paragraph.itertext()).strip()
            if line:
                lines.append(line)
    return "\n".join(lines)


def slide_items(xml: str) -> dict:
    """Items of a slide in document order, which is their stacking order."""
    try:
        tree = _first(ET.fromstring(xml), "spTree")
    except ET.ParseError:
        return {"error": "malformed", "items": []}
    if tree is None:
        return {"error": "no-shape-tree", "items": []}
    items = []
    for child in tree:
        kind = _local(child)
        if kind in REJECTED:
            return {"error": f"unsupported-{kind}", "items": []}
        if kind not in ("sp", "pic", "graphicFrame"):
            continue
        frame = _first(child, "xfrm")
        off, ext = _first(frame, "off"), _first(frame, "ext")
        geometry = _first(_first(child, "spPr"), "prstGeom")
        preset = geometry.get("prst") if geometry is not None else None
        item = {
            "z": len(items),
            "x": _points(off, "x", 0.0, 0.0),
            "y": _points(off, "y", 0.0, 0.0),
            "width": _points(ext, "cx", 1.0, 100.0),
            "height": _points(ext, "cy", 1.0, 50.0),
        }
        if kind == "sp":
            if preset and preset not in PRESETS:
                return {"error": f"unsupported-shape-{preset}", "items": []}
            text = _paragraph_text(_first(child, "txBody"))
            item |= {"item_kind": "text" if text else "shape", "text": text, "preset": preset}
        elif kind == "pic":
            item |= {"item_kind": "image", "text": ""}
        else:
            table = _first(child, "tbl")
            if table is None:
                return {"error": "unsupported-graphic", "items": []}
            rows = [r for r in table if _local(r) == "tr"]
            cells = [_paragraph_text(_first(c, "txBody")) for r in rows for c in r if _local(c) == "tc"]
            item |= {"item_kind": "table", "text": "\t".join(cells), "table_rows": len(rows)}
        items.append(item)
    return {"error": None if items else "no-content", "items": items}


@F.arrow_udf(returnType=SLIDE)
def _read_slide(xml: pa.Array) -> pa.Array:
    return pa.array([None if x is None else slide_items(x) for x in xml.to_pylist()], type=SLIDE_ARROW)


def scan_slide_items(parts: DataFrame) -> DataFrame:
    """``parts``: doc, scene, xml → items in stacking order; a refused slide is one row with error."""
    guarded = parts.select("doc", "scene", "xml", xml_guard(F.col("xml")).alias("refused"))
    read = guarded.select("doc", "scene", "refused", _read_slide(F.when(F.col("refused").isNull(), F.col("xml"))).alias("s"))
    return read.select(
        "doc", "scene", F.coalesce("refused", "s.error").alias("error"), F.explode_outer("s.items").alias("i")
    ).select("doc", "scene", "error", "i.*")


# ---- workbook, strings, styles -------------------------------------------------------------------

def _list(parts: DataFrame, schema: str, path: str) -> DataFrame:
    """Members of a repeated element with their position."""
    column = F.from_xml("xml", schema, NO_NS)
    for name in path.split("."):
        column = column[name]
    return parts.select("file_id", F.posexplode_outer(column).alias("idx", "e")).where(F.col("idx").isNotNull())


def scan_workbook_sheets(parts: DataFrame) -> DataFrame:
    """file_id, sheet_ord, name, rel_id in workbook order."""
    rows = _list(parts, "struct<sheets: struct<sheet: array<struct<_name: string, _id: string>>>>", "sheets.sheet")
    return rows.select("file_id", F.col("idx").alias("sheet_ord"), F.col("e._name").alias("name"), F.col("e._id").alias("rel_id"))


def scan_shared_strings(parts: DataFrame) -> DataFrame:
    rows = _list(parts, "struct<si: array<struct<t: string, r: array<struct<t: string>>>>>", "si")
    text = F.concat(F.coalesce("e.t", F.lit("")), F.coalesce(F.array_join(F.transform("e.r", lambda r: r["t"]), ""), F.lit("")))
    return rows.select("file_id", "idx", text.alias("text"))


def scan_styles(parts: DataFrame) -> DataFrame:
    xf = "struct<_fontId: string, _fillId: string, _numFmtId: string, alignment: struct<_horizontal: string>>"
    rows = _list(parts, f"struct<cellXfs: struct<xf: array<{xf}>>>", "cellXfs.xf")

    def number(name: str) -> Column:
        return F.coalesce(F.col(f"e.{name}").try_cast("long"), F.lit(0).cast("long"))

    return rows.select(
        "file_id",
        "idx",
        number("_fontId").alias("font_id"),
        number("_fillId").alias("fill_id"),
        number("_numFmtId").alias("num_fmt_id"),
        F.col("e.alignment._horizontal").alias("align"),
    )


def _colour(value: Column) -> Column:
    raw = F.regexp_replace(value, "^#", "")
    return F.when(raw.rlike(r"(?i)^[0-9a-f]{6}\z"), F.concat(F.lit("#"), raw))


def scan_fonts(parts: DataFrame) -> DataFrame:
    font = "struct<b: string, i: string, u: string, color: struct<_rgb: string>>"
    rows = _list(parts, f"struct<fonts: struct<font: array<{font}>>>", "fonts.font")
    return rows.select(
        "file_id", "idx", F.col("e.b").isNotNull().alias("bold"), F.col("e.i").isNotNull().alias("italic"), F.col("e.u").isNotNull().alias("underline"), _colour(F.col("e.color._rgb")).alias("color")
    )


def scan_fills(parts: DataFrame) -> DataFrame:
    fill = "struct<patternFill: struct<fgColor: struct<_rgb: string>>>"
    rows = _list(parts, f"struct<fills: struct<fill: array<{fill}>>>", "fills.fill")
    return rows.select("file_id", "idx", _colour(F.col("e.patternFill.fgColor._rgb")).alias("fill"))


def scan_number_formats(parts: DataFrame) -> DataFrame:
    rows = _list(parts, "struct<numFmts: struct<numFmt: array<struct<_numFmtId: string, _formatCode: string>>>>", "numFmts.numFmt")
    return rows.select(
        "file_id", F.coalesce(F.col("e._numFmtId").try_cast("long"), F.lit(0).cast("long")).alias("num_fmt_id"), F.coalesce("e._formatCode", F.lit("")).alias("code")
    )
