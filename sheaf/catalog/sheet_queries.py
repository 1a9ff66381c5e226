"""Queries over workbooks, scenes and layouts."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import dims
from ..functions import cells as C
from ..operators import quality as Q
from ..operators import sheets as S
from . import recipes as R
from .registry import query

D = R.duck
CELLS, SR = R.CELLS_DUCK, R.SHEET_ROWS_DUCK


def _long(*names: str):
    return [F.col(n).cast("long").alias(n) for n in names]


# ---- references ---------------------------------------------------------------------

_REFS = """SELECT l_orderkey * 10 + l_linenumber AS id, l_partkey % 800 AS col, l_suppkey AS row, l_linenumber AS k FROM <lineitem>"""
_LETTERS = """CASE WHEN col < 26 THEN chr(CAST(65 + col AS INT)) WHEN col < 702 THEN chr(CAST(64 + floor(col / 26) AS INT)) || chr(CAST(65 + col % 26 AS INT))
  ELSE 'A' || chr(CAST(65 + floor((col - 702) / 26) AS INT)) || chr(CAST(65 + (col - 702) % 26 AS INT)) END"""
_REF_TEXT = f"""SELECT id, row, col, k, CASE k WHEN 1 THEN '$' || lower(letters) || '$' || CAST(row + 1 AS STRING) WHEN 2 THEN ' ' || letters || CAST(row + 1 AS STRING) || ' '
  WHEN 3 THEN letters || '-' || CAST(row AS STRING) WHEN 4 THEN CAST(row AS STRING) ELSE letters || CAST(row + 1 AS STRING) END AS ref
  FROM (SELECT *, {_LETTERS} AS letters FROM ({_REFS}) AS r) AS t"""


@query(
    "a1_to_rowcol",
    f"SELECT id, ref, CASE WHEN k NOT IN (3, 4) THEN row END AS row, CASE WHEN k NOT IN (3, 4) THEN col END AS col FROM ({D(_REF_TEXT)})",
)
def a1_to_rowcol(spark, sf):
    refs = R.run(spark, sf, _REF_TEXT, "lineitem").select("id", "ref", C.a1_to_rowcol(F.col("ref")).alias("at"))
    return refs.select("id", "ref", F.col("at.row").alias("row"), F.col("at.col").alias("col"))


_BOXES = f"""SELECT id, CASE k WHEN 1 THEN letters || CAST(row + 1 AS STRING) WHEN 2 THEN letters || CAST(row + 1 AS STRING) || ':A1' WHEN 3 THEN 'B2:?'
  ELSE letters || CAST(row + 1 AS STRING) || ':$C$9' END AS ref, row, col, k FROM (SELECT *, {_LETTERS} AS letters FROM ({_REFS}) AS r) AS t"""


@query(
    "range_to_box",
    f"""SELECT id, ref, CASE WHEN k = 3 THEN NULL ELSE least(row, r2) END AS row, CASE WHEN k = 3 THEN NULL ELSE least(col, c2) END AS col,
      CASE WHEN k = 3 THEN NULL ELSE abs(row - r2) + 1 END AS rowspan, CASE WHEN k = 3 THEN NULL ELSE abs(col - c2) + 1 END AS colspan
    FROM (SELECT *, CASE k WHEN 1 THEN row WHEN 2 THEN 0 ELSE 8 END AS r2, CASE k WHEN 1 THEN col WHEN 2 THEN 0 ELSE 2 END AS c2 FROM ({D(_BOXES)}))""",
)
def range_to_box(spark, sf):
    boxes = R.run(spark, sf, _BOXES, "lineitem").select("id", "ref", C.range_to_box(F.col("ref")).alias("box"))
    return boxes.select("id", "ref", *[F.col(f"box.{n}").alias(n) for n in ("row", "col", "rowspan", "colspan")])


@query("rowcol_to_a1", f"SELECT id, letters || (row + 1) AS ref FROM (SELECT *, {_LETTERS} AS letters FROM ({D(_REFS)}))")
def rowcol_to_a1(spark, sf):
    return R.run(spark, sf, _REFS, "lineitem").select("id", C.rowcol_to_a1(F.col("row"), F.col("col")).alias("ref"))


# ---- values -----------------------------------------------------------------------------

_SHARED = f"""SELECT c.*, CASE WHEN c.t = 's' THEN coalesce(s.text, '') END AS shared FROM ({CELLS}) AS c LEFT JOIN ({D(R.STRINGS)}) AS s
  ON s.file_id = c.file_id AND c.t = 's' AND s.idx = coalesce(TRY_CAST(c.v AS DOUBLE), 0)"""


@query("shared_strings", f"SELECT file_id, ref, shared FROM ({_SHARED}) WHERE t = 's'")
def shared_strings(spark, sf):
    cells = R.sheet(spark, sf, R.CELLS)
    out = S.shared_strings(cells, R.sheet(spark, sf, R.STRINGS))
    return out.where(F.col("t") == "s").select("file_id", "ref", "shared")


_TYPED = f"""SELECT *, CASE WHEN t = 'b' THEN 'bool' WHEN t IS NULL AND v <> '' AND TRY_CAST(v AS DOUBLE) IS NOT NULL THEN 'double' ELSE 'string' END AS value_type,
  CASE WHEN t IS NULL AND v <> '' THEN TRY_CAST(v AS DOUBLE) END AS d, CASE WHEN t = 'b' THEN v = '1' END AS b,
  CASE WHEN t = 's' THEN shared WHEN t = 'b' OR (t IS NULL AND v <> '' AND TRY_CAST(v AS DOUBLE) IS NOT NULL) THEN NULL ELSE v END AS s,
  coalesce(regexp_matches(f, '\\[[^\\]]+\\]|(?:https?|file):'), false) AS external FROM ({_SHARED})"""


@query("cell_value_type", f"SELECT file_id, ref, value_type, s, d, b, external FROM ({_TYPED})")
def cell_value_type(spark, sf):
    cells = S.shared_strings(R.sheet(spark, sf, R.CELLS), R.sheet(spark, sf, R.STRINGS))
    return S.typed_cells(cells).select("file_id", "ref", "value_type", "s", "d", "b", "external")


@query("external_workbooks", f"SELECT file_id, count(*) AS formulas FROM ({CELLS}) WHERE f LIKE '[1]%' GROUP BY file_id")
def external_workbooks(spark, sf):
    return S.external_workbooks(R.sheet(spark, sf, R.CELLS))


_STYLED = f"""SELECT c.file_id, c.ref, c.v, c.t, s.align AS raw_align, fo.bold, fo.italic, fo.underline, fo.color, fi.fill, coalesce(n.code, b.code) AS code FROM ({CELLS}) AS c
  LEFT JOIN ({D(R.STYLES)}) AS s ON s.file_id = c.file_id AND s.idx = c.style_idx
  LEFT JOIN ({D(R.FONTS)}) AS fo ON fo.file_id = s.file_id AND fo.idx = s.font_id LEFT JOIN ({D(R.FILLS)}) AS fi ON fi.file_id = s.file_id AND fi.idx = s.fill_id
  LEFT JOIN ({D(R.NUM_FMTS)}) AS n ON n.file_id = s.file_id AND n.num_fmt_id = s.num_fmt_id LEFT JOIN ({dims.NUMBER_FORMATS_SQL}) AS b ON b.num_fmt_id = s.num_fmt_id"""


def _styled(spark, sf, cells):
    return S.style_snowflake(
        cells, R.sheet(spark, sf, R.STYLES), R.sheet(spark, sf, R.FONTS), R.sheet(spark, sf, R.FILLS), R.sheet(spark, sf, R.NUM_FMTS)
    )


@query(
    "style_snowflake",
    f"""SELECT file_id, ref, bold, italic, underline, color, fill, CASE WHEN raw_align IN ('left','center','right') THEN raw_align END AS align, code AS num_fmt_code FROM ({_STYLED})""",
)
def style_snowflake(spark, sf):
    out = _styled(spark, sf, R.sheet(spark, sf, R.CELLS).select("file_id", "ref", "style_idx"))
    return out.select("file_id", "ref", "bold", "italic", "underline", "color", "fill", "align", "num_fmt_code")


@query(
    "excel_date",
    f"""SELECT file_id, ref, d, CASE WHEN code IN ('yyyy-mm-dd', 'dd/mm', 'm/d/yy') THEN strftime(DATE '1899-12-30' + CAST(floor(d) AS INT), '%Y-%m-%d') END AS iso_date
    FROM (SELECT *, TRY_CAST(v AS DOUBLE) AS d FROM ({_STYLED}) WHERE t IS NULL) WHERE d IS NOT NULL""",
)
def excel_date(spark, sf):
    cells = R.sheet(spark, sf, R.CELLS).where(F.col("t").isNull())
    numbers = cells.select("file_id", "ref", "style_idx", F.col("v").try_cast("double").alias("d")).where(F.col("d").isNotNull())
    return S.dated_cells(_styled(spark, sf, numbers)).select("file_id", "ref", "d", "iso_date")


_TEXT_CELLS = f"""SELECT file_id, sheet_ord, row, col, CASE col WHEN 0 THEN '=A' || v WHEN 1 THEN v || '.50' WHEN 2 THEN '0' || v WHEN 3 THEN '-' || v WHEN 4 THEN v
  WHEN 5 THEN v || 'e3' ELSE v END AS text FROM ({R.CELLS}) AS c"""


@query(
    "infer_number",
    f"""SELECT file_id, chr(CAST(65 + col AS INT)) || (row + 1) AS ref, kind AS cell_kind, CASE WHEN kind = 'number' THEN CAST(text AS DOUBLE) END AS number,
      CASE WHEN kind = 'formula' THEN substr(text, 2) END AS formula, row < 1 AS is_header
    FROM (SELECT *, CASE WHEN text[1:1] = '=' THEN 'formula' WHEN regexp_matches(text, '^-?(0|[1-9]\\d*)(\\.\\d+)?$') THEN 'number' ELSE 'text' END AS kind
      FROM ({_TEXT_CELLS.replace(R.CELLS, CELLS)}))""",
)
def infer_number(spark, sf):
    out = S.infer_number(R.sheet(spark, sf, _TEXT_CELLS), header_rows=1)
    return out.select("file_id", "ref", "cell_kind", "number", "formula", "is_header")


@query("header_flags", f"SELECT file_id, ref, row < 1 OR col < 2 AS is_header FROM ({CELLS})")
def header_flags(spark, sf):
    return S.header_flags(R.sheet(spark, sf, R.CELLS), 1, 2).select("file_id", "ref", "is_header")


# ---- grids ----------------------------------------------------------------------------------

_SIZES = f"SELECT file_id, sheet_ord, max(row) + 1 AS rows, max(col) + 1 AS cols FROM ({CELLS}) GROUP BY file_id, sheet_ord"


@query(
    "dense_grid",
    f"""WITH g AS (SELECT file_id, sheet_ord, row, unnest(generate_series(0, cols - 1)) AS col FROM
      (SELECT file_id, sheet_ord, cols, unnest(generate_series(0, rows - 1)) AS row FROM ({_SIZES})))
    SELECT g.file_id, g.row, string_agg(coalesce(c.v, ''), '|' ORDER BY g.col) AS line FROM g LEFT JOIN ({CELLS}) AS c
      ON c.file_id = g.file_id AND c.sheet_ord = g.sheet_ord AND c.row = g.row AND c.col = g.col GROUP BY g.file_id, g.row""",
)
def dense_grid(spark, sf):
    rows = S.dense_rows(R.sheet(spark, sf, R.CELLS), "v")
    return rows.select("file_id", "row", F.array_join("values", "|").alias("line"))


_COLS = f"""SELECT file_id, sheet_ord, col, arg_max(least(80, greatest(3, width)), ord) AS width FROM
  (SELECT *, unnest(generate_series(min_col - 1, max_col - 1)) AS col FROM ({D(R.SPANS)})) GROUP BY file_id, sheet_ord, col"""


@query("expand_col_widths", f"SELECT file_id, col, CAST(width AS DOUBLE) AS width FROM ({_COLS})")
def expand_col_widths(spark, sf):
    return S.expand_col_widths(R.sheet(spark, sf, R.SPANS)).select("file_id", "col", "width")


@query(
    "blank_sheet_reject",
    f"""SELECT file_id, sheet_ord, count(*) AS cells FROM (SELECT file_id, sheet_ord, CASE WHEN file_id % 9 = 0 THEN '  ' ELSE v END AS v FROM ({CELLS}))
    GROUP BY file_id, sheet_ord HAVING bool_and(coalesce(trim(v), '') = '')""",
)
def blank_sheet_reject(spark, sf):
    # Every ninth file has nothing but spaces in its cells.
    cells = R.sheet(spark, sf, R.CELLS).withColumn("v", F.when(F.col("file_id") % 9 == 0, "  ").otherwise(F.col("v")))
    return S.blank_sheets(cells, "v").select("file_id", "sheet_ord", "cells")


# ---- merges -------------------------------------------------------------------------------------

MERGES = D(R.MERGES)
_COVERED = f"""SELECT c.file_id, c.row, c.col, m.ord, m.row AS mr, m.col AS mc, m.rowspan, m.colspan FROM ({CELLS}) AS c JOIN ({MERGES}) AS m ON m.file_id = c.file_id
  AND c.row >= m.row AND c.row < m.row + m.rowspan AND c.col >= m.col AND c.col < m.col + m.colspan"""


@query(
    "merge_cover",
    f"SELECT file_id, row, col FROM ({CELLS}) AS c WHERE (file_id, row, col) NOT IN (SELECT (file_id, row, col) FROM ({_COVERED}) WHERE row <> mr OR col <> mc)",
)
def merge_cover(spark, sf):
    return S.merge_cover(R.sheet(spark, sf, R.CELLS), R.sheet(spark, sf, R.MERGES)).select("file_id", "row", "col")


@query(
    "vertical_merge_state",
    f"""SELECT c.file_id, c.row, c.col, CASE WHEN m.mr IS NULL THEN 'none' WHEN c.row > m.mr THEN 'continue' WHEN m.rowspan > 1 THEN 'restart' ELSE 'none' END AS v_merge,
      coalesce(m.colspan, 1) AS grid_span FROM ({CELLS}) AS c LEFT JOIN ({_COVERED}) AS m ON m.file_id = c.file_id AND m.row = c.row AND m.col = c.col
    WHERE m.mr IS NULL OR m.mc = c.col""",
)
def vertical_merge_state(spark, sf):
    out = S.merge_state(R.sheet(spark, sf, R.CELLS), R.sheet(spark, sf, R.MERGES))
    return out.select("file_id", "row", "col", "v_merge", "grid_span")


_HEIGHTS = f"SELECT file_id, row, least(72, greatest(12, height)) AS height FROM ({D(R.ROW_DIMS)})"


@query(
    "merge_span",
    f"""WITH m AS (SELECT m.file_id, m.row, m.col, greatest(1, least(s.cols - m.col, m.colspan)) AS colspan, greatest(1, least(s.rows - m.row, m.rowspan)) AS rowspan
      FROM ({MERGES}) AS m JOIN ({_SIZES}) AS s ON s.file_id = m.file_id WHERE m.row < s.rows AND m.col < s.cols),
    w AS (SELECT m.file_id, m.row, m.col, CAST(sum(coalesce(c.width, 80)) AS DOUBLE) AS w FROM (SELECT *, unnest(generate_series(col, col + colspan - 1)) AS a FROM m) AS m
      LEFT JOIN ({_COLS}) AS c ON c.file_id = m.file_id AND c.col = m.a GROUP BY 1, 2, 3),
    h AS (SELECT m.file_id, m.row, m.col, CAST(sum(coalesce(r.height, 22)) AS DOUBLE) AS h FROM (SELECT *, unnest(generate_series(row, row + rowspan - 1)) AS a FROM m) AS m
      LEFT JOIN ({D(R.ROW_DIMS)}) AS r ON r.file_id = m.file_id AND r.row = m.a GROUP BY 1, 2, 3)
    SELECT m.*, w.w AS merged_width, h.h AS merged_height FROM m JOIN w USING (file_id, row, col) JOIN h USING (file_id, row, col)""",
)
def merge_span(spark, sf):
    cells = R.sheet(spark, sf, R.CELLS)
    out = S.merge_span(
        R.sheet(spark, sf, R.MERGES),
        S.expand_col_widths(R.sheet(spark, sf, R.SPANS)),
        R.sheet(spark, sf, R.ROW_DIMS),
        S.sheet_sizes(cells),
    )
    return out.select("file_id", "row", "col", "colspan", "rowspan", "merged_width", "merged_height")


# ---- page plans: rows and columns repeated so that sheets need several pages ------------------------

REPEAT_ROWS, REPEAT_COLS = 12, 4
_BIG_SIZES = f"SELECT file_id, sheet_ord, (max(rown)) * {REPEAT_ROWS} AS rows, CAST(7 * {REPEAT_COLS} AS BIGINT) AS cols FROM ({R.SHEET_ROWS}) AS r GROUP BY file_id, sheet_ord"
_BIG_COLS = f"SELECT file_id, sheet_ord, (rown - 1) * {REPEAT_COLS} + sk % {REPEAT_COLS} AS col, least(80.0, greatest(3.0, q * 1.5)) AS width FROM ({R.SHEET_ROWS}) AS r"
_BIG_HEIGHTS = f"SELECT file_id, sheet_ord, (rown - 1) * {REPEAT_ROWS} + sk % {REPEAT_ROWS} AS row, CAST(q * 3 AS DOUBLE) AS height FROM ({R.SHEET_ROWS}) AS r"
_LAYOUT = f"""SELECT s.file_id, s.sheet_ord, s.rows, s.cols, w.widths, h.heights, list_sum(w.widths) > 531.28 AS landscape FROM ({D(_BIG_SIZES)}) AS s
  JOIN (SELECT s.file_id, list(least(28.0, greatest(3.0, coalesce(c.width, 12.0))) * 7 ORDER BY i) AS widths FROM (SELECT file_id, unnest(generate_series(0, cols - 1)) AS i FROM ({D(_BIG_SIZES)})) AS s
    LEFT JOIN ({D(_BIG_COLS)}) AS c ON c.file_id = s.file_id AND c.col = s.i GROUP BY s.file_id) AS w ON w.file_id = s.file_id
  JOIN (SELECT s.file_id, list(least(72.0, greatest(12.0, coalesce(c.height, 20.0))) ORDER BY i) AS heights FROM (SELECT file_id, unnest(generate_series(0, rows - 1)) AS i FROM ({D(_BIG_SIZES)})) AS s
    LEFT JOIN ({D(_BIG_HEIGHTS)}) AS c ON c.file_id = s.file_id AND c.row = s.i GROUP BY s.file_id) AS h ON h.file_id = s.file_id"""


def _duck_pack(sizes: str, room: str, header: str) -> str:
    return f"""SELECT file_id, sheet_ord, landscape, list_reduce(list_transform({sizes}, lambda v: {{'v': CAST(v AS DOUBLE), 'room': CAST({room} AS DOUBLE), 'head': CAST({header} AS DOUBLE)}}),
      lambda s, x: CASE WHEN len(s.p) = 0 THEN {{'p': [CAST(0 AS BIGINT)], 'used': x.v}} WHEN s.used + x.v > x.room THEN {{'p': list_append(s.p, s.p[-1] + 1), 'used': x.v + x.head}}
        ELSE {{'p': list_append(s.p, s.p[-1]), 'used': s.used + x.v}} END, {{'p': CAST([] AS BIGINT[]), 'used': CAST(0 AS DOUBLE)}}).p AS p FROM ({_LAYOUT})"""


def _duck_spans(pack: str, number: str, first: str, last: str) -> str:
    return f"""SELECT file_id, sheet_ord, landscape, page AS {number}, min(i) AS {first}, max(i) AS {last} FROM
      (SELECT file_id, sheet_ord, landscape, unnest(p) AS page, unnest(generate_series(0, len(p) - 1)) AS i FROM ({pack})) GROUP BY ALL"""


_WINDOWS = _duck_spans(_duck_pack("widths", "CASE WHEN landscape THEN 841.89 ELSE 595.28 END - 64", "0"), "window_no", "first_col", "last_col")
_ROW_PAGES = _duck_spans(_duck_pack("heights", "CASE WHEN landscape THEN 595.28 ELSE 841.89 END - 98", "heights[1]"), "page", "first_row", "last_row")
_TABLE_PAGES = _duck_spans(_duck_pack("heights", "CASE WHEN landscape THEN 595.28 ELSE 841.89 END - 96", "0"), "page", "first_row", "last_row")


def _layout(spark, sf):
    return S.sheet_layout(R.sheet(spark, sf, _BIG_SIZES), R.sheet(spark, sf, _BIG_COLS), R.sheet(spark, sf, _BIG_HEIGHTS))


@query("column_windows", f"SELECT file_id, window_no, first_col, last_col, landscape FROM ({_WINDOWS})")
def column_windows(spark, sf):
    out = S.column_windows(_layout(spark, sf))
    return out.select("file_id", F.col("window").cast("long").alias("window_no"), *_long("first_col", "last_col"), "landscape")


@query("row_pages", f"SELECT file_id, page, first_row, last_row FROM ({_ROW_PAGES})")
def row_pages(spark, sf):
    return S.row_pages(_layout(spark, sf)).select("file_id", *_long("page", "first_row", "last_row"))


@query("table_row_pages", f"SELECT file_id, page, first_row, last_row FROM ({_TABLE_PAGES})")
def table_row_pages(spark, sf):
    return S.table_row_pages(_layout(spark, sf)).select("file_id", *_long("page", "first_row", "last_row"))


_TALL = f"SELECT file_id, sheet_ord, rown AS ord, (rown - 1) * 9 AS row, sk % 5 AS col, 1 + pk % 16 AS rowspan, 1 + sk % 3 AS colspan FROM ({R.SHEET_ROWS}) AS r"


@query(
    "clip_merges",
    f"""SELECT m.file_id, m.ord, p.page, greatest(m.row, p.first_row) - p.first_row AS row, m.col, least(m.row + m.rowspan, p.last_row + 1) - greatest(m.row, p.first_row) AS rowspan, m.colspan
    FROM ({D(_TALL)}) AS m JOIN ({_TABLE_PAGES}) AS p ON p.file_id = m.file_id AND p.first_row < m.row + m.rowspan AND p.last_row >= m.row""",
)
def clip_merges(spark, sf):
    pages = S.table_row_pages(_layout(spark, sf))
    out = S.clip_merges(R.sheet(spark, sf, _TALL), pages)
    return out.select("file_id", "ord", F.col("page").cast("long").alias("page"), "row", "col", "rowspan", "colspan")


@query(
    "window_merges",
    f"""SELECT m.file_id, m.ord, p.page, w.window_no, CASE WHEN m.row = 0 THEN 0 ELSE m.row - p.first_row + CASE WHEN p.page > 0 THEN 1 ELSE 0 END END AS row,
      m.col - w.first_col AS col, m.rowspan, m.colspan FROM ({D(_TALL)}) AS m
    JOIN ({_ROW_PAGES}) AS p ON p.file_id = m.file_id AND ((p.first_row <= m.row AND p.last_row >= m.row) OR m.row = 0)
    JOIN ({_WINDOWS}) AS w ON w.file_id = m.file_id AND w.first_col <= m.col AND m.col + m.colspan - 1 <= w.last_col""",
)
def window_merges(spark, sf):
    out = S.window_merges(R.sheet(spark, sf, _TALL), _layout(spark, sf))
    return out.select(
        "file_id", "ord", F.col("page").cast("long").alias("page"), F.col("window").cast("long").alias("window_no"), "row", "col", "rowspan", "colspan"
    )


# ---- scenes and expectations ---------------------------------------------------------------------------

ITEMS = R.ITEMS_DUCK


@query(
    "z_order",
    f"""SELECT doc, scene, ord, row_number() OVER (PARTITION BY doc, scene ORDER BY z, CASE WHEN item_kind IN ('shape','image') THEN 0 WHEN item_kind = 'table' THEN 1 ELSE 2 END, ord)
      AS draw_no FROM ({ITEMS})""",
)
def z_order(spark, sf):
    return S.z_order(R.sheet(spark, sf, R.ITEMS)).select("doc", "scene", "ord", "draw_no")


_SUMMARY = f"""SELECT doc, count(DISTINCT scene) AS scenes, count(*) FILTER (item_kind = 'text') AS text_blocks, count(*) FILTER (item_kind = 'table') AS tables,
    count(*) FILTER (item_kind = 'shape') AS shapes, count(*) FILTER (item_kind = 'chart') AS charts, count(*) FILTER (item_kind = 'image') AS images,
    count(*) FILTER (item_kind = 'note') AS notes, coalesce(list_sort(list(table_rows) FILTER (item_kind = 'table')), CAST([] AS BIGINT[])) AS sizes,
    array_to_string(list_concat(list_concat(coalesce((list(text ORDER BY ord) FILTER (item_kind = 'text' AND text <> ''))[1:6], []),
      coalesce((list(text ORDER BY ord) FILTER (item_kind = 'cell' AND text <> ''))[1:12], [])), coalesce((list(text ORDER BY ord) FILTER (item_kind = 'note'))[1:6], [])), chr(10)) AS text_corpus,
    array_to_string(coalesce((list(text ORDER BY ord) FILTER (item_kind = 'note'))[1:6], []), chr(10)) AS note_text FROM ({ITEMS}) GROUP BY doc"""


@query(
    "doc_summary",
    f"""SELECT doc, scenes, text_blocks, tables, notes, note_text, array_to_string(sizes, ',') AS table_rows, array_to_string(list_sort(list_distinct(sizes)), ',') AS table_row_counts, array_to_string(list_filter(
      [CASE WHEN images > 0 THEN 'image:' || images END, CASE WHEN shapes > 0 THEN 'shape:' || shapes END], lambda x: x IS NOT NULL), ',') AS object_kinds, text_corpus
    FROM ({_SUMMARY})""",
)
def doc_summary(spark, sf):
    out = Q.doc_summary(R.sheet(spark, sf, R.ITEMS))
    kinds = F.transform(F.map_entries("object_kinds"), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string")))
    return out.select(
        "doc", "scenes", "text_blocks", "tables", "notes", "note_text",
        F.array_join(F.flatten(F.transform(F.map_entries("table_rows"), lambda e: F.array_repeat(e["key"].cast("string"), e["value"].cast("int")))), ",").alias("table_rows"),
        F.coalesce(F.array_join(F.transform("table_row_counts", lambda r: r.cast("string")), ","), F.lit("")).alias("table_row_counts"),
        F.coalesce(F.array_join(kinds, ","), F.lit("")).alias("object_kinds"),
        "text_corpus",
    )


_FAILURES = f"""SELECT e.doc, array_to_string(list_filter([CASE WHEN s.scenes <> e.scenes THEN 'scenes' END, CASE WHEN s.scenes < e.min_scenes THEN 'min_scenes' END,
    CASE WHEN s.text_blocks < e.min_text_blocks THEN 'min_text_blocks' END, CASE WHEN s.tables <> e.tables THEN 'tables' END, CASE WHEN s.tables < e.min_tables THEN 'min_tables' END,
    CASE WHEN NOT list_contains(s.sizes, e.table_rows) THEN 'table_rows' END, CASE WHEN s.shapes <> e.shapes THEN 'shapes' END, CASE WHEN e.charts <> s.charts THEN 'charts' END,
    CASE WHEN s.images <> e.images THEN 'images' END, CASE WHEN s.notes < e.notes THEN 'notes' END, CASE WHEN NOT contains(s.text_corpus, e.text) THEN 'text' END,
    CASE WHEN NOT contains(s.note_text, e.note_text) THEN 'note_text' END, CASE WHEN NOT contains(s.text_corpus, e.cached_value) THEN 'cached_value' END], lambda x: x IS NOT NULL), ',') AS failures
  FROM ({D(R.EXPECTATIONS)}) AS e JOIN ({_SUMMARY}) AS s ON s.doc = e.doc"""


@query("expectation_check", _FAILURES)
def expectation_check(spark, sf):
    out = Q.expectation_check(Q.doc_summary(R.sheet(spark, sf, R.ITEMS)), R.sheet(spark, sf, R.EXPECTATIONS))
    return out.select("doc", F.array_join("failures", ",").alias("failures"))


@query(
    "corpus_scorecard",
    f"""SELECT count(*) FILTER (ok) AS passed, count(*) FILTER (NOT ok) AS failed, count(*) FILTER (ok AND failures = '') AS structural_passed,
      count(*) FILTER (ok AND failures <> '') AS structural_failed FROM (SELECT *, doc % 13 <> 0 AS ok FROM ({_FAILURES}))""",
)
def corpus_scorecard(spark, sf):
    checked = Q.expectation_check(Q.doc_summary(R.sheet(spark, sf, R.ITEMS)), R.sheet(spark, sf, R.EXPECTATIONS))
    return Q.corpus_scorecard(checked.select((F.col("doc") % 13 != 0).alias("ok"), (F.size("failures") == 0).alias("structural_ok")))


@query(
    "scene_limits",
    f"""SELECT doc, scenes, CASE WHEN scenes > 2 THEN 'too-many-scenes' END AS problem FROM (SELECT doc, count(DISTINCT scene) AS scenes FROM ({ITEMS}) GROUP BY doc) WHERE scenes > 2""",
)
def scene_limits(spark, sf):
    return Q.scene_limits(R.sheet(spark, sf, R.ITEMS), most=2)
