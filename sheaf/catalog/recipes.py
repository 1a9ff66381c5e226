"""How the given tables become files, blobs, pages, cells, text items, …

Each recipe is one SQL text per dialect, built from the same template where the
dialects agree, so Spark and the oracle start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .registry import SPREAD_KEYS, table, wide_table


def run(spark: SparkSession, sf_dir: str, sql: str, *tables: str, wide: bool = False) -> DataFrame:
    """Run recipe SQL with ``<name>`` standing for a table; ``wide``: rows fan out."""
    sql = sql.replace("{", "{{").replace("}", "}}")
    for name in tables:
        sql = sql.replace(f"<{name}>", "{" + name + "}")
    read = {name: wide_table if wide and name in SPREAD_KEYS else table for name in tables}
    return spark.sql(sql, **{name: read[name](spark, sf_dir, name) for name in tables})


def duck(sql: str) -> str:
    """The same recipe for the oracle, whose views carry the table names."""
    for name in ("documents", "lineitem", "orders", "events", "pages", "embeddings", "part", "supplier"):
        sql = sql.replace(f"<{name}>", name)
    return sql


# ---- D1: a file table from documents ------------------------------------------

_NAME = """CASE doc_id % 4
    WHEN 0 THEN 'in/' || source || '/Report ' || CAST(doc_id AS STRING)
    WHEN 1 THEN 'C:' || chr(92) || 'drop' || chr(92) || '..Draft #' || CAST(doc_id AS STRING) || ' (v2)--'
    WHEN 2 THEN 'résumé & plan_' || CAST(doc_id AS STRING) || ' - '
    ELSE '  [x] ' || CAST(doc_id AS STRING) || '.final' END
  || CASE doc_id % 11 WHEN 0 THEN '.pdf' WHEN 1 THEN '.jpg' WHEN 2 THEN '.PNG' WHEN 3 THEN '.docx' WHEN 4 THEN '.md'
    WHEN 5 THEN '.pptx' WHEN 6 THEN '.xlsx' WHEN 7 THEN '.pages' WHEN 8 THEN '' WHEN 9 THEN '.tar.gz' ELSE '.jpeg' END"""
_MIME = """CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'application/pdf' WHEN 2 THEN 'image/jpeg'
    WHEN 3 THEN 'text/markdown' ELSE 'application/octet-stream' END"""

FILES = f"""SELECT doc_id AS file_id, source AS batch_id, doc_id AS pos, {_NAME} AS name, {_MIME} AS mime,
  CASE WHEN doc_id % 13 = 0 THEN CAST(0 AS BIGINT) WHEN doc_id % 37 = 0 THEN n_chars * 1000000 ELSE n_chars * 4096 END AS size,
  text FROM <documents>"""
FILES_DUCK = duck(FILES)


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, FILES, "documents")


# ---- D2: binary snapshots ------------------------------------------------------


def _blobs(encode: str) -> str:
    big = "lpad(hex((doc_id % 3) * 300 + 256 * (doc_id % 2)), 8, '0')"
    return f"""SELECT *, CASE WHEN empty_file THEN CAST(0 AS BIGINT) WHEN file_id % 31 = 0 THEN CAST(209715200 AS BIGINT)
    ELSE CAST(octet_length(content) AS BIGINT) END AS size FROM (
  SELECT doc_id AS file_id, source AS batch_id, doc_id AS pos, {_NAME} AS name, {_MIME} AS mime, doc_id % 29 = 0 AS empty_file,
    unhex(CASE doc_id % 6 WHEN 0 THEN '255044462D312E37' WHEN 1 THEN 'FFD8FFE0'
      WHEN 2 THEN '89504E470D0A1A0A0000000D49484452' || {big} || {big} || '0806000000AABBCCDD'
      WHEN 3 THEN '' WHEN 4 THEN '504B0304' ELSE 'C3' END)
    || {encode}
    || unhex(CASE doc_id % 5 WHEN 0 THEN '2525454F46' WHEN 1 THEN 'FFD9' WHEN 2 THEN '49454E44AE426082' ELSE '' END) AS content
  FROM <documents>) AS b"""


BLOBS = _blobs("encode(text, 'UTF-8')")
BLOBS_DUCK = duck(_blobs("encode(text)"))


def blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, BLOBS, "documents")


# ---- D3: page range requests ----------------------------------------------------

RANGES = """SELECT request_id, page_count,
  CASE request_id % 14
    WHEN 0 THEN '   '
    WHEN 1 THEN '1-' || lo || ',' || hi
    WHEN 2 THEN ' ' || hi || ' , 1-' || lo || ', ' || lo || ' '
    WHEN 3 THEN lo || '-'
    WHEN 4 THEN hi || '-' || lo
    WHEN 5 THEN '1-' || hi || ',' || CAST(page_count + 3 AS STRING)
    WHEN 6 THEN '1,,2'
    WHEN 7 THEN lo || ', abc'
    WHEN 8 THEN '0-' || hi
    WHEN 9 THEN '1--2'
    WHEN 10 THEN '1 - ' || hi
    WHEN 11 THEN lo || '-0'
    WHEN 12 THEN lo
    ELSE '1-' || hi || ',5-2,x' END AS spec
  FROM (SELECT l_orderkey AS request_id, count(*) AS page_count, CAST(min(l_linenumber) AS STRING) AS lo,
    CAST(least(count(*), max(l_linenumber)) AS STRING) AS hi
  FROM <lineitem> GROUP BY l_orderkey) AS r"""
RANGES_DUCK = duck(RANGES)


def range_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, RANGES, "lineitem")


# ---- D4: a page table -------------------------------------------------------------

# The lines of an order, numbered by all their columns: line numbers repeat.
NUMBERED = """SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice,
  l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS BIGINT) AS n FROM <lineitem>"""
PAGE_TABLE = f"""SELECT l_orderkey AS doc, n AS page, l_orderkey % 50 AS batch_id, l_returnflag = 'R' AS selected, 90 * (l_suppkey % 4) AS rotation,
  CAST(l_quantity * 20 AS DOUBLE) AS width, CAST((51 - l_quantity) * 20 AS DOUBLE) AS height FROM ({NUMBERED}) AS numbered"""
PAGE_TABLE_DUCK = duck(PAGE_TABLE)


def page_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, PAGE_TABLE, "lineitem")


# ---- D11: error messages -----------------------------------------------------------

MESSAGES = """SELECT event_id AS id,
  CASE WHEN user_id % 23 = 0 THEN 'read' WHEN user_id % 19 = 0 THEN 'archive' ELSE 'error' END AS error_class,
  CASE WHEN user_id % 2 = 0 THEN 'ARCHIVE_UNSAFE_PATH' WHEN user_id % 3 = 0 THEN 'ARCHIVE_DUPLICATE_PATH'
    ELSE 'ARCHIVE_MALFORMED' END AS archive_code,
  CASE user_id % 14
    WHEN 0 THEN 'Broken page tree after ' || event_type
    WHEN 1 THEN 'These bytes are no text: ' || event_type
    WHEN 2 THEN 'Too many pixels (' || CAST(value AS STRING) || ')'
    WHEN 3 THEN 'picture.png: header cut short'
    WHEN 4 THEN 'The word part of the package is missing'
    WHEN 5 THEN 'Nothing to do in ' || event_type
    WHEN 6 THEN 'This session has no drawing surface'
    WHEN 7 THEN 'Too few files'
    WHEN 8 THEN 'TOO MANY pages'
    WHEN 9 THEN 'The stream ended early'
    WHEN 10 THEN 'Toomany is one word'
    WHEN 11 THEN 'A page tree of pixels'
    WHEN 12 THEN 'There is nothing here'
    ELSE event_type END AS message
  FROM <events>"""
MESSAGES_DUCK = duck(MESSAGES)


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, MESSAGES, "events")


# ---- D12: raw pages with active content mixed in -------------------------------------

_BAD_HTML = """CASE page_id % 7
    WHEN 0 THEN '<a href="javascript:alert(1)" onclick="x()">go</a>'
    WHEN 1 THEN '<img src=x onerror=''boom()''/><iframe src="//e.example"></iframe>'
    WHEN 2 THEN '<form action=''vbscript:run''><input type=text></form>'
    WHEN 3 THEN '<a href= data:text/html,hi>d</a><STYLE>b{}</STYLE >'
    WHEN 4 THEN '<p title="keep" HREF="  JavaScript:void(0)">safe</p>'
    WHEN 5 THEN '<a href="https://ok.example/?q=javascript:1">ok</a><base href="/">'
    ELSE '' END"""
HTML_PAGES = f"SELECT page_id, url, html || {_BAD_HTML} AS html FROM <pages>"
HTML_PAGES_DUCK = duck(HTML_PAGES)


def html_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, HTML_PAGES, "pages", wide=True)


# ---- requests ---------------------------------------------------------------------------

REQUESTS = """SELECT doc_id AS request_id,
  CASE doc_id % 9 WHEN 0 THEN 'docx' WHEN 1 THEN 'PAGES' WHEN 2 THEN 'key' WHEN 3 THEN 'numbers' WHEN 4 THEN 'pptx'
    WHEN 5 THEN 'xls' WHEN 6 THEN 'png' WHEN 7 THEN 'ppt' ELSE 'doc' END AS from_fmt,
  CASE WHEN doc_id % 5 = 4 THEN 'docx' WHEN doc_id % 53 = 0 THEN '' ELSE 'pdf' END AS to_fmt,
  'up/File ' || CAST(doc_id AS STRING) || CASE doc_id % 7 WHEN 0 THEN '' WHEN 1 THEN '.txt'
    ELSE '.' || CASE doc_id % 9 WHEN 0 THEN 'docx' WHEN 1 THEN 'pages' WHEN 2 THEN 'key' WHEN 3 THEN 'numbers' WHEN 4 THEN 'pptx'
    WHEN 5 THEN 'xls' WHEN 6 THEN 'png' WHEN 7 THEN 'ppt' ELSE 'doc' END END AS filename,
  CASE WHEN doc_id % 11 = 0 THEN CAST(0 AS BIGINT) WHEN doc_id % 17 = 0 THEN CAST(140000001 AS BIGINT) ELSE n_chars END AS content_len,
  doc_id % 4 <> 0 AS is_mac, doc_id % 6 <> 0 AS connected, doc_id % 2 = 0 AS browser_ok, doc_id % 3 <> 0 AS fallback_ok,
  CASE doc_id % 5 WHEN 0 THEN 'pages,keynote,numbers' WHEN 1 THEN 'word,excel' WHEN 2 THEN 'libreoffice' WHEN 3 THEN 'powerpoint'
    ELSE '' END AS engine_list
  FROM <documents>"""
REQUESTS_DUCK = duck(REQUESTS)


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, REQUESTS, "documents")

# ---- D6: Markdown from documents --------------------------------------------------------


def _markdown_prefix(line: str, k: str) -> str:
    return f"""CASE {k} WHEN 0 THEN '# ' || {line} WHEN 1 THEN '- ' || {line} WHEN 2 THEN '1. ' || {line} WHEN 3 THEN '> ' || {line}
    WHEN 4 THEN '---' WHEN 5 THEN '[ref](https://e.example/x) ' || {line} WHEN 6 THEN {line} WHEN 7 THEN '' WHEN 8 THEN '| head | b |'
    WHEN 9 THEN '| --- | :---: |' WHEN 10 THEN '| c' || chr(92) || '|d | `x|y` | ' || {line} WHEN 11 THEN '```py' WHEN 12 THEN {line}
    WHEN 13 THEN '```' WHEN 14 THEN '   - ' || {line} WHEN 15 THEN '## ' || {line} || ' ##' WHEN 16 THEN '![i](http://e.example/a.png) ' || {line}
    WHEN 17 THEN '~~~' WHEN 18 THEN '2) ' || {line} WHEN 19 THEN '* * *' WHEN 20 THEN '  ' || {line} || '  ' ELSE '[bad](javascript:x) ' || {line} END"""


MARKDOWN_DOCS = (
    "SELECT doc_id AS doc, array_join(transform(split(text, '\\n', -1), (l, i) -> "
    + _markdown_prefix("l", "(i * (1 + doc_id % 3) + doc_id) % 22")
    + "), chr(10)) AS text FROM <documents>"
)
MARKDOWN_DOCS_DUCK = (
    "SELECT doc_id AS doc, array_to_string(list_transform(string_split(text, chr(10)), lambda l, i: "
    + _markdown_prefix("l", "((i - 1) * (1 + doc_id % 3) + doc_id) % 22")
    + "), chr(10)) AS text FROM documents"
)


def markdown_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, MARKDOWN_DOCS, "documents", wide=True)


# ---- D5: positioned text items and link annotations -----------------------------------------

_ITEM_STR = """CASE WHEN (word + line) % 17 = 9 THEN ' ' ELSE
  CASE WHEN word = 0 AND line % 9 = 4 THEN '• ' WHEN word = 0 AND line % 9 = 5 THEN '3) ' WHEN (word + doc) % 29 = 7 THEN ', ' ELSE '' END
  || s || CASE WHEN (word + doc) % 29 = 11 THEN '(' ELSE '' END END"""
_LINE_Y = "CAST(800 - 20 * (line % 30) - 15 * floor((line % 30) / 6) AS DOUBLE)"
_ITEMS = f"""SELECT doc, page, line, CAST(line AS BIGINT) * 100000 + word AS ord, str, CAST(40 * word AS DOUBLE) AS x, {_LINE_Y} AS y,
  CAST(least(39, 5 * length(str)) AS DOUBLE) AS width, CAST(CASE WHEN line = 0 AND doc % 2 = 0 THEN 20 WHEN line % 13 = 7 THEN 18 ELSE 12 END AS DOUBLE) AS font_size
  FROM (SELECT doc, CAST(floor(line / 30) AS BIGINT) + 1 AS page, line, word, {_ITEM_STR} AS str FROM (<<words>>) AS w) AS i"""
TEXT_ITEMS = _ITEMS.replace(
    "<<words>>",
    """SELECT doc, line, posexplode_outer(split(t, ' ', -1)) AS (word, s) FROM
    (SELECT doc_id AS doc, posexplode_outer(split(text, '\n', -1)) AS (line, t) FROM <documents>)""",
)
TEXT_ITEMS_DUCK = _ITEMS.replace(
    "<<words>>",
    """SELECT doc, line, unnest(generate_series(0, len(string_split(t, ' ')) - 1)) AS word, unnest(string_split(t, ' ')) AS s FROM
    (SELECT doc_id AS doc, unnest(generate_series(0, len(string_split(text, chr(10))) - 1)) AS line, unnest(string_split(text, chr(10))) AS t FROM documents)""",
)
_NOTES = f"""SELECT doc, CAST(floor(line / 30) AS BIGINT) + 1 AS page, CAST(line AS BIGINT) * 10 + k AS ord, {_LINE_Y} - 2 AS y1, {_LINE_Y} + 2 AS y2,
  CASE (doc + k) % 5 WHEN 0 THEN 'https://e.example/' || CAST(doc AS STRING) WHEN 1 THEN 'mailto:a@e.example' WHEN 2 THEN 'javascript:x'
    WHEN 3 THEN ' http://e.example/x ' ELSE 'https://e.example/' || CAST(doc AS STRING) END AS url
  FROM (<<lines>>) AS l WHERE line % 3 = 0"""
NOTES = _NOTES.replace(
    "<<lines>>",
    """SELECT doc, line, k FROM (SELECT doc_id AS doc, posexplode_outer(split(text, '\n', -1)) AS (line, t) FROM <documents>)
    LATERAL VIEW explode(array(0, 1, 4)) v AS k""",
)
NOTES_DUCK = _NOTES.replace(
    "<<lines>>",
    """SELECT doc, line, unnest([0, 1, 4]) AS k FROM
    (SELECT doc_id AS doc, unnest(generate_series(0, len(string_split(text, chr(10))) - 1)) AS line FROM documents)""",
)


def text_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, TEXT_ITEMS, "documents", wide=True)


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, NOTES, "documents", wide=True)

# ---- D7: workbooks from lineitem: one sheet per order, one row per line ------------------

SHEET_ROWS = f"""SELECT l_orderkey AS file_id, CAST(0 AS BIGINT) AS sheet_ord, n AS rown, l_suppkey AS sk, l_partkey AS pk,
  CAST(l_quantity AS BIGINT) AS q, CAST(floor(l_extendedprice) AS BIGINT) AS price, l_returnflag AS flag, l_linestatus AS stat FROM ({NUMBERED}) AS numbered"""
SHEET_ROWS_DUCK = duck(SHEET_ROWS)

# col, type, value, formula, style
_CELL_COLUMNS = [
    ("'s'", "CAST(sk % 9 AS STRING)", "NULL", "sk % 7"),
    ("NULL", "CAST(q AS STRING)", "NULL", "sk % 4"),
    ("NULL", "CASE WHEN sk % 6 = 0 THEN '' ELSE CAST(price AS STRING) END", "NULL", "rown % 7"),
    ("'b'", "CASE WHEN stat = 'F' THEN '1' ELSE '0' END", "NULL", "0"),
    ("NULL", "CAST(36000 + pk AS STRING)", "NULL", "pk % 7"),
    ("NULL", "CAST(price AS STRING)", "CASE WHEN sk % 50 = 0 THEN '[1]Other!A1' ELSE 'SUM(B1:B' || CAST(rown AS STRING) || ')' END", "1"),
    ("CASE WHEN sk % 9 = 0 THEN 's' ELSE 'inlineStr' END", "CASE WHEN sk % 9 = 0 THEN 'x' WHEN sk % 8 = 1 THEN '' ELSE flag || ' note' END", "NULL", "2"),
]


def _cells(rows: str, dialect: str) -> str:
    def text(expr: str) -> str:
        return f"CAST({expr} AS STRING)"

    if dialect == "spark":
        structs = ", ".join(
            f"named_struct('col', CAST({i} AS BIGINT), 't', {text(t)}, 'v', {text(v)}, 'f', {text(f)}, 'style_idx', CAST({s} AS BIGINT))"
            for i, (t, v, f, s) in enumerate(_CELL_COLUMNS)
        )
        return f"""SELECT file_id, sheet_ord, rown - 1 AS row, col, chr(65 + col) || CAST(rown AS STRING) AS ref, t, v, f, style_idx
        FROM ({rows}) LATERAL VIEW inline(array({structs})) c AS col, t, v, f, style_idx"""
    structs = ", ".join(
        f"{{'col': CAST({i} AS BIGINT), 't': {text(t)}, 'v': {text(v)}, 'f': {text(f)}, 'style_idx': CAST({s} AS BIGINT)}}"
        for i, (t, v, f, s) in enumerate(_CELL_COLUMNS)
    )
    return f"""SELECT file_id, sheet_ord, rown - 1 AS row, c.col AS col, chr(CAST(65 + c.col AS INT)) || rown AS ref, c.t AS t, c.v AS v, c.f AS f, c.style_idx AS style_idx
      FROM (SELECT file_id, sheet_ord, rown, unnest([{structs}]) AS c FROM ({rows}))"""


CELLS = _cells(SHEET_ROWS, "spark")
CELLS_DUCK = _cells(SHEET_ROWS_DUCK, "duck")
STRINGS = f"SELECT file_id, rown - 1 AS idx, 'text ' || CAST(pk AS STRING) AS text FROM ({SHEET_ROWS}) AS r"
STYLES = f"""SELECT file_id, rown - 1 AS idx, sk % 3 AS font_id, pk % 3 AS fill_id, CASE sk % 5 WHEN 0 THEN 14 WHEN 1 THEN 165 WHEN 2 THEN 20 WHEN 3 THEN 166 ELSE 0 END AS num_fmt_id,
  CASE pk % 4 WHEN 0 THEN 'center' WHEN 1 THEN 'right' WHEN 2 THEN 'justify' ELSE NULL END AS align FROM ({SHEET_ROWS}) AS r"""
FONTS = f"SELECT file_id, rown - 1 AS idx, sk % 2 = 0 AS bold, pk % 2 = 0 AS italic, pk % 3 = 0 AS underline, '#0000' || lpad(CAST(q AS STRING), 2, '0') AS color FROM ({SHEET_ROWS}) AS r"
FILLS = f"SELECT file_id, rown - 1 AS idx, '#' || lpad(CAST(price % 1000000 AS STRING), 6, '0') AS fill FROM ({SHEET_ROWS}) AS r"
NUM_FMTS = f"""SELECT file_id, CAST(164 + rown AS BIGINT) AS num_fmt_id, CASE rown WHEN 1 THEN 'yyyy-mm-dd' WHEN 2 THEN '[Red]0.00"day"' ELSE 'dd/mm' END AS code FROM ({SHEET_ROWS}) AS r"""
MERGES = f"""SELECT file_id, sheet_ord, rown AS ord, rown - 1 AS row, sk % 4 AS col, 1 + pk % 2 AS rowspan, 1 + sk % 3 AS colspan
  FROM ({SHEET_ROWS}) AS r WHERE rown % 2 = 0"""
SPANS = f"SELECT file_id, sheet_ord, rown AS ord, rown AS min_col, rown + sk % 4 AS max_col, q * 2.0 AS width FROM ({SHEET_ROWS}) AS r"
ROW_DIMS = f"SELECT file_id, sheet_ord, rown - 1 AS row, CAST(CASE WHEN sk % 10 = 0 THEN NULL ELSE q * 6 END AS DOUBLE) AS height FROM ({SHEET_ROWS}) AS r"
ITEMS = f"""SELECT file_id AS doc, 1 + rown % 3 AS scene, rown * 10 + k AS ord, CASE (sk + k) % 8 WHEN 0 THEN 'text' WHEN 1 THEN 'table' WHEN 2 THEN 'shape' WHEN 3 THEN 'image' WHEN 5 THEN 'note' WHEN 6 THEN 'cell' WHEN 7 THEN 'table' ELSE 'text' END AS item_kind,
  (pk + k) % 4 AS z, CASE WHEN (sk + k) % 8 IN (0, 4, 5, 6) THEN flag || ' words ' || CAST(pk % 50 AS STRING) ELSE '' END AS text, q + k AS table_rows
  FROM (<<two>>) AS r"""
_TWO = f"SELECT *, 0 AS k FROM ({SHEET_ROWS}) AS r UNION ALL SELECT *, 1 AS k FROM ({SHEET_ROWS}) AS r"
ITEMS_DUCK = duck(ITEMS.replace("<<two>>", _TWO))
ITEMS = ITEMS.replace("<<two>>", f"SELECT r.*, k FROM ({SHEET_ROWS}) AS r LATERAL VIEW explode(array(0, 1)) v AS k")
EXPECTATIONS = f"""SELECT file_id AS doc, CASE WHEN file_id % 3 = 0 THEN count(*) ELSE NULL END AS scenes, CASE WHEN file_id % 3 = 1 THEN CAST(3 AS BIGINT) ELSE NULL END AS min_scenes,
  CAST(2 AS BIGINT) AS min_text_blocks, CASE WHEN file_id % 2 = 0 THEN min(sk) % 4 ELSE NULL END AS tables, CASE WHEN file_id % 5 = 0 THEN min(q) ELSE NULL END AS table_rows,
  CASE WHEN file_id % 4 = 0 THEN min(pk) % 3 ELSE NULL END AS shapes, CASE WHEN file_id % 7 = 0 THEN CAST(file_id % 2 AS BIGINT) ELSE NULL END AS charts,
  CASE WHEN file_id % 6 = 1 THEN CAST(1 AS BIGINT) ELSE NULL END AS min_tables, CASE WHEN file_id % 13 = 0 THEN CAST(1 AS BIGINT) ELSE NULL END AS notes,
  CASE WHEN file_id % 8 = 2 THEN 'N words' ELSE NULL END AS note_text, CASE WHEN file_id % 9 = 4 THEN 'words 7' ELSE NULL END AS cached_value,
  CASE WHEN file_id % 4 = 1 THEN min(sk) % 3 ELSE NULL END AS images, CASE WHEN file_id % 11 = 0 THEN 'A words' WHEN file_id % 11 = 1 THEN 'zzz' ELSE NULL END AS text
  FROM ({SHEET_ROWS}) AS r GROUP BY file_id"""


def sheet(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return run(spark, sf_dir, sql, "lineitem")
