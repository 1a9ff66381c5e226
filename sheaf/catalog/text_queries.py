"""Queries over HTML and Markdown text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import text as X
from ..operators import markdown as M
from . import recipes as R
from .registry import query, table

# ---- HTML ---------------------------------------------------------------------------

_BAD_URL = "(?:\"\\s*(?:javascript:|data:text/html|vbscript:)[^\"]*\"|''\\s*(?:javascript:|data:text/html|vbscript:)[^'']*''|(?:javascript:|data:text/html|vbscript:)[^\\s>]*)"
_D_SCRIPT = "regexp_replace(html, '<script[\\s\\S]*?</script\\s*>', '', 'gi')"
_D_STYLE = f"regexp_replace({_D_SCRIPT}, '<style[\\s\\S]*?</style\\s*>', '', 'gi')"
_TAGS = "</?(iframe|frame|frameset|object|embed|form|input|button|select|textarea|meta|link|base)\\b[^>]*>"
_D_TAGS = f"regexp_replace({_D_STYLE}, '{_TAGS}', '', 'gi')"
_HANDLERS = "\\s+on[a-z]+\\s*=\\s*(\"[^\"]*\"|''[^'']*''|[^\\s>]+)"
_D_HANDLERS = f"regexp_replace({_D_TAGS}, '{_HANDLERS}', '', 'gi')"
_D_URLS = f"regexp_replace({_D_HANDLERS}, '\\s(href|src|xlink:href|action)\\s*=\\s*{_BAD_URL}', ' \\1=\"#\"', 'gi')"


@query("html_sanitize", f"SELECT page_id, {_D_URLS} AS clean FROM ({R.HTML_PAGES_DUCK})")
def html_sanitize(spark, sf):
    return R.html_pages(spark, sf).select("page_id", H.sanitize(F.col("html")).alias("clean"))


def _count(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text}, '(?i){pattern}'))"


@query(
    "html_sanitize_audit",
    f"""SELECT host, count(*) AS pages, CAST(sum(a) AS BIGINT) AS scripts, CAST(sum(b) AS BIGINT) AS styles, CAST(sum(c) AS BIGINT) AS active_tags,
      CAST(sum(d) AS BIGINT) AS handlers, CAST(sum(e) AS BIGINT) AS bad_urls
    FROM (SELECT regexp_extract(url, '://([^/?#]+)', 1) AS host, {_count('html', '<script[\\s\\S]*?</script\\s*>')} AS a,
      {_count(_D_SCRIPT, '<style[\\s\\S]*?</style\\s*>')} AS b, {_count(_D_STYLE, _TAGS)} AS c, {_count(_D_TAGS, _HANDLERS)} AS d,
      {_count(_D_HANDLERS, f'\\s(href|src|xlink:href|action)\\s*=\\s*{_BAD_URL}')} AS e FROM ({R.HTML_PAGES_DUCK})) GROUP BY host""",
)
def html_sanitize_audit(spark, sf):
    counts = H.removal_counts(F.col("html"))
    pages = R.html_pages(spark, sf).select(
        F.regexp_extract("url", "://([^/?#]+)", 1).alias("host"), *[c.alias(n) for n, c in counts.items()]
    )
    return pages.groupBy("host").agg(F.count(F.lit(1)).alias("pages"), *[F.sum(n).alias(n) for n in counts])


@query(
    "escape_html",
    """SELECT page_id, length(h) AS html_len, md5(h) AS html_md5, md5(replace(h, '`', '&#96;')) AS attribute_md5, md5(replace(h, '&#39;', '&apos;')) AS xml_md5
    FROM (SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS h
      FROM (SELECT page_id, html || '`it''s`' AS html FROM pages))""",
)
def escape_html(spark, sf):
    html = F.concat("html", F.lit("`it's`"))
    return table(spark, sf, "pages").select(
        "page_id",
        F.length(X.escape_html(html)).cast("long").alias("html_len"),
        F.md5(F.encode(X.escape_html(html), "UTF-8")).alias("html_md5"),
        F.md5(F.encode(X.escape_attribute(html), "UTF-8")).alias("attribute_md5"),
        F.md5(F.encode(X.escape_xml(html), "UTF-8")).alias("xml_md5"),
    )


_ENTITY_TEXT = """SELECT page_id, replace(replace(html, '&copy;', '&#169;'), '&middot;', '&#xB7;') ||
  CASE page_id % 8 WHEN 0 THEN '&bogus;' WHEN 1 THEN '&#xD800;' WHEN 2 THEN '&#1114112;' WHEN 3 THEN '&#x1F600;&amp;&LT;b&gt;'
  WHEN 4 THEN 'a & b' WHEN 5 THEN '&amp;lt;' WHEN 6 THEN '&quot;&apos;&#65;' ELSE '' END AS text FROM <pages>"""
_D_DECODED = """replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(text, '&#169;', '©'), '&#xB7;', '·'), '&#x1F600;', '😀'),
  '&#65;', 'A'), '&LT;', '<'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', ''''), '&amp;', '&')"""


@query(
    "decode_entities",
    f"""SELECT page_id, CASE WHEN error IS NULL THEN {_D_DECODED} END AS decoded, error FROM (SELECT page_id, text, CASE
      WHEN contains(regexp_replace(text, '&(#x[0-9a-f]+|#\\d+|amp|lt|gt|quot|apos);', ' ', 'gi'), '&') THEN 'undeclared-entity'
      WHEN contains(text, '&#xD800;') OR contains(text, '&#1114112;') THEN 'bad-character-reference'
      WHEN regexp_matches({_D_DECODED}, '&[^;\\s]{{1,80}};') THEN 'undeclared-entity' END AS error FROM ({R.duck(_ENTITY_TEXT)}))""",
)
def decode_entities(spark, sf):
    decoded, error = H.decode_entities(F.col("text"))
    return R.run(spark, sf, _ENTITY_TEXT, "pages").select("page_id", decoded.alias("decoded"), error.alias("error"))


# ---- Markdown lines ---------------------------------------------------------------------

_CRLF = "SELECT doc, {bom} || replace(text, chr(10), CASE doc % 3 WHEN 0 THEN chr(10) WHEN 1 THEN chr(13) || chr(10) ELSE chr(13) END) AS text FROM ({docs})"
_LINES_DUCK = f"""SELECT doc, i - 1 AS line, lines[i] AS text, lines[i + 1] AS following FROM (SELECT doc, lines, unnest(generate_series(1, len(lines))) AS i
  FROM (SELECT doc, string_split(text, chr(10)) AS lines FROM ({R.MARKDOWN_DOCS_DUCK})))"""


@query("md_lines", f"SELECT doc, line, text FROM ({_LINES_DUCK})")
def md_lines(spark, sf):
    docs = R.markdown_docs(spark, sf)
    ending = F.when(F.col("doc") % 3 == 0, "\n").when(F.col("doc") % 3 == 1, "\r\n").otherwise("\r")
    mixed = docs.select("doc", F.concat(F.lit("\ufeff"), F.replace("text", F.lit("\n"), ending)).alias("text"))
    return M.md_lines(mixed).withColumn("line", F.col("line").cast("long"))


_RULE_RE = "^\\s*((\\*\\s*){3,}|(-\\s*){3,}|(_\\s*){3,})$"
_DIV_RE = "^\\s*\\|?\\s*:?-{3,}:?\\s*(\\|\\s*:?-{3,}:?\\s*)*\\|?\\s*$"
_LIST_RE = "^(\\s*)([-+*]|\\d+[.)])\\s+(.+)$"
_FENCE_RE = "^\\s*(```+|~~~+)\\s*([^\\s]*)\\s*$"
_HEAD_RE = "^\\s*(#{1,6})\\s+(.+?)\\s*#*\\s*$"
_OPENS = f"contains(text, '|') AND coalesce(regexp_matches(following, '{_DIV_RE}'), false)"
_CLASSED = f"""SELECT *, CASE WHEN trim(text) = '' THEN 'blank' WHEN regexp_matches(text, '{_FENCE_RE}') THEN 'fence'
  WHEN regexp_matches(text, '{_HEAD_RE}') THEN 'heading' WHEN regexp_matches(text, '{_RULE_RE}') THEN 'rule' WHEN regexp_matches(text, '^\\s*>') THEN 'quote'
  WHEN {_OPENS} THEN 'table' WHEN regexp_matches(text, '{_LIST_RE}') THEN 'list' ELSE 'text' END AS class FROM ({_LINES_DUCK})"""


@query(
    "md_line_class",
    f"""SELECT doc, line, class, CASE WHEN class = 'heading' THEN length(regexp_extract(text, '{_HEAD_RE}', 1)) END AS level,
      CASE WHEN class = 'list' THEN regexp_matches(text, '^\\s*\\d') END AS ordered,
      CASE WHEN class = 'list' THEN least(3, length(regexp_extract(text, '{_LIST_RE}', 1)) // 2) END AS indent,
      CASE WHEN class = 'fence' THEN regexp_extract(text, '{_FENCE_RE}', 2) END AS language FROM ({_CLASSED})""",
)
def md_line_class(spark, sf):
    out = M.md_line_class(R.markdown_docs(spark, sf))
    return out.select(
        "doc", F.col("line").cast("long").alias("line"), "class", F.col("level").cast("long").alias("level"), "ordered",
        F.col("indent").cast("long").alias("indent"), "language",
    )


# ---- Markdown blocks: a line by line state machine in SQL ------------------------------------

_L = f"""SELECT doc, line, text, class, contains(text, '|') AS pipe, {_OPENS} AS opens, regexp_matches(text, '{_LIST_RE}') AS is_list,
  regexp_matches(text, '^\\s*\\d') AS is_num, regexp_matches(text, '^\\s*```+\\s*$') AS shut1, regexp_matches(text, '^\\s*~~~+\\s*$') AS shut2,
  class IN ('quote', 'rule') OR regexp_matches(text, '^\\s*#{{1,6}}\\s+') OR regexp_matches(text, '{_LIST_RE}') OR ({_OPENS}) AS breaks,
  trim(text)[1:1] = '`' AS tick FROM ({_CLASSED})"""
# State: s = open block (''=none), n = block number of the line, out = per line (block, role).
_STEP = """CASE
  WHEN a.s = 'c1' THEN {'s': CASE WHEN x.shut1 THEN '' ELSE 'c1' END, 'n': a.n, 'out': list_append(a.out, {'b': a.n, 'r': CASE WHEN x.shut1 THEN 'end' ELSE 'in' END})}
  WHEN a.s = 'c2' THEN {'s': CASE WHEN x.shut2 THEN '' ELSE 'c2' END, 'n': a.n, 'out': list_append(a.out, {'b': a.n, 'r': CASE WHEN x.shut2 THEN 'end' ELSE 'in' END})}
  WHEN a.s = 't0' THEN {'s': 't', 'n': a.n, 'out': list_append(a.out, {'b': a.n, 'r': 'div'})}
  WHEN a.s = 't' AND x.class <> 'blank' AND x.pipe THEN {'s': 't', 'n': a.n, 'out': list_append(a.out, {'b': a.n, 'r': 'in'})}
  WHEN a.s = 'q' AND x.class = 'quote' THEN {'s': 'q', 'n': a.n, 'out': list_append(a.out, {'b': a.n, 'r': 'in'})}
  WHEN a.s = 'lo' AND x.is_list AND x.is_num THEN {'s': 'lo', 'n': a.n, 'out': list_append(a.out, {'b': a.n, 'r': 'in'})}
  WHEN a.s = 'lu' AND x.is_list AND NOT x.is_num THEN {'s': 'lu', 'n': a.n, 'out': list_append(a.out, {'b': a.n, 'r': 'in'})}
  WHEN a.s = 'p' AND x.class <> 'blank' AND NOT x.breaks THEN {'s': 'p', 'n': a.n, 'out': list_append(a.out, {'b': a.n, 'r': 'in'})}
  WHEN x.class = 'blank' THEN {'s': '', 'n': a.n, 'out': list_append(a.out, {'b': CAST(-1 AS BIGINT), 'r': 'skip'})}
  ELSE {'s': CASE x.class WHEN 'fence' THEN CASE WHEN x.tick THEN 'c1' ELSE 'c2' END WHEN 'quote' THEN 'q' WHEN 'table' THEN 't0'
      WHEN 'list' THEN CASE WHEN x.is_num THEN 'lo' ELSE 'lu' END WHEN 'text' THEN 'p' ELSE '' END,
    'n': a.n + 1, 'out': list_append(a.out, {'b': a.n + 1, 'r': CASE x.class WHEN 'fence' THEN 'code' WHEN 'quote' THEN 'blockquote' WHEN 'text' THEN 'paragraph' ELSE x.class END})}
  END"""
_FOLDED = f"""SELECT doc, list_reduce(list(l ORDER BY l.line), lambda a, x: {_STEP},
    {{'s': '', 'n': CAST(-1 AS BIGINT), 'out': CAST([] AS STRUCT(b BIGINT, r VARCHAR)[])}}).out AS out, list(l ORDER BY l.line) AS ls
  FROM (SELECT doc, l FROM ({_L}) AS l) GROUP BY doc"""
BLOCK_LINES = f"""SELECT doc, out[i].b AS block, out[i].r AS role, ls[i].line AS line, ls[i].text AS text FROM
  (SELECT doc, out, ls, unnest(generate_series(1, len(out))) AS i FROM ({_FOLDED})) WHERE out[i].b >= 0"""
BLOCKS_DUCK = f"""SELECT doc, block, kind, CASE WHEN kind = 'heading' THEN length(regexp_extract(first, '{_HEAD_RE}', 1)) END AS level,
    CASE WHEN kind = 'list' THEN regexp_matches(first, '^\\s*\\d') END AS ordered,
    CASE WHEN kind = 'code' THEN regexp_extract(first, '{_FENCE_RE}', 2) END AS language,
    CASE kind WHEN 'heading' THEN regexp_extract(first, '{_HEAD_RE}', 2)
      WHEN 'blockquote' THEN array_to_string(list_transform(lines, lambda t: regexp_replace(t, '^\\s*>\\s?', '')), chr(10))
      WHEN 'code' THEN array_to_string(inner_lines, chr(10)) WHEN 'paragraph' THEN array_to_string(list_transform(lines, lambda t: trim(t)), chr(10)) END AS text,
    CASE WHEN kind = 'list' THEN array_to_string(list_transform(lines, lambda t: least(3, length(regexp_extract(t, '{_LIST_RE}', 1)) // 2) || ':' ||
      regexp_extract(t, '{_LIST_RE}', 3)), chr(10)) END AS items, CASE WHEN kind = 'table' THEN len(inner_lines) END AS data_rows, lines, inner_lines, first
  FROM (SELECT doc, block, max(role) FILTER (role NOT IN ('in', 'end', 'div')) AS kind, list(text ORDER BY line) AS lines,
    coalesce(list(text ORDER BY line) FILTER (role = 'in'), CAST([] AS VARCHAR[])) AS inner_lines, arg_min(text, line) AS first
    FROM ({BLOCK_LINES}) GROUP BY doc, block)"""


@query("md_blocks", f"SELECT doc, block, kind, level, ordered, language, text, items, data_rows FROM ({BLOCKS_DUCK})")
def md_blocks(spark, sf):
    blocks = M.md_blocks(R.markdown_docs(spark, sf))
    return blocks.select(
        "doc",
        F.col("block").cast("long").alias("block"),
        "kind",
        F.col("level").cast("long").alias("level"),
        "ordered",
        "language",
        "text",
        F.array_join(F.transform("items", lambda i: F.concat(i["level"].cast("string"), F.lit(":"), i["text"])), "\n").alias("items"),
        F.when(F.col("kind") == "table", F.size("rows").cast("long")).alias("data_rows"),
    )


# The only special cells of the recipe are spelled out; the rest splits at pipes.
_CELL_PARTS = """string_split(regexp_replace(regexp_replace(trim(replace(replace(t, chr(92) || '|', chr(1)), '`x|y`', '`x' || chr(1) || 'y`')), '^[|]', ''), '[|]$', ''), '|')"""


@query(
    "md_table_cells",
    f"""WITH t AS (SELECT doc, block, unnest(list_concat([first], inner_lines)) AS t, unnest(generate_series(0, len(inner_lines))) AS row
      FROM ({BLOCKS_DUCK}) WHERE kind = 'table'),
    c AS (SELECT doc, block, row, list_transform({_CELL_PARTS}, lambda x: replace(trim(x), chr(1), '|')) AS cells FROM t),
    w AS (SELECT *, max(len(cells)) OVER (PARTITION BY doc, block) AS width FROM c)
    SELECT doc, block, row, array_to_string(list_concat(cells, list_transform(generate_series(1, width - len(cells)), lambda x: '')), '¦') AS cells FROM w""",
)
def md_table_cells(spark, sf):
    cells = M.md_table_cells(M.md_blocks(R.markdown_docs(spark, sf)))
    return cells.select(
        "doc", F.col("block").cast("long").alias("block"), F.col("row").cast("long").alias("row"), F.array_join("cells", "¦").alias("cells")
    )


@query(
    "md_links",
    f"""WITH t AS (SELECT doc, block, unnest(CASE kind WHEN 'list' THEN list_transform(lines, lambda t: regexp_extract(t, '{_LIST_RE}', 3))
        WHEN 'table' THEN flatten(list_transform(list_concat([first], inner_lines), lambda t: {_CELL_PARTS})) ELSE [text] END) AS text
      FROM ({BLOCKS_DUCK}) WHERE kind NOT IN ('code', 'rule')),
    m AS (SELECT doc, block, unnest(regexp_extract_all(text, '!?\\[[^\\]]+\\]\\([^)\\s]+\\)')) AS raw FROM t)
    SELECT doc, block, target, label, url, allowed, count(*) AS n FROM (SELECT doc, block,
      CASE WHEN raw[1:1] = '!' THEN 'image' ELSE 'link' END AS target, regexp_extract(raw, '\\[([^\\]]*)\\]', 1) AS label,
      regexp_extract(raw, '\\(([^)]*)\\)', 1) AS url, raw[1:1] <> '!' AND regexp_matches(raw, '\\((https?://|mailto:|#|/)') AS allowed FROM m)
    GROUP BY ALL""",
)
def md_links(spark, sf):
    found = M.md_links(M.md_blocks(R.markdown_docs(spark, sf)))
    return found.groupBy("doc", F.col("block").cast("long").alias("block"), "target", "label", "url", "allowed").agg(
        F.count(F.lit(1)).alias("n")
    )


@query("md_outline", f"SELECT doc, block, level, text FROM ({BLOCKS_DUCK}) WHERE kind = 'heading'")
def md_outline(spark, sf):
    return M.md_outline(M.md_blocks(R.markdown_docs(spark, sf))).select(
        "doc", F.col("block").cast("long").alias("block"), F.col("level").cast("long").alias("level"), "text"
    )


@query(
    "md_doc_stats",
    f"""SELECT d.doc, count(b.block) AS blocks, count(*) FILTER (kind = 'heading') AS headings, count(*) FILTER (kind = 'paragraph') AS paragraphs,
      count(*) FILTER (kind = 'blockquote') AS quotes, count(*) FILTER (kind = 'list') AS lists, count(*) FILTER (kind = 'code') AS codes,
      count(*) FILTER (kind = 'rule') AS rules, count(*) FILTER (kind = 'table') AS tables,
      coalesce(max(greatest(len(inner_lines), 1)) FILTER (kind = 'code'), 0) AS longest_code,
      coalesce(max(len(inner_lines)) FILTER (kind = 'code'), 0) > 200 AS code_too_long
    FROM ({R.MARKDOWN_DOCS_DUCK}) AS d LEFT JOIN ({BLOCKS_DUCK}) AS b ON b.doc = d.doc GROUP BY d.doc""",
)
def md_doc_stats(spark, sf):
    return M.md_doc_stats(R.markdown_docs(spark, sf))


_PAGE_STEP = """CASE WHEN a.err <> '' THEN a
  WHEN len(a.p) = 0 AND x > 7 THEN {'p': a.p, 'used': x, 'pages': a.pages, 'err': 'block-too-large'}
  WHEN len(a.p) = 0 THEN {'p': [CAST(1 AS BIGINT)], 'used': x, 'pages': CAST(1 AS BIGINT), 'err': ''}
  WHEN a.used + x > 7 AND a.pages >= 4 THEN {'p': a.p, 'used': x, 'pages': a.pages, 'err': 'too-many-pages'}
  WHEN a.used + x > 7 THEN {'p': list_append(a.p, a.pages + 1), 'used': x, 'pages': a.pages + 1, 'err': ''}
  ELSE {'p': list_append(a.p, a.pages), 'used': a.used + x, 'pages': a.pages, 'err': ''} END"""


@query(
    "paginate_blocks",
    f"""WITH h AS (SELECT d.doc, coalesce(list(CAST(len(lines) AS BIGINT) ORDER BY block) FILTER (block IS NOT NULL), CAST([] AS BIGINT[])) AS hs
      FROM ({R.MARKDOWN_DOCS_DUCK}) AS d LEFT JOIN ({BLOCKS_DUCK}) AS b ON b.doc = d.doc GROUP BY d.doc),
    f AS (SELECT doc, hs, list_reduce(hs, lambda a, x: {_PAGE_STEP},
      {{'p': CAST([] AS BIGINT[]), 'used': CAST(0 AS BIGINT), 'pages': CAST(0 AS BIGINT), 'err': ''}}) AS s FROM h),
    r AS (SELECT doc, unnest(s.p) AS page, unnest(hs) AS height, unnest(generate_series(0, len(hs) - 1)) AS block FROM f WHERE s.err = '' AND len(hs) > 0)
    SELECT doc, page, min(block) AS first_block, max(block) AS last_block, CAST(sum(height) AS BIGINT) AS used, CAST(NULL AS VARCHAR) AS error FROM r GROUP BY doc, page
    UNION ALL SELECT doc, NULL, NULL, NULL, NULL, CASE WHEN len(hs) = 0 THEN 'no-content' ELSE s.err END FROM f WHERE s.err <> '' OR len(hs) = 0""",
)
def paginate_blocks(spark, sf):
    plan = M.paginate_blocks(M.block_heights(R.markdown_docs(spark, sf)), page_height=7, max_pages=4)
    return plan.select("doc", *[F.col(c).cast("long").alias(c) for c in ("page", "first_block", "last_block", "used")], "error")
