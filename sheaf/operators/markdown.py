"""Markdown as tables: lines, blocks, table cells, links, outline, page fit.

A document is one row and stays one row until its blocks are exploded, so none
of this shuffles text.  Every line is classified to one letter; the sequence of
letters is cut into blocks by one regular expression whose alternatives stand in
the order of the parser's tests.

Arrays are exploded with the outer form and the empty rows dropped after it: the
plain form makes Catalyst test the array for emptiness in a filter of its own,
which would compute every expensive array twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dims
from ..functions.links import safe_href, safe_image_source
from ..functions.text import WS, WS_CLASS, clean_trim, is_blank

S = WS_CLASS

# Line patterns.
FENCE = f"^{S}*(```+|~~~+){S}*([^{WS}]*){S}*\\z"
TICK_CLOSE = f"^{S}*`{{3,}}{S}*\\z"
TILDE_CLOSE = f"^{S}*~{{3,}}{S}*\\z"
HEADING = f"^{S}*(#{{1,6}}){S}+(.+?){S}*#*{S}*\\z"
HEADING_START = f"^{S}*#{{1,6}}{S}+"
RULE = (
    f"^(?:(?=(?:[^*]*\\*){{3}})[*{WS}]+|(?=(?:[^-]*-){{3}})[-{WS}]+|(?=(?:[^_]*_){{3}})[_{WS}]+)\\z"
)
QUOTE = f"^{S}*>"
LIST_ITEM = f"^({S}*)([-+*]|\\d+[.)]){S}+(.+)\\z"
ORDERED_ITEM = f"^{S}*\\d+[.)]{S}+.+\\z"
DIVIDER_CHARS = f"^[-|:{WS}]+\\z"
DIVIDER_CELL = f"^{S}*:?-{{3,}}:?{S}*\\z"
MARKED = f"^{S}*[#`~*_>+0-9-]"


def normalize(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"^\x{FEFF}", ""), r"\r\n?", "\n")


def lines_of(text: Column) -> Column:
    return F.split(normalize(text), "\n", -1)


def _strip_pipes(line: Column) -> Column:
    value = clean_trim(line)
    value = F.regexp_replace(value, r"^\|", "")
    return F.regexp_replace(value, r"\|\z", "")


def is_divider(line: Column) -> Column:
    cells = F.split(_strip_pipes(line), r"\|", -1)
    return line.rlike(DIVIDER_CHARS) & F.forall(cells, lambda c: c.rlike(DIVIDER_CELL))


def _has_pipe(line: Column) -> Column:
    return F.contains(line, F.lit("|"))


def opens_table(lines: Column, line: Column, index: Column) -> Column:
    following = F.get(lines, index + 1)
    return _has_pipe(line) & F.coalesce(is_divider(following), F.lit(False))


def md_lines(docs: DataFrame) -> DataFrame:
    """``docs``: doc, text → doc, line (from 0), text."""
    return docs.select("doc", F.posexplode_outer(lines_of(F.col("text"))).alias("line", "text")).where(F.col("line").isNotNull())


def md_line_class(docs: DataFrame) -> DataFrame:
    """Class of every line taken by itself (with one line of look-ahead)."""
    lines = docs.select("doc", lines_of(F.col("text")).alias("lines"))
    flagged = lines.select(
        "doc",
        F.posexplode_outer(
            F.transform("lines", lambda line, i: F.struct(line.alias("text"), opens_table(F.col("lines"), line, i).alias("opens")))
        ).alias("line", "l"),
    ).select("doc", "line", F.col("l.text").alias("text"), F.col("l.opens").alias("opens"))
    text = F.col("text")
    kind = (
        F.when(is_blank(text), "blank")
        .when(text.rlike(FENCE), "fence")
        .when(text.rlike(HEADING), "heading")
        .when(text.rlike(RULE), "rule")
        .when(text.rlike(QUOTE), "quote")
        .when(F.col("opens"), "table")
        .when(text.rlike(LIST_ITEM), "list")
        .otherwise("text")
    )
    classed = flagged.withColumn("class", kind)
    return classed.select(
        "doc",
        "line",
        "class",
        F.when(F.col("class") == "heading", F.length(F.regexp_extract(text, HEADING, 1))).alias("level"),
        F.when(F.col("class") == "list", text.rlike(ORDERED_ITEM)).alias("ordered"),
        F.when(F.col("class") == "list", list_indent(text)).alias("indent"),
        F.when(F.col("class") == "fence", F.regexp_extract(text, FENCE, 2)).alias("language"),
    )


def list_indent(line: Column) -> Column:
    lead = F.replace(F.regexp_extract(line, LIST_ITEM, 1), F.lit("\t"), F.lit("  "))
    return F.least(F.lit(3), F.floor(F.length(lead) / 2).cast("int"))


# One letter per line.  Upper case: the line holds a pipe.
#   b blank     c/d bare ``` or ~~~       e/f fence with a language (g/k: opens a table)
#   h heading   x "# " without a text     r rule, u rule that also reads as a list item
#   q quote     o/l list item (1/2: opens a table)    p text, t opens a table
_PIPED = "QHEFgkOL12Pt"
_PARAGRAPH_GOES_ON = "pPcdefEF"
BLOCK = (
    "b"
    "|[ceEg][^c]*+c?+"
    "|[dfFk][^d]*+d?+"
    "|[hH]"
    "|[ru]"
    "|[qQ]++"
    f"|[t12].[{_PIPED}]*+"
    "|[oO][oO1]*+"
    "|[lL][lLu2]*+"
    f"|[xpP][{_PARAGRAPH_GOES_ON}]*+"
)


def _letter(lines: Column, line: Column, index: Column) -> Column:
    pipe, opens = _has_pipe(line), opens_table(lines, line, index)

    def cased(plain: str, piped: str, table: str | None = None) -> Column:
        out = F.when(~pipe, plain)
        if table is not None:
            out = out.when(opens, table)
        return out.otherwise(piped)

    tick = F.regexp_extract(line, FENCE, 1).startswith("`")
    return (
        F.when(is_blank(line), "b")
        .when(~line.rlike(MARKED), cased("p", "P", "t"))
        .when(line.rlike(TICK_CLOSE), "c")
        .when(line.rlike(TILDE_CLOSE), "d")
        .when(line.rlike(FENCE), F.when(tick, cased("e", "E", "g")).otherwise(cased("f", "F", "k")))
        .when(line.rlike(HEADING), cased("h", "H"))
        .when(line.rlike(HEADING_START), "x")
        .when(line.rlike(RULE), F.when(line.rlike(LIST_ITEM), "u").otherwise("r"))
        .when(line.rlike(QUOTE), cased("q", "Q"))
        .when(line.rlike(ORDERED_ITEM), cased("o", "O", "1"))
        .when(line.rlike(LIST_ITEM), cased("l", "L", "2"))
        .otherwise(cased("p", "P", "t"))
    )


def doc_blocks(docs: DataFrame) -> DataFrame:
    """doc, blocks ARRAY<STRING>: letter of the first line, then the lines.

    Lines were split at every carriage return, so that character is free to
    mark the block starts.
    """
    lettered = docs.select("doc", lines_of(F.col("text")).alias("lines")).select(
        "doc",
        "lines",
        F.array_join(F.transform("lines", lambda line, i: _letter(F.col("lines"), line, i)), "").alias("letters"),
    )
    starts = F.flatten(
        F.transform(
            F.regexp_extract_all("letters", F.lit(f"({BLOCK})"), F.lit(0)),
            lambda t: F.concat(
                F.array(F.concat(F.lit("\r"), F.substring(t, 1, 1))), F.array_repeat(F.lit(""), F.length(t) - 1)
            ),
        )
    )
    marked = F.array_join(F.zip_with("lines", starts, lambda line, start: F.concat(start, line)), "\n")
    parts = F.split(marked, "\n?\r", -1)
    return lettered.select(
        "doc", F.filter(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda b: ~b.startswith("b")).alias("blocks")
    )


def md_blocks(docs: DataFrame) -> DataFrame:
    """doc, block, kind, level, ordered, language, text, items, headers, rows."""
    exploded = doc_blocks(docs).select("doc", F.posexplode_outer("blocks").alias("block", "raw")).where(F.col("block").isNotNull())
    letter = F.substring("raw", 1, 1)
    body = F.col("raw").substr(F.lit(2), F.length("raw"))
    kind = (
        F.when(letter.rlike("[ceEgdfFk]"), "code")
        .when(letter.rlike("[hH]"), "heading")
        .when(letter.rlike("[ru]"), "rule")
        .when(letter.rlike("[qQ]"), "blockquote")
        .when(letter.rlike("[t12]"), "table")
        .when(letter.rlike("[oOlL]"), "list")
        .otherwise("paragraph")
    )
    split = exploded.select("doc", "block", kind.alias("kind"), letter.alias("letter"), body.alias("body"), F.split(body, "\n", -1).alias("lines"))
    k, rows = F.col("kind"), F.col("lines")
    first, last = F.element_at(rows, 1), F.element_at(rows, -1)
    closed = (F.size(rows) > 1) & F.when(F.col("letter").rlike("[ceEg]"), last.rlike(TICK_CLOSE)).otherwise(last.rlike(TILDE_CLOSE))
    code_lines = F.slice(rows, 2, F.greatest(F.size(rows) - F.when(closed, 2).otherwise(1), F.lit(0)))
    text = (
        F.when(k == "heading", F.regexp_extract(first, HEADING, 2))
        .when(k == "blockquote", F.array_join(F.transform(rows, lambda r: F.regexp_replace(r, f"{QUOTE}{S}?", "")), "\n"))
        .when(k == "code", F.array_join(code_lines, "\n"))
        .when(k == "paragraph", F.array_join(F.transform(rows, clean_trim), "\n"))
    )
    items = F.transform(
        rows, lambda r: F.struct(F.regexp_extract(r, LIST_ITEM, 3).alias("text"), list_indent(r).alias("level"))
    )
    data_rows = F.slice(rows, 3, F.greatest(F.size(rows) - 2, F.lit(0)))
    return split.select(
        "doc",
        "block",
        "kind",
        F.when(k == "heading", F.length(F.regexp_extract(first, HEADING, 1))).alias("level"),
        F.when(k == "list", F.col("letter").isin("o", "O")).alias("ordered"),
        F.when(k == "code", F.regexp_extract(first, FENCE, 2)).alias("language"),
        text.alias("text"),
        F.when(k == "list", items).alias("items"),
        F.when(k == "table", split_row(first)).alias("headers"),
        F.when(k == "table", F.transform(data_rows, split_row)).alias("rows"),
    )


# Pieces of a table row: escaped character, code span, plain run, delimiter.
ROW_PIECE = r"\\(?:.|\z)|`(?:[^`\\]++|\\.)*+(?:`|\\?\z)|[^|`\\]++|\|"


def split_row(line: Column) -> Column:
    """Cells of a table row; a pipe counts unless escaped or inside back-ticks."""
    value = _strip_pipes(line)
    pieces = F.regexp_extract_all(value, F.lit(f"(?s){ROW_PIECE}"), F.lit(0))
    open_escape = F.length(F.regexp_extract(value, r"\\*\z", 0)) % 2 == 1
    marked = F.concat(
        F.array_join(F.transform(pieces, lambda p: F.when(p == "|", "\r").otherwise(p)), ""),
        F.when(open_escape, "\\").otherwise(""),
    )
    return F.transform(F.split(marked, "\r", -1), lambda c: F.replace(clean_trim(c), F.lit("\\|"), F.lit("|")))


def md_table_cells(blocks: DataFrame) -> DataFrame:
    """doc, block, row (0 = header), cells; rows padded to the widest."""
    tables = blocks.where(F.col("kind") == "table").select(
        "doc", "block", F.concat(F.array("headers"), "rows").alias("grid")
    )
    width = F.greatest(F.lit(1), F.array_max(F.transform("grid", F.size)))
    return tables.select("doc", "block", width.alias("width"), F.posexplode_outer("grid").alias("row", "cells")).select(
        "doc",
        "block",
        "row",
        F.transform(F.sequence(F.lit(0), F.col("width") - 1), lambda i: F.coalesce(F.get("cells", i), F.lit(""))).alias("cells"),
    )


# Code span, image, link, whichever starts first.
INLINE = r"(`+)[\s\S]*?\1|!\[[^\]]*\]\([^)\s]+(?:\s+[\"'][^\"']*[\"'])?\)|\[[^\]]+\]\([^)\s]+(?:\s+[\"'][^\"']*[\"'])?\)"
INLINE_PARTS = r"^!?\[([^\]]*)\]\(([^)\s]+)"


def inline_texts(blocks: DataFrame) -> DataFrame:
    """Every inline text of every block but code, in document order."""
    cells = F.flatten(F.concat(F.array("headers"), "rows"))
    texts = (
        F.when(F.col("kind") == "list", F.transform("items", lambda i: i["text"]))
        .when(F.col("kind") == "table", cells)
        .when(F.col("kind").isin("heading", "paragraph", "blockquote"), F.array("text"))
    )
    return blocks.select("doc", "block", F.posexplode_outer(texts).alias("part", "text")).where(F.col("text").isNotNull())


def md_links(blocks: DataFrame) -> DataFrame:
    """doc, block, part, ord, target kind, label, url, allowed."""
    found = inline_texts(blocks).select(
        "doc",
        "block",
        "part",
        F.posexplode_outer(
            F.filter(F.regexp_extract_all("text", F.lit(INLINE), F.lit(0)), lambda m: ~m.startswith("`"))
        ).alias("ord", "raw"),
    ).where(F.col("ord").isNotNull())
    image = F.col("raw").startswith("!")
    url = F.regexp_extract("raw", INLINE_PARTS, 2)
    return found.select(
        "doc",
        "block",
        "part",
        "ord",
        F.when(image, "image").otherwise("link").alias("target"),
        F.regexp_extract("raw", INLINE_PARTS, 1).alias("label"),
        url.alias("url"),
        F.when(image, safe_image_source(url)).otherwise(safe_href(url)).isNotNull().alias("allowed"),
    )


def md_outline(blocks: DataFrame) -> DataFrame:
    """Headings in document order; the block number carries the order."""
    return blocks.where(F.col("kind") == "heading").select("doc", "block", "level", "text")


def md_doc_stats(docs: DataFrame) -> DataFrame:
    """Block counts per kind and the longest code block, one row per document.

    Counted over the block array of the row: no shuffle.
    """
    blocks = F.col("blocks")

    def count(letters: str) -> Column:
        return F.size(F.filter(blocks, lambda b: b.rlike(f"^[{letters}]"))).cast("long")

    code = F.filter(blocks, lambda b: b.rlike("^[ceEgdfFk]"))

    def length(block: Column) -> Column:
        rows = F.split(block, "\n", -1)
        last = F.element_at(rows, -1)
        ticks = block.rlike("^[ceEg]")
        closed = (F.size(rows) > 1) & F.when(ticks, last.rlike(TICK_CLOSE)).otherwise(last.rlike(TILDE_CLOSE))
        return F.greatest(F.size(rows) - F.when(closed, 2).otherwise(1), F.lit(1))

    longest = F.coalesce(F.array_max(F.transform(code, length)), F.lit(0)).cast("long")
    return (
        doc_blocks(docs)
        .select(
            "doc",
            F.size(blocks).cast("long").alias("blocks"),
            count("hH").alias("headings"),
            count("xpP").alias("paragraphs"),
            count("qQ").alias("quotes"),
            count("oOlL").alias("lists"),
            count("ceEgdfFk").alias("codes"),
            count("ru").alias("rules"),
            count("t12").alias("tables"),
            longest.alias("longest_code"),
        )
        .withColumn("code_too_long", F.col("longest_code") > dims.MAX_CODE_LINES)
    )


def block_heights(docs: DataFrame) -> DataFrame:
    """doc, heights ARRAY<INT>: lines per block, the stand-in for a drawn height."""
    return doc_blocks(docs).select("doc", F.transform("blocks", lambda b: F.size(F.split(b, "\n", -1))).alias("heights"))


def paginate_blocks(docs: DataFrame, page_height: int, max_pages: int = dims.MAX_MARKDOWN_PAGES) -> DataFrame:
    """Greedy page fit of ``heights``; doc, page, first_block, last_block, used, error.

    A block that does not fit moves to a new page as it is; only one that
    overflows while alone on the page it was put on is an error.  A failed
    document yields one row with its error code.
    """
    start = F.struct(
        F.expr("cast(array() as array<int>)").alias("starts"),
        F.lit(0).alias("used"),
        F.lit(0).alias("i"),
        F.lit(None).cast("string").alias("error"),
    )

    def step(s: Column, height: Column) -> Column:
        fresh = F.size(s["starts"]) == 0
        over = s["used"] + height > page_height
        turn = over & ~fresh
        error = F.when(s["error"].isNotNull(), s["error"]).when(turn & (F.size(s["starts"]) >= max_pages), "too-many-pages").when(
            over & fresh, "block-too-large"
        )
        return F.struct(
            F.when(turn | fresh, F.concat(s["starts"], F.array(s["i"]))).otherwise(s["starts"]).alias("starts"),
            F.when(turn | fresh, height).otherwise(s["used"] + height).alias("used"),
            (s["i"] + 1).alias("i"),
            error.alias("error"),
        )

    folded = docs.select("doc", "heights", F.aggregate("heights", start, step).alias("s"))
    error = F.when(F.size("heights") == 0, "no-content").otherwise(F.col("s.error"))
    plan = F.when(
        error.isNull(),
        F.transform(
            "s.starts",
            lambda b, p: F.struct(
                (p + 1).alias("page"),
                b.alias("first_block"),
                (F.coalesce(F.get("s.starts", p + 1), F.size("heights")) - 1).alias("last_block"),
            ),
        ),
    )
    return (
        folded.select("doc", "heights", error.alias("error"), F.explode_outer(plan).alias("p"))
        .select(
            "doc",
            F.col("p.page").alias("page"),
            F.col("p.first_block").alias("first_block"),
            F.col("p.last_block").alias("last_block"),
            F.aggregate(
                F.slice("heights", F.col("p.first_block") + 1, F.col("p.last_block") - F.col("p.first_block") + 1),
                F.lit(0),
                lambda a, h: a + h,
            ).alias("used"),
            "error",
        )
    )
