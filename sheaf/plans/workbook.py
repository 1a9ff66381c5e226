"""Workbook files to typed cells and refused files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import dims
from ..functions.links import is_external_target
from ..operators import sheets as S
from ..operators.archive import MACRO_TYPE, resolve_target, with_verdict
from ..operators.ordering import kept
from ..sources.archive import part_rows
from ..sources.office import (
    scan_fills,
    scan_fonts,
    scan_number_formats,
    scan_relationships,
    scan_shared_strings,
    scan_sheet_rows,
    scan_styles,
    scan_workbook_sheets,
    sheet_cells,
    sheet_facts,
    xml_guard,
)

WORKBOOK = "xl/workbook.xml"
RELS = "xl/_rels/workbook.xml.rels"
STRINGS = "xl/sharedstrings.xml"
STYLES = "xl/styles.xml"
CONTENT_TYPES = "[content_types].xml"
FIXED = [CONTENT_TYPES, WORKBOOK, RELS, STRINGS, STYLES]
# Sheets lie where the relationships say, so any XML part may be one.
WANTED = r"\.xml\z|^xl/_rels/workbook\.xml\.rels\z"
BLOCKED = r"/embeddings/|/activex/|\.(?:bin|exe|js)\z"
MACROS = r"vbaproject\.bin\z"
ELSEWHERE = r"(?i)<(?:\w+:)?externalReferences\b"


def workbook_parts(files: DataFrame) -> DataFrame:
    """file_id, path (lower case), xml, problem: one row per part needed, or one with a problem.

    Directory, limits and inflation happen in the row of the file.
    """
    judged = with_verdict(files)
    lower = F.transform("paths", F.lower)
    problem = (
        F.when(F.octet_length("content") > dims.MAX_OFFICE_BYTES, "too-large")
        .when(F.col("archive_error").isNotNull(), F.col("archive_error"))
        .when(~F.array_contains(lower, CONTENT_TYPES), "missing-content-types")
        .when(F.exists(lower, lambda p: p.rlike(MACROS)), "macros")
        .when(F.exists(lower, lambda p: p.rlike(BLOCKED)), "embedded-content")
        .when(~F.array_contains(lower, WORKBOOK), "missing-workbook")
    )
    chosen = judged.select("file_id", "content", problem.alias("problem"), F.col("dir.entries").alias("entries"))
    wanted = F.when(F.col("problem").isNull(), F.filter("entries", lambda e: F.lower(e["path"]).rlike(WANTED))).otherwise(
        F.slice("entries", 1, 0)
    )
    read = chosen.withColumn("wanted", wanted).select("file_id", "problem", part_rows(F.col("wanted"), F.col("content")).alias("parts"))
    rows = read.select("file_id", "problem", F.inline_outer("parts"))
    xml = F.col("data").cast("string")
    return rows.select(
        "file_id",
        F.lower("path").alias("path"),
        xml.alias("xml"),
        F.coalesce("problem", "error", F.when(F.col("path").isNotNull(), F.coalesce(F.when(~F.is_valid_utf8(xml), "not-utf8"), xml_guard(xml)))).alias("problem"),
    )


def _of(parts: DataFrame, path: str) -> DataFrame:
    return parts.where(F.col("path") == path).select("file_id", "xml")


def _package_problems(parts: DataFrame) -> DataFrame:
    """file_id, problem: what the content types, the workbook part and its relationships
    say against the whole file."""
    rels = scan_relationships(_of(parts, RELS).withColumn("source_part", F.lit(WORKBOOK)))
    blank = reduce(lambda a, b: a | b, (F.trim(F.coalesce(c, F.lit(""))) == "" for c in ("rel_id", "type", "target")))
    away = is_external_target(F.coalesce("target", F.lit("")), F.col("mode"))
    linked = rels.select("file_id", F.when(blank, "incomplete-relationship").when(away, "external-relationship").alias("problem"))
    whole = parts.where(F.col("path").isin(CONTENT_TYPES, WORKBOOK)).select(
        "file_id",
        F.when((F.col("path") == CONTENT_TYPES) & F.col("xml").rlike(MACRO_TYPE), "macros")
        .when((F.col("path") == WORKBOOK) & F.col("xml").rlike(ELSEWHERE), "external-references")
        .alias("problem"),
    )
    unlinked = parts.where(F.col("path") == WORKBOOK).select("file_id").join(_of(parts, RELS).select("file_id"), "file_id", "left_anti")
    found = linked.unionByName(whole).unionByName(unlinked.select("file_id", F.lit("missing-relationships").alias("problem")))
    return found.where(F.col("problem").isNotNull())


def workbook_cells(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``files``: file_id, content → (cells with their shown text, refused files).

    Every sheet of a workbook that is not refused gives cells; a sheet without a part to
    read, with a part that is no worksheet, or without a filled cell refuses the file.
    The parts are written once: all readers share one pass over the archives, and those of
    the few fixed parts do not read the sheets.  Cells are written once too, and what they
    say against their file is told from them.
    """
    parts = kept(workbook_parts(files).withColumn("has_xml", F.col("xml").isNotNull()))
    fixed = kept(parts.where(F.col("path").isNull() | F.col("path").isin(FIXED)))
    refused = fixed.where(F.col("problem").isNotNull()).select("file_id", "problem").unionByName(_package_problems(fixed))
    good = fixed.where(F.col("problem").isNull()).join(refused.select("file_id").distinct(), "file_id", "left_anti")

    rels = scan_relationships(_of(fixed, RELS).withColumn("source_part", F.lit(WORKBOOK)))
    targets = rels.select("file_id", "rel_id", F.lower(resolve_target(F.col("source_part"), F.col("target"))).alias("path"))
    named = kept(scan_workbook_sheets(_of(fixed, WORKBOOK)).join(targets, ["file_id", "rel_id"], "left"))
    counts = named.groupBy("file_id").agg(F.count(F.lit(1)).alias("n"))
    # Every sheet the workbook names goes on from here: as a part to read or as a refusal.
    # Of a workbook with too many, which gives no cells, each part is read for its first name only.
    again = F.row_number().over(Window.partitionBy("file_id", "path").orderBy("sheet_ord")) > 1
    listed = named.select("file_id", "sheet_ord", "path", again.alias("again")).join(counts, "file_id")
    found = listed.join(parts.select("file_id", "path", "problem", "has_xml"), ["file_id", "path"], "left")
    why = F.when(F.col("path").isNull(), "sheet-without-part").otherwise(F.coalesce("problem", F.when(~F.coalesce("has_xml", F.lit(False)), "sheet-part-missing")))
    skipped = F.col("again") & (F.col("n") > dims.MAX_SHEETS)
    found = kept(found.select("file_id", "sheet_ord", "path", skipped.alias("skipped"), why.alias("problem")))
    crowded = counts.where(F.col("n") > dims.MAX_SHEETS).select("file_id", F.lit("too-many-sheets").alias("problem"))
    empty = _of(fixed, WORKBOOK).select("file_id").join(counts, "file_id", "left_anti").select("file_id", F.lit("no-sheets").alias("problem"))
    readable = found.where(F.col("problem").isNull() & ~F.col("skipped")).select("file_id", "path", "sheet_ord")
    rows = kept(scan_sheet_rows(readable.join(parts.select("file_id", "path", "xml"), ["file_id", "path"]).select("file_id", "sheet_ord", "xml")))

    raw, told = sheet_cells(rows), sheet_facts(rows)
    codes = (("external", "external-formula"), ("unread", "malformed"), ("blank", "blank-sheet"))
    facts = F.array(*[F.when(~F.col("filled") if c == "blank" else F.col(c), code) for c, code in codes])
    bad = told.select("file_id", F.explode(F.array_compact(facts)).alias("problem"))
    sheets = found.where(F.col("problem").isNotNull()).select("file_id", "problem")
    # A package refused as a whole is not read further.
    inner = reduce(DataFrame.unionByName, [sheets, crowded, empty, bad])
    alone = fixed.where(F.col("path").isNull() & F.col("problem").isNotNull()).select("file_id").distinct()
    refused = kept(refused.unionByName(inner.join(alone, "file_id", "left_anti")).groupBy("file_id").agg(F.min("problem").alias("problem")))
    good_cells = raw.join(refused.select("file_id"), "file_id", "left_anti")

    styles = _of(good, STYLES)
    typed = S.typed_cells(S.shared_strings(good_cells, scan_shared_strings(_of(good, STRINGS))))
    styled = S.style_snowflake(typed, scan_styles(styles), scan_fonts(styles), scan_fills(styles), scan_number_formats(styles))
    return S.display_text(S.dated_cells(styled)), refused
