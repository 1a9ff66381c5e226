"""Registries: the small fixed tables the operators join to.

Everything here is a fixed value set: kinds, tools, limits, capability rows and
native pairs.  Each table is handed out as one ``VALUES`` clause, so Spark sees a
local relation of known size (and broadcasts it by itself) and the oracle reads
the very same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

MIB = 1024 * 1024

# Byte and count limits.
MAX_PDF_BYTES = 100 * MIB
MAX_IMAGE_BYTES = 25 * MIB
MAX_OFFICE_BYTES = 50 * MIB
MAX_MARKDOWN_BYTES = 10 * MIB
MAX_APPLE_BYTES = 100 * MIB
MAX_BATCH_PDF_BYTES = 200 * MIB
MAX_BATCH_IMAGE_BYTES = 100 * MIB
MAX_BATCH_DOCX_BYTES = 100 * MIB
MAX_COMBINE_BYTES = 150 * MIB
MAX_INSPECT_BYTES = 100 * MIB
MAX_DROP_FILES = 20
MAX_DROP_BYTES = 150 * MIB
MAX_BASE64_CHARS = 140_000_000
MAX_XML_BYTES = 16 * MIB
MAX_XML_NODES = 250_000
MAX_XML_DEPTH = 128
MAX_SHEET_ROWS = 20_000
MAX_SHEET_COLUMNS = 500
MAX_SHEETS = 100
MAX_SLIDES = 200
MAX_TABLE_ROWS = 10_000
MAX_JPG_PAGES = 100
MAX_TEXT_PAGES = 300
MAX_TEXT_CHARS = 5 * MIB
MAX_MARKDOWN_PAGES = 100
MAX_DOCX_PAGES = 200
MAX_CODE_LINES = 200
# Pixel caps of the three image checks, and one side cap.
MAX_PDF_IMAGE_PIXELS = 24_000_000
MAX_OFFICE_IMAGE_PIXELS = 40_000_000
MAX_STAMP_PIXELS = 16_000_000
MAX_STAMP_SIDE = 4096
# Archive limits.
ARCHIVE_LIMITS = {
    "input_bytes": 100 * MIB,
    "entries": 10_000,
    "entry_bytes": 64 * MIB,
    "total_bytes": 256 * MIB,
    "ratio": 200,
}
# The tighter archive limits for small devices.

DOCX_MIME = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"
PPTX_MIME = "application/vnd.openxmlformats-officedocument.presentationml.presentation"
XLSX_MIME = "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet"

# Kind, label, extensions, MIME types.
KIND_RULES = [
    ("pdf", "PDF", ".pdf", "application/pdf"),
    ("jpeg", "JPEG image", ".jpg,.jpeg", "image/jpeg"),
    ("png", "PNG image", ".png", "image/png"),
    ("docx", "Word document", ".docx", DOCX_MIME),
    ("markdown", "Markdown document", ".md,.markdown", "text/markdown,text/plain"),
    ("pptx", "PowerPoint presentation", ".pptx", PPTX_MIME),
    ("xlsx", "Excel workbook", ".xlsx", XLSX_MIME),
    ("pages", "Apple Pages document", ".pages", "application/vnd.apple.pages"),
    ("keynote", "Apple Keynote presentation", ".key,.keynote", "application/vnd.apple.keynote"),
    ("numbers", "Apple Numbers spreadsheet", ".numbers", "application/vnd.apple.numbers"),
]
UNKNOWN_LABEL = "Unknown file"

# Slug, extensions, MIME types, max files, max bytes per file,
# max bytes in total, category.
TOOL_RULES = [
    ("merge-pdf", ".pdf", "application/pdf", 20, MAX_PDF_BYTES, MAX_BATCH_PDF_BYTES, "PDF"),
    ("split-pdf", ".pdf", "application/pdf", 1, MAX_PDF_BYTES, MAX_PDF_BYTES, "PDF"),
    ("images-to-pdf", ".jpg,.jpeg,.png", "image/jpeg,image/png", 30, MAX_IMAGE_BYTES, MAX_BATCH_IMAGE_BYTES, "Images"),
    ("docx-to-pdf", ".docx", DOCX_MIME, 10, MAX_OFFICE_BYTES, MAX_BATCH_DOCX_BYTES, "Documents"),
    ("pages-to-word", ".pages", "application/vnd.apple.pages", 1, MAX_APPLE_BYTES, MAX_APPLE_BYTES, "Documents"),
    ("powerpoint-to-pdf", ".pptx", PPTX_MIME, 1, MAX_OFFICE_BYTES, MAX_OFFICE_BYTES, "Documents"),
    ("keynote-to-powerpoint", ".key,.keynote", "application/vnd.apple.keynote", 1, MAX_APPLE_BYTES, MAX_APPLE_BYTES, "Documents"),
    ("excel-to-pdf", ".xlsx", XLSX_MIME, 1, MAX_OFFICE_BYTES, MAX_OFFICE_BYTES, "Documents"),
    ("pdf-to-jpg", ".pdf", "application/pdf", 1, MAX_PDF_BYTES, MAX_PDF_BYTES, "PDF"),
    ("sign-pdf", ".pdf", "application/pdf", 1, MAX_PDF_BYTES, MAX_PDF_BYTES, "PDF"),
    ("rotate-pdf", ".pdf", "application/pdf", 1, MAX_PDF_BYTES, MAX_PDF_BYTES, "PDF"),
    ("compress-pdf", ".pdf", "application/pdf", 1, MAX_PDF_BYTES, MAX_PDF_BYTES, "PDF"),
    ("markdown-to-pdf", ".md,.markdown", "text/markdown", 1, MAX_MARKDOWN_BYTES, MAX_MARKDOWN_BYTES, "Documents"),
    ("pdf-to-markdown", ".pdf", "application/pdf", 1, MAX_PDF_BYTES, MAX_PDF_BYTES, "Documents"),
    ("combine-to-pdf", ".pdf,.docx,.md,.markdown,.jpg,.jpeg,.png",
     "application/pdf," + DOCX_MIME + ",text/markdown,image/jpeg,image/png", 20, MAX_PDF_BYTES, MAX_COMBINE_BYTES, "Documents"),
    ("pages-to-pdf", ".pages", "application/vnd.apple.pages", 1, MAX_APPLE_BYTES, MAX_APPLE_BYTES, "Documents"),
    ("keynote-to-pdf", ".key,.keynote", "application/vnd.apple.keynote", 1, MAX_APPLE_BYTES, MAX_APPLE_BYTES, "Documents"),
    ("numbers-to-xlsx", ".numbers", "application/vnd.apple.numbers", 1, MAX_APPLE_BYTES, MAX_APPLE_BYTES, "Documents"),
    ("numbers-to-pdf", ".numbers", "application/vnd.apple.numbers", 1, MAX_APPLE_BYTES, MAX_APPLE_BYTES, "Documents"),
]
# Retired slugs.
RETIRED_SLUGS = [("word-to-pdf",), ("numbers-to-excel",)]

# Capability id, kind, input formats, output, tool, category, support.
CAPABILITIES = [
    ("merge-pdf", "conversion", "pdf", "pdf", "merge-pdf", "PDF", "full"),
    ("sign-pdf", "conversion", "pdf", "pdf", "sign-pdf", "PDF", "full"),
    ("split-pdf", "conversion", "pdf", "pdf", "split-pdf", "PDF", "full"),
    ("compress-pdf", "conversion", "pdf", "pdf", "compress-pdf", "PDF", "full"),
    ("rotate-pdf", "conversion", "pdf", "pdf", "rotate-pdf", "PDF", "full"),
    ("pdf-to-jpg", "conversion", "pdf", "jpg", "pdf-to-jpg", "PDF", "full"),
    ("images-to-pdf", "conversion", "jpg,jpeg,png", "pdf", "images-to-pdf", "Images", "full"),
    ("docx-to-pdf", "conversion", "docx", "pdf", "docx-to-pdf", "Documents", "scoped"),
    ("pages-to-word", "conversion", "pages", "docx", "pages-to-word", "Documents", "scoped"),
    ("powerpoint-to-pdf", "conversion", "pptx", "pdf", "powerpoint-to-pdf", "Documents", "scoped"),
    ("keynote-to-powerpoint", "conversion", "keynote", "pptx", "keynote-to-powerpoint", "Documents", "scoped"),
    ("excel-to-pdf", "conversion", "xlsx", "pdf", "excel-to-pdf", "Documents", "scoped"),
    ("markdown-to-pdf", "conversion", "md,markdown", "pdf", "markdown-to-pdf", "Documents", "full"),
    ("pdf-to-markdown", "conversion", "pdf", "md", "pdf-to-markdown", "Documents", "scoped"),
    ("combine-to-pdf", "conversion", "pdf,docx,md,markdown,jpg,jpeg,png", "pdf", "combine-to-pdf", "Documents", "scoped"),
    ("pages-to-pdf", "conversion", "pages", "pdf", "pages-to-pdf", "Documents", "scoped"),
    ("keynote-to-pdf", "conversion", "keynote", "pdf", "keynote-to-pdf", "Documents", "scoped"),
    ("numbers-to-xlsx", "conversion", "numbers", "xlsx", "numbers-to-xlsx", "Documents", "scoped"),
    ("numbers-to-pdf", "conversion", "numbers", "pdf", "numbers-to-pdf", "Documents", "scoped"),
    ("embedded-pdf", "preview", "pages,keynote,numbers", "pdf-preview", "", "Documents", "scoped"),
]

# Id, allowed pair, native engine, fallback engine, status.
NATIVE_PAIRS = [
    ("docx-to-pdf-native", "docx>pdf", "word", "libreoffice", "helper-native"),
    ("doc-to-pdf", "doc>pdf", "word", "libreoffice", "helper-native"),
    ("pages-to-pdf-native", "pages>pdf", "pages", "", "helper-native"),
    ("pages-to-docx", "pages>docx", "pages", "", "helper-native"),
    ("pptx-to-pdf", "pptx>pdf", "powerpoint", "libreoffice", "helper-native"),
    ("key-to-pdf", "key>pdf", "keynote", "", "helper-beta"),
    ("key-to-pptx", "key>pptx", "keynote", "", "helper-beta"),
    ("numbers-to-pdf-native", "numbers>pdf", "numbers", "", "helper-native"),
    ("numbers-to-xlsx-native", "numbers>xlsx", "numbers", "", "helper-native"),
    ("xlsx-to-pdf", "xlsx>pdf", "excel", "libreoffice", "helper-native"),
]
# Legacy inputs the pptx and xlsx rows also cover.
EXTRA_PAIRS = [("ppt>pdf", "powerpoint", "libreoffice"), ("xls>pdf", "excel", "libreoffice")]

# Built-in number formats by id.
BUILTIN_NUMBER_FORMATS = [
    (14, "m/d/yy"),
    (15, "d-mmm-yy"),
    (16, "d-mmm"),
    (17, "mmm-yy"),
    (18, "h:mm AM/PM"),
    (19, "h:mm:ss AM/PM"),
    (20, "h:mm"),
    (21, "h:mm:ss"),
    (22, "m/d/yy h:mm"),
]


def _literal(value: object) -> str:
    if isinstance(value, int):
        return f"CAST({value} AS BIGINT)"
    return "'" + str(value).replace("'", "''") + "'"


def values_sql(rows: list[tuple], columns: str) -> str:
    """``SELECT * FROM (VALUES …)`` readable by Spark and by the oracle."""
    body = ", ".join("(" + ", ".join(_literal(v) for v in row) + ")" for row in rows)
    return f"SELECT * FROM (VALUES {body}) AS t({columns})"


KIND_RULES_SQL = values_sql(KIND_RULES, "kind, label, exts, mimes")
TOOL_RULES_SQL = values_sql(
    TOOL_RULES, "slug, accepts, accept_mime, max_files, max_file_bytes, max_total_bytes, category"
)
RETIRED_SQL = values_sql(RETIRED_SLUGS, "slug")
CAPABILITIES_SQL = values_sql(
    [(i, *row) for i, row in enumerate(CAPABILITIES)],
    "ord, id, kind, inputs, output, tool_slug, category, support",
)
ALLOWED_PAIRS_SQL = values_sql(
    [(p, e, f) for _, p, e, f, _ in NATIVE_PAIRS] + EXTRA_PAIRS, "pair, engine, fallback"
)
NUMBER_FORMATS_SQL = values_sql(BUILTIN_NUMBER_FORMATS, "num_fmt_id, code")


def kind_rules(spark: SparkSession) -> DataFrame:
    return spark.sql(KIND_RULES_SQL)


def tool_rules(spark: SparkSession) -> DataFrame:
    return spark.sql(TOOL_RULES_SQL)


def retired_slugs(spark: SparkSession) -> DataFrame:
    return spark.sql(RETIRED_SQL)


def capabilities(spark: SparkSession) -> DataFrame:
    return spark.sql(CAPABILITIES_SQL)


def allowed_pairs(spark: SparkSession) -> DataFrame:
    return spark.sql(ALLOWED_PAIRS_SQL)


def number_formats(spark: SparkSession) -> DataFrame:
    return spark.sql(NUMBER_FORMATS_SQL)
