"""Queries over the file table: inspection, names, limits, batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import dims
from ..functions import links as L
from ..functions import text as X
from ..operators import batch as B
from ..operators import errors as E
from ..operators import inspect as I
from ..operators.registry import registry_order as registry_order_of
from ..plans.intake import batch_plan
from . import recipes as R
from .registry import query, table

# ---- text status --------------------------------------------------------------

_TEXTS = """SELECT doc_id, CASE WHEN doc_id % 17 = 0 THEN '  ' || chr(9) || ' ' || chr(10)
  WHEN doc_id % 19 = 0 THEN text || {nul} || 'x' ELSE text END AS text FROM {docs}"""


@query(
    "scan_markdown_text",
    f"""SELECT doc_id, CASE WHEN NOT regexp_matches(text, '[^\\s]') THEN 'blank' WHEN contains(text, chr(0)) THEN 'binary'
    ELSE 'ok' END AS status FROM ({_TEXTS.format(nul="chr(0)", docs="documents")})""",
)
def scan_markdown_text(spark, sf):
    docs = table(spark, sf, "documents")
    blank = F.lit("  \t \n")
    text = (
        F.when(F.col("doc_id") % 17 == 0, blank)
        .when(F.col("doc_id") % 19 == 0, F.concat("text", F.lit("\0x")))
        .otherwise(F.col("text"))
    )
    return docs.select("doc_id", I.text_status(F.encode(text, "UTF-8")).alias("status"))


@query(
    "markdown_valid",
    f"""SELECT file_id, coalesce(regexp_matches(TRY(decode(content)), '[^\\s]') AND NOT contains(TRY(decode(content)), chr(0)), false)
    AS valid FROM ({R.BLOBS_DUCK})""",
)
def markdown_valid(spark, sf):
    return R.blobs(spark, sf).select("file_id", (I.text_status(F.col("content")) == "ok").alias("valid"))


# ---- signatures -----------------------------------------------------------------

_STEP_DUCK = """CASE WHEN size = 0 THEN 'empty' WHEN size > 104857600 THEN 'too-large' WHEN octet_length(content) = 0 THEN 'empty'
  WHEN hex(content) LIKE '255044462D%' THEN 'pdf' WHEN hex(content) LIKE 'FFD8FF%' THEN 'jpeg'
  WHEN hex(content) LIKE '89504E470D0A1A0A%' THEN 'png'
  WHEN lower(name) LIKE '%.md' OR lower(name) LIKE '%.markdown' OR mime = 'text/markdown' THEN 'markdown'
  WHEN hex(content) LIKE '504B0304%' THEN 'zip' ELSE 'unknown' END"""


@query("detect_kind", f"SELECT file_id, {_STEP_DUCK} AS step FROM ({R.BLOBS_DUCK})")
def detect_kind(spark, sf):
    step = I.detect_step(F.col("content"), F.col("name"), F.col("mime"), F.col("size"))
    return R.blobs(spark, sf).select("file_id", step.alias("step"))


_PDF_OK = "hex(content) LIKE '255044462D%' AND regexp_matches(hex(content), '^(?:..)*2525454F46')"
_JPEG_OK = "hex(content) LIKE 'FFD8FF%' AND octet_length(content) >= 4 AND hex(content) LIKE '%FFD9'"
_IHDR = "hex(content) LIKE '89504E470D0A1A0A________49484452%' AND octet_length(content) >= 33"
_W = f"CASE WHEN {_IHDR} THEN CAST(('0x' || substr(hex(content), 33, 8)) AS BIGINT) ELSE 0 END"
_H = f"CASE WHEN {_IHDR} THEN CAST(('0x' || substr(hex(content), 41, 8)) AS BIGINT) ELSE 0 END"
_PNG_OK = f"({_W}) > 0 AND ({_H}) > 0 AND regexp_matches(hex(content), '^(?:..)*49454E44')"
_MD_OK = "coalesce(regexp_matches(TRY(decode(content)), '[^\\s]') AND NOT contains(TRY(decode(content)), chr(0)), false)"


@query("pdf_envelope", f"SELECT file_id, {_PDF_OK} AS valid FROM ({R.BLOBS_DUCK})")
def pdf_envelope(spark, sf):
    return R.blobs(spark, sf).select("file_id", I.pdf_valid(F.col("content")).alias("valid"))


@query("jpeg_envelope", f"SELECT file_id, {_JPEG_OK} AS valid FROM ({R.BLOBS_DUCK})")
def jpeg_envelope(spark, sf):
    return R.blobs(spark, sf).select("file_id", I.jpeg_valid(F.col("content")).alias("valid"))


@query(
    "png_header",
    f"SELECT file_id, {_W} AS width, {_H} AS height, {_PNG_OK} AS valid FROM ({R.BLOBS_DUCK})",
)
def png_header(spark, sf):
    header = I.png_header(F.col("content"))
    return R.blobs(spark, sf).select(
        "file_id",
        header["width"].cast("long").alias("width"),
        header["height"].cast("long").alias("height"),
        header["valid"].alias("valid"),
    )


@query(
    "image_pixel_audit",
    f"""SELECT file_id, 'png' AS image_kind, CASE WHEN w > 0 AND h > 0 THEN w END AS width, CASE WHEN w > 0 AND h > 0 THEN h END AS height,
      coalesce(NOT (w > 0 AND h > 0) OR w * h > 24000000, true) AS over_pdf_cap,
      coalesce(NOT (w > 0 AND h > 0) OR w * h > 40000000, true) AS over_office_cap,
      coalesce(NOT (w > 0 AND h > 0) OR w > 4096 OR h > 4096 OR w * h > 16000000, true) AS over_stamp_cap
    FROM (SELECT file_id, {_W} AS w, {_H} AS h FROM
      (SELECT doc_id AS file_id, unhex('89504E470D0A1A0A0000000D49484452' || lpad(hex(n_chars), 8, '0') ||
        lpad(hex(n_chars * 3 % 9000), 8, '0') || '0806000000AABBCCDD49454E44') AS content FROM documents WHERE doc_id % 2 = 0))
    UNION ALL
    SELECT doc_id, 'jpeg', w, h, w * h > 24000000, w * h > 40000000, w > 4096 OR h > 4096 OR w * h > 16000000
    FROM (SELECT doc_id, 1 + n_chars % 65535 AS w, 1 + n_chars * 7 % 9000 AS h FROM documents WHERE doc_id % 2 = 1)""",
)
def image_pixel_audit(spark, sf):
    def hexed(value, width):
        return F.lpad(F.hex(value), width, "0")

    docs = table(spark, sf, "documents")
    chars = F.col("n_chars")
    png = F.concat(
        F.lit("89504E470D0A1A0A0000000D49484452"), hexed(chars, 8), hexed(chars * 3 % 9000, 8), F.lit("0806000000AABBCCDD49454E44")
    )

    # Metadata of the length of the text first, in as many segments as it takes, then
    # the frame header.
    def metadata(length):
        return F.concat(F.lit("FFE1"), hexed(length + 2, 4), F.repeat(F.lit("41"), length.cast("int")))

    most = F.lit(60000).cast("long")
    jpeg = F.concat(
        F.lit("FFD8"),
        F.repeat(metadata(most), F.floor(chars / most).cast("int")),
        metadata(chars % most),
        F.lit("FFC0000B08"),
        hexed(1 + chars * 7 % 9000, 4),
        hexed(1 + chars % 65535, 4),
        F.lit("0101110000FFD9"),
    )
    content = F.unhex(F.when(F.col("doc_id") % 2 == 0, png).otherwise(jpeg))
    return I.image_pixel_audit(docs.select(F.col("doc_id").alias("file_id"), content.alias("content")))


# ---- inspection rows --------------------------------------------------------------

_INSPECTED_DUCK = f"""SELECT b.*, coalesce(k.label, 'Unknown file') AS format_label,
    coalesce(list_contains(string_split(k.exts, ','), extension), false) AS extension_match,
    coalesce(list_contains(string_split(k.mimes, ','), mime), false) AS mime_match
  FROM (SELECT *, CASE WHEN step IN ('pdf','jpeg','png','markdown') THEN step ELSE 'unknown' END AS kind,
      lower(regexp_extract(name, '(\\.[A-Za-z0-9]+)$', 1)) AS extension,
      CASE step WHEN 'pdf' THEN {_PDF_OK} WHEN 'jpeg' THEN {_JPEG_OK} WHEN 'png' THEN {_PNG_OK} WHEN 'markdown' THEN {_MD_OK}
        ELSE false END AS valid
    FROM (SELECT *, {_STEP_DUCK} AS step FROM ({R.BLOBS_DUCK}))) AS b
  LEFT JOIN ({dims.KIND_RULES_SQL}) AS k ON k.kind = b.kind"""


@query(
    "type_mismatch",
    f"""SELECT file_id, kind, extension, extension_match, mime_match,
      array_to_string(list_filter([
        CASE WHEN step = 'empty' THEN 'malformed-content' WHEN step = 'too-large' THEN 'unsafe-container'
          WHEN kind <> 'unknown' AND NOT valid THEN 'malformed-content' END,
        CASE WHEN kind <> 'unknown' AND NOT extension_match THEN 'extension-mismatch' END,
        CASE WHEN kind <> 'unknown' AND mime <> '' AND NOT mime_match THEN 'mime-mismatch' END], lambda x: x IS NOT NULL), ',') AS warnings
    FROM ({_INSPECTED_DUCK})""",
)
def type_mismatch(spark, sf):
    out = I.inspect_files(R.blobs(spark, sf))
    return out.select("file_id", "kind", "extension", "extension_match", "mime_match", "warnings")


@query(
    "inspection_labels",
    f"""SELECT file_id, format_label, 'unknown' AS generation, CASE WHEN kind = 'unknown' THEN 'none' ELSE 'high' END AS confidence,
      CASE WHEN step IN ('empty','too-large') THEN 'rejected' WHEN step IN ('unknown','zip') OR valid THEN 'safe' ELSE 'rejected' END AS safety,
      step = 'zip' AS is_container, valid FROM ({_INSPECTED_DUCK})""",
)
def inspection_labels(spark, sf):
    out = I.inspect_files(R.blobs(spark, sf))
    return out.select("file_id", "format_label", "generation", "confidence", "safety", "is_container", "valid")


# ---- names, sizes -------------------------------------------------------------------


@query(
    "file_extension",
    f"""SELECT file_id, lower(regexp_extract(name, '(\\.[A-Za-z0-9]+)$', 1)) AS strict_ext,
      CASE WHEN contains(name, '.') THEN '.' || lower(split_part(name, '.', -1)) ELSE '' END AS loose_ext,
      CASE WHEN contains(name, '.') THEN lower(split_part(name, '.', -1)) ELSE '' END AS bare_ext FROM ({R.FILES_DUCK})""",
)
def file_extension(spark, sf):
    name = F.col("name")
    return R.files(spark, sf).select(
        "file_id",
        X.file_extension(name).alias("strict_ext"),
        X.loose_extension(name).alias("loose_ext"),
        X.bare_extension(name).alias("bare_ext"),
    )


_CAP_DUCK = """CASE WHEN regexp_matches(lower(name), '\\.(docx|pptx|xlsx)$') THEN 52428800
  WHEN regexp_matches(lower(name), '\\.(jpg|jpeg|png)$') THEN 26214400 WHEN regexp_matches(lower(name), '\\.(md|markdown)$') THEN 10485760
  ELSE 104857600 END"""


@query(
    "format_size_cap",
    f"SELECT file_id, CAST({_CAP_DUCK} AS BIGINT) AS cap, size <= {_CAP_DUCK} AS fits FROM ({R.FILES_DUCK})",
)
def format_size_cap(spark, sf):
    cap = B.format_cap(F.col("name"))
    return R.files(spark, sf).select("file_id", cap.alias("cap"), (F.col("size") <= cap).alias("fits"))


def duck_tidy(stem: str, junk: str, limit: int, fallback: str) -> str:
    return f"""coalesce(nullif(substr(regexp_replace(regexp_replace(regexp_replace({stem}, '{junk}', '-', 'g'), '-+', '-', 'g'),
      '^[.\\- ]+|[.\\- ]+$', '', 'g'), 1, {limit}), ''), '{fallback}')"""


def duck_safe_name(name: str) -> str:
    base = f"regexp_extract({name}, '([^/\\\\]*)$', 1)"
    return duck_tidy(f"trim(regexp_replace({base}, '\\.[A-Za-z0-9]+$', ''))", "[^\\w\\-. ()\\[\\]]+", 120, "output")


_REQUEST_NAME_DUCK = duck_tidy(
    "regexp_replace(trim(regexp_extract(name, '([^/\\\\]*)$', 1)), '^\\.+', '')", "[^A-Za-z0-9._\\- ()\\[\\]]+", 100, "document"
)


@query(
    "safe_file_name",
    f"SELECT file_id, {duck_safe_name('name')} AS safe_name, {_REQUEST_NAME_DUCK} AS request_name FROM ({R.FILES_DUCK})",
)
def safe_file_name(spark, sf):
    return R.files(spark, sf).select(
        "file_id",
        X.safe_file_name(F.col("name")).alias("safe_name"),
        X.safe_request_name(F.col("name")).alias("request_name"),
    )


def duck_format_bytes(size: str) -> str:
    unit = f"CASE WHEN {size} < 1048576 THEN CAST(1024 AS BIGINT) WHEN {size} < 1073741824 THEN 1048576 ELSE 1073741824 END"
    label = f"CASE WHEN {size} < 1048576 THEN 'KB' WHEN {size} < 1073741824 THEN 'MB' ELSE 'GB' END"
    value = f"(CAST({size} AS DECIMAL(30,15)) / ({unit}))"
    return f"""CASE WHEN {size} IS NULL OR {size} < 0 THEN '0 B' WHEN {size} < 1024 THEN {size} || ' B' ELSE
      (CASE WHEN {size} % ({unit}) = 0 THEN CAST({size} // ({unit}) AS VARCHAR)
        WHEN {size} >= 100 * ({unit}) THEN CAST(CAST(round({value}, 0) AS BIGINT) AS VARCHAR)
        WHEN {size} >= 10 * ({unit}) THEN printf('%.1f', round({value}, 1)) ELSE printf('%.2f', round({value}, 2)) END) || ' ' || ({label}) END"""


@query("format_bytes", f"SELECT file_id, {duck_format_bytes('size')} AS label FROM ({R.FILES_DUCK})")
def format_bytes(spark, sf):
    return R.files(spark, sf).select("file_id", X.format_bytes(F.col("size")).alias("label"))


def duck_change(before: str, after: str) -> str:
    pct = f"(({after} - {before}) / CAST({before} AS DOUBLE) * 100)"
    return f"""CASE WHEN {before} <= 0 THEN '—' ELSE (CASE WHEN {pct} > 0 THEN '+' WHEN {pct} < 0 THEN '-' ELSE '' END)
      || printf('%.1f', floor(abs({pct}) * 10 + 0.5) / 10) || '%' END"""


_AFTER = "(size * (60 + file_id % 55)) // 100"


@query("percent_change", f"SELECT file_id, {duck_change('size', _AFTER)} AS change FROM ({R.FILES_DUCK})")
def percent_change(spark, sf):
    after = F.floor(F.col("size") * (60 + F.col("file_id") % 55) / 100)
    return R.files(spark, sf).select("file_id", X.percent_change(F.col("size"), after).alias("change"))


@query(
    "compression_report",
    f"""SELECT file_id, size AS before_bytes, {_AFTER} AS after_bytes, {duck_format_bytes('size')} AS before_label,
      {duck_format_bytes(_AFTER)} AS after_label, {duck_change('size', _AFTER)} AS change FROM ({R.FILES_DUCK})""",
)
def compression_report(spark, sf):
    files = R.files(spark, sf).select(
        "file_id",
        F.col("size").alias("before_bytes"),
        F.floor(F.col("size") * (60 + F.col("file_id") % 55) / 100).alias("after_bytes"),
    )
    return B.compression_report(files)


_ACTIONS = ["merge-pdf", "split-pdf", "images-to-pdf", "docx-to-pdf", "combine-to-pdf", "pdf-to-markdown", "rotate-pdf",
            "compress-pdf", "pdf-to-jpg", "excel-to-pdf"]
_ACTION_CASE = "CASE n % 10 " + " ".join(f"WHEN {i} THEN '{a}'" for i, a in enumerate(_ACTIONS)) + " END"


@query(
    "output_name_plan",
    f"""WITH b AS (SELECT batch_id, count(*) AS file_count, arg_min(name, pos) AS first_name, min(pos) AS n FROM ({R.FILES_DUCK}) GROUP BY batch_id),
    c AS (SELECT *, {_ACTION_CASE} AS action, {duck_safe_name('first_name')} AS stem FROM b)
    SELECT batch_id, action, CASE WHEN action = 'images-to-pdf' AND file_count > 1 THEN 'images.pdf'
      WHEN action = 'docx-to-pdf' AND file_count > 1 THEN 'word-documents.pdf' WHEN action = 'combine-to-pdf' THEN 'combined-documents.pdf'
      WHEN action = 'pdf-to-jpg' THEN stem || '-p1.jpg'
      ELSE {duck_safe_name('''(stem || CASE action WHEN 'merge-pdf' THEN '-merged' WHEN 'split-pdf' THEN '-pages-1-' || file_count
        WHEN 'rotate-pdf' THEN '-rotated-90' WHEN 'compress-pdf' THEN '-optimized' ELSE '' END)''')}
        || CASE WHEN action = 'pdf-to-markdown' THEN '.md' ELSE '.pdf' END END AS output_name FROM c""",
)
def output_name_plan(spark, sf):
    batches = R.files(spark, sf).groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("file_count"), F.min_by("name", "pos").alias("first_name"), F.min("pos").alias("n")
    )
    batches = batches.select(
        "batch_id",
        "file_count",
        "first_name",
        F.expr(_ACTION_CASE).alias("action"),
        F.lit("1").alias("first_page"),
        F.col("file_count").cast("string").alias("last_page"),
        F.lit("90").alias("degrees"),
    )
    return B.output_names(batches).select("batch_id", "action", "output_name")


# ---- errors, requests ------------------------------------------------------------------


# Families of this catalog's own messages (recipes.MESSAGES); the operator takes any.
FAMILIES = [
    ("(?i)stream ended early", "file-read"),
    ("(?i)page tree", "invalid-pdf"),
    ("(?i)bytes are no text", "invalid-markdown"),
    ("(?i)pixels|picture", "invalid-image"),
    ("(?i)word part", "invalid-docx"),
    ("(?i)no drawing surface", "browser-capability"),
    (r"(?i)^too (?:few|many)\b|^nothing\b", "input"),
]


@query(
    "classify_errors",
    "SELECT code, count(*) AS n FROM (SELECT CASE WHEN error_class = 'read' THEN 'file-read' WHEN error_class = 'archive' THEN "
    + "CASE WHEN archive_code IN ('ARCHIVE_UNSAFE_PATH','ARCHIVE_DUPLICATE_PATH') THEN 'unsafe-container' ELSE 'invalid-container' END "
    + " ".join(f"WHEN regexp_matches(message, '{p}') THEN '{c}'" for p, c in FAMILIES)
    + f" ELSE 'unknown' END AS code FROM ({R.MESSAGES_DUCK})) GROUP BY code",
)
def classify_errors(spark, sf):
    return E.classify_errors(R.messages(spark, sf), FAMILIES)


@query(
    "request_validation",
    f"""SELECT r.request_id, CASE WHEN from_fmt = '' OR to_fmt = '' THEN 'missing-format' WHEN p.pair IS NULL THEN 'pair-not-allowed'
      WHEN content_len = 0 THEN 'missing-content' WHEN content_len > 140000000 THEN 'too-large'
      WHEN contains(filename, '.') AND split_part(filename, '.', -1) <> lower(from_fmt) THEN 'extension-mismatch' END AS error_code
    FROM ({R.REQUESTS_DUCK}) AS r LEFT JOIN ({dims.ALLOWED_PAIRS_SQL}) AS p ON p.pair = lower(from_fmt) || '>' || lower(to_fmt)""",
)
def request_validation(spark, sf):
    return B.request_validation(R.requests(spark, sf)).select("request_id", "error_code")


@query(
    "route_assignment",
    f"""SELECT request_id, split_part(route, ':', 1) AS via, split_part(route, ':', 2) AS detail FROM (
    SELECT request_id, CASE WHEN p.pair IS NULL THEN CASE WHEN browser_ok THEN 'browser:pair-not-native' ELSE 'blocked:unsupported-pair' END
      WHEN NOT is_mac THEN CASE WHEN browser_ok AND fallback_ok THEN 'browser:needs-mac' ELSE 'blocked:needs-mac' END
      WHEN NOT connected OR engine_list = '' THEN CASE WHEN browser_ok AND fallback_ok THEN 'browser:helper-off' ELSE 'blocked:helper-off' END
      WHEN list_contains(string_split(engine_list, ','), p.engine) THEN 'helper-native:' || p.engine
      WHEN p.engine IN ('word','powerpoint','excel') AND contains(engine_list, 'libreoffice') THEN 'helper-fallback:libreoffice'
      WHEN browser_ok AND fallback_ok THEN 'browser:app-missing' ELSE 'blocked:app-missing' END AS route
    FROM ({R.REQUESTS_DUCK}) AS r LEFT JOIN ({dims.ALLOWED_PAIRS_SQL}) AS p ON p.pair = lower(from_fmt) || '>' || lower(to_fmt))""",
)
def route_assignment(spark, sf):
    requests = R.requests(spark, sf).withColumn(
        "engines", F.when(F.col("engine_list") != "", F.split("engine_list", ","))
    )
    return B.route_assignment(requests).select("request_id", "via", "detail")


# ---- links and origins ----------------------------------------------------------------------

# An example allow-list; the operator takes any.
ORIGINS = ["https://thther.example.org", "http://ththre.example.com", "https://www.example.com"]
ORIGIN_SUFFIX = ".example.net"

_TARGETS = """SELECT page_id, CASE page_id % 9 WHEN 0 THEN url WHEN 1 THEN 'mailto:a@b.example' WHEN 2 THEN '#top' WHEN 3 THEN '//cdn.example/x'
  WHEN 4 THEN '/local/path' WHEN 5 THEN 'javascript:void(0)' WHEN 6 THEN 'data:image/png;base64,QUJD'
  WHEN 7 THEN 'blob:' || url ELSE '../media/image' || CAST(page_id AS STRING) || '.png' END AS target,
  CASE WHEN page_id % 11 = 0 THEN 'External' ELSE NULL END AS mode FROM <pages>"""


@query(
    "link_policy",
    f"""SELECT page_id, regexp_matches(target, '(?i)^(https?://|mailto:|#|/$|/[^/])') AS href_ok,
      regexp_matches(target, '(?i)^(blob:|data:image/(png|jpe?g|gif|webp);base64,[a-z0-9+/=\\s]+$)') AS image_ok,
      regexp_matches(target, '(?i)^(https?:|mailto:)') AS extracted_ok FROM ({R.duck(_TARGETS)})""",
)
def link_policy(spark, sf):
    target = F.col("target")
    return R.run(spark, sf, _TARGETS, "pages").select(
        "page_id",
        L.safe_href(target).isNotNull().alias("href_ok"),
        L.safe_image_source(target).isNotNull().alias("image_ok"),
        L.safe_extracted_link(target).isNotNull().alias("extracted_ok"),
    )


@query(
    "external_target",
    f"""SELECT page_id, lower(coalesce(mode, '')) = 'external' OR regexp_matches(target, '(?i)^([a-z][a-z0-9+.-]*:|//)') AS is_external
    FROM ({R.duck(_TARGETS)})""",
)
def external_target(spark, sf):
    return R.run(spark, sf, _TARGETS, "pages").select(
        "page_id", L.is_external_target(F.col("target"), F.col("mode")).alias("is_external")
    )


@query(
    "origin_policy",
    f"""SELECT page_id, scheme || '://' || host IN ({", ".join(f"'{o}'" for o in ORIGINS)})
      OR (scheme = 'https' AND ends_with(host, '{ORIGIN_SUFFIX}') AND NOT contains(host, '..') AND len(string_split(host, '.')) >= 3
        AND len(list_filter(string_split(host, '.'), lambda x: x = '')) = 0) AS allowed
    FROM (SELECT page_id, split_part(url, '://', 1) AS scheme, regexp_extract(url, '://([^/?#]+)', 1) AS host FROM pages)""",
)
def origin_policy(spark, sf):
    return table(spark, sf, "pages").select(
        "page_id", L.is_allowed_origin(F.col("url"), ORIGINS, ORIGIN_SUFFIX).alias("allowed")
    )


# ---- batches -----------------------------------------------------------------------------------

# Kinds straight from the extension, so that batches mix.
_KINDED = f"""SELECT file_id, batch_id, pos, name, size, CASE lower(regexp_extract(name, '([.][A-Za-z0-9]+)$', 1)) WHEN '.pdf' THEN 'pdf'
  WHEN '.jpg' THEN 'jpeg' WHEN '.jpeg' THEN 'jpeg' WHEN '.png' THEN 'png' WHEN '.docx' THEN 'docx' WHEN '.md' THEN 'markdown'
  WHEN '.pptx' THEN 'pptx' WHEN '.xlsx' THEN 'xlsx' WHEN '.pages' THEN 'pages' ELSE 'unknown' END AS kind, file_id % 3 = 0 AS has_preview,
  size > 0 AS valid FROM ({R.FILES}) AS f"""
_KINDED_DUCK = R.duck(_KINDED)
# Small batches: up to three neighbours of one kind modulus.
_SMALL = "file_id % 11 || '/' || CAST(floor(file_id / 33) AS INT)"
_SMALL_SPARK = "concat(file_id % 11, '/', CAST(floor(file_id / 33) AS INT))"


@query(
    "batch_actions",
    f"""WITH k AS (SELECT {_SMALL} AS batch_id, kind, has_preview FROM ({_KINDED_DUCK}) UNION ALL SELECT batch_id, kind, has_preview FROM ({_KINDED_DUCK})),
    b AS (SELECT batch_id, count(*) AS n, list_sort(list(DISTINCT kind)) AS kinds, bool_or(has_preview) AS preview FROM k GROUP BY batch_id)
    SELECT batch_id, n AS file_count, array_to_string(kinds, ',') AS kinds, CASE
      WHEN n = 1 AND kinds[1] = 'pages' THEN CASE WHEN preview THEN 'embedded-pdf,' ELSE '' END || 'pages-to-pdf,pages-to-word'
      WHEN n = 1 AND kinds[1] = 'pptx' THEN 'powerpoint-to-pdf' WHEN n = 1 AND kinds[1] = 'xlsx' THEN 'excel-to-pdf'
      WHEN len(list_filter(kinds, lambda x: x NOT IN ('pdf','docx','markdown','jpeg','png'))) > 0 THEN ''
      WHEN len(kinds) = 1 AND kinds[1] = 'pdf' AND n > 1 THEN 'merge-pdf'
      WHEN len(kinds) = 1 AND kinds[1] = 'pdf' THEN 'merge-pdf,sign-pdf,split-pdf,rotate-pdf,compress-pdf,pdf-to-jpg,pdf-to-markdown'
      WHEN len(kinds) = 1 AND kinds[1] = 'docx' THEN 'docx-to-pdf'
      WHEN len(list_filter(kinds, lambda x: x NOT IN ('jpeg','png'))) = 0 THEN 'image-to-pdf'
      WHEN n = 1 AND kinds[1] = 'markdown' THEN 'markdown-to-pdf' ELSE 'combine-to-pdf' END AS actions FROM b""",
)
def batch_actions(spark, sf):
    files = R.run(spark, sf, _KINDED, "documents")
    both = files.select(F.expr(_SMALL_SPARK).alias("batch_id"), "kind", "has_preview").unionByName(
        files.select("batch_id", "kind", "has_preview")
    )
    return B.batch_actions(both)


@query(
    "batch_gate",
    f"""SELECT batch_id, bool_and(ok) AS batch_ok, count(*) FILTER (NOT ok) AS offenders, arg_min(name, pos) FILTER (NOT ok) AS first_offender
    FROM (SELECT {_SMALL} AS batch_id, pos, name, valid AND kind IN ('pdf','jpeg','png','docx','markdown') AS ok FROM ({_KINDED_DUCK})) GROUP BY batch_id""",
)
def batch_gate(spark, sf):
    files = R.run(spark, sf, _KINDED, "documents").withColumn("batch_id", F.expr(_SMALL_SPARK))
    return B.batch_gate(files, B.COMBINABLE)


@query(
    "batch_totals",
    f"""SELECT batch_id, count(*) AS file_count, CAST(sum(size) AS BIGINT) AS total_bytes, count(*) > 20 AS too_many, sum(size) > 157286400 AS too_large
    FROM ({R.FILES_DUCK}) GROUP BY batch_id""",
)
def batch_totals(spark, sf):
    return B.batch_totals(R.files(spark, sf), dims.MAX_DROP_FILES, dims.MAX_DROP_BYTES)


_SLUG = "CASE length(batch_id) % 3 + file_id * 0 WHEN 0 THEN 'combine-to-pdf' WHEN 1 THEN 'images-to-pdf' ELSE 'no-such-tool' END"
_FOLD_DUCK = """list_reduce(list_sort(list({{'pos': pos, 'size': size, 'ok': own IS NULL, 'why': own, 'cap': cap, 'most': most}})),
    lambda s, x: CASE WHEN len(s.why) >= 0 AND s.n >= x.most THEN
        {{'n': s.n, 'b': s.b, 'pos': list_append(s.pos, x.pos), 'why': list_append(s.why, 'count')}}
      WHEN NOT x.ok THEN {{'n': s.n, 'b': s.b, 'pos': list_append(s.pos, x.pos), 'why': list_append(s.why, x.why)}}
      WHEN s.b + x.size > x.cap THEN {{'n': s.n, 'b': s.b, 'pos': list_append(s.pos, x.pos), 'why': list_append(s.why, 'total')}}
      ELSE {{'n': s.n + 1, 'b': s.b + x.size, 'pos': list_append(s.pos, x.pos), 'why': list_append(s.why, CAST(NULL AS VARCHAR))}} END,
    {{'n': CAST(0 AS BIGINT), 'b': CAST(0 AS BIGINT), 'pos': CAST([] AS BIGINT[]), 'why': CAST([] AS VARCHAR[])}})""".replace("{{", "{").replace("}}", "}")


@query(
    "accept_files",
    f"""WITH f AS (SELECT f.*, CASE WHEN t.slug IS NULL THEN 'unknown-tool' WHEN NOT (list_contains(string_split(t.accept_mime, ','), f.mime) OR list_contains(string_split(t.accepts, ','),
        CASE WHEN contains(name, '.') THEN '.' || lower(split_part(name, '.', -1)) ELSE '' END)) THEN 'type'
        WHEN size = 0 THEN 'empty' WHEN size > t.max_file_bytes THEN 'file-size' END AS own, coalesce(t.max_total_bytes, 0) AS cap, coalesce(t.max_files, 1) AS most
      FROM (SELECT *, {_SLUG} AS slug FROM ({R.FILES_DUCK})) AS f LEFT JOIN ({dims.TOOL_RULES_SQL}) AS t ON t.slug = f.slug),
    r AS (SELECT batch_id, {_FOLD_DUCK} AS s FROM f GROUP BY batch_id)
    SELECT batch_id, pos AS file_id, why IS NULL AS accepted, why AS reason FROM (SELECT batch_id, unnest(s.pos) AS pos, unnest(s.why) AS why FROM r)""",
)
def accept_files(spark, sf):
    files = R.files(spark, sf).drop("text").withColumn("slug", F.expr(_SLUG))
    return B.accept_files(files).select("batch_id", "file_id", "accepted", "reason")


@query(
    "accept_drop",
    f"""WITH f AS (SELECT *, CASE WHEN size > {_CAP_DUCK} THEN 'format-size' END AS own, CAST(157286400 AS BIGINT) AS cap, CAST(20 AS BIGINT) AS most
      FROM ({R.FILES_DUCK})),
    r AS (SELECT batch_id, {_FOLD_DUCK} AS s FROM f GROUP BY batch_id)
    SELECT batch_id, pos AS file_id, why IS NULL AS accepted, why AS reason FROM (SELECT batch_id, unnest(s.pos) AS pos, unnest(s.why) AS why FROM r)""",
)
def accept_drop(spark, sf):
    return B.accept_drop(R.files(spark, sf).drop("text")).select("batch_id", "file_id", "accepted", "reason")


# ---- registry joins ---------------------------------------------------------------------------------

_CAPS_DUCK = f"""SELECT DISTINCT id, ord, output, tool_slug, CASE token WHEN 'jpg' THEN 'jpeg' WHEN 'md' THEN 'markdown' ELSE token END AS kind
  FROM (SELECT id, ord, output, tool_slug, unnest(string_split(inputs, ',')) AS token FROM ({dims.CAPABILITIES_SQL}))"""


@query(
    "capability_lookup",
    f"SELECT f.file_id, f.kind, c.id AS capability, c.output FROM ({_KINDED_DUCK}) AS f JOIN ({_CAPS_DUCK}) AS c ON c.kind = f.kind",
)
def capability_lookup(spark, sf):
    kinds = R.run(spark, sf, _KINDED, "documents").select("file_id", "kind")
    return B.capability_lookup(kinds).select("file_id", "kind", F.col("id").alias("capability"), "output")


_WANTED = """SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'image-to-pdf' WHEN 1 THEN 'word-to-pdf' WHEN 2 THEN 'excel-to-pdf' WHEN 3 THEN 'merge-pdf'
  WHEN 4 THEN 'fax-to-pdf' ELSE 'numbers-to-excel' END AS action FROM <documents>"""


@query(
    "slug_lookup",
    f"""SELECT doc_id, a.slug, category, max_files, CASE WHEN category IS NOT NULL THEN 'live' WHEN a.slug IN ('word-to-pdf','numbers-to-excel')
      THEN 'retired' ELSE 'unknown' END AS slug_status
    FROM (SELECT doc_id, CASE action WHEN 'image-to-pdf' THEN 'images-to-pdf' ELSE action END AS slug FROM ({R.duck(_WANTED)})) AS a
    LEFT JOIN ({dims.TOOL_RULES_SQL}) AS t ON t.slug = a.slug""",
)
def slug_lookup(spark, sf):
    out = B.slug_lookup(R.run(spark, sf, _WANTED, "documents"))
    return out.select("doc_id", "slug", "category", "max_files", "slug_status")


@query(
    "dedup_snapshot",
    """SELECT doc_id AS file_id, source AS batch_id, sha256(text) AS digest, count(*) OVER (PARTITION BY text) AS copies,
      min(doc_id) OVER (PARTITION BY text) AS first_file, octet_length(encode(text)) AS bytes, 'ok' AS status FROM documents""",
)
def dedup_snapshot(spark, sf):
    files = table(spark, sf, "documents").select(
        F.col("doc_id").alias("file_id"), F.col("source").alias("batch_id"), F.col("doc_id").alias("pos"), "text"
    )

    out = B.dedup_snapshot(
        files,
        F.sha2(F.encode("text", "UTF-8"), 256),
        {"bytes": F.octet_length("text").cast("long"), "status": I.plain_text_status(F.col("text"))},
    )
    return out.select("file_id", "batch_id", "digest", "copies", "first_file", "bytes", "status")


# ---- inventories, sets -----------------------------------------------------------------------------------


@query(
    "inventory",
    f"""WITH f AS (SELECT file_id, size FROM ({R.FILES_DUCK}))
    SELECT count(*) AS file_count, CAST(sum(size) AS BIGINT) AS total_bytes,
      (SELECT string_agg(CAST(file_id AS VARCHAR), ',' ORDER BY size DESC, file_id) FROM (SELECT * FROM f ORDER BY size DESC, file_id LIMIT 12)) AS largest
    FROM f""",
)
def inventory(spark, sf):
    from ..operators.quality import inventory as summary

    return summary(R.files(spark, sf), k=12)


@query("top_n_files", f"SELECT file_id, name, size FROM ({R.FILES_DUCK}) ORDER BY size DESC, file_id LIMIT 12")
def top_n_files(spark, sf):
    return R.files(spark, sf).select("file_id", "name", "size").orderBy(F.desc("size"), "file_id").limit(12)


@query(
    "exactly_once",
    f"""WITH g AS (SELECT file_id FROM ({_KINDED_DUCK}) WHERE kind <> 'unknown' UNION ALL SELECT file_id FROM ({_KINDED_DUCK}) WHERE kind = 'pdf' AND valid)
    SELECT f.file_id, count(g.file_id) AS times FROM ({R.FILES_DUCK}) AS f LEFT JOIN g ON g.file_id = f.file_id GROUP BY f.file_id HAVING count(g.file_id) <> 1""",
)
def exactly_once(spark, sf):
    kinded = R.run(spark, sf, _KINDED, "documents")
    groups = kinded.where(F.col("kind") != "unknown").select("file_id").unionByName(
        kinded.where((F.col("kind") == "pdf") & F.col("valid")).select("file_id")
    )
    return B.exactly_once(groups, kinded, "file_id")


@query(
    "registry_reconcile",
    f"""WITH l AS (SELECT name || CASE WHEN file_id % 10 = 0 THEN '.old' ELSE '' END AS name, kind FROM ({_KINDED_DUCK})),
    r AS (SELECT name || CASE WHEN file_id % 15 = 0 THEN '.new' ELSE '' END AS name, CASE WHEN file_id % 25 = 0 THEN 'other' ELSE kind END AS kind FROM ({_KINDED_DUCK}))
    SELECT name, kind, 'left' AS side FROM (SELECT * FROM l EXCEPT ALL SELECT * FROM r)
    UNION ALL SELECT name, kind, 'right' FROM (SELECT * FROM r EXCEPT ALL SELECT * FROM l)""",
)
def registry_reconcile(spark, sf):
    kinded = R.run(spark, sf, _KINDED, "documents")
    fid = F.col("file_id")
    left = kinded.select(F.concat("name", F.when(fid % 10 == 0, ".old").otherwise("")).alias("name"), "kind")
    right = kinded.select(
        F.concat("name", F.when(fid % 15 == 0, ".new").otherwise("")).alias("name"),
        F.when(fid % 25 == 0, "other").otherwise(F.col("kind")).alias("kind"),
    )
    return B.registry_reconcile(left, right)


# The smallest set of moved ids has no SQL form; tests hold it against brute force.
@query("registry_order")
def registry_order(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("source").alias("registry"), F.col("doc_id").alias("id"))
    fid = F.col("id")
    expected = docs.where(fid % 35 != 6).withColumn("pos", fid)
    # Every twentieth id a stretch further down, some left out, some listed again.
    placed = docs.where(fid % 45 != 5).withColumn("pos", 4 * fid + F.when(fid % 20 == 3, 802).otherwise(0))
    again = docs.where((fid % 70 == 9) & (fid % 45 != 5)).withColumn("pos", 4 * fid + 1)
    retired = docs.where(fid % 90 == 7)
    return registry_order_of(expected, placed.unionByName(again), retired)


@query(
    "batch_plan",
    f"""WITH i AS ({_INSPECTED_DUCK}),
    f AS (SELECT *, CASE WHEN size > {_CAP_DUCK} THEN 'format-size' END AS own, CAST(157286400 AS BIGINT) AS cap, CAST(20 AS BIGINT) AS most FROM i),
    r AS (SELECT batch_id, {_FOLD_DUCK} AS s FROM f GROUP BY batch_id),
    a AS (SELECT batch_id, pos FROM (SELECT batch_id, unnest(s.pos) AS pos, unnest(s.why) AS why FROM r) WHERE why IS NULL),
    j AS (SELECT i.* FROM i JOIN a ON a.batch_id = i.batch_id AND a.pos = i.pos)
    SELECT batch_id, count(*) AS file_count, CAST(sum(size) AS BIGINT) AS total_bytes, array_to_string(list_sort(list(DISTINCT kind)), ',') AS kinds,
      bool_and(valid AND kind IN ('pdf','jpeg','png','docx','markdown')) AS batch_ok,
      arg_min(name, pos) FILTER (NOT (valid AND kind IN ('pdf','jpeg','png','docx','markdown'))) AS first_offender,
      CASE WHEN NOT bool_and(valid AND safety = 'safe') THEN '' WHEN bool_and(kind = 'pdf') AND count(*) = 1 THEN
        'merge-pdf,sign-pdf,split-pdf,rotate-pdf,compress-pdf,pdf-to-jpg,pdf-to-markdown'
        WHEN bool_and(kind = 'pdf') THEN 'merge-pdf' WHEN bool_and(kind IN ('jpeg','png')) THEN 'image-to-pdf'
        WHEN count(*) = 1 AND bool_and(kind = 'markdown') THEN 'markdown-to-pdf' ELSE 'combine-to-pdf' END AS actions
    FROM (SELECT *, CASE WHEN step IN ('empty','too-large') THEN 'rejected' WHEN step IN ('unknown','zip') OR valid THEN 'safe' ELSE 'rejected' END AS safety FROM j)
    GROUP BY batch_id""",
)
def batch_plan_query(spark, sf):
    return batch_plan(R.blobs(spark, sf).drop("empty_file"))


# ---- scalar surface -------------------------------------------------------------------------------------


@query(
    "scalar_numbers",
    f"""SELECT file_id, CAST(greatest(3.0, least(80.0, size / 65536.0)) AS DOUBLE) AS clamped,
      greatest(1, CAST(floor(file_id * 12700 / 7.0 + 0.5) AS BIGINT)) AS emus, greatest(1440, least(31680, CAST(floor(file_id * 20 + 0.5) AS BIGINT))) AS twips,
      round(file_id * 31 / 12700.0, 6) AS points, file_id % 4 IN (0, 1, 2) AS flag, CASE WHEN file_id % 3 = 0 THEN CAST(file_id AS DOUBLE) ELSE 7.0 END AS finite FROM ({R.FILES_DUCK})""",
)
def scalar_numbers(spark, sf):
    fid = F.col("file_id")
    flag = F.when(fid % 4 == 0, "1").when(fid % 4 == 1, "true").when(fid % 4 == 2, "on").otherwise("off")
    text = F.when(fid % 3 == 0, fid.cast("string")).when(fid % 3 == 1, "x1").otherwise("Infinity")
    return R.files(spark, sf).select(
        "file_id",
        X.clamp(F.col("size") / 65536, 3, 80, 10).alias("clamped"),
        X.points_to_emu(fid / 7).alias("emus"),
        X.points_to_twips(fid).alias("twips"),
        F.round(X.emu_to_points((fid * 31).cast("string")), 6).alias("points"),
        X.to_flag(flag).alias("flag"),
        X.finite_or(text, 7).alias("finite"),
    )


@query(
    "scalar_binary",
    f"""SELECT file_id, CASE WHEN file_id % 3 = 0 THEN upper(substr(md5(text), 1, 6)) ELSE '111827' END AS colour,
      CASE file_id % 5 WHEN 0 THEN upper(substr(md5(text), 1, 6)) WHEN 1 THEN upper(repeat(substr(md5(text), 1, 1), 2) || repeat(substr(md5(text), 2, 1), 2) || repeat(substr(md5(text), 3, 1), 2))
        WHEN 2 THEN '0C' || lpad(hex(file_id % 256), 2, '0') || 'FF' WHEN 3 THEN '010203' ELSE '1A1F26' END AS css, octet_length(content) AS bytes,
      CASE WHEN octet_length(content) >= 2 THEN CAST('0x' || substr(hex(content), 1, 4) AS BIGINT) END AS u16, md5(text) AS round_trip
    FROM (SELECT doc_id AS file_id, text, encode(text) AS content FROM documents)""",
)
def scalar_binary(spark, sf):
    content = F.encode("text", "UTF-8")
    digest = F.md5(content)
    colour = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("#"), F.substring(digest, 1, 6))).otherwise("rgb(1,2,3)")
    n, fid = F.pmod("doc_id", F.lit(256)).cast("string"), F.col("doc_id") % 5
    css = (
        F.when(fid == 0, F.concat(F.lit(" #"), F.substring(digest, 1, 6)))
        .when(fid == 1, F.concat(F.lit("#"), F.substring(digest, 1, 3)))
        .when(fid == 2, F.concat(F.lit("rgba(11.6, "), n, F.lit(", 999, 0.5)")))
        .when(fid == 3, "RGB(1 2 3)")
        .otherwise("#12")
    )
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("file_id"),
        X.hex_colour(colour).alias("colour"),
        X.css_colour(css).alias("css"),
        F.octet_length(content).cast("long").alias("bytes"),
        F.when(F.octet_length(content) >= 2, I.big_endian(content, 0, 2)).alias("u16"),
        F.md5(F.unbase64(F.base64(content))).alias("round_trip"),
    )
