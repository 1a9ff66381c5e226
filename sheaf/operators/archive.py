"""Archive limits, container kinds, embedded-content rules, relationships.

Everything reads the ``dir`` column made by ``sources.archive.with_directory``
and stays in the row of the archive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dims
from ..functions.links import is_external_target
from ..functions.text import file_extension
from ..sources.archive import MALFORMED, ZIP64, part_rows, with_directory
from .inspect import PDF_HEAD, has_pdf_end, starts_with


def safe_path(path: Column) -> Column:
    """Path with forward slashes, null when it could lead out of a folder."""
    plain = F.translate(path, "\\", "/")
    bad = (plain == "") | plain.rlike(r"[\x00-\x1F]") | plain.rlike(r"^/|^[A-Za-z]:/") | plain.rlike(r"(?:^|/)\.\.?(?:/|\z)")
    return F.when(~bad, plain)


def first_violation(entries: Column, paths: Column, limits: dict[str, int]) -> Column:
    """Code of the first rule broken, in entry order; null for a clean archive.

    ``paths``: the safe paths of the entries, null where unsafe.
    """
    repeated = F.size(F.array_distinct(paths)) < F.size(paths)
    start = F.struct(
        F.lit(0).cast("long").alias("total"), F.lit(0).alias("i"), F.lit(None).cast("string").alias("code"), repeated.alias("dup")
    )

    def step(s: Column, e: Column) -> Column:
        path = F.get(paths, s["i"])
        code = (
            F.when(e["broken"].isNotNull(), e["broken"])
            .when(e["flags"] % 2 == 1, "ARCHIVE_ENCRYPTED")
            .when((e["disk"] != 0) | e["offset"].isin(0xFFFF, 0xFFFFFFFF), ZIP64)
            .when(~e["method"].isin(0, 8), "ARCHIVE_UNSUPPORTED_COMPRESSION")
            .when(e["usize"] > limits["entry_bytes"], "ARCHIVE_ENTRY_TOO_LARGE")
            .when(e["usize"] > e["csize"] * limits["ratio"], "ARCHIVE_COMPRESSION_RATIO")
            .when(e["usize"] > F.lit(limits["total_bytes"]) - s["total"], "ARCHIVE_TOO_COMPLEX")
            .when(e["path"].isNull(), MALFORMED)
            .when(path.isNull(), "ARCHIVE_UNSAFE_PATH")
            .when(s["dup"] & (F.array_position(paths, path) <= s["i"]), "ARCHIVE_DUPLICATE_PATH")
        )
        return F.when(s["code"].isNotNull(), s).otherwise(
            F.struct((s["total"] + F.coalesce(e["usize"], F.lit(0))).alias("total"), (s["i"] + 1).alias("i"), code.alias("code"), s["dup"].alias("dup"))
        )

    return F.aggregate(entries, start, step, lambda s: s["code"])


def with_verdict(files: DataFrame, limits: dict[str, int] = dims.ARCHIVE_LIMITS) -> DataFrame:
    """Adds dir, paths (safe paths) and archive_error."""
    listed = with_directory(files, limits)
    listed = listed.withColumn("paths", F.transform("dir.entries", lambda e: safe_path(e["path"])))
    error = F.coalesce(F.col("dir.error"), first_violation(F.col("dir.entries"), F.col("paths"), limits))
    return listed.withColumn("archive_error", error)


def archive_limits(files: DataFrame, limits: dict[str, int] = dims.ARCHIVE_LIMITS) -> DataFrame:
    return with_verdict(files, limits).select("file_id", F.size("dir.entries").alias("entries"), "archive_error")


# ---- container kinds ------------------------------------------------------------------

MARKER_LIMIT = 8
MARKER_BYTES = 2 * dims.MIB
CONTENT_TYPES = "[content_types].xml"
PREVIEW = "quicklook/preview.pdf"
# Required part per office kind, text marks per Apple kind.
OFFICE_MAIN = (("docx", "word/document.xml"), ("pptx", "ppt/presentation.xml"), ("xlsx", "xl/workbook.xml"))
APPLE_MARKS = tuple(
    (kind, rf"(?:iwork|apple).*{kind}|{kind}.*(?:document|template)|com\.apple\.{kind}") for kind in ("pages", "keynote", "numbers")
)
MACRO_TYPE = r"""(?i)<Override\b[^>]*ContentType\s*=\s*["'][^"']*macroEnabled[^"']*["']"""
MACRO_NAME = r"(?i)\.(?:docm|pptm|xlsm)\z"
MARKER_PATH = r"metadata|properties|index\.xml\z|info\.plist\z|buildversion"
LEGACY_PATH = r"^(?:index\.xml|index\.apxl|quicklook/preview\.pdf|preview\.pdf)\z|preview\.jpg"


def _text(data: Column) -> Column:
    return F.make_valid_utf8(data.cast("string"))


def _apple_kind(text: Column) -> Column:
    lowered, out = F.lower(text), None
    for kind, pattern in APPLE_MARKS:
        out = F.when(lowered.rlike(pattern), kind) if out is None else out.when(lowered.rlike(pattern), kind)
    return out


def container_kind(files: DataFrame, limits: dict[str, int] = dims.ARCHIVE_LIMITS) -> DataFrame:
    """What a ZIP file is: kind, valid, safety, generation, confidence, warning,
    archive_error, has_preview.  ``files``: file_id, name, content."""
    judged = with_verdict(files, limits)
    clean = F.col("archive_error").isNull()
    lowered = judged.withColumn("lower", F.when(clean, F.transform("paths", F.lower))).withColumn("entries", F.col("dir.entries"))
    empty = F.slice("entries", 1, 0)

    def spelled(e: Column) -> Column:
        return F.lower(F.translate(e["path"], "\\", "/"))

    def named(name: str, last: bool) -> Column:
        found = F.filter("entries", lambda e: spelled(e) == name)
        return F.slice(F.reverse(found) if last else found, 1, 1)

    markers = F.slice(
        F.filter(
            "entries",
            lambda e: spelled(e).rlike(MARKER_PATH) & ~e["path"].endswith("/") & (e["usize"] <= MARKER_BYTES),
        ),
        1,
        MARKER_LIMIT,
    )
    picked = lowered.select(
        "file_id",
        "name",
        "content",
        "archive_error",
        "lower",
        F.when(clean, named(CONTENT_TYPES, last=True)).otherwise(empty).alias("types"),
        F.when(clean, markers).otherwise(empty).alias("markers"),
        F.when(clean, named(PREVIEW, last=False)).otherwise(empty).alias("preview"),
    ).select(
        "*", F.size("types").alias("n_types"), F.size("markers").alias("n_markers"), F.concat("types", "markers", "preview").alias("wanted")
    )
    read = picked.select(
        "file_id", "name", "archive_error", "lower", "n_types", "n_markers", part_rows(F.col("wanted"), F.col("content")).alias("parts")
    )
    has_types = F.col("n_types") > 0
    types = F.when(has_types, F.coalesce(_text(F.get("parts", F.lit(0))["data"]), F.lit(""))).otherwise("")
    marks = F.filter(
        F.transform(F.slice("parts", F.col("n_types") + 1, F.col("n_markers")), lambda p: _apple_kind(_text(p["data"]))),
        lambda k: k.isNotNull(),
    )
    preview = F.get("parts", F.col("n_types") + F.col("n_markers"))["data"]
    facts = read.select(
        "file_id",
        "archive_error",
        file_extension(F.col("name")).alias("ext"),
        (
            types.rlike(MACRO_TYPE)
            | F.col("name").rlike(MACRO_NAME)
            | F.exists("lower", lambda p: p.endswith("/vbaproject.bin") | F.contains(p, F.lit("/activex/")))
        ).alias("macro"),
        *[(has_types & F.array_contains("lower", main)).alias(kind) for kind, main in OFFICE_MAIN],
        F.exists("lower", lambda p: p.startswith("index/") & p.endswith(".iwa")).alias("iwa"),
        F.exists("lower", lambda p: p.rlike(LEGACY_PATH)).alias("legacy"),
        F.get(marks, F.lit(0)).alias("marked"),
        F.coalesce(starts_with(preview, PDF_HEAD) & has_pdf_end(preview), F.lit(False)).alias("has_preview"),
    )
    by_ext = F.when(F.col("ext") == ".pages", "pages").when(F.col("ext").isin(".key", ".keynote"), "keynote").when(F.col("ext") == ".numbers", "numbers")
    office = F.when(F.col("docx"), "docx").when(F.col("pptx"), "pptx").when(F.col("xlsx"), "xlsx")
    apple = F.when(F.col("iwa") | F.col("legacy"), F.coalesce("marked", F.when(F.col("legacy"), by_ext)))
    named_kinds = facts.withColumn("office", office).withColumn("apple", apple)
    failed, is_office = F.col("archive_error").isNotNull(), F.col("office").isNotNull()
    is_apple, structured = F.col("apple").isNotNull(), F.col("iwa") | F.col("legacy")
    age = F.when(F.col("iwa"), "modern").otherwise("legacy")
    return named_kinds.select(
        "file_id",
        F.when(failed, "unknown").otherwise(F.coalesce("office", "apple", F.lit("unknown"))).alias("kind"),
        (~failed & ((is_office & ~F.col("macro")) | (~is_office & is_apple))).alias("valid"),
        F.when(failed | (is_office & F.col("macro")), "rejected").otherwise("safe").alias("safety"),
        F.when(failed, "unknown").when(is_office, "modern").when(structured, age).otherwise("unknown").alias("generation"),
        F.when(failed, "none")
        .when(is_office, "high")
        .when(~is_apple, "low")
        .when((F.col("apple") == "pages") & (F.col("ext") == ".pages"), "high")
        .otherwise("medium")
        .alias("confidence"),
        F.when(failed, F.when(F.col("archive_error") == "ARCHIVE_UNSAFE_PATH", "unsafe-container").otherwise("malformed-content"))
        .when(is_office, F.when(F.col("macro"), "macro-enabled"))
        .when(is_apple, "renderer-evaluation-pending")
        .otherwise("unsupported-container")
        .alias("warning"),
        "archive_error",
        (~failed & ~is_office & is_apple & F.col("has_preview")).alias("has_preview"),
    )


def embedded_policy(files: DataFrame, limits: dict[str, int] = dims.ARCHIVE_LIMITS) -> DataFrame:
    """Whether an archive carries content that is never run or exported."""
    lowered = with_directory(files, limits).select(
        "file_id", F.transform(F.filter("dir.entries", lambda e: e["broken"].isNull()), lambda e: F.lower(e["path"])).alias("lower")
    )
    return lowered.select(
        "file_id",
        F.coalesce(F.exists("lower", lambda p: p.rlike(r"/embeddings/|/activex/|\.(?:bin|exe|js)\z")), F.lit(False)).alias("office_blocked"),
        F.coalesce(F.exists("lower", lambda p: p.rlike(r"^word/embeddings/|\.(?:svg|bin)\z")), F.lit(False)).alias("word_blocked"),
    )


def external_relationships(rels: DataFrame) -> DataFrame:
    """Word files pointing outside with anything but a hyperlink."""
    outside = is_external_target(F.coalesce("target", F.lit("")), F.col("mode")) & ~F.coalesce(F.col("type").rlike("(?i)hyperlink"), F.lit(False))
    return rels.where(outside).groupBy("file_id").agg(F.count(F.lit(1)).alias("external"))


# ---- relationships ------------------------------------------------------------------------


def resolve_target(source_part: Column, target: Column) -> Column:
    """Part path a relationship points to; null when it climbs out of the package."""
    folder = F.regexp_extract(source_part, r"^(.*/)", 1)
    steps = F.filter(F.concat(F.split(folder, "/"), F.split(F.substring_index(target, "#", 1), "/")), lambda p: p != "")
    start = F.expr("cast(array() as array<string>)")

    def step(stack: Column, part: Column) -> Column:
        return (
            F.when(stack.isNull() | (part == "."), stack)
            .when(part != "..", F.concat(stack, F.array(part)))
            .when(F.size(stack) > 0, F.slice(stack, 1, F.size(stack) - 1))
        )

    return F.array_join(F.aggregate(steps, start, step), "/")


def resolve_relationships(rels: DataFrame, parts: DataFrame) -> DataFrame:
    """status per relationship: ok, external, outside-package, incomplete, missing-part."""
    external = is_external_target(F.coalesce("target", F.lit("")), F.col("mode"))
    resolved = rels.withColumn("external", external).withColumn(
        "resolved", F.when(~F.col("external"), resolve_target(F.col("source_part"), F.col("target")))
    )
    known = parts.select("file_id", F.lower("path").alias("_lower"), F.col("path").alias("part")).distinct()
    joined = resolved.withColumn("_lower", F.lower("resolved")).join(known, ["file_id", "_lower"], "left")
    status = (
        F.when(F.coalesce("rel_id", F.lit("")).eqNullSafe("") | F.coalesce("target", F.lit("")).eqNullSafe(""), "incomplete")
        .when(F.col("external"), "external")
        .when(F.col("resolved").isNull(), "outside-package")
        .when(F.col("part").isNull(), "missing-part")
        .otherwise("ok")
    )
    return joined.withColumn("status", status).drop("_lower", "external")


def unique_sheet_names(sheets: DataFrame) -> DataFrame:
    """Sheet names fit for a workbook: cleaned, 31 characters, made unique in order.

    ``sheets``: file_id, ord (from 0), name.  A suffix may meet a later literal
    name, so this is a fold over the names of a workbook, which the readers hold
    to 100 sheets (200 scenes).
    """
    fallback = F.concat(F.lit("Sheet "), (F.col("ord") + 1).cast("string"))
    given = F.coalesce(F.nullif(F.col("name"), F.lit("")), fallback)
    base = F.substring(F.trim(F.regexp_replace(given, r"[\\/*?:\[\]]", " ")), 1, 31)
    named = sheets.select("file_id", "ord", F.coalesce(F.nullif(base, F.lit("")), fallback).alias("base"))
    packed = named.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("ord", "base"))).alias("names"))

    def step(used: Column, item: Column) -> Column:
        def candidate(k: Column) -> Column:
            ending = F.concat(F.lit(" "), k.cast("string"))
            return F.when(k == 1, item["base"]).otherwise(
                F.concat(item["base"].substr(F.lit(1), F.lit(31) - F.length(ending)), ending)
            )

        tries = F.transform(F.sequence(F.lit(1), F.size(used) + 1), candidate)
        return F.concat(used, F.array(F.get(F.filter(tries, lambda c: ~F.array_contains(used, c)), F.lit(0))))

    unique = F.aggregate("names", F.expr("cast(array() as array<string>)"), step)
    return packed.select(
        "file_id",
        F.inline_outer(F.zip_with("names", unique, lambda n, u: F.struct(n["ord"].alias("ord"), u.alias("sheet_name")))),
    )
