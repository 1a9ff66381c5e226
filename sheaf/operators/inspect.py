"""Content-first file inspection: signatures, envelopes, warnings, labels."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import dims
from ..functions.text import file_extension, is_blank

# Leading bytes.
PDF_HEAD = bytes.fromhex("255044462D")
JPEG_HEAD = bytes.fromhex("FFD8FF")
JPEG_TAIL = bytes.fromhex("FFD9")
PNG_HEAD = bytes.fromhex("89504E470D0A1A0A")
ZIP_HEAD = bytes.fromhex("504B0304")
PDF_END = b"%%EOF"
PDF_TAIL_BYTES = 2 * dims.MIB


def starts_with(content: Column, head: bytes) -> Column:
    return F.substring(content, 1, len(head)) == F.lit(head)


def big_endian(content: Column, offset: int, width: int) -> Column:
    """Unsigned big-endian integer at a zero-based byte offset."""
    return F.conv(F.hex(F.substring(content, offset + 1, width)), 16, 10).cast("long")


def detect_step(content: Column, name: Column, mime: Column, size: Column) -> Column:
    """The first rule of the ladder that fits; ``zip`` still needs its directory."""
    return (
        F.when(size == 0, "empty")
        .when(size > dims.MAX_INSPECT_BYTES, "too-large")
        .when(F.octet_length(content) == 0, "empty")
        .when(starts_with(content, PDF_HEAD), "pdf")
        .when(starts_with(content, JPEG_HEAD), "jpeg")
        .when(starts_with(content, PNG_HEAD), "png")
        .when(file_extension(name).isin(".md", ".markdown") | (mime == "text/markdown"), "markdown")
        .when(starts_with(content, ZIP_HEAD), "zip")
        .otherwise("unknown")
    )


def has_pdf_end(content: Column) -> Column:
    return F.contains(F.substring(content, -PDF_TAIL_BYTES, PDF_TAIL_BYTES), F.lit(PDF_END))


def pdf_valid(content: Column) -> Column:
    return starts_with(content, PDF_HEAD) & has_pdf_end(content)


def jpeg_valid(content: Column) -> Column:
    return starts_with(content, JPEG_HEAD) & (F.octet_length(content) >= 4) & (F.substring(content, -2, 2) == F.lit(JPEG_TAIL))


def png_header(content: Column) -> dict[str, Column]:
    has_ihdr = (
        starts_with(content, PNG_HEAD) & (F.octet_length(content) >= 33) & (F.substring(content, 13, 4) == F.lit(b"IHDR"))
    )
    width = F.when(has_ihdr, big_endian(content, 16, 4)).otherwise(0)
    height = F.when(has_ihdr, big_endian(content, 20, 4)).otherwise(0)
    valid = has_ihdr & (width > 0) & (height > 0) & F.contains(content, F.lit(b"IEND"))
    return {"width": width, "height": height, "valid": valid}


def text_status(content: Column) -> Column:
    """``ok`` or one of three reasons: not UTF-8, blank, binary."""
    text = F.when(F.is_valid_utf8(content), F.decode(content, "UTF-8"))
    return F.when(text.isNull(), "not-utf8").otherwise(plain_text_status(text))


def plain_text_status(text: Column) -> Column:
    return F.when(is_blank(text), "blank").when(F.contains(text, F.lit("\0")), "binary").otherwise("ok")


def envelope_valid(step: Column, content: Column) -> Column:
    return (
        F.when(step == "pdf", pdf_valid(content))
        .when(step == "jpeg", jpeg_valid(content))
        .when(step == "png", png_header(content)["valid"])
        .when(step == "markdown", text_status(content) == "ok")
        .otherwise(False)
    )




def inspect_files(files: DataFrame, containers: DataFrame | None = None) -> DataFrame:
    """One inspection row per file; ``content`` itself is left behind.

    ``files``: file_id, name, mime, size, content (+ any key columns).
    ``containers``: file_id, kind, valid, safety, generation, confidence,
    warning, archive_error, has_preview for ZIP files, from
    ``operators.archive.container_kind``.  Without it a ZIP file stays unknown.
    """
    keys = [c for c in files.columns if c != "content"]
    step = files.select(
        *keys,
        detect_step(F.col("content"), F.col("name"), F.col("mime"), F.col("size")).alias("step"),
        F.col("content"),
    )
    base = step.select(
        *keys,
        "step",
        F.when(F.col("step").isin("pdf", "jpeg", "png", "markdown"), F.col("step")).otherwise("unknown").alias("kind"),
        envelope_valid(F.col("step"), F.col("content")).alias("valid"),
        file_extension(F.col("name")).alias("extension"),
    )
    step_col = F.col("step")
    if containers is None:
        base = base.select(
            "*",
            F.when(step_col.isin("empty", "too-large"), "rejected")
            .when(step_col.isin("unknown", "zip"), "safe")
            .when(F.col("valid"), "safe")
            .otherwise("rejected")
            .alias("safety"),
            F.when(F.col("kind") == "unknown", "none").otherwise("high").alias("confidence"),
            F.lit("unknown").alias("generation"),
            F.lit(None).cast("string").alias("container_warning"),
            F.when(step_col == "too-large", "ARCHIVE_TOO_LARGE").alias("archive_error"),
            F.lit(False).alias("has_preview"),
        )
    else:
        found = containers.select(
            "file_id",
            F.col("kind").alias("c_kind"),
            F.col("valid").alias("c_valid"),
            F.col("safety").alias("c_safety"),
            F.col("generation").alias("c_generation"),
            F.col("confidence").alias("c_confidence"),
            F.col("warning").alias("c_warning"),
            F.col("archive_error").alias("c_error"),
            F.col("has_preview").alias("c_preview"),
        )
        is_zip = step_col == "zip"
        base = base.join(found, "file_id", "left").select(
            *keys,
            "step",
            F.when(is_zip, F.coalesce("c_kind", F.lit("unknown"))).otherwise(F.col("kind")).alias("kind"),
            F.when(is_zip, F.coalesce("c_valid", F.lit(False))).otherwise(F.col("valid")).alias("valid"),
            "extension",
            F.when(is_zip, F.coalesce("c_safety", F.lit("safe")))
            .when(step_col.isin("empty", "too-large"), "rejected")
            .when((step_col == "unknown") | F.col("valid"), "safe")
            .otherwise("rejected")
            .alias("safety"),
            F.when(is_zip, F.coalesce("c_confidence", F.lit("none")))
            .when(F.col("kind") == "unknown", "none")
            .otherwise("high")
            .alias("confidence"),
            F.when(is_zip, F.coalesce("c_generation", F.lit("unknown"))).otherwise("unknown").alias("generation"),
            F.when(is_zip, F.col("c_warning")).alias("container_warning"),
            F.when(step_col == "too-large", "ARCHIVE_TOO_LARGE").when(is_zip, F.col("c_error")).alias("archive_error"),
            F.when(is_zip, F.coalesce("c_preview", F.lit(False))).otherwise(False).alias("has_preview"),
        )
    return add_type_warnings(base)


def add_type_warnings(files: DataFrame) -> DataFrame:
    """Label, extension and MIME match, warning codes, from the kind registry."""
    rules = dims.kind_rules(files.sparkSession)
    known = F.col("kind") != "unknown"
    ext_ok = F.coalesce(F.array_contains(F.split("exts", ","), F.col("extension")), F.lit(False))
    mime_ok = F.coalesce(F.array_contains(F.split("mimes", ","), F.col("mime")), F.lit(False))
    first = (
        F.when(F.col("step") == "empty", "malformed-content")
        .when(F.col("step") == "too-large", "unsafe-container")
        .when(F.col("step") == "zip", F.col("container_warning"))
        .when(known & ~F.col("valid"), "malformed-content")
    )
    return files.join(rules, "kind", "left").select(
        *[c for c in files.columns if c not in ("container_warning",)],
        F.coalesce("label", F.lit(dims.UNKNOWN_LABEL)).alias("format_label"),
        ext_ok.alias("extension_match"),
        mime_ok.alias("mime_match"),
        (F.col("step") == "zip").alias("is_container"),
        F.array_join(
            F.array_distinct(
                F.filter(
                    F.array(
                        first,
                        F.when(known & ~ext_ok, "extension-mismatch"),
                        F.when(known & (F.col("mime") != "") & ~mime_ok, "mime-mismatch"),
                    ),
                    lambda c: c.isNotNull(),
                )
            ),
            ",",
        ).alias("warnings"),
    )


# ---- image headers ----------------------------------------------------------


def jpeg_dimensions(content: Column) -> Column:
    """``(width, height)`` from the start-of-frame segment, null when there is none.

    Walking marker segments depends on the bytes just read, so this is one
    Arrow UDF.  It gets the whole value: a frame header may follow large
    metadata segments.
    """
    return _jpeg_walk(content)


def _frame_size(data: bytes) -> tuple[int, int] | None:
    pos, end = 2, len(data)
    if end < 4 or data[:2] != b"\xff\xd8":
        return None
    while pos + 9 < end:
        if data[pos] != 0xFF:
            pos += 1
            continue
        marker = data[pos + 1]
        pos += 2
        if marker in (0xD8, 0xD9) or 0xD0 <= marker <= 0xD7:
            continue
        length = int.from_bytes(data[pos : pos + 2], "big")
        if length < 2 or pos + length > end:
            return None
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC) and length >= 7:
            high = int.from_bytes(data[pos + 3 : pos + 5], "big")
            wide = int.from_bytes(data[pos + 5 : pos + 7], "big")
            return (wide, high) if wide and high else None
        pos += length
    return None


FRAME = T.StructType([T.StructField("width", T.LongType()), T.StructField("height", T.LongType())])


@F.pandas_udf(FRAME)
def _jpeg_walk(content: pd.Series) -> pd.DataFrame:
    sizes = [_frame_size(bytes(c)) if c is not None else None for c in content]
    return pd.DataFrame(
        {"width": [s[0] if s else None for s in sizes], "height": [s[1] if s else None for s in sizes]},
        dtype="Int64",
    )


def image_pixel_audit(files: DataFrame) -> DataFrame:
    """Header size of every PNG and JPEG, and which pixel caps it breaks."""
    is_png = starts_with(F.col("content"), PNG_HEAD[:4])
    is_jpeg = starts_with(F.col("content"), JPEG_HEAD[:2])
    keys = [c for c in files.columns if c != "content"]
    png_ok = is_png & (F.octet_length("content") >= 24) & (F.substring("content", 13, 4) == F.lit(b"IHDR"))
    pngs = files.where(is_png).select(
        *keys,
        F.lit("png").alias("image_kind"),
        F.when(png_ok, big_endian(F.col("content"), 16, 4)).alias("w"),
        F.when(png_ok, big_endian(F.col("content"), 20, 4)).alias("h"),
    )
    jpegs = (
        files.where(is_jpeg)
        .withColumn("frame", jpeg_dimensions(F.col("content")))
        .select(*keys, F.lit("jpeg").alias("image_kind"), F.col("frame.width").alias("w"), F.col("frame.height").alias("h"))
    )
    real = F.coalesce((F.col("w") > 0) & (F.col("h") > 0), F.lit(False))
    width, height = F.when(real, F.col("w")), F.when(real, F.col("h"))
    area = width * height
    return pngs.unionByName(jpegs).select(
        *keys,
        "image_kind",
        width.alias("width"),
        height.alias("height"),
        F.coalesce(area > dims.MAX_PDF_IMAGE_PIXELS, F.lit(True)).alias("over_pdf_cap"),
        F.coalesce(area > dims.MAX_OFFICE_IMAGE_PIXELS, F.lit(True)).alias("over_office_cap"),
        F.coalesce(
            (width > dims.MAX_STAMP_SIDE) | (height > dims.MAX_STAMP_SIDE) | (area > dims.MAX_STAMP_PIXELS), F.lit(True)
        ).alias("over_stamp_cap"),
    )
