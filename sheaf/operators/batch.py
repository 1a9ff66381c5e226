"""Batch rules: what a drop of files may do, whether it may go on, its totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dims
from ..functions.text import (
    bare_extension,
    format_bytes,
    loose_extension,
    percent_change,
    safe_file_name,
    safe_request_name,
)
from .greedy import admit


def format_of(token: Column) -> Column:
    """Format aliases used by capability inputs."""
    return F.when(token == "jpg", "jpeg").when(token == "md", "markdown").otherwise(token)


COMBINABLE = ["pdf", "docx", "markdown", "jpeg", "png"]

# What a batch of one kind offers.
SINGLE_ACTIONS = {
    "pages": ["pages-to-pdf", "pages-to-word"],
    "keynote": ["keynote-to-pdf", "keynote-to-powerpoint"],
    "numbers": ["numbers-to-xlsx", "numbers-to-pdf"],
    "pptx": ["powerpoint-to-pdf"],
    "xlsx": ["excel-to-pdf"],
    "pdf": ["merge-pdf", "sign-pdf", "split-pdf", "rotate-pdf", "compress-pdf", "pdf-to-jpg", "pdf-to-markdown"],
    "markdown": ["markdown-to-pdf"],
}


def _names(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.expr("cast(array() as array<string>)")


def actions_for(count: Column, kinds: Column, preview: Column) -> Column:
    """Ordered action list for a whole batch (``kinds``: its distinct kinds)."""
    single, only = count == 1, F.element_at(kinds, 1)
    same = F.size(kinds) == 1
    out = F.when(count == 0, _names([]))
    for kind in ("pages", "keynote", "numbers"):
        plain = _names(SINGLE_ACTIONS[kind])
        out = out.when(single & (only == kind), F.when(preview, F.concat(_names(["embedded-pdf"]), plain)).otherwise(plain))
    for kind in ("pptx", "xlsx"):
        out = out.when(single & (only == kind), _names(SINGLE_ACTIONS[kind]))
    every = F.forall(kinds, lambda k: k.isin(*COMBINABLE))
    images = F.forall(kinds, lambda k: k.isin("jpeg", "png"))
    return (
        out.when(~every, _names([]))
        .when(same & (only == "pdf"), F.when(single, _names(SINGLE_ACTIONS["pdf"])).otherwise(_names(["merge-pdf"])))
        .when(same & (only == "docx"), _names(["docx-to-pdf"]))
        .when(images, _names(["image-to-pdf"]))
        .when(same & single & (only == "markdown"), _names(SINGLE_ACTIONS["markdown"]))
        .otherwise(_names(["combine-to-pdf"]))
    )


def batch_actions(files: DataFrame, group: str = "batch_id") -> DataFrame:
    """``files``: group, kind, has_preview.  The kinds of a batch are at most ten."""
    grouped = files.groupBy(group).agg(
        F.count(F.lit(1)).alias("file_count"),
        F.array_sort(F.collect_set("kind")).alias("kinds"),
        F.bool_or("has_preview").alias("preview"),
    )
    return grouped.select(
        group,
        "file_count",
        F.array_join("kinds", ",").alias("kinds"),
        F.array_join(actions_for(F.col("file_count"), F.col("kinds"), F.col("preview")), ",").alias("actions"),
    )


def batch_gate(files: DataFrame, allowed: list[str], group: str = "batch_id") -> DataFrame:
    """Fail closed: a batch goes on only if each file is valid and of an allowed kind."""
    ok = F.col("valid") & F.col("kind").isin(*allowed)
    return files.groupBy(group).agg(
        F.bool_and(ok).alias("batch_ok"),
        F.count_if(~ok).alias("offenders"),
        F.min_by(F.when(~ok, F.col("name")), F.when(~ok, F.col("pos"))).alias("first_offender"),
    )


def batch_totals(files: DataFrame, max_files: int, max_bytes: int, group: str = "batch_id") -> DataFrame:
    totals = files.groupBy(group).agg(F.count(F.lit(1)).alias("file_count"), F.sum("size").alias("total_bytes"))
    return totals.select(
        "*",
        (F.col("file_count") > max_files).alias("too_many"),
        (F.col("total_bytes") > max_bytes).alias("too_large"),
    )


def format_cap(name: Column) -> Column:
    """Byte cap by extension; anything unknown gets the PDF cap."""
    ext = loose_extension(name)
    return (
        F.when(ext.isin(".docx", ".pptx", ".xlsx"), dims.MAX_OFFICE_BYTES)
        .when(ext.isin(".jpg", ".jpeg", ".png"), dims.MAX_IMAGE_BYTES)
        .when(ext.isin(".md", ".markdown"), dims.MAX_MARKDOWN_BYTES)
        .when(ext.isin(".pages", ".key", ".keynote", ".numbers"), dims.MAX_APPLE_BYTES)
        .otherwise(dims.MAX_PDF_BYTES)
        .cast("long")
    )


def accept_files(files: DataFrame, group: str = "batch_id") -> DataFrame:
    """Tool rules in order: tool, count, type, empty, per-file cap, running byte cap.

    ``files``: group, pos, name, mime, size, slug; optional first_count,
    first_bytes for files taken before.
    """
    rules = dims.tool_rules(files.sparkSession)
    for prior in ("first_count", "first_bytes"):
        if prior not in files.columns:
            files = files.withColumn(prior, F.lit(0).cast("long"))
    ruled = files.join(rules, "slug", "left").select(
        *files.columns,
        F.col("max_files").alias("max_count"),
        F.col("max_total_bytes").alias("max_bytes"),
        "max_file_bytes",
        (
            F.array_contains(F.split("accept_mime", ","), F.col("mime"))
            | F.array_contains(F.split("accepts", ","), loose_extension(F.col("name")))
        ).alias("type_ok"),
    )
    most = max(row[3] for row in dims.TOOL_RULES)
    tests = [
        (F.col("max_count").isNull(), "unknown-tool"),
        (~F.col("type_ok"), "type"),
        (F.col("size") == 0, "empty"),
        (F.col("size") > F.col("max_file_bytes"), "file-size"),
    ]
    out = admit(ruled, group, most, tests)
    return out.drop("max_count", "max_bytes", "max_file_bytes", "type_ok", "first_count", "first_bytes")


def accept_drop(files: DataFrame, group: str = "batch_id") -> DataFrame:
    """Mixed drop: count, per-format cap, running byte cap; no type or empty test."""
    ruled = files.select(
        "*",
        F.lit(dims.MAX_DROP_FILES).alias("max_count"),
        F.lit(dims.MAX_DROP_BYTES).cast("long").alias("max_bytes"),
        F.lit(0).alias("first_count"),
        F.lit(0).cast("long").alias("first_bytes"),
    )
    tests = [(F.col("size") > format_cap(F.col("name")), "format-size")]
    out = admit(ruled, group, dims.MAX_DROP_FILES, tests)
    return out.drop("max_count", "max_bytes", "first_count", "first_bytes")


def output_names(batches: DataFrame) -> DataFrame:
    """Result name per batch and action.

    ``batches``: action, first_name, file_count, first_page, last_page, degrees.
    """
    action, many = F.col("action"), F.col("file_count") > 1
    suffix = (
        F.when(action == "merge-pdf", "-merged")
        .when(action == "split-pdf", F.concat(F.lit("-pages-"), F.col("first_page"), F.lit("-"), F.col("last_page")))
        .when(action == "rotate-pdf", F.concat(F.lit("-rotated-"), F.col("degrees")))
        .when(action == "compress-pdf", "-optimized")
        .otherwise("")
    )
    # One projection per cleaning step: nested, the expressions would repeat.
    stems = batches.select("*", safe_file_name(F.col("first_name")).alias("stem"), suffix.alias("suffix"))
    named = stems.select("*", safe_file_name(F.concat("stem", "suffix")).alias("named"))
    ext = F.when(action == "pdf-to-markdown", ".md").otherwise(".pdf")
    fixed = (
        F.when((action == "images-to-pdf") & many, "images.pdf")
        .when((action == "docx-to-pdf") & many, "word-documents.pdf")
        .when(action == "combine-to-pdf", "combined-documents.pdf")
        .when(action == "pdf-to-jpg", F.concat(F.col("stem"), F.lit("-p"), F.col("first_page"), F.lit(".jpg")))
    )
    return named.select(*batches.columns, F.coalesce(fixed, F.concat("named", ext)).alias("output_name"))


# ---- registry joins -----------------------------------------------------------


def capability_lookup(kinds: DataFrame) -> DataFrame:
    """kind → capabilities through the exploded input list (aliases folded)."""
    caps = dims.capabilities(kinds.sparkSession).select(
        "id", "ord", "output", "tool_slug", F.explode(F.split("inputs", ",")).alias("token")
    )
    flat = caps.select("id", "ord", "output", "tool_slug", format_of(F.col("token")).alias("kind")).distinct()
    return kinds.join(flat, "kind")


def slug_lookup(actions: DataFrame) -> DataFrame:
    """action → tool rule, with ``slug_status``: live, retired or unknown."""
    spark = actions.sparkSession
    rules = dims.tool_rules(spark).select("slug", "category", "max_files")
    retired = dims.retired_slugs(spark).withColumn("is_retired", F.lit(True))
    wanted = actions.withColumn("slug", F.when(F.col("action") == "image-to-pdf", "images-to-pdf").otherwise(F.col("action")))
    return (
        wanted.join(rules, "slug", "left")
        .join(retired, "slug", "left")
        .withColumn(
            "slug_status",
            F.when(F.col("category").isNotNull(), "live").when(F.col("is_retired"), "retired").otherwise("unknown"),
        )
        .drop("is_retired")
    )


def route_assignment(requests: DataFrame) -> DataFrame:
    """Which engine serves a request.

    ``requests``: from_fmt, to_fmt, is_mac, connected, browser_ok, fallback_ok,
    engines ARRAY<STRING> (null while unknown).
    """
    pairs = dims.allowed_pairs(requests.sparkSession)
    joined = requests.withColumn("pair", F.concat(F.lower("from_fmt"), F.lit(">"), F.lower("to_fmt"))).join(pairs, "pair", "left")
    backup = F.col("browser_ok") & F.col("fallback_ok")
    no_helper = ~F.col("connected") | F.col("engines").isNull()
    native = F.coalesce(F.array_contains("engines", F.col("engine")), F.lit(False))
    office = F.col("engine").isin("word", "powerpoint", "excel") & F.coalesce(
        F.array_contains("engines", F.lit("libreoffice")), F.lit(False)
    )
    route = (
        F.when(F.col("engine").isNull(), F.when(F.col("browser_ok"), "browser:pair-not-native").otherwise("blocked:unsupported-pair"))
        .when(~F.col("is_mac"), F.when(backup, "browser:needs-mac").otherwise("blocked:needs-mac"))
        .when(no_helper, F.when(backup, "browser:helper-off").otherwise("blocked:helper-off"))
        .when(native, F.concat(F.lit("helper-native:"), F.col("engine")))
        .when(office, F.lit("helper-fallback:libreoffice"))
        .when(backup, F.lit("browser:app-missing"))
        .otherwise(F.lit("blocked:app-missing"))
    )
    return joined.select(
        *requests.columns,
        F.split_part(route, F.lit(":"), F.lit(1)).alias("via"),
        F.split_part(route, F.lit(":"), F.lit(2)).alias("detail"),
    )


def request_validation(requests: DataFrame) -> DataFrame:
    """First failing rule of a conversion request, null when it may run.

    ``requests``: from_fmt, to_fmt, filename, content_len.
    """
    pairs = dims.allowed_pairs(requests.sparkSession).select("pair", F.lit(True).alias("listed"))
    src, dst = F.trim(F.lower("from_fmt")), F.trim(F.lower("to_fmt"))
    ext = bare_extension(safe_request_name(F.coalesce("filename", F.lit("document"))))
    joined = requests.withColumn("pair", F.concat(src, F.lit(">"), dst)).join(pairs, "pair", "left")
    return joined.select(
        *requests.columns,
        F.when(src.isNull() | dst.isNull() | (src == "") | (dst == ""), "missing-format")
        .when(F.col("listed").isNull(), "pair-not-allowed")
        .when(F.coalesce("content_len", F.lit(0)) == 0, "missing-content")
        .when(F.col("content_len") > dims.MAX_BASE64_CHARS, "too-large")
        .when((ext != "") & (ext != src), "extension-mismatch")
        .alias("error_code"),
    )


SHARES = 64  # tasks over which the occurrences of one content may spread


def dedup_snapshot(files: DataFrame, digest: Column, inspection: dict[str, Column]) -> DataFrame:
    """One inspection per distinct content, handed to every occurrence in its place.

    Digest and inspection are taken where the content lies; only they are shuffled.
    Copies are counted on the map side.  On the way back the occurrences of a content
    are dealt into shares by file, and its row goes to each share that has any, so a
    content that makes up a third of the files does not meet in one task.
    """
    found = F.struct(*[c.alias(n) for n, c in inspection.items()])
    keyed = files.select("file_id", "batch_id", "pos", digest.alias("digest"), found.alias("found"))
    keyed = keyed.where(F.col("digest").isNotNull())
    share = F.pmod(F.xxhash64("file_id"), F.lit(SHARES)).cast("int")
    slim = keyed.select("file_id", "batch_id", "pos", "digest").withColumn("share", share)
    counts = slim.groupBy("digest", "share").agg(F.count(F.lit(1)).alias("n"), F.min("file_id").alias("first"))
    totals = counts.groupBy("digest").agg(F.sum("n").alias("copies"), F.min("first").alias("first_file"), F.collect_list("share").alias("shares"))
    first = totals.join(keyed.select(F.col("digest").alias("_digest"), "file_id", "found"), (F.col("digest") == F.col("_digest")) & (F.col("first_file") == F.col("file_id")))
    distinct = first.select("digest", "copies", "first_file", "found", F.explode("shares").alias("share"))
    return slim.join(distinct, ["digest", "share"]).select("file_id", "batch_id", "pos", "digest", "copies", "first_file", "found.*")


def exactly_once(groups: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """Ids that fall in no group or in several (``groups`` may repeat an id)."""
    seen = groups.groupBy(key).agg(F.count(F.lit(1)).alias("times"))
    return (
        members.select(key)
        .distinct()
        .join(seen, key, "full_outer")
        .select(key, F.coalesce("times", F.lit(0)).cast("long").alias("times"))
        .where(F.col("times") != 1)
    )


def registry_reconcile(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of one side missing on the other, multiplicity kept."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(
        right.exceptAll(left).withColumn("side", F.lit("right"))
    )


def compression_report(files: DataFrame) -> DataFrame:
    return files.select(
        "*",
        format_bytes(F.col("before_bytes")).alias("before_label"),
        format_bytes(F.col("after_bytes")).alias("after_label"),
        percent_change(F.col("before_bytes"), F.col("after_bytes")).alias("change"),
    )
