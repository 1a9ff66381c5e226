"""Page selections, page order, page counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import dims
from ..functions.text import WS_CLASS, clean_trim
from .ordering import BLOCK, block_of, exclusive_sum, join_on, kept, rank_in_group

PART = f"^[0-9]+(?:{WS_CLASS}*-{WS_CLASS}*[0-9]*)?\\z"


def _range(part: Column, count: Column) -> Column:
    """One part of a spec: bounds and the first rule it breaks."""
    low = F.regexp_extract(part, r"^([0-9]+)", 1).try_cast("double")
    high_text = F.regexp_extract(part, f"-{WS_CLASS}*([0-9]*)\\z", 1)
    dashed = F.contains(part, F.lit("-"))
    high = F.when(~dashed, low).when(high_text == "", count.cast("double")).otherwise(high_text.try_cast("double"))
    far = float("inf")
    code = (
        F.when(~part.rlike(PART), "syntax")
        .when((low < 1) | (low == far), "start")
        .when((high < 1) | (high == far), "end")
        .when(high < low, "reversed")
        .when((low > count) | (high > count), "outside")
    )
    return F.struct(code.alias("code"), low.cast("long").alias("low"), high.cast("long").alias("high"))


def expand_page_ranges(requests: DataFrame) -> DataFrame:
    """request_id, spec, page_count → request_id, page, error_code.

    A good request gives its distinct pages in order, a bad one a single row with
    the code of the first problem.  Stays inside the request's own row.
    """
    spec = clean_trim(F.col("spec"))
    parts = F.transform(F.split(spec, ",", -1), clean_trim)
    parsed = requests.select(
        "request_id",
        "page_count",
        spec.alias("spec"),
        parts.alias("parts"),
    ).select("*", F.transform("parts", lambda p: _range(p, F.col("page_count"))).alias("ranges"))
    bad = F.element_at(F.filter("ranges", lambda r: r["code"].isNotNull()), 1)["code"]
    error = (
        F.when(F.col("spec") == "", "blank")
        .when(F.coalesce(F.col("page_count"), F.lit(0)) < 1, "no-pages")
        .when(F.exists("parts", lambda p: p == ""), "empty-part")
        .otherwise(F.when(F.exists("ranges", lambda r: r["code"].isNotNull()), bad))
    )
    flagged = parsed.select("request_id", "ranges", error.alias("error_code"))
    pages = F.when(
        F.col("error_code").isNull(),
        F.array_sort(F.array_distinct(F.flatten(F.transform("ranges", lambda r: F.sequence(r["low"], r["high"]))))),
    )
    return flagged.select("request_id", F.explode_outer(pages).alias("page"), "error_code")


def page_runs(pages: DataFrame, group: str = "doc", block: int = BLOCK) -> DataFrame:
    """``4 pages (1–3, 5)`` per group from distinct page numbers.

    Runs are found inside blocks of page numbers, then joined across blocks.
    """
    blocked = pages.select(group, "page").distinct().withColumn("_block", block_of("page", block))
    island = F.col("page") - F.row_number().over(Window.partitionBy(group, "_block").orderBy("page"))
    runs = blocked.withColumn("_island", island).groupBy(group, "_block", "_island").agg(
        F.min("page").alias("low"), F.max("page").alias("high")
    )
    order = Window.partitionBy(group).orderBy("low")
    joined = runs.withColumn("_new", F.when(F.lag("high").over(order) == F.col("low") - 1, 0).otherwise(1))
    joined = joined.withColumn("_run", F.sum("_new").over(order)).groupBy(group, "_run").agg(
        F.min("low").alias("low"), F.max("high").alias("high")
    )
    label = F.when(F.col("low") == F.col("high"), F.col("low").cast("string")).otherwise(
        F.concat(F.col("low").cast("string"), F.lit("–"), F.col("high").cast("string"))
    )
    summed = joined.groupBy(group).agg(
        F.sum(F.col("high") - F.col("low") + 1).alias("pages"),
        F.array_sort(F.collect_list(F.struct("low", label.alias("label")))).alias("runs"),
    )
    noun = F.when(F.col("pages") == 1, " page (").otherwise(" pages (")
    return summed.select(
        group,
        "pages",
        F.concat(
            F.col("pages").cast("string"), noun, F.array_join(F.transform("runs", lambda r: r["label"]), ", "), F.lit(")")
        ).alias("summary"),
    )


def split_pages(pages: DataFrame, selection: DataFrame) -> DataFrame:
    """Selected pages of each document, renumbered; documents without any get an error row."""
    kept = pages.join(selection, ["doc", "page"], "left_semi")
    numbered = rank_in_group(kept, ["doc"], "page", "out_page").select("doc", "page", "out_page", F.lit(None).cast("string").alias("error_code"))
    asked = selection.select("doc").distinct()
    missing = asked.join(kept.select("doc"), "doc", "left_anti").select(
        "doc",
        F.lit(None).cast("long").alias("page"),
        F.lit(None).cast("long").alias("out_page"),
        F.lit("no-valid-pages").alias("error_code"),
    )
    return numbered.unionByName(missing)


def rotate_pages(pages: DataFrame, degrees: int, selection: DataFrame | None = None) -> DataFrame:
    """Turn the selected pages (all without a selection)."""
    turned = F.pmod(F.col("rotation") + degrees, F.lit(360)).cast("long")
    if selection is None:
        return pages.withColumn("rotation", turned)
    chosen = selection.select("doc", "page").distinct().withColumn("_hit", F.lit(True))
    return (
        pages.join(chosen, ["doc", "page"], "left")
        .withColumn("rotation", F.when(F.col("_hit"), turned).otherwise(F.col("rotation").cast("long")))
        .drop("_hit")
    )


def merge_order(pages: DataFrame, group: str = "batch_id", file: str = "file_pos", block: int = BLOCK) -> DataFrame:
    """Output page number over the files of a batch in their order, ``i / n`` label.

    Pages are ranked inside a block of one file; the blocks, a few rows per file,
    are summed up along the batch in blocks of file positions.
    """
    blocked = pages.withColumn("_pb", block_of("page", block))
    # A few numbers per file, read three times: kept instead of counted again.
    counts = kept(blocked.groupBy(group, file, "_pb").agg(F.count(F.lit(1)).alias("_n")))
    total = counts.groupBy(group).agg(F.sum("_n").alias("out_pages"))
    sums = exclusive_sum(counts, [group], file, "_n", "_start", block, then=["_pb"])
    starts = join_on(sums, total, [group]).select(group, file, "_pb", "_start", "out_pages", F.lit(False).alias("_own"))
    # What a block starts with is its first row, so that its pages are dealt and sorted once.
    both = blocked.withColumn("_own", F.lit(True)).unionByName(starts, allowMissingColumns=True)
    inside = Window.partitionBy(group, file, "_pb").orderBy("_own", "page")
    head = inside.rowsBetween(Window.unboundedPreceding, 0)
    out_page = (F.first("_start").over(head) + F.row_number().over(inside) - 1).cast("long")
    numbered = both.select(*pages.columns, "_own", out_page.alias("out_page"), F.first("out_pages").over(head).alias("out_pages")).where("_own").drop("_own")
    return numbered.withColumn("label", F.concat(F.col("out_page").cast("string"), F.lit(" / "), F.col("out_pages").cast("string")))


def combine_segments(sources: list[DataFrame], group: str = "batch_id", file: str = "file_pos") -> DataFrame:
    """Ordered UNION ALL of page sources; duplicates stay."""
    union = sources[0]
    for source in sources[1:]:
        union = union.unionByName(source)
    return merge_order(union, group, file)


def page_count_reconcile(segments: DataFrame, outputs: DataFrame, group: str = "batch_id") -> DataFrame:
    """Batches whose output does not hold exactly the pages of its segments.

    ``segments``: group, pages; ``outputs``: group, out_pages.
    """
    expected = segments.groupBy(group).agg(F.sum("pages").alias("expected"), F.bool_or(F.col("pages") < 1).alias("empty_segment"))
    joined = expected.join(outputs, group, "full_outer")
    problem = (
        F.when(F.col("out_pages").isNull(), "missing-output")
        .when(F.col("expected").isNull(), "unexpected-output")
        .when(F.col("empty_segment"), "empty-segment")
        .when(F.col("out_pages") < 1, "no-pages")
        .when(F.col("out_pages") != F.col("expected"), "page-count")
    )
    return joined.select(group, "expected", "out_pages", problem.alias("problem")).where(F.col("problem").isNotNull())


def page_geometry_diff(actual: DataFrame, reference: DataFrame, tolerance: float = 1.5) -> DataFrame:
    """Per document: same page count, same page sizes within the tolerance."""
    a = actual.select("doc", "page", F.col("width").alias("aw"), F.col("height").alias("ah"), F.lit(1).alias("a"))
    r = reference.select("doc", "page", F.col("width").alias("rw"), F.col("height").alias("rh"), F.lit(1).alias("r"))
    joined = a.join(r, ["doc", "page"], "full_outer")
    close = (F.abs(F.col("aw") - F.col("rw")) <= tolerance) & (F.abs(F.col("ah") - F.col("rh")) <= tolerance)
    summed = joined.groupBy("doc").agg(
        F.coalesce(F.sum("a"), F.lit(0)).alias("actual_pages"),
        F.coalesce(F.sum("r"), F.lit(0)).alias("reference_pages"),
        F.bool_and(F.coalesce(close, F.lit(False))).alias("sizes_close"),
    )
    same = F.col("actual_pages") == F.col("reference_pages")
    return summed.select(
        "doc",
        "actual_pages",
        "reference_pages",
        same.alias("page_count_match"),
        (same & F.col("sizes_close")).alias("page_size_match"),
    )


def natural_page_sort(names: DataFrame, group: str) -> DataFrame:
    """Order ``page-12.png`` by its number, not by its letters."""
    number = F.regexp_extract("name", r"(\d+)", 1).cast("long")
    return names.where(F.col("name").rlike(r"^page-\d+\.png\z")).withColumn("page_no", number).orderBy(group, "page_no")


# What each target may hold.
PAGE_CAPS = {
    "jpg": dims.MAX_JPG_PAGES,
    "text": dims.MAX_TEXT_PAGES,
    "markdown": dims.MAX_MARKDOWN_PAGES,
    "docx": dims.MAX_DOCX_PAGES,
    "slides": dims.MAX_SLIDES,
    "sheets": dims.MAX_SHEETS,
    "rows": dims.MAX_TABLE_ROWS,
}


def page_caps(units: DataFrame, keys: list[str]) -> DataFrame:
    """Units over a cap, one row per cap broken; fail closed."""
    counted = units.groupBy(*keys).agg(F.count(F.lit(1)).alias("pages"))
    caps = F.array(*[F.struct(F.lit(k).alias("target"), F.lit(v).cast("long").alias("cap")) for k, v in PAGE_CAPS.items()])
    return (
        counted.withColumn("c", F.explode(caps))
        .where(F.col("pages") > F.col("c.cap"))
        .select(*keys, "pages", F.col("c.target").alias("target"), F.col("c.cap").alias("cap"))
    )
