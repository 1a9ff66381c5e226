"""Evaluation of corpora, rasters and load samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import first_k, values_at_rank


def inventory(files: DataFrame, k: int = 12) -> DataFrame:
    """Count, bytes and the ``k`` largest of a whole corpus, one row."""
    totals = files.agg(F.count(F.lit(1)).alias("file_count"), F.sum("size").alias("total_bytes"))
    top = files.select("file_id", "size").orderBy(F.desc("size"), "file_id").limit(k)
    none = F.lit(None).cast("long")
    rows = totals.select("file_count", "total_bytes", none.alias("file_id"), none.alias("size")).unionByName(
        top.select(none.alias("file_count"), none.alias("total_bytes"), "file_id", "size")
    )
    listed = F.collect_list(F.when(F.col("file_id").isNotNull(), F.struct((-F.col("size")).alias("s"), "file_id")))
    return rows.agg(
        F.max("file_count").alias("file_count"),
        F.max("total_bytes").alias("total_bytes"),
        F.array_join(F.transform(F.array_sort(listed), lambda r: r["file_id"].cast("string")), ",").alias("largest"),
    )


def output_text_reconcile(texts: DataFrame, outputs: DataFrame, k: int = 5) -> DataFrame:
    """First ``k`` source texts per document that the output does not contain.

    ``texts``: doc, ord, text (non-empty); ``outputs``: doc, output.
    """
    wanted = first_k(texts.where(F.col("text") != ""), ["doc"], ["ord"], k).select("doc", "ord", "text")
    joined = wanted.join(outputs.withColumn("_found", F.lit(True)), "doc", "left")
    problem = F.when(F.col("_found").isNull(), "no-output").when(~F.contains("output", F.col("text")), "missing-text")
    return joined.select("doc", "ord", "text", problem.alias("problem")).where(F.col("problem").isNotNull())


# ---- summaries and expectations -------------------------------------------------


# How many texts of each kind a summary quotes, in this order.
QUOTED = {"text": 6, "cell": 12, "note": 6}


def doc_summary(items: DataFrame) -> DataFrame:
    """One row per document: scenes, text blocks, tables, objects by kind, first texts.

    ``items``: doc, scene, ord, item_kind, text, table_rows.  Counts combine on the map
    side.  ``text_corpus`` joins the first texts, cells (both without empty ones) and
    notes, ``note_text`` the notes alone; groups are limited before the shuffle.
    ``table_rows`` maps a number of rows to how many tables have it.
    """
    kinds = ["text", "table", "shape", "image", "chart", "note"]
    per_scene = items.groupBy("doc", "scene").agg(
        *[F.count_if(F.col("item_kind") == k).alias(k) for k in kinds]
    )
    objects = F.create_map(*[c for k in ("chart", "image", "shape") for c in (F.lit(k), F.col(f"{k}s"))])
    counts = (
        per_scene.groupBy("doc")
        .agg(
            F.count(F.lit(1)).alias("scenes"),
            *[F.sum(k).alias("text_blocks" if k == "text" else f"{k}s") for k in kinds],
        )
        .withColumn("object_kinds", F.map_filter(objects, lambda k, n: n > 0))
    )
    sized = items.where((F.col("item_kind") == "table") & F.col("table_rows").isNotNull()).groupBy("doc", "table_rows").agg(F.count(F.lit(1)).alias("n"))
    rows = sized.groupBy("doc").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("table_rows", "n")))).alias("table_rows"))
    kind, text = F.col("item_kind"), F.col("text")
    quotable = ((kind == "note") & text.isNotNull()) | (kind.isin("text", "cell") & (text != ""))
    limits = F.create_map(*[F.lit(v) for pair in QUOTED.items() for v in pair])
    order = F.create_map(*[F.lit(v) for pair in enumerate(QUOTED) for v in reversed(pair)])
    firsts = (
        first_k(items.where(quotable), ["doc", "item_kind"], ["ord"], max(QUOTED.values()))
        .where(F.col("rn") <= limits[kind])
        .groupBy("doc")
        .agg(F.array_sort(F.collect_list(F.struct(order[kind].alias("at"), "rn", "text"))).alias("_t"))
    )

    def joined(quotes: Column) -> Column:
        return F.coalesce(F.array_join(F.transform(quotes, lambda t: t["text"]), "\n"), F.lit(""))

    notes = F.filter("_t", lambda t: t["at"] == list(QUOTED).index("note"))
    none = F.expr("cast(map() as map<bigint, bigint>)")
    out = counts.join(rows, "doc", "left").join(firsts, "doc", "left")
    out = out.withColumns({"table_rows": F.coalesce("table_rows", none), "text_corpus": joined(F.col("_t")), "note_text": joined(notes)})
    return out.withColumn("table_row_counts", F.map_keys("table_rows")).drop("_t")


def expectation_check(summaries: DataFrame, expectations: DataFrame) -> DataFrame:
    """doc, failures ARRAY<STRING>: the rules a summary breaks, in rule order.

    An expectation column that is missing or null asks for nothing.  ``table_rows`` is a
    number of rows or an array of them, each of which a table must have.
    """
    optional = {
        "scenes": "long", "min_scenes": "long", "min_text_blocks": "long", "tables": "long", "min_tables": "long",
        "table_rows": "array<long>", "shapes": "long", "charts": "long", "images": "long", "notes": "long", "text": "string",
        "note_text": "string", "cached_value": "string",
    }
    if dict(expectations.dtypes).get("table_rows", "array").split("<")[0] != "array":
        expectations = expectations.withColumn("table_rows", F.when(F.col("table_rows").isNotNull(), F.array("table_rows")))
    wanted = expectations.select(
        "doc",
        *[(F.col(c) if c in expectations.columns else F.lit(None)).cast(t).alias(f"x_{c}") for c, t in optional.items()],
    )
    joined = wanted.join(summaries.withColumn("_seen", F.lit(True)), "doc", "left")

    def rule(name: str, broken):
        want = F.col(f"x_{name}")
        return F.when(want.isNotNull() & broken(want), name)

    def differs(column: str):
        return lambda want: F.coalesce(F.col(column), F.lit(0)) != want

    def below(column: str):
        return lambda want: F.coalesce(F.col(column), F.lit(0)) < want

    def absent(column: str):
        return lambda want: ~F.contains(F.coalesce(F.col(column), F.lit("")), want)

    rules = F.array(
        rule("scenes", differs("scenes")),
        rule("min_scenes", below("scenes")),
        rule("min_text_blocks", below("text_blocks")),
        rule("tables", differs("tables")),
        rule("min_tables", below("tables")),
        rule("table_rows", lambda want: F.size(F.array_except(want, F.coalesce("table_row_counts", F.array().cast("array<long>")))) > 0),
        rule("shapes", differs("shapes")),
        rule("charts", differs("charts")),
        rule("images", differs("images")),
        rule("notes", below("notes")),
        rule("text", absent("text_corpus")),
        rule("note_text", absent("note_text")),
        rule("cached_value", absent("text_corpus")),
    )
    failures = F.when(F.col("_seen").isNull(), F.array(F.lit("no-summary"))).otherwise(F.filter(rules, lambda r: r.isNotNull()))
    return joined.select("doc", failures.alias("failures"))


def corpus_scorecard(results: DataFrame) -> DataFrame:
    """``results``: ok, structural_ok → totals, one row."""
    ok, structural = F.col("ok"), F.col("structural_ok")
    return results.agg(
        F.count_if(ok).alias("passed"),
        F.count_if(~ok).alias("failed"),
        F.count_if(ok & structural).alias("structural_passed"),
        F.count_if(ok & ~structural).alias("structural_failed"),
    )


def scene_limits(items: DataFrame, most: int) -> DataFrame:
    """Documents outside 1..``most`` scenes or without any content."""
    scenes = items.groupBy("doc", "scene").agg(F.bool_or(F.col("item_kind") != "").alias("filled"))
    docs = scenes.groupBy("doc").agg(F.count(F.lit(1)).alias("scenes"), F.bool_or("filled").alias("filled"))
    problem = F.when(F.col("scenes") > most, "too-many-scenes").when(~F.col("filled"), "no-content")
    return docs.select("doc", "scenes", problem.alias("problem")).where(F.col("problem").isNotNull())


# ---- load samples ----------------------------------------------------------------------


def latency_percentiles(samples: DataFrame, group: str = "concurrency") -> DataFrame:
    """p50, p95, max at rank ``min(n - 1, floor(n * f))``."""

    def rank(fraction: float):
        return F.least(F.col("n") - 1, F.floor(F.col("n") * fraction))

    out = values_at_rank(samples, [group], "ms", {"p50": rank(0.5), "p95": rank(0.95), "max_ms": F.col("n") - 1})
    return out.select(group, F.col("n").alias("requests"), "p50", "p95", "max_ms")


def status_histogram(samples: DataFrame, group: str = "concurrency", k: int = 3) -> DataFrame:
    """Counts per status, errors, first ``k`` failing paths per group."""
    counts = samples.groupBy(group, "status").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("ok")).alias("bad"))
    per_group = counts.groupBy(group).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "n")))).alias("statuses"),
        F.sum("n").alias("requests"),
        F.sum("bad").alias("errors"),
    )
    failing = (
        first_k(samples.where(~F.col("ok")), [group], ["ord"], k)
        .groupBy(group)
        .agg(F.array_sort(F.collect_list(F.struct("rn", "path"))).alias("_p"))
        .select(group, F.transform("_p", lambda p: p["path"]).alias("failed_paths"))
    )
    return per_group.join(failing, group, "left")


# ---- rasters, boxes, signals ---------------------------------------------------------------

CHANGED_LEVEL = 24


def raster_diff(pairs: DataFrame) -> DataFrame:
    """Mean absolute error and share of changed pixels of two rasters in one row.

    ``pairs``: width, height, channels, ref_width, ref_height, ref_channels,
    actual, reference (channel values row by row); alpha is not compared.
    """
    channels = F.col("channels")
    colour = F.least(F.lit(3), channels)
    same = (
        (F.col("width") == F.col("ref_width")) & (F.col("height") == F.col("ref_height")) & (channels == F.col("ref_channels"))
    )
    keys = [c for c in pairs.columns if c not in ("actual", "reference")]
    diffed = pairs.select(*keys, same.alias("geometry_match"), F.zip_with("actual", "reference", lambda a, b: F.abs(a - b)).alias("d"))
    pixels = F.col("width") * F.col("height")
    total = F.aggregate(F.filter("d", lambda v, i: i % channels < colour), F.lit(0).cast("long"), lambda a, v: a + v)
    changed = F.size(
        F.filter(
            F.sequence(F.lit(0), (pixels - 1).cast("int")),
            lambda p: F.exists(F.slice("d", (p * channels + 1).cast("int"), colour.cast("int")), lambda v: v > CHANGED_LEVEL),
        )
    )
    match = F.col("geometry_match")
    return diffed.select(
        *keys,
        "geometry_match",
        F.when(match, total / 255 / (pixels * colour)).otherwise(1.0).alias("mean_abs_error"),
        F.when(match, changed / pixels).otherwise(1.0).alias("changed_ratio"),
    )


def bounds_violations(boxes: DataFrame, slack: float = 0.5) -> DataFrame:
    """Boxes whose rotated bounds leave the page, are not finite, or whose page is odd."""
    turn = F.radians("angle")
    wide = F.abs(F.col("width") * F.cos(turn)) + F.abs(F.col("height") * F.sin(turn))
    high = F.abs(F.col("width") * F.sin(turn)) + F.abs(F.col("height") * F.cos(turn))
    left = F.col("x") + (F.col("width") - wide) / 2
    top = F.col("y") + (F.col("height") - high) / 2

    def odd(side: str):
        value = F.col(side)
        return value.isNull() | F.isnan(value) | (value < 72) | (value > 4000)

    placed = boxes.select("*", left.alias("_l"), top.alias("_t"), wide.alias("_w"), high.alias("_h"))
    finite = [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf")) for c in ("_l", "_t", "_w", "_h")]
    problem = (
        F.when(odd("page_width") | odd("page_height"), "page-size")
        .when(~(finite[0] & finite[1] & finite[2] & finite[3]), "not-finite")
        .when(
            (F.col("_l") < -slack)
            | (F.col("_t") < -slack)
            | (F.col("_l") + F.col("_w") > F.col("page_width") + slack)
            | (F.col("_t") + F.col("_h") > F.col("page_height") + slack),
            "outside",
        )
    )
    return placed.withColumn("problem", problem).where(F.col("problem").isNotNull()).drop("_l", "_t", "_w", "_h")


# Signals counted in source texts.
SIGNALS = {
    "fetch": r"\bfetch\s*\(",
    "xhr": r"XMLHttpRequest",
    "websocket": r"WebSocket",
    "beacon": r"sendBeacon",
    "wasm": r"(?i)WebAssembly|\.wasm\b",
    "worker": r"new\s+Worker\s*\(",
    "object_url_create": r"URL\.createObjectURL",
    "object_url_revoke": r"URL\.revokeObjectURL",
    "remote_url_literal": r"(?i)https?://",
}


def signal_counts(texts: DataFrame, column: str = "text") -> DataFrame:
    """signal, n over a corpus: summed on the map side, one row in the end, then unpivoted."""
    sums = texts.agg(*[F.sum(F.regexp_count(column, F.lit(p))).cast("long").alias(s) for s, p in SIGNALS.items()])
    return sums.unpivot([], list(SIGNALS), "signal", "n")
