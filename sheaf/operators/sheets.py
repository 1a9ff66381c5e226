"""Workbooks as tables: values, styles, merges, grids, page plans.

Sheets are bounded by the reader (20 000 rows by 500 columns), so folds and
windows over the columns or rows of one sheet stay small; joins on cells carry
the row, the column or a tile in their key, so a big sheet spreads out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import dims
from ..functions.cells import cell_value, excel_date, infer_kind, is_external_formula, rowcol_to_a1, string_index
from ..functions.text import clamp

SHEET = ["file_id", "sheet_ord"]
PORTRAIT = (595.28, 841.89)
MARGIN = 32.0
TITLE = 34.0
TILE = 32


# ---- values and styles ------------------------------------------------------------


def shared_strings(cells: DataFrame, strings: DataFrame) -> DataFrame:
    """Adds ``shared``: the string a cell of type ``s`` points to, '' if there is none."""
    # Only the cells that point are dealt out; the others stay where they are.
    points = F.col("t").eqNullSafe("s")
    table = strings.select("file_id", F.col("idx").cast("double").alias("_idx"), F.col("text").alias("_text"))
    joined = cells.where(points).withColumn("_idx", string_index(F.col("v"))).join(table, ["file_id", "_idx"], "left")
    pointing = joined.select(*cells.columns, F.coalesce("_text", F.lit("")).alias("shared"))
    return pointing.unionByName(cells.where(~points).withColumn("shared", F.lit(None).cast("string")))


def typed_cells(cells: DataFrame) -> DataFrame:
    """Adds value_type, s, d, b and ``external``; wants ``shared`` next to t, v, f."""
    value = cell_value(F.col("t"), F.col("v"), F.col("shared"))
    typed = cells.withColumn("_value", value)
    return typed.select(
        *cells.columns,
        *[F.col(f"_value.{n}").alias(n) for n in ("value_type", "s", "d", "b")],
        is_external_formula(F.col("f")).alias("external"),
    )


def external_workbooks(cells: DataFrame) -> DataFrame:
    """Workbooks to refuse as a whole, with the number of offending formulas."""
    return cells.where(is_external_formula(F.col("f"))).groupBy("file_id").agg(F.count(F.lit(1)).alias("formulas"))


def resolved_styles(styles: DataFrame, fonts: DataFrame, fills: DataFrame, num_fmts: DataFrame) -> DataFrame:
    """One row per cell style with font, fill and number format looked up.

    Small against the cells; they join the result once.
    """
    builtin = dims.number_formats(styles.sparkSession).select(F.col("num_fmt_id"), F.col("code").alias("_builtin"))
    custom = num_fmts.select("file_id", "num_fmt_id", F.col("code").alias("_custom"))
    return (
        styles.withColumn("num_fmt_id", F.col("num_fmt_id").cast("long"))
        .join(fonts.select("file_id", F.col("idx").alias("font_id"), "bold", "italic", "underline", "color"), ["file_id", "font_id"], "left")
        .join(fills.select("file_id", F.col("idx").alias("fill_id"), "fill"), ["file_id", "fill_id"], "left")
        .join(custom, ["file_id", "num_fmt_id"], "left")
        .join(builtin, "num_fmt_id", "left")
        .select(
            "file_id",
            F.col("idx").alias("style_idx"),
            "bold",
            "italic",
            "underline",
            "color",
            "fill",
            F.when(F.col("align").isin("left", "center", "right"), F.col("align")).alias("align"),
            F.coalesce("_custom", "_builtin").alias("num_fmt_code"),
        )
    )


def style_snowflake(cells: DataFrame, styles: DataFrame, fonts: DataFrame, fills: DataFrame, num_fmts: DataFrame) -> DataFrame:
    return cells.join(resolved_styles(styles, fonts, fills, num_fmts), ["file_id", "style_idx"], "left")


def dated_cells(cells: DataFrame) -> DataFrame:
    """Adds ``iso_date`` for numbers under a date format (wants d, num_fmt_code)."""
    return cells.withColumn("iso_date", excel_date(F.col("d"), F.col("num_fmt_code")))


def display_text(cells: DataFrame) -> DataFrame:
    """Adds ``shown``: the cell as text."""
    number = F.when(F.col("d") == F.floor("d"), F.floor("d").cast("string")).otherwise(F.col("d").cast("string"))
    shown = F.coalesce("iso_date", "s", number, F.when(F.col("b").isNotNull(), F.col("b").cast("string")), F.lit(""))
    return cells.withColumn("shown", shown)


def infer_number(cells: DataFrame, header_rows: int) -> DataFrame:
    """Text cells of a table export: kind, number, formula, header flag, reference."""
    kind = infer_kind(F.col("text"))
    return cells.select(
        *cells.columns,
        rowcol_to_a1(F.col("row"), F.col("col")).alias("ref"),
        kind.alias("cell_kind"),
        F.when(kind == "number", F.col("text").try_cast("double")).alias("number"),
        F.when(kind == "formula", F.expr("substring(text, 2)")).alias("formula"),
        (F.col("row") < header_rows).alias("is_header"),
    )


def header_flags(cells: DataFrame, header_rows: int, header_columns: int) -> DataFrame:
    return cells.withColumn("is_header", (F.col("row") < header_rows) | (F.col("col") < header_columns))


# ---- grids ------------------------------------------------------------------------------


def sheet_sizes(cells: DataFrame) -> DataFrame:
    """Rows and columns of each sheet within the limits."""
    inside = (F.col("row") < dims.MAX_SHEET_ROWS) & (F.col("col") < dims.MAX_SHEET_COLUMNS)
    return cells.where(inside).groupBy(*SHEET).agg((F.max("row") + 1).alias("rows"), (F.max("col") + 1).alias("cols"))


def dense_rows(cells: DataFrame, value: str, ord: str | None = None) -> DataFrame:
    """One row per sheet row of the used rectangle: ``values``, blanks filled with ''.

    The cells of a row meet in one array (500 at most) and the gaps are filled inside it,
    so only cells that exist are shuffled, and they are read once: the width of a sheet and
    the gap before each row come from a window over its rows (20 000 at most).  Rows without
    a cell are made in that gap.  Of several cells at one place the last by ``ord`` stays, or
    the greatest value without one.
    """
    inside = (F.col("row") >= 0) & (F.col("row") < dims.MAX_SHEET_ROWS) & (F.col("col") >= 0) & (F.col("col") < dims.MAX_SHEET_COLUMNS)
    text = F.coalesce(F.col(value).cast("string"), F.lit(""))
    cell = F.struct(F.col("col").cast("int").alias("at"), (F.col(ord) if ord else F.lit(0)).alias("ord"), text.alias("size"))
    rows = cells.where(inside).groupBy(*SHEET, F.col("row").cast("long").alias("_last")).agg(F.sort_array(F.collect_list(cell)).alias("_cells"))
    last = F.filter("_cells", lambda c, i: F.coalesce(F.get("_cells", i + 1)["at"] != c["at"], F.lit(True)))
    once = F.size(F.array_distinct("_cells.at")) == F.size("_cells")
    rows = rows.withColumn("_cells", F.when(once, F.col("_cells")).otherwise(last))
    sheet = Window.partitionBy(*SHEET).orderBy("_last")
    whole = sheet.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    width = F.element_at("_cells.at", -1) + 1
    rows = rows.withColumn("cols", F.max(width).over(whole)).withColumn("_first", F.coalesce(F.lag("_last").over(sheet) + 1, F.lit(0).cast("long")))
    each = rows.select(*SHEET, F.explode(F.sequence("_first", "_last")).alias("row"), "_last", "_cells", "cols")
    # Most rows have no gap before their last cell.
    full = F.concat(F.col("_cells.size"), F.array_repeat(F.lit(""), F.col("cols") - F.size("_cells")))
    own = F.when(width == F.size("_cells"), full).otherwise(_dense(F.col("_cells"), F.col("cols")))
    values = F.when(F.col("row") == F.col("_last"), own).otherwise(F.array_repeat(F.lit(""), F.col("cols")))
    return each.select(*SHEET, "row", values.alias("values"))


def dense_grid(cells: DataFrame, value: str, ord: str | None = None) -> DataFrame:
    """Every cell of the used rectangle, a row each, blanks filled with ''."""
    rows = dense_rows(cells, value, ord)
    return rows.select(*SHEET, "row", F.posexplode("values").alias("col", value)).withColumn("col", F.col("col").cast("long"))


def expand_col_widths(spans: DataFrame) -> DataFrame:
    """``min..max`` spans to one row per column; the last span in the file wins."""
    low = F.greatest(F.lit(1), F.floor(F.coalesce("min_col", F.lit(1)))).cast("long") - 1
    high = F.least(F.lit(dims.MAX_SHEET_COLUMNS), F.floor(F.coalesce("max_col", low + 1))).cast("long")
    some = spans.withColumn("_low", low).withColumn("_high", high).where(F.col("_high") > F.col("_low"))
    columns = some.withColumn("col", F.explode(F.sequence(F.col("_low"), F.col("_high") - 1)))
    return columns.groupBy(*SHEET, "col").agg(F.max_by(clamp(F.col("width"), 3, 80, 10), "ord").alias("width"))


def blank_sheets(cells: DataFrame, value: str) -> DataFrame:
    """Sheets without a single readable cell."""
    blank = F.coalesce(F.trim(F.col(value)), F.lit("")) == ""
    return cells.groupBy(*SHEET).agg(F.bool_and(blank).alias("blank"), F.count(F.lit(1)).alias("cells")).where("blank")


# ---- merges ---------------------------------------------------------------------------------


def _tiled_merges(merges: DataFrame) -> DataFrame:
    """Merges cut by square tiles; a tile meets few cells and few merges."""
    last_row = F.least(F.col("row") + F.col("rowspan"), F.lit(dims.MAX_SHEET_ROWS)) - 1
    last_col = F.least(F.col("col") + F.col("colspan"), F.lit(dims.MAX_SHEET_COLUMNS)) - 1
    real = merges.where((F.col("row") < dims.MAX_SHEET_ROWS) & (F.col("col") < dims.MAX_SHEET_COLUMNS))
    tiles = real.withColumn("_tr", F.explode(F.sequence(F.floor(F.col("row") / TILE), F.floor(last_row / TILE))))
    tiles = tiles.withColumn("_tc", F.explode(F.sequence(F.floor(F.col("col") / TILE), F.floor(last_col / TILE))))
    return tiles.select(
        *SHEET, "_tr", "_tc",
        F.struct("ord", F.col("row").alias("m_row"), F.col("col").alias("m_col"), "rowspan", "colspan").alias("m"),
    )


def _with_tile(cells: DataFrame) -> DataFrame:
    return cells.withColumn("_tr", F.floor(F.col("row") / TILE)).withColumn("_tc", F.floor(F.col("col") / TILE))


def merge_cover(cells: DataFrame, merges: DataFrame) -> DataFrame:
    """Cells left after the covered ones are dropped.

    What the merges of a tile cover, but for the anchor of each, is one bit a cell: the
    rows of the tile are as many masks, joined by OR before and after the shuffle.  Cells
    then test their own bit, so no cell ever meets the merges of its tile one by one.
    """
    m, tiles = F.col("m"), _tiled_merges(merges)
    top, left = F.col("_tr") * TILE, F.col("_tc") * TILE
    first = F.greatest(m["m_col"] - left, F.lit(0)).cast("int")
    after = F.least(m["m_col"] + m["colspan"] - left, F.lit(TILE)).cast("int")
    one = F.lit(1).cast("long")
    span = _shifted(one, after) - _shifted(one, first)
    here = (m["m_col"] >= left) & (m["m_col"] < left + TILE)
    anchor = F.when(here, _shifted(one, first)).otherwise(F.lit(0).cast("long"))
    masks = tiles.withColumns({"_span": span, "_anchor": anchor})
    rows = []
    for k in range(TILE):
        mine = F.when(top + k == m["m_row"], F.col("_span").bitwiseAND(F.bitwise_not("_anchor"))).otherwise(F.col("_span"))
        inside = (top + k >= m["m_row"]) & (top + k < m["m_row"] + m["rowspan"])
        rows.append(F.coalesce(F.bit_or(F.when(inside, mine)), F.lit(0).cast("long")))
    covers = masks.groupBy(*SHEET, "_tr", "_tc").agg(F.array(*rows).alias("_rows"))
    joined = _with_tile(cells).join(covers, [*SHEET, "_tr", "_tc"], "left")
    mask = F.get(F.col("_rows"), (F.col("row") - top).cast("int"))
    bit = mask.bitwiseAND(_shifted(one, (F.col("col") - left).cast("int")))
    return joined.where(F.coalesce(bit, F.lit(0)) == 0).select(*cells.columns)


def _shifted(value: Column, by: Column) -> Column:
    return F.call_function("shiftleft", value, by)


SPAN = ["m_row", "m_col", "rowspan", "colspan"]
# A tile and what its row is, in one number: tile row, tile column, 0 for a merge or 1 for a cell.
WIDE = 1 << 20


def _painted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first merge over each cell of a tile.

    Tile by tile its merges come first, in order, then its cells.  A merge paints the
    places of the tile that are still free; a cell looks up its place, once.  The k-th
    merges of all tiles of a batch paint together; a tile that goes on in the next batch
    hands over its places.
    """
    key, held, met = None, None, None  # the last tile: spans by place (4, TILE, TILE), cells seen
    places = np.arange(TILE)
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        names = ("_at", "row", "col", "rowspan", "colspan")
        column = {c: pc.fill_null(batch.column(c), 0).to_numpy(zero_copy_only=False) for c in names}
        sheet = [pc.dictionary_encode(batch.column(c), null_encoding="encode").indices.to_numpy() for c in SHEET]
        tile, cell = column["_at"] >> 1, (column["_at"] & 1).astype(bool)
        new = np.zeros(n, bool)
        for values in (*sheet, tile):
            new[1:] |= values[1:] != values[:-1]
        group = np.cumsum(new)
        mine = [(*(batch.column(c)[i].as_py() for c in SHEET), tile[i].item()) for i in (0, n - 1)]
        goes_on = mine[0] == key
        top, left = (tile // WIDE) * TILE, (tile % WIDE) * TILE
        r0, c0 = column["row"] - top, column["col"] - left

        # Only tiles with merges get places.
        merged = np.flatnonzero(~cell)
        tiles = np.unique(np.append(group[merged], 0) if goes_on else group[merged])
        slot = np.full(group[-1] + 1, -1)
        slot[tiles] = np.arange(len(tiles))
        grid, free = np.full((len(tiles), TILE, TILE), -1, np.int32), np.full(len(tiles), TILE * TILE)
        owners = np.stack([column[c][merged] for c in ("row", "col", "rowspan", "colspan")])
        if goes_on:
            taken = np.flatnonzero(held[2].ravel() > 0)
            grid[0].ravel()[taken] = owners.shape[1] + np.arange(len(taken))
            owners = np.concatenate([owners, held.reshape(4, -1)[:, taken]], axis=1)
            free[0] -= len(taken)
        turn = np.arange(len(merged)) - np.searchsorted(group[merged], group[merged])
        order = np.argsort(turn, kind="stable")
        for lo, hi in _runs(turn[order], 1024):
            at = order[lo:hi]
            at = at[free[slot[group[merged[at]]]] > 0]
            if not len(at):
                continue
            i = merged[at]
            rows = (places >= r0[i, None]) & (places < (r0 + column["rowspan"])[i, None])
            cols = (places >= c0[i, None]) & (places < (c0 + column["colspan"])[i, None])
            where = slot[group[i]]
            part = grid[where]
            open_ = rows[:, :, None] & cols[:, None, :] & (part < 0)
            grid[where] = np.where(open_, at.astype(np.int32)[:, None, None], part)
            free[where] -= open_.sum(axis=(1, 2))

        # Of a cell that comes twice the first stays.
        asked = np.flatnonzero(cell)
        place = r0[asked] * TILE + c0[asked]
        _, once = np.unique(group[asked] * (TILE * TILE) + place, return_index=True)
        once.sort()
        if goes_on:
            once = once[~((group[asked[once]] == 0) & met[place[once]])]
        seen = met.copy() if goes_on and group[-1] == 0 else np.zeros(TILE * TILE, bool)
        seen[place[once][group[asked[once]] == group[-1]]] = True
        asked, place = asked[once], place[once]
        which = slot[group[asked]]
        owner = np.full(len(asked), -1)
        owner[which >= 0] = grid.reshape(len(tiles), TILE * TILE)[which[which >= 0], place[which >= 0]]
        spans = np.concatenate([owners, np.full((4, 1), -1)], axis=1)
        last = slot[group[-1]]
        here = spans[:, grid[last]] if last >= 0 else np.full((4, TILE, TILE), -1)
        key, held, met = mine[1], here, seen
        if len(asked):
            out = [pa.array(x, mask=owner < 0) for x in spans[:, owner]]
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(pa.array(asked)) for c in (*SHEET, "row", "col")], *out], names=[*SHEET, "row", "col", *SPAN])


def _runs(values: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Begin and end of each run of equal values, in pieces of ``most`` at most."""
    cuts = [0, *(np.flatnonzero(np.diff(values)) + 1).tolist(), len(values)]
    return [(at, min(at + most, hi)) for lo, hi in zip(cuts, cuts[1:]) for at in range(lo, hi, most)]


def merge_state(cells: DataFrame, merges: DataFrame) -> DataFrame:
    """restart / continue / none per cell; horizontally covered cells are skipped.

    The first merge of the file wins.  Merges and cells of a tile stream past in order,
    and what is held is a batch and the places of its tiles.
    """
    none = F.lit(None).cast("long")
    m = F.col("m")
    at = (F.col("_tr") * WIDE + F.col("_tc")) * 2
    events = _tiled_merges(merges).select(
        *SHEET, at.alias("_at"), m["ord"].cast("long").alias("ord"), *[m[c].cast("long").alias(o) for c, o in zip(SPAN, ("row", "col", "rowspan", "colspan"))]
    )
    asked = _with_tile(cells).select(
        *SHEET, (at + 1).alias("_at"), none.alias("ord"), F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), none.alias("rowspan"), none.alias("colspan")
    )
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cells.schema if f.name in SHEET)
    first = (
        asked.unionByName(events)
        .repartition(*SHEET, F.shiftright("_at", 1))
        .sortWithinPartitions(*SHEET, "_at", "ord", "row", "col", "rowspan", "colspan")
        .mapInArrow(_painted, f"{types}, row long, col long, " + ", ".join(f"{c} long" for c in SPAN))
    )
    none_here, start = F.col("m_row").isNull(), F.col("m_row")
    state = F.when(none_here, "none").when(F.col("row") > start, "continue").when(F.col("rowspan") > 1, "restart").otherwise("none")
    return first.where(none_here | (F.col("col") == F.col("m_col"))).select(
        *SHEET, *[F.col(c).cast(cells.schema[c].dataType).alias(c) for c in ("row", "col")], state.alias("v_merge"), F.coalesce("colspan", F.lit(1)).cast("long").alias("grid_span")
    )


def merge_span(merges: DataFrame, col_widths: DataFrame, row_heights: DataFrame, sizes: DataFrame) -> DataFrame:
    """Anchors with spans clipped to the sheet and the summed width and height."""
    clipped = merges.join(sizes, SHEET).select(
        *SHEET,
        "row",
        "col",
        F.greatest(F.lit(1), F.least(F.col("cols") - F.col("col"), F.col("colspan"))).cast("long").alias("colspan"),
        F.greatest(F.lit(1), F.least(F.col("rows") - F.col("row"), F.col("rowspan"))).cast("long").alias("rowspan"),
        "rows",
        "cols",
    )
    inside = clipped.where((F.col("row") < F.col("rows")) & (F.col("col") < F.col("cols")))
    anchor = [*SHEET, "row", "col"]
    across = inside.withColumn("at", F.explode(F.sequence(F.col("col"), F.col("col") + F.col("colspan") - 1))).join(
        col_widths.select(*SHEET, F.col("col").alias("at"), F.col("width").alias("w")), [*SHEET, "at"], "left"
    )
    widths = across.groupBy(*anchor, "rowspan", "colspan").agg(F.sum(F.coalesce("w", F.lit(80.0))).alias("merged_width"))
    down = inside.withColumn("at", F.explode(F.sequence(F.col("row"), F.col("row") + F.col("rowspan") - 1))).join(
        row_heights.select(*SHEET, F.col("row").alias("at"), F.col("height").alias("h")), [*SHEET, "at"], "left"
    )
    heights = down.groupBy(*anchor).agg(F.sum(F.coalesce("h", F.lit(22.0))).alias("merged_height"))
    return widths.join(heights, anchor)


# ---- page plans -----------------------------------------------------------------------------


def _entries(rows: DataFrame, key: str, value: str, most: int, out: str, bounded) -> DataFrame:
    """Explicit sizes of each sheet, held to their bounds, in order of their index (one row per index)."""
    rows = rows.where(F.col(key) < most)
    pair = F.struct(F.col(key).cast("int").alias("at"), bounded(F.col(value).cast("double")).alias("size"))
    return rows.where(F.col(value).isNotNull()).groupBy(*SHEET).agg(F.sort_array(F.collect_list(pair)).alias(out))


def _dense(found: Column, count: Column) -> Column:
    """Texts 0..count-1 with '' in every gap, in one pass (``found`` is a plain column)."""
    filled = F.transform(
        found,
        lambda e, i: F.concat(F.array_repeat(F.lit(""), e["at"] - F.coalesce(F.get(found, i - 1)["at"], F.lit(-1)) - 1), F.array(e["size"])),
    )
    rest = F.array_repeat(F.lit(""), count - F.coalesce(F.get(found, F.size(found) - 1)["at"], F.lit(-1)) - 1)
    return F.concat(F.flatten(filled), rest)


@F.arrow_udf(returnType=T.ArrayType(T.DoubleType()))
def _dense_sizes(at: pa.Array, size: pa.Array, count: pa.Array, default: pa.Array) -> pa.Array:
    """Sizes 0..count-1 of each sheet, the default where none is given."""
    counts = pc.fill_null(count, 0).to_numpy(zero_copy_only=False).astype(np.int64)
    given = pc.fill_null(pc.list_value_length(at), 0).to_numpy(zero_copy_only=False)
    ends = np.append(0, np.cumsum(counts))
    which = np.repeat(np.arange(len(counts)), given)
    places, sizes = at.flatten().to_numpy(zero_copy_only=False), size.flatten().to_numpy(zero_copy_only=False)
    own = (places >= 0) & (places < counts[which])
    flat = np.repeat(default.to_numpy(zero_copy_only=False), counts)
    flat[ends[:-1][which[own]] + places[own]] = sizes[own]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))


def sheet_layout(sizes: DataFrame, col_widths: DataFrame, row_heights: DataFrame) -> DataFrame:
    """One row per sheet: column widths, row heights, page orientation."""

    def bounded(low: float, high: float, factor: float = 1.0):
        return lambda v: F.least(F.lit(high), F.greatest(F.lit(low), v)) * factor

    joined = (
        sizes.join(_entries(col_widths, "col", "width", dims.MAX_SHEET_COLUMNS, "_w", bounded(3.0, 28.0, 7.0)), SHEET, "left")
        .join(_entries(row_heights, "row", "height", dims.MAX_SHEET_ROWS, "_h", bounded(12.0, 72.0)), SHEET, "left")
        .withColumn("rows", F.least(F.col("rows"), F.lit(dims.MAX_SHEET_ROWS)).cast("int"))
        .withColumn("cols", F.least(F.col("cols"), F.lit(dims.MAX_SHEET_COLUMNS)).cast("int"))
    )
    # A column without a width counts 12 characters, a row without a height 20 points.
    return joined.select(
        *SHEET,
        "rows",
        "cols",
        _dense_sizes("_w.at", "_w.size", "cols", F.lit(12.0 * 7.0)).alias("widths"),
        _dense_sizes("_h.at", "_h.size", "rows", F.lit(20.0)).alias("heights"),
    ).withColumn("landscape", F.aggregate("widths", F.lit(0.0), lambda a, w: a + w) > PORTRAIT[0] - 2 * MARGIN)


@F.arrow_udf(returnType=T.ArrayType(T.IntegerType()))
def _page_starts(sizes: pa.Array, room: pa.Array, head: pa.Array) -> pa.Array:
    """Start index of every page of a greedy pack.  All sheets of a batch go step by step
    together, the longest first, so sums are those of one sheet after the other."""
    count = pc.fill_null(pc.list_value_length(sizes), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat, first = sizes.flatten().to_numpy(zero_copy_only=False), np.cumsum(count) - count
    order = np.argsort(-count, kind="stable")
    begin, room, head = first[order], room.to_numpy(zero_copy_only=False)[order], head.to_numpy(zero_copy_only=False)[order]
    left = np.searchsorted(-count[order], -np.arange(int(count.max(initial=0))), "left")
    used, turns = np.zeros(len(order)), np.zeros(len(flat), bool)
    for i, n in enumerate(left):
        size = flat[begin[:n] + i]
        more = used[:n] + size
        turn = np.full(n, True) if i == 0 else more > room[:n]
        used[:n] = size if i == 0 else np.where(turn, size + head[:n], more)
        turns[begin[:n] + i] = turn
    at = np.flatnonzero(turns)
    ends = np.searchsorted(at, np.append(first, len(flat)))
    which = np.repeat(np.arange(len(order)), np.diff(ends))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(at - first[which], pa.int32()))


def _pack(sizes: Column, room: Column, header: bool = False) -> Column:
    """Start index of every page of a greedy pack; each page takes one at least.

    With ``header`` the first size is repeated on every page but the first.
    """
    head = F.coalesce(F.get(sizes, F.lit(0)), F.lit(0.0)) if header else F.lit(0.0)
    return _page_starts(sizes, room, head)


def _page_height(landscape: Column) -> Column:
    return F.when(landscape, PORTRAIT[0]).otherwise(PORTRAIT[1])


def _page_width(landscape: Column) -> Column:
    return F.when(landscape, PORTRAIT[1]).otherwise(PORTRAIT[0])


def _spans(starts: str, total: str, names: tuple[str, str, str]) -> Column:
    """First and last index of every page, as one array."""
    number, first, last = names
    return F.transform(
        starts, lambda s, i: F.struct(i.alias(number), s.alias(first), (F.coalesce(F.get(starts, i + 1), F.col(total)) - 1).alias(last))
    )


WINDOW, PAGE = ("window", "first_col", "last_col"), ("page", "first_row", "last_row")


def _window_starts() -> Column:
    return _pack(F.col("widths"), _page_width(F.col("landscape")) - 2 * MARGIN)


def _row_starts() -> Column:
    return _pack(F.col("heights"), _page_height(F.col("landscape")) - 2 * MARGIN - TITLE, header=True)


def _spread(layout: DataFrame, starts: Column, total: str, names: tuple[str, str, str]) -> DataFrame:
    packed = layout.select(*SHEET, "landscape", F.col(total).alias("_total"), starts.alias("_starts"))
    return packed.select(*SHEET, "landscape", F.inline_outer(_spans("_starts", "_total", names))).where(F.col(names[1]).isNotNull())


def column_windows(layout: DataFrame) -> DataFrame:
    return _spread(layout, _window_starts(), "cols", WINDOW).select(*SHEET, *WINDOW, "landscape")


def row_pages(layout: DataFrame) -> DataFrame:
    """Row pages with the first row repeated on every page but the first."""
    return _spread(layout, _row_starts(), "rows", PAGE).select(*SHEET, *PAGE)


def table_row_pages(layout: DataFrame) -> DataFrame:
    """Variant without a repeated header and with a top margin of 48."""
    room = F.greatest(F.lit(120.0), _page_height(F.col("landscape")) - 96.0)
    return _spread(layout, _pack(F.col("heights"), room), "rows", PAGE).select(*SHEET, *PAGE)


def clip_merges(merges: DataFrame, pages: DataFrame) -> DataFrame:
    """Merges cut to each row page they reach, rows counted from the page top.

    The pages of a sheet travel as one array, so this is one equi-join.
    """
    packed = pages.groupBy(*SHEET).agg(F.sort_array(F.collect_list(F.struct("page", "first_row", "last_row"))).alias("pages"))
    end = F.col("row") + F.col("rowspan")
    reached = F.filter("pages", lambda p: (p["first_row"] < end) & (p["last_row"] >= F.col("row")))
    hit = merges.join(packed, SHEET).select("*", F.explode(reached).alias("p"))
    top = F.greatest(F.col("row"), F.col("p.first_row"))
    bottom = F.least(F.col("row") + F.col("rowspan"), F.col("p.last_row") + 1)
    return hit.select(
        *SHEET,
        "ord",
        F.col("p.page").alias("page"),
        (top - F.col("p.first_row")).cast("long").alias("row"),
        "col",
        (bottom - top).cast("long").alias("rowspan"),
        "colspan",
    )


def window_merges(merges: DataFrame, layout: DataFrame) -> DataFrame:
    """Spreadsheet variant: a merge stays only inside a column window and with its
    anchor row on the page (the repeated first row counts).

    Pages and windows of a sheet are arrays of its one row: the layout is made once and
    meets the merges in one equi-join.
    """
    starts = layout.select(*SHEET, "rows", "cols", _row_starts().alias("_rows"), _window_starts().alias("_cols"))
    packed = starts.select(*SHEET, _spans("_rows", "rows", PAGE).alias("pages"), _spans("_cols", "cols", WINDOW).alias("windows"))
    row, col = F.col("row"), F.col("col")
    on_page = F.filter("pages", lambda p: ((p["first_row"] <= row) & (p["last_row"] >= row)) | ((row == 0) & (p["page"] > 0)))
    in_window = F.filter("windows", lambda w: (w["first_col"] <= col) & (col + F.col("colspan") - 1 <= w["last_col"]))
    hit = merges.join(packed, SHEET).withColumn("w", F.explode_outer(in_window)).where(F.col("w").isNotNull())
    hit = hit.withColumn("p", F.explode_outer(on_page)).where(F.col("p").isNotNull())
    local = F.when(row == 0, 0).otherwise(row - F.col("p.first_row") + F.when(F.col("p.page") > 0, 1).otherwise(0))
    return hit.select(
        *SHEET,
        "ord",
        F.col("p.page").alias("page"),
        F.col("w.window").alias("window"),
        local.cast("long").alias("row"),
        (col - F.col("w.first_col")).cast("long").alias("col"),
        "rowspan",
        "colspan",
    )


# ---- scenes ------------------------------------------------------------------------------------


def z_order(items: DataFrame) -> DataFrame:
    """Drawing order inside a scene: z, then objects, tables, text, then file order."""
    rank = F.when(F.col("item_kind").isin("shape", "image", "chart"), 0).when(F.col("item_kind") == "table", 1).otherwise(2)
    order = Window.partitionBy("doc", "scene").orderBy("z", rank, "ord")
    return items.withColumn("draw_no", F.row_number().over(order).cast("long"))
