"""From positioned text fragments back to readable text."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.links import safe_extracted_link
from ..functions.text import WS_CLASS, clean_trim, collapse_spaces, is_blank, solid
from .ordering import carry, join_on, kept

PAGE = ["doc", "page"]
LINE = ["doc", "page", "line_no"]
SHARE = 0.35
LEAST_TOLERANCE = 2.0
DEFAULT_SIZE = 12.0
BAND = 64.0

# What marks a list item, what ends a sentence, glyphs that join.
LIST_START = f"^(?:[-*+•●◦▪‣]|\\d+[.)]){WS_CLASS}+"
# The rest of a line; Java's dot would also stop at U+0085.
REST = r"[^\n\r\x{2028}\x{2029}]+"
BULLET = f"^[-*+•●◦▪‣]{WS_CLASS}+({REST})\\z"
NUMBERED = f"^(\\d+)[.)]{WS_CLASS}+({REST})\\z"
SENTENCE_END = r"[.!?:;]\z"
NO_SPACE_BEFORE = r"^[,.;:!?%)]"
NO_SPACE_AFTER = r"[(\[{/]\z"


def placed_items(items: DataFrame) -> DataFrame:
    size = F.greatest(F.lit(1.0), F.abs(F.coalesce("font_size", F.lit(DEFAULT_SIZE))))
    return items.where(~is_blank(F.col("str"))).withColumn("font_size", size)


def _tolerance(size: Column) -> Column:
    return F.greatest(F.lit(LEAST_TOLERANCE), size * SHARE)


def page_heights(items: DataFrame) -> DataFrame:
    """doc, page, y, size, chars, items: what lies at each height of a page, by type size.

    ``size`` is null for items that are blank, ``chars`` the characters that are not
    white space.
    """
    size = F.greatest(F.lit(1.0), F.abs(F.coalesce("font_size", F.lit(DEFAULT_SIZE))))
    sized = items.groupBy(*PAGE, "y", F.when(~is_blank(F.col("str")), size).alias("size"))
    return sized.agg(F.sum(F.length(solid(F.col("str")))).alias("chars"), F.count(F.lit(1)).alias("items"))


class PageLines:
    """The lines of a page so far; heights come from the top down.

    Lines lie ``LEAST_TOLERANCE`` apart at least, so a page has no more of them than its
    height allows, whatever it holds.
    """

    def __init__(self) -> None:
        self.tops: list[float] = []
        self.downs: list[float] = []  # the same below zero, rising

    def line_of(self, y: float, tolerance: float) -> int:
        """The first line near enough, which is opened if there is none."""
        at = bisect_left(self.downs, -y - tolerance)
        # Sums round: the line found may be a little too far, or the one before near enough.
        while at and self.tops[at - 1] - y <= tolerance:
            at -= 1
        while at < len(self.tops) and self.tops[at] - y > tolerance:
            at += 1
        if at == len(self.tops):
            self.tops.append(y)
            self.downs.append(-y)
        return at


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each height and size with its line; pages come one by one, downwards, and sizes of
    one height from the smallest on."""
    names = [*PAGE, "y", "font_size", "items"]
    page, lines = None, PageLines()
    for batch in batches:
        numbers, tops = [], []
        for doc, number, y, size in zip(*(batch.column(c).to_pylist() for c in names[:-1])):
            if (doc, number) != page:
                page, lines = (doc, number), PageLines()
            at = lines.line_of(y, max(LEAST_TOLERANCE, size * SHARE))
            numbers.append(at)
            tops.append(lines.tops[at])
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(numbers, pa.int32()), pa.array(tops, pa.float64())], names=[*names, "line_no", "line_y"])


def height_lines(heights: DataFrame) -> DataFrame:
    """doc, page, y, font_size, items, line_no, line_y: the line of each height and type size.

    Heights and lines of a page are merged in one pass from the top down, in which only
    the lines are held.  It sees each height and size once, however many items share
    them; these are combined before the shuffle.
    """
    asked = heights.where(F.col("size").isNotNull() & F.col("y").isNotNull()).select(*PAGE, F.col("y").cast("double").alias("y"), F.col("size").cast("double").alias("font_size"), "items")
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in asked.schema)
    ordered = asked.repartition(*PAGE).sortWithinPartitions(*PAGE, F.desc("y"), "font_size")
    return ordered.mapInArrow(_merged, f"{types}, line_no int, line_y double")


def group_lines(items: DataFrame, heights: DataFrame | None = None) -> DataFrame:
    """Adds line_no and line_y: the first line, top to bottom, close enough to the item.

    A new line starts where some item finds none near enough, and among items of one
    height the smallest one is the first to miss.  So the different heights and sizes of
    a page find their lines (an as-of match: the highest line no further above than
    allowed), and items look theirs up by height and size, which spreads a page out.
    ``heights`` may be handed in, cut down to the documents wanted; items of other pages
    are dropped, and so are items without a height.
    """
    placed = placed_items(items)
    lines = kept(height_lines(page_heights(items) if heights is None else heights))
    return placed.join(lines, [*PAGE, "y", "font_size"]).select(*placed.columns, "line_no", "line_y")


# An item of a run as it is sent: what its order and its gap need; the words lie beside it.
ITEM = np.dtype([("x", "<f8"), ("width", "<f8"), ("ord", "<i8"), ("bytes", "<u4"), ("nulls", "u1")])
NUMBERS = ("x", "width", "ord")
STEPPED = ("x", "ord")
RUN = 256  # items in a run at most
FOLDED = 1 << 18  # items put in order at once in a task
OPENING, CLOSING = (np.frombuffer(marks, np.uint8) for marks in (b",.;:!?%)", b"([{/"))  # as in NO_SPACE_BEFORE, NO_SPACE_AFTER


def _starts(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    """Where rows begin that differ from the row before them."""
    new = np.ones(batch.num_rows, bool)
    if batch.num_rows > 1:
        new[1:] = False
        for column in map(batch.column, names):
            here, before = column.slice(1), column.slice(0, len(column) - 1)
            one_null = pc.xor(here.is_null(), before.is_null())
            new[1:] |= pc.coalesce(pc.not_equal(here, before), one_null).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def _packed(names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Neighbouring items with equal ``names`` as one row: their number and, deflated, their
    numbers byte by byte and their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.num_rows
            items = np.zeros(size, ITEM)
            for bit, name in enumerate(NUMBERS):
                column = batch.column(name)
                items["nulls"] |= column.is_null().to_numpy(zero_copy_only=False).astype(np.uint8) << bit
                items[name] = column.fill_null(0).to_numpy(zero_copy_only=False)
            words = batch.column("value").cast(pa.large_binary())
            at = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + size + 1] if size else np.zeros(1, np.int64)
            items["bytes"] = np.diff(at)
            data = memoryview(words.buffers()[2] or b"")
            starts = _starts(batch, names)
            place = np.arange(size) - np.repeat(starts, np.diff(np.append(starts, size)))
            starts = np.flatnonzero(place % RUN == 0)
            # Steps repeat where values do not; those of x are steps of its bits.
            for name in STEPPED:
                bits = np.ascontiguousarray(items[name]).view(np.int64)
                steps = np.diff(bits, prepend=0)
                steps[starts] = bits[starts]
                items[name] = steps.view(items[name].dtype)
            spans = list(zip(starts.tolist(), [*starts[1:].tolist(), size]))[: len(starts)]
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c).take(pa.array(starts)) for c in names],
                    pa.array([hi - lo for lo, hi in spans], pa.int32()),
                    pa.array([zlib.compress(items[lo:hi].view(np.uint8).reshape(-1, ITEM.itemsize).T.tobytes() + data[at[lo] : at[hi]], 1) for lo, hi in spans], pa.binary()),
                ],
                names=[*names, "packed", "content"],
            )

    return run


def _texts(rows: pa.Table, groups: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """x and text of each line; ``groups`` numbers the lines of the runs, 0, 1, ... in order."""
    counts = rows.column("packed").to_numpy()
    parts = [zlib.decompress(b) for b in rows.column("content").to_pylist()]
    sizes = (counts.astype(np.int64) * ITEM.itemsize).tolist()
    items = np.concatenate([np.frombuffer(b, np.uint8, n).reshape(ITEM.itemsize, -1).T.copy().view(ITEM).reshape(-1) for b, n in zip(parts, sizes)])
    data = b"".join([b[n:] for b, n in zip(parts, sizes)])
    for name in STEPPED:
        upto = np.cumsum(np.ascontiguousarray(items[name]).view(np.int64))
        before = np.append(0, upto)[np.cumsum(counts, dtype=np.int64) - counts]
        items[name] = (upto - np.repeat(before, counts)).view(items[name].dtype)
    words = pa.Array.from_buffers(
        pa.large_string(), len(items), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(items["bytes"], dtype=np.int64)])), pa.py_buffer(data)]
    )
    group = np.repeat(groups, counts)
    y = rows.column("y").to_numpy()
    down = np.repeat(np.where(np.isnan(y), -np.inf, -y), counts)
    given = {name: items["nulls"] & (1 << bit) == 0 for bit, name in enumerate(NUMBERS)}
    order = np.lexsort((items["ord"], given["ord"], down, items["x"], given["x"], group))
    items, group, words = items[order], group[order], words.take(pa.array(order))
    x, has_x = items["x"], given["x"][order]
    reach = np.where(has_x & given["width"][order], x + items["width"], -np.inf)
    firsts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    ends = np.append(firsts[1:], len(items))
    edge = np.zeros(len(items))
    for lo, hi in zip(firsts.tolist(), ends.tolist()):
        np.maximum.accumulate(reach[lo : hi - 1], out=edge[lo + 1 : hi])
    edge = np.maximum(edge, 0.0)
    at = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(items) + 1]
    letters = np.frombuffer(words.buffers()[2] or b"\0", np.uint8)
    some = np.diff(at) > 0
    head = some & np.isin(letters[np.minimum(at[:-1], len(letters) - 1)], OPENING)
    tail = some & np.isin(letters[np.maximum(at[1:] - 1, 0)], CLOSING)
    # A sum that is no number is above any gap.
    with np.errstate(invalid="ignore"):
        space = has_x & ~(x - edge <= 1.5) & ~head
    space[1:] &= ~tail[:-1]
    space[firsts] = False
    pieces = pc.binary_join_element_wise(pc.if_else(pa.array(space), " ", "").cast(pa.large_string()), words, pa.scalar("", pa.large_string()))
    at = np.frombuffer(pieces.buffers()[1], np.int64)[pieces.offset : pieces.offset + len(items) + 1]
    text = pa.Array.from_buffers(pa.large_string(), len(firsts), [None, pa.py_buffer(np.append(at[firsts], at[-1])), pieces.buffers()[2]])
    left = np.fmin.reduceat(np.where(has_x, x, np.nan), firsts)
    return pa.array(left, mask=~np.logical_or.reduceat(has_x, firsts)), text.cast(pa.string())


def _line_texts(rows: pa.Table, groups: np.ndarray) -> tuple[pa.ChunkedArray, pa.ChunkedArray]:
    """``_texts`` of lines that together are ``FOLDED`` items, and so on."""
    firsts = np.flatnonzero(np.append(True, groups[1:] != groups[:-1]))
    part = np.cumsum(np.add.reduceat(rows.column("packed").to_numpy().astype(np.int64), firsts)) // FOLDED
    cuts = [*firsts[np.flatnonzero(np.append(True, part[1:] != part[:-1]))].tolist(), rows.num_rows]
    done = [_texts(rows.slice(lo, hi - lo), groups[lo:hi]) for lo, hi in zip(cuts, cuts[1:])]
    return pa.chunked_array([x for x, _ in done]), pa.chunked_array([text for _, text in done])


def _scattered(values: pa.ChunkedArray, where: np.ndarray) -> pa.Array:
    """The values in the places that are marked, null in the others."""
    return values.combine_chunks().take(pa.array(np.cumsum(where) - 1, mask=~where))


SENT = [*LINE, "line_y", "y", "font_size", "packed", "content"]


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs that are all of their line become its text; others stay as they are."""
    for batch in batches:
        whole = pc.equal(batch.column("packed"), batch.column("line_items")).to_numpy(zero_copy_only=False)
        columns = {c: batch.column(c) for c in SENT} | {"x": pa.nulls(batch.num_rows, pa.float64()), "text": pa.nulls(batch.num_rows, pa.string())}
        if whole.any():
            x, text = _line_texts(pa.Table.from_batches([batch.filter(pa.array(whole))]), np.arange(whole.sum()))
            columns |= {"x": _scattered(x, whole), "text": _scattered(text, whole)}
            columns["content"] = pc.if_else(pa.array(whole), pa.scalar(None, pa.binary()), columns["content"])
        yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per line; its runs come one after the other."""

    def finish(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(parts).combine_chunks()
        starts = _starts(rows.to_batches()[0], LINE)
        lines = rows.take(pa.array(starts))
        x, text = _line_texts(rows, np.repeat(np.arange(len(starts)), np.diff(np.append(starts, rows.num_rows))))
        size = pa.array(np.maximum.reduceat(rows.column("font_size").to_numpy(), starts))
        out = pa.Table.from_arrays([*[lines.column(c) for c in (*LINE, "line_y")], x, size, text], names=[*LINE, "y", "x", "font_size", "text"])
        return out.combine_chunks().to_batches()[0]

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        if held and any(batch.column(c)[0] != held[-1].column(c)[-1] for c in LINE):
            yield finish(held)
            held = []
        last = int(_starts(batch, LINE)[-1])
        if last:
            yield finish([*held, batch.slice(0, last)])
            held = []
        held.append(batch.slice(last))
    if held:
        yield finish(held)


def _runs(items: DataFrame, names: list[str]) -> DataFrame:
    """``names``, packed, content: neighbouring items as one row."""
    sent = items.select(
        *names, *[F.col(c).cast("long" if c == "ord" else "double").alias(c) for c in NUMBERS], collapse_spaces(F.col("str")).alias("value")
    )
    types = ", ".join(f"`{c}` {sent.schema[c].dataType.simpleString()}" for c in names)
    return sent.mapInArrow(_packed(names), f"{types}, packed int, content binary")


def _lines(runs: DataFrame, x: str) -> DataFrame:
    kinds = {c: runs.schema[c].dataType.simpleString() for c in PAGE}
    head = "".join(f"`{c}` {kind}, " for c, kind in kinds.items()) + "line_no int, "
    lines = (
        runs.repartition(*LINE).sortWithinPartitions(*LINE).mapInArrow(_joined, head + "y double, x double, font_size double, text string")
    )
    return lines.select(*LINE, "y", F.col("x").cast(x).alias("x"), "font_size", clean_trim(F.col("text")).alias("text"))


def join_items(grouped: DataFrame) -> DataFrame:
    """One row per line: text, y, x, font_size.

    A space goes in where the gap to everything before exceeds 1.5 units, unless
    punctuation says otherwise.  Neighbouring items are sent as one row.
    """
    placed = grouped.select("*", F.col("y").cast("double").alias("_y"), F.col("font_size").cast("double").alias("_size")).drop("y", "font_size")
    runs = _runs(placed.withColumnsRenamed({"_y": "y", "_size": "font_size"}), [*LINE, "line_y", "y", "font_size"])
    return _lines(runs, grouped.schema["x"].dataType.simpleString())


def text_lines(items: DataFrame, heights: DataFrame | None = None) -> DataFrame:
    """``join_items`` of ``group_lines``, with items sent once, in runs.

    Neighbouring items of one height and size are a run, which finds its line as
    ``group_lines`` says.  A run as long as its line is the line and done; the others of a
    line meet as in ``join_items``.  The result is read from tables.
    """
    placed = placed_items(items).withColumn("y", F.col("y").cast("double"))
    lines = height_lines(page_heights(items) if heights is None else heights)
    lines = kept(lines.withColumn("line_items", F.sum("items").over(Window.partitionBy(*LINE))).drop("items"))
    runs = _runs(placed.withColumn("font_size", F.col("font_size").cast("double")), [*PAGE, "y", "font_size"])
    found = runs.join(lines, [*PAGE, "y", "font_size"])
    types = {f.name: f.dataType.simpleString() for f in found.schema} | {"x": "double", "text": "string"}
    sent = kept(found.mapInArrow(_whole, ", ".join(f"`{c}` {types[c]}" for c in [*SENT, "x", "text"])).withColumn("text", clean_trim(F.col("text"))), "zstd")
    x = items.schema["x"].dataType.simpleString()
    whole = sent.where(F.col("text").isNotNull())
    apart = sent.where(F.col("text").isNull()).select(*SENT)
    return whole.select(*LINE, F.col("line_y").alias("y"), F.col("x").cast(x).alias("x"), "font_size", "text").unionByName(kept(_lines(apart, x), "zstd"))


def _banded(lines: DataFrame) -> DataFrame:
    """Height bands, downwards: what a page is scanned by, block by block."""
    return lines.withColumn("_band", F.floor(-F.col("y") / BAND).cast("long"))


# What of a list item decides that it is one: the mark, and how the rest goes on.
MARK = f"^((?:[-*+•●◦▪‣]|\\d+[.)]){WS_CLASS}*)"
BREAK = r"[\n\r\x{2028}\x{2029}]"


def line_marks(lines: DataFrame) -> DataFrame:
    """The lines with a text, without it: ``title`` if it may be a heading by its words,
    ``head`` what tells a list item, the same for the patterns as the text itself."""
    text = F.col("text")
    mark = F.regexp_extract(text, MARK, 1)
    rest = F.substring(text, F.length(mark) + 1, F.length(text))
    head = F.when(mark != "", F.concat(mark, F.when(rest == "", "").when(rest.rlike(BREAK), "x\n").otherwise("x"))).otherwise("")
    return lines.where(text != "").select(*[c for c in lines.columns if c != "text"], _title(text).alias("title"), head.alias("head"))


def shown_lines(lines: DataFrame) -> DataFrame:
    """The lines with a text, or their ``line_marks``, in bands: what gaps, spans and sizes
    are read from."""
    lines = lines.where(F.col("text") != "") if "text" in lines.columns else lines
    return _banded(lines).withColumn("_down", -F.col("y"))


def line_gaps(lines: DataFrame, shown: DataFrame | None = None) -> DataFrame:
    """Distance to the line above; 0 for the first line of a page.

    ``shown`` may be handed in: the ``shown_lines`` of lines that are in a table.
    """
    shown = kept(shown_lines(lines)) if shown is None else shown
    scanned = carry(shown, PAGE, "_band", ["_down", "x", "line_no"], before={"_above": F.col("y")}, sums={"seq": F.lit(1)})
    gap = F.greatest(F.lit(0.0), F.coalesce(F.col("_above") - F.col("y"), F.lit(0.0)))
    return scanned.select(*lines.columns, F.col("seq").cast("int").alias("seq"), gap.alias("gap_above"))


SLACK = 4.0


class OpenLinks:
    """The annotations over the height a sweep has come to: each url once, at the place
    of its first annotation."""

    def __init__(self) -> None:
        self.places: dict[str, list[int]] = {}
        self.shown: list[tuple[int, str]] = []

    def _replace(self, url: str, old: int | None) -> None:
        own = self.places[url]
        new = own[0] if own else None
        if new != old:
            if old is not None:
                del self.shown[bisect_left(self.shown, (old, url))]
            if new is not None:
                insort(self.shown, (new, url))

    def open(self, place: int, url: str) -> None:
        own = self.places.setdefault(url, [])
        old = own[0] if own else None
        insort(own, place)
        self._replace(url, old)

    def close(self, place: int, url: str) -> None:
        own = self.places[url]
        old = own[0]
        del own[bisect_left(own, place)]
        self._replace(url, old)
        if not own:
            del self.places[url]

    def tail(self) -> str:
        return "".join([f" [link]({url})" for _, url in self.shown])


GIVES, OPENS, LINE_AT, CLOSES = range(4)


def _swept(names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Lines with what is open over them and the size their band is given; bands come
    upwards, openings before lines and lines before closings of one height."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        band, open_, size = None, OpenLinks(), None
        for batch in batches:
            given = batch.column("body_size").to_pylist() if "body_size" in names else []
            kinds, places, urls = (batch.column(c).to_pylist() for c in ("_kind", "_place", "_url"))
            at, tails, sizes = [], [], []
            for i, mine in enumerate(zip(*(batch.column(c).to_pylist() for c in (*PAGE, "_band")))):
                if mine != band:
                    band, open_, size = mine, OpenLinks(), None
                if kinds[i] == GIVES:
                    size = given[i]
                elif kinds[i] == LINE_AT:
                    at.append(i)
                    tails.append(open_.tail() if open_.shown else "")
                    sizes.append(given[i] if given and size is None else size)
                elif kinds[i] == OPENS:
                    open_.open(places[i], urls[i])
                else:
                    open_.close(places[i], urls[i])
            arrays = [pa.array(sizes, pa.float64()) if c == "body_size" else batch.column(c).take(pa.array(at, pa.int64())) for c in names]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(tails, pa.string())], names=[*names, "_tail"])

    return run


def recover_links(lines: DataFrame, annotations: DataFrame, shown: DataFrame | None = None) -> DataFrame:
    """Appends ``[link](url)`` for every allowed annotation over a line's height.

    A sweep over heights: annotations open and close, a line takes what is open, in the
    order of the annotations and each url once, so that the work is the answer's.  Pages
    are cut into height bands; an annotation is cut to the span of its page's lines and
    opens again in each band it reaches.

    With ``shown``, the table that the lines were read from, they also get the
    ``body_size`` of their page, which each band is given first.
    """
    swept = link_tails(lines, annotations, shown)
    return swept.select(*[c for c in swept.columns if c != "tail"], F.concat("text", "tail").alias("linked"))


def link_tails(lines: DataFrame, annotations: DataFrame, shown: DataFrame | None = None) -> DataFrame:
    """``recover_links`` with what is appended alone, as ``tail``."""
    places = lines if shown is None else shown
    if shown is not None:
        lines = lines.withColumn("body_size", F.lit(None).cast("double"))
    low = F.least("y1", "y2") - SLACK
    high = F.greatest("y1", "y2") + SLACK
    notes = annotations.select(*PAGE, "ord", safe_extracted_link(F.col("url")).alias("url"), low.alias("low"), high.alias("high"))
    span = places.groupBy(*PAGE).agg(F.min("y").alias("_bottom"), F.max("y").alias("_top"))
    notes = notes.where(F.col("url").isNotNull() & (F.col("url") != "")).join(span, PAGE)
    first_band, last_band = F.floor(F.greatest("low", "_bottom") / BAND), F.floor(F.least("high", "_top") / BAND)
    notes = notes.where(first_band <= last_band).withColumn("_band", F.explode(F.sequence(first_band, last_band)))
    blank = lambda name: F.lit(None).cast(lines.schema[name].dataType).alias(name)
    others = [c for c in lines.columns if c not in PAGE]
    ends = F.explode(F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(at).alias("at")) for kind, at in ((OPENS, "low"), (CLOSES, "high"))]))
    events = notes.withColumn("_end", ends).select(
        *PAGE, *[blank(c) for c in others], "_band", F.col("_end.at").alias("_height"), F.col("_end.kind").alias("_kind"), F.col("ord").cast("long").alias("_place"), F.col("url").alias("_url")
    )
    asked = lines.select(
        *PAGE, *others, F.floor(F.col("y") / BAND).alias("_band"), F.col("y").alias("_height"), F.lit(LINE_AT).alias("_kind"), F.lit(None).cast("long").alias("_place"), F.lit(None).cast("string").alias("_url")
    )
    if shown is not None:
        bands = shown.select(*PAGE, F.floor(F.col("y") / BAND).alias("_band")).distinct()
        sizes = join_on(bands, body_sizes(shown), PAGE).withColumn("_kind", F.lit(GIVES)).withColumn("body_size", F.col("body_size").cast("double"))
        events = events.unionByName(sizes, allowMissingColumns=True)
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in lines.schema)
    swept = (
        asked.unionByName(events)
        .repartition(*PAGE, "_band")
        .sortWithinPartitions(*PAGE, "_band", "_height", "_kind", "_place")
        .mapInArrow(_swept(lines.columns), f"{types}, _tail string")
    )
    return swept.withColumnRenamed("_tail", "tail")


def body_sizes(lines: DataFrame) -> DataFrame:
    """doc, page, body_size: the upper median of the type sizes, from the counts of the
    different ones."""
    counts = lines.groupBy(*PAGE, "font_size").agg(F.count(F.lit(1)).alias("_c"))
    page = Window.partitionBy(*PAGE)
    ranked = counts.select(
        *PAGE, "font_size", F.sum("_c").over(page.orderBy("font_size").rowsBetween(Window.unboundedPreceding, 0)).alias("_upto"), F.sum("_c").over(page).alias("_n")
    )
    above = F.when(F.col("_upto") > F.floor(F.col("_n") / 2), F.col("font_size"))
    return ranked.groupBy(*PAGE).agg(F.coalesce(F.min(above), F.lit(DEFAULT_SIZE)).alias("body_size"))


def _title(text: Column) -> Column:
    return (F.length(text) <= 120) & ~text.rlike(SENTENCE_END) & ~text.rlike(LIST_START)


def heading_level(lines: DataFrame) -> DataFrame:
    """level 1–3 for heading lines, null for the rest; also the body size used, which may
    be there already.  ``title`` may stand for the text.

    The body size goes to every band of its page, so that the lines of a page meet it
    band by band.
    """
    sized = lines
    if "body_size" not in lines.columns:
        lines = kept(lines)
        sizes = join_on(_banded(lines).select(*PAGE, "_band").distinct(), body_sizes(lines), PAGE)
        sized = join_on(_banded(lines), sizes, [*PAGE, "_band"]).drop("_band")
    size, body = F.col("font_size"), F.col("body_size")
    title = F.col("title") if "title" in lines.columns else _title(F.col("text"))
    heading = title & (size >= F.greatest(F.lit(14.0), body * 1.4))
    level = F.when(size >= body * 1.8, 1).when(size >= body * 1.55, 2).otherwise(3)
    return sized.withColumn("level", F.when(heading, level))


def paragraphs(lines: DataFrame, by: list[str] | None = None, texts: DataFrame | None = None) -> DataFrame:
    """doc, page, block, kind, text from lines with level, seq, gap_above, linked.

    Blocks are dealt by ``by``, by page and block if it is not given.  With ``texts``, the
    texts by line, the lines have ``head`` and ``tail`` in place of ``linked``.
    """
    key, told = ([*PAGE, "seq"], F.col("linked")) if texts is None else (LINE, F.concat("head", "tail"))
    kind = F.when(F.col("level").isNotNull(), "heading").when(told.rlike(BULLET) | told.rlike(NUMBERED), "list").otherwise("text")
    wide = F.col("gap_above") > F.greatest(F.col("body_size") * 1.9, F.lit(18.0))
    # Blocks are numbered without texts, which meet their numbers once.
    names = list(dict.fromkeys([*key, "seq", "_band", "kind", "level", "linked" if texts is None else "tail"]))
    typed = kept(_banded(lines.withColumn("kind", kind)).select(*names, wide.alias("wide")))
    seen = carry(typed.select(*dict.fromkeys([*key, "seq"]), "_band", "kind", "wide"), PAGE, "_band", ["seq"], before={"_last": F.col("kind")})
    opens = (F.col("kind") != "text") | F.col("wide") | (F.coalesce("_last", F.lit("")) != "text")
    opened = seen.select(*dict.fromkeys([*key, "seq"]), "_band", F.when(opens, 1).otherwise(0).alias("opens"))
    numbered = carry(opened, PAGE, "_band", ["seq"], sums={"block": F.col("opens")}).select(*key, "block")
    typed = typed.drop("_band", "wide")
    if texts is None:
        placed = join_on(typed, numbered, key)
    else:  # read from tables of ``text_lines``, whose lines have no nulls
        placed = typed.join(numbered, LINE).join(texts.select(*LINE, "text"), LINE).withColumn("linked", F.concat("text", "tail"))
    linked = F.col("linked")
    numbers = F.concat(F.regexp_extract(linked, NUMBERED, 1), F.lit(". "), F.regexp_extract(linked, NUMBERED, 2))
    shown = (
        F.when(F.col("kind") == "heading", F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "), linked))
        .when((F.col("kind") == "list") & linked.rlike(NUMBERED), numbers)
        .when(F.col("kind") == "list", F.concat(F.lit("- "), F.regexp_extract(linked, BULLET, 1)))
        .otherwise(linked)
    )
    placed = placed.select(*PAGE, "block", "kind", "seq", shown.alias("shown"))
    blocks = (
        (placed.repartition(*by) if by else placed)
        .groupBy(*PAGE, "block")
        .agg(F.first("kind").alias("kind"), F.array_sort(F.collect_list(F.struct("seq", "shown"))).alias("parts"))
    )
    joined = F.array_join(F.transform("parts", lambda p: p["shown"]), " ")
    return blocks.select(
        *PAGE, "block", "kind", F.when(F.col("kind") == "text", clean_trim(joined)).otherwise(joined).alias("text")
    )


def page_markdown(blocks: DataFrame) -> DataFrame:
    pages = blocks.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("block", "text"))).alias("blocks"))
    return pages.select(*PAGE, clean_trim(F.array_join(F.transform("blocks", lambda b: b["text"]), "\n")).alias("text"))
