"""Quality rules: cross-document line frequency.

Lines are normalised (A-Z lower-cased, white space runs made one space) and hashed;
for each host the documents that hold a line are counted.  Lines in more documents
than the limit are removed, and a document that loses too much by it is rejected;
``rest`` names a column for the text without these lines.

Defined cases: a null or empty text has no words and fails the base rules; a null
host is a host of its own; documents of one host with equal texts count as one (to
tell copies apart is the work of deduplication, not of this rule); rows with equal or
null ids are judged row by row; a line without a word is not a line here; of further
columns only those in ``keep`` are carried.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import common as C

MIN_DOCS = 5  # a line in as many documents of a host may be there by chance
DOC_SHARE = 0.02  # nor one in at most this share of the host's documents
LEAST_LEFT = 0.3  # share of its words that a document must keep
MIN_WORDS = 10
REPEAT_PERCENT = 20

WORD = re.compile(r"[^\x20\x09-\x0D]")
SYMBOLS = np.zeros(256, np.int64)
SYMBOLS[list(b"#*$%&|<>")] = 1


def line_bounds(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Starts of the lines of all rows, and the end of the last."""
    return np.unique(np.concatenate([bounds[:-1], np.flatnonzero(data == 10) + 1, bounds[-1:]]))


def measure(data: np.ndarray, bounds: np.ndarray) -> dict[str, np.ndarray | list]:
    """Base counts of some rows, and hash and words of each line with a word."""
    n = len(bounds) - 1
    starts, ends = C.word_spans(data, bounds)
    rows = C.row_of(bounds, starts)
    n_words = np.bincount(rows, minlength=n)
    points = ((data & 0xC0) != 0x80) & ~C.SEPARATOR[data]
    sums = C.prefix_sums(data)
    exact = C.slice_hash(sums, starts, ends)

    grams, first = C.windows(exact, rows, 5)
    keyed = C.mix(grams + rows[first].astype(np.uint64) * C.BASE)
    _, inverse, counts = np.unique(keyed, return_inverse=True, return_counts=True)
    again = first[counts[inverse] > 1]
    cover = np.zeros(len(starts) + 1, np.int64)
    np.add.at(cover, again, 1)
    np.add.at(cover, again + 5, -1)
    repeated = np.bincount(rows[np.cumsum(cover[:-1]) > 0], minlength=n)

    lines = line_bounds(data, bounds)
    begin, end = lines[:-1], lines[1:].copy()
    end[data[end - 1] == 10] -= 1
    line_row = C.row_of(bounds, begin)
    word_at = np.searchsorted(starts, np.append(begin, len(data)))
    in_line = np.diff(word_at)
    full = in_line > 0
    whole = C.slice_hash(sums, begin[full], end[full])
    once = np.unique(C.mix(whole + line_row[full].astype(np.uint64) * C.BASE), return_index=True)[1]
    n_lines = np.bincount(line_row[full], minlength=n)
    duplicate = n_lines - np.bincount(line_row[full][once], minlength=n)

    # Normalised lines: the sequence of lower-cased words.
    lowered = C.slice_hash(C.prefix_sums(C.LOWER[data]), starts, ends)
    chained = np.zeros(len(starts) + 1, np.uint64)
    np.cumsum(lowered * C.powers(len(starts))[0], out=chained[1:])
    norm = C.slice_hash(chained, word_at[:-1][full], word_at[1:][full])
    return {
        "n_words": n_words,
        "word_chars": C.sums_by_row(points, bounds),
        "n_symbols": C.sums_by_row(SYMBOLS[data], bounds),
        "n_dup_lines": duplicate,
        "n_repeat_words": repeated,
        "text_key": C.slice_hash(sums, bounds[:-1], bounds[1:]),
        "line_ends": np.concatenate([[0], np.cumsum(n_lines)]),
        "lines": norm,
        "line_words": in_line[full],
    }


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def profiles(docs: DataFrame, text: str, host: str, keep: list[str]) -> DataFrame:
    """One row per document: ``keep``, host, base counts, hashed lines."""
    kept = docs.select(*[F.col(c).alias(f"k_{i}") for i, c in enumerate(keep)], F.col(host).cast("string").alias("_host"), F.col(text).alias("_text"))
    head = [f for f in kept.schema.fields if f.name != "_text"]
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in head] + [f"{c} long" for c in [*COUNTS, "text_key"]] + ["lines array<long>", "line_words array<int>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, bounds in C.text_chunks(batch.column("_text")):
                got = measure(data, bounds)
                arrays = [batch.column(f.name).slice(lo, hi - lo) for f in head]
                arrays += [pa.array(np.asarray(got[c]).astype(np.int64)) for c in COUNTS] + [pa.array(C.signed(got["text_key"]))]
                ends = pa.array(got["line_ends"].astype(np.int32))
                arrays += [pa.ListArray.from_arrays(ends, pa.array(C.signed(got["lines"]))), pa.ListArray.from_arrays(ends, pa.array(got["line_words"].astype(np.int32)))]
                yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in head] + [*COUNTS, "text_key", "lines", "line_words"])

    return kept.mapInArrow(run, schema)


@F.arrow_udf(StringType())
def without(texts: pa.Array, gone: pa.Array) -> pa.Array:
    """Texts without some of their lines, told by their places among the lines with a word."""
    out = []
    for text, places in zip(texts.to_pylist(), gone.to_pylist()):
        if text is not None:
            lines = text.split("\n")
            full = [i for i, line in enumerate(lines) if WORD.search(line)]
            drop = {full[k] for k in places}
            text = "\n".join(line for i, line in enumerate(lines) if i not in drop)
        out.append(text)
    return pa.array(out, pa.string())


def line_frequency(
    docs: DataFrame,
    text: str = "text",
    host: str = "source",
    keep: tuple[str, ...] = ("doc_id",),
    min_docs: int = MIN_DOCS,
    doc_share: float = DOC_SHARE,
    least_left: float = LEAST_LEFT,
    rest: str | None = None,
) -> DataFrame:
    """``keep``, the base counts, ``n_removed_words``, ``base_failed``, ``kept`` and ``rest``.

    The text is read once; what follows works on hashes of lines, and on the texts that
    lose lines.  Counts are combined before each shuffle, so a line may stand in any share
    of documents.
    """
    keep = list(keep)
    carried = keep if rest is None or text in keep else [*keep, text]
    # The number of a row is made before the file is written, and stays.
    rows = C.stash(profiles(docs, text, host, carried).withColumn("_row", F.monotonically_increasing_id()), "lines")
    copies = rows.groupBy("_host", "text_key").agg(F.min("_row").alias("_row"))
    hosts = copies.groupBy("_host").agg(F.count(F.lit(1)).alias("_docs"))
    one_each = rows.select("_row", "_host", F.array_distinct("lines").alias("lines")).join(copies.select("_row"), "_row", "left_semi")
    seen = one_each.select("_host", F.explode("lines").alias("line")).groupBy("_host", "line").agg(F.count(F.lit(1)).alias("_n"))
    often = seen.where(F.col("_n") > min_docs)  # few are left before the hosts' sizes are looked up
    limit = F.greatest(F.lit(float(min_docs)), F.col("_docs") * doc_share)
    above = C.stash(often.alias("o").join(hosts.alias("h"), F.col("o._host").eqNullSafe(F.col("h._host"))).where(F.col("_n") > limit).select("o._host", "line"), "above")
    each = rows.select("_row", "_host", F.posexplode(F.arrays_zip("lines", "line_words")).alias("place", "l")).select("_row", "_host", "place", "l.lines", "l.line_words")
    lost = (
        each.alias("e")
        .join(above.alias("a"), (F.col("e.lines") == F.col("a.line")) & F.col("e._host").eqNullSafe(F.col("a._host")))
        .groupBy("_row")
        .agg(F.sum("line_words").cast("long").alias("_lost"), *([F.collect_list("place").alias("_gone")] if rest else []))
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    lost_words = F.coalesce("_lost", F.lit(0).cast("long"))
    depleted = F.col("n_words") - lost_words < F.col("n_words") * least_left
    texts = []
    if rest:
        whole = F.col(f"k_{carried.index(text)}")
        # Only texts that lose lines go to Python.
        texts = [F.when(F.col("_gone").isNull(), whole).otherwise(without(F.when(F.col("_gone").isNotNull(), whole), "_gone")).alias(rest)]
    return rows.drop("lines", "line_words").join(lost, "_row", "left").select(
        *[F.col(f"k_{i}").alias(c) for i, c in enumerate(keep)],
        *COUNTS,
        lost_words.alias("n_removed_words"),
        failed.alias("base_failed"),
        (~failed & ~depleted).alias("kept"),
        *texts,
    )
