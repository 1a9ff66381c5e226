"""Helpers the operators of this package share: text buffers, word and line
hashes in numpy, results kept in the shared folder, ranks and components.

Words are maximal runs of bytes outside ``[\\x20\\x09-\\x0D]``.  Hashes are 64 bits
wide: equal words always agree, different ones differ but for odds of 2^-64 a pair.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir

# Bytes of text worked on at once; numpy needs some 100 times as much for a moment.
CHUNK = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def stash(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written once to the shared checkpoint folder and read back: lineage
    ends there, and what executors have computed outlives them."""
    path = f"{checkpoint_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def held_out(modulus: int, remainder: int, doc_id: str = "doc_id") -> Column:
    """True for the rows kept from training.  A null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def train_rows(modulus: int, remainder: int, doc_id: str = "doc_id") -> Column:
    return ~held_out(modulus, remainder, doc_id)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the base and of its inverse, modulo 2^64."""
    if len(_POWERS[0]) < n:
        size = 1 << max(16, n.bit_length())
        inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        for k, base in enumerate((BASE, inverse)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS[0][:n], _POWERS[1][:n]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums that give the hash of any slice; see ``slice_hash``."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data))[0], out=sums[1:])
    return sums


def slice_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix((sums[ends] - sums[starts]) * powers(len(sums))[1][starts])


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the n + 1 bounds of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column) or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    bounds = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, bounds - bounds[0]


def row_chunks(bounds: np.ndarray, most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``most`` bytes, or of one longer row."""
    at, n = 0, len(bounds) - 1
    while at < n:
        to = int(np.searchsorted(bounds, bounds[at] + most, "right")) - 1
        to = min(n, max(at + 1, to))
        yield at, to
        at = to


def text_chunks(column: pa.Array, most: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, bounds) of the chunks of a string column."""
    data, bounds = text_buffer(column)
    for lo, hi in row_chunks(bounds, most):
        yield lo, hi, data[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo]


def word_spans(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words; a row's end ends its last word."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = ~SEPARATOR[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = word[:-1], word[1:]
    before[bounds[:-1][bounds[:-1] < len(data)]] = False
    after[bounds[1:][bounds[1:] > 0] - 1] = False
    return np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1


def row_of(bounds: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.searchsorted(bounds, at, "right") - 1


def _cuts(data: np.ndarray, most: int) -> list[int]:
    """Bounds of pieces of a long text, cut before separators only."""
    cuts, at = [0], 0
    while len(data) - at > most:
        gap = np.flatnonzero(SEPARATOR[data[at + most : at + 2 * most]])
        at += most + int(gap[0]) if len(gap) else most
        if len(gap):
            cuts.append(at)
    return [*cuts, len(data)]


def words(data: np.ndarray, bounds: np.ndarray, lower: bool = True, most: int = CHUNK) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every word of the rows, in order."""
    if lower:
        data = LOWER[data]
    cuts = [0, len(data)] if len(data) <= 2 * most else _cuts(data, most)
    hashes, rows = [], []
    for lo, hi in zip(cuts, cuts[1:]):
        part = data[lo:hi]
        starts, ends = word_spans(part, np.clip(bounds - lo, 0, hi - lo))
        hashes.append(slice_hash(prefix_sums(part), starts, ends))
        rows.append(row_of(bounds, starts + lo))
    return np.concatenate(hashes), np.concatenate(rows)


def windows(hashes: np.ndarray, rows: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``width`` words of one row, and the run's first word."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    first = np.flatnonzero(rows[:n] == rows[width - 1 :])
    out = hashes[first]
    for k in range(1, width):
        out = mix(out * BASE + hashes[first + k])
    return out, first


def sums_by_row(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of ``values`` (one a byte or an item) between consecutive bounds."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def grouped(batches: Iterator[pa.RecordBatch], key: str, least: int = 1) -> Iterator[pa.Table]:
    """Whole groups of rows with one key, from batches sorted by it: one group at a
    time, or as many as make up ``least`` rows."""
    held: list[pa.RecordBatch] = []
    rows, last = 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        begin = 0
        for cut in cuts[:-1]:
            if (cut or (held and keys[0] != last)) and rows + cut - begin >= least:
                if cut > begin:
                    held.append(batch.slice(begin, cut - begin))
                yield pa.Table.from_batches(held)
                held, rows, begin = [], 0, cut
        held.append(batch.slice(begin))
        rows += batch.num_rows - begin
        last = keys[-1]
    if held:
        yield pa.Table.from_batches(held)


def ranked(rows: DataFrame, group: list[str], key: str, ties: list[str], out: str, per_block: int = 20_000) -> DataFrame:
    """``out``: place of the row in its group, from 0, by ``key`` (a double in
    [0, 1), spread evenly) and then by ``ties``.

    The groups are cut into blocks of the key, so that one group may hold all the
    rows; blocks are counted first, and only rows of one block meet in a task.
    """
    rows = stash(rows, "ranked")
    blocks = max(1, -(-rows.count() // per_block))
    rows = rows.withColumn("_block", F.floor(F.col(key) * blocks).cast("long"))
    sizes = rows.groupBy(*group, "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = stash(sizes.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n"), "starts")
    keys = [*group, "_block"]
    both = rows.alias("r").join(starts.alias("s"), [F.col(f"r.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys])
    inside = Window.partitionBy(*[F.col(f"r.{k}") for k in keys]).orderBy(F.col(f"r.{key}"), *[F.col(f"r.{t}") for t in ties])
    place = (F.col("s._start") + F.row_number().over(inside) - 1).cast("long").alias(out)
    return both.select(*[F.col(f"r.{c}") for c in rows.columns if c != "_block"], place)


def uniform(seed: str, *columns: str) -> Column:
    """A number in [0, 1) drawn by the columns' values: 52 bits of an MD5."""
    parts = [F.lit(seed), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("long") / float(1 << 52)


def lowest(rows: DataFrame, group: str, key: str, ties: list[str], most: int, out: str) -> DataFrame:
    """The ``most`` rows of each group with the smallest ``key`` (a number in [0, 1) drawn
    by ``uniform``), then ``ties``; ``out`` numbers them from 1.

    Rows are counted by steps of the key's logarithm first, at most 52 * 64 of them a
    group, each 1.1 % wide.  Only rows up to the step that holds the last one wanted are
    sorted, so a task sorts about ``most`` rows, whatever a group holds.  The last steps,
    one row a group, are broadcast: groups are labels or languages, each with a model of
    its own on the driver.
    """
    step = F.floor(F.log2(F.greatest(F.col(key), F.lit(2.0**-52))) * 64)
    before = Window.partitionBy(group).orderBy("_step").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy(group, step.alias("_step")).agg(F.count(F.lit(1)).alias("_n"))
    some = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).where(F.col("_before") < most)
    edge = some.groupBy(group).agg(F.max("_step").alias("_edge"))
    near = rows.withColumn("_step", step).join(F.broadcast(edge), group).where("_step <= _edge").drop("_step", "_edge")
    first = Window.partitionBy(group).orderBy(key, *ties)
    return near.withColumn(out, F.row_number().over(first)).where(F.col(out) <= most)


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, label): the smallest node each node of ``edges`` (a, b) can reach.

    Every round takes the smallest label among a node's neighbours (combined on
    the map side, so a node may have any number of them) and then that label's own
    label; labels halve the way left, and each round is kept in the shared folder.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = stash(both.where("a <> b").distinct(), "edges")
    labels = stash(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"), "labels")
    for _ in range(most_rounds):
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        hooked = labels.join(near, labels.node == near.a, "left").select("node", F.col("label").alias("old"), F.least("label", "near").alias("step"))
        up = labels.select(F.col("node").alias("step"), F.col("label").alias("up"))
        after = stash(hooked.join(up, "step", "left").select("node", "old", F.coalesce(F.least("step", "up"), "step").alias("label")), "labels")
        labels = after.select("node", "label")
        if after.where("label <> old").isEmpty():
            return labels
    raise RuntimeError(f"components did not settle within {most_rounds} rounds")
