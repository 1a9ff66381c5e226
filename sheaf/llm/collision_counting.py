"""Near-duplicate vectors by counting collisions of one-dimensional projections.

Unit vectors are projected on Gaussian directions.  Two of them at distance d differ on
each direction by a normal deviate of spread d, so near ones collide in a window around
either's value far more often than others do.  Vectors first meet in tables of coarse
cells (of a few further projections, shifted at random), as many as find a pair at the
threshold but for odds of ``MISS``.  Inside a cell the vectors are sorted by one
projection; for each, those within its window are taken, collisions of ``COUNTED``
projections are counted, pairs below a count that pairs at the threshold reach but for
odds of ``MISS`` are dropped, and the others are verified by their exact cosine.

A pair is counted in the first table that it meets in, so only counts and labels leave
a task, not pairs.  Equal vectors are one with a multiplicity.  A cell with more than
``BLOCK`` vectors is dealt into pairs of blocks, so no task gets all of it.

The length of a cell's key follows the number of vectors, to keep cells small; with it
the number of tables grows as about n^0.2.

Defined cases: a vector that is null, empty, zero, or holds a null or non-finite
component links with nothing and is its own component; vectors of different length
never link; rows with equal or null ids are vectors of their own (``component_id``
ignores null ids); an empty table gives no rows; extra columns are not carried.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

COSINE = 0.95
MISS = 1e-4
CELL = 1.6  # width of a cell's side
PARTNERS = 40  # unrelated vectors wanted in a cell
COUNTED = 32
WINDOW = 2.6  # in spreads of a pair at the threshold
SORTED = 4.2  # the same on the sorted line, which every pair must pass
BLOCK = 512
SEED = 20240917


def meets(distance: float, width: float = CELL) -> float:
    """Odds that two vectors at a distance share a randomly shifted side of a cell."""
    x = width / distance
    return math.erf(x / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * x) * (1 - math.exp(-x * x / 2))


def layout(n: int, cosine: float = COSINE, miss: float = MISS) -> tuple[int, int]:
    """Projections of a key, and tables, for ``n`` vectors."""
    near, far = meets(math.sqrt(2 - 2 * cosine)), meets(math.sqrt(2))
    sides = max(1, math.ceil(math.log(max(n / PARTNERS, 1)) / -math.log(far)))
    return sides, math.ceil(math.log(miss) / math.log(1 - near**sides))


def least_count(counted: int = COUNTED, window: float = WINDOW, miss: float = MISS) -> int:
    """Largest count that a pair at the threshold misses with odds of at most ``miss``."""
    p, below, need = math.erf(window / math.sqrt(2)), 0.0, 0
    while below + math.comb(counted, need) * p**need * (1 - p) ** (counted - need) <= miss:
        below += math.comb(counted, need) * p**need * (1 - p) ** (counted - need)
        need += 1
    return need


def directions(size: int, count: int, stream: int) -> tuple[np.ndarray, np.ndarray]:
    """Gaussian directions for vectors of ``size``, and a shift for each."""
    draw = np.random.default_rng([SEED, size, stream])
    return draw.standard_normal((size, count)), draw.random(count)


def units(column: pa.Array, size: int) -> np.ndarray:
    values = column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()
    rows = values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)  # squares neither overflow nor vanish
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def cell_keys(vectors: np.ndarray, sides: int, tables: int) -> np.ndarray:
    along, shift = directions(vectors.shape[1], sides * tables, 0)
    cells = np.floor((vectors @ along) / CELL + shift).astype(np.int64).astype(np.uint64).reshape(len(vectors), tables, sides)
    out = np.broadcast_to(np.arange(1, tables + 1, dtype=np.uint64), cells.shape[:2]) * C.BASE + np.uint64(vectors.shape[1])
    for k in range(sides):
        out = C.mix(out + cells[:, :, k]) * C.BASE
    return out


def keyed(sides: int, tables: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                sizes = np.diff(batch.column("v").offsets.to_numpy())
                keys = np.zeros((batch.num_rows, tables), np.int64)
                for size in np.unique(sizes):
                    rows = np.flatnonzero(sizes == size)
                    keys[rows] = C.signed(cell_keys(units(batch.column("v").take(pa.array(rows)), int(size)), sides, tables))
                ends = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * tables)
                yield pa.RecordBatch.from_arrays([batch.column("node"), pa.ListArray.from_arrays(ends, pa.array(keys.ravel()))], names=["node", "keys"])

    return run


def collisions(vectors: np.ndarray, group: np.ndarray, spread: float, need: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of one group that collide in at least ``need`` of the projections."""
    values = vectors @ directions(vectors.shape[1], COUNTED, 1)[0]
    window, wide = WINDOW * spread, SORTED * spread
    # Groups lie far apart on the line that is sorted.
    line = values[:, 0] - values[:, 0].min() + group * (np.ptp(values[:, 0]) + 4 * wide)
    order = np.argsort(line, kind="stable")
    line = line[order]
    upto = np.searchsorted(line, line + wide, "right")
    ahead = upto - np.arange(len(line)) - 1
    a = np.repeat(np.arange(len(line)), ahead)
    b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(ahead) - ahead, ahead)
    a, b = order[a], order[b]
    count = np.zeros(len(a), np.int16)
    for m in range(COUNTED):
        count += np.abs(values[a, m] - values[b, m]) <= window
        if m % 4 == 3:  # pairs that can't reach the count any more
            live = count + (COUNTED - 1 - m) >= need
            a, b, count = a[live], b[live], count[live]
    return a[count >= need], b[count >= need]


def verified(cosine: float, sides: int, tables: int):
    """Groups of one cell (or pair of its blocks): links and a label per vector."""
    need, spread = least_count(), math.sqrt(2 - 2 * cosine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in C.grouped(batches, "cell", 2048):
            column = table.column("v").combine_chunks()
            sizes = np.diff(column.offsets.to_numpy())
            for size in np.unique(sizes):
                rows = np.flatnonzero(sizes == size)
                part = table.take(pa.array(rows))
                get = {c: part.column(c).to_numpy() for c in ("node", "times", "cell", "number", "own", "one")}
                vectors = units(part.column("v"), int(size))
                group = np.unique(get["cell"], return_inverse=True)[1]
                a, b = collisions(vectors, group, spread, need)
                apart = get["one"][a] | (get["own"][a] != get["own"][b])  # of two blocks, only pairs across
                a, b = a[apart], b[apart]
                near = [np.einsum("ij,ij->i", vectors[a[k : k + 65536]], vectors[b[k : k + 65536]]) >= cosine for k in range(0, len(a), 65536)]
                near = np.concatenate(near) if near else np.zeros(0, bool)
                a, b = a[near], b[near]
                if not len(a):
                    continue
                met = np.unique(np.concatenate([a, b]))
                at = np.searchsorted(met, [a, b])
                keys = cell_keys(vectors[met], sides, tables)
                first = np.ones(len(a), bool)
                for t in range(tables):
                    earlier = get["number"][a] > t
                    first &= ~(earlier & (keys[at[0], t] == keys[at[1], t]))
                links = np.zeros(len(met), np.int64)
                np.add.at(links, at[0][first], get["times"][b[first]])
                np.add.at(links, at[1][first], get["times"][a[first]])
                label = get["node"][met].copy()
                while True:
                    before = label.copy()
                    low = np.minimum(label[at[0]], label[at[1]])
                    np.minimum.at(label, at[0], low)
                    np.minimum.at(label, at[1], low)
                    if (label == before).all():
                        break
                yield pa.RecordBatch.from_arrays([pa.array(get["node"][met]), pa.array(links), pa.array(label)], names=["node", "links", "label"])

    return run


def near_vectors(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """One row per vector: id, ``n_links``, ``component_id``, ``kept``."""
    base = rows.select(F.col(vec_id).alias("id"), F.col(vector).alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    sound = F.coalesce(F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0), F.lit(False))
    distinct = base.where(sound).groupBy("v").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("times"))
    distinct = C.stash(distinct.withColumn("node", F.monotonically_increasing_id()), "vectors")
    sides, tables = layout(distinct.count(), cosine)

    places = C.stash(distinct.select("node", "v").mapInArrow(keyed(sides, tables), "node long, keys array<long>"), "places")
    each = places.select("node", F.posexplode("keys").alias("number", "key"))
    cells = each.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("key", F.ceil(F.col("c") / BLOCK).alias("blocks"))
    met = each.join(C.stash(cells, "cells"), "key").withColumn("own", F.expr("pmod(xxhash64(node, key), blocks)"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    cell = F.struct(
        F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("cell"), "number", "own", (F.col("own") == F.col("other")).alias("same")
    )
    wanted = C.stash(met.groupBy("node").agg(F.collect_list(cell).alias("cells")), "wanted")
    dealt = distinct.join(wanted, "node").select("node", "times", "v", F.explode("cells").alias("c"))
    # In the group of block i with itself every pair counts; across blocks only mixed ones.
    dealt = dealt.select("node", "times", "v", "c.cell", "c.number", "c.own", F.col("c.same").alias("one"))
    dealt = dealt.repartition("cell").sortWithinPartitions("cell")
    found = C.stash(dealt.mapInArrow(verified(cosine, sides, tables), "node long, links long, label long"), "links")

    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    labels = C.components(found.where("node <> label").select(F.col("node").alias("a"), F.col("label").alias("b")).distinct())
    nodes = distinct.join(links, "node", "left").join(labels, "node", "left")
    nodes = C.stash(nodes.select("node", "v", "id", "times", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("label", "node").alias("label")), "nodes")
    smallest = C.stash(nodes.groupBy("label").agg(F.min("id").alias("component_id")), "smallest")
    nodes = C.stash(nodes.join(smallest, "label").select("v", "times", "links", "component_id"), "classes")
    keys = base.withColumn("key", F.when(sound, F.col("v")))
    out = keys.join(nodes.withColumnRenamed("v", "key"), "key", "left")
    single = F.col("times").isNull()
    component = F.when(single, F.col("id")).otherwise(F.col("component_id"))
    return out.select(
        F.col("id").alias(vec_id),
        F.when(single, F.lit(0)).otherwise(F.col("links") + F.col("times") - 1).cast("long").alias("n_links"),
        component.cast("long").alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"),
    )
