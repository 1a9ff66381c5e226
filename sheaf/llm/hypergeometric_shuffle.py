"""Uniform shuffle into shards of exact sizes by a communication matrix.

Rows lie in many small partitions (by hash).  How many rows of partition p go to shard
s is drawn exactly as a uniform permutation of all rows would have it: a row of
multivariate hypergeometric counts per partition, from the places the shards still
have.  Each partition is permuted and cut by its counts, the pieces are exchanged, and
each shard is permuted again.  Shard sizes differ by one at most (law ``rows``).

The matrix has one row of ``shards`` numbers per ``PER_BLOCK`` rows of input: a few MB
for a thousand million rows.  It is drawn from the counts of the partitions alone.

Defined cases: null ids, repeated rows and equal texts are rows like others, and equal
rows may go to different shards; a null text has size 1; an empty table has no rows in
any shard; fewer rows than shards leave shards empty; columns of the input are kept.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

PER_BLOCK = 20_000


def communication_matrix(counts: np.ndarray, shards: int, seed: str) -> np.ndarray:
    """Rows of partition p that go to shard s, with exact sums both ways."""
    total = int(counts.sum())
    free = np.full(shards, total // shards, np.int64)
    free[: total % shards] += 1
    draw = np.random.Generator(np.random.PCG64(zlib.crc32(seed.encode())))
    matrix = np.zeros((len(counts), shards), np.int64)
    for p, n in enumerate(counts):
        # Shard after shard, each from what the ones before it have left.
        left, open_places = int(n), int(free.sum())
        for s in range(shards):
            took = free[s]
            if left and s < shards - 1:
                matrix[p, s] = hypergeometric(draw, int(took), open_places - int(took), left)
            else:
                matrix[p, s] = left
            left -= int(matrix[p, s])
            open_places -= int(took)
        free -= matrix[p]
    return matrix


def hypergeometric(draw: np.random.Generator, good: int, bad: int, n: int) -> int:
    """numpy's method stops at 10^9; beyond it the distribution is inverted over twelve
    deviations around its mode, outside of which less than 10^-30 lies."""
    if good + bad < 10**9:
        return int(draw.hypergeometric(good, bad, n))
    mean = n * good / (good + bad)
    spread = 12 * (mean * bad / (good + bad)) ** 0.5 + 40
    k = np.arange(max(0, n - bad, int(mean - spread)), min(good, n, int(mean + spread)) + 1, dtype=np.float64)
    steps = np.log((good - k[:-1]) * (n - k[:-1])) - np.log((k[:-1] + 1) * (bad - n + k[:-1] + 1))
    level = np.concatenate([[0.0], np.cumsum(steps)])
    upto = np.cumsum(np.exp(level - level.max()))
    return int(k[min(len(k) - 1, np.searchsorted(upto, draw.random() * upto[-1], "right"))])


def shuffle_into(rows: DataFrame, shards: int, identity: list[str], seed: str = "shards", per_block: int = PER_BLOCK) -> DataFrame:
    """``rows`` with ``shard`` and ``slot`` (gapless from 0 in each shard).

    ``identity`` names columns whose values tell rows apart; rows equal in all of them
    are interchangeable.
    """
    drawn = C.stash(
        rows.withColumn("_u", C.uniform(f"{seed}/from", *identity)).withColumn("_v", C.uniform(f"{seed}/first", *identity)).withColumn("_w", C.uniform(f"{seed}/second", *identity)),
        "drawn",
    )
    partitions = max(1, -(-drawn.count() // per_block))
    parts = drawn.withColumn("_part", F.floor(F.col("_u") * partitions).cast("int"))
    counted = {r["_part"]: r["n"] for r in parts.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}
    counts = np.array([counted.get(p, 0) for p in range(partitions)], np.int64)
    ends = np.cumsum(communication_matrix(counts, shards, seed), axis=1)
    spark = rows.sparkSession
    matrix = spark.createDataFrame([(p, [int(x) for x in e]) for p, e in enumerate(ends)], "_part int, _ends array<long>")
    place = F.row_number().over(Window.partitionBy("_part").orderBy("_v", *identity)) - 1
    sent = parts.withColumn("_place", place).join(matrix, "_part")
    sent = sent.withColumn("shard", F.size(F.filter("_ends", lambda e: e <= F.col("_place"))).cast("int")).drop("_u", "_v", "_part", "_place", "_ends")
    return C.ranked(sent, ["shard"], "_w", identity, "slot", per_block).drop("_w")


def write_shards(rows: DataFrame, path: str) -> None:
    """One folder a shard, rows in the order of their slots within each file."""
    rows.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
