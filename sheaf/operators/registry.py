"""A registry against the list of ids it should hold, and their order."""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordering import BLOCK, block_of, carry, kept, rank_in_group


def out_of_order(wants: np.ndarray) -> np.ndarray:
    """Mask of the fewest entries without which the numbers rise.

    The others are a longest rising subsequence: ``piles[k]`` is the entry with the least
    number that ends a rising run of k + 1 entries, and each entry remembers what it
    follows.
    """
    tops, piles, follows = [], [], np.full(len(wants), -1, np.int64)
    for i, want in enumerate(wants.tolist()):
        k = bisect_left(tops, want)
        if k:
            follows[i] = piles[k - 1]
        if k == len(tops):
            tops.append(want)
            piles.append(i)
        else:
            tops[k], piles[k] = want, i
    moved = np.ones(len(wants), bool)
    at = piles[-1] if piles else -1
    while at >= 0:
        moved[at] = False
        at = follows[at]
    return moved


def registry_order(expected: DataFrame, actual: DataFrame, retired: DataFrame, group: str = "registry", block: int = BLOCK) -> DataFrame:
    """``group``, ``id``, ``problem``: why ``actual`` is not ``expected`` in its order.

    ``expected`` and ``actual``: group, id, pos (an integer, unique per group); ``retired``:
    group, id.  ``retired`` ids must be absent whatever is expected; the others are
    ``missing``, ``unexpected`` or ``repeated`` (their first place counts) or ``moved``:
    the smallest set of ids whose removal leaves the rest in the expected order.  Rows
    with a null id or place are left out; a null group is a group.

    Ids that both sides hold are ranked on both, in blocks.  The first k of one side are
    the first k of the other exactly where the sum of (wanted - found rank) is 0: a cut,
    over which nothing moved.  Only stretches between cuts that hold something out of
    place are looked at in whole, as two integers an id; a registry with local moves is
    many of them, one with an id moved from end to end is a single one.
    """
    gone = retired.select(F.col(group).alias("_rg"), F.col("id").alias("_ri")).where(F.col("_ri").isNotNull()).distinct()

    def listed(rows: DataFrame) -> DataFrame:
        return rows.where(F.col("id").isNotNull() & F.col("pos").isNotNull()).select(group, "id", "pos")

    left = listed(expected).groupBy(group, "id").agg(F.min("pos").cast("long").alias("_pos"))
    right = listed(actual).groupBy(group, "id").agg(F.min("pos").cast("long").alias("_at"), F.count(F.lit(1)).alias("_n"))
    right = right.withColumnsRenamed({group: "_ag", "id": "_ai"})
    sides = left.join(right, left[group].eqNullSafe(right["_ag"]) & (left["id"] == right["_ai"]), "full_outer")
    sides = sides.select(
        F.when(F.col("_ai").isNotNull(), F.col("_ag")).otherwise(F.col(group)).alias(group),
        F.coalesce("id", "_ai").alias("id"), "_pos", "_at", "_n",
    )
    marked = sides.join(gone.withColumn("_gone", F.lit(True)), sides[group].eqNullSafe(F.col("_rg")) & (sides["id"] == F.col("_ri")), "left")
    marked = kept(marked.select(group, "id", "_pos", "_at", "_n", F.coalesce("_gone", F.lit(False)).alias("_gone")))

    seen, live = F.col("_at").isNotNull(), ~F.col("_gone")
    problems = F.array(
        F.when(F.col("_gone") & seen, "retired"),
        F.when(live & ~seen, "missing"),
        F.when(live & F.col("_pos").isNull(), "unexpected"),
        F.when(live & (F.col("_n") > 1), "repeated"),
    )
    plain = marked.select(group, "id", F.explode(F.filter(problems, lambda p: p.isNotNull())).alias("problem"))

    both = marked.where(live & seen & F.col("_pos").isNotNull()).select(group, "id", "_pos", "_at")
    ranked = rank_in_group(rank_in_group(both, [group], "_pos", "_want", block), [group], "_at", "_have", block)
    ranked = kept(ranked.select(group, "id", "_want", "_have").withColumn("_block", block_of("_have", block)))
    summed = kept(carry(ranked, [group], "_block", ["_have"], sums={"_sum": F.col("_want") - F.col("_have")}))
    parts = carry(summed, [group], "_block", ["_have"], before={"_cut": F.when(F.col("_sum") == 0, F.col("_have"))})
    # An id in its place at a cut is a stretch of its own.
    loose = parts.where((F.col("_sum") != 0) | (F.col("_want") != F.col("_have")))

    def moved(table: pa.Table) -> pa.Table:
        table = table.sort_by("_have")
        return table.filter(pa.array(out_of_order(table.column("_want").to_numpy()))).select([group, "id"])

    types = {f.name: f.dataType.simpleString() for f in marked.schema}
    found = loose.select(group, "id", "_want", "_have", F.coalesce("_cut", F.lit(0)).alias("_cut"))
    found = found.groupBy(group, "_cut").applyInArrow(moved, f"`{group}` {types[group]}, id {types['id']}")
    return plain.unionByName(found.withColumn("problem", F.lit("moved")))
