"""Greedy admission that stays exact on groups of any size.

A rejected element must not move the state, so a running sum is wrong.  In rounds,
each group offers its first ``STEP`` rows that lie behind the last one looked at and
still fit; they are folded in order and the state moves behind them.  A row that does
not fit once never fits later, and the first row offered always fits, so a group takes
one row a round at least and is done after as many rounds as it may take rows.  Spark
limits each group before the shuffle, so a group of any size sends ``STEP`` rows a map
task and never meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import kept

STEP = 64


def _fold(members: Column, taken: Column, left: Column, max_count: Column) -> Column:
    """Accepted positions of one group and the bytes left, after the offered members."""
    start = F.struct(taken.alias("taken"), left.alias("left"))

    def step(state: Column, item: Column) -> Column:
        fits = (F.size(state["taken"]) < max_count) & (item["size"] <= state["left"])
        return F.when(
            fits,
            F.struct(
                F.concat(state["taken"], F.array(item["pos"])).alias("taken"),
                (state["left"] - item["size"]).alias("left"),
            ),
        ).otherwise(state)

    return F.aggregate(members, start, step)


def greedy_picks(candidates: DataFrame, group: str, max_rounds: int, step: int = STEP) -> DataFrame:
    """Per group the accepted positions in order.

    ``candidates``: group, pos (unique in its group), size, max_count, max_bytes
    (the last two constant in a group).  Result: group, taken ARRAY<BIGINT>.
    """
    rows = kept(candidates.select(group, F.col("pos").cast("long"), F.col("size").cast("long"), "max_count", "max_bytes"))
    state = rows.groupBy(group).agg(F.first("max_count").alias("max_count"), F.first("max_bytes").cast("long").alias("left"))
    state = kept(
        state.select(
            group, "max_count", "left", F.lit(-(2**63)).alias("last"), F.expr("cast(array() as array<bigint>)").alias("taken"), (F.col("max_count") > 0).alias("open")
        )
    )
    first = Window.partitionBy(group).orderBy("pos")
    for _ in range(max_rounds + 1):
        live = state.where("open").select(group, "left", "last")
        offered = rows.select(group, "pos", "size").join(live, group).where((F.col("pos") > F.col("last")) & (F.col("size") <= F.col("left")))
        offered = offered.withColumn("turn", F.row_number().over(first)).where(F.col("turn") <= step)
        batch = offered.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("pos", "size"))).alias("members"))
        moved = state.join(batch, group, "left").withColumn("after", F.when(F.col("members").isNotNull(), _fold(F.col("members"), F.col("taken"), F.col("left"), F.col("max_count"))))
        state = moved.select(
            group,
            "max_count",
            F.coalesce("after.left", "left").alias("left"),
            F.coalesce(F.element_at("members", -1)["pos"], "last").alias("last"),
            F.coalesce("after.taken", "taken").alias("taken"),
            # Fewer than were asked for: there are no more.
            F.coalesce((F.size("members") == step) & (F.size("after.taken") < F.col("max_count")), F.lit(False)).alias("open"),
        )
        state = kept(state)
        if state.where("open").isEmpty():
            break
    return state.select(group, "taken")


def admit(files: DataFrame, group: str, max_rounds: int, stateless: list[tuple[Column, str]]) -> DataFrame:
    """Adds ``accepted`` and ``reason`` to every row.

    ``files``: group, pos, size, max_count, max_bytes, first_count (rows taken
    before this drop), first_bytes.  ``stateless``: (test, reason) pairs, first
    match wins, checked after the count cap and before the byte cap.
    """
    reason = F.lit(None).cast("string")
    for test, code in reversed(stateless):
        reason = F.when(test, code).otherwise(reason)
    marked = files.withColumn("own_reason", reason)
    room = F.col("max_count") - F.col("first_count")
    picks = greedy_picks(
        marked.where(F.col("own_reason").isNull()).select(
            group,
            "pos",
            "size",
            F.greatest(room, F.lit(0)).alias("max_count"),
            (F.col("max_bytes") - F.col("first_bytes")).alias("max_bytes"),
        ),
        group,
        max_rounds,
    )
    full_at = F.when(room <= 0, F.lit(-(2**63))).when(F.size("taken") >= room, F.element_at("taken", -1))
    joined = marked.join(picks, group, "left")
    accepted = F.coalesce(F.array_contains("taken", F.col("pos")), F.lit(False))
    why = (
        F.when(accepted, None)
        .when(F.col("pos") > full_at, "count")
        .when(F.col("own_reason").isNotNull(), F.col("own_reason"))
        .otherwise("total")
    )
    return joined.select(*files.columns, accepted.alias("accepted"), why.alias("reason"))
