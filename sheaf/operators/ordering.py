"""Ranks, running sums and order statistics that do not need one task per group.

A group is cut into blocks of its integer order key.  Blocks are summed with
map-side combine, the few block sums are scanned per group, and the last step
ranks inside a block.  No task ever sees more than one block of the big side, so
one group may hold any share of the rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir

BLOCK = 1 << 16


def kept(df: DataFrame, codec: str | None = None) -> DataFrame:
    """``df`` written once to the checkpoint folder and read back: what follows reads it
    as often as it likes, and a lost executor does not start it over.  (``checkpoint()``
    would compute it twice.)  ``codec`` is for tables of long texts."""
    path = f"{checkpoint_dir(df.sparkSession)}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def block_of(order: str, block: int = BLOCK) -> Column:
    return F.floor(F.col(order) / block).cast("long")


def join_on(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on keys that may be null; null meets null."""
    meets = [left[k].eqNullSafe(F.col(f"_right_{k}")) for k in keys]
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    return left.join(renamed, meets).drop(*[f"_right_{k}" for k in keys])


def exclusive_sum(
    totals: DataFrame, group: list[str], order: str, value: str, out: str, block: int = BLOCK, then: list[str] | None = None
) -> DataFrame:
    """Sum of ``value`` over the rows before this one.

    Order is ``order`` (an integer) and ``then``; unique per group.  Null groups and
    orders are a group and a block of their own.
    """
    blocked = totals.withColumn("_xblock", block_of(order, block))
    sums = blocked.groupBy(*group, "_xblock").agg(F.sum(value).alias("_xsum"))
    before = Window.partitionBy(*group).orderBy("_xblock").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*group, "_xblock", F.coalesce(F.sum("_xsum").over(before), F.lit(0)).alias("_xstart"))
    inside = Window.partitionBy(*group, "_xblock").orderBy(order, *(then or [])).rowsBetween(Window.unboundedPreceding, -1)
    return (
        join_on(blocked, starts, [*group, "_xblock"])
        .withColumn(out, F.col("_xstart") + F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .drop("_xblock", "_xstart")
    )


def rank_in_group(rows: DataFrame, group: list[str], order: str, out: str, block: int = BLOCK, ties: list[str] | None = None) -> DataFrame:
    """``row_number`` by ``order`` (an integer column) per group."""
    blocked = rows.withColumn("_block", block_of(order, block))
    counts = kept(blocked.groupBy(*group, "_block").agg(F.count(F.lit(1)).alias("_n")))
    starts = exclusive_sum(counts, group, "_block", "_n", "_start", block).select(*group, "_block", "_start")
    inside = Window.partitionBy(*group, "_block").orderBy(order, *(ties or []))
    return (
        join_on(blocked, starts, [*group, "_block"])
        .withColumn(out, (F.col("_start") + F.row_number().over(inside)).cast("long"))
        .drop("_block", "_start")
    )


def carry(
    rows: DataFrame,
    group: list[str],
    block: str,
    order: list[str],
    upto: dict[str, Column] | None = None,
    before: dict[str, Column] | None = None,
    sums: dict[str, Column] | None = None,
) -> DataFrame:
    """A scan of each group in order: the last value that is not null at or before each
    row (``upto``), strictly before it (``before``), and the sum up to it (``sums``); one
    column per entry.

    ``block`` rises with ``order`` (rising columns, unique per group).  Blocks hand on
    their last values and sums, one row a block, so only rows of one block meet in a task.
    """
    last, sums = {**(upto or {}), **(before or {})}, sums or {}
    at = F.struct(*order)
    named = rows.select("*", *[value.alias(f"_v_{name}") for name, value in {**last, **sums}.items()])
    ends = named.groupBy(*group, block).agg(
        *[F.max_by(f"_v_{name}", F.when(F.col(f"_v_{name}").isNotNull(), at)).alias(f"_l_{name}") for name in last],
        *[F.sum(f"_v_{name}").alias(f"_l_{name}") for name in sums],
    )
    past = Window.partitionBy(*group).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    handed = ends.select(
        *group,
        block,
        F.lit(False).alias("_own"),
        *[F.last(f"_l_{name}", ignorenulls=True).over(past).alias(f"_h_{name}") for name in last],
        *[F.coalesce(F.sum(f"_l_{name}").over(past), F.lit(0)).alias(f"_h_{name}") for name in sums],
    )
    # What a block is handed is its first row, so that its rows are dealt and sorted once.
    both = named.withColumn("_own", F.lit(True)).unionByName(handed, allowMissingColumns=True)
    inside = Window.partitionBy(*group, block).orderBy("_own", *order)
    upto_here = inside.rowsBetween(Window.unboundedPreceding, 0)
    own = []
    for name in last:
        frame = upto_here if name in (upto or {}) else inside.rowsBetween(Window.unboundedPreceding, -1)
        own.append(F.coalesce(F.last(f"_v_{name}", ignorenulls=True).over(frame), F.first(f"_h_{name}").over(upto_here)).alias(name))
    own += [(F.first(f"_h_{name}").over(upto_here) + F.sum(f"_v_{name}").over(upto_here)).alias(name) for name in sums]
    return both.select(*rows.columns, "_own", *own).where("_own").drop("_own")


def values_at_rank(rows: DataFrame, group: list[str], value: str, ranks: dict[str, Column]) -> DataFrame:
    """Exact order statistics per group.

    ``ranks`` maps an output name to a zero-based rank written over ``n``, the group size.
    Equal values are counted first and dealt by range into buckets of about equal size,
    whatever the values are; counts are summed per bucket, and only the bucket that holds
    a wanted rank is ranked value by value.
    """
    counts = rows.groupBy(*group, value).agg(F.count(F.lit(1)).alias("_c")).repartitionByRange(*group, value)
    counts = kept(counts.withColumn("_bucket", F.spark_partition_id()))
    buckets = counts.groupBy(*group, "_bucket").agg(F.sum("_c").alias("_b"))
    whole = Window.partitionBy(*group)
    upto = whole.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    wanted = buckets.select(
        *group,
        "_bucket",
        "_b",
        F.sum("_b").over(whole).alias("n"),
        F.coalesce(F.sum("_b").over(upto), F.lit(0)).alias("_start"),
    )
    asked = F.array(*[F.struct(F.lit(name).alias("name"), rank.cast("long").alias("rank")) for name, rank in ranks.items()])
    mine = F.filter(asked, lambda r: (r["rank"] >= F.col("_start")) & (r["rank"] < F.col("_start") + F.col("_b")))
    hits = wanted.select(*group, "_bucket", "_start", "n", mine.alias("_wants"), F.lit(False).alias("_own")).where(F.size("_wants") > 0)
    # A bucket's wishes are its first row, so that its values are dealt and sorted once.
    both = counts.withColumn("_own", F.lit(True)).unionByName(hits, allowMissingColumns=True)
    inside = Window.partitionBy(*group, "_bucket").orderBy("_own", value)
    head = inside.rowsBetween(Window.unboundedPreceding, 0)
    at = F.first("_start").over(head) + F.coalesce(F.sum("_c").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = both.select(*group, value, "_own", "_c", at.alias("_at"), F.first("n").over(head).alias("n"), F.first("_wants").over(head).alias("_wants"))
    here = F.filter("_wants", lambda r: (r["rank"] >= F.col("_at")) & (r["rank"] < F.col("_at") + F.col("_c")))
    found = placed.where(F.col("_own") & F.col("_wants").isNotNull()).select(*group, value, "n", F.explode(here["name"]).alias("_name"))
    return found.groupBy(*group).agg(
        F.max("n").alias("n"),
        *[F.max(F.when(F.col("_name") == name, F.col(value))).alias(name) for name in ranks],
    )


def upper_median(rows: DataFrame, group: list[str], value: str, out: str = "median") -> DataFrame:
    """Element at ``floor(n / 2)`` of the sorted finite values."""
    finite = rows.where(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(F.col(value)) < float("inf")))
    return values_at_rank(finite, group, value, {out: F.floor(F.col("n") / 2)})


def first_k(rows: DataFrame, group: list[str], order: list, k: int, out: str = "rn") -> DataFrame:
    """First ``k`` per group.  Spark limits each group before the shuffle, so a
    hot group sends ``k`` rows per map task, not all of them."""
    ranked = rows.withColumn(out, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return ranked.where(F.col(out) <= k)
