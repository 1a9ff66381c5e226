"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document draws an exponential key whose rate is its quality weight; sorted by
the key, the first documents of a source are a weighted sample without replacement.
A source whose target is ``e`` times its size and a part gets ``e`` whole epochs, and
the part is the prefix of that order whose sizes come nearest to what is missing.

Sources in order of their code points, null last, have the given weights in turn.
Targets share the sum of all sizes by weight; what exceeds ``most`` times a source's
size is shared anew among the others.

Defined cases: a null or empty text has size 0 and is taken only as part of an epoch;
a null source is a source of its own, the last; equal keys (repeated rows) are
ordered by id and size, and rows equal in all of these count alike; an empty table
gives an empty mix; extra columns are not carried unless named in ``keep``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3
BLOCK = 2_000  # documents of a block of keys
WORD = r"[^\x20\x09-\x0D]+"
LEAST_WEIGHT = 0.05


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text: str) -> Column:
    """Share of characters that are no symbol, at least ``LEAST_WEIGHT``."""
    plain = F.length(F.translate(F.col(text), "#*$%&|<>{}[]\\^~_=+@!", "")) / F.length(text)
    return F.when(F.length(text) > 0, F.greatest(plain, F.lit(LEAST_WEIGHT))).otherwise(1.0)


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``sizes`` (source, source_size, ...) with ``weight`` and ``target``.

    Shares rise together; a source leaves when it reaches ``most`` times its size.
    Sorted by the level at which that happens, one running sum finds the last level.
    The table has one row per source.
    """
    everything = Window.partitionBy(F.lit(0))
    turn = (F.row_number().over(everything.orderBy(F.col("source").isNull(), "source")) - 1) % len(weights)
    known = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn + 1))
    known = known.withColumn("_level", F.col("source_size") * most / F.col("weight"))
    by_level = everything.orderBy("_level", F.col("source").isNull(), "source")
    full = F.coalesce(F.sum(F.col("source_size") * most).over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing))
    known = known.withColumn("_share", (F.sum("source_size").over(everything) - full) / rest)
    # The level of the first source, in this order, that is not filled, if any.
    known = known.withColumn("_order", F.row_number().over(by_level))
    open_ones = F.when(F.col("_share") < F.col("_level"), F.struct("_order", "_share"))
    known = known.withColumn("_last", F.min(open_ones).over(everything)["_share"])
    target = F.least(F.col("source_size") * most, F.col("weight") * F.coalesce("_last", F.col("_level")))
    return known.withColumn("target", target.cast("double")).drop("_level", "_share", "_order", "_last")


def mix(
    docs: DataFrame,
    text: str = "text",
    source: str = "source",
    doc_id: str = "doc_id",
    keep: tuple[str, ...] = ("doc_id",),
    weights: tuple[float, ...] = WEIGHTS,
    most: int = MOST,
    quality: Column | None = None,
    seed: str = "mix",
) -> DataFrame:
    """``keep``, ``size``, ``source_size``, ``target``, ``times`` (copies taken) and
    ``taken`` (words).

    The text is read once, for sizes.  Sizes are summed per block of keys; only the
    block in which a source's part ends is ordered row by row.
    """
    cols = [f"k_{i}" for i in range(len(keep))]
    base = docs.select(
        *[F.col(c).alias(k) for c, k in zip(keep, cols)],
        F.col(doc_id).cast("string").alias("_id"),
        F.col(source).cast("string").alias("source"),
        word_count(text).alias("size"),
        (quality_weight(text) if quality is None else quality).cast("double").alias("_weight"),
        C.uniform(seed, doc_id).alias("_u"),
    )
    drawn = base.withColumn("_key", -F.log(F.lit(1.0) - F.col("_u")) / F.col("_weight"))
    drawn = C.stash(drawn.drop("_weight", "_u"), "drawn")

    sizes = drawn.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_docs"))
    plan = targets(sizes, weights, most)
    epochs = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(most))).otherwise(0)
    plan = plan.withColumn("_epochs", epochs.cast("int"))
    plan = plan.withColumn("_part", F.col("target") - F.col("_epochs") * F.col("source_size"))
    plan = C.stash(plan.withColumn("_blocks", F.ceil(F.col("_docs") / BLOCK)).drop("_docs"), "plan")

    # 1 - exp(-key) rises with the key and lies in [0, 1).
    placed = drawn.alias("d").join(plan.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source"))).drop(F.col("p.source"))
    placed = placed.withColumn("_block", F.floor((F.lit(1.0) - F.exp(-F.col("_key"))) * F.col("_blocks")).cast("long"))
    blocks = placed.groupBy("source", "_block", "_part").agg(F.sum("size").alias("_sum"))
    upto = Window.partitionBy("source").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_start", F.coalesce(F.sum("_sum").over(upto), F.lit(0)))
    last = blocks.where((F.col("_start") < F.col("_part")) & (F.col("_start") + F.col("_sum") >= F.col("_part")))
    last = C.stash(last.groupBy("source").agg(F.min("_block").alias("_last"), F.min("_start").alias("_start")), "last")

    placed = placed.alias("d").join(last.alias("l"), F.col("d.source").eqNullSafe(F.col("l.source")), "left").drop(F.col("l.source"))
    whole = placed.where(F.col("_last").isNull() | (F.col("_block") != F.col("_last"))).withColumn("_more", F.coalesce(F.col("_block") < F.col("_last"), F.lit(False)))
    order = Window.partitionBy("source").orderBy("_key", "_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    inner = placed.where(F.col("_block") == F.col("_last"))
    before = F.col("_start") + F.coalesce(F.sum("size").over(order), F.lit(0))
    inner = inner.withColumn("_more", before + F.col("size") / 2 <= F.col("_part"))
    out = whole.unionByName(inner).withColumn("times", F.col("_epochs") + F.col("_more").cast("int"))
    return out.select(
        *[F.col(k).alias(c) for c, k in zip(keep, cols)], "size", "source_size", "target", "times", (F.col("size") * F.col("times")).alias("taken")
    )


def mixed_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """``docs`` as the mix has them: each row as often as it is taken."""
    from functools import reduce

    key = F.xxhash64(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.coalesce(text, F.lit("")))
    keyed = docs.withColumn("_mix_key", key)
    taken = mix(keyed, text=text, doc_id=doc_id, keep=("_mix_key",), **how)
    # Rows repeated in full share a key: their copies are dealt evenly, none is lost.
    taken = C.stash(taken.groupBy("_mix_key").agg(F.sum("times").alias("_times"), F.count(F.lit(1)).alias("_rows")), "taken")
    # A merge join at every size: the other side has a row a document.
    single = keyed.hint("merge").join(taken.where("_rows = 1 and _times > 0").select("_mix_key", "_times"), "_mix_key")
    same = taken.where("_rows > 1 and _times > 0")
    repeated = keyed.dropDuplicates(["_mix_key"]).join(same.select("_mix_key", "_times"), "_mix_key")
    both = [single] if same.isEmpty() else [single, repeated]
    rows = reduce(DataFrame.unionByName, both)
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_times").cast("long")))).select(*docs.columns)
