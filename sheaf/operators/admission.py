"""Rolling-window admission: at most N admitted events per key in any window.

Only admitted events count, so the fold is sequential per key.  To keep a hot key out
of one task, time is cut into blocks of many windows and all blocks are folded at once
from an empty state.  Where events pause for a window the state is empty indeed, and a
block whose first event sees nothing of what the block before admitted is right as it
is.  The others are folded again by units of ``FAN``, ``FAN`` squared, ... blocks: each
unit runs on from its first block whose entry state is not what the block before left,
and carries the state through its blocks in one stream.  When a unit spans the key, all
of it is right; that takes one round per power of ``FAN`` in the number of blocks, and
rounds end early once every block fits the one before.  A fold holds N stamps.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordering import kept

BLOCK_KEYS = ["key", "block"]
NOTHING = "cast(array() as array<bigint>)"


def admit_stamps(stamps: deque, now: int, limit: int, width: int) -> bool:
    """The rule for one event: drop stamps of age ``width`` or more, admit below ``limit``."""
    while stamps and now - stamps[0] >= width:
        stamps.popleft()
    if len(stamps) >= limit:
        return False
    stamps.append(now)
    return True


FAN = 16
STATES = "key {key}, block long, entry array<long>, leaves array<long>"


def _states(limit: int, width: int, length: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """What each block begins with, as far as its first event sees it, and what it leaves."""

    def alive(stamps: deque, block: int) -> list[int]:
        return [t for t in stamps if t > (block + 1) * length - width]

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, stamps, entry = None, deque(), []
        for pdf in batches:
            out = []
            for key, unit, block, now, start in zip(pdf["key"], pdf["unit"], pdf["block"], pdf["t"], pdf["start"]):
                if current is None or (key, unit, block) != current:
                    if current is not None:
                        out.append((current[0], current[2], entry, alive(stamps, current[2])))
                    if current is None or (key, unit) != current[:2]:
                        stamps = deque(sorted(start) if start is not None else ())
                    current, entry = (key, unit, block), [t for t in stamps if now - t < width]
                admit_stamps(stamps, now, limit, width)
            yield pd.DataFrame(out, columns=["key", "block", "entry", "leaves"])
        if current is not None:
            yield pd.DataFrame([(current[0], current[2], entry, alive(stamps, current[2]))], columns=["key", "block", "entry", "leaves"])

    return fold


def _fold_units(events: DataFrame, limit: int, width: int, length: int) -> DataFrame:
    """``events`` with ``unit`` and ``start``, the state its first block begins with."""
    return (
        events.select("key", "unit", "block", "t", "event_id", "start")
        .repartition("key", "unit")
        .sortWithinPartitions("key", "unit", "block", "t", "event_id")
        .mapInPandas(_states(limit, width, length), STATES.format(key=events.schema["key"].dataType.simpleString()))
    )


def _misfits(states: DataFrame, firsts: DataFrame, width: int) -> DataFrame:
    """Blocks that begin with another state than the block before has left for them."""
    left = states.select("key", (F.col("block") + 1).alias("block"), F.col("leaves").alias("given"))
    seen = states.join(firsts, BLOCK_KEYS).join(left, BLOCK_KEYS, "left")
    given = F.coalesce(F.filter("given", lambda t: F.col("first_t") - t < width), F.expr(NOTHING))
    return seen.withColumn("given", given).where(F.col("given") != F.col("entry")).select("key", "block", "since", "given")


def entry_states(slim: DataFrame, limit: int, width: int, length: int) -> tuple[DataFrame, int]:
    """(key, block, entry) of all blocks that begin with stamps, and the rounds it took.

    ``slim`` has key, event_id, t and block.
    """
    firsts = slim.groupBy(*BLOCK_KEYS).agg(F.min("t").alias("first_t"))
    since = firsts.groupBy("key").agg(F.min("block").alias("since"))
    firsts = kept(firsts.join(since, "key"))
    alone = slim.select("*", F.col("block").alias("unit"), F.expr(NOTHING).alias("start"))
    states = kept(_fold_units(alone, limit, width, length))
    rounds, size = 0, 1
    while True:
        bad = kept(_misfits(states, firsts, width))
        if bad.isEmpty():
            return states.where(F.size("entry") > 0).select("key", "block", "entry"), rounds
        rounds, size = rounds + 1, size * FAN
        unit = F.floor((F.col("block") - F.col("since")) / size).cast("long")
        # Each unit runs on from its first misfit.
        runs = bad.groupBy("key", "since", unit.alias("unit")).agg(F.min("block").alias("first"), F.min_by("given", "block").alias("start"))
        blocks = firsts.select(*BLOCK_KEYS, unit.alias("unit")).join(runs.drop("since"), ["key", "unit"])
        again = slim.join(blocks.where(F.col("block") >= F.col("first")), BLOCK_KEYS)
        fresh = kept(_fold_units(again, limit, width, length))
        states = kept(states.join(fresh.select(*BLOCK_KEYS), BLOCK_KEYS, "left_anti").unionByName(fresh))


def _folder(limit: int, width: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, stamps = None, deque()
        for pdf in batches:
            flags = []
            for key, block, now, entry in zip(pdf["key"], pdf["block"], pdf["t"], pdf["entry"]):
                if (key, block) != current:
                    current, stamps = (key, block), deque(sorted(entry) if entry is not None else ())
                flags.append(admit_stamps(stamps, now, limit, width))
            yield pdf[["key", "block", "event_id", "t"]].assign(admitted=flags)

    return fold


def _fold_blocks(events: DataFrame, entries: DataFrame, limit: int, width: int) -> DataFrame:
    events = events.join(entries, BLOCK_KEYS, "left")
    key_type = events.schema["key"].dataType.simpleString()
    return (
        events.select("key", "block", "t", "event_id", "entry")
        .repartition(*BLOCK_KEYS)
        .sortWithinPartitions("key", "block", "t", "event_id")
        .mapInPandas(_folder(limit, width), f"key {key_type}, block long, event_id long, t long, admitted boolean")
    )


def rolling_admission(
    events: DataFrame, limit: int = 20, window_seconds: float = 60.0, block_windows: int = 64
) -> DataFrame:
    """``events``: key, event_id, ts → key, event_id, admitted; order is (ts, event_id)."""
    width = int(window_seconds * 1_000_000)
    length = width * block_windows
    slim = events.select("key", F.col("event_id").cast("long"), F.unix_micros(F.col("ts")).alias("t"))
    slim = slim.withColumn("block", F.floor(F.col("t") / length).cast("long"))
    entries, _ = entry_states(slim, limit, width, length)
    return _fold_blocks(slim, entries, limit, width).select("key", "event_id", "admitted")
