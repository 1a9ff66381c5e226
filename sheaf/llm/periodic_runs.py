"""Periodic runs of words by an online sparse diagonal DP.

A run of period q is a stretch of words in which words q apart are identical: matches
of one lag, a diagonal, in unbroken sequence.  Words are read from left to right; the
earlier occurrence of what is read adds one to the match length of its lag, a diagonal
that is not added to ends, and if it is long enough it is a run and leaves at once.

What keeps the diagonals few: a run has ``POWERS`` periods at least, so its lag matches
at ``FEWEST - 1`` words in a row and more, and windows of words stand in for words.
Lags are taken in bands, up to 5, 6 to 10, 11 to 20 and so on, and windows are as long
as the largest lag of their band.  A run with smallest period q is a power of a word
sequence that is no power itself, and such a sequence occurs in its powers at multiples
of q only.  So in a window that long the latest earlier occurrence lies at q exactly,
and of all earlier occurrences this one alone can be on the run's diagonal; if a
shorter lag is met, q is not the smallest period.  Each word thus adds to one diagonal
a band at most, whatever the text: n log n steps for n words, also for one word
repeated a million times.  A band reads only windows that occur twice, and those of the
next band are sought among their starts.

Defined cases: a null or empty text has no words and no runs; rows with equal or null
ids are rows of their own; an empty table gives no rows; extra columns are not carried
unless named in ``keep``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

FEWEST = 6  # words of a run
POWERS = 4  # periods of a run
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def repeated(keys: np.ndarray) -> np.ndarray:
    """Whether each value occurs more than once."""
    _, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
    return counts[inverse] > 1


def diagonals(at: list[int], keys: list[int], width: int) -> Iterator[tuple[int, int, int]]:
    """(lag, first word, words matched) of the diagonals, as they end.

    ``at`` has the places of windows, rising, ``keys`` their contents.
    """
    latest: dict[int, int] = {}
    lag = begin = end = 0  # the active diagonal; lag 0: none
    for i, key in zip(at, keys):
        before = latest.get(key)
        latest[key] = i
        new = 0 if before is None else i - before
        if lag and new == lag and i == end + 1:
            end = i
            continue
        if lag:
            yield lag, begin, end - begin + width
        lag, begin, end = new, i, i
    if lag:
        yield lag, begin, end - begin + width


def runs_of(words: np.ndarray, fewest: int = FEWEST, powers: int = POWERS) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a sequence of numbers, by start and period."""
    n, out = len(words), []
    width, shortest = fewest - 1, 1  # band: lags from ``shortest`` to ``width``
    if n < fewest:
        return out
    keys, places = C.windows(words, np.zeros(n, np.int8), width)
    again = repeated(keys)
    keys, places = keys[again], places[again]
    while len(places):
        for lag, first, matched in diagonals(places.tolist(), keys.tolist(), width):
            # The match at ``first`` is with the word one lag before it.
            if shortest <= lag <= width and matched + lag >= max(fewest, powers * lag):
                out.append((first - lag, matched + lag, lag))
        # A window twice as long is a pair of windows, and repeats only if both do.
        shortest = width + 1
        if powers * shortest > n:
            break
        second = np.searchsorted(places, places + width)
        pair = second < len(places)
        pair[pair] = places[second[pair]] == places[pair] + width
        keys, places = C.mix(keys[pair] * C.BASE + keys[second[pair]]), places[pair]
        width *= 2
        again = repeated(keys)
        keys, places = keys[again], places[again]
    return sorted(out, key=lambda run: (run[0], run[2]))


def collapse(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Whether each of ``n`` words stays: a run keeps its first period."""
    steps = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        steps[start + period] += 1
        steps[start + length] -= 1
    return np.cumsum(steps[:-1]) == 0


def periodic_runs(
    docs: DataFrame,
    text: str = "text",
    keep: tuple[str, ...] = ("doc_id",),
    order: tuple[str, Callable[[object, int], np.ndarray | None]] | None = None,
    fewest: int = FEWEST,
    powers: int = POWERS,
) -> DataFrame:
    """``keep``, ``n_words``, ``runs`` (start, length and period in words, by start and
    period) and ``collapsed``: the words outside of repetitions, joined by one space.

    ``order`` names a column of ``docs`` and a function of its value and the number of
    words that says which word stands at each place (None: as they are).
    """
    if powers < 3 or not 2 <= fewest < 2 * powers:
        raise ValueError("the matches of a run must fill a window of its band")
    head = [f"k_{i}" for i in range(len(keep))]
    by = [F.col(order[0]).alias("_by")] if order else []
    rows = docs.select(*[F.col(c).alias(h) for c, h in zip(keep, head)], *by, F.col(text).alias("_text"))
    types = ", ".join(f"{h} {docs.schema[c].dataType.simpleString()}" for c, h in zip(keep, head))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("_by").to_pylist() if order else None
            for lo, hi, data, bounds in C.text_chunks(batch.column("_text")):
                starts, ends = C.word_spans(data, bounds)
                hashes = C.words(data, bounds, lower=False)[0]
                cuts = np.searchsorted(starts, bounds)
                counts, found, texts = [], [], []
                for i in range(hi - lo):
                    own = slice(cuts[i], cuts[i + 1])
                    words, n = hashes[own], int(cuts[i + 1] - cuts[i])
                    place = order[1](ids[lo + i], n) if order else None
                    if place is not None:
                        words = words[place]
                    runs = runs_of(words, fewest, powers)
                    stays = np.flatnonzero(collapse(n, runs))
                    stays = stays if place is None else place[stays]
                    begin, end = starts[own][stays].tolist(), ends[own][stays].tolist()
                    raw = data[bounds[i] : bounds[i + 1]].tobytes()
                    texts.append(b" ".join([raw[a - bounds[i] : b - bounds[i]] for a, b in zip(begin, end)]))
                    counts.append(n)
                    found.append([{"start": s, "length": m, "period": p} for s, m, p in runs])
                arrays = [batch.column(h).slice(lo, hi - lo) for h in head]
                arrays += [pa.array(counts, pa.int64()), pa.array(found, pa.list_(RUN)), pa.array(texts, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, names=[*head, "n_words", "runs", "collapsed"])

    out = rows.mapInArrow(run, f"{types}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
    return out.select(*[F.col(h).alias(c) for c, h in zip(keep, head)], "n_words", "runs", "collapsed")


def planted(checksum: int | None, n: int) -> np.ndarray | None:
    """Order of the words in which every tenth text repeats a part of itself to its end."""
    if checksum is None or checksum % 10 or not n:
        return None
    g = checksum // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    out = np.arange(n)
    out[a:] = a + np.arange(n - a) % p
    return out


def digests(runs: DataFrame) -> DataFrame:
    """Number and longest of the runs, and checksums of them all and of what stays."""
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))))
    # The longest; ties by the smallest start, then period.
    first = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("length"), r["start"].alias("start"), r["period"].alias("period"))))
    top = runs.withColumn("_top", first)
    length, period = -F.col("_top.length"), F.col("_top.period")
    kept = [c for c in runs.columns if c not in ("n_words", "runs", "collapsed")]
    return top.select(
        *kept,
        F.size("runs").cast("long").alias("n_runs"),
        F.col("_top.start").alias("start"),
        length.alias("length"),
        period.alias("period"),
        ((1000 * length - 1000 * length % period) / period).cast("long").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
