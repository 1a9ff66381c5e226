"""Vector best-fit packing of tokenised documents into sequences.

A document's tokens and an end id are cut, if they exceed a sequence, into full pieces
with the shorter one first.  A piece asks a bin for tokens, one document place and
attention cost (its length squared), and fits if no residual capacity is exceeded; of
the bins that fit, that with the largest weighted dot product of what the piece asks
and what the bin has used is taken, ties by the smallest weighted residual norm.  Pieces
come in falling length (ties alike), so all that matters of a piece is its length: bins
and pieces are handled in bulk, as counts of equal ones.  The packing of any corpus is
then a plan of a few thousand ranges at most (each length adds a bounded number), and
pieces find their place in it by their rank among pieces of their length.

Defined cases: a null or empty text is the end id alone; rows with equal or null ids
are packed as rows of their own; an empty table gives no rows; extra columns are not
carried unless named in ``keep``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

TOKENS = 1024
END_ID = 2
DOCUMENTS = 1024  # places for documents in a sequence: as many as it has tokens
ATTENTION = TOKENS * TOKENS  # pairs of positions; one document of full length asks this much
WEIGHTS = (1.0, 0.05, 0.25)
BLOCK = 20_000


class Encoder:
    """Ids of the byte-level BPE file ``path``, the same as the tokenizers library gives.

    The BPE is tiktoken's, on the same vocabulary and pattern, which takes a sixth of
    the library's time; a text with a special token's string is left to the library.
    """

    def __init__(self, path: str):
        import base64

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        ranks = {}
        with open(path.replace(".json", ".tiktoken"), "rb") as f:
            for word, rank in map(bytes.split, f):
                ranks[base64.b64decode(word)] = int(rank)
        self.bpe = tiktoken.Encoding("bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.whole = Tokenizer.from_file(path)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]

    def encode(self, text: str) -> np.ndarray:
        if any(s in text for s in self.special):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(self.bpe.encode_ordinary(text), np.uint32)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder; it outlives the task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def pieces(docs: DataFrame, tokenizer: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), tokens: int = TOKENS, with_ids: bool = False) -> DataFrame:
    """A row per piece: ``keep``, ``piece``, ``start``, ``length``, ``ids_crc32`` and,
    if asked for, ``ids``."""
    head = [f"k_{i}" for i in range(len(keep))]
    narrow = docs.select(*[F.col(c).alias(h) for c, h in zip(keep, head)], F.col(text).alias("_text"))
    types = ", ".join(f"{h} {docs.schema[c].dataType.simpleString()}" for c, h in zip(keep, head))
    names = [*head, "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    end = np.array([END_ID], np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)
        for batch in batches:
            for lo, hi, data, bounds in C.text_chunks(batch.column("_text"), 1 << 22):
                rows, columns = [], [[], [], [], [], []]
                for i in range(hi - lo):
                    ids = np.concatenate([own.encode(data[bounds[i] : bounds[i + 1]].tobytes().decode("utf-8", "replace")), end])
                    first = (len(ids) - 1) % tokens + 1
                    for n, at in enumerate([0, *range(first, len(ids), tokens)]):
                        part = ids[at : first if not n else at + tokens]
                        rows.append(lo + i)
                        for column, value in zip(columns, (n, at, len(part), zlib.crc32(part.astype("<u4").tobytes()), part.astype(np.int32) if with_ids else None)):
                            column.append(value)
                taken = pa.array(rows, pa.int64())
                arrays = [batch.column(h).take(taken) for h in head]
                arrays += [pa.array(columns[0], pa.int32()), *[pa.array(c, pa.int64()) for c in columns[1:4]]]
                if with_ids:
                    arrays.append(pa.array(columns[4], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    cut = narrow.mapInArrow(run, f"{types}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)
    return cut.select(*[F.col(h).alias(c) for c, h in zip(keep, head)], *names[len(head) :])


def packing_plan(counts: dict[int, int], tokens: int = TOKENS, documents: int = DOCUMENTS, attention: int = ATTENTION, weights: tuple[float, float, float] = WEIGHTS) -> list[tuple[int, ...]]:
    """Ranges (length, from rank, to rank, pieces a bin, first bin, offset).

    ``counts`` has the number of pieces of each length.  Equal bins are one entry:
    what they have left, and how many there are.
    """
    capacity = np.array([tokens, documents, attention], np.float64)
    scale = np.array(weights) / capacity**2
    plan: list[tuple[int, ...]] = []
    left = np.zeros((0, 3), np.int64)  # residual capacities of the groups of bins
    size = np.zeros(0, np.int64)
    start = np.zeros(0, np.int64)  # first bin of each group
    opened = 0
    for length in sorted(counts, reverse=True):
        asks = np.array([length, 1, length * length], np.int64)
        waiting, done = counts[length], 0
        new: list[tuple[np.ndarray, int, int]] = []
        while waiting:
            fit = np.flatnonzero((left >= asks).all(axis=1) & (size > 0))
            if len(fit):
                rest = left[fit]
                score = ((capacity - rest) * scale) @ asks
                norm = ((rest - asks) ** 2 * scale).sum(axis=1)
                g = fit[np.lexsort((norm, -score))[0]]
                each = 1
                bins = min(waiting, int(size[g]))
                first = int(start[g])
                used = tokens - int(left[g, 0])
                new.append((left[g] - asks * each, bins, first))
                start[g] += bins
                size[g] -= bins
            else:
                each = int(min(capacity // asks))
                if not each:
                    raise ValueError(f"a piece of {length} tokens fits no bin")
                each = min(each, waiting)
                bins = waiting // each
                first, used = opened, 0
                opened += bins
                new.append((capacity.astype(np.int64) - asks * each, bins, first))
            plan.append((length, done, done + bins * each, each, first, used))
            done += bins * each
            waiting -= bins * each
            # New groups are seen at once: the same length may go there again.
            left = np.concatenate([left, [new[-1][0]]])
            size = np.append(size, new[-1][1])
            start = np.append(start, new[-1][2])
        live = (size > 0) & (left[:, 0] > 0)
        left, size, start = left[live], size[live], start[live]
    return plan


def pack(cut: DataFrame, identity: list[str], tokens: int = TOKENS, documents: int = DOCUMENTS, attention: int = ATTENTION) -> DataFrame:
    """``cut`` (rows with ``length``) with ``sequence_id`` and ``offset``."""
    cut = C.stash(cut, "pieces")
    full = cut.where(F.col("length") == tokens)
    part = cut.where(F.col("length") < tokens)
    counts = {r["length"]: r["n"] for r in part.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a length
    plan = packing_plan(counts, tokens, documents, attention)
    spark = cut.sparkSession
    ranges = spark.createDataFrame(plan, "length long, lo long, hi long, each long, first long, used long")
    ranked = C.ranked(part.withColumn("_u", C.uniform("pack", *identity)), ["length"], "_u", identity, "_rank", BLOCK).drop("_u")
    inside = (F.col("c.length") == F.col("p.length")) & (F.col("c._rank") >= F.col("p.lo")) & (F.col("c._rank") < F.col("p.hi"))
    at = F.col("c._rank") - F.col("p.lo")
    placed = ranked.alias("c").join(F.broadcast(ranges.alias("p")), inside).select(
        *[F.col(f"c.{c}") for c in cut.columns],
        (F.col("p.first") + F.floor(at / F.col("p.each"))).cast("long").alias("sequence_id"),
        (F.col("p.used") + at % F.col("p.each") * F.col("p.length")).cast("long").alias("offset"),
    )
    # A full piece is a sequence of its own; its number is drawn from the negative ones.
    numbered = full.withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    return placed.unionByName(numbered)
