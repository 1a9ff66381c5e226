"""Token counts of whole texts, huge ones by overlap resynchronisation.

A text of more than ``CHUNK`` characters is cut into chunks that overlap, so that no
task encodes more than a chunk at once and the chunks of one text may be encoded in
different tasks.  Each chunk is encoded with offsets.  In the overlap of two chunks a
splice is a place where both encodings start a token and which is proven stable: the
pre-tokenizer starts a new match there whatever stands before, and normalisation joins
nothing across it (see ``stable``).  Tokens before the splice are counted in the left
chunk, those from it on in the right one.  Texts without a splice in one of their
overlaps go into another round, with chunks and overlaps ``WIDEN`` times as long, until
a chunk holds the whole text.

Shorter texts need no splices.  White space ends every match of the pre-tokenizer, so
their words are counted one by one, and each different word of a batch is encoded once.

Defined cases: a null text is empty and has no tokens; rows with equal or null ids are
rows of their own; an empty table gives no rows; extra columns are not carried unless
named in ``keep``.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

LIMIT = 2048
CHUNK = 1 << 16  # characters
OVERLAP = 1 << 11
WIDEN = 8
KNOWN = 1 << 20  # words whose counts a worker remembers
BATCH = 512

SPACE = " \t\n\x0b\x0c\r"


@lru_cache(maxsize=2)
def tokenizer(path: str):
    """The library's tokenizer of ``path``, once a worker, without truncation or padding."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(path)
    out.no_truncation()
    out.no_padding()
    return out


def stable(text: str, at: int) -> bool:
    """Whether the pre-tokenizer starts a match at ``at`` whatever surrounds both sides.

    After ASCII white space it always does, for no match holds any.  A sign that follows
    a letter or digit is in no match with it: words and numbers hold no signs, runs of
    signs no letters, and contractions end in letters.  Signs never compose with what is
    before them, and neither does what follows white space.
    """
    before = text[at - 1]
    if before in SPACE:
        return not unicodedata.combining(text[at])
    letter = before.isascii() and before.isalnum() or unicodedata.category(before) == "Lo"
    return letter and unicodedata.category(text[at])[0] in "PS"


def boundaries(text: str, spans: list[tuple[int, int]], lo: int, hi: int) -> list[tuple[int, int]]:
    """(place, tokens before it) of the stable starts of tokens in [lo, hi)."""
    out = []
    for n in range(1, len(spans)):
        at = spans[n][0]
        if lo <= at < hi and at and spans[n - 1][1] <= at and stable(text, at):
            out.append((at, n))
    return out


class WordCounts:
    """Tokens of words, each different word encoded once and then remembered."""

    def __init__(self, path: str):
        self.encode = tokenizer(path).encode_batch_fast
        self.hashes, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def of(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        different, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.hashes, different), max(0, len(self.hashes) - 1))
        known = self.hashes[at] == different if len(self.hashes) else np.zeros(len(different), bool)
        counts = np.zeros(len(different), np.int64)
        counts[known] = self.counts[at[known]]
        new = np.flatnonzero(~known)
        for k in range(0, len(new), BATCH):
            part = new[k : k + BATCH]
            texts = [data[starts[i] : ends[i]].tobytes().decode("utf-8", "replace") for i in first[part]]
            counts[part] = [len(e) for e in self.encode(texts, add_special_tokens=False)]
        if len(new):
            if len(self.hashes) + len(new) > KNOWN:
                self.hashes, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
            both = np.concatenate([self.hashes, different[new]])
            order = np.argsort(both)
            self.hashes, self.counts = both[order], np.concatenate([self.counts, counts[new]])[order]
        return counts[inverse]


@lru_cache(maxsize=2)
def word_counts(path: str) -> WordCounts:
    return WordCounts(path)


def first_pass(path: str, head: list[str], chunk: int):
    """Counts of texts up to ``chunk`` characters; longer ones are passed on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = word_counts(path)
        for batch in batches:
            column = batch.column("_text")
            data, bounds = C.text_buffer(column)
            leads = (data & 0xC0) != 0x80
            huge = C.sums_by_row(leads, bounds) > chunk
            counts = np.zeros(batch.num_rows, np.int64)
            for lo, hi in C.row_chunks(bounds):
                if hi == lo + 1 and huge[lo]:
                    continue
                part, ends_at = data[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo]
                starts, ends = C.word_spans(part, ends_at)
                rows = C.row_of(ends_at, starts)
                small = ~huge[lo + rows]
                starts, ends, rows = starts[small], ends[small], rows[small]
                each = known.of(part, starts, ends, C.slice_hash(C.prefix_sums(part), starts, ends))
                counts[lo:hi] += np.bincount(rows, each, hi - lo).astype(np.int64)
            left = pa.array([column[i].as_py() if huge[i] else None for i in range(batch.num_rows)], pa.string())
            arrays = [batch.column("_row"), *[batch.column(h) for h in head], pa.array(np.diff(bounds)), pa.array(counts, mask=huge), left]
            yield pa.RecordBatch.from_arrays(arrays, names=["_row", *head, "n_bytes", "n_tokens", "_text"])

    return run


def cut_chunks(chunk: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["_row", "begin", "last", "chunk"]
        for batch in batches:
            for row, text in zip(batch.column("_row").to_pylist(), batch.column("_text").to_pylist()):
                begin = 0
                while True:
                    last = begin + chunk >= len(text)
                    yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (row, begin, last, text[begin : begin + chunk])], names=names)
                    if last:
                        break
                    begin += chunk - overlap

    return run


def encode_chunks(path: str, overlap: int):
    """Tokens of each chunk, and its boundaries in what it shares with the chunk before
    and with the one after."""
    place = pa.list_(pa.struct([("at", pa.int64()), ("n", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(path)
        for batch in batches:
            for i in range(batch.num_rows):
                row, begin, last, text = (batch.column(c)[i].as_py() for c in ("_row", "begin", "last", "chunk"))
                spans = own.encode(text, add_special_tokens=False).offsets
                sides = [(0, overlap if begin else 0), (len(text) - overlap, 0 if last else len(text))]
                head, tail = ([{"at": begin + at, "n": n} for at, n in boundaries(text, spans, lo, hi)] for lo, hi in sides)
                arrays = [pa.array([x]) for x in (row, begin, last, len(spans))] + [pa.array([x], place) for x in (head, tail)]
                yield pa.RecordBatch.from_arrays(arrays, names=["_row", "begin", "last", "n", "head", "tail"])

    return run


def spliced(encoded: DataFrame) -> DataFrame:
    """(_row, n_tokens): the tokens between the splices; null if an overlap has none."""
    chunks = Window.partitionBy("_row").orderBy("begin")
    places = lambda side: F.transform(side, lambda b: b["at"])
    at = F.array_max(F.array_intersect(places("tail"), F.lead(places("head")).over(chunks)))
    before = lambda side, place: F.get(F.filter(F.col(side), lambda b: b["at"] == place), F.lit(0))["n"]
    cut = encoded.withColumn("to", at).withColumn("from", F.lag("to").over(chunks))
    until = F.when(F.col("last"), F.col("n")).otherwise(before("tail", F.col("to")))
    since = F.when(F.col("begin") == 0, 0).otherwise(before("head", F.col("from")))
    tokens = until - since
    return cut.groupBy("_row").agg(F.when(F.count(tokens) == F.count(F.lit(1)), F.sum(tokens)).cast("long").alias("n_tokens"))


def token_counts(
    docs: DataFrame,
    path: str,
    text: str = "text",
    keep: tuple[str, ...] = ("doc_id",),
    limit: int = LIMIT,
    chunk: int = CHUNK,
    overlap: int = OVERLAP,
) -> DataFrame:
    """``keep``, ``n_bytes``, ``n_tokens`` and ``over_limit`` of every text."""
    if not 64 <= overlap <= chunk // 2:
        raise ValueError("an overlap must hold the special strings and stay under half a chunk")
    head = [f"k_{i}" for i in range(len(keep))]
    types = ", ".join(f"{h} {docs.schema[c].dataType.simpleString()}" for c, h in zip(keep, head))
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), *[F.col(c).alias(h) for c, h in zip(keep, head)], F.col(text).alias("_text"))
    seen = C.stash(rows.mapInArrow(first_pass(path, head, chunk), f"_row long, {types}, n_bytes long, n_tokens long, _text string"), "token-counts")
    huge = seen.where("n_tokens is null").select("_row", "_text")
    done = None
    while not huge.isEmpty():
        cut = huge.mapInArrow(cut_chunks(chunk, overlap), "_row long, begin long, last boolean, chunk string")
        places = "array<struct<at:long,n:long>>"
        encoded = cut.repartition("_row", "begin").mapInArrow(encode_chunks(path, overlap), f"_row long, begin long, last boolean, n long, head {places}, tail {places}")
        found = C.stash(spliced(encoded), "splices")
        good = found.where("n_tokens is not null")
        done = good if done is None else done.unionByName(good)
        huge = huge.join(found.where("n_tokens is null").select("_row"), "_row", "left_semi")
        chunk, overlap = chunk * WIDEN, overlap * WIDEN
    out = seen.drop("_text")
    if done is not None:
        out = out.join(done.withColumnRenamed("n_tokens", "_n"), "_row", "left").withColumn("n_tokens", F.coalesce("n_tokens", "_n"))
    return out.select(*[F.col(h).alias(c) for c, h in zip(keep, head)], "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
