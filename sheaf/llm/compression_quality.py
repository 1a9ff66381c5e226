"""Quality classifier by compression.

From texts labelled good and from texts labelled bad a zstandard dictionary each is
built.  A text is compressed block by block with either (in blocks, for within a long
text what stands before would soon weigh more than the dictionary), and the difference
of the two sizes over their sum is its evidence: positive if the good dictionary saves
more.  A logistic curve over it and over how far the text compresses at all (both
dictionaries save alike on mere repetition), fitted to other labelled texts than those
in the dictionaries, turns it into a probability.

Dictionaries hold at most ``DOCS`` texts of each label, the curve is fitted to as many
others, drawn by a hash of the id; both are documented bounds of the training sample.

Defined cases: a null or empty text has evidence 0, 0 and gets the curve's value there;
with labels of one kind only, or none, the score is the share of good ones, or 0.5;
a label other than 0 or 1, or null, teaches nothing; a text with several labels counts
with each; rows with equal or null ids are rows of their own (null ids have no label);
extra columns are not carried unless named in ``keep``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

DOCS = 600
DICTIONARY = 112_640
BLOCK = 1024
LEVEL = 3


@dataclass
class Model:
    good: bytes
    bad: bytes
    slopes: np.ndarray
    offset: float

    def score(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(evidence @ self.slopes + self.offset, -500, 500)))


def blocks(text: bytes) -> list[bytes]:
    return [text[k : k + BLOCK] for k in range(0, len(text), BLOCK)]


def dictionary(texts: list[bytes]) -> bytes:
    """Trained on blocks; too few of them are the dictionary as they are."""
    parts = [b for t in texts for b in blocks(t)]
    size = min(DICTIONARY, max(256, sum(map(len, parts)) // 10))
    try:
        return zstandard.train_dictionary(size, parts, k=256, d=8).as_bytes() if len(parts) > 7 else b"".join(parts)[-DICTIONARY:]
    except zstandard.ZstdError:
        return b"".join(parts)[-DICTIONARY:]


def evidence(good: bytes, bad: bytes):
    """A function from text to (bad - good) / (bad + good), sizes compressed, and the
    logarithm of their mean over the text's size."""
    pressed = [zstandard.ZstdCompressor(level=LEVEL, dict_data=_prepared(d), write_content_size=False, write_checksum=False, write_dict_id=False) for d in (good, bad)]

    def of(text: bytes) -> tuple[float, float]:
        if not text:
            return 0.0, 0.0
        sizes = [0, 0]
        for part in blocks(text):
            for k in (0, 1):
                sizes[k] += len(pressed[k].compress(part))
        return (sizes[1] - sizes[0]) / (sizes[1] + sizes[0]), math.log((sizes[1] + sizes[0]) / (2 * len(text)))

    return of


def _prepared(raw: bytes):
    made = zstandard.ZstdCompressionDict(raw)
    made.precompute_compress(level=LEVEL)
    return made


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> tuple[np.ndarray, float]:
    """Slopes and offset by Newton's method; columns are scaled to their spread."""
    spread = np.where(x.std(axis=0) > 0, x.std(axis=0), 1.0)
    design = np.column_stack([x / spread, np.ones(len(x))])
    beta = np.zeros(design.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        slope = design.T @ (weight * (y - p)) - ridge * beta
        curve = (design * (weight * p * (1 - p))[:, None]).T @ design + ridge * np.eye(len(beta))
        step = np.linalg.solve(curve, slope)
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    return beta[:-1] / spread, float(beta[-1])


def train(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality", docs_per_label: int = DOCS) -> Model:
    """``docs`` are the rows to learn from; ``labels`` has ``doc_id`` and ``label``."""
    known = labels.where(F.col(label).isin(0, 1)).select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("_y"))
    drawn = known.withColumn("_u", C.uniform("quality", "_id")).join(docs.select(F.col(doc_id).alias("_id")), "_id", "left_semi")
    chosen = C.lowest(drawn, "_y", "_u", ["_id"], 2 * docs_per_label, "_n")
    shares = drawn.groupBy("_y").agg(F.count(F.lit(1)).alias("n"))
    total = {r["_y"]: r["n"] for r in shares.collect()}
    if len(total) < 2:
        share = 0.5 if not total else float(next(iter(total)))
        return Model(b"", b"", np.zeros(2), float(np.log(max(share, 1e-6) / max(1 - share, 1e-6))))
    chosen = C.stash(chosen.select("_id", "_y", "_n"), "chosen")  # at most 4 * docs_per_label rows
    texts = docs.select(F.col(doc_id).alias("_doc"), F.coalesce(text, F.lit("")).alias("_text"))
    rows = texts.join(F.broadcast(chosen), F.col("_doc") == F.col("_id")).select("_y", "_n", "_text").collect()
    half = {y: min(docs_per_label, (total[y] + 1) // 2) for y in total}
    made = {y: dictionary([r["_text"].encode() for r in sorted(rows, key=lambda r: r["_n"]) if r["_y"] == y and r["_n"] <= half[y]]) for y in total}
    of = evidence(made[1], made[0])
    held = [r for r in rows if r["_n"] > half[r["_y"]]]
    x, y = np.array([of(r["_text"].encode()) for r in held]).reshape(-1, 2), np.array([r["_y"] for r in held])
    if len(set(y.tolist())) < 2:
        return Model(made[1], made[0], np.array([1.0, 0.0]), 0.0)
    # Both labels were drawn in equal numbers; weights give them their shares again.
    weight = np.array([total[k] / max(1, int((y == k).sum())) for k in y])
    slopes, offset = logistic(x, y, weight / weight.mean())
    return Model(made[1], made[0], slopes, offset)


def classify(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, ``score`` and ``predicted``."""
    head = [f"k_{i}" for i in range(len(keep))]
    narrow = docs.select(*[F.col(c).alias(h) for c, h in zip(keep, head)], F.col(text).alias("_text"))
    types = "".join(f"{h} {docs.schema[c].dataType.simpleString()}, " for c, h in zip(keep, head))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of at most DICTIONARY bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        of = evidence(own.good, own.bad) if own.good and own.bad else lambda text: (0.0, 0.0)
        for batch in batches:
            data, bounds = C.text_buffer(batch.column("_text"))
            found = np.array([of(data[bounds[i] : bounds[i + 1]].tobytes()) for i in range(batch.num_rows)], np.float64).reshape(-1, 2)
            score = own.score(found)
            yield pa.RecordBatch.from_arrays([*[batch.column(h) for h in head], pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=[*head, "score", "predicted"])

    out = narrow.mapInArrow(run, f"{types}score double, predicted int")
    return out.select(*[F.col(h).alias(c) for c, h in zip(keep, head)], "score", "predicted")
