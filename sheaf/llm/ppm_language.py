"""Language identification by prediction by partial matching.

For each language a tree of byte contexts up to ``ORDER`` bytes long is counted once and
frozen.  A context gives a byte seen after it c / (n + d), with n bytes and d different
ones seen there, and keeps d / (n + d) for an escape to the next shorter context, from
which the bytes already seen are excluded; under all of them lies one in 256.  The code
length of a text under each language is exact: every distribution sums to one.  The
shortest code wins, and the score is its share when all languages were as likely before.

All contexts' distributions are laid out as rows of one matrix, with every escape worked
out, so a byte costs two look-ups.

Learned from at most ``DOCS_PER_LANG`` labelled documents a language, drawn by a hash of
the id, whole texts; the counts that reach the driver are those of the distinct strings
of ``ORDER + 1`` bytes in them.

Defined cases: a null or empty text, or one without a letter, is ``und`` with score 0;
so is every text if nothing could be learned; languages with equal code lengths go by
name; rows with equal or null ids are rows of their own; a null id counts as the empty
string where ids decide; extra columns are not carried unless named in ``keep``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

ORDER = 3
DOCS_PER_LANG = 1500
UNKNOWN = "und"


def coded(data: np.ndarray, bounds: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Each byte with the ``order`` bytes before it in its row, as one number; before a
    row's start stand zero bytes.  And the row of each byte."""
    n = len(data)
    rows = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    place = np.arange(n) - bounds[rows]
    out = data.astype(np.int64)
    for k in range(1, order + 1):
        back = np.zeros(n, np.int64)
        back[k:] = data[:-k] if k else data
        back[place < k] = 0
        out |= back << (8 * k)
    return out, rows


def count_strings(docs: DataFrame, text: str, lang: str, order: int = ORDER) -> DataFrame:
    """(lang, string, n): how often each byte follows each context."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, bounds in C.text_chunks(batch.column("_text")):
                codes, rows = coded(data, bounds, order)
                names, which = np.unique(batch.column("_lang").slice(lo, hi - lo).to_numpy(zero_copy_only=False).astype(str), return_inverse=True)
                for k, name in enumerate(names):
                    found, times = np.unique(codes[which[rows] == k], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(found), pa.string()), pa.array(found), pa.array(times)], names=["lang", "string", "n"])

    chosen = docs.select(F.col(lang).alias("_lang"), F.col(text).alias("_text"))
    return chosen.mapInArrow(run, "lang string, string long, n long").groupBy("lang", "string").agg(F.sum("n").alias("n"))


class Model:
    """Rows of log2 probabilities, and the row of the longest known context of any three
    bytes.  ``rows[r, byte code, language]``."""

    def __init__(self, langs: list[str], strings: list[np.ndarray], counts: list[np.ndarray], order: int = ORDER):
        self.langs, self.order = langs, order
        seen = np.unique(np.concatenate([s & 255 for s in strings] + [np.zeros(1, np.int64)]))
        self.code = np.full(256, len(seen), np.int64)  # bytes never seen share one code
        self.code[seen] = np.arange(len(seen))
        size = len(seen) + 1
        spare = 256 - len(seen)  # bytes that the last code stands for
        base = np.full(size, 1 / 256)
        table = {(): np.tile(base, (len(langs), 1))}
        levels = [{(): 0}]
        matrix = [self._node(table[()], [self._counts(s, c, 0).get((), {}) for s, c in zip(strings, counts)], spare)]
        parents = levels[0]
        for k in range(1, order + 1):
            own = [self._counts(s, c, k) for s, c in zip(strings, counts)]
            level = {}
            for context in sorted(set().union(*own)):
                # A context's parent is what remains without its oldest byte.
                parent = matrix[parents[context[1:]]]
                level[context] = len(matrix)
                matrix.append(self._node(parent, [o.get(context, {}) for o in own], spare))
            levels.append(level)
            parents = level
        self.rows = np.log2(np.maximum(np.stack(matrix), 1e-300)).transpose(0, 2, 1).astype(np.float32).copy()
        self.size = size
        # The longest known context of each combination of codes.
        at = np.zeros((size,) * order, np.int32)
        for k, level in enumerate(levels):
            for context, row in level.items():
                at[(..., *[self.code[b] for b in context])] = row
        self.at = at.ravel()

    @staticmethod
    def _counts(strings: np.ndarray, counts: np.ndarray, k: int) -> dict[tuple[int, ...], dict[int, int]]:
        """Counts of bytes after contexts of ``k`` bytes, oldest byte first."""
        keys, which = np.unique(strings & ((1 << (8 * (k + 1))) - 1), return_inverse=True)
        totals = np.bincount(which, weights=counts).astype(np.int64)
        out: dict[tuple[int, ...], dict[int, int]] = {}
        for key, n in zip(keys.tolist(), totals.tolist()):
            context = tuple((key >> (8 * j)) & 255 for j in range(k, 0, -1))
            out.setdefault(context, {})[key & 255] = n
        return out

    def _node(self, parent: np.ndarray, counts: list[dict[int, int]], spare: int) -> np.ndarray:
        out = parent.copy()
        for lang, seen in enumerate(counts):
            if seen:
                where = self.code[list(seen)]
                n = np.array(list(seen.values()), np.float64)
                total = n.sum() + len(n)
                left = 1 - parent[lang, where].sum()  # of the shorter context, without what is seen here
                escape = len(n) / total
                if left > 1e-12:
                    out[lang] = parent[lang] * (escape / left)
                    out[lang, where] = n / total
                else:  # nothing is left to escape to
                    out[lang, where] = n / n.sum()
        return out

    def bits(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Code length of each row under each language."""
        n = len(data)
        if not n:
            return np.zeros((len(bounds) - 1, len(self.langs)))
        codes = self.code[data]
        rows = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        place = np.arange(n) - bounds[rows]
        context = np.zeros(n, np.int64)
        for k in range(self.order, 0, -1):
            back = np.full(n, self.code[0], np.int64)
            back[k:] = codes[:-k]
            back[place < k] = self.code[0]
            context = context * self.size + back
        values = self.rows[self.at[context], codes].astype(np.float64)
        total = np.zeros((n + 1, len(self.langs)))
        np.cumsum(values, axis=0, out=total[1:])
        return -(total[bounds[1:]] - total[bounds[:-1]])


def train(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", docs_per_lang: int = DOCS_PER_LANG, order: int = ORDER) -> Model | None:
    drawn = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).alias("_lang"), F.col(text).alias("_text"), C.uniform("ppm", doc_id).alias("_u"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("_id")
    )
    # Which documents: found without their texts, and few enough to look up by key.
    edge = C.lowest(drawn.select("_lang", "_u", "_id"), "_lang", "_u", ["_id"], docs_per_lang, "_n")
    edge = C.stash(edge.groupBy("_lang").agg(F.max("_u").alias("_edge")), "edges")
    sample = drawn.join(edge, "_lang").where("_u <= _edge")
    found = C.stash(count_strings(sample, "_text", "_lang", order), "strings").toArrow()
    if not found.num_rows:
        return None
    names = np.array(found.column("lang").to_pylist())
    strings, counts = found.column("string").to_numpy(), found.column("n").to_numpy()
    langs = sorted(set(names.tolist()))
    return Model(langs, [strings[names == x] for x in langs], [counts[names == x] for x in langs], order)


def identify(docs: DataFrame, model: Model | None, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, ``lang_pred``, ``score``."""
    head = [f"k_{i}" for i in range(len(keep))]
    letters: Column = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    narrow = docs.select(*[F.col(c).alias(h) for c, h in zip(keep, head)], F.col(text).alias("_text"), letters.alias("_letters"))
    types = "".join(f"{h} {docs.schema[c].dataType.simpleString()}, " for c, h in zip(keep, head))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample and ORDER

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for lo, hi, data, bounds in C.text_chunks(batch.column("_text"), 1 << 19):
                arrays = [batch.column(h).slice(lo, hi - lo) for h in head]
                known = batch.column("_letters").slice(lo, hi - lo).to_numpy(zero_copy_only=False)
                lang, score = np.full(hi - lo, UNKNOWN, object), np.zeros(hi - lo)
                if own is not None:
                    bits = lengths(own, data, bounds)
                    best = bits.argmin(axis=1)
                    share = np.exp2(bits.min(axis=1, keepdims=True) - bits)
                    lang[known] = np.array(own.langs, object)[best[known]]
                    score[known] = (1 / share.sum(axis=1))[known]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(lang, pa.string()), pa.array(score)], names=[*head, "lang_pred", "score"])

    out = narrow.mapInArrow(run, f"{types}lang_pred string, score double")
    return out.select(*[F.col(h).alias(c) for c, h in zip(keep, head)], "lang_pred", "score")


def lengths(model: Model, data: np.ndarray, bounds: np.ndarray, most: int = 1 << 20) -> np.ndarray:
    """Code lengths; a longer row is read in pieces that repeat the context."""
    if len(data) <= most:
        return model.bits(data, bounds)
    total = np.zeros((1, len(model.langs)))
    for at in range(0, len(data), most):
        begin = max(0, at - model.order)
        part = data[begin : at + most]
        whole = model.bits(part, np.array([0, len(part)]))
        total += whole - model.bits(data[begin:at], np.array([0, at - begin]))
    return total
