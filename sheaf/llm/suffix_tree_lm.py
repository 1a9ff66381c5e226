"""Scores of texts under a probabilistic suffix tree over words.

Tokens are words (A-Z lower-cased) and one end per text.  A context (the last one or
two words) is a candidate if it makes up ``P_MIN`` of the training tokens at least, so
there are at most 1 / P_MIN of each length; it is kept if its next-token distribution
diverges from that of its own suffix by ``DIVERGENCE`` bits, or a kept one needs it as
suffix.  A token is predicted by the longest kept suffix of what stands before it:

    P(t | s) = max(c(s t) - 1, 0) / n(s) + d(s) / n(s) * P(t | suffix of s)

with n(s) tokens and d(s) different ones seen after s, and below all contexts the base
(c(t) + 1) / (N + V + 1).  Each of these sums to one over the V tokens and one unknown.

Counts of all tokens, and of all tokens after candidate contexts, are kept in buckets by
token as sorted arrays; a batch of texts sends each bucket its distinct tokens only, so
a frequent word is one entry a batch.  For scores, texts are dealt into chunks; a chunk
asks each bucket for its distinct (token, context) pairs and is answered in the same
order.  Nothing that grows with the corpus is broadcast.

Tokens are told apart by 64-bit hashes.  Defined cases: a null or empty text is its end
token alone; with no training rows every probability is that of the unknown token; rows
with equal or null ids are rows of their own; extra columns are not carried unless named
in ``keep``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

P_MIN = 1e-3
DIVERGENCE = 0.05
END = np.uint64(0xE9D0F0E0D0C0B0A1)
BUCKET_BYTES = 8 << 20  # text per bucket of counts
CHUNK_BYTES = 14 << 20  # text per chunk of scoring
FLUSH = 2_000_000  # tokens counted at once in a task


@dataclass
class Tree:
    """What every task knows: totals and at most 2 / P_MIN contexts."""

    buckets: int
    total: int = 0
    types: int = 0
    words: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))  # candidate words, sorted
    kept: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # ids of contexts, sorted
    seen: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # n(s)
    kinds: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # d(s)

    def contexts(self, tokens: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the one- and two-word contexts before each token, 0 if no candidates."""
        one, two = np.zeros(len(tokens), np.int64), np.zeros(len(tokens), np.int64)
        size = len(self.words)
        if not size:
            return one, two
        at = np.minimum(np.searchsorted(self.words, tokens), size - 1)
        word = np.where(self.words[at] == tokens, at + 1, 0)
        one[1:] = np.where(rows[1:] == rows[:-1], word[:-1], 0)
        before = np.where(rows[2:] == rows[:-2], word[:-2], 0)
        two[2:] = np.where((before > 0) & (one[2:] > 0), size + (before - 1) * size + one[2:], 0)
        return one, two

    def suffix(self, context: np.ndarray) -> np.ndarray:
        size = max(1, len(self.words))
        return np.where(context > size, (context - 1) % size + 1, 0)

    def known(self, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether contexts are kept, and their places."""
        if not len(self.kept):
            return np.zeros(len(context), bool), np.zeros(len(context), np.int64)
        at = np.minimum(np.searchsorted(self.kept, context), len(self.kept) - 1)
        return self.kept[at] == context, at

    def states(self, tokens: np.ndarray, rows: np.ndarray) -> np.ndarray:
        one, two = self.contexts(tokens, rows)
        return np.where(self.known(two)[0], two, np.where(self.known(one)[0], one, 0))

    def bucket(self, tokens: np.ndarray) -> np.ndarray:
        return (((tokens >> np.uint64(32)) * np.uint64(self.buckets)) >> np.uint64(32)).astype(np.int64)


def stream(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of the rows, each row with its end, and their rows."""
    hashes, rows = C.words(data, bounds)
    n = len(bounds) - 1
    counts = np.bincount(rows, minlength=n)
    tokens, owner = np.full(len(hashes) + n, END, np.uint64), np.repeat(np.arange(n), counts + 1)
    tokens[np.arange(len(hashes)) + rows] = hashes
    return tokens, owner


def pair_key(tokens: np.ndarray, context: np.ndarray) -> np.ndarray:
    return C.mix(tokens + context.astype(np.uint64) * C.BASE)


def tally(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, one place of each, and their (weighted) counts."""
    if weights is None:
        return np.unique(keys, return_index=True, return_counts=True)
    found, at, inverse = np.unique(keys, return_index=True, return_inverse=True)
    return found, at, np.bincount(inverse, weights=weights, minlength=len(found)).astype(np.int64)


BLOBS = "bucket long, tokens binary, contexts binary, counts binary"


def blobs(tree: Tree, tokens: np.ndarray, contexts: np.ndarray, *counts: np.ndarray) -> pa.RecordBatch:
    """Rows of arrays, one a bucket."""
    bucket = tree.bucket(tokens)
    order = np.argsort(bucket, kind="stable")
    found, starts = np.unique(bucket[order], return_index=True)
    columns = {"tokens": tokens, "contexts": contexts.astype(np.uint32), **{"counts": c for c in counts}}
    arrays = [pa.array(found, pa.int64())]
    for values in columns.values():
        values = values[order]
        arrays.append(pa.array([values[lo:hi].tobytes() for lo, hi in zip(starts, np.append(starts[1:], len(order)))], pa.binary()))
    return pa.RecordBatch.from_arrays(arrays, names=["bucket", *columns])


def counted(tree: Tree, pairs: bool):
    """Counts of tokens, or of tokens after candidate contexts, batch by batch."""

    def flush(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        tokens, rows = (np.concatenate(x) for x in zip(*held))
        if not pairs:
            found, at, n = tally(tokens)
            return blobs(tree, found, np.zeros(len(found), np.int64), n)
        one, two = tree.contexts(tokens, rows)
        symbols, contexts = np.concatenate([tokens[one > 0], tokens[two > 0]]), np.concatenate([one[one > 0], two[two > 0]])
        _, at, n = tally(pair_key(symbols, contexts))
        return blobs(tree, symbols[at], contexts[at], n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, base = [], 0, 0
        for batch in batches:
            for lo, hi, data, bounds in C.text_chunks(batch.column("_text")):
                tokens, rows = stream(data, bounds)
                held.append((tokens, rows + base))
                size, base = size + len(tokens), base + hi - lo
                if size > FLUSH:
                    yield flush(held)
                    held, size = [], 0
        if held:
            yield flush(held)

    return run


def read(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    kinds = {"tokens": np.uint64, "contexts": np.uint32, "counts": np.int64}
    parts = [np.frombuffer(b"".join(table.column(c).to_pylist()), kind) if table.num_rows else np.zeros(0, kind) for c, kind in kinds.items()]
    return parts[0], parts[1].astype(np.int64), parts[2]


def merged(table: pa.Table) -> pa.Table:
    """One row a bucket: what all batches counted."""
    tokens, contexts, counts = read(table)
    _, at, n = tally(pair_key(tokens, contexts), counts)
    values = [tokens[at], contexts[at].astype(np.uint32), n]
    row = [table.column("bucket")[:1].combine_chunks(), *[pa.array([v.tobytes()], pa.binary()) for v in values]]
    sums = [pa.array([len(n)], pa.int64()), pa.array([int(n.sum())], pa.int64())]
    return pa.Table.from_arrays([*row, *sums], names=["bucket", "tokens", "contexts", "counts", "types", "total"])


class Shelf:
    """The counts of one bucket, to look up."""

    def __init__(self, tree: Tree, singles: pa.Table, pairs: pa.Table):
        self.tree = tree
        tokens, contexts, counts = (np.concatenate(x) for x in zip(read(singles), read(pairs)))
        self.keys = pair_key(tokens, contexts)
        order = np.argsort(self.keys)
        self.keys, self.counts = self.keys[order], counts[order]

    def count(self, tokens: np.ndarray, contexts: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(tokens), np.int64)
        wanted = pair_key(tokens, contexts)
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.counts[at], 0)

    def base(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        c = self.count(tokens, np.zeros(len(tokens), np.int64))
        return c, (c + 1) / (self.tree.total + self.tree.types + 1)

    def probability(self, tokens: np.ndarray, contexts: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """P(token | context), given that under the context's suffix; only kept contexts."""
        kept, at = self.tree.known(contexts)
        out = lower.copy()
        if kept.any():
            n, d = self.tree.seen[at[kept]], self.tree.kinds[at[kept]]
            c = self.count(tokens[kept], contexts[kept])
            out[kept] = np.maximum(c - 1, 0) / n + d / n * lower[kept]
        return out


def context_sums(pairs: DataFrame) -> DataFrame:
    """(context, n, d): tokens and different tokens after each candidate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, contexts, counts = read(pa.Table.from_batches([batch]))
            found, inverse = np.unique(contexts, return_inverse=True)
            n = np.bincount(inverse, weights=counts, minlength=len(found)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n), pa.array(np.bincount(inverse, minlength=len(found)))], names=["context", "n", "d"])

    sums = pairs.select("tokens", "contexts", "counts").mapInArrow(run, "context long, n long, d long")
    return sums.groupBy("context").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))


def divergences(model: DataFrame, tree: Tree) -> DataFrame:
    """(context, gain, covered): parts of each candidate's divergence from its suffix, for
    tokens seen twice or more, and what the suffix gives these.  ``tree`` keeps all
    candidates here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                singles, pairs = sides(batch.slice(i, 1))
                shelf = Shelf(tree, singles, pairs)
                tokens, contexts, counts = read(pairs)
                use = (counts > 1) & tree.known(contexts)[0]
                tokens, contexts = tokens[use], contexts[use]
                lower = shelf.probability(tokens, tree.suffix(contexts), shelf.base(tokens)[1])
                own = shelf.probability(tokens, contexts, lower)
                found, inverse = np.unique(contexts, return_inverse=True)
                sums = [np.bincount(inverse, weights=w, minlength=len(found)) for w in (own * np.log2(own / lower), lower)]
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), *map(pa.array, sums)], names=["context", "gain", "covered"])

    parts = model.mapInArrow(run, "context long, gain double, covered double")
    return parts.groupBy("context").agg(F.sum("gain").alias("gain"), F.sum("covered").alias("covered"))


def sides(rows: pa.RecordBatch | pa.Table) -> tuple[pa.Table, pa.Table]:
    """The counts of tokens and those of pairs of a model row."""
    table = pa.Table.from_batches([rows]) if isinstance(rows, pa.RecordBatch) else rows
    return table.select(["tokens", "contexts", "counts"]), table.select(["p_tokens", "p_contexts", "p_counts"]).rename_columns(["tokens", "contexts", "counts"])


def train(docs: DataFrame, text: str = "text", p_min: float = P_MIN, divergence: float = DIVERGENCE) -> tuple[Tree, DataFrame]:
    """The tree, and the counts (one row a bucket)."""
    texts = docs.select(F.col(text).alias("_text"))
    size = texts.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    tree = Tree(buckets=max(8, -(-size // BUCKET_BYTES)))
    rows = "bucket long, tokens binary, contexts binary, counts binary, types long, total long"
    singles = C.stash(texts.mapInArrow(counted(tree, False), BLOBS).groupBy("bucket").applyInArrow(merged, rows), "tokens")
    sums = singles.agg(F.sum("types"), F.sum("total")).first()
    tree.types, tree.total = sums[0] or 0, sums[1] or 0
    least = p_min * tree.total

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, _, counts = read(pa.Table.from_batches([batch]))
            use = (counts >= least) & (tokens != END)
            yield pa.RecordBatch.from_arrays([pa.array(C.signed(tokens[use]))], names=["token"])

    words = singles.select("tokens", "contexts", "counts").mapInArrow(frequent, "token long").toArrow()  # at most 1 / p_min
    tree.words = np.sort(words.column("token").to_numpy().astype(np.int64).view(np.uint64))
    pairs = C.stash(texts.mapInArrow(counted(tree, True), BLOBS).groupBy("bucket").applyInArrow(merged, rows), "pairs")
    renamed = pairs.select("bucket", *[F.col(c).alias(f"p_{c}") for c in ("tokens", "contexts", "counts")])
    empty = F.lit(b"")
    model = singles.select("bucket", "tokens", "contexts", "counts").join(renamed, "bucket", "left")
    model = C.stash(model.select("bucket", "tokens", "contexts", "counts", *[F.coalesce(f"p_{c}", empty).alias(f"p_{c}") for c in ("tokens", "contexts", "counts")]), "counts")

    found = context_sums(pairs).where(F.col("n") >= least).orderBy("context").toArrow()  # at most 1 / p_min of each length
    tree.kept, tree.seen, tree.kinds = (found.column(c).to_numpy().astype(np.int64) for c in ("context", "n", "d"))
    # Candidates of two words need theirs of one, which are more frequent still.
    whole = tree.known(tree.suffix(tree.kept))[0] | (tree.kept <= len(tree.words))
    tree.kept, tree.seen, tree.kinds = tree.kept[whole], tree.seen[whole], tree.kinds[whole]
    told = {r["context"]: (r["gain"], r["covered"]) for r in divergences(model.drop("bucket"), tree).collect()}
    keep = set()
    for context, n, d in zip(tree.kept.tolist(), tree.seen.tolist(), tree.kinds.tolist()):
        gain, covered = told.get(context, (0.0, 0.0))
        if gain + d / n * (1 - covered) * math.log2(d / n) >= divergence:
            keep |= {context, int(tree.suffix(np.array([context]))[0])}
    use = np.isin(tree.kept, list(keep - {0}))
    tree.kept, tree.seen, tree.kinds = tree.kept[use], tree.seen[use], tree.kinds[use]
    return tree, model


def asked(tree: Tree, column: pa.ChunkedArray) -> tuple[np.ndarray, ...]:
    """Rows of the tokens of a chunk; its distinct (token, context) pairs, in order of
    buckets; and which of them each token is."""
    rows, keys, tokens, states = [], [], [], []
    base = 0
    for part in column.chunks:
        for lo, hi, data, bounds in C.text_chunks(part):
            t, r = stream(data, bounds)
            s = tree.states(t, r)
            rows.append((r + base).astype(np.int32))
            base += hi - lo
            tokens.append(t)
            states.append(s.astype(np.uint32))
    if not tokens:
        none = np.zeros(0, np.int64)
        return none, none.view(np.uint64), none, none
    row, token, state = np.concatenate(rows), np.concatenate(tokens), np.concatenate(states)
    _, at, inverse = np.unique(pair_key(token, state), return_index=True, return_inverse=True)
    token, state = token[at], state[at].astype(np.int64)
    order = np.argsort(tree.bucket(token), kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return row, token[order], state[order], place[inverse]


def score(docs: DataFrame, tree: Tree, model: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), key: tuple[Column | str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``."""
    head = [f"k_{i}" for i in range(len(keep))]
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    chunks = max(8, -(-size // CHUNK_BYTES))
    types = "".join(f"{h} {docs.schema[c].dataType.simpleString()}, " for c, h in zip(keep, head))
    dealt = docs.select(*[F.col(c).alias(h) for c, h in zip(keep, head)], F.coalesce(text, F.lit("")).alias("_text"), F.pmod(F.xxhash64(*key, text), F.lit(chunks)).alias("chunk"))

    def ask(table: pa.Table) -> pa.Table:
        _, tokens, states, _ = asked(tree, table.column("_text"))
        out = pa.Table.from_batches([blobs(tree, tokens, states)])
        return out.append_column("chunk", pa.array([table.column("chunk")[0].as_py()] * out.num_rows, pa.int64()))

    def answer(questions: pa.Table, counts: pa.Table) -> pa.Table:
        shelf = Shelf(tree, *sides(counts))
        known, logs = [], []
        for tokens, contexts in zip(questions.column("tokens").to_pylist(), questions.column("contexts").to_pylist()):
            tokens, contexts = np.frombuffer(tokens, np.uint64), np.frombuffer(contexts, np.uint32).astype(np.int64)
            c, p = shelf.base(tokens)
            p = shelf.probability(tokens, tree.suffix(contexts), p)
            p = shelf.probability(tokens, contexts, p)
            known.append(c.tobytes())
            logs.append(np.log10(p).tobytes())
        return pa.Table.from_arrays([questions.column("chunk"), questions.column("bucket"), pa.array(known, pa.binary()), pa.array(logs, pa.binary())], names=["chunk", "bucket", "known", "logs"])

    def sum_up(table: pa.Table, answers: pa.Table) -> pa.Table:
        rows, tokens, _, which = asked(tree, table.column("_text"))
        answers = answers.sort_by("bucket")
        c = np.frombuffer(b"".join(answers.column("known").to_pylist()) or bytes(8), np.int64)[: len(tokens)]
        logs = np.frombuffer(b"".join(answers.column("logs").to_pylist()) or bytes(8), np.float64)[: len(tokens)]
        plain = np.log10((c + 1) / (tree.total + tree.types + 1))
        n = table.num_rows
        per = [np.bincount(rows, minlength=n), np.bincount(rows, weights=c[which] > 0, minlength=n).astype(np.int64), np.full(n, tree.total)]
        per += [np.bincount(rows, weights=w[which], minlength=n) for w in (plain, logs)]
        return pa.Table.from_arrays([*[table.column(h) for h in head], *map(pa.array, per)], names=[*head, "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    questions = dealt.groupBy("chunk").applyInArrow(ask, "bucket long, tokens binary, contexts binary, chunk long")
    answers = questions.groupBy("bucket").cogroup(model.groupBy("bucket")).applyInArrow(answer, "chunk long, bucket long, known binary, logs binary")
    out = dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(sum_up, f"{types}n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.select(*[F.col(h).alias(c) for c, h in zip(keep, head)], "n_tokens", "n_known", "train_tokens", "base_score", "score")
