"""Repeated passages by suffix sorting, deep-shallow.

Removed is each byte that a string of ``length`` bytes covers which starts anywhere
else too, in the same text or another; texts are judged as they came in.

Sampling: of every ``length`` consecutive bytes the smallest hash of ``GRAM`` bytes,
leftmost first, is an anchor, so equal strings of that length hold an equal anchor at
an equal place.  Texts meet by anchor.  What surrounds an anchor inside its text, up
to ``length - GRAM`` bytes before it and ``length`` from it on, is its context; equal
contexts are counted without moving text.  Of a shared string at least half of what is
not the anchor lies on one side of it, so contexts that differ need only meet where
they share that half at the left or at the right.  Those that do are fetched, and
their suffixes (and reversed prefixes) are sorted: multikey quicksort by eight-byte
characters to a shallow depth, then blind tries for those still tied.  Common prefixes
of neighbours then give each string's longest match at either side.  A half shared by
more than ``CROWD`` different contexts is not brought into one task: hashes of all
their strings are counted instead.

Defined cases: a null text is empty and returned with an empty rest; texts shorter
than ``length`` keep all bytes; rows with equal or null ids are rows of their own, so
the copy of a whole row counts as another text; what is left is given as bytes, for a
cut may fall inside a UTF-8 character.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

LENGTH = 400
GRAM = 32
SHALLOW = 4  # eight-byte characters compared by multikey quicksort
PLACE_BITS = np.uint64(24)  # places within a chunk; longer texts are cut with overlap
PIECE = 1 << 21
CROWD = 20_000
PAIRWISE = 200  # contexts of a group whose common parts are laid out as a matrix


def smallest_places(hashes: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` hashes the place of its smallest, leftmost first.

    Minima from the left and from the right inside blocks of ``width`` meet.
    """
    n = len(hashes)
    if n < width:
        return np.zeros(0, np.int64)
    low = (np.uint64(1) << PLACE_BITS) - np.uint64(1)
    value = (hashes & ~low) | np.arange(n, dtype=np.uint64)
    blocks = -(-n // width)
    grid = np.full(blocks * width, np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64)
    grid[:n] = value
    grid = grid.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()[:n]
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()[:n]
    return (np.minimum(back[: n - width + 1], ahead[width - 1 :]) & low).astype(np.int64)


def anchors(data: np.ndarray, bounds: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Row, place in the row, anchor key, context key, keys of the left and of the right
    half (0: there is none), context bytes before and from the anchor."""
    sums = C.prefix_sums(data)
    width = length - GRAM + 1
    n = len(data) - GRAM + 1
    none = np.zeros(0, np.int64)
    if n < width:
        return (none,) * 8
    at = np.arange(n)
    hashes = C.slice_hash(sums, at, at + GRAM)
    places = smallest_places(hashes, width)
    inside = np.zeros(len(places) + 1, np.int64)  # windows that do not leave their row
    fits = bounds[1:] - bounds[:-1] >= length
    np.add.at(inside, bounds[:-1][fits], 1)
    np.add.at(inside, bounds[1:][fits] - length + 1, -1)
    found = np.unique(places[np.cumsum(inside[:-1]) > 0])
    row = C.row_of(bounds, found)
    before = np.minimum(found - bounds[row], length - GRAM)
    after = np.minimum(bounds[row + 1] - found, length)
    context = C.mix(C.slice_hash(sums, found - before, found + after) + (before * 1000003 + after).astype(np.uint64) * C.BASE)
    half = (length - GRAM) // 2
    lower = C.slice_hash(sums, np.maximum(found - half, 0), found + GRAM)
    upper = C.mix(C.slice_hash(sums, found, np.minimum(found + GRAM + half, len(data))) + C.BASE)
    lower[before < half], upper[after < GRAM + half] = 0, 0
    return row, found - bounds[row], C.signed(hashes[found]), C.signed(context), C.signed(lower), C.signed(upper), before, after


def anchored(docs: DataFrame, text: str, length: int) -> DataFrame:
    """One row per anchor: ``id`` of the text, place, keys and context bounds."""
    schema = "id long, at long, key long, context long, lower long, upper long, before int, after int"
    names = ["id", "at", "key", "context", "lower", "upper", "before", "after"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            for lo, hi, data, bounds in C.text_chunks(batch.column(text)):
                # A long text is cut into pieces that share length - 1 bytes; anchors found
                # twice agree, but their contexts must be those of the whole text.
                margin = 2 * length
                for cut in range(0, max(1, len(data)), PIECE):
                    begin, end = max(0, cut - margin), min(len(data), cut + PIECE + margin)
                    part = np.clip(bounds - begin, 0, end - begin)
                    row, at, *keys, before, after = anchors(data[begin:end], part, length)
                    place = at + part[row] + begin
                    own = (place >= cut) & (place < cut + PIECE)
                    columns = [ids[lo + row[own]], (place - bounds[row])[own], *[k[own] for k in keys], before[own].astype(np.int32), after[own].astype(np.int32)]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=names)

    return docs.select("id", text).mapInArrow(run, schema)


def common(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix."""
    n = min(len(a), len(b))
    differ = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n if not differ else n - (differ.bit_length() + 7) // 8


class BlindTrie:
    """Strings under branching places only; what lies between is read once an insert."""

    def __init__(self, strings: list[bytes]):
        self.strings = strings
        self.root: list | int | None = None  # an inner node is [place, {byte: child}], a leaf [-1, ids]

    def insert(self, which: int) -> None:
        if self.root is None:
            self.root = [-1, [which]]
            return
        text, node = self.strings[which], self.root
        while node[0] >= 0:  # blind: only the branching bytes are compared
            sign = text[node[0]] if node[0] < len(text) else -1
            node = node[1][sign] if sign in node[1] else next(iter(node[1].values()))
        other = self.strings[node[1][0]]
        shared = common(text, other)
        if shared == len(text) == len(other):
            node[1].append(which)
            return
        hold, slot, node = None, None, self.root  # again from the top, down to where they part
        while 0 <= node[0] < shared:
            hold, slot = node, text[node[0]] if node[0] < len(text) else -1
            node = node[1][slot]
        mine = text[shared] if shared < len(text) else -1
        if node[0] == shared:
            node[1][mine] = [-1, [which]]
            return
        theirs = other[shared] if shared < len(other) else -1
        split = [shared, {theirs: node, mine: [-1, [which]]}]
        if hold is None:
            self.root = split
        else:
            hold[1][slot] = split

    def ordered(self) -> list[int]:
        out, stack = [], [self.root]
        while stack:
            node = stack.pop()
            if node[0] < 0:
                out += node[1]
            else:
                stack += [node[1][k] for k in sorted(node[1], reverse=True)]
        return out


def deep_shallow(strings: list[bytes]) -> tuple[list[int], np.ndarray]:
    """Order of the strings, and each one's common prefix with the one before it."""
    packed = np.zeros((len(strings), SHALLOW * 8), np.uint8)
    for i, s in enumerate(strings):
        head = s[: SHALLOW * 8]
        packed[i, : len(head)] = np.frombuffer(head, np.uint8)
    characters = packed.view(">u8")
    order: list[int] = []

    def shallow(group: np.ndarray, depth: int) -> None:
        """Multikey quicksort: three parts around a pivot, the middle one deeper."""
        stack = [(group, depth)]
        while stack:
            group, depth = stack.pop()
            if len(group) == 1:
                order.append(int(group[0]))
            elif depth == SHALLOW:
                trie = BlindTrie(strings)
                for i in group:
                    trie.insert(int(i))
                order.extend(trie.ordered())
            else:
                keys = characters[group, depth]
                pivot = keys[len(keys) // 2]
                parts = [(group[keys > pivot], depth), (group[keys == pivot], depth + 1), (group[keys < pivot], depth)]
                stack += [p for p in parts if len(p[0])]

    shallow(np.arange(len(strings)), 0)
    shared = np.zeros(len(strings), np.int64)
    for k in range(1, len(order)):
        shared[k] = common(strings[order[k - 1]], strings[order[k]])
    return order, shared


def best(shared: np.ndarray) -> np.ndarray:
    """Longest common prefix of each sorted string with either neighbour."""
    out = shared.copy()
    out[:-1] = np.maximum(out[:-1], shared[1:])
    return out


def match_spans(before: list[bytes], after: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """How far each context of one anchor is covered to the left and to the right of it
    by strings of ``length`` bytes that another context has as well; 0, 0 if none."""
    n = len(before)
    left, right = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if n == 2:
        sides = common(*before), common(*after)
        if sum(sides) >= length:
            left[:], right[:] = sides
        return left, right
    reach, ranks, steps = [], [], []
    for side in (before, after):
        order, shared = deep_shallow(side)
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n)
        reach.append(best(shared)[rank])
        ranks.append(rank)
        steps.append(shared)
    live = np.flatnonzero(reach[0] + reach[1] >= length)
    if len(live) < 2:
        return left, right
    if n <= PAIRWISE:
        # What two contexts share at a side is the least of the steps between their ranks.
        shared = []
        for rank, step in zip(ranks, steps):
            least = np.zeros((n, n), np.int64)
            for k in range(n - 1):
                least[k, k + 1 :] = np.minimum.accumulate(step[k + 1 :])
            shared.append(np.maximum(least, least.T)[rank][:, rank])
        hit = shared[0] + shared[1] >= length
        return (shared[0] * hit).max(axis=1), (shared[1] * hit).max(axis=1)
    # A string that starts o bytes before the anchor is shared if both its parts are; the
    # classes of each part are the runs of sorted neighbours with that much in common.
    left[live] = -1
    for o in range(max(0, length - int(reach[1].max())), min(length - GRAM, int(reach[0].max())) + 1):
        who = live[(reach[0][live] >= o) & (reach[1][live] >= length - o)]
        if len(who) < 2:
            continue
        part = [np.cumsum(s < depth)[r[who]] for s, r, depth in zip(steps, ranks, (o, length - o))]
        joint = part[0] * (n + 1) + part[1]
        _, inverse, counts = np.unique(joint, return_inverse=True, return_counts=True)
        hit = who[counts[inverse] > 1]
        right[hit] = np.maximum(right[hit], np.where(left[hit] < 0, length - o, 0))
        left[hit] = o
    left[left < 0] = 0
    return left, right


def sorted_matches(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, starts, ends = [], [], []
        for group in C.grouped(batches, "key"):
            if group.num_rows > 1:
                # Reversed, so that what is common lies in front on both sides.
                before = [x[::-1] for x in group.column("left").to_pylist()]
                after = group.column("right").to_pylist()
                left, right = match_spans(before, after, length)
                hit = np.flatnonzero(left + right > 0)
                at = group.column("at").to_numpy()[hit]
                ids += group.column("id").to_numpy()[hit].tolist()
                starts += (at - left[hit]).tolist()
                ends += (at + right[hit]).tolist()
            if len(ids) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids, starts, ends)], names=["id", "begin", "end"])
                ids, starts, ends = [], [], []
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids, starts, ends)], names=["id", "begin", "end"])

    return run


def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per wanted context: its bytes before the anchor and from it on."""
    names = ["key", "id", "at", "crowd", "left", "right"]
    for batch in batches:
        data, bounds = C.text_buffer(batch.column("text"))
        ids, wants = batch.column("id").to_pylist(), batch.column("wants")
        out: list[list] = [[] for _ in names]
        size = 0
        for i, row_id in enumerate(ids):
            text = data[bounds[i] : bounds[i + 1]].tobytes()
            for w in wants[i].as_py():
                at = w["at"]
                row = (w["key"], row_id, at, w["crowd"], text[at - w["before"] : at], text[at : at + w["after"]])
                for column, value in zip(out, row):
                    column.append(value)
                size += w["before"] + w["after"]
            if size > 1 << 23 or i == len(ids) - 1:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds)], names=names)
                out, size = [[] for _ in names], 0


def strings_of(length: int):
    """Hashes of all strings of ``length`` bytes around the anchor of each context."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lefts, rights = batch.column("left").to_pylist(), batch.column("right").to_pylist()
            ids, ats = batch.column("id").to_numpy(), batch.column("at").to_numpy()
            for i, (left, right) in enumerate(zip(lefts, rights)):
                data = np.frombuffer(left + right, np.uint8)
                starts = np.arange(max(0, len(data) - length) + 1)[: len(left) + 1]
                hashes = C.signed(C.slice_hash(C.prefix_sums(data), starts, starts + length))
                begins = ats[i] - len(left) + starts
                same = [np.full(len(starts), x, np.int64) for x in (ids[i], ats[i])]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (hashes, *same, begins)], names=["hash", "id", "at", "begin"])

    return run


def repeated_spans(texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """(id, begin, end): spans, overlapping or not, whose union is what is repeated.

    ``texts`` has ``id`` (a long that stands for row and text), ``text`` and whatever
    else the caller's own join of it needs, so that both can share one exchange.
    """
    found = C.stash(anchored(texts, "text", length), "anchors")
    shared = C.stash(found.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("key"), "keys")
    found = C.stash(found.join(shared, "key"), "shared")
    each = found.groupBy("key", "context").agg(F.count(F.lit(1)).alias("c"), *[F.first(c).alias(c) for c in ("id", "at", "lower", "upper", "before", "after")])
    each = C.stash(each, "contexts")
    equal = found.join(each.where("c > 1").select("key", "context"), ["key", "context"])
    covered = equal.select("id", (F.col("at") - F.col("before")).alias("begin"), (F.col("at") + F.col("after")).alias("end"))

    halves = each.select(F.explode(F.array("lower", "upper")).alias("half"), "id", "at", "before", "after").where("half <> 0")
    meet = C.stash(halves.groupBy("half").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "halves")
    wanted = halves.join(meet, "half").select("id", F.struct(F.col("half").alias("key"), "at", "before", "after", (F.col("c") > CROWD).alias("crowd")).alias("w"))
    wanted = C.stash(wanted.groupBy("id").agg(F.collect_list("w").alias("wants")), "wanted")  # bounded by the text itself
    # Merge joins at every size, so that both reads of the texts share one exchange.
    fetched = texts.hint("merge").join(wanted, "id").mapInArrow(contexts, "key long, id long, at long, crowd boolean, left binary, right binary")
    met = fetched.where("not crowd").repartition("key").sortWithinPartitions("key").mapInArrow(sorted_matches(length), "id long, begin long, end long")
    spans = covered.unionByName(met)
    if meet.where(F.col("c") > CROWD).isEmpty():
        return spans
    crowd = C.stash(fetched.where("crowd").drop("crowd").dropDuplicates(["id", "at"]), "crowd")
    strings = C.stash(crowd.mapInArrow(strings_of(length), "hash long, id long, at long, begin long"), "strings")
    # A string counts once per place: different contexts may overlap in one text.
    places = strings.select("hash", "id", "begin").distinct()
    again = C.stash(places.groupBy("hash").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("hash"), "again")
    return spans.unionByName(places.join(again, "hash").select("id", "begin", (F.col("begin") + length).alias("end")))


def cut(as_text: bool, head: list[str]):
    """The rest of each text, and the removed spans, joined where they touch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = C.text_buffer(batch.column("text"))
            spans = batch.column("spans")
            rest, gone = [], []
            for i in range(batch.num_rows):
                text = data[bounds[i] : bounds[i + 1]]
                joined: list[list[int]] = []
                for s in sorted((s["begin"], s["end"]) for s in spans[i].as_py() or ()):
                    if joined and s[0] <= joined[-1][1]:
                        joined[-1][1] = max(joined[-1][1], s[1])
                    else:
                        joined.append(list(s))
                left = text.tobytes()
                if joined:
                    at = [0, *[x for s in joined for x in s], len(left)]
                    left = b"".join(left[a:b] for a, b in zip(at[::2], at[1::2]))
                rest.append(left.decode("utf-8", "ignore") if as_text else left)
                gone.append([{"begin": a, "end": b} for a, b in joined])
            arrays = [batch.column(c) for c in head]
            arrays += [pa.array(np.diff(bounds)), pa.array(gone, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))), pa.array(rest, pa.string() if as_text else pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*head, "n_bytes", "spans", "rest"])

    return run


def remove_repeats(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), doc_id: str = "doc_id", length: int = LENGTH, as_text: bool = False) -> DataFrame:
    """``keep``, ``n_bytes``, ``spans`` (removed bytes) and ``rest`` (what stays, as
    bytes, or as text without the parts of characters that a cut has left)."""
    head = [f"k_{i}" for i in range(len(keep))]
    key = F.xxhash64(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.coalesce(text, F.lit("")))
    texts = docs.select(key.alias("id"), F.coalesce(text, F.lit("")).alias("text"), *[F.col(c).alias(h) for c, h in zip(keep, head)])
    spans = repeated_spans(texts, length).groupBy("id").agg(F.collect_list(F.struct("begin", "end")).alias("spans"))
    joined = texts.hint("merge").join(spans, "id", "left")
    types = ", ".join(f"{h} {docs.schema[c].dataType.simpleString()}" for c, h in zip(keep, head))
    out = joined.mapInArrow(cut(as_text, head), f"{types}, n_bytes long, spans array<struct<begin:long,end:long>>, rest {'string' if as_text else 'binary'}")
    return out.select(*[F.col(h).alias(c) for c, h in zip(keep, head)], "n_bytes", "spans", "rest")
