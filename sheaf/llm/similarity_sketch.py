"""Near-duplicate documents by fast similarity sketching.

A document is the set of its five-word shingles (A-Z lower-cased).  A sketch of
``SIZE`` coordinates is filled in rounds: in each of the first ``SIZE`` rounds every
shingle goes to one hashed bin, in the next ``SIZE`` rounds all shingles go to the
bin of that round, so every coordinate is filled at the latest then; a bin keeps the
smallest (round, hash), and rounds end once no bin is empty.  The share of agreeing
coordinates is concentrated around the Jaccard similarity as with full MinHash, at
the cost of one or two rounds for all but the shortest texts.

Bands of the sketch propose pairs, one bit of every coordinate screens them, and full
shingle sets decide each of them.  Of a
bucket's pairs only these are looked at: every member against the smallest one, and
then, inside the tasks, those of members whose components still differ.  At
similarity 0.75 a pair shares no band with odds of 5e-6, less above it.

Defined cases: a null or empty text, or one without words, has no shingles and is
linked with nothing; one to four words are one shingle; rows with equal or null ids
are rows of their own; ``component_id`` ignores null ids and is null if there is no
other; extra columns are not carried unless named in ``keep``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

SIZE = 512
BANDS = 32
ROWS = 4  # coordinates of a band
WIDTH = 5  # words of a shingle
PERCENT = 75
LEAST_BITS = 414  # of 512 one-bit coordinates; a pair at 0.75 has fewer with odds of 3e-6
BITS = [f"b{i}" for i in range(SIZE // 64)]
HUB_SHARE = 2000  # members of a hub that meet in one task
BLOCK = 512  # members of a bucket compared at once

EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingles(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of the rows and their rows, rows in order."""
    hashes, rows = C.words(data, bounds)
    grams, first = C.windows(hashes, rows, WIDTH)
    gram_rows = rows[first]
    counts = np.bincount(rows, minlength=len(bounds) - 1)
    short = np.flatnonzero((counts > 0) & (counts < WIDTH))
    if len(short):
        starts = np.concatenate([[0], np.cumsum(counts)])
        whole = np.full(len(short), np.uint64(0x5851F42D4C957F2D), np.uint64)
        for k in range(WIDTH - 1):
            more = counts[short] > k
            whole[more] = C.mix(whole[more] * C.BASE + hashes[starts[short[more]] + k])
        grams, gram_rows = np.concatenate([grams, whole]), np.concatenate([gram_rows, short])
    keyed = C.mix(grams + gram_rows.astype(np.uint64) * C.BASE)
    once = np.unique(keyed, return_index=True)[1]
    order = once[np.argsort(gram_rows[once], kind="stable")]
    return grams[order], gram_rows[order]


def sketch(grams: np.ndarray, rows: np.ndarray, n: int, size: int = SIZE) -> np.ndarray:
    """Sketches of ``n`` sets; those of empty sets stay ``EMPTY``."""
    out = np.full(n * size, EMPTY, np.uint64)
    shift = np.uint64(64 - (size.bit_length() - 1))
    for turn in range(2 * size):
        if not len(grams):
            break
        drawn = C.mix(grams + np.uint64((turn + 1) * int(C.BASE) % (1 << 64)))
        place = (drawn >> shift).astype(np.int64) if turn < size else turn - size
        value = (np.uint64(turn) << np.uint64(48)) | (drawn & np.uint64((1 << 48) - 1))
        np.minimum.at(out, rows * size + place, value)
        live = np.unique(rows)
        unfilled = np.zeros(n, bool)
        unfilled[live] = (out.reshape(n, size)[live] == EMPTY).any(axis=1)
        more = unfilled[rows]
        grams, rows = grams[more], rows[more]
    return out.reshape(n, size)


def bands(sketches: np.ndarray) -> np.ndarray:
    """Hashes of the first ``BANDS`` runs of coordinates; all coordinates give bits."""
    parts = sketches[:, : BANDS * ROWS].reshape(len(sketches), BANDS, ROWS)
    out = np.broadcast_to(np.arange(1, parts.shape[1] + 1, dtype=np.uint64), parts.shape[:2]) * C.BASE
    for k in range(ROWS):
        out = C.mix(out + parts[:, :, k]) * C.BASE
    return out


def set_keys(grams: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size and two order-free hashes of each set."""
    ends = np.searchsorted(rows, np.arange(n + 1))
    keys = []
    for salt in (0x2545F4914F6CDD1D, 0x9FB21C651E98DF25):
        total = np.zeros(len(grams) + 1, np.uint64)
        np.cumsum(C.mix(grams ^ np.uint64(salt)), out=total[1:])
        keys.append(C.signed(total[ends[1:]] - total[ends[:-1]]))
    return np.diff(ends), keys[0], keys[1]


def signatures(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    kept = docs.select(*[F.col(c).alias(f"k_{i}") for i, c in enumerate(keep)], F.col(text).alias("_text"))
    head = [f for f in kept.schema.fields if f.name != "_text"]
    names = [f.name for f in head] + ["n", "k1", "k2", *BITS, "bands"]
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in head] + ["n long, k1 long, k2 long", *[f"{b} long" for b in BITS], "bands array<long>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, bounds in C.text_chunks(batch.column("_text")):
                grams, rows = shingles(data, bounds)
                sizes, k1, k2 = set_keys(grams, rows, hi - lo)
                sketches = sketch(grams, rows, hi - lo)
                bits = np.packbits((sketches & np.uint64(1)).astype(bool), axis=1).view(np.int64)
                keys = C.signed(bands(sketches))
                ends = pa.array(np.arange(hi - lo + 1, dtype=np.int32) * keys.shape[1])
                arrays = [batch.column(f.name).slice(lo, hi - lo) for f in head]
                arrays += [pa.array(x) for x in (sizes.astype(np.int64), k1, k2, *bits.T.copy())]
                yield pa.RecordBatch.from_arrays([*arrays, pa.ListArray.from_arrays(ends, pa.array(keys.ravel()))], names=names)

    return kept.mapInArrow(run, schema)


def likely(left: str, right: str) -> Column:
    """Sizes and one-bit sketches that a linked pair has."""
    apart = sum((F.bit_count(F.col(f"{left}.{b}").bitwiseXOR(F.col(f"{right}.{b}"))) for b in BITS), F.lit(0))
    a, b = F.col(f"{left}.n"), F.col(f"{right}.n")
    return (100 * F.least(a, b) >= PERCENT * F.greatest(a, b)) & (apart <= SIZE - LEAST_BITS)


def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (hub, share, member), the hub's own text first: links of members
    with it.  Only the hub's set is held from one batch to the next."""
    held = (None, None, None)
    for batch in batches:
        for lo, hi, data, bounds in C.text_chunks(batch.column("text")):
            grams, rows = shingles(data, bounds)
            sizes, k1, k2 = set_keys(grams, rows, hi - lo)
            ends = np.searchsorted(rows, np.arange(hi - lo + 1))
            get = {c: batch.column(c).slice(lo, hi - lo).to_numpy(zero_copy_only=False) for c in ("hub", "share", "node", "member", "k1", "k2")}
            same = (get["k1"] == k1) & (get["k2"] == k2)  # else another text under the same id
            a, b = [], []
            for i in np.flatnonzero(same):
                own = np.sort(grams[ends[i] : ends[i + 1]])
                key = (get["hub"][i], get["share"][i])
                if not get["member"][i]:
                    held = (*key, own)
                elif held[:2] == key:
                    other = held[2]
                    at = np.minimum(np.searchsorted(other, own), len(other) - 1)
                    common = int((other[at] == own).sum())
                    if 100 * common >= PERCENT * (len(own) + len(other) - common):
                        a.append(get["node"][i])
                        b.append(key[0])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def confirm(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Links among ``pairs`` (a, b) by full sets.

    The members of a hub b are dealt into shares, each with a copy of the hub's text,
    so that no task gets all members of one.
    """
    degree = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / HUB_SHARE).cast("long").alias("_shares"))
    dealt = pairs.join(degree, "b").select("a", "b", F.expr("pmod(xxhash64(a), _shares)").alias("share"))
    roles = dealt.select(F.col("a").alias("node"), F.col("b").alias("hub"), "share", F.lit(True).alias("member"))
    roles = roles.union(dealt.select(F.col("b").alias("node"), F.col("b").alias("hub"), "share", F.lit(False).alias("member")).distinct())
    wanted = roles.join(nodes.select("node", "id", "k1", "k2"), "node")
    # A merge join at every size: roles grow with the documents, so they are never sent whole.
    texts = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("text")).hint("merge").join(C.stash(wanted, "roles"), F.col("_id").eqNullSafe(F.col("id")))
    met = texts.select("hub", "share", "node", "member", "k1", "k2", "text").repartition("hub", "share").sortWithinPartitions("hub", "share", "member")
    return met.mapInArrow(compare, "a long, b long").distinct()


def blocked(multi: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of the buckets in which components differ, dealt into groups.

    The largest component of a bucket is only compared with the others, so a bucket full
    of joined copies costs little.  Both sides are cut into blocks, and a group is one
    block of the others with one block of either side: of a bucket of any size, a task
    gets ``2 * BLOCK`` members at a time.
    """
    rows = multi.select("band", "node").join(labels, "node", "left").select("band", "node", F.coalesce("label", "node").alias("comp"))
    rows = C.stash(rows, "members")
    parts = rows.groupBy("band", "comp").agg(F.count(F.lit(1)).alias("c"))
    tops = parts.groupBy("band").agg(F.max(F.struct("c", "comp")).alias("top"), F.sum("c").alias("all"), F.count(F.lit(1)).alias("parts"))
    most, rest = F.ceil(F.col("top.c") / BLOCK), F.ceil((F.col("all") - F.col("top.c")) / BLOCK)
    tops = C.stash(tops.where("parts > 1").select("band", F.col("top.comp").alias("major"), most.alias("most"), rest.alias("rest")), "split")
    rows = rows.join(tops, "band").withColumn("minor", F.col("comp") != F.col("major"))
    own = F.when(F.col("minor"), F.expr("pmod(xxhash64(node), rest)")).otherwise(F.expr("pmod(xxhash64(node), most)"))
    rows = rows.withColumn("own", own)
    each = F.sequence(F.lit(0).cast("long"), F.col("rest") - 1)
    among = F.transform(each, lambda k: F.struct(F.lit(True).alias("among"), F.least(k, F.col("own")).alias("i"), F.greatest(k, F.col("own")).alias("j")))
    across = F.transform(F.sequence(F.lit(0).cast("long"), F.col("most") - 1), lambda k: F.struct(F.lit(False).alias("among"), F.col("own").alias("i"), k.alias("j")))
    theirs = F.transform(each, lambda k: F.struct(F.lit(False).alias("among"), k.alias("i"), F.col("own").alias("j")))
    rows = rows.withColumn("g", F.explode(F.when(F.col("minor"), F.concat(among, across)).otherwise(theirs)))
    return rows.select(
        F.xxhash64("band", "g.among", "g.i", "g.j").alias("group"), "band", "node", "comp", "minor", "own", (F.col("g.among") & (F.col("g.i") == F.col("g.j"))).alias("one"), F.col("g.among").alias("among")
    )


def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per member of a group the members before it that it may be linked with: of another
    component, of like size and bits, and in no earlier bucket together."""
    names = ["group", "node", "comp", "partners"]
    for table in C.grouped(batches, "group"):
        n = table.num_rows
        get = {c: table.column(c).to_numpy() for c in ("group", "node", "comp", "minor", "own", "one", "among", "n", "band")}
        bits = np.stack([table.column(b).to_numpy() for b in BITS], axis=1).view(np.uint64)
        keys = table.column("bands").combine_chunks().flatten().to_numpy().reshape(n, BANDS)
        place = np.argmax(keys == get["band"][:, None], axis=1)  # the bucket's own band
        wanted = np.zeros(n, bool)
        found: list[np.ndarray] = []
        for i in range(n):
            j = np.flatnonzero(get["comp"][:i] != get["comp"][i])
            # Members of one block meet in the block's own group, sides in theirs.
            apart = np.where(get["among"][j], get["one"][j] | (get["own"][j] != get["own"][i]), get["minor"][j] != get["minor"][i])
            j = j[apart]
            small, large = np.minimum(get["n"][j], get["n"][i]), np.maximum(get["n"][j], get["n"][i])
            j = j[100 * small >= PERCENT * large]
            j = j[np.bitwise_count(bits[j] ^ bits[i]).sum(axis=1) <= SIZE - LEAST_BITS]
            j = j[np.argmax(keys[j] == keys[i], axis=1) == place[i]]
            wanted[i] |= bool(len(j))
            wanted[j] = True
            found.append(j)
        if wanted.any():
            at = np.flatnonzero(wanted)
            ends = np.concatenate([[0], np.cumsum([len(found[i]) for i in at])]).astype(np.int32)
            partners = get["node"][np.concatenate([found[i] for i in at])] if ends[-1] else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*[pa.array(get[c][at]) for c in names[:3]], pa.ListArray.from_arrays(pa.array(ends), pa.array(partners))], names=names)


def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between components of a group by full sets; pairs that other links have
    joined by then are left out, so a group gives fewer links than it has members."""
    for table in C.grouped(batches, "group"):
        data, bounds = C.text_buffer(table.column("text"))
        grams, rows = zip(*(shingles(data[bounds[k] : bounds[k + 1]], np.array([0, bounds[k + 1] - bounds[k]])) for k in range(table.num_rows)))
        k1, k2 = (np.array([set_keys(g, r, 1)[x][0] for g, r in zip(grams, rows)]) for x in (1, 2))
        true = (k1 == table.column("k1").to_numpy()) & (k2 == table.column("k2").to_numpy())  # else another text under the id
        nodes, comp = table.column("node").to_numpy(), table.column("comp").to_numpy()
        sets = {int(nodes[k]): np.sort(grams[k]) for k in np.flatnonzero(true)}
        parent = {int(c): int(c) for c in comp}
        of = dict(zip(nodes.tolist(), comp.tolist()))

        def top(c: int) -> int:
            while parent[c] != c:
                parent[c] = c = parent[parent[c]]
            return c

        links = []
        for node, partners in zip(nodes.tolist(), table.column("partners").to_pylist()):
            for other in partners:
                x, y = top(of[node]), top(of[other])
                if x == y or node not in sets or other not in sets:
                    continue
                a, b = sets[node], sets[other]
                shared = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
                if 100 * shared >= PERCENT * (len(a) + len(b) - shared):
                    parent[x] = y
                    links.append((of[node], of[other]))
        if links:
            a, b = zip(*links)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def across_components(multi: DataFrame, labels: DataFrame, signed: DataFrame, docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Links (a, b) of components that the links to the hubs have left apart.

    Pairs are formed and decided inside the tasks: what leaves them has a row a member,
    or a row a link, however many pairs a group has.
    """
    members = blocked(multi, labels).join(signed.select("node", "n", *BITS, "bands"), "node")
    near = members.repartition("group").sortWithinPartitions("group").mapInArrow(screen, "group long, node long, comp long, partners array<long>")
    wanted = C.stash(near.join(signed.select("node", "id", "k1", "k2"), "node"), "apart")
    # One row a document on its way to the text; its groups follow from there.
    asked = wanted.groupBy("node", "id", "k1", "k2", "comp").agg(F.collect_list(F.struct("group", "partners")).alias("groups"))
    texts = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("text")).hint("merge").join(C.stash(asked, "asked"), F.col("_id").eqNullSafe(F.col("id")))
    met = texts.select("node", "comp", "k1", "k2", "text", F.explode("groups").alias("g")).select("g.group", "node", "comp", "k1", "k2", "g.partners", "text")
    return met.repartition("group").sortWithinPartitions("group").mapInArrow(settle, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, ``n_shingles``, ``component_id``, ``kept`` (the id is
    the component's), ``first`` (exactly one row of each component), ``text_key`` (a hash of the text)."""
    sig = C.stash(signatures(docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"), F.xxhash64(text).alias("_tk")), "_text", ["_id", "_tk"]).withColumn("_row", F.monotonically_increasing_id()), "signatures")
    nodes = C.stash(sig.where("n > 0").groupBy("n", "k1", "k2").agg(F.min("_row").alias("node")), "nodes")
    each = sig.join(nodes.select("node"), sig["_row"] == F.col("node"), "left_semi")
    signed = C.stash(each.select(F.col("_row").alias("node"), F.col("k_0").alias("id"), "n", "k1", "k2", *BITS, "bands"), "sets")
    exploded = signed.select(F.explode("bands").alias("band"), "node")
    hubs = exploded.groupBy("band").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("c")).where("c > 1").select("band", "hub")
    multi = C.stash(exploded.join(C.stash(hubs, "hubs"), "band"), "buckets")

    facts = signed.select("node", "n", *BITS)
    stars = multi.where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    stars = stars.join(facts.alias("x"), F.col("a") == F.col("x.node")).join(facts.alias("y"), F.col("b") == F.col("y.node"))
    stars = C.stash(stars.where(likely("x", "y")).select("a", "b"), "stars")
    links = C.stash(confirm(stars, docs, signed, doc_id, text), "links")
    labels = C.components(links)

    more = C.stash(across_components(multi, labels, signed, docs, doc_id, text), "links")
    if not more.isEmpty():
        higher = C.components(more).select(F.col("node").alias("label"), F.col("label").alias("up"))
        single = higher.select(F.col("label").alias("node"), F.col("up").alias("label")).join(labels, "node", "left_anti")
        labels = labels.join(higher, "label", "left").select("node", F.coalesce("up", "label").alias("label")).unionByName(single)
        labels = C.stash(labels, "labels")

    placed = sig.select("k_0", "k_1", "_row", "n", "k1", "k2").join(nodes, ["n", "k1", "k2"], "left").join(labels, "node", "left")
    placed = C.stash(placed.select("k_0", "k_1", "_row", "n", F.coalesce("label", "node", "_row").alias("label")), "placed")
    smallest = placed.groupBy("label").agg(F.min(F.struct(F.col("k_0").isNull().alias("none"), "k_0", "_row")).alias("s"))
    smallest = C.stash(smallest.select("label", F.col("s.k_0").alias("component_id"), F.col("s._row").alias("_first")), "classes")
    out = placed.join(smallest, "label")
    return out.select(
        F.col("k_0").alias(doc_id),
        F.col("n").alias("n_shingles"),
        "component_id",
        F.col("k_0").eqNullSafe(F.col("component_id")).alias("kept"),
        (F.col("_row") == F.col("_first")).alias("first"),
        F.col("k_1").alias("text_key"),
    )


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each component; a row repeated in full is kept once.

    Rows are known by id and text, so ids may be null or shared: what goes is each pair
    of them that is not the first of its component, and the copies of one that is.
    """
    pair = near_duplicates(docs, doc_id, text).groupBy(F.col(doc_id).alias("_gone_id"), F.col("text_key").alias("_gone_key"))
    seen = pair.agg(F.bool_or("first").alias("_stays"), F.bool_or(~F.col("first")).alias("_goes"))
    gone = C.stash(seen.where("_goes"), "gone")
    same = F.col(doc_id).eqNullSafe(F.col("_gone_id")) & (F.xxhash64(text) == F.col("_gone_key"))
    left = docs.join(gone.where(~F.col("_stays")), same, "left_anti")
    repeats = gone.where("_stays")
    if repeats.isEmpty():
        return left
    return left.join(repeats, same, "left_anti").unionByName(left.join(repeats, same, "left_semi").dropDuplicates([doc_id, text]))
