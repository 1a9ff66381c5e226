"""Queries without an oracle SQL, over whole tables, against brute force, exact round
trips and held-out labels; and parts of the methods against their definitions."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from sheaf.llm import collision_counting, common, hypergeometric_shuffle, line_frequency, similarity_sketch, suffix_dedup
from sheaf.llm.best_fit_packing import packing_plan
from sheaf.llm.ppm_language import Model
from sheaf.llm.queries import QUERIES, tokenizer_path
from sheaf.llm.suffix_tree_lm import Shelf, Tree

SF = "/root/testdata/sf0.001"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def crc(doc_id: int) -> int:
    return zlib.crc32(str(doc_id).encode())


def removed(texts: dict, length: int = 400) -> dict:
    data = {d: t.encode() for d, t in texts.items()}
    seen = Counter(b[i : i + length] for b in data.values() for i in range(len(b) - length + 1))
    out = {}
    for d, b in data.items():
        mark = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                mark[i : i + length] = b"\1" * length
        out[d] = (b, mark)
    return out


def test_suffix_query(spark, texts):
    got = {r["doc_id"]: r for r in QUERIES["op5_suffix_dedup"](spark, SF).collect()}
    assert len(got) == len(texts)
    for d, (b, mark) in removed(texts).items():
        rest = bytes(x for x, m in zip(b, mark) if not m)
        runs = len(re.findall(rb"\x01+", bytes(mark)))
        assert (got[d]["n_bytes"], got[d]["n_removed"], got[d]["n_spans"], got[d]["kept_sha256"]) == (len(b), sum(mark), runs, hashlib.sha256(rest).hexdigest())


def test_match_spans_by_all_pairs():
    """Groups of contexts of every size, also beyond the pairwise form."""
    random.seed(3)
    for n, pairwise in ((2, 200), (3, 200), (9, 200), (9, 0), (40, 0)):
        suffix_dedup.PAIRWISE, was = pairwise, suffix_dedup.PAIRWISE
        try:
            for _ in range(20):
                pick = lambda most: bytes(random.choice(b"ab") if random.random() < 0.1 else 97 for _ in range(random.randint(0, most)))
                before, after = [pick(48) for _ in range(n)], [b"x" * 32 + pick(48) for _ in range(n)]
                left, right = suffix_dedup.match_spans(before, after, 80)
                for i in range(n):
                    want = [(a, b) for j in range(n) if j != i for a, b in [(suffix_dedup.common(before[i], before[j]), suffix_dedup.common(after[i], after[j]))] if a + b >= 80]
                    assert (left[i], right[i]) == ((max(a for a, _ in want), max(b for _, b in want)) if want else (0, 0))
        finally:
            suffix_dedup.PAIRWISE = was


def test_deep_shallow_sorts():
    random.seed(5)
    strings = [bytes(random.choice(b"ab") for _ in range(random.randint(0, 60))) for _ in range(300)]
    strings += [b"a" * 40 + s for s in strings] + [b"a" * 70] * 3
    order, shared = suffix_dedup.deep_shallow(strings)
    # Zero bytes fill up short heads, so equal up to them counts as equal.
    assert sorted(order) == list(range(len(strings)))
    assert [strings[i] for i in order] == sorted(strings)
    assert all(shared[k] == len(__import__("os").path.commonprefix([strings[order[k - 1]], strings[order[k]]])) for k in range(1, len(order)))


def test_crowded_halves(spark, texts):
    """The counted form for halves that too many contexts share gives the same spans."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    suffix_dedup.CROWD, was = 1, suffix_dedup.CROWD
    try:
        got = {r["doc_id"]: bytes(r["rest"]) for r in suffix_dedup.remove_repeats(docs).collect()}
    finally:
        suffix_dedup.CROWD = was
    assert got == {d: bytes(x for x, m in zip(b, mark) if not m) for d, (b, mark) in removed(texts).items()}


def test_packing_query(spark, texts):
    tokenizer = Tokenizer.from_file(tokenizer_path())
    got = QUERIES["op2_best_fit_packing"](spark, SF).collect()
    ids = {d: [*tokenizer.encode(t, add_special_tokens=False).ids, 2] for d, t in texts.items()}
    pieces: dict[int, list] = {}
    bins: dict[int, list] = {}
    for r in got:
        pieces.setdefault(r["doc_id"], []).append(r)
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for d, own in ids.items():
        at = 0
        for n, r in enumerate(sorted(pieces[d], key=lambda r: r["piece"])):
            part = own[r["start"] : r["start"] + r["length"]]
            assert (r["piece"], r["start"]) == (n, at) and (n == 0 or r["length"] == 1024)
            assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
            at += r["length"]
        assert at == len(own) and len(pieces[d]) == -(-len(own) // 1024)
    for inside in bins.values():
        ends = [0]
        for offset, length in sorted(inside):
            assert offset == ends[-1]
            ends.append(offset + length)
        assert ends[-1] <= 1024
    assert len(bins) <= -(-sum(map(len, ids.values())) // 1024) + 2


def test_plan_keeps_every_capacity():
    random.seed(1)
    counts = {length: random.randint(1, 400) for length in random.sample(range(1, 100), 60)}
    plan = packing_plan(counts, tokens=100, documents=5, attention=9900)
    bins: dict[int, list] = {}
    for length, lo, hi, each, first, used in plan:
        for k in range(hi - lo):
            bins.setdefault(first + k // each, []).append((used + k % each * length, length))
        assert (hi - lo) % each == 0
    assert Counter(n for b in bins.values() for _, n in b) == counts | {k: v for k, v in counts.items() if v}
    for inside in bins.values():
        assert sum(n for _, n in inside) <= 100 and len(inside) <= 5
        assert sum(n * n for _, n in inside) <= 9900
        at = 0
        for offset, n in sorted(inside):
            assert offset == at
            at += n


def test_tree_query(spark, texts):
    tokens = {d: [*WORD.findall(t.encode().translate(LOWER)), None] for d, t in texts.items()}
    counts = Counter(x for d, own in tokens.items() if crc(d) % 7 != 2 for x in own)
    n, v = sum(counts.values()), len(counts)
    got = QUERIES["op1_suffix_tree_lm"](spark, SF).collect()
    assert len(got) == len(texts)
    held = [0.0, 0.0]
    for r in got:
        own = tokens[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(own), sum(counts[x] > 0 for x in own), n)
        assert math.isclose(r["base_score"], sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in own), rel_tol=1e-9)
        assert r["held_out"] == (crc(r["doc_id"]) % 7 == 2)
        held[0] += r["base_score"] * r["held_out"]
        held[1] += r["score"] * r["held_out"]
    assert held[1] > held[0]


def test_tree_is_a_distribution():
    """Over all known tokens and one unknown, each context's probabilities sum to one."""
    import pyarrow as pa

    random.seed(2)
    words = [np.uint64(x) for x in random.sample(range(1 << 60), 30)]
    stream = np.array([random.choice(words[: random.choice([3, 30])]) for _ in range(4000)], np.uint64)
    tree = Tree(buckets=1, total=len(stream), types=len(set(stream.tolist())), words=np.sort(np.array(words[:2], np.uint64)))
    one, two = tree.contexts(stream, np.zeros(len(stream), np.int64))
    pairs = Counter((int(t), int(c)) for side in (one, two) for t, c in zip(stream, side) if c)
    found = sorted({c for _, c in pairs})
    tree.kept = np.array(found)
    tree.seen = np.array([sum(n for (_, c), n in pairs.items() if c == f) for f in found])
    tree.kinds = np.array([sum(c == f for _, c in pairs) for f in found])

    def table(rows):
        tokens, contexts, counts = (np.array(x) for x in zip(*rows))
        return pa.table({"tokens": [tokens.astype(np.uint64).tobytes()], "contexts": [contexts.astype(np.uint32).tobytes()], "counts": [counts.astype(np.int64).tobytes()]})

    shelf = Shelf(tree, table([(t, 0, n) for t, n in Counter(stream.tolist()).items()]), table([(t, c, n) for (t, c), n in pairs.items()]))
    every = np.array([*sorted(set(stream.tolist())), 5], np.uint64)
    for context in found:
        asked = np.full(len(every), context)
        p = shelf.probability(every, tree.suffix(asked), shelf.base(every)[1])
        assert math.isclose(shelf.probability(every, asked, p).sum(), 1, rel_tol=1e-9)


def test_lowest_rows_of_each_group(spark):
    """The first rows by key and tie as a plain sort has them, for large, small and equal keys."""
    from sheaf.llm import common as C

    random.seed(5)
    keys = [0.0, 1e-17, 0.25, *[random.random() for _ in range(3000)]]
    rows = [("hot", k, i) for i, k in enumerate(keys)] + [("few", 0.5, i) for i in range(7)] + [("same", 0.125, i) for i in range(400)]
    random.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, u double, id long")
    for most in (1, 5, 150, 5000):
        got = {(r["g"], r["n"]): r["id"] for r in C.lowest(df, "g", "u", ["id"], most, "n").collect()}
        want = {}
        for g in ("hot", "few", "same"):
            own = sorted((u, i) for x, u, i in rows if x == g)
            want |= {(g, n + 1): i for n, (_, i) in enumerate(own[:most])}
        assert got == want
    assert C.lowest(df.limit(0), "g", "u", ["id"], 3, "n").count() == 0


def test_language_query(spark):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = QUERIES["op6_ppm_language"](spark, SF).collect()
    assert len(got) == len(truth)
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (crc(r["doc_id"]) % 4 == 2) and 0 <= r["score"] <= 1 for r in got)
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held)


def test_partial_matching_sums_to_one():
    data = b"abracadabra abracadabra"
    codes = [sum(data[i - k] << (8 * k) for k in range(4) if i >= k) for i in range(len(data))]
    model = Model(["x"], [np.array(codes)], [np.ones(len(codes))])
    rows = np.exp2(model.rows[:, :, 0].astype(float))
    spare = 256 - (model.size - 1)  # the last code stands for every byte that was never seen
    assert np.allclose(rows[:, :-1].sum(axis=1) + spare * rows[:, -1], 1, atol=1e-5)


def test_quality_query(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    got = QUERIES["op3_compression_quality"](spark, "/root/testdata/sf0.1").collect()
    held = [r for r in got if r["held_out"] and r["doc_id"] in labels]
    assert len(got) == 10_000 and all(r["held_out"] == (crc(r["doc_id"]) % 3 == 1) for r in got)
    for label in (0, 1):
        own = [r for r in held if labels[r["doc_id"]] == label]
        assert sum(r["predicted"] == label for r in own) >= (0.85, 0.97)[label] * len(own)


def test_shuffle_query(spark, texts):
    got = QUERIES["op9_hypergeometric_shuffle"](spark, SF).collect()
    sizes = Counter(r["shard"] for r in got)
    assert len(got) == len(texts) and max(sizes.values()) - min(sizes.values()) <= 1 and set(sizes) == set(range(8))
    assert sorted((r["shard"], r["slot"]) for r in got) == [(s, k) for s in range(8) for k in range(sizes[s])]
    assert all((r["size"], r["text_crc32"]) == (len(texts[r["doc_id"]].encode()) + 1, zlib.crc32(texts[r["doc_id"]].encode())) for r in got)


def test_matrix_has_the_law():
    counts = np.array([7, 0, 30, 13])
    drawn = [hypergeometric_shuffle.communication_matrix(counts, 3, f"seed {k}") for k in range(4000)]
    assert all((m.sum(axis=1) == counts).all() and (m.sum(axis=0) == [17, 17, 16]).all() for m in drawn)
    first = np.array([m[2, 0] for m in drawn])
    mean, spread = 30 * 17 / 50, 30 * 17 * 33 * 20 / (50 * 50 * 49)
    assert abs(first.mean() - mean) < 5 * math.sqrt(spread / 4000) and abs(first.var() / spread - 1) < 0.15
    draw = np.random.default_rng(4)
    large = np.array([hypergeometric_shuffle.hypergeometric(draw, 10**9, 7 * 10**9, 20_000) for _ in range(2000)])
    assert abs(large.mean() - 2500) < 5 * math.sqrt(2500 * 7 / 8 / 2000) and abs(large.var() / (2500 * 7 / 8) - 1) < 0.2


def test_sketch_estimates_similarity():
    """Coordinates fill for any set, and agree as often as the sets are similar."""
    random.seed(7)
    pool = common.mix(np.arange(3000, dtype=np.uint64))
    for size, shared in ((1, 1), (5, 3), (100, 60), (700, 525), (1000, 100)):
        a, b = pool[:size], pool[size - shared : 2 * size - shared]
        got = similarity_sketch.sketch(np.concatenate([a, b]), np.repeat([0, 1], size), 2)
        assert (got != similarity_sketch.EMPTY).all()
        true = shared / (2 * size - shared)
        assert abs((got[0] == got[1]).mean() - true) < 5 * math.sqrt(0.25 / similarity_sketch.SIZE)


def test_similarity_finds_every_link(spark):
    """Chains of edits with pairs just above and below the threshold."""
    random.seed(11)
    rows, texts = [], []
    for g in range(60):
        base = [f"w{random.randint(0, 99999)}" for _ in range(random.randint(20, 120))]
        for _ in range(5):
            texts.append(list(base))
            for _ in range(random.randint(1, 4)):
                base[random.randrange(len(base))] = f"w{random.randint(0, 99999)}"
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    parent = list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                parent[b] = a
    got = {r["doc_id"]: r["component_id"] for r in similarity_sketch.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: top(i) for i in range(len(rows))}


def test_vector_recall(spark):
    """Pairs around the threshold, and a group larger than a block."""
    draw = np.random.default_rng(8)
    one = draw.standard_normal((300, 16))
    near = one + draw.standard_normal((300, 16)) * 0.3
    crowd = draw.standard_normal(16) + draw.standard_normal((1200, 16)) * 0.15
    vectors = np.concatenate([one, near, crowd]).astype(np.float32)
    unit = vectors.astype(float) / np.linalg.norm(vectors.astype(float), axis=1, keepdims=True)
    want = (unit @ unit.T >= 0.95).sum(axis=1) - 1
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    got = {r["vec_id"]: r["n_links"] for r in collision_counting.near_vectors(table).collect()}
    found = np.array([got[i] for i in range(len(vectors))])
    assert (found <= want).all() and found.sum() >= 0.999 * want.sum()


def test_pipeline(spark, texts):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        seen.append(common.stash(stage(spark, seen[-1], SF), "stage"))
    assert all(s.columns == docs.columns for s in seen[:-1])
    kept = {r["doc_id"] for r in QUERIES["op4_line_frequency"](spark, SF).collect() if r["kept"]}
    assert {r["doc_id"] for r in seen[1].collect()} == kept
    alone = {r["doc_id"]: r["text"] for r in seen[2].collect()}
    assert set(alone) <= kept and seen[2].count() == len(alone)
    rest = {r["doc_id"]: r["text"] for r in seen[3].collect()}
    assert rest == {d: bytes(x for x, m in zip(b, mark) if not m).decode("utf-8", "ignore") for d, (b, mark) in removed(alone, corpus_pipeline.PASSAGE).items()}
    mixed = Counter(r["doc_id"] for r in seen[4].collect())
    assert mixed and set(mixed) <= set(rest) and max(mixed.values()) <= 3
    tokenizer = Tokenizer.from_file(tokenizer_path())
    ids = {d: len(tokenizer.encode(rest[d], add_special_tokens=False).ids) + 1 for d in mixed}
    packed = Counter()
    for r in seen[5].collect():
        packed[r["doc_id"]] += r["length"]
    assert packed == {d: ids[d] * n for d, n in mixed.items()}


def test_passages_leave_the_texts(spark):
    """Passages of 51 to 60 words in two or three otherwise different documents."""
    random.seed(17)
    letters = "etaoinshrdlu"
    word = lambda: "".join(random.choice(letters) for _ in range(random.choice((4, 5, 5, 6, 6, 7, 8))))
    prose = lambda n: " ".join(word() for _ in range(n))
    rows, planted = [], {}
    for p in range(40):
        passage = prose(51 + p % 10)
        for _ in range(2 + p % 2):
            planted[len(rows)] = passage
            rows.append((len(rows), f"{prose(random.randint(20, 300))} {passage} {prose(random.randint(20, 300))}", "s", 1))
    rows += [(len(rows) + k, prose(400), "s", 1) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.repeated_passages(spark, docs, SF).collect()}
    assert len(got) == len(rows)
    # A cut may end a few bytes beyond the passage where texts go on alike by chance.
    assert all(planted[d] not in got[d] and len(rows[d][1]) - len(got[d]) - len(planted[d]) in range(6) for d in planted)
    assert all(got[d] == rows[d][1] for d in got if d not in planted)


def test_frequent_lines_leave_the_texts(spark):
    """Lines above the limit are gone after the stage, whatever their place, case and
    spaces; lines of another or a smaller host stay, and a depleted document does not."""
    random.seed(13)
    own = lambda n: " ".join(f"w{random.randint(0, 10**9)}" for _ in range(n))
    rows = []
    for i in range(150):
        lines = [own(12), "", own(3)]
        lines.insert(i % 4, ("Share this  page", "share\tthis page ", "SHARE THIS PAGE")[i % 3])
        rows += [(len(rows), "\n".join(lines), None if i % 2 else "large", 1)]
        rows += [(len(rows), "\n".join(lines) + " x", "large" if i % 2 else None, 1)]
    rows += [(len(rows), "share this page\n" * 20 + own(10), "large", 1), (len(rows) + 1, "share this page\n" + own(10) + "\n", "small", 1)]
    first = len(rows)
    menus = [f"menu {own(2)}" for _ in range(5)]
    for i in range(40):  # a small host: lines in 8 documents go, one in 5 stays
        lines = [own(14), *(menus[i % 5 : i % 5 + 1]), *(["a rare line"] if i < 5 else [])]
        rows.append((len(rows), "\n".join(lines), "village", 1))
    rows.append((len(rows), "\n".join([*menus, own(3)]), "village", 1))  # nothing but menus
    norm = lambda line: line.lower().split()
    held = Counter((r[2], " ".join(line)) for r in rows for line in {tuple(norm(x)) for x in r[1].split("\n")} if line)
    hosts = Counter(r[2] for r in rows)
    want = {}
    for d, text, host, _ in rows:
        lines = text.split("\n")
        gone = [x for x in lines if norm(x) and held[host, " ".join(norm(x))] > max(line_frequency.MIN_DOCS, 0.02 * hosts[host])]
        n, lost = len(text.split()), sum(len(norm(x)) for x in gone)
        if n - lost >= 0.3 * n:
            want[d] = "\n".join(x for x in lines if x not in gone)
    got = corpus_pipeline.quality_rules(spark, spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long"), SF)
    assert got.columns == ["doc_id", "text", "source", "n_chars"]
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in got.collect()} == {d: (t, len(t)) for d, t in want.items()}
    assert first == 302 and sum(want[d] != rows[d][1] for d in want) > 140 and want[301] == rows[301][1]
    assert 300 not in want and rows[-1][0] not in want and "a rare line" in want[first] and "menu" not in want[first]
