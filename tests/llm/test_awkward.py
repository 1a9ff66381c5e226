"""Nulls in any column, empty and long texts, ties, repeated rows, empty tables, and
extra columns with clashing names: the defined result of each operator."""

from __future__ import annotations

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sheaf.llm.best_fit_packing import pack, pieces
from sheaf.llm.collision_counting import near_vectors
from sheaf.llm.compression_quality import classify
from sheaf.llm.compression_quality import train as train_quality
from sheaf.llm.hypergeometric_shuffle import shuffle_into
from sheaf.llm.line_frequency import line_frequency
from sheaf.llm.ppm_language import identify
from sheaf.llm.ppm_language import train as train_language
from sheaf.llm.queries import tokenizer_path
from sheaf.llm.similarity_sketch import keep_first, near_duplicates
from sheaf.llm.suffix_dedup import remove_repeats
from sheaf.llm.suffix_tree_lm import score
from sheaf.llm.suffix_tree_lm import train as train_tree
from sheaf.llm.weighted_mixing import mix, mixed_rows

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, node long, label string, k_0 string, shard int"
PROSE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen"
LONG = " ".join(f"word{i * 7919 % 100_003}" for i in range(40_000))
ROWS = [
    (1, PROSE, "en", "a", 5),
    (2, PROSE, "en", "a", 5),
    (2, PROSE, "en", "a", 5),  # a row repeated in full
    (3, PROSE + " end", None, None, None),
    (None, PROSE, "en", None, None),
    (None, None, None, None, None),
    (4, None, "en", "b", None),
    (5, "", "en", "b", 0),
    (6, " \t\n\r\x0b\x0c ", "en", "b", 7),
    (7, "Ünïcödé ß 漢字 😀 é", "de", "b", 9),
    (8, "a b c", "de", "b", 5),
    (9, "x", "de", "c", 1),
    (10, "12 34 | $$ %%", "de", "c", 2),
    (11, LONG, "en", "c", len(LONG)),
    (12, "one two three four", "fr", "c", 4),
    (13, "ONE TWO three four", "fr", "c", 4),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "old", 7, "old", "old", 99) for r in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.limit(0)


def test_line_frequency(docs, nothing):
    got = line_frequency(docs).collect()
    assert len(got) == len(ROWS)
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert by[1]["n_words"] == 17 and by[1]["kept"] and not by[1]["base_failed"]
    assert (by[4]["n_words"], by[5]["n_words"], by[6]["n_words"]) == (0, 0, 0) and by[4]["base_failed"]
    assert by[7]["word_chars"] == 7 + 1 + 2 + 1 + 2 and by[8]["n_words"] == 2
    assert by[10]["n_symbols"] == 5
    assert line_frequency(nothing).count() == 0


def test_similarity(docs, nothing):
    got = near_duplicates(docs).collect()
    assert len(got) == len(ROWS)
    of = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert [of[i]["component_id"] for i in (1, 2, 3)] == [1, 1, 1]
    assert of[12]["component_id"] == of[13]["component_id"] == 12 and of[12]["n_shingles"] == 1
    assert of[4]["n_shingles"] == of[5]["n_shingles"] == of[6]["n_shingles"] == 0
    assert [of[i]["component_id"] for i in (4, 5, 6)] == [4, 5, 6]
    assert of[11]["n_shingles"] == len({tuple(LONG.split()[i : i + 5]) for i in range(39_996)})
    left = keep_first(docs)
    assert left.columns == docs.columns
    assert Counter(r["doc_id"] for r in left.collect()) == Counter({1: 1, None: 1, 4: 1, 5: 1, 6: 1, 7: 1, 8: 1, 9: 1, 10: 1, 11: 1, 12: 1})
    assert near_duplicates(nothing).count() == keep_first(nothing).count() == 0


def test_near_texts_with_null_or_shared_ids(spark):
    """One of each group stays, whatever the ids are; texts without words all stay."""
    words = [f"w{i}" for i in range(60)]
    near = [" ".join([*words, f"end{k}"]) for k in range(3)]
    rows = [(None, t) for t in near] + [(7, t + " more") for t in near] + [(8, "alone in the world with some words")] * 2 + [(None, None)] * 2 + [(9, "")] * 2
    left = keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r["doc_id"], (r["text"] or "")[:2]) for r in left) == Counter({(7, "w0"): 1, (8, "al"): 1, (None, ""): 2, (9, ""): 2})


def test_suffix(docs, nothing):
    twice = docs.where("doc_id = 11").withColumn("doc_id", F.lit(None).cast("long"))
    got = remove_repeats(docs.unionByName(twice), length=64).collect()
    assert len(got) == len(ROWS) + 1
    for r in got:
        if r["n_bytes"] == len(LONG):
            assert r["rest"] == b"" and [tuple(s) for s in r["spans"]] == [(0, len(LONG))]
        elif r["doc_id"] in (1, 2):
            assert r["rest"] == b""
        elif r["doc_id"] == 3:
            assert bytes(r["rest"]) == b" end"
        elif r["doc_id"] in (4, 5):
            assert r["n_bytes"] == 0 and r["rest"] == b"" and r["spans"] == []
    assert remove_repeats(nothing).count() == 0


def test_mixing(docs, nothing):
    got = mix(docs).collect()
    assert len(got) == len(ROWS)
    sizes = {r["source_size"]: r["target"] for r in got}
    assert abs(sum(sizes.values()) - sum(sizes)) < 1e-6 * sum(sizes)  # every source has a size of its own here
    assert all(0 <= r["times"] <= 3 and r["taken"] == r["size"] * r["times"] for r in got)
    rows = mixed_rows(docs)
    assert rows.columns == docs.columns
    assert rows.count() == sum(r["times"] for r in got)
    assert mix(nothing).count() == mixed_rows(nothing).count() == 0


def test_packing(docs, nothing):
    got = pack(pieces(docs, tokenizer_path()), ["doc_id", "piece", "ids_crc32"]).collect()
    bins: dict[int, list] = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for inside in bins.values():
        at = 0
        for offset, length in sorted(inside):
            assert offset == at
            at += length
        assert at <= 1024
    assert sum(r["piece"] == 0 for r in got) == len(ROWS)
    assert [r["length"] for r in got if r["doc_id"] in (4, 5)] == [1, 1]
    assert pack(pieces(nothing, tokenizer_path()), ["doc_id"]).count() == 0


def test_shuffle(docs, nothing):
    got = shuffle_into(docs.select("doc_id", "text", "shard"), 3, ["doc_id", "text"]).collect()
    sizes = Counter(r["shard"] for r in got)
    assert sorted(sizes.values()) == [5, 5, 6]
    assert sorted((r["shard"], r["slot"]) for r in got) == [(s, k) for s in sorted(sizes) for k in range(sizes[s])]
    assert shuffle_into(nothing.select("doc_id"), 8, ["doc_id"]).count() == 0


def test_language(docs, nothing):
    model = train_language(docs)
    got = {r["doc_id"]: r for r in identify(docs, model).collect()}
    assert got[1]["lang_pred"] == "en" and got[7]["lang_pred"] == "de"
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (4, 5, 6, 10))
    assert identify(nothing, model).count() == 0
    assert train_language(nothing) is None
    assert {r["lang_pred"] for r in identify(docs, None).collect()} == {"und"}


def test_quality(spark, docs, nothing):
    labels = spark.createDataFrame([(1, 1), (2, 1), (9, 0), (10, 0), (None, 1), (3, None), (7, 5), (11, 1)], "doc_id long, quality int")
    for learned in (docs, nothing):
        got = classify(docs, train_quality(learned, labels)).collect()
        assert len(got) == len(ROWS)
        assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert classify(nothing, train_quality(docs, labels)).count() == 0


def test_tree(docs, nothing):
    for learned in (docs, nothing):
        tree, counts = train_tree(learned)
        got = score(docs, tree, counts).collect()
        assert len(got) == len(ROWS)
        of = {r["doc_id"]: r for r in got}
        assert of[4]["n_tokens"] == of[5]["n_tokens"] == of[6]["n_tokens"] == 1 and of[12]["n_tokens"] == 5
        assert of[1]["n_known"] == (18 if learned is docs else 0)
        assert all(r["score"] <= 0 and r["base_score"] <= 0 for r in got)
    assert score(nothing, *train_tree(docs)).count() == 0


def test_vectors(spark):
    one, near = [1.0, 0.0, 0.0], [1.0, 0.1, 0.0]
    vectors = [one, one, near, [5.0, 0.0, 0.0], [0.0, 1.0, 0.0], None, [], [0.0, 0.0, 0.0], [float("nan"), 1.0, 0.0], [float("inf"), 1.0, 0.0], [None, 1.0, 1.0], [1.0, 0.0], [-1.0, 0.0, 0.0]]
    rows = [(i if i != 3 else None, v, "old", 1) for i, v in enumerate(vectors)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, kept string, node int")
    got = {r["vec_id"]: r for r in near_vectors(table).collect()}
    assert [got[i]["n_links"] for i in (0, 1, 2, None)] == [3, 3, 3, 3]
    assert [got[i]["component_id"] for i in (0, 1, 2, None)] == [0, 0, 0, 0]
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in (4, 5, 6, 7, 8, 9, 10, 11, 12))
    assert near_vectors(table.limit(0)).count() == 0


def test_kept_rest_is_whole_text(docs):
    rest = {r["doc_id"]: r for r in remove_repeats(docs).collect() if r["doc_id"] == 11}
    assert hashlib.sha256(rest[11]["rest"]).digest() == hashlib.sha256(LONG.encode()).digest()
