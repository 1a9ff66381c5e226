"""Registry order and summaries against small brute-force versions."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from sheaf.operators import quality as Q
from sheaf.operators.registry import registry_order

LISTED = "registry string, id long, pos long"


def rising(values):
    """Length of a longest rising subsequence, by comparing all pairs."""
    best = []
    for i, v in enumerate(values):
        best.append(1 + max((best[j] for j in range(i) if values[j] < v), default=0))
    return max(best, default=0)


def shuffled_nearby(n, seed):
    """0..n-1 with about a tenth moved by a few places."""
    rng = random.Random(seed)
    key = {i: i + (rng.choice([-7, -3, 4, 9]) + rng.random() / 2 if rng.random() < 0.1 else 0) for i in range(n)}
    return sorted(range(n), key=key.get)


def test_fewest_moved_in_each_registry(spark):
    rng = random.Random(3)
    orders = {
        None: list(range(12)),
        "one": [0],
        "back": list(range(9, -1, -1)),
        "far": [*range(1, 40), 0],
        "mixed": rng.sample(range(60), 60),
        "hot": shuffled_nearby(1500, 5),
    }
    expected = spark.createDataFrame([(g, i, 3 * i) for g, ids in orders.items() for i in ids], LISTED)
    actual = spark.createDataFrame([(g, i, 5 * at) for g, ids in orders.items() for at, i in enumerate(ids)], LISTED)
    none = spark.createDataFrame([], "registry string, id long")
    moved = {g: set() for g in orders}
    for r in registry_order(expected, actual, none, block=64).collect():
        assert r["problem"] == "moved"
        assert r["id"] not in moved[r["registry"]]
        moved[r["registry"]].add(r["id"])
    for g, ids in orders.items():
        left = [i for i in ids if i not in moved[g]]
        assert left == sorted(left)
        assert len(left) == rising(ids), g


def test_missing_unexpected_repeated_retired(spark):
    expected = spark.createDataFrame([("a", i, i) for i in range(6)] + [("a", None, 9), ("b", 1, 1), (None, 7, 1)], LISTED)
    actual = spark.createDataFrame(
        [("a", 0, 0), ("a", 2, 1), ("a", 1, 2), ("a", 3, 3), ("a", 3, 8), ("a", 5, 5), ("a", 99, 6), ("a", 50, 7), ("a", 4, None), ("c", 1, 1)], LISTED
    )
    retired = spark.createDataFrame([("a", 50), ("a", 51), ("a", 5), ("a", 50), ("b", 50)], "registry string, id long")
    found = {(r["registry"], r["id"], r["problem"]) for r in registry_order(expected, actual, retired).collect()}
    moved = {f for f in found if f[2] == "moved"}
    assert len(moved) == 1 and moved <= {("a", 1, "moved"), ("a", 2, "moved")}
    assert found - moved == {
        ("a", 4, "missing"), ("b", 1, "missing"), (None, 7, "missing"), ("a", 3, "repeated"),
        ("a", 99, "unexpected"), ("c", 1, "unexpected"), ("a", 50, "retired"), ("a", 5, "retired"),
    }
    empty = spark.createDataFrame([], LISTED)
    assert registry_order(empty, empty, retired).count() == 0


ITEMS = "doc long, scene long, ord long, item_kind string, text string, table_rows long"


@pytest.fixture(scope="module")
def summaries(spark):
    rows = [(1, 1, i, "text", f"t{i}" if i % 2 else "", None) for i in range(20)]
    rows += [(1, 2, 100 + i, "cell", f"c{i}" if i else "", None) for i in range(30)]
    rows += [(1, 2, 200 + i, "note", f"n{i}" if i else "", None) for i in range(9)]
    rows += [(1, 3, 300 + i, "table", None, 4 if i < 3 else 7) for i in range(4)] + [(1, 3, 310, "chart", None, None)]
    rows += [(2, 1, 1, "table", None, None), (3, 1, 1, "image", None, None)]
    return Q.doc_summary(spark.createDataFrame(rows, ITEMS))


def test_summary_quotes_the_first_of_each_kind(summaries):
    out = {r["doc"]: r for r in summaries.collect()}
    notes = ["", *[f"n{i}" for i in range(1, 6)]]
    want = [f"t{i}" for i in range(1, 12, 2)] + [f"c{i}" for i in range(1, 13)] + notes
    assert out[1]["text_corpus"].split("\n") == want and out[1]["note_text"].split("\n") == notes
    assert out[1]["table_rows"] == {4: 3, 7: 1} and out[1]["table_row_counts"] == [4, 7]
    assert (out[1]["notes"], out[1]["text_blocks"], out[1]["tables"], out[1]["scenes"]) == (9, 20, 4, 3)
    assert out[2]["table_rows"] == {} and out[2]["tables"] == 1 and out[3]["text_corpus"] == "" == out[3]["note_text"]


def test_every_rule_can_break_and_hold(spark, summaries):
    broken = dict(scenes=2, min_scenes=4, min_text_blocks=21, tables=3, min_tables=5, table_rows=[4, 5], shapes=1, charts=2, images=1,
                  notes=10, text="t12", note_text="n6", cached_value="c13")
    held = dict(scenes=3, min_scenes=3, min_text_blocks=20, tables=4, min_tables=4, table_rows=[7, 4], shapes=0, charts=1, images=0,
                notes=9, text="t11", note_text="n5", cached_value="c12")
    kinds = {k: "array<long>" if k == "table_rows" else "string" if isinstance(v, str) else "long" for k, v in broken.items()}
    schema = "doc long, " + ", ".join(f"{k} {t}" for k, t in kinds.items())
    for wanted, failures in ((broken, list(broken)), (held, [])):
        asked = spark.createDataFrame([(1, *wanted.values())], schema)
        assert Q.expectation_check(summaries, asked).first()["failures"] == failures
    one = spark.createDataFrame([(1, 5), (2, None), (9, 4)], "doc long, table_rows long")
    out = {r["doc"]: r["failures"] for r in Q.expectation_check(summaries, one).collect()}
    assert out == {1: ["table_rows"], 2: [], 9: ["no-summary"]}


def test_rules_reached_by_the_registered_query(spark):
    import __spark_entry__ as entry

    failures = entry.queries()["expectation_check"](spark, "/root/testdata/sf0.01").select(F.explode(F.split("failures", ",")).alias("f"))
    assert {r["f"] for r in failures.distinct().collect()} - {""} == {
        "scenes", "min_scenes", "min_text_blocks", "tables", "min_tables", "table_rows", "shapes", "charts", "images", "notes", "text",
        "note_text", "cached_value",
    }
