"""Token counts, periodic runs and conversation repair against brute force, and their
defined cases: nulls, empty and long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from functools import lru_cache

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sheaf.llm import conversation_repair, periodic_runs, token_counts
from sheaf.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("word_bpe_49k.json")
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


# Token counts ----------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    own = Tokenizer.from_file(PATH)
    return lambda text: len(own.encode(text or "", add_special_tokens=False).ids)


def awkward_text(draw: random.Random, n: int) -> str:
    """Spaces of all kinds, marks, digits, contractions, special strings, long runs."""
    parts = [" ", "\n", "\t", "\x0b", " ", " ", "\x85", "\x1c", "é", "́", "İ", "Σ", "ß", "漢字", "。", "가", "가", "12", "'s", "'", "!'ll", "...", "<|endoftext|>", "<|startoftext|>", "<|end", "oftext|>", "word", "Wörter", "x", "😀", "̸", "=", "don't", "ﬁ"]
    return "".join(draw.choice(parts) * draw.choice((1, 1, 1, 3)) for _ in range(n))


def test_tokens_query(spark, texts, library):
    got = {r["doc_id"]: r for r in QUERIES["op11_overlap_tokens"](spark, SF).collect()}
    assert len(got) == len(texts)
    for d, t in texts.items():
        n = library(t)
        assert (got[d]["n_bytes"], got[d]["n_tokens"], got[d]["over_limit"]) == (len(t.encode()), n, n > 2048)


def test_tokens_of_huge_and_awkward_texts(spark, library):
    """Chunks down to the smallest: texts that splice, that must widen, and that are one word."""
    draw = random.Random(5)
    rows = [(i, awkward_text(draw, n), "old", 9) for i, n in enumerate([0, 1, 3, 40, 200, 700, 2000, 2000, 5000] * 3)]
    rows += [(100, "a" * 3000, "old", 1), (101, "ab1" * 2000, "old", 1), (102, "漢字" * 900 + "。" + "字" * 900, "old", 1), (103, "é" * 1500, "old", 1)]
    rows += [(104, "<|endoftext|>" * 300, "old", 1), (105, None, None, None), (None, None, "old", 1), (None, "one two", "old", 1), (106, "!" * 2500 + "'s" * 300, "old", 1)]
    rows += [rows[5], rows[5]]
    table = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, k_0 int")
    for chunk, overlap in ((200, 64),):
        got = token_counts.token_counts(table, PATH, chunk=chunk, overlap=overlap).collect()
        want = sorted((str(d), len((t or "").encode()), library(t), library(t) > 2048) for d, t, *_ in rows)
        assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got) == want
    assert token_counts.token_counts(table.limit(0), PATH).count() == 0


def test_stable_places_are_starts(library):
    """A text splits at a stable place into two that have as many tokens together."""
    draw, seen = random.Random(9), 0
    for _ in range(300):
        text = awkward_text(draw, 12)
        special = {k for m in re.finditer(r"<\|(?:start|end)oftext\|>", text) for k in range(m.start() + 1, m.end())}
        for at in range(1, len(text)):
            if at not in special and token_counts.stable(text, at):
                seen += 1
                assert library(text[:at]) + library(text[at:]) == library(text), (text, at)
    assert seen > 500


# Periodic runs -----------------------------------------------------------------------


def runs_by_definition(words: list) -> list[tuple[int, int, int]]:
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = q
        while i < n:
            if words[i] != words[i - q]:
                i += 1
                continue
            begin = i
            while i < n and words[i] == words[i - q]:
                i += 1
            start, length = begin - q, i - begin + q
            part = words[start : start + length]
            smallest = not any(part[p:] == part[:-p] for p in range(1, q))
            if length >= max(6, 4 * q) and smallest:
                out.append((start, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_by_definition():
    draw = random.Random(3)
    for _ in range(600):
        words: list = []
        for _ in range(draw.randint(0, 6)):
            unit = [draw.randint(0, draw.choice((1, 2, 40))) for _ in range(draw.randint(1, 9))]
            words += unit * draw.randint(1, 7)
            words = words[: -draw.randint(1, 3)] if draw.random() < 0.3 else words
            if draw.random() < 0.15:
                words = words * 4
        words = words[:400]
        assert periodic_runs.runs_of(np.array(words, np.uint64)) == runs_by_definition(words)


def test_runs_of_hot_texts_are_few_steps():
    """One word a hundred thousand times, and long powers: one diagonal a band."""
    n = 100_000
    assert periodic_runs.runs_of(np.zeros(n, np.uint64)) == [(0, n, 1)]
    unit = np.arange(7000, dtype=np.uint64)
    assert periodic_runs.runs_of(np.tile(unit, 5)) == [(0, 35_000, 7000)]
    nine = np.tile(np.array([1] * 9 + [2], np.uint64), 6000)
    # The last nine words hold no other end, so the power ends with the whole text.
    assert periodic_runs.runs_of(nine)[:2] == [(0, 60_000, 10), (0, 9, 1)] or (0, 60_000, 10) in periodic_runs.runs_of(nine)


def expected_runs(doc_id, text: str) -> tuple:
    words = WORD.findall(text.encode())
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = runs_by_definition(words)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    top = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return len(runs), *(top or (None,) * 3), top and 1000 * top[1] // top[2], hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()


FIELDS = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def test_runs_query(spark, texts):
    short = {d: t for d, t in texts.items() if len(t.split()) < 1500}
    got = {r["doc_id"]: tuple(r[f] for f in FIELDS) for r in QUERIES["op12_periodic_runs"](spark, SF).collect()}
    assert len(got) == len(texts)
    assert {d: got[d] for d in short} == {d: expected_runs(d, t) for d, t in short.items()}
    assert sum(g[0] > 0 for g in got.values()) > 5


def test_runs_of_awkward_rows(spark):
    rows = [(1, "a a a a a a b", "x"), (1, "a a a a a a b", "x"), (None, None, None), (None, "é é é é é é", "x"), (2, "", "x"), (3, " \n\t", "x"), (4, "ü b " * 5000, "x"), (5, "w", None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    got = periodic_runs.periodic_runs(table)
    assert got.columns == ["doc_id", "n_words", "runs", "collapsed"]
    want = [(d, len((t or "").split()), runs_by_definition((t or "").split()) if d != 4 else [(0, 10_000, 2)], {1: "a b", None: "é" if t else "", 4: "ü b", 5: "w"}.get(d, "")) for d, t, _ in rows]
    assert sorted(map(str, ((r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in got.collect()))) == sorted(map(str, want))
    assert periodic_runs.periodic_runs(table.limit(0)).count() == 0
    with pytest.raises(ValueError):
        periodic_runs.periodic_runs(table, fewest=12)


# Conversation repair -------------------------------------------------------------------

SHAPE = re.compile(r"(s?(ua)+)?")


def best_by_trying(turns: str) -> tuple[int, str]:
    """Every sequence of edits with up to two inserts at each place."""
    found = []
    each = []
    for t in turns:
        ways = [("D", "", 3)]
        if t != "x":
            ways += [("K", t.lower(), int(t.isupper()))] + [("R", r, 2 + t.isupper()) for r in "ua"]
        each.append(ways)
    gaps = ["", "u", "a", "ua", "au", "uu", "aa"]
    for ways in itertools.product(*each):
        for inserts in itertools.product(gaps, repeat=len(turns) + 1):
            roles = "".join(g + w[1] for g, w in zip(inserts, (*ways, ("", "", 0))))
            if SHAPE.fullmatch(roles):
                audit = "".join("I" * len(g) + w[0] for g, w in zip(inserts, (*ways, ("", "", 0))))
                found.append((sum(2 * len(g) for g in inserts) + sum(w[2] for w in ways), audit))
    return min(found)


def test_least_by_trying_all():
    for n in range(4):
        for turns in itertools.product("suaUAox", repeat=n):
            code = "".join(turns)
            cost, audit = conversation_repair.least(code, conversation_repair.END)[0]
            role = conversation_repair.replay(code, audit, 0)
            audit += "I" * (conversation_repair.END[role] // 2)
            assert (cost, audit) == best_by_trying(code), code


def repaired(rows: list[tuple]) -> tuple:
    """Expected row of one conversation's (turn, role, text) after damage, in order."""
    seen, codes, count = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in rows:
        last = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)[-1:]
        fault = "blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else None
        seen.add((role, text))
        if fault:
            count[fault] += 1
        codes.append((role[:1], fault))

    step = {"": "u", "s": "u", "u": "a", "a": "u"}

    @lru_cache(None)
    def ways(i: int, state: str, inserts: int) -> tuple:
        """(cost, audit, lines) by explicit strings."""
        out = []
        if i == len(rows):
            if state in ("", "a"):
                out.append((0, "", ()))
        else:
            role, fault = codes[i]
            rest = ways(i + 1, state, 0)
            out.append((rest[0] + 3, "D" + rest[1], rest[2]))
            if fault not in ("blank", "duplicate"):
                extra = int(fault == "truncated")
                if step[state] == role or (state == "" and role == "s"):
                    rest = ways(i + 1, role, 0)
                    out.append((rest[0] + extra, "K" + rest[1], (f"{rows[i][1]}:{rows[i][2]}", *rest[2])))
                rest = ways(i + 1, step[state], 0)
                name = {"u": "user", "a": "assistant"}[step[state]]
                out.append((rest[0] + 2 + extra, "R" + rest[1], (f"{name}:{rows[i][2]}", *rest[2])))
        if inserts < 2:
            rest = ways(i, step[state], inserts + 1)
            out.append((rest[0] + 2, "I" + rest[1], ({"u": "user:", "a": "assistant:"}[step[state]], *rest[2])))
        return min(out) if out else (10**9, "", ())

    cost, audit, lines = ways(0, "", 0)
    numbers = [t for t, *_ in rows if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    pairs = [a[0] + b[0] for a, b in zip(codes, codes[1:])]
    return gaps, count["blank"], count["duplicate"], count["truncated"], sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def expected_repairs(rows: list[tuple]) -> dict:
    out: dict = {}
    space = lambda x: " " if x is None else x
    for conv, turn, role, text in rows:
        own = out.setdefault(conv, [])
        kind = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20
        role, text = space(role), space(text)
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        own += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    order = lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())
    return {c: repaired(sorted(own, key=order)) for c, own in out.items()}


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


@pytest.mark.parametrize("size", ["sf0.01"])
def test_repair_query(spark, size):
    sf = f"/root/testdata/{size}"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in QUERIES["op13_conversation_repair"](spark, sf).collect()}
    assert got == expected_repairs(rows)


def test_repair_of_awkward_and_long_conversations(spark):
    """Nulls, ties, strange roles; conversations over many blocks, of any block size."""
    draw = random.Random(21)
    rows = []
    for turn in range(400):
        role = draw.choice(["user", "assistant", "assistant", "user", "system", "tool", None, ""])
        rows.append((7, draw.choice([turn, turn, None, 3]), role, draw.choice(["Yes.", f"No {turn}.", "cut", " \n", None, f"is it {turn}? \t", "é."])))
    rows += [(c, t, draw.choice(["user", "assistant"]), draw.choice([f"{t}.", "x"])) for c in (8, 9, None) for t in range(draw.randint(3, 70))]
    rows += [(10, None, None, None), (11, 0, "system", "Only."), (12, 5, "user", "Same."), (12, 5, "user", "Same."), (13, 0, "user", "")]
    table = spark.createDataFrame([(*r, "old", "old") for r in rows], "conv_id long, turn long, role string, text string, audit string, _conv string")
    want = expected_repairs(rows)
    for block in (3, 256):
        got = conversation_repair.report(table, conversation_repair.damaged(table), block=block).collect()
        assert {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in got} == want
    assert conversation_repair.report(table.limit(0), conversation_repair.damaged(table.limit(0))).count() == 0
    gone = [(c, t, "user", "x") for c in range(40) for t in (0,) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0]
    assert gone
    few = spark.createDataFrame(gone, "conv_id long, turn long, role string, text string")
    empty = hashlib.sha256(b"").hexdigest()
    assert {tuple(r)[1:] for r in conversation_repair.report(few, conversation_repair.damaged(few)).collect()} == {(0, 0, 0, 0, 0, 0, "", empty)}


def test_repaired_rows(spark):
    """The operator's own rows: roles alternate, deleted turns are named."""
    rows = [(1, 0, "assistant", "Hi."), (1, 1, "user", ""), (1, 2, "user", "And?"), (1, 3, "user", "So.")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    turns = conversation_repair.faults(conversation_repair.as_turns(table))
    done = conversation_repair.repair(turns).orderBy("_block", "_place").collect()
    left = [(r["role"], r["text"]) for r in done if r["edit"] != "D"]
    assert "".join(r["edit"] for r in done) == repaired([r[1:] for r in rows])[6]
    assert SHAPE.fullmatch("".join(r[0][0] for r in left)) and [r["turn"] for r in done if r["edit"] == "D"] == [1]
