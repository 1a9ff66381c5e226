"""Hot groups: the spread-out forms against plain Python."""

from __future__ import annotations

import math
import random
from collections import deque

from pyspark.sql import functions as F

from sheaf.operators import admission as A
from sheaf.operators import greedy as G
from sheaf.operators import ordering as O
from sheaf.operators import pages as P
from sheaf.operators import sheets as S
from sheaf.operators import textflow as T


def test_greedy_rounds_equal_the_fold(spark):
    rng = random.Random(7)
    rows, want = [], {}
    for group in range(6):
        sizes = [rng.randint(1, 60) for _ in range(400 if group < 2 else 12)]
        if group == 1:
            sizes = list(range(400, 0, -1))
        taken, left = [], 100
        for pos, size in enumerate(sizes):
            if len(taken) < 5 and size <= left:
                taken.append(pos)
                left -= size
        want[group] = taken
        rows += [(group, pos, size, 5, 100) for pos, size in enumerate(sizes)]
    df = spark.createDataFrame(rows, "g int, pos long, size long, max_count int, max_bytes long")
    for step in (2, 64):
        assert {r.g: r.taken for r in G.greedy_picks(df, "g", 5, step).collect()} == want


def test_greedy_on_one_huge_group(spark):
    """The rows of a group that no round needs are never brought together."""
    df = spark.range(1_000_000).select(
        F.lit(1).alias("g"), F.col("id").alias("pos"), (F.lit(30) - F.col("id") % 30).alias("size"), F.lit(5).alias("max_count"), F.lit(60).cast("long").alias("max_bytes")
    )
    taken, left = [], 60
    for pos in range(1_000):
        if len(taken) < 5 and 30 - pos % 30 <= left:
            taken.append(pos)
            left -= 30 - pos % 30
    assert [r.taken for r in G.greedy_picks(df, "g", 5).collect()] == [taken]


def test_admission_over_many_blocks(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for key in range(4):
        now, stamps = 0.0, deque()
        for i in range(70):
            now += rng.choice([0.0, 1.0, 5.0, 20.0, 61.0 if key else 2.0])
            while stamps and now - stamps[0] >= 60:
                stamps.popleft()
            ok = len(stamps) < 3
            if ok:
                stamps.append(now)
            want[(key, i)] = ok
            rows.append((key, i, now))
    df = spark.createDataFrame(rows, "key long, event_id long, s double").select(
        "key", "event_id", F.timestamp_micros((F.col("s") * 1_000_000).cast("long")).alias("ts")
    )
    for block_windows in (2, 64):
        out = A.rolling_admission(df, 3, 60.0, block_windows).collect()
        assert {(r.key, r.event_id): r.admitted for r in out} == want


def test_a_saturated_key_takes_few_rounds(spark):
    """Ten thousand blocks without a pause: a round per power of FAN, not one a block."""
    second, window, limit = 1_000_000, 60, 3
    times = [7 * i * second for i in range(172_000)]  # 9 events a window, 2 windows a block
    slim = spark.range(len(times)).select(F.lit(1).alias("key"), F.col("id").alias("event_id"), (F.col("id") * 7 * second).alias("t"))
    slim = slim.union(spark.createDataFrame([(2, 0, 5), (2, 1, 900 * second), (None, 2, 9)], "key int, event_id long, t long"))
    width, length = window * second, 2 * window * second
    slim = slim.withColumn("block", F.floor(F.col("t") / length).cast("long"))
    entries, rounds = A.entry_states(slim.where("key is not null"), limit, width, length)
    blocks = times[-1] // length + 1
    assert blocks > 10_000 and 1 <= rounds <= 1 + math.ceil(math.log(blocks, A.FAN))
    got = {r.block: r.entry for r in entries.collect() if r.key == 1}
    stamps: deque = deque()
    want, block = {}, 0
    for now in times:
        if now // length != block:
            block = now // length
            seen = [t for t in stamps if now - t < width]
            want |= {block: seen} if seen else {}
        A.admit_stamps(stamps, now, limit, width)
    assert got == want


def test_an_age_of_exactly_the_window_is_dropped():
    stamps = deque()
    assert [A.admit_stamps(stamps, t, 2, 60) for t in (0, 20, 40, 60, 80, 100, 120, 140)] == [
        True, True, False, True, True, False, True, True,
    ]


def test_null_groups_keep_their_rows(spark):
    df = spark.createDataFrame([(None, 1, 2), (None, 2, 3), (1, 1, 4)], "g int, i long, v long")
    assert sorted((r.g or 0, r.i, r.rn) for r in O.rank_in_group(df, ["g"], "i", "rn").collect()) == [(0, 1, 1), (0, 2, 2), (1, 1, 1)]
    assert sorted((r.g or 0, r.i, r.s) for r in O.exclusive_sum(df, ["g"], "i", "v", "s").collect()) == [(0, 1, 0), (0, 2, 2), (1, 1, 0)]


def test_ranks_and_sums_in_blocks(spark):
    rng = random.Random(1)
    rows = [(g, i, rng.randint(0, 9)) for g in range(3) for i in rng.sample(range(500), 200)]
    df = spark.createDataFrame(rows, "g int, i long, v long")
    ranks = {(r.g, r.i): r.rn for r in O.rank_in_group(df, ["g"], "i", "rn", block=16).collect()}
    sums = {(r.g, r.i): r.s for r in O.exclusive_sum(df, ["g"], "i", "v", "s", block=16).collect()}
    for g in range(3):
        mine = sorted((i, v) for gg, i, v in rows if gg == g)
        for n, (i, _) in enumerate(mine):
            assert ranks[(g, i)] == n + 1
            assert sums[(g, i)] == sum(v for _, v in mine[:n])


def test_values_at_rank(spark):
    rng = random.Random(2)
    rows = [(g, round(rng.random() * 20, 1)) for g in range(3) for _ in range(101 + g)]
    df = spark.createDataFrame(rows, "g int, v double")
    out = O.values_at_rank(df, ["g"], "v", {"mid": F.floor(F.col("n") / 2), "top": F.col("n") - 1}).collect()
    for r in out:
        mine = sorted(v for g, v in rows if g == r.g)
        assert (r.n, r.mid, r.top) == (len(mine), mine[len(mine) // 2], mine[-1])
    four = spark.createDataFrame([(1, float(v)) for v in (1, 2, 3, 4)], "g int, v double")
    assert O.upper_median(four, ["g"], "v").first().median == 3.0


def test_merge_order_with_a_hot_batch(spark):
    rng = random.Random(4)
    rows = [(0, f, p) for f in range(60) for p in range(1, rng.randint(2, 30))] + [(1, 5, 1), (1, 2, 1), (1, 2, 2)]
    out = P.merge_order(spark.createDataFrame(rows, "batch_id int, file_pos long, page long"), block=8).collect()
    for batch in (0, 1):
        want = sorted((f, p) for b, f, p in rows if b == batch)
        got = sorted((r.out_page, r.file_pos, r.page) for r in out if r.batch_id == batch)
        assert [(f, p) for _, f, p in got] == want and [n for n, _, _ in got] == list(range(1, len(want) + 1))
        assert {r.out_pages for r in out if r.batch_id == batch} == {len(want)}


def test_links_by_band(spark):
    lines = spark.createDataFrame([(1, 1, i, 100.0 * i, f"l{i}") for i in range(5)], "doc long, page long, line_no int, y double, text string")
    notes = [
        (1, 1, 2, "https://b", 95.0, 105.0),
        (1, 1, 1, "https://a", 104.0, 108.0),
        (1, 1, 3, "https://b", 99.0, 101.0),
        (1, 1, 4, "javascript:x", 99.0, 101.0),
        (1, 1, 5, "mailto:m", 1e9, 300.0),
    ]
    out = T.recover_links(lines, spark.createDataFrame(notes, "doc long, page long, ord long, url string, y1 double, y2 double"))
    assert {r.line_no: r.linked for r in out.collect()} == {
        0: "l0",
        1: "l1 [link](https://a) [link](https://b)",
        2: "l2",
        3: "l3 [link](mailto:m)",
        4: "l4 [link](mailto:m)",
    }


def lines_of(items):
    """The fold itself: (doc, page, ord) -> (line_no, line_y)."""
    out, tops = {}, {}
    for doc, page, o, text, x, y, width, size in sorted(items, key=lambda i: (i[0], i[1], -i[5], i[7] or 12.0, i[4])):
        reach = max(2.0, 0.35 * max(1.0, abs(size if size is not None else 12.0)))
        mine = tops.setdefault((doc, page), [])
        near = [n for n, top in enumerate(mine) if abs(top - y) <= reach]
        if not near:
            mine.append(y)
            near = [len(mine) - 1]
        out[doc, page, o] = near[0], mine[near[0]]
    return out


def test_lines_of_a_hot_page(spark):
    """Stacks of near heights over many bands, sizes that reach over several lines, and
    pages of one item; no page is ever a row."""
    rng = random.Random(12)
    items = []
    for page in range(5):
        for o in range(1500 if page == 0 else rng.randint(1, 60)):
            y = rng.choice([rng.random() * 900 - 100, float(rng.randint(0, 60) * 13), rng.randint(0, 500) / 4])
            items.append((1, page, o, "w", rng.random() * 500, y, 5.0, rng.choice([None, 8.0, 12.0, -12.0, 30.0, 90.0])))
    items += [(2, 0, o, "w", float(o), 700.0, 5.0, 12.0) for o in range(1500)] + [(3, 0, o, "w", 0.0, 3000 - 1.5 * o, 5.0, 9.0) for o in range(800)]
    df = spark.createDataFrame(items, "doc long, page long, ord long, str string, x double, y double, width double, font_size double")
    grouped = T.group_lines(df)
    assert {(r.doc, r.page, r.ord): (r.line_no, r.line_y) for r in grouped.collect()} == lines_of(items)
    assert not any("array" in f.dataType.simpleString() for f in T.height_lines(T.page_heights(df)).schema)
    plan = grouped._jdf.queryExecution().toString()
    assert "collect_list" not in plan


def test_stacked_merges_of_one_tile(spark):
    """Five thousand merges over each other and five thousand cells: a merge paints a tile
    once, a cell asks once.  The first merge of the file wins; anchors stay."""
    rng = random.Random(6)
    merges = [(1, 0, n, rng.randint(0, 31), rng.randint(0, 31), rng.randint(1, 40), rng.randint(1, 40)) for n in range(5000)]
    merges += [(2, 0, n, 40 * n, 3 * n, 1 + n % 4, 1 + n % 5) for n in range(40)] + [(3, 0, 0, 0, 0, 400, 200), (3, 0, 1, 5, 5, 2, 2)]
    cells = [(f, 0, r, c, f"{f} {r} {c}") for f in (1, 2, 3, 4) for r in range(0, 72) for c in range(0, 70)]
    cells += cells[:3]
    of = {1: merges[:5000], 2: merges[5000:5040], 3: merges[5040:], 4: []}
    kept, states = [], set()
    for f, sheet, r, c, text in cells:
        over = [(n, mr, mc, h, w) for _, _, n, mr, mc, h, w in of[f] if mr <= r < mr + h and mc <= c < mc + w]
        if all((mr, mc) == (r, c) for _, mr, mc, _, _ in over):
            kept.append((f, r, c, text))
        first = min(over, default=None)
        if first is None:
            states.add((f, r, c, "none", 1))
        elif first[2] == c:
            states.add((f, r, c, "continue" if r > first[1] else "restart" if first[3] > 1 else "none", first[4]))
    cell_df = spark.createDataFrame(cells, "file_id long, sheet_ord int, row int, col int, text string")
    merge_df = spark.createDataFrame(merges, "file_id long, sheet_ord int, ord int, row int, col int, rowspan int, colspan int")
    got = S.merge_cover(cell_df, merge_df)
    assert got.columns == cell_df.columns
    assert sorted((r.file_id, r.row, r.col, r.text) for r in got.collect()) == sorted(kept)
    out = [(r.file_id, r.row, r.col, r.v_merge, r.grid_span) for r in S.merge_state(cell_df, merge_df).collect()]
    assert len(out) == len(set(out)) and set(out) == states


def test_sweeps_do_the_work_of_the_answer():
    """Steps, counted: links opened and shown follow annotations and lines, and a tile
    that is full takes no more paint."""
    shown = T.OpenLinks()
    for n in range(5000):
        shown.open(n, "https://one")
    assert shown.tail() == " [link](https://one)" and len(shown.shown) == 1
    for n in range(4999):
        shown.close(n, "https://one")
    assert shown.shown == [(4999, "https://one")]
    shown.close(4999, "https://one")
    assert shown.tail() == "" and not shown.places


def test_links_against_every_pair(spark):
    rng = random.Random(8)
    lines = [(1, p, i, float(rng.randint(0, 4000)) / 4, f"l{i}") for p in (1, 2) for i in range(300)]
    notes = []
    for n in range(400):
        y = rng.randint(-200, 1200)
        notes.append((1, rng.choice([1, 1, 3]), n // 2, f"https://{rng.randint(0, 30)}", float(y), float(y + rng.choice([0, 5, 90, 2000]) * rng.choice([1, -1]))))
    got = T.recover_links(
        spark.createDataFrame(lines, "doc long, page long, line_no int, y double, text string"),
        spark.createDataFrame(notes, "doc long, page long, ord long, url string, y1 double, y2 double"),
    )
    want = {}
    for _, page, i, y, text in lines:
        over = sorted((o, url) for _, p, o, url, y1, y2 in notes if p == page and min(y1, y2) - 4 <= y <= max(y1, y2) + 4)
        want[page, i] = text + "".join(f" [link]({u})" for u in dict.fromkeys(u for _, u in over))
    assert {(r.page, r.line_no): r.linked for r in got.collect()} == want


def test_text_of_a_hot_page(spark):
    """A page of many lines over many bands: order, gaps, body size and paragraphs are
    those of one pass over the page."""
    rng = random.Random(15)
    sizes = [9.0, 11.0, 11.0, 11.0, 16.0, 24.0]
    lines = []
    for page in (0, 1, 2):
        y = 5000.0
        for n in range(700 if page == 0 else 5):
            y -= rng.choice([12.0, 12.0, 12.0, 40.0, 300.0])
            text = rng.choice(["plain words", "plain words", "It ends.", "- item", "3) third", "Title", "", "x" * 130])
            lines.append((1, page, n, y, rng.random() * 9, rng.choice(sizes), text))
    df = spark.createDataFrame(lines, "doc long, page long, line_no int, y double, x double, font_size double, text string")
    seen = T.heading_level(T.line_gaps(df).withColumn("linked", F.col("text")))
    got = {(r.page, r.line_no): (r.seq, r.gap_above, r.body_size, r.level) for r in seen.collect()}
    blocks = {(r.page, r.block): (r.kind, r.text) for r in T.paragraphs(seen).collect()}
    want, want_blocks = {}, {}
    for page in (0, 1, 2):
        mine = [r for r in lines if r[1] == page and r[6]]
        body = sorted(r[5] for r in mine)[len(mine) // 2]
        before, last, block, parts = None, None, 0, {}
        for seq, r in enumerate(mine, 1):
            size, text = r[5], r[6]
            heading = len(text) <= 120 and size >= max(14.0, body * 1.4) and text[-1] not in ".!?:;" and not text.startswith(("- ", "3) "))
            level = (1 if size >= body * 1.8 else 2 if size >= body * 1.55 else 3) if heading else None
            gap = 0.0 if before is None else before - r[3]
            want[page, r[2]] = (seq, gap, body, level)
            kind = "heading" if heading else "list" if text.startswith(("- ", "3) ")) else "text"
            if kind != "text" or last != "text" or gap > max(body * 1.9, 18.0):
                block += 1
            shown = "#" * level + " " + text if heading else text.replace("3) ", "3. ") if kind == "list" else text
            parts.setdefault(block, (kind, []))[1].append(shown)
            before, last = r[3], kind
        want_blocks |= {(page, b): (kind, " ".join(p)) for b, (kind, p) in parts.items()}
    assert got == want
    assert blocks == want_blocks


def test_dense_rows_shuffle_only_cells(spark):
    """Gaps are filled inside rows: a sheet of 1 500 by 500 places with 40 cells moves no blank."""
    random.seed(8)
    places = {(random.randrange(1500), random.randrange(500)): f"v{i}" for i in range(40)} | {(1499, 499): "end"}
    rows = [(1, 0, r, c, v, 1) for (r, c), v in places.items()]
    rows += [(1, 0, 1499, 499, "later", 2), (1, 0, 20_000, 3, "off", 1), (1, 0, 3, 500, "off", 1), (1, 0, None, 2, "null", 1), (2, 0, 0, 0, None, 1), (None, 0, 1, 1, "x", 1)]
    cells = spark.createDataFrame(rows, "file_id long, sheet_ord int, row long, col long, v string, ord int")
    got = {(r.file_id, r.row): r["values"] for r in S.dense_rows(cells, "v", "ord").collect()}
    for r in range(1500):
        assert got[1, r] == [("later" if (r, c) == (1499, 499) else places.get((r, c), "")) for c in range(500)]
    assert got[2, 0] == [""] and len([k for k in got if k[0] == 1]) == 1500
    assert S.dense_grid(cells.where("file_id = 1"), "v", "ord").where("v <> ''").count() == len(places)
    assert S.dense_rows(cells.limit(0), "v").count() == 0
    # No explode below an exchange: what is made is not shuffled.
    plan = S.dense_rows(cells, "v")._jdf.queryExecution().executedPlan().toString()
    below, depth = False, None
    for line in plan.splitlines():
        at = len(line) - len(line.lstrip(" :+-|"))
        depth = None if depth is not None and at <= depth else depth
        if "Exchange" in line and depth is None:
            depth = at
        below |= depth is not None and "Generate" in line
    assert "Generate" in plan and not below


def test_lines_from_runs_are_those_of_single_items(spark):
    """Items of a line that are apart, of several heights and sizes, or without numbers."""
    rng = random.Random(11)
    rows = []
    for i in range(900):
        y = rng.choice([700.0, 699.0, 680.0, 660.5, None])
        x = rng.choice([None, float(rng.randrange(0, 60, 4)), float("nan")] + [float(rng.randrange(60))] * 6)
        text = rng.choice(["a", "é b", " , c", "(", "d[", " ", "", "x  y", None])
        rows.append((i % 3 and rng.randrange(3), 1, i, text, x, y, rng.choice([None, 3.0, 8.0, 0.5]), rng.choice([12.0, 9.0, None])))
    schema = "doc long, page long, ord long, str string, x double, y double, width double, font_size double"
    items = spark.createDataFrame(rows, schema).repartition(5)
    grouped = T.group_lines(items).collect()
    lines = {}
    for r in grouped:
        lines.setdefault((r.doc, r.page, r.line_no), []).append(r)
    want = {}
    for key, own in lines.items():
        nan = lambda v: (v is not None, v != v, v if v == v else 0)
        own.sort(key=lambda r: (nan(r.x), -r.y, r.ord))
        text, reach, left = "", [], ""
        for r in own:
            value = " ".join(r.str.split())
            edge = max(reach, default=0.0, key=lambda v: (v != v, v if v == v else 0))
            edge = edge if edge != edge else max(0.0, edge)
            wide = r.x is not None and not (r.x - edge <= 1.5)
            text += (" " if left and wide and value[0] not in ",.;:!?%)" and left[-1] not in "([{/" else "") + value
            left = value
            if r.x is not None and r.width is not None:
                reach.append(r.x + r.width)
        want[key] = (own[0].line_y, max(r.font_size for r in own), text.strip())
    for out in (T.text_lines(items), T.join_items(T.group_lines(items))):
        got = {(r.doc, r.page, r.line_no): (r.y, r.font_size, r.text) for r in out.collect()}
        assert got == want
    assert max(map(len, lines.values())) > 60


def test_sizes_given_in_the_sweep_are_those_of_the_join(spark):
    rng = random.Random(5)
    lines = [(d, p, i, 2000.0 - 19 * i, 0.0, rng.choice([10.0, 10.0, 21.0]), f"l{i}") for d in range(3) for p in range(2) for i in range(80)]
    lines.append((9, 1, 0, 5.0, 0.0, 14.0, "alone"))
    texts = spark.createDataFrame(lines, "doc long, page long, line_no int, y double, x double, font_size double, text string")
    notes = spark.createDataFrame([(1, 1, 0, 1990.0, 900.0, "https://e.example/a")], "doc long, page long, ord long, y1 double, y2 double, url string")
    shown = T.shown_lines(texts)
    given = T.heading_level(T.recover_links(T.line_gaps(texts, shown), notes, shown))
    columns = ["doc", "page", "seq", "linked", "body_size", "level"]
    joined = T.heading_level(T.recover_links(T.line_gaps(texts), notes))
    assert sorted(map(str, given.select(*columns).collect())) == sorted(map(str, joined.select(*columns).collect()))
    assert given.where("body_size IS NULL").count() == 0 and given.count() == len(lines)
