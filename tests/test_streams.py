"""Streams over several micro-batches."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from sheaf.operators.admission import rolling_admission
from sheaf.streaming.admission import stream_admission
from sheaf.streaming.dedup import stream_dedup
from sheaf.streaming.intake import file_stream, stream_intake
from sheaf.streaming.runs import ClosingTicks, run_available

EVENTS = "key long, event_id long, t long"


def write_batches(spark, folder, batches):
    for number, rows in enumerate(batches):
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(f"{folder}/b{number:03d}")


def events(df):
    return df.withColumn("ts", F.timestamp_micros("t"))


def admitted(spark, tmp_path, batches, limit, window, delay="10 minutes", slice_seconds=None):
    """What the stream says of batches of rows, and of all rows behind a last tick."""
    folder = str(tmp_path / "ev")
    write_batches(spark, folder, batches)
    stream = (
        spark.readStream.schema(EVENTS).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(folder)
    )
    ticks = ClosingTicks(events(stream).drop("t"))
    newest = max(t for rows in batches for _, _, t in rows)
    out = stream_admission(ticks.stream, limit, window, delay, slice_seconds)
    until = datetime.fromtimestamp(newest / 1_000_000) + timedelta(days=4)
    return {r.event_id: r.admitted for r in run_available(out, "t1", ticks=ticks, until=until).collect()}


def in_batch(spark, rows, limit, window):
    batch = rolling_admission(events(spark.createDataFrame(rows, EVENTS)), limit, window)
    return {r.event_id: r.admitted for r in batch.collect()}


def test_admission_in_any_order_equals_the_batch_form(spark, tmp_path):
    """Arrival shuffled inside the watermark: over batches and within them."""
    rng = random.Random(11)
    rows, now = [], 0
    for i in range(240):
        now += rng.choice([0, 1, 7, 20, 40]) * 1_000_000
        rows.append((rng.randint(0, 3), i, now))
    arrival = sorted(rows, key=lambda r: r[2] + rng.random() * 500_000_000)
    assert arrival != rows
    batches = [arrival[i : i + 80] for i in range(0, 240, 80)]
    assert admitted(spark, tmp_path, batches, 2, 60.0, slice_seconds=7.0) == in_batch(spark, rows, 2, 60.0)


def test_an_older_event_comes_first_though_it_arrives_later(spark, tmp_path):
    second = 1_000_000
    rows = [(1, 1, 100 * second), (1, 2, 50 * second), (1, 3, 115 * second)]
    got = admitted(spark, tmp_path, [rows[:1], rows[1:]], 2, 60.0)
    assert got == in_batch(spark, rows, 2, 60.0) == {1: True, 2: True, 3: True}


def test_a_hot_key(spark, tmp_path):
    """More events of a key in a batch than are held at once."""
    rng = random.Random(4)
    rows = [(5, i, rng.randint(1, 80_000) * 1_000_000) for i in range(25_000)] + [(6, 30_000, 5)]
    shuffled = rng.sample(rows, len(rows))
    got = admitted(spark, tmp_path, [shuffled[:13_000], shuffled[13_000:]], 3, 600.0, delay="2 days")
    assert got == in_batch(spark, rows, 3, 600.0)


def test_late_events_are_dropped(spark, tmp_path):
    hour = 3_600_000_000
    batches = [[(1, 1, 10 * hour)], [(1, 2, 11 * hour)], [(1, 3, 1 * hour)], [(1, 4, 11 * hour + 1)]]
    assert sorted(admitted(spark, tmp_path, batches, 20, 60.0, delay="1 minute")) == [1, 2, 4]


def test_intake_and_dedup(spark, tmp_path):
    for name, body in (("a.pdf", b"%PDF-1 %%EOF"), ("b.pdf", b"%PDF-1 %%EOF"), ("c.md", b"# x"), ("d.md", b"\xff")):
        (tmp_path / name).write_bytes(body)
    stream = file_stream(spark, str(tmp_path), max_files=2)
    out = run_available(stream_intake(stream).select("name", "kind", "valid"), "t3").collect()
    assert {r.name: (r.kind, r.valid) for r in out} == {
        "a.pdf": ("pdf", True), "b.pdf": ("pdf", True), "c.md": ("markdown", True), "d.md": ("markdown", False),
    }
    keyed = stream.select(F.sha2("content", 256).alias("digest"), F.col("modificationTime").alias("ts"))
    assert run_available(stream_dedup(keyed), "t4").count() == 3


def _tables(spark, tmp_path, parts):
    """``documents`` as a folder of several files, in the order of ``parts``."""
    for number, rows in enumerate(parts):
        spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.mode("append").parquet(
            str(tmp_path / "documents.parquet")
        )
    return str(tmp_path)


def test_dedup_query_over_a_folder_of_files(spark, tmp_path):
    """Equal texts further apart than 30 days of ids, the newest first."""
    import __spark_entry__ as entry

    far = 40 * 86_400
    sf = _tables(spark, tmp_path, [[(far, "a", "en", "s", 1), (far + 1, "b", "en", "s", 1)], [(1, "a", "en", "s", 1), (2, "c", "en", "s", 1)], [(far // 2, "b", "en", "s", 1)]])
    digests = [r.digest for r in entry.queries()["stream_dedup"](spark, sf).collect()]
    assert len(digests) == len(set(digests)) == 3


def test_intake_query_over_a_folder_of_files(spark, tmp_path):
    import __spark_entry__ as entry

    sf = _tables(spark, tmp_path, [[(2, "a", "en", "s", 1)], [(6, "b", "en", "s", 1), (7, "c", "en", "s", 1)]])
    assert sorted(r.file_id for r in entry.queries()["stream_intake"](spark, sf).collect()) == [2, 6, 7]
