"""Admission, batch and stream, and the other streaming forms."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from ..operators.admission import rolling_admission
from ..streaming.admission import stream_admission
from ..streaming.dedup import stream_dedup
from ..streaming.intake import stream_intake
from ..streaming.runs import ClosingTicks, run_available
from . import recipes as R
from .file_queries import _INSPECTED_DUCK
from .registry import query, table

DAY = 86_400.0
LIMIT = 2

_ADMISSION_DUCK = """WITH RECURSIVE o AS (SELECT user_id AS key, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
  r AS (SELECT key, event_id, rn, true AS admitted, [ts] AS stamps FROM o WHERE rn = 1
    UNION ALL SELECT o.key, o.event_id, o.rn, len(list_filter(r.stamps, lambda s: s > o.ts - INTERVAL 1 DAY)) < 2,
      CASE WHEN len(list_filter(r.stamps, lambda s: s > o.ts - INTERVAL 1 DAY)) < 2 THEN list_append(list_filter(r.stamps, lambda s: s > o.ts - INTERVAL 1 DAY), o.ts)
        ELSE list_filter(r.stamps, lambda s: s > o.ts - INTERVAL 1 DAY) END
    FROM r JOIN o ON o.key = r.key AND o.rn = r.rn + 1)
  SELECT key, event_id, admitted FROM r"""


def _events(events):
    return events.select(F.col("user_id").alias("key"), "event_id", F.col("ts").cast("timestamp").alias("ts"))


@query("rolling_admission", _ADMISSION_DUCK)
def rolling_admission_query(spark, sf):
    return rolling_admission(_events(table(spark, sf, "events")), LIMIT, DAY, block_windows=16)


def _stream(spark, sf, name):
    """The files of one table as a stream, be the table a folder of files or one file."""
    given = table(spark, sf, name)
    reader = spark.readStream.schema(given.schema).option("maxFilesPerTrigger", 64)
    if any(f"/{name}.parquet/" in path for path in given.inputFiles()[:1]):
        return reader.parquet(f"{sf}/{name}.parquet")
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf)


@query("stream_admission", _ADMISSION_DUCK)
def stream_admission_query(spark, sf):
    ticks = ClosingTicks(_events(_stream(spark, sf, "events")))
    # Two slices and the delay behind the newest event everything is decided.
    newest = _events(table(spark, sf, "events")).agg(F.coalesce(F.max("ts"), F.timestamp_seconds(F.lit(0)))).first()[0]
    admitted = stream_admission(ticks.stream, LIMIT, DAY)
    return run_available(admitted, "admission", ticks=ticks, until=newest + timedelta(days=3))


@query("stream_dedup", "SELECT DISTINCT sha256(text) AS digest FROM documents")
def stream_dedup_query(spark, sf):
    docs = _stream(spark, sf, "documents").select(
        F.sha2(F.encode("text", "UTF-8"), 256).alias("digest"), F.timestamp_seconds(F.col("doc_id") + 86_400).alias("ts")
    )
    # One row per text of all files, in whatever order they come: the horizon spans all ids.
    span = table(spark, sf, "documents").agg(F.max("doc_id") - F.min("doc_id")).first()[0] or 0
    return run_available(stream_dedup(docs, horizon=f"{max(30, span // 86_400 + 1)} days"), "dedup").select("digest")


@query("stream_intake", f"SELECT file_id, kind, valid, format_label, extension_match, mime_match FROM ({_INSPECTED_DUCK})")
def stream_intake_query(spark, sf):
    docs = _stream(spark, sf, "documents")
    blobs = spark.sql(R.BLOBS.replace("<documents>", "{documents}"), documents=docs).drop("empty_file")
    out = run_available(stream_intake(blobs), "intake")
    return out.select("file_id", "kind", "valid", "format_label", "extension_match", "mime_match")
