"""One inspection per content inside a horizon."""

from __future__ import annotations

from pyspark.sql import DataFrame


def stream_dedup(files: DataFrame, digest: str = "digest", time: str = "ts", horizon: str = "1 hour") -> DataFrame:
    """Keeps the first row per digest; state is dropped behind the watermark."""
    return files.withWatermark(time, horizon).dropDuplicatesWithinWatermark([digest])
