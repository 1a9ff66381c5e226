"""A drop of files from first look to its list of actions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import batch as B
from ..operators.inspect import inspect_files


def batch_plan(files: DataFrame, containers: DataFrame | None = None) -> DataFrame:
    """accept → inspect → gate → actions.

    ``files``: file_id, batch_id, pos, name, mime, size, content.  Admission reads
    names and sizes only, so the bytes of rejected files are never shuffled.
    Inspection is a narrow projection over the bytes; everything after it is slim.
    """
    inspected = inspect_files(files, containers).select(
        "file_id", "batch_id", "pos", "name", "size", "kind", "valid", "safety", "has_preview"
    )
    admitted = B.accept_drop(files.select("file_id", "batch_id", "pos", "name", "size")).where("accepted").select("file_id")
    kept = inspected.join(admitted, "file_id", "left_semi")
    ok = F.col("valid") & F.col("kind").isin(*B.COMBINABLE)
    usable = F.col("valid") & (F.col("safety") == "safe")
    grouped = kept.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("file_count"),
        F.sum("size").alias("total_bytes"),
        F.array_sort(F.collect_set("kind")).alias("kinds"),
        F.bool_and(ok).alias("batch_ok"),
        F.min_by(F.when(~ok, F.col("name")), F.when(~ok, F.col("pos"))).alias("first_offender"),
        F.bool_and(usable).alias("usable"),
        F.bool_or("has_preview").alias("preview"),
    )
    actions = F.when(F.col("usable"), B.actions_for(F.col("file_count"), F.col("kinds"), F.col("preview")))
    return grouped.select(
        "batch_id",
        "file_count",
        "total_bytes",
        F.array_join("kinds", ",").alias("kinds"),
        "batch_ok",
        "first_offender",
        F.coalesce(F.array_join(actions, ","), F.lit("")).alias("actions"),
    )
