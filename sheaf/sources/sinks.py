"""What goes out: texts, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def write_text_docs(docs: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One text per document as parquet, a file a task.

    ``docs``: doc, text (others travel along).  Documents that failed have no text.
    """
    docs.where(F.col("text").isNotNull()).write.mode(mode).parquet(path)


def read_text_docs(spark, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_report(results: DataFrame, path: str, generated_at: str, ok: str = "ok", mode: str = "errorifexists") -> bool:
    """Results as JSON lines stamped with ``generated_at``; true when every row is ok.

    The stamp is handed in, so that a retried task writes the same bytes.  Rows that are
    not ok are counted while they are written.
    """
    seen = Observation()
    stamped = results.withColumn("generated_at", F.lit(generated_at))
    stamped.observe(seen, F.count_if(~F.coalesce(F.col(ok), F.lit(False))).alias("failed")).write.mode(mode).json(path)
    return not seen.get["failed"]
