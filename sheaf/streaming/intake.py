"""Files inspected as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.inspect import inspect_files
from ..sources.files import FILE_COLUMNS, FILE_SCHEMA


def file_stream(spark: SparkSession, path: str, glob: str = "*", max_files: int = 1000) -> DataFrame:
    """A folder of files as a stream of the columns ``scan_files`` gives."""
    files = (
        spark.readStream.format("binaryFile")
        .schema(FILE_SCHEMA)
        .option("pathGlobFilter", glob)
        .option("maxFilesPerTrigger", max_files)
        .load(path)
    )
    return files.selectExpr(*FILE_COLUMNS)


def stream_intake(files: DataFrame) -> DataFrame:
    """The batch inspection on a stream: a projection and a broadcast join."""
    return inspect_files(files)
