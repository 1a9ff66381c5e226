"""Messages to families: the first family whose pattern a message matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNSAFE_ARCHIVE_CODES = ["ARCHIVE_UNSAFE_PATH", "ARCHIVE_DUPLICATE_PATH"]


def first_match(message: Column, families: list[tuple[str, str]]) -> Column:
    """``families``: (pattern, code) in order of priority; null where none matches."""
    code = F.lit(None).cast("string")
    for pattern, family in reversed(families):
        code = F.when(message.rlike(pattern), family).otherwise(code)
    return code


def error_code(error_class: Column, archive_code: Column, message: Column, families: list[tuple[str, str]]) -> Column:
    """The class decides for failed reads and archives, the caller's families for the rest."""
    unsafe = F.when(archive_code.isin(UNSAFE_ARCHIVE_CODES), "unsafe-container").otherwise("invalid-container")
    by_class = F.when(error_class == "read", "file-read").when(error_class == "archive", unsafe)
    return F.coalesce(by_class, first_match(message, families), F.lit("unknown"))


def classify_errors(messages: DataFrame, families: list[tuple[str, str]]) -> DataFrame:
    """Messages per code.  ``messages``: error_class, archive_code, message."""
    code = error_code(F.col("error_class"), F.col("archive_code"), F.col("message"), families)
    return messages.groupBy(code.alias("code")).agg(F.count(F.lit(1)).alias("n"))
