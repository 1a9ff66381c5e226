"""Registered queries and their oracle SQL."""

from . import (  # noqa: F401
    file_queries,
    package_queries,
    page_queries,
    quality_queries,
    sheet_queries,
    stream_queries,
    text_queries,
)
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
