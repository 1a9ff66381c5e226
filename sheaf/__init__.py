"""Document-table analytics on PySpark: files, pages, cells, text items and
Markdown as DataFrames."""

from .session import checkpoint_dir, local_session, tune

__all__ = ["checkpoint_dir", "local_session", "tune"]
