"""Link and origin rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clean_trim

# What each rule lets through.
SAFE_HREF = r"(?i)^(?:https?://|mailto:|#|/(?!/))"
SAFE_IMAGE = r"(?i)^(?:blob:|data:image/(?:png|jpe?g|gif|webp);base64,[a-z0-9+/=\s]+\z)"
SAFE_EXTRACTED = r"(?i)^(?:https?:|mailto:)"
EXTERNAL_TARGET = r"(?i)^(?:[a-z][a-z0-9+.-]*:|//)"


def safe_href(url: Column) -> Column:
    trimmed = clean_trim(url)
    return F.when(trimmed.rlike(SAFE_HREF), trimmed)


def safe_image_source(url: Column) -> Column:
    trimmed = clean_trim(url)
    return F.when(trimmed.rlike(SAFE_IMAGE), trimmed)


def safe_extracted_link(url: Column) -> Column:
    trimmed = clean_trim(url)
    return F.when(trimmed.rlike(SAFE_EXTRACTED), trimmed)


def is_external_target(target: Column, mode: Column | None = None) -> Column:
    by_scheme = F.coalesce(target.rlike(EXTERNAL_TARGET), F.lit(False))
    if mode is None:
        return by_scheme
    return F.coalesce(F.lower(mode) == "external", F.lit(False)) | by_scheme


def is_allowed_origin(url: Column, origins: list[str], suffix: str) -> Column:
    """Exact origin, or an https host below ``suffix`` with three labels or more."""
    scheme = F.lower(F.regexp_extract(url, r"(?i)^([a-z][a-z0-9+.-]*)://", 1))
    host = F.lower(F.regexp_extract(url, r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]+)", 1))
    exact = F.concat(scheme, F.lit("://"), host).isin([o.lower() for o in origins])
    labels = F.split(host, r"\.", -1)
    below = (
        (scheme == "https")
        & host.endswith(suffix)
        & ~F.contains(host, F.lit(".."))
        & (F.size(labels) >= 3)
        & F.forall(labels, lambda label: label != "")
    )
    return F.coalesce((host != "") & (exact | below), F.lit(False))
