"""HTML cleaning and entity decoding as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WS, WS_CLASS

# What is taken out, in this order.
SCRIPT = f"(?is)<script.*?</script{WS_CLASS}*>"
STYLE = f"(?is)<style.*?</style{WS_CLASS}*>"
ACTIVE_TAG = r"(?i)</?(?:iframe|frame|frameset|object|embed|form|input|button|select|textarea|meta|link|base)\b[^>]*>"
HANDLER = f"(?i){WS_CLASS}+on[a-z]+{WS_CLASS}*={WS_CLASS}*(?:\"[^\"]*\"|'[^']*'|[^{WS}>]+)"
URL_ATTRIBUTE = (
    f"(?i){WS_CLASS}(href|src|xlink:href|action){WS_CLASS}*={WS_CLASS}*(?:\"[^\"]*\"|'[^']*'|[^{WS}>]+)"
)
_BAD = r"(?:javascript:|data:text/html|vbscript:)"
BAD_URL_ATTRIBUTE = (
    f"(?is)^{WS_CLASS}(href|src|xlink:href|action){WS_CLASS}*={WS_CLASS}*"
    f"(?:\"{WS_CLASS}*{_BAD}[^\"]*\"|'{WS_CLASS}*{_BAD}[^']*'|{_BAD}[^{WS}>]*)\\z"
)


def rewrite_matches(text: Column, pattern: str, rewrite) -> Column:
    """Replace every match by ``rewrite(match)``: split out the gaps, weave them back."""
    gaps = F.split(text, pattern, -1)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    woven = F.zip_with(gaps, hits, lambda gap, hit: F.concat(gap, F.coalesce(rewrite(hit), F.lit(""))))
    return F.when(F.size(hits) == 0, text).otherwise(F.array_join(woven, ""))


def stages(html: Column) -> dict[str, Column]:
    """The text before each of the five steps, by the name of the step."""
    no_script = F.regexp_replace(html, SCRIPT, "")
    no_style = F.regexp_replace(no_script, STYLE, "")
    no_tags = F.regexp_replace(no_style, ACTIVE_TAG, "")
    no_handlers = F.regexp_replace(no_tags, HANDLER, "")
    return {"script": html, "style": no_script, "tags": no_style, "handlers": no_tags, "urls": no_handlers}


def sanitize(html: Column) -> Column:
    before_urls = stages(html)["urls"]

    def neutralise(attribute: Column) -> Column:
        name = F.regexp_extract(attribute, BAD_URL_ATTRIBUTE, 1)
        return F.when(name == "", attribute).otherwise(F.concat(F.lit(" "), name, F.lit('="#"')))

    # Pages without such a scheme anywhere skip the weaving.
    return F.when(before_urls.rlike(f"(?i){_BAD}"), rewrite_matches(before_urls, URL_ATTRIBUTE, neutralise)).otherwise(before_urls)


def removal_counts(html: Column) -> dict[str, Column]:
    """How many items each step of ``sanitize`` takes out."""
    step = stages(html)
    urls = F.regexp_extract_all(step["urls"], F.lit(URL_ATTRIBUTE), F.lit(0))
    return {
        "scripts": F.regexp_count(step["script"], F.lit(SCRIPT)),
        "styles": F.regexp_count(step["style"], F.lit(STYLE)),
        "active_tags": F.regexp_count(step["tags"], F.lit(ACTIVE_TAG)),
        "handlers": F.regexp_count(step["handlers"], F.lit(HANDLER)),
        "bad_urls": F.size(F.filter(urls, lambda u: u.rlike(BAD_URL_ATTRIBUTE))),
    }


# The entities XML declares by itself.
NAMED_ENTITIES = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"))
ENTITY = r"(?i)&(?:#x[0-9a-f]+|#\d+|amp|lt|gt|quot|apos);"
UNDECLARED = r"(?i)&(?!#x[0-9a-f]+;|#\d+;|amp;|lt;|gt;|quot;|apos;)"


def _code_point(entity: Column) -> Column:
    hexed = F.regexp_extract(entity, r"(?i)^&#x([0-9a-f]+);", 1)
    digits = F.regexp_extract(entity, r"^&#(\d+);", 1)
    return F.when(hexed != "", F.conv(hexed, 16, 10)).when(digits != "", F.conv(digits, 10, 10)).try_cast("decimal(20,0)")


def _bad_reference(entity: Column) -> Column:
    cp = _code_point(entity)
    return F.coalesce((cp > 0x10FFFF) | cp.between(0xD800, 0xDFFF), F.lit(False))


def decode_entities(text: Column) -> tuple[Column, Column]:
    """``(decoded, error_code)``; decoded is null when there is an error.

    Errors: an entity that is not declared (also one that only appears once the
    text is decoded) and a numeric reference to no character.
    """
    hits = F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0))

    def one(entity: Column) -> Column:
        out = F.decode(F.unhex(F.lpad(F.hex(_code_point(entity).cast("long")), 8, "0")), "UTF-32")
        for name, char in reversed(NAMED_ENTITIES):
            out = F.when(F.lower(entity) == name, F.lit(char)).otherwise(out)
        return out

    bad_number = F.exists(hits, _bad_reference)
    undeclared = text.rlike(UNDECLARED)
    decoded = F.when(~(undeclared | bad_number), rewrite_matches(text, ENTITY, one))
    error = (
        F.when(undeclared, "undeclared-entity")
        .when(bad_number, "bad-character-reference")
        .when(decoded.rlike(r"&[^;" + WS + r"]{1,80};"), "undeclared-entity")
    )
    return F.when(error.isNull(), decoded), error
