"""Names, sizes and plain-text columns.  Everything stays in Catalyst."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as a browser regex sees it; Java's ``\s`` is ASCII only.
WS = r"\s\x0B\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
# The same set as plain characters, for trimming without a regex.
WS_CHARS = "\t\n\x0b\f\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
WS_CLASS = f"[{WS}]"


def clean_trim(col: Column) -> Column:
    """Trim Unicode white space on both ends."""
    return F.btrim(col, F.lit(WS_CHARS))


def is_blank(col: Column) -> Column:
    return clean_trim(col) == ""


def collapse_spaces(col: Column) -> Column:
    """Trimmed, every run of white space one space; a single word skips the regex."""
    trimmed = clean_trim(col)
    return F.when(solid(trimmed) == trimmed, trimmed).otherwise(F.regexp_replace(trimmed, f"{WS_CLASS}+", " "))


def solid(col: Column) -> Column:
    """Without any white space."""
    return F.translate(col, WS_CHARS, "")


def file_extension(name: Column) -> Column:
    """Lower-case suffix with its dot, letters and digits only; '' if none."""
    return F.lower(F.regexp_extract(name, r"(?i)\.[a-z0-9]+\z", 0))


def loose_extension(name: Column) -> Column:
    """Whatever follows the last dot, with the dot, lower case; '' without a dot."""
    return F.when(F.contains(name, F.lit(".")), F.concat(F.lit("."), F.lower(F.substring_index(name, ".", -1)))).otherwise("")


def bare_extension(name: Column) -> Column:
    """Whatever follows the last dot, lower case, no dot."""
    return F.when(F.contains(name, F.lit(".")), F.lower(F.substring_index(name, ".", -1))).otherwise("")


def base_name(name: Column) -> Column:
    return F.regexp_extract(name, r"[^\\/]*\z", 0)


def _tidy(col: Column, junk: str, limit: int, fallback: str) -> Column:
    out = F.regexp_replace(col, junk, "-")
    out = F.regexp_replace(out, "-+", "-")
    out = F.regexp_replace(out, r"^[.\- ]+|[.\- ]+\z", "")
    return F.coalesce(F.nullif(F.substring(out, 1, limit), F.lit("")), F.lit(fallback))


def safe_file_name(name: Column, fallback: str = "output") -> Column:
    """Base name without extension, fit for a download on any system."""
    stem = clean_trim(F.regexp_replace(base_name(name), r"(?i)\.[a-z0-9]+\z", ""))
    return _tidy(stem, r"[^\w\-. ()\[\]]+", 120, fallback)


def safe_request_name(name: Column, fallback: str = "document") -> Column:
    """Variant that keeps the extension and drops control characters and leading dots."""
    bare = F.regexp_replace(base_name(name), r"[\x00-\x1F\x7F]", "")
    bare = F.regexp_replace(clean_trim(bare), r"^\.+", "")
    return _tidy(bare, r"[^A-Za-z0-9._\- ()\[\]]+", 100, fallback)


def format_bytes(size: Column) -> Column:
    """B/KB/MB/GB in steps of 1024.

    Rounding is done on integers (half up), so no binary fraction can tip it.
    """
    size = size.cast("long")
    unit = F.when(size < 1 << 20, 0).when(size < 1 << 30, 1).otherwise(2)
    base = F.when(size < 1 << 20, 1 << 10).when(size < 1 << 30, 1 << 20).otherwise(1 << 30).cast("long")

    def scaled(factor: int) -> Column:
        return F.floor((size * (2 * factor) + base) / (base * 2)).cast("long")

    def fixed(digits: int) -> Column:
        value = scaled(10**digits)
        whole = F.floor(value / 10**digits).cast("long").cast("string")
        rest = F.lpad((value % 10**digits).cast("string"), digits, "0")
        return F.concat(whole, F.lit("."), rest)

    number = (
        F.when(size % base == 0, F.floor(size / base).cast("long").cast("string"))
        .when(size >= base * 100, scaled(1).cast("string"))
        .when(size >= base * 10, fixed(1))
        .otherwise(fixed(2))
    )
    name = F.element_at(F.array(F.lit("KB"), F.lit("MB"), F.lit("GB")), unit + 1)
    return (
        F.when(size.isNull() | (size < 0), F.lit("0 B"))
        .when(size < 1024, F.concat(size.cast("string"), F.lit(" B")))
        .otherwise(F.concat(number, F.lit(" "), name))
    )


def percent_change(before: Column, after: Column) -> Column:
    """Signed change with one decimal; a dash when there is nothing to compare to."""
    pct = (after - before) / before * 100
    tenths = F.floor(F.abs(pct) * 10 + 0.5).cast("long")
    sign = F.when(pct > 0, "+").when(pct < 0, "-").otherwise("")
    text = F.concat(sign, F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit("%"))
    return F.when(before <= 0, F.lit("—")).otherwise(text)


def escape_html(col: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        col = F.replace(col, F.lit(char), F.lit(entity))
    return col


def escape_attribute(col: Column) -> Column:
    return F.replace(escape_html(col), F.lit("`"), F.lit("&#96;"))


def escape_xml(col: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        col = F.replace(col, F.lit(char), F.lit(entity))
    return col


# ---- coercion, clamps, units ------------------------------------------------

EMU_PER_POINT = 12_700
# What counts as a number in a text: decimal with or without exponent, or hexadecimal.
# A cast alone would also take Java's type suffixes, as in ``1d``.
DECIMAL = r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?\z"
HEXADECIMAL = r"^0[xX][0-9a-fA-F]{1,13}\z"


def finite_number(col: Column) -> Column:
    """The finite number a text holds (blanks around it aside), null if it holds none."""
    bare = F.trim(col.cast("string"))
    value = F.when(bare.rlike(DECIMAL), bare.try_cast("double")).when(
        bare.rlike(HEXADECIMAL), F.conv(F.substr(bare, F.lit(3)), 16, 10).cast("double")
    )
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def finite_or(col: Column, fallback: float) -> Column:
    return F.coalesce(finite_number(col), F.lit(float(fallback)))


def clamp(col: Column, low: float, high: float, fallback: float) -> Column:
    value = col.cast("double")
    ok = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
    return F.when(ok, F.least(F.lit(float(high)), F.greatest(F.lit(float(low)), value))).otherwise(F.lit(float(fallback)))


def to_flag(col: Column) -> Column:
    return F.coalesce(col.isin("1", "true", "on"), F.lit(False))


def emu_to_points(col: Column, fallback: float = 0.0) -> Column:
    return F.greatest(F.lit(0.0), finite_or(col, fallback * EMU_PER_POINT)) / EMU_PER_POINT


def points_to_emu(col: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(col * EMU_PER_POINT + 0.5)).cast("long")


def points_to_twips(col: Column) -> Column:
    return F.greatest(F.lit(1_440), F.least(F.lit(31_680), F.floor(col * 20 + 0.5))).cast("long")


def hex_colour(value: Column, fallback: str = "111827") -> Column:
    raw = F.regexp_replace(F.coalesce(value, F.lit(f"#{fallback}")), "^#", "")
    return F.when(raw.rlike(r"(?i)^[0-9a-f]{6}\z"), F.upper(raw)).otherwise(F.lit(fallback))


def css_colour(value: Column, fallback: str = "1A1F26") -> Column:
    """Six hex digits of ``#rgb``, ``#rrggbb`` or ``rgb()`` / ``rgba()`` (parts rounded and
    held to 0..255); anything else is the fallback."""
    bare = F.trim(value)
    short = F.regexp_replace(F.regexp_extract(bare, r"(?i)^#([0-9a-f]{3})\z", 1), "(.)", "$1$1")
    full = F.regexp_extract(bare, r"(?i)^#([0-9a-f]{6})\z", 1)
    parts = [F.regexp_extract(value, r"(?i)rgba?\(\s*([\d.]+)[, ]+\s*([\d.]+)[, ]+\s*([\d.]+)", k).try_cast("double") for k in (1, 2, 3)]
    bytes_ = [F.when(p.isNotNull(), F.lpad(F.hex(F.least(F.lit(255), F.floor(p + 0.5)).cast("long")), 2, "0")) for p in parts]
    found = F.coalesce(F.nullif(full, F.lit("")), F.nullif(short, F.lit("")), F.concat(*bytes_), F.lit(fallback))
    return F.upper(found)
