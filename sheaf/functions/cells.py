"""Cell references, typed values, dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clean_trim, finite_number, finite_or

A1 = r"(?i)^\$?([A-Z]+)\$?(\d+)\z"
FAR = 10**15  # stands for any index no sheet can hold


def a1_to_rowcol(ref: Column) -> Column:
    """``$AB$12`` → (row 11, col 27), zero-based; null when it is no reference."""
    ref = clean_trim(ref)
    letters = F.upper(F.regexp_extract(ref, A1, 1))
    digits = F.regexp_extract(ref, A1, 2).try_cast("double")
    col = F.aggregate(F.split(letters, ""), F.lit(0.0), lambda a, c: a * 26 + F.ascii(c) - 64)
    return F.when(
        ref.rlike(A1),
        F.struct(
            F.least(F.greatest(digits - 1, F.lit(0.0)), F.lit(float(FAR))).cast("long").alias("row"),
            (F.least(col, F.lit(float(FAR))) - 1).cast("long").alias("col"),
        ),
    )


def range_to_box(ref: Column) -> Column:
    """``A1:B3`` or one cell → row, col, rowspan, colspan."""
    ends = F.split(ref, ":", -1)
    a = a1_to_rowcol(F.element_at(ends, 1))
    b = a1_to_rowcol(F.coalesce(F.get(ends, F.lit(1)), F.element_at(ends, 1)))
    return F.when(
        a.isNotNull() & b.isNotNull(),
        F.struct(
            F.least(a["row"], b["row"]).alias("row"),
            F.least(a["col"], b["col"]).alias("col"),
            (F.abs(b["row"] - a["row"]) + 1).alias("rowspan"),
            (F.abs(b["col"] - a["col"]) + 1).alias("colspan"),
        ),
    )


ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def rowcol_to_a1(row: Column, col: Column) -> Column:
    """Inverse of ``a1_to_rowcol``, up to three letters."""

    def letter(index: Column) -> Column:
        return F.substring(F.lit(ALPHABET), (index % 26).cast("int") + 1, F.lit(1))

    two = F.floor((col - 26) / 26)
    three = F.floor((col - 702) / 676)
    name = (
        F.when(col < 26, letter(col))
        .when(col < 702, F.concat(letter(two), letter(col - 26)))
        .otherwise(F.concat(letter(three), letter(F.floor((col - 702) / 26)), letter(col - 702)))
    )
    return F.concat(name, (row + 1).cast("string"))


# Fixed value: what makes a formula point outside its workbook.
EXTERNAL_FORMULA = r"(?i)\[[^\]]+\]|(?:https?|file):|\\\\"


def is_external_formula(formula: Column) -> Column:
    return F.coalesce(formula.rlike(EXTERNAL_FORMULA), F.lit(False))


def string_index(raw: Column) -> Column:
    """Index into the string table; anything that is no number reads as 0."""
    return finite_or(raw, 0)


def cell_value(kind: Column, raw: Column, shared: Column) -> Column:
    """Typed value: value_type, s, d, b (exactly one of the last three set)."""
    raw = F.coalesce(raw, F.lit(""))
    number = finite_number(raw)
    is_number = F.coalesce(kind, F.lit("")).eqNullSafe("") & number.isNotNull()
    value_type = F.when(kind == "s", "string").when(kind == "b", "bool").when(is_number, "double").otherwise("string")
    return F.struct(
        value_type.alias("value_type"),
        F.when(kind == "s", F.coalesce(shared, F.lit(""))).when((kind == "b") | is_number, None).otherwise(raw).alias("s"),
        F.when(is_number & (F.coalesce(kind, F.lit("")) == ""), number).alias("d"),
        F.when(kind == "b", raw == "1").alias("b"),
    )


def is_date_format(code: Column) -> Column:
    """A year or day letter outside quotes and brackets."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(code, F.lit("")), '"[^"]*"', ""), r"\[[^\]]+\]", "")
    return bare.rlike("(?i)[yd]")


LAST_DAY = 2_958_465  # 9999-12-31 as a serial day


def excel_date(serial: Column, code: Column) -> Column:
    """ISO date of a serial day under a date format, null otherwise."""
    fits = serial.isNotNull() & (serial > -693_594) & (serial < LAST_DAY + 1)
    day = F.date_add(F.lit("1899-12-30").cast("date"), F.floor(F.when(fits, serial)).cast("int"))
    return F.when(is_date_format(code) & fits, F.date_format(day, "yyyy-MM-dd"))


NUMBER = r"^-?(?:0|[1-9]\d*)(?:\.\d+)?\z"


def infer_kind(text: Column) -> Column:
    return F.when(text.startswith("="), "formula").when(text.rlike(NUMBER), "number").otherwise("text")
