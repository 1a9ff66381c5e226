"""ZIP containers: the directory and single parts.

Two small Arrow functions touch bytes: one lists the central directory, one
inflates chosen parts with a bounded output.  They decide nothing; limits, safe
paths, kinds and checksums are column expressions in ``operators.archive``.
Both work inside the file's own row, so content is never shuffled.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import dims

EOCD = struct.Struct("<4s4H2LH")
CENTRAL = struct.Struct("<4s6H3L5H2L")
LOCAL = struct.Struct("<4s5H3L2H")
MAX_COMMENT = 65_535
MARK_END, MARK_ENTRY, MARK_LOCAL = b"PK\x05\x06", b"PK\x01\x02", b"PK\x03\x04"
MARK_END64, MARK_LOCATOR64 = b"PK\x06\x06", b"PK\x06\x07"
ESCAPES = (0xFFFF, 0xFFFFFFFF)

MALFORMED = "ARCHIVE_MALFORMED"
ZIP64 = "ARCHIVE_ZIP64_UNSUPPORTED"

ENTRY = T.StructType(
    [
        T.StructField("ord", T.IntegerType()),
        T.StructField("path", T.StringType()),
        T.StructField("csize", T.LongType()),
        T.StructField("usize", T.LongType()),
        T.StructField("method", T.IntegerType()),
        T.StructField("flags", T.IntegerType()),
        T.StructField("crc32", T.LongType()),
        T.StructField("offset", T.LongType()),
        T.StructField("disk", T.IntegerType()),
        T.StructField("broken", T.StringType()),
    ]
)
DIRECTORY = T.StructType([T.StructField("error", T.StringType()), T.StructField("entries", T.ArrayType(ENTRY))])
PART = T.StructType(
    [T.StructField("path", T.StringType()), T.StructField("data", T.BinaryType()), T.StructField("error", T.StringType())]
)
ENTRY_ARROW = pa.struct(
    [("ord", pa.int32()), ("path", pa.string()), ("csize", pa.int64()), ("usize", pa.int64()), ("method", pa.int32()),
     ("flags", pa.int32()), ("crc32", pa.int64()), ("offset", pa.int64()), ("disk", pa.int32()), ("broken", pa.string())]
)
DIRECTORY_ARROW = pa.struct([("error", pa.string()), ("entries", pa.list_(ENTRY_ARROW))])
PARTS_ARROW = pa.list_(pa.struct([("path", pa.string()), ("data", pa.binary()), ("error", pa.string())]))


def _end_record(data: bytes) -> int | None:
    floor = max(0, len(data) - EOCD.size - MAX_COMMENT)
    at = data.rfind(MARK_END, floor)
    while at >= 0:
        if at + EOCD.size <= len(data) and at + EOCD.size + EOCD.unpack_from(data, at)[7] == len(data):
            return at
        at = data.rfind(MARK_END, floor, at)
    return None


def list_directory(data: bytes, max_entries: int) -> dict:
    """``error`` for the archive as a whole, else its entries in directory order.

    A record that cannot be read ends the list with ``broken`` set.
    """
    end = _end_record(data)
    if end is None:
        return {"error": MALFORMED, "entries": []}
    if data[max(0, end - 20) : max(0, end - 16)] == MARK_LOCATOR64 or (end >= 56 and data[end - 56 : end - 52] == MARK_END64):
        return {"error": ZIP64, "entries": []}
    _, disk, first_disk, here, total, size, start, _ = EOCD.unpack_from(data, end)
    if disk or first_disk or here != total or any(v in ESCAPES for v in (here, total, size, start)):
        return {"error": ZIP64, "entries": []}
    if total == 0:
        return {"error": MALFORMED, "entries": []}
    if total > max_entries:
        return {"error": "ARCHIVE_TOO_COMPLEX", "entries": []}
    if start + size > end:
        return {"error": MALFORMED, "entries": []}
    entries, at, stop = [], start, start + size
    for number in range(total):
        if at + CENTRAL.size > stop or data[at : at + 4] != MARK_ENTRY:
            entries.append({"ord": number, "broken": MALFORMED})
            return {"error": None, "entries": entries}
        f = CENTRAL.unpack_from(data, at)
        name, after = at + CENTRAL.size, at + CENTRAL.size + f[10] + f[11] + f[12]
        if after > stop:
            entries.append({"ord": number, "broken": MALFORMED})
            return {"error": None, "entries": entries}
        try:
            path = data[name : name + f[10]].decode("utf-8")
        except UnicodeDecodeError:
            path = None
        entries.append(
            {"ord": number, "path": path, "csize": f[8], "usize": f[9], "method": f[4], "flags": f[3], "crc32": f[7],
             "offset": f[16], "disk": f[13], "broken": None}
        )
        at = after
    if at != stop:
        entries.append({"ord": total, "broken": MALFORMED})
    return {"error": None, "entries": entries}


def inflate_part(data: bytes, entry: dict) -> dict:
    out = {"path": entry["path"], "data": None, "error": MALFORMED}
    at = entry["offset"]
    if at + LOCAL.size > len(data) or data[at : at + 4] != MARK_LOCAL:
        return out
    head = LOCAL.unpack_from(data, at)
    name_end = at + LOCAL.size + head[9]
    body = name_end + head[10]
    name = data[at + LOCAL.size : name_end].decode("utf-8", "replace").replace("\\", "/")
    if head[3] != entry["method"] or name != entry["path"].replace("\\", "/") or body + entry["csize"] > len(data):
        return out
    raw = data[body : body + entry["csize"]]
    if entry["method"] == 8:
        try:
            raw = zlib.decompressobj(-15).decompress(raw, entry["usize"] + 1)
        except zlib.error:
            return out
        if len(raw) > entry["usize"]:
            return {**out, "error": "ARCHIVE_ENTRY_TOO_LARGE"}
    if len(raw) != entry["usize"]:
        return out
    return {**out, "data": raw, "error": None}


def one_by_one(values: pa.Array) -> Iterator:
    return (value.as_py() for value in values)


def _directory_udf(max_entries: int):
    @F.arrow_udf(returnType=DIRECTORY)
    def read(content: pa.Array) -> pa.Array:
        # One archive at a time is copied out of the batch.
        rows = (None if c is None else list_directory(c, max_entries) for c in one_by_one(content))
        return pa.array(rows, type=DIRECTORY_ARROW, size=len(content))

    return read


@F.arrow_udf(returnType=T.ArrayType(PART))
def _read_parts(content: pa.Array, entries: pa.Array) -> pa.Array:
    # One archive at a time is copied out of the batch, and its parts go to the result at once.
    rows = (
        [inflate_part(data, e) for e in wanted or []] if data is not None else []
        for data, wanted in zip(one_by_one(content), one_by_one(entries))
    )
    return pa.array(rows, type=PARTS_ARROW, size=len(content))


def with_directory(files: DataFrame, limits: dict[str, int] = dims.ARCHIVE_LIMITS) -> DataFrame:
    """Adds ``dir`` (error, entries); an archive over the size limit is not opened."""
    fits = F.octet_length("content") <= limits["input_bytes"]
    read = _directory_udf(limits["entries"])
    listed = files.withColumn("dir", read(F.when(fits, F.col("content"))))
    return listed.withColumn(
        "dir",
        F.struct(
            F.when(~fits, "ARCHIVE_TOO_LARGE").otherwise(F.col("dir.error")).alias("error"), F.col("dir.entries").alias("entries")
        ),
    )


def scan_archive_entries(files: DataFrame, limits: dict[str, int] = dims.ARCHIVE_LIMITS) -> DataFrame:
    """One row per directory record; archives without a directory give none."""
    return with_directory(files, limits).select("file_id", F.inline_outer("dir.entries")).where(F.col("ord").isNotNull() & F.col("broken").isNull()).select(
        "file_id", "ord", "path", "csize", "usize", "method", "flags", "crc32", "offset", F.col("path").endswith("/").alias("is_dir")
    )


def part_rows(wanted: Column, content: Column) -> Column:
    """Parts of the entries in ``wanted``; a checksum that is off is an error too."""
    read = _read_parts(content, wanted)
    return F.zip_with(
        read,
        wanted,
        lambda p, e: F.struct(
            e["path"].alias("path"),
            F.when(F.crc32(p["data"]) == e["crc32"], p["data"]).alias("data"),
            F.coalesce(p["error"], F.when(F.crc32(p["data"]) != e["crc32"], MALFORMED)).alias("error"),
        ),
    )


def scan_archive_parts(files: DataFrame, wanted, limits: dict[str, int] = dims.ARCHIVE_LIMITS) -> DataFrame:
    """``wanted``: entry column → boolean.  file_id, path, data, error."""
    listed = with_directory(files, limits)
    chosen = F.filter(F.coalesce("dir.entries", F.array().cast(T.ArrayType(ENTRY))), lambda e: e["broken"].isNull() & wanted(e))
    picked = listed.select("file_id", "content", chosen.alias("wanted"))
    return picked.select("file_id", F.inline_outer(part_rows(F.col("wanted"), F.col("content")))).where(F.col("path").isNotNull())
