"""Files and manifests: what comes in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"
# Name: last path part.  The id is a hash of the path, so it is stable across runs.
FILE_COLUMNS = [
    "xxhash64(path) AS file_id",
    "path",
    "regexp_extract(path, '[^/]*$', 0) AS name",
    "length AS size",
    "'' AS mime",
    "modificationTime",
    "content",
]


def scan_files(spark: SparkSession, path: str, glob: str = "*", max_bytes: int | None = None) -> DataFrame:
    """Files below ``path``: file_id, path, name, size, mime, modificationTime, content.

    The size filter is pushed into the scan, so an oversized file is not opened;
    a query that never selects ``content`` does not read any bytes.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    if max_bytes is not None:
        files = files.where(F.col("length") <= max_bytes)
    return files.selectExpr(*FILE_COLUMNS)


def with_manifest(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """MIME types (and other facts) by file name: ``manifest``: name, mime."""
    return files.drop("mime").join(manifest.select("name", "mime"), "name", "left").withColumn(
        "mime", F.coalesce("mime", F.lit(""))
    )


FIXTURE = "struct<kind:string,name:string,path:string,bytes:bigint,features:array<string>>"


def scan_manifest(spark: SparkSession, path: str) -> DataFrame:
    """``{"fixtures": [...]}`` or ``{"fixtures": {path: {...}}}`` → one row per fixture.

    In the map form the path is the key, the name its last part and the kind its
    first part unless the entry says otherwise.
    """
    text = spark.read.text(path, wholetext=True)
    return parse_manifest(text.withColumnRenamed("value", "json"))


def parse_manifest(manifests: DataFrame) -> DataFrame:
    raw = F.get_json_object("json", "$.fixtures")
    tagged = manifests.withColumn("raw", raw)
    listed = tagged.where(F.col("raw").startswith("[")).select(
        F.explode(F.from_json("raw", f"array<{FIXTURE}>")).alias("f")
    ).select("f.*")
    mapped = tagged.where(F.col("raw").startswith("{")).select(F.explode(F.from_json("raw", f"map<string,{FIXTURE}>")).alias("key", "f"))
    mapped = mapped.select(
        F.coalesce("f.kind", F.split_part("key", F.lit("/"), F.lit(1))).alias("kind"),
        F.coalesce("f.name", F.regexp_extract("key", "[^/]*$", 0)).alias("name"),
        F.col("key").alias("path"),
        F.col("f.bytes").alias("bytes"),
        F.col("f.features").alias("features"),
    )
    return listed.unionByName(mapped)
