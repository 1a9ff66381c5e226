"""A corpus from raw documents to packed sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and
read again as the documents of the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.llm import common
from sheaf.llm.best_fit_packing import pack, pieces
from sheaf.llm.line_frequency import line_frequency
from sheaf.llm.queries import tokenizer_path
from sheaf.llm.similarity_sketch import keep_first
from sheaf.llm.suffix_dedup import remove_repeats
from sheaf.llm.weighted_mixing import mixed_rows

# Bytes of a repeated passage: 51 words take some 330 bytes at the median, few of them
# under 300.
PASSAGE = 300

# Suffix-array removal and packing have no SQL form; tests hold them against brute force.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are not depleted by frequent lines, without
    these lines; ``n_chars`` follows."""
    rest = line_frequency(docs, keep=tuple(docs.columns), rest="_rest").where("kept")
    new = {"text": F.col("_rest"), "n_chars": F.length("_rest").cast("long")}
    return rest.select(*[new[c].alias(c) if c in new else F.col(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return keep_first(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of repeated passages; ``n_chars`` follows."""
    rest = remove_repeats(docs, keep=tuple(c for c in docs.columns if c not in ("text", "n_chars")), length=PASSAGE, as_text=True)
    new = {"text": F.col("rest"), "n_chars": F.length("rest").cast("long")}
    return rest.select(*[new[c].alias(c) if c in new else F.col(c) for c in docs.columns])


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixed_rows(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences."""
    return pack(pieces(docs, tokenizer_path()), ["doc_id", "piece", "ids_crc32"])


STAGES = [
    ("quality rules", quality_rules),
    ("MinHash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("mixing to target weights", source_mix),
    ("best-fit packing", packed_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = common.stash(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
