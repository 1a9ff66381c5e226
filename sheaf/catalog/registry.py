"""Query registry: one Spark callable per operator, next to its oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Tables whose rows fan out (lines, words, cells).
SPREAD_KEYS = {"documents": "doc_id", "pages": "page_id"}
SPREAD = "spark.sheaf.spreadPartitions"


def wide_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """``table``, spread by key over as many partitions as the session asks for.

    Unset or 0 (the default): one task per split, nothing is shuffled.  ``local_session``
    sets it, since one small file is one split there.
    """
    df = table(spark, sf_dir, name)
    partitions = int(spark.conf.get(SPREAD, "0"))
    return df.repartition(partitions, SPREAD_KEYS[name]) if partitions else df
