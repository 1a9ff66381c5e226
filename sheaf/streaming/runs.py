"""Running a stream to the end of what is there, into a table others can read."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """State on local disk with a log in the shared folder, not on the heap."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class ClosingTicks:
    """A second source of a stream, with rows that are null but for their time.

    Operators that wait for the watermark keep the last events; a tick sent after them
    says that nothing before it will come any more.
    """

    def __init__(self, stream: DataFrame, ts: str = "ts"):
        self.spark, self.ts = stream.sparkSession, ts
        self.path = f"{checkpoint_dir(self.spark)}/ticks-{uuid.uuid4().hex}"
        self.schema = stream.schema
        self.spark.createDataFrame([], self.schema).write.parquet(self.path)
        self.stream = stream.unionByName(self.spark.readStream.schema(self.schema).parquet(self.path))

    def send(self, at: datetime) -> None:
        nulls = [F.lit(at).cast(f.dataType).alias(f.name) if f.name == self.ts else F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema]
        self.spark.range(1).select(*nulls).write.mode("append").parquet(self.path)


def run_available(stream: DataFrame, name: str, mode: str = "append", ticks: ClosingTicks | None = None, until: datetime | None = None) -> DataFrame:
    """Process everything available once, exactly once, into parquet; read it back.

    With ``ticks`` the query is started again from its checkpoint after a tick at
    ``until``, which lets out what waits for the watermark.
    """
    spark = stream.sparkSession
    root = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    for last in (False, True) if ticks else (True,):
        query = (
            stream.writeStream.format("parquet")
            .outputMode(mode)
            .option("path", f"{root}/out")
            .option("checkpointLocation", f"{root}/log")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
        if not last:
            ticks.send(until)
    return spark.read.schema(stream.schema).parquet(f"{root}/out")
