"""Reading and writing tables, batch and streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

FORMATS = ("parquet", "orc", "json", "csv", "text")


def read(spark: SparkSession, path: str, name: str | None = None, source: str = "parquet", schema: str | None = None) -> DataFrame:
    """A table of a folder (``name``.parquet) or a path in any of FORMATS."""
    if source not in FORMATS:
        raise ValueError(f"unknown format {source!r}")
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.format(source).load(f"{path}/{name}.{source}" if name else path)


def read_stream(spark: SparkSession, path: str, schema: str | StructType, source: str = "parquet", files_per_batch: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).format(source).option("maxFilesPerTrigger", files_per_batch).load(path)


def write(df: DataFrame, path: str, source: str = "parquet", mode: str = "errorifexists", partition_by: tuple[str, ...] = ()) -> None:
    df.write.format(source).mode(mode).partitionBy(*partition_by).save(path)


def write_stream(df: DataFrame, path: str, checkpoint: str, source: str = "parquet") -> StreamingQuery:
    """Write what is there now and stop; calling it again goes on from the checkpoint."""
    return df.writeStream.format(source).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)


def audit_stream(df: DataFrame, path: str, checkpoint: str, where: str = "detection.detected") -> StreamingQuery:
    """Detected rows (or those ``where``: "leaked") to an audit table, batch by batch; a repeated batch overwrites its own folder."""

    def sink(batch: DataFrame, number: int) -> None:
        batch.filter(where).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return df.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
