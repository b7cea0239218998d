"""Tables replayed as streams, for the queries on streaming operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from guardframe.sources.tables import read_stream, write, write_stream
from guardframe.streaming.ordered import stateful

FOLDER = "spark.checkpoint.dir"
PARTITIONS = "spark.sql.shuffle.partitions"


def work_folder(spark: SparkSession) -> str:
    """A fresh folder below the one that all executors share; a temporary one where all runs on one machine."""
    where = spark.conf.get(FOLDER, None) or spark.sparkContext.getConf().get(FOLDER)
    if not where:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError(f"{FOLDER} must name a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="guardframe-")
        spark.conf.set(FOLDER, where)
    return f"{where.rstrip('/')}/replay-{uuid.uuid4().hex}"


def replayed(df: DataFrame, make: Callable[[DataFrame], DataFrame], files_per_batch: int = 1 << 20) -> DataFrame:
    """What the stream ``make`` gives for all rows of ``df``: written, streamed to its end, and read back.

    The stream has a session of its own, so that its settings don't reach the caller's.
    """
    spark, where = df.sparkSession, work_folder(df.sparkSession)
    write(df, f"{where}/in")
    session = stateful(spark.newSession())
    session.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    session.conf.set(PARTITIONS, spark.conf.get(PARTITIONS))
    out = make(read_stream(session, f"{where}/in", df.schema, files_per_batch=files_per_batch))
    write_stream(out, f"{where}/out", f"{where}/state").awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{where}/out")
