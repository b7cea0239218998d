"""Helpers shared by the corpus operators: tables, shared storage, Arrow plumbing."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

CHECKPOINT_KEY = "spark.checkpoint.dir"
BATCH_KEY, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Let what goes to Python at once be bounded by bytes, where the session doesn't set it: ten thousand
    rows, the bound otherwise, are gigabytes where texts are long."""
    if spark.conf.get(BATCH_KEY, None) is None:
        spark.conf.set(BATCH_KEY, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables, read by Spark only (any file system it knows)."""
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Where the setting is absent and all runs on one machine (tests), a temporary folder is set for the session.
    """
    where = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if not where:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise ValueError(f"{CHECKPOINT_KEY} must name a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="guardframe-")
        spark.conf.set(CHECKPOINT_KEY, where)
    return where.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/guardframe-{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return the table read back.

    This cuts the lineage: a lost executor costs a reread of files, not a recomputation.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.work_path = path
    return back


def discard(*tables: DataFrame | None) -> None:
    """Remove work tables that ``materialize`` stored, once nothing that is still to be read depends on them.

    Shuffle files go when the driver's JVM collects the plans that made them; it is asked to here, else the
    files of many short jobs stay for half an hour.
    """
    stored = [t for t in tables if getattr(t, "work_path", None)]
    for t in stored:
        jvm = t.sparkSession.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(t.work_path)
        where.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    if stored:
        gc.collect()
        jvm.System.gc()


def free_name(taken: list[str], wish: str) -> str:
    """``wish``, or ``wish`` with underscores in front, so that no column of the input clashes."""
    low = {t.lower() for t in taken}
    while wish.lower() in low:
        wish = "_" + wish
    return wish


#: What this worker process keeps between tasks: the module it belongs to, and how to let go of it.
_KEPT: dict[str, Callable] = {}


def kept_by(module: str, clear: Callable) -> None:
    """Note that tasks of ``module`` keep something in this worker, which ``clear`` drops."""
    _KEPT[module] = clear


def only_for(module: str) -> None:
    """Drop what tasks of other operators have kept: workers serve one stage after another."""
    for other in [m for m in _KEPT if m != module]:
        _KEPT.pop(other)()


def give_back() -> None:
    """Return freed memory to the system, for Arrow's pool and for the C library where it can."""
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def map_arrow(df: DataFrame, fn: Callable, schema: T.StructType) -> DataFrame:
    """``mapInArrow`` with a function from a record batch to an iterator of dicts of arrays.

    The target Arrow types come from ``schema``; ``fn`` gets one batch at a time.  A worker keeps nothing of
    other operators meanwhile, and gives memory back at the end of its task.
    """
    bound_batches(df.sparkSession)
    arrow, module = to_arrow_schema(schema), fn.__module__

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only_for(module)
        for batch in batches:
            if batch.num_rows:
                for out in fn(batch):
                    yield to_batch(out, arrow)
        give_back()

    return df.mapInArrow(run, schema)


def to_batch(columns: dict, arrow: pa.Schema) -> pa.RecordBatch:
    made = []
    for field in arrow:
        x = columns[field.name]
        if not isinstance(x, (pa.Array, pa.ChunkedArray)):
            x = pa.array(x, type=field.type)
        elif isinstance(x, pa.ChunkedArray):
            x = x.combine_chunks()
        made.append(x if x.type == field.type else x.cast(field.type))
    return pa.RecordBatch.from_arrays(made, schema=arrow)


def blocks(batch: pa.RecordBatch, column: str, max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose ``column`` holds about ``max_bytes`` each (one row at least)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > max_bytes:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield batch.slice(start)


def few(rows: DataFrame, most: int = 1_000_000, weight: Column | None = None) -> DataFrame:
    """Marked for broadcast if there are at most ``most`` rows, of a sum of ``weight`` of at most that too if
    it is given; else joined by shuffle."""
    sizes = rows.agg(F.count("*").alias("n"), F.sum(weight if weight is not None else F.lit(0)).alias("w")).first()
    return F.broadcast(rows) if max(sizes["n"], sizes["w"] or 0) <= most else rows


def row_key(df: DataFrame, id_col: str) -> tuple[DataFrame, str]:
    """``df`` with a column that is unique and never null, and its name.

    That is the id itself where a count shows so; else the rows are stored with numbers of their own,
    which follow the ids (nulls first), and among equal ids a hash of the text, then the text.
    """
    sizes = df.agg(F.count("*").alias("n"), F.count(id_col).alias("ids")).first()
    if sizes["n"] == sizes["ids"] == df.select(id_col).distinct().count():
        return df, id_col
    name = free_name(df.columns, "_gf_row")
    mark = free_name([*df.columns, name], "_gf_mark")
    ordered = df.withColumn(mark, F.xxhash64("text")).repartitionByRange(id_col, mark).sortWithinPartitions(id_col, mark, "text").drop(mark)
    return materialize(ordered.withColumn(name, F.monotonically_increasing_id()), "rows"), name
