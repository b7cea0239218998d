"""Connected components of a table of edges, by alternating star contraction.

Each round is two grouped minima: every node points its larger neighbours, then its smaller ones, at
the smallest node it knows.  The tables stay in Spark; the driver only compares two numbers to see
whether a round changed anything.  Every round is stored in the shared folder.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from guardframe.llm.common import discard, map_arrow, materialize

MOST_ROUNDS = 60


def fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def forest(edges: DataFrame) -> DataFrame:
    """Fewer edges (a, b), batch by batch, that connect what ``edges`` do: each node and the least of its batch."""

    def run(batch: pa.RecordBatch):
        up: dict[int, int] = {}

        def top(x: int) -> int:
            while (to := up.setdefault(x, x)) != x:
                up[x] = up[to] if to in up else to
                x = to
            return x

        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            a, b = top(a), top(b)
            if a != b:
                up[max(a, b)] = min(a, b)
        pairs = [(x, top(x)) for x in list(up)]
        yield {"a": [x for x, y in pairs if x != y], "b": [y for x, y in pairs if x != y]}

    dealt = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").repartition("a").sortWithinPartitions("a")
    return map_arrow(dealt, run, T.StructType.fromDDL("a long, b long"))


def large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node reachable) for every node of the edges (a, b); no self loops.

    Repeated edges and either direction are fine; an empty table gives no rows.
    """
    now = materialize(forest(edges).distinct(), "edges")
    mark = fingerprint(now)
    for _ in range(MOST_ROUNDS):
        if not mark[0]:
            break
        before, now = now, materialize(small_star(large_star(now)), "edges")
        new = fingerprint(now)
        discard(before)
        if new == mark:
            break
        mark = new
    else:
        raise RuntimeError("the components didn't settle")
    roots = now.select(F.col("b").alias("node")).distinct().withColumn("root", F.col("node"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
