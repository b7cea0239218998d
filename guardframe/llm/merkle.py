"""Merkle manifest of a dataset by time-forward processing.

Rows become leaves, leaves of one group a binary tree, and the groups' roots a tree above.  A node's label is its
tree, level and place.  Digests travel to later labels as messages: Spark's sorted exchange is the external
priority queue between blocks of 2**BITS nodes, which it delivers in order of their labels, and within a block a
heap of its messages delivers the rest.  Each round so lifts all trees by BITS levels, and stores the nodes.  The
reversed sweep goes back over what is stored: each block receives the marks and siblings above it and delivers
them, with its own, to the nodes below, down to the leaves.  No task holds more than a block, so a group of
any size is spread, and the driver sees the last root and sizes only.

A digest is the sha256 of hexadecimal digests joined; a last node without a sibling is hashed alone.  A proof
is the siblings from leaf to root; ``marks`` tells on which side each stands (L, R) or that there is none (-).

Defined cases: null values are written as such and differ from empty ones; a null group comes first; equal
ids are ordered by leaf, and equal leaves are interchangeable; an empty table has no root and gives no rows;
columns that aren't named, clashing or not, don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from guardframe.llm.common import few, map_arrow, materialize

BITS = 12  # levels of a block
NODE = "tree string, pos long, n long, digest binary"
PATH = "tree string, pos long, digest binary, marks string, proof binary, subroot binary"


def parent(*children: bytes) -> bytes:
    return sha256("".join(c.hex() for c in children).encode()).digest()


def written(value: Column) -> Column:
    """A value of a leaf: '-' for null, else its number of bytes, ':' and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(values: list[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*map(written, values)), 256))


def tree_key(group: Column) -> Column:
    """Text that is never null and sorts as groups do: null first, then by bytes."""
    return F.when(group.isNull(), F.lit("")).otherwise(F.concat(F.lit("+"), group.cast("string")))


def height(n: int, bits: int) -> int:
    """Levels above the nodes of a block, of a tree that has ``n`` nodes on this level."""
    return min(bits, (n - 1).bit_length())


def lift(digests: list[bytes], levels: int) -> list[list[bytes]]:
    """The digests of a block, level by level."""
    out: list[list[bytes]] = [[] for _ in range(levels + 1)]
    queue = [(0, i, d) for i, d in enumerate(digests)]
    while queue:
        level, i, digest = heappop(queue)
        out[level].append(digest)
        if level < levels:
            run = [digest]
            if queue and queue[0][:2] == (level, i + 1):
                run.append(heappop(queue)[2])
                out[level].append(run[1])
            heappush(queue, (level + 1, i // 2, parent(*run)))
    return out


def lower(levels: list[list[bytes]], marks: str, proof: bytes) -> list[tuple[str, bytes]]:
    """Marks and proof of each node of a block's lowest level, from those of its top."""
    queue, out = [(1 - len(levels), 0, marks, proof)], []
    while queue:
        level, i, marks, proof = heappop(queue)
        if not level:
            out.append((marks, proof))
            continue
        below, a = levels[-level - 1], 2 * i
        if a + 1 < len(below):
            heappush(queue, (level + 1, a, "R" + marks, below[a + 1] + proof))
            heappush(queue, (level + 1, a + 1, "L" + marks, below[a] + proof))
        else:
            heappush(queue, (level + 1, a, "-" + marks, proof))
    return out


def fold(digest: bytes, marks: str, proof: bytes) -> bytes:
    """The root that a leaf's digest and its proof lead to."""
    at = 0
    for mark in marks:
        if mark == "-":
            digest = parent(digest)
        else:
            other = proof[at : at + 32]
            digest, at = parent(digest, other) if mark == "R" else parent(other, digest), at + 32
    return digest


def by_block(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[list[tuple]]:
    """Rows (the first two columns are tree and block) of one block after another; they arrive sorted."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
            if held and held[0][:2] != row[:2]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def record(rows: list[tuple], types: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), types, strict=True)], schema=types)


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` (tree, digest, ...) with ``pos``, the place within the tree by ``order``, and ``n``, the tree's size.

    Rows are sorted over all partitions; only their numbers by tree and partition are summed up.
    """
    keys = ["tree", *order, "digest", "_gf_tie"]
    dealt = rows.withColumn("_gf_tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_gf_tie")
    made = materialize(dealt.withColumns({"_gf_part": F.spark_partition_id(), "_gf_no": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}), "ordered")
    counts = made.groupBy("tree", "_gf_part").agg(F.count("*").alias("rows"), F.min("_gf_no").alias("first"))
    before = Window.partitionBy("tree").orderBy("_gf_part").rowsBetween(Window.unboundedPreceding, -1)
    places = counts.select("tree", "_gf_part", (F.coalesce(F.sum("rows").over(before), F.lit(0)) - F.col("first")).alias("_gf_shift"), F.sum("rows").over(Window.partitionBy("tree")).alias("n"))
    places = materialize(places, "places")
    return made.join(few(places), ["tree", "_gf_part"]).withColumn("pos", F.col("_gf_no") + F.col("_gf_shift")).drop("_gf_part", "_gf_no", "_gf_shift")


def lifted(nodes: DataFrame, bits: int) -> DataFrame:
    """The nodes ``bits`` levels above (or of the root, where it comes first)."""
    schema = T.StructType.fromDDL(NODE)
    types = pa.schema([("tree", pa.string()), ("pos", pa.int64()), ("n", pa.int64()), ("digest", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for rows in by_block(batches, ["tree", "block", "n", "digest"]):
            tree, block, n, _ = rows[0]
            out.append((tree, block, -(-n >> bits) if n > 1 << bits else 1, lift([r[3] for r in rows], height(n, bits))[-1][0]))
            if len(out) >= 1000:
                yield record(out, types)
                out = []
        if out:
            yield record(out, types)

    dealt = nodes.select("tree", F.shiftright("pos", bits).alias("block"), "pos", "n", "digest").repartition("tree", "block").sortWithinPartitions("tree", "block", "pos")
    return dealt.mapInArrow(run, schema)


def lowered(nodes: DataFrame, above: DataFrame, bits: int, keep: list[str]) -> DataFrame:
    """PATH and ``keep`` of ``nodes``, from the PATH of the nodes ``bits`` levels above."""
    kept = [nodes.schema[c] for c in keep]
    schema = T.StructType([*T.StructType.fromDDL(PATH), *kept])
    block = F.shiftright("pos", bits).alias("block")
    below = nodes.select("tree", block, "pos", "n", "digest", F.lit(None).cast("string").alias("marks"), F.lit(None).cast("binary").alias("proof"), F.lit(None).cast("binary").alias("subroot"), *keep)
    message = above.select("tree", F.col("pos").alias("block"), F.lit(-1).cast("long").alias("pos"), F.lit(0).cast("long").alias("n"), F.lit(None).cast("binary").alias("digest"), "marks", "proof", "subroot", *(F.lit(None).cast(f.dataType).alias(f.name) for f in kept))
    dealt = message.unionByName(below).repartition("tree", "block").sortWithinPartitions("tree", "block", "pos")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types, out = to_arrow_schema(schema), []
        for (head, *rows) in by_block(batches, ["tree", "block", "pos", "n", "digest", "marks", "proof", "subroot", *keep]):
            paths = lower(lift([r[4] for r in rows], height(rows[0][3], bits)), head[5], head[6])
            out += [(r[0], r[2], r[4], marks, proof, head[7], *r[8:]) for r, (marks, proof) in zip(rows, paths, strict=True)]
            if len(out) >= 1000:
                yield record(out, types)
                out = []
        if out:
            yield record(out, types)

    return dealt.mapInArrow(run, schema)


@dataclass
class Manifest:
    """Stored nodes of the groups' trees and of the tree above, lowest first, and the root (None of no rows)."""

    trees: list[DataFrame]
    tops: list[DataFrame]
    root: str | None
    bits: int = BITS


def rounds(nodes: DataFrame, bits: int, name: str) -> list[DataFrame]:
    """``nodes`` and what each round makes of them, until every tree is one node."""
    out = [nodes]
    while len(out) < 2 or out[-1].filter("n > 1").take(1):
        out.append(materialize(lifted(out[-1], bits), name))
    return out


def build(df: DataFrame, columns: list[str], group_col: str = "lang", id_col: str = "doc_id", claimed: Column | None = None, bits: int = BITS) -> Manifest:
    """The manifest of ``df``: leaves of ``columns``, by group and id.

    The lowest table of ``trees`` has the id and, if ``claimed`` is given, that leaf besides, for ``verified``.
    """
    made = df.select(tree_key(F.col(group_col)).alias("tree"), F.col(id_col).alias("_gf_id"), leaf([F.col(c) for c in columns]).alias("digest"), *([] if claimed is None else [claimed.alias("claimed")]))
    if claimed is not None:
        made = made.withColumn("claimed", F.coalesce("claimed", "digest"))
    trees = rounds(materialize(numbered(materialize(made, "leaves"), ["_gf_id"]), "nodes"), bits, "nodes")
    roots = trees[-1].select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest")
    tops = rounds(materialize(numbered(roots, ["name"]), "tops"), bits, "tops")
    top = tops[-1].first()
    return Manifest(trees, tops, top["digest"].hex() if top else None, bits)


def proofs(made: Manifest, keep: list[str] | None = None) -> DataFrame:
    """doc_id (and ``keep``), leaf, tree, pos, marks, proof and subroot of every row."""
    first = made.tops[-1].select("tree", "pos", "digest", F.lit("").alias("marks"), F.lit(b"").alias("proof"), F.col("digest").alias("subroot"))
    for nodes in made.tops[-2::-1]:
        first = materialize(lowered(nodes, first, made.bits, ["name"] if "name" in nodes.columns else []), "paths")
    path = first.select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("pos"), "digest", "marks", "proof", F.col("digest").alias("subroot"))
    for nodes in made.trees[:0:-1][1:]:
        path = materialize(lowered(nodes, path, made.bits, []), "paths")
    out = lowered(made.trees[0], path, made.bits, ["_gf_id", *(keep or [])])
    return out.withColumnsRenamed({"_gf_id": "doc_id", "digest": "leaf"})


def verified(rows: DataFrame, root: str | None) -> DataFrame:
    """``rows`` (of ``proofs`` with ``claimed``) as a report in hexadecimal: proof_sha256, folded_root and verified."""
    kind = rows.schema["doc_id"]
    schema = T.StructType([kind, *T.StructType.fromDDL("leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")])

    def run(batch: pa.RecordBatch):
        column = lambda c: batch.column(c).to_pylist()
        folded = [fold(*x).hex() for x in zip(column("claimed"), column("marks"), column("proof"), strict=True)]
        yield {
            "doc_id": batch.column("doc_id"), "leaf": [x.hex() for x in column("leaf")], "subroot": [x.hex() for x in column("subroot")], "root": [root] * len(folded),
            "proof_sha256": [sha256(x.hex().encode()).hexdigest() for x in column("proof")], "folded_root": folded, "verified": [x == root for x in folded],
        }

    return map_arrow(rows, run, schema)
