"""N-gram Jaccard join by parity sketches; exact up to collisions of 64-bit hashes of shingles.

A document's set are its distinct word shingles.  Documents with equal sets form a class; only one of
them goes on.  Each class XORs its shingles' hashes into a bit sketch: a shingle flips one bit, so the
Hamming distance of two sketches never exceeds the symmetric difference of their sets.  Within a band
of sizes the difference of a linked pair is at most d, so of d + 1 chunks of the sketch one at least is
equal: classes are joined on (band, chunk, bits).  What meets is checked with a folded sketch of 512
bits first, then with the whole sets.

Buckets are worked in rounds.  First a few centres, drawn by hash, meet all other members; links make
components; then only buckets whose members are still in several components go on, with more centres.
So a group of thousands of near copies costs a few pairs for each member rather than all pairs.  What is
still apart in a large bucket shares a chunk without being similar, as texts made from one template do.
Members of such buckets meet in a last round by their rarest shingles instead (prefix filtering: of two
similar sets the rarest n - ceil(p n) + 1 shingles of each have one in common, in any order of rarity that
both share), where members of each bucket's largest component don't meet each other.  No link between
components is lost.

Defined cases: null and empty texts have an empty set, ``n_shingles`` 0, and are linked with nothing;
texts of fewer words than a shingle are one shingle; repeated rows and repeated ids are rows like
others (equal sets are linked); a null id takes part in links, and its ``component_id`` is the smallest
id reachable (null if there is none); empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from guardframe.llm.common import blocks, discard, few, map_arrow, materialize
from guardframe.llm.components import components
from guardframe.llm.words import Block, mix, sequences

SHINGLE = 3
PERCENT = 90
FOLD = 8  # 64-bit words of the folded sketch
GROWTH = 1.25  # of the sizes in a band
SPARE = 1.5  # chunks for each that is needed
CENTRES = (4, 64)  # centres of a bucket in each round, before that by rarest shingles
RARITY = 1 << 16  # cells of the histogram by which shingles are rare or common: 512 kB
REDUCERS = 16
SALT = np.uint64(0x632BE59BD9B4E019)
LONGS = T.ArrayType(T.LongType())
SETS = T.StructType([*(T.StructField(c, T.LongType()) for c in ("doc_id", "n", "s1", "s2")), T.StructField("sketch", LONGS), T.StructField("keys", LONGS)])


def shingle_hashes(block: Block, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of a block, and the place of each document's first (and the end)."""
    words = block.word_hashes()
    count = np.where(block.count >= size, block.count - size + 1, np.minimum(block.count, 1))
    at = np.concatenate([[0], np.cumsum(count)])
    doc = np.repeat(np.arange(block.n), count)
    start = block.first[:-1][doc] + np.arange(at[-1]) - at[:-1][doc]
    end = np.minimum(start + size, block.first[1:][doc])
    return sequences(words, start, end - start, size), at


@lru_cache(maxsize=4)
def band_edges(percent: int) -> list[int]:
    """Smallest sizes of the bands, up to sets of a thousand million shingles."""
    out = [1]
    while out[-1] < 10**9:
        out.append(max(out[-1] + 1, int(out[-1] * GROWTH)))
    return out


def chunk_count(band: int, percent: int) -> int:
    """Chunks of a band: one more than the largest symmetric difference of a linked pair.

    With I >= p U: a + b = U + I >= (1 + p) U, and the difference U - I is at most (1 - p) U.
    """
    most = band_edges(percent)[band + 1] - 1
    pair = most + most * 100 // percent
    return pair * (100 - percent) // (100 + percent) + 1


def bands_of(n: int, percent: int) -> list[int]:
    """The band of a size, and the one below if a linked partner may be in it."""
    edges = band_edges(percent)
    band = int(np.searchsorted(edges, n, side="right")) - 1
    lower = band > 0 and n <= (edges[band] - 1) * 100 // percent
    # where no difference is allowed at all, linked sets are equal and so are in one class already
    return [b for b in ([band, band - 1] if lower else [band]) if chunk_count(b, percent) > 1]


def parity(h: np.ndarray, chunks: int) -> np.ndarray:
    """The sketch: bit (hash mod 64 chunks) flipped by each shingle, as 64-bit words."""
    bits = np.bincount((h % np.uint64(64 * chunks)).astype(np.int64), minlength=64 * chunks)
    return np.packbits((bits & 1).astype(np.uint8), bitorder="little").view("<u8")


def chunk_keys(h: np.ndarray, percent: int) -> np.ndarray:
    """Keys of a set (sorted hashes) under which a linked set is found.

    Shingles are dealt to SPARE times as many chunks as needed and XORed there.  A pair within the bound
    d differs in d chunks at most; so of each set's chunks in one order that depends on their content
    alone, the first d + 1 suffice (prefix filtering).  Fullest first: chunks of no or few shingles,
    which unrelated sets share by chance, are left out.
    """
    out = [np.empty(0, np.uint64)]
    sums = np.concatenate([[np.uint64(0)], np.bitwise_xor.accumulate(h)])
    for band in bands_of(len(h), percent):
        need = chunk_count(band, percent)
        chunks = int(need * SPARE)
        at = np.searchsorted((h >> np.uint64(32)) * np.uint64(chunks) >> np.uint64(32), np.arange(chunks + 1))
        place = (np.uint64(band) << np.uint64(40)) + np.arange(chunks, dtype=np.uint64)
        key = mix(mix(place * SALT + np.uint64(1)) ^ sums[at[1:]] ^ sums[at[:-1]])
        out.append(key[np.lexsort((key, -np.diff(at)))[:need]])
    return np.concatenate(out)


def describe(df: DataFrame, id_col: str, text_col: str, size: int, percent: int) -> DataFrame:
    """A row of SETS for each document: size and two checksums of its set, sketch and chunk keys."""

    def run(batch: pa.RecordBatch):
        for part in blocks(batch, "_gf_text", 1 << 20):
            block = Block(part.column("_gf_text"), lower=True)
            hashes, at = shingle_hashes(block, size)
            n, s1, s2, sketch, keys = [], [], [], [], []
            for a, b in zip(at[:-1], at[1:], strict=True):
                h = np.unique(hashes[a:b])
                n.append(len(h))
                sums = checksums(h)
                s1.append(sums[0])
                s2.append(sums[1])
                sketch.append(parity(h // np.uint64(3), FOLD).view(np.int64))
                keys.append(chunk_keys(h, percent).view(np.int64))
            yield {"doc_id": part.column("doc_id"), "n": n, "s1": s1, "s2": s2, "sketch": lists(sketch), "keys": lists(keys)}

    work = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("_gf_text"))
    return map_arrow(work, run, SETS)


def lists(arrays: list[np.ndarray]) -> pa.Array:
    at = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([np.empty(0, np.int64), *arrays])))


def shared_buckets(classes: DataFrame) -> DataFrame:
    """key, cls for every chunk key that two classes or more have.

    Rows are sorted by key, so neighbours tell; a task streams and holds a batch at a time.
    """
    rows = classes.select(F.explode("keys").alias("key"), "cls").repartition("key").sortWithinPartitions("key")
    schema = T.StructType.fromDDL("key long, cls long")

    def run(batches):
        held = None  # the last row so far, and whether it was given out
        for batch in batches:
            if not batch.num_rows:
                continue
            key, cls = batch.column("key").to_numpy(), batch.column("cls").to_numpy()
            if held is not None:
                key, cls = np.concatenate([[held[0]], key]), np.concatenate([[held[1]], cls])
            same = np.zeros(len(key) + 1, bool)
            same[1:-1] = key[1:] == key[:-1]
            out = same[1:] | same[:-1]
            if held is not None and held[2]:
                out[0] = False
            given = bool(out[-1]) or (len(key) == 1 and held is not None and held[2])
            held = (key[-1], cls[-1], given)
            if out.any():
                yield pa.RecordBatch.from_arrays([pa.array(key[out]), pa.array(cls[out])], names=["key", "cls"])

    return rows.mapInArrow(run, schema)


def class_texts(df: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The text of the first document of each class of ``wanted`` (cls, first, n, s1, s2), read again."""
    key = F.coalesce(F.col("first"), F.lit(-(2**63)))
    ids = few(wanted.select(key.alias("_gf_id")).distinct())
    return df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("_gf_id"), F.col(text_col).alias("_gf_text")).join(ids, "_gf_id", "left_semi").select("_gf_text")


def sets_of(batch: pa.RecordBatch, size: int):
    """Lists of the sorted shingle hashes of each text, block by block."""
    for part in blocks(batch, "_gf_text", 1 << 20):
        hashes, at = shingle_hashes(Block(part.column("_gf_text"), lower=True), size)
        yield [np.unique(hashes[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]


def checksums(h: np.ndarray) -> tuple[int, int]:
    return (int(h.sum().view(np.int64)), int(mix(h ^ SALT).sum().view(np.int64))) if len(h) else (0, 0)


def by_class(made: DataFrame, wanted: DataFrame, name: str) -> DataFrame:
    """cls and ``name`` from rows with n, s1, s2 and ``name``."""
    return made.join(wanted.select("cls", "n", "s1", "s2"), ["n", "s1", "s2"]).groupBy("cls").agg(F.first(name).alias(name))


def fetch_sets(df: DataFrame, wanted: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """cls, set (sorted shingle hashes) for the classes of ``wanted``."""
    schema = T.StructType.fromDDL("n long, s1 long, s2 long, set array<long>")

    def run(batch: pa.RecordBatch):
        for sets in sets_of(batch, size):
            sums = [checksums(x) for x in sets]
            yield {"n": [len(x) for x in sets], "s1": [a for a, _ in sums], "s2": [b for _, b in sums], "set": lists([x.view(np.int64) for x in sets])}

    return by_class(map_arrow(class_texts(df, wanted, id_col, text_col), run, schema), wanted, "set")


def rare_keys(df: DataFrame, wanted: DataFrame, id_col: str, text_col: str, size: int, percent: int) -> DataFrame:
    """key, cls: the rarest shingles of each class, as many as a linked set must share one of.

    Rarity is told by a histogram of fixed size, so what is broadcast doesn't grow with the data.
    """
    texts = class_texts(df, wanted, id_col, text_col)

    def count(batches):
        total = np.zeros(RARITY, np.int64)
        for batch in batches:
            for sets in sets_of(batch, size) if batch.num_rows else ():
                total += np.bincount((np.concatenate(sets) % np.uint64(RARITY)).astype(np.int64), minlength=RARITY)
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], names=["cells"])

    def add(batches):
        total = np.zeros(RARITY, np.int64)
        for batch in batches:
            for cells in batch.column("cells"):
                total += np.frombuffer(cells.as_py(), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], names=["cells"])

    # a histogram of each task, of all that REDUCERS tasks add up, and of all
    sums = texts.mapInArrow(count, "cells binary").repartition(REDUCERS).mapInArrow(add, "cells binary").collect()
    histogram = np.sum([np.frombuffer(r["cells"], np.int64) for r in sums], axis=0)
    sent = df.sparkSession.sparkContext.broadcast(histogram)

    def keys(batch: pa.RecordBatch):
        for sets in sets_of(batch, size):
            sums, rare = [checksums(x) for x in sets], []
            for x in sets:
                order = np.lexsort((x, sent.value[(x % np.uint64(RARITY)).astype(np.int64)]))
                rare.append(x[order[: len(x) - -(-percent * len(x) // 100) + 1]].view(np.int64))
            yield {"n": [len(x) for x in sets], "s1": [a for a, _ in sums], "s2": [b for _, b in sums], "keys": lists(rare)}

    made = map_arrow(texts, keys, T.StructType.fromDDL("n long, s1 long, s2 long, keys array<long>"))
    return by_class(made, wanted, "keys").select(F.explode("keys").alias("key"), "cls")


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""
    both = pairs.join(sets.select(F.col("cls").alias("a"), F.col("set").alias("_gf_x")), "a").join(sets.select(F.col("cls").alias("b"), F.col("set").alias("_gf_y")), "b")
    both = both.withColumn("_gf_i", F.size(F.array_intersect("_gf_x", "_gf_y")))
    return both.filter(f"100 * _gf_i >= {percent} * (size(_gf_x) + size(_gf_y) - _gf_i)").select("a", "b")


def drawn(rows: DataFrame, centres: int) -> DataFrame:
    """``rows`` (key, cls, size of the bucket, ...) with the column ``centre``.

    A bucket of at most ``centres`` members has all of them as centres, else they are drawn by hash.
    """
    lot = F.pmod(F.xxhash64("key", "cls"), F.lit(1 << 30))
    return rows.withColumn("centre", (F.col("size") <= centres) | (lot * F.col("size") < centres * (1 << 30)))


def candidates(marked: DataFrame, percent: int, apart: bool) -> DataFrame:
    """Pairs a < b of a centre and a member of its bucket that the folded sketches leave possible.

    ``marked``: key, cls, n, sketch, root, centre.
    """
    x = marked.filter("centre").select("key", *(F.col(c).alias(f"x_{c}") for c in ("cls", "n", "sketch", "root")))
    y = marked.select("key", *(F.col(c).alias(f"y_{c}") for c in ("cls", "n", "sketch", "root", "centre")))
    d = " + ".join(f"bit_count(x_sketch[{i}] ^ y_sketch[{i}])" for i in range(FOLD))
    met = x.join(y, "key").filter("x_cls <> y_cls AND (x_cls < y_cls OR NOT y_centre)")
    met = met.filter(f"100 * least(x_n, y_n) >= {percent} * greatest(x_n, y_n) AND {100 + percent} * ({d}) <= {100 - percent} * (x_n + y_n)")
    if apart:
        met = met.filter("x_root <> y_root")
    return met.select(F.least("x_cls", "y_cls").alias("a"), F.greatest("x_cls", "y_cls").alias("b")).distinct()


def crowded(rows: DataFrame, least: int) -> DataFrame:
    """key, size of the buckets of more than ``least`` members that are in several components."""
    sizes = rows.groupBy("key").agg(F.count("*").alias("size"), F.min("root").alias("least"), F.max("root").alias("most"))
    return materialize(sizes.filter((F.col("least") != F.col("most")) & (F.col("size") > least)).select("key", "size"), "sizes")


def but_largest(rows: DataFrame) -> DataFrame:
    """Rows (key, cls, root) of buckets with several components, with ``centre`` false for the largest one."""
    counts = rows.groupBy("key", "root").agg(F.count("*").alias("n"))
    largest = counts.groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("largest"), F.count("*").alias("roots")).filter("roots > 1")
    return rows.join(largest, "key").withColumn("centre", F.col("root") != F.col("largest")).drop("largest", "roots")


def link(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, class_id and component_id of every row of ``df``.

    ``class_id`` numbers the documents with equal sets; ``component_id`` is the smallest id that links
    lead to.
    """
    described = materialize(describe(df, id_col, text_col, size, percent), "sets")
    grouped = described.filter("n > 0").groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("first"), F.first("sketch").alias("sketch"), F.first("keys").alias("keys"))
    keyed = materialize(grouped.withColumn("cls", F.monotonically_increasing_id()), "classes")
    # sketches and keys are most of what is stored: they go as soon as the next table has what it needs of them
    sizes_of = materialize(described.select("doc_id", "n", "s1", "s2"), "sizes")
    discard(described)
    buckets = materialize(shared_buckets(keyed), "buckets")
    classes = materialize(keyed.drop("keys"), "classes")
    discard(keyed)
    facts = classes.select("cls", "n", "sketch")
    roots = known = tried = sets = None
    stored: list[DataFrame] = []

    def rooted(rows: DataFrame) -> DataFrame:
        if roots is None:
            return rows.withColumn("root", F.col("cls"))
        return rows.join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))

    def work(marked: DataFrame) -> None:
        """Check the candidates of a round and bring links and components up to date."""
        nonlocal roots, known, tried, sets
        pairs = candidates(marked, percent, apart=tried is not None)
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = materialize(pairs, "pairs")
        stored.append(pairs)
        tried = pairs if tried is None else tried.unionByName(pairs)
        ends = pairs.select(F.col("a").alias("cls")).union(pairs.select(F.col("b").alias("cls"))).distinct()
        wanted = classes.join(ends, "cls", "left_semi").select("cls", "first", "n", "s1", "s2")
        new = materialize(wanted if known is None else wanted.join(known, "cls", "left_anti"), "wanted")
        got = materialize(fetch_sets(df, new, id_col, text_col, size), "members")
        stored.extend((new, got))
        sets = got if known is None else sets.unionByName(got)
        known = new.select("cls") if known is None else known.union(new.select("cls"))
        found = materialize(verify(pairs, sets, percent), "links")
        stored.append(found)
        known_links = None if roots is None else roots.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
        roots = components(found if known_links is None else known_links.union(found))

    rows = rooted(buckets)
    for turn, centres in enumerate(CENTRES):
        sizes = crowded(rows, CENTRES[turn - 1] if turn else 1)  # smaller buckets had all their pairs tried
        if turn and not sizes.take(1):
            break
        members = materialize(rows.join(sizes, "key").join(facts, "cls"), "members")
        work(drawn(members, centres))
        discard(members, sizes)
        rows = rooted(buckets)
    left = crowded(rows, CENTRES[-1])
    if left.take(1):
        members = rows.join(left.select("key"), "key", "left_semi").select("cls").distinct()
        wanted = materialize(classes.join(members, "cls", "left_semi").select("cls", "first", "n", "s1", "s2"), "wanted")
        rare = materialize(rare_keys(df, wanted, id_col, text_col, size, percent), "rare")
        members = materialize(but_largest(rooted(rare)).join(facts, "cls"), "members")
        work(members)
        discard(wanted, rare, members)
    least = classes.select("cls", "n", "s1", "s2", "first").join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    least = materialize(least, "roots")
    smallest = materialize(least.groupBy("root").agg(F.min("first").alias("component")), "smallest")
    table = materialize(least.join(smallest, "root").select("n", "s1", "s2", "cls", "component"), "labels")
    discard(classes, buckets, least, smallest, *stored)
    out = sizes_of.join(table, ["n", "s1", "s2"], "left")
    own = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.col("cls").alias("class_id"), own.alias("component_id"))
