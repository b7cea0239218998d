"""Token ids as ORC files: integer run-length encoding, row indexes, Bloom filters.

``encode`` turns texts into id lists, ``write_tokens`` stores them sorted by document id in ORC
(each column of integers is run-length encoded by the format; every stripe carries a row index and
a Bloom filter on ``doc_id``), ``read_tokens`` and ``lookup`` read them back, stripe-parallel and
with pruning from file, stripe and row-group metadata.

Defined cases: null and empty texts give the end id alone; a null document id sorts first and is
kept; rows of one id follow a hash of their text, then the text; repeated rows are all kept; an empty table gives an empty file set; other columns are ignored.

Encoding memo: a single space between two non-space characters always starts a new pre-token of
byte-level BPE, so a text may be cut in front of such spaces and each distinct piece be encoded
once by the library.  The memo has two generations, which go by turns, and ``MEMO_BYTES`` at most, so it
doesn't grow with the data.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from guardframe.llm.common import blocks, bound_batches, give_back, kept_by, new_path, only_for

END = 0
LATIN = "\u0250"
MEMO_BYTES = 144 << 20
PIECE_BYTES = 210  # of a piece, its ids and their place in the table
BLOCK = 4 << 20  # bytes encoded at once
MARKS = ".,;:!?|*%&$#()"
FILES = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("part", T.IntegerType()),
    T.StructField("local_start", T.LongType()), T.StructField("n_tokens", T.LongType()),
    T.StructField("ids", T.ArrayType(T.IntegerType(), False)),
])
#: White space other than single spaces and line ends between other characters.
UNEVEN = r"[\x00-\x09\x0b-\x1f\x7f-\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|[ \n][ \n]|^[ \n]|[ \n]$"
CUT = re.compile(r"(?<=\S) (?=\S)")
#: Letters below LATIN, for the pattern engine of Arrow.
LETTERS = "^[A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+$"


def strings(column: pa.Array) -> list[str]:
    return column.to_numpy(zero_copy_only=False).tolist()  # many times as fast as to_pylist


def as_objects(values: list) -> np.ndarray:
    out = np.empty(len(values), object)
    out[:] = values
    return out


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One for each worker process: its memo serves all tasks of this operator that run there."""
    kept_by(__name__, encoder.cache_clear)
    return Encoder(path)


class Encoder:
    """Texts to ids, with a memo of the pieces that come again.

    Texts are cut and their pieces numbered by Arrow, a block at a time; only distinct pieces are looked up,
    and the ids of a block are gathered by piece number.
    """

    def __init__(self, path: str, memo_bytes: int = MEMO_BYTES):
        from tokenizers import Tokenizer, models, pre_tokenizers

        self.tokenizer, self.limit, self.memo, self.old = Tokenizer.from_file(path), memo_bytes // 2, {}, {}
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.width = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, i in vocab.items():
            self.width[i] = len(token)  # a character of a token stands for a byte
        # the same merges over words that are byte characters already, parted by spaces
        plain = json.loads(self.tokenizer.to_str())["model"]
        self.merger = Tokenizer(models.BPE(vocab=plain["vocab"], merges=[tuple(m) for m in plain["merges"]], cache_capacity=0))
        self.merger.pre_tokenizer = pre_tokenizers.Split(" ", "removed")
        shown = [b for r in ((33, 127), (161, 173), (174, 256)) for b in range(*r)]  # bytes that stand for themselves
        chars = dict(zip(shown, map(chr, shown), strict=True)) | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(shown))}
        self.space, chars[10] = chars[32], " " + chars[32]
        self.chars = str.maketrans({chr(b): c for b, c in chars.items()})

    def pieces(self, texts: list[str]) -> tuple[pa.Array, np.ndarray]:
        """The texts cut at certain pre-token borders, and the place of each text's first piece (and the end).

        Pieces after the first begin with a line end, or with a space that is left out.
        """
        column = pa.array(texts, pa.large_string())
        odd = np.asarray(pc.match_substring_regex(column, UNEVEN))
        if not odd.any():
            cut = pc.split_pattern(pc.replace_substring(column, "\n", " \n"), " ")
            return cut.flatten(), np.asarray(cut.offsets, np.int64)
        lists = [CUT.split(t) if o else t.replace("\n", " \n").split(" ") for t, o in zip(texts, odd.tolist(), strict=True)]
        return pa.array(list(chain.from_iterable(lists)), pa.large_string()), np.cumsum([0, *map(len, lists)])

    def slices(self, ids: list[int], sizes: np.ndarray) -> list[bytes]:
        """The ids of each of the joined parts, which have ``sizes`` bytes."""
        raw = np.array(ids, "<u4")
        at = [0, *(4 * (np.searchsorted(np.cumsum(self.width[raw]), np.cumsum(sizes)) + 1)).tolist()]
        raw = raw.tobytes()
        return [raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]

    def together(self, pieces: list[str]) -> list[bytes]:
        """The ids of each piece with its space, from one call over all of them joined."""
        full = [p if p[:1] == "\n" else " " + p for p in pieces]
        made = self.tokenizer.encode_batch_fast(["".join(full)], add_special_tokens=False)[0].ids
        return self.slices(made, np.array([len(p.encode()) for p in full]))

    def words(self, cores: list[str]) -> list[bytes]:
        """As ``together``, for pieces of Latin letters alone: each is one pre-token with its space."""
        joined = "\n".join(cores).encode()
        made = self.merger.encode_batch_fast([self.space + joined.decode("latin-1").translate(self.chars)], add_special_tokens=False)[0].ids
        ends = np.flatnonzero(np.frombuffer(joined + b"\n", np.uint8) == 10)
        return self.slices(made, np.diff(ends, prepend=-1))

    def learn(self, new: list[str]) -> list[bytes]:
        """The ids of pieces.  Letters and the marks after them are separate pre-tokens."""
        column = pa.array(new, pa.large_string())
        core = pc.utf8_rtrim(column, characters=MARKS)
        latin = np.asarray(pc.match_substring_regex(core, LETTERS))
        coded = core.filter(pa.array(latin)).dictionary_encode()
        cores, heads, made = strings(coded.dictionary), [], []
        for i in range(0, len(cores), 100):
            heads += self.words(cores[i : i + 100])
        out, place = np.empty(len(new), object), np.flatnonzero(~latin).tolist()
        for i in range(0, len(place), 4000):
            made += self.together([new[k] for k in place[i : i + 4000]])
        out[place] = as_objects(made)
        which = np.asarray(coded.indices)
        out[latin] = as_objects(heads)[which]
        longer, tails = np.asarray(pc.binary_length(column)) > np.asarray(pc.binary_length(core)), {}
        for i, k in zip(np.flatnonzero(latin & longer).tolist(), which[longer[latin]].tolist(), strict=True):
            tail = new[i][len(cores[k]) :]
            if tail not in tails:
                tails[tail] = np.array(self.tokenizer.encode(tail, add_special_tokens=False).ids, "<u4").tobytes()
            out[i] = heads[k] + tails[tail]
        return out.tolist()

    def encode(self, texts: list[str], end: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, ``end`` after each, and the place of each text's first id (and the end)."""
        flat, at = self.pieces(texts)
        coded = flat.dictionary_encode()
        known = strings(coded.dictionary)
        order = np.asarray(coded.indices).astype(np.int64)
        heads = [np.array(h.ids, "<u4").tobytes() for h in self.tokenizer.encode_batch_fast([known[i] for i in order[at[:-1]].tolist()], add_special_tokens=False)]
        inner = np.ones(len(order), bool)
        inner[at[:-1]] = False
        used = np.zeros(len(known), bool)
        used[order[inner]] = True
        memo, old = self.memo, self.old
        table, new = list(map(memo.get, known)), []
        for i in np.flatnonzero(used).tolist():
            if table[i] is None:
                piece = known[i]
                ids = old.get(piece)
                if ids is None:
                    new.append(i)
                else:
                    table[i] = memo[piece] = ids
        words = [known[i] for i in new]
        for i, piece, ids in zip(new, words, self.learn(words) if new else (), strict=True):
            table[i] = memo[piece] = ids
        # piece numbers of a text: its head, its other pieces, the end
        table = [t or b"" for t in table] + heads + [np.array([end], "<u4").tobytes()]
        order[at[:-1]] = len(known) + np.arange(len(texts))
        order = np.insert(order, at[1:], len(table) - 1)
        size = np.fromiter(map(len, table), np.int64, len(table)) // 4
        first = np.cumsum(size) - size
        count = size[order]
        stop = np.cumsum(count)
        ids = np.frombuffer(b"".join(table), "<i4")[np.repeat(first[order] - stop + count, count) + np.arange(stop[-1])]
        if len(memo) * PIECE_BYTES > self.limit:  # pieces that don't come again for so long go
            self.memo, self.old = {}, memo
        return ids, np.concatenate([[0], stop[at[1:] + np.arange(len(texts))]])


def encode(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END) -> DataFrame:
    """Rows of FILES for each row of ``df``, in ascending id order over all partitions.

    Equal ids follow the hash that ranges are dealt by too, so their order doesn't depend on the partitions.
    """
    ordered = df.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("mark"), F.col(text_col).alias("text"))
    ordered = ordered.repartitionByRange("doc_id", "mark").sortWithinPartitions("doc_id", "mark", "text").drop("mark")

    bound_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only_for(__name__)
        part, start, library = TaskContext.get().partitionId(), 0, encoder(tokenizer)
        for batch in batches:
            for block in blocks(batch, "text", BLOCK):
                values, stops = library.encode([t or "" for t in block.column("text").to_pylist()], end_id)
                n, stop = np.diff(stops), stops[1:]
                lists = pa.ListArray.from_arrays(pa.array(stops.astype("int32")), pa.array(values))
                yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(np.full(len(n), part, "int32")), pa.array(start + stop - n), pa.array(n), lists], names=FILES.names)
                start += int(stop[-1])
                give_back()

    return ordered.mapInArrow(run, FILES)


def write_tokens(encoded: DataFrame, path: str, stripe_bytes: int = 16 << 20, stride: int = 1000) -> None:
    """Store rows of FILES as ORC; the order of rows within a partition is the order in its file."""
    (encoded.write.format("orc").option("compression", "snappy").option("orc.stripe.size", stripe_bytes)
     .option("orc.row.index.stride", stride).option("orc.create.index", "true")
     .option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", 0.01).save(path))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FILES).orc(path)


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """The rows of a few documents; the filter prunes files, stripes and row groups."""
    return read_tokens(spark, path).filter(F.col("doc_id").isin(doc_ids))


def checksums(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every stored document, from the files alone.

    ``start`` is the number of ids before the document: its place within its part plus the total of
    the parts before, so only one number for each part is summed in one place.
    """
    totals = files.groupBy("part").agg(F.max(F.col("local_start") + F.col("n_tokens")).alias("total"))
    sums = []
    before = 0
    for row in totals.orderBy("part").toLocalIterator():
        sums.append((row["part"], before))
        before += row["total"]
    offsets = files.sparkSession.createDataFrame(sums, "part int, offset long")
    schema = T.StructType([T.StructField(n, T.LongType()) for n in ("doc_id", "part", "local_start", "n_tokens", "ids_crc32")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            at = np.asarray(lists.offsets)
            values = np.asarray(lists.values).astype("<u4", copy=False)
            crc = [zlib.crc32(values[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("part").cast(pa.int64()), batch.column("local_start"), pa.array(np.diff(at).astype("int64")), pa.array(crc, pa.int64())], names=schema.names
            )

    read = files.select("doc_id", "part", "local_start", "ids").mapInArrow(run, schema)
    joined = read.join(F.broadcast(offsets), "part")  # a row for each part of the files
    return joined.select("doc_id", (F.col("offset") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, write, read back and summarise."""
    spark = df.sparkSession
    path = new_path(spark, "tokens")
    write_tokens(encode(df, tokenizer, id_col, text_col), path)
    return checksums(read_tokens(spark, path))
