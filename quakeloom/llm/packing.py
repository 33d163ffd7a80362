"""Best-fit packing of token pieces into fixed-length sequences, hierarchically.

A document is tokenised and closed by an end id; longer ones are cut into pieces of the capacity, the
first of which may be shorter. Pieces are dealt out evenly, so many to a task as its memory holds, and
each partition packs its own by best fit in decreasing length. Its full bins, and those that nothing can be gained from, are final. The rest
are items of the next round, in which groups of partitions are merged, and so on up a tree.

What a partition passes on is bounded without loss: after best fit any two of its bins exceed the
capacity together, so that at most one is half full or less. Only such small bins can still move into
another bin, and each needs one host; the emptiest hosts take whatever any host takes. So the small
bin and as many of the emptiest others as a merge has partitions are enough.

Defined results: null text counts as empty (the end id alone); repeated rows and repeated or null
doc_ids are packed as documents of their own; an empty table gives no sequences; columns other than
doc_id and text are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quakeloom.llm import textscan
from quakeloom.session import cut, table

CAPACITY, END_ID, FAN_IN = 1024, 2, 8
#: Pieces that are dealt to a task: there are as many tasks as that takes.
TASK_PIECES = 200_000
#: Outside this range the two libraries' Unicode tables may differ; there the slower one decides.
_RARE = re.compile("[^\x00-ɏ‐-‧]|<\\|endoftext\\|>|[\x1c-\x1f\x85]")


@lru_cache(maxsize=2)
def _encoders(folder: str | None):
    """The tokenizer, and a faster encoder with the same merges."""
    import base64

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    path = (lambda name: f"{folder}/{name}") if folder else public_tokenizers.path
    exact = Tokenizer.from_file(path("byte_bpe_50k.json"))
    with open(path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return exact, tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode(text: str, folder: str | None = None) -> np.ndarray:
    """Token ids of a text, without special tokens added."""
    exact, fast = _encoders(folder)
    if _RARE.search(text):
        return np.array(exact.encode(text, add_special_tokens=False).ids, np.uint32)
    return fast.encode_to_numpy(text, disallowed_special=())


def tokenize(documents: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, tokenizers: str | None = None) -> DataFrame:
    """Pieces of every document: doc_id, piece, start, length and ids (little-endian 32-bit numbers).

    tokenizers: the folder of the vocabulary files; by default the installed package's.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textscan.chunks(batches):
            ids = [np.append(encode(t or "", tokenizers), np.uint32(end_id)) for t in batch.column("text").to_pylist()]
            sizes = np.array([len(x) for x in ids])
            count = -(-sizes // capacity)
            owner = np.repeat(np.arange(len(ids)), count)
            piece = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
            head = sizes - capacity * (count - 1)
            start = np.where(piece == 0, 0, head[owner] + capacity * (piece - 1))
            length = np.where(piece == 0, head[owner], capacity)
            stops = np.concatenate([[0], np.cumsum(length)]).astype(np.int64) * 4
            flat = np.concatenate(ids).astype("<u4")
            binary = pa.Array.from_buffers(pa.large_binary(), len(owner), [None, pa.py_buffer(stops), pa.py_buffer(flat)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(owner)), pa.array(piece.astype(np.int32)), pa.array(start.astype(np.int64)), pa.array(length.astype(np.int64)), binary],
                names=["doc_id", "piece", "start", "length", "ids"],
            )

    source = documents.select("doc_id", "text")
    return source.mapInArrow(run, f"doc_id {dict(source.dtypes)['doc_id']}, piece int, start bigint, length bigint, ids binary")


def best_fit(lengths: list[int], capacity: int) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each item in the given order, and what each bin holds in the end."""
    open_: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by room left
    rooms, bins, offsets, fills = 0, [], [], []  # rooms: a bit per room that some bin has
    for length in lengths:
        fitting = rooms >> length
        if fitting:
            room = length + (fitting & -fitting).bit_length() - 1
            at = open_[room].pop()
            if not open_[room]:
                rooms ^= 1 << room
        else:
            room, at = capacity, len(fills)
            fills.append(0)
        bins.append(at)
        offsets.append(capacity - room)
        fills[at] += length
        room -= length
        if room:
            open_[room].append(at)
            rooms |= 1 << room
    return bins, offsets, fills


def _packed(block: pa.Table, capacity: int, carry: int, last: bool, first_bin: int) -> pa.Table:
    """The block with bin, offset and done."""
    keys = [(n, "ascending") for n in block.schema.names if n != "length"]
    block = block.sort_by([("length", "descending"), *keys])
    bins, offsets, fills = best_fit(block.column("length").to_pylist(), capacity)
    fill = np.array(fills, np.int64)
    done = np.ones(len(fill), bool)
    if not last:
        under = np.flatnonzero(fill < capacity)
        done[under[np.argsort(fill[under], kind="stable")[: carry + 1]]] = False
    bins = np.array(bins, np.int64)
    for name, values in (("bin", bins + first_bin), ("offset", np.array(offsets, np.int64)), ("fill", fill[bins]), ("done", done[bins])):
        block = block.append_column(name, pa.array(values))
    return block


def _round(items: DataFrame, level: int, capacity: int, fan_in: int, last: bool) -> DataFrame:
    """`items` (length and keys) with bin, offset, fill and done, packed partition by partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a bin's number names its round, partition and place there
        first_bin = (level << 56) + (TaskContext.get().partitionId() << 32)
        held = list(batches)
        if held:
            yield from _packed(pa.Table.from_batches(held), capacity, fan_in, last, first_bin).to_batches()

    schema = ", ".join(f"{n} {t}" for n, t in items.dtypes)
    return items.mapInArrow(run, f"{schema}, bin bigint, offset bigint, fill bigint, done boolean")


def pack(pieces: DataFrame, capacity: int = CAPACITY, fan_in: int = FAN_IN) -> DataFrame:
    """`pieces` (length of at most `capacity`, and columns that tell them apart) with sequence_id and offset."""
    columns = pieces.columns
    pieces = cut(pieces)  # so that the count doesn't tokenize, and the dealing is the same should a task run again
    width = max(1, -(-pieces.count() // TASK_PIECES))
    packed = cut(_round(pieces.repartition(width), 0, capacity, fan_in, last=False))
    final = [packed.where("done").select(*columns, F.col("bin").alias("sequence_id"), "offset")]
    moving = packed.where("NOT done")
    level = 1
    while True:
        width = -(-width // fan_in)
        items = moving.groupBy("bin").agg(F.first("fill").alias("length")).withColumnRenamed("bin", "item").repartition(width, "item")
        # each row: a bin of the round before, the bin it goes into and the offset there
        moved = cut(_round(items, level, capacity, fan_in, last=width == 1).withColumnRenamed("offset", "shift").drop("length"))
        now = moving.drop("fill", "done").withColumnRenamed("bin", "item").join(moved, "item").withColumn("offset", F.col("offset") + F.col("shift")).drop("item", "shift")
        final.append(now.where("done").select(*columns, F.col("bin").alias("sequence_id"), "offset"))
        if width == 1:
            break
        moving, level = now.where("NOT done"), level + 1
    out = final[0]
    for more in final[1:]:
        out = out.unionByName(more)
    return out


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and the ids of each whole sequence; packed: with ids, sequence_id and offset.

    A group is one sequence, so at most `capacity` pieces.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.transform(parts, lambda x: F.hex(x["ids"])).alias("parts")).select("sequence_id", F.unhex(F.array_join("parts", "")).alias("ids"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every piece of every document goes."""
    pieces = tokenize(table(spark, sf_dir, "documents"))
    return pack(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


QUERIES = {"op7_packing": op7_packing}
ORACLE_SQL = {}
