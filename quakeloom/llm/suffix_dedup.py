"""Exact removal of repeated byte strings by longest-previous-factor values.

A byte goes if a string of 100 bytes that covers it also starts earlier: in a smaller doc_id, or earlier
in the same document. So a suffix loses its first 100 bytes exactly if its longest previous factor
reaches 100. In suffix order, the earlier positions next to a suffix share the longest prefixes with it.
Only factors of 100 bytes count, so suffixes are ordered by their first 100 bytes (by a 128-bit key of
them) and then by position: the previous smaller position is then the neighbour before, and a suffix has
a long factor exactly if that neighbour has the same key.

A sparse suffix set is enough. Each window of 100 bytes is named after the least key among its 69 grams
of 32 bytes. Neighbouring windows with the same name form a block (about one per 35 bytes), and equal
windows lie in blocks of the same name:
1. Blocks are compared as wholes. All of a block that also stands earlier is removed at once.
2. Where different blocks share a name, mostly next to the edges of repeats, their bytes are gathered
   by name and their suffixes ordered and compared one by one.
All comparisons are first made within chunks of text, which send on one row per key, so that the most
frequent passage costs a row per chunk. A chunk in which more than NAMES different blocks share a name
sends the suffixes' keys themselves, and one row that tells the other chunks so. Such names, and names
with more blocks than a task holds at once (GROUP), have their suffixes compared in a last round, in
which only equal suffixes meet, a row per chunk or group.

Defined results: null text is empty; texts under 100 bytes lose nothing; null doc_ids come last; rows
that share a doc_id count as parts of one document in the order of their texts' SHA-256, and equal such
rows are answered alike; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quakeloom.llm import textscan
from quakeloom.llm.dataset_manifest import numbered
from quakeloom.session import cut, table

LENGTH, GRAM, NAMES, GROUP = 100, 32, 4, 20_000
#: Kinds of marks: a block, one that may repeat itself, a note that more blocks have its name, bytes to
#: remove, a suffix, and a block whose suffixes are to be compared (k2: 1 if other chunks send suffixes).
BLOCK, REPEATING, NOTE, REMOVE, SUFFIX, COMPARE = range(6)
_MARK = "kind int, k1 bigint, k2 bigint, doc bigint, s bigint, n bigint"
_NAMES = ["kind", "k1", "k2", "doc", "s", "n"]
_OTHER_BASE = 0xC2B2AE3D27D4EB4F


def _least_of(keys: np.ndarray, width: int) -> np.ndarray:
    """Least of `width` keys from each position on, by doubling."""
    done, block = 1, keys
    while done * 2 <= width:
        block = np.minimum(block[:-done], block[done:])
        done *= 2
    rest = width - done
    return np.minimum(block[: len(block) - rest], block[rest:]) if rest else block


def _blocks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """start, end (of window starts), document, name, key and whether it may repeat itself."""
    n = len(data) - LENGTH + 1
    if n <= 0:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64, bool))
    grams = textscan.window_hashes(data, GRAM)
    name = _least_of(grams, LENGTH - GRAM + 1)
    change = np.zeros(n + LENGTH, np.int32)
    np.add.at(change, offsets[:-1][np.diff(offsets) >= LENGTH], 1)
    np.add.at(change, (offsets[1:] - LENGTH + 1)[np.diff(offsets) >= LENGTH], -1)
    valid = np.cumsum(change[:n]) > 0
    goes_on = np.zeros(n, bool)
    goes_on[1:] = valid[1:] & valid[:-1] & (name[1:] == name[:-1])
    start = np.flatnonzero(valid & ~goes_on)
    last = np.append(goes_on[1:], False)
    end = np.flatnonzero(valid & ~last) + 1
    # the least gram stands first in a window that isn't the block's last: an equal one follows
    twice = np.concatenate([[0], np.cumsum((grams[:n] == name) & last & valid)])
    return start, end, np.searchsorted(offsets, start, side="right") - 1, name[start], textscan.span_hashes(data, start, end + LENGTH - 1), twice[end] > twice[start]


def _earlier(keys: tuple[np.ndarray, ...], place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which entries are the first of their keys, and which have an earlier place; equal places: neither."""
    order = np.lexsort((place, *reversed(keys)))
    same = np.ones(len(order) - 1, bool)
    for k in keys:
        same &= k[order][1:] == k[order][:-1]
    head = np.concatenate([[True], ~same])
    first_place = place[order][np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))]
    first, later = np.zeros(len(order), bool), np.zeros(len(order), bool)
    first[order] = head
    later[order] = place[order] > first_place
    return first, later


class _Chunk:
    """Byte strings with their documents, and the marks that are made of them.

    text: the strings; pid and hi: whose they are; base: where they start in the document.
    """

    def __init__(self, text: pa.Array, pid: np.ndarray, hi: np.ndarray, base: np.ndarray | int = 0) -> None:
        self.data, self.offsets = textscan.buffer(text)
        self.pid, self.hi, self.base = pid, hi, np.broadcast_to(base, len(pid))
        rows = np.unique(np.column_stack([pid, hi]), axis=0, return_inverse=True)[1].ravel()
        self.row_place = rows.astype(np.int64) << 32
        self.out: list[tuple[np.ndarray, ...]] = []

    def put(self, kind: int, k1, k2, rows: np.ndarray, starts: np.ndarray, n: np.ndarray) -> None:
        """starts: within the document."""
        if len(rows):
            as_long = lambda x: np.broadcast_to(x, len(rows)).astype(np.uint64).view(np.int64)
            self.out.append((np.full(len(rows), kind, np.int32), as_long(k1), as_long(k2), self.pid[rows], (self.hi[rows] << 32) | starts, n))

    def remove(self, rows: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> None:
        """Marks the union of the byte ranges of each row."""
        order = np.lexsort((starts, rows))
        rows, starts, stops = rows[order], starts[order], stops[order]
        if len(rows):
            reach = np.maximum.accumulate(stops + (rows << 32)) - (rows << 32)
            new = np.concatenate([[True], (rows[1:] != rows[:-1]) | (starts[1:] > reach[:-1])])
            at = np.flatnonzero(new)
            last = np.append(at[1:], len(rows)) - 1
            spread = textscan.mix(self.pid[rows[at]].astype(np.uint64))
            self.put(REMOVE, spread, 0, rows[at], starts[at], reach[last] - starts[at])

    def suffixes(self, rows: np.ndarray, starts: np.ndarray, sizes: np.ndarray, send: np.ndarray) -> None:
        """Compares the suffixes of these ranges with each other; sends on the first ones of ranges where `send`."""
        if not len(rows):
            return
        keys = textscan.window_hashes(self.data, LENGTH), textscan.window_hashes(self.data, LENGTH, _OTHER_BASE)
        at, rows, send = textscan.ranges(self.offsets[rows] + starts, sizes), np.repeat(rows, sizes), np.repeat(send, sizes)
        k1, k2, starts = keys[0][at], keys[1][at], at - self.offsets[rows] + self.base[rows]
        first, later = _earlier((k1, k2), self.row_place[rows] | starts)
        self.remove(rows[later], starts[later], starts[later] + LENGTH)
        first &= send
        self.put(SUFFIX, k1[first], k2[first], rows[first], starts[first], np.ones(first.sum(), np.int64))

    def marks(self) -> Iterator[pa.RecordBatch]:
        for columns in self.out:
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names=_NAMES)


    def packed(self) -> Iterator[pa.RecordBatch]:
        """The same with n and kind in one number: fewer bytes for the largest shuffle."""
        for kind, k1, k2, doc, s, n in self.out:
            columns = [k1, k2, doc, s, (n << 3) | kind]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names=["k1", "k2", "doc", "s", "nk"])


def _numbers(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [batch.column(n).to_numpy(zero_copy_only=False) for n in names]


def _first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in textscan.chunks(batches):
        chunk = _Chunk(batch.column("text"), *_numbers(batch, "pid", "hi"))
        start, end, row, name, key, twice = _blocks(chunk.data, chunk.offsets)
        if not len(start):
            continue
        at = start - chunk.offsets[row]
        first, later = _earlier((name, key), chunk.row_place[row] | at)
        chunk.remove(row[later], at[later], at[later] + (end - start)[later] + LENGTH - 1)
        keep = np.flatnonzero(first)
        _, group, count = np.unique(name[keep], return_inverse=True, return_counts=True)
        crowded = count[group] > NAMES
        many = keep[crowded]
        if len(many):
            noted = np.unique(name[many], return_index=True)[1]
            chunk.put(NOTE, name[many][noted], 0, row[many][noted], at[many][noted], np.zeros(len(noted), np.int64))
            chunk.suffixes(row[many], at[many], (end - start)[many], np.ones(len(many), bool))
        few = keep[~crowded]
        for kind, some in ((BLOCK, few[~twice[few]]), (REPEATING, few[twice[few]])):
            chunk.put(kind, name[some], key[some], row[some], at[some], (end - start)[some])
        yield from chunk.packed()


def _second_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Gives blocks to compare their bytes; other marks pass, byte ranges to remove united."""
    for batch in textscan.chunks(batches):
        marks = batch.column("marks")
        if marks.null_count == len(marks):
            continue
        chunk = _Chunk(batch.column("text"), *_numbers(batch, "pid", "hi"))
        held = pc.fill_null(pc.list_value_length(marks), 0).to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(marks)), held)
        kind, k1, k2, s, n = (marks.flatten().field(x).to_numpy(zero_copy_only=False) for x in ("kind", "k1", "k2", "s", "n"))
        s = s & 0xFFFFFFFF
        gone, known, wanted = (np.flatnonzero(kind == k) for k in (REMOVE, SUFFIX, COMPARE))
        chunk.remove(row[gone], s[gone], s[gone] + n[gone])
        chunk.put(SUFFIX, k1[known].astype(np.int64).view(np.uint64), k2[known].astype(np.int64).view(np.uint64), row[known], s[known], n[known])
        for marked in chunk.marks():
            yield marked.append_column("bytes", pa.nulls(marked.num_rows, pa.binary()))
        if len(wanted):
            chunk.out.clear()
            chunk.put(COMPARE, k1[wanted].astype(np.int64).view(np.uint64), k2[wanted].astype(np.int64).view(np.uint64), row[wanted], s[wanted], n[wanted])
            at = chunk.offsets[row[wanted]] + s[wanted]
            size = n[wanted] + LENGTH - 1
            flat = chunk.data[textscan.ranges(at, size)]
            binary = pa.Array.from_buffers(pa.large_binary(), len(wanted), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(size)]).astype(np.int64)), pa.py_buffer(flat)])
            yield from (marked.append_column("bytes", binary.cast(pa.binary())) for marked in chunk.marks())


def _compared(rows: pa.Table, always_send: bool) -> Iterator[pa.RecordBatch]:
    """Marks from whole names' blocks, or from a part of one name's (always_send)."""
    batch = rows.combine_chunks().to_batches()[0]
    k1, k2, doc, s, n = _numbers(batch, "k1", "k2", "doc", "s", "n")
    chunk = _Chunk(batch.column("bytes"), doc, s >> 32, s & 0xFFFFFFFF)
    chunk.suffixes(np.arange(len(n)), np.zeros(len(n), np.int64), n, (k2 != 0) | always_send)
    yield from chunk.marks()


def _third_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compares the suffixes of blocks of one name, which follow each other. Holds GROUP blocks or so."""
    held, opened = None, None
    for batch in batches:
        compare = pc.equal(batch.column("kind"), COMPARE)
        yield batch.filter(pc.invert(compare)).select(_NAMES)
        more = pa.Table.from_batches([batch.filter(compare)])
        held = more if held is None else pa.concat_tables([held, more])
        while held.num_rows >= GROUP:
            names = held.column("k1").to_numpy()
            edge = np.flatnonzero(names[1:] != names[:-1]) + 1
            # the end of a name that parts have been taken of, or all whole names, or a part of one
            whole = len(edge) and names[0] != opened
            stop = int(edge[-1] if whole else edge[0] if len(edge) else held.num_rows)
            if not whole:
                opened = names[0]
            yield from _compared(held.slice(0, stop), not whole)
            held = held.slice(stop)
    if held is not None and held.num_rows:
        names = held.column("k1").to_numpy()
        stop = int((names == opened).sum()) if opened is not None else 0
        if stop:
            yield from _compared(held.slice(0, stop), True)
        if stop < held.num_rows:
            yield from _compared(held.slice(stop), False)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in textscan.chunks(batches):
        kept, spans, sizes = [], [], []
        for text, marks in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("marks").to_pylist()):
            text, runs = text or b"", []
            for a, b in sorted((m["s"] & 0xFFFFFFFF, (m["s"] & 0xFFFFFFFF) + m["n"]) for m in marks or ()):
                if runs and a <= runs[-1][1]:
                    runs[-1] = (runs[-1][0], max(b, runs[-1][1]))
                else:
                    runs.append((a, b))
            edges = [0, *(x for run in runs for x in run), len(text)]
            kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])))
            spans.append([{"start": a, "stop": b} for a, b in runs])
            sizes.append(len(text))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), pa.array(kept, pa.binary())],
            names=["doc_id", "n_bytes", "spans", "kept"],
        )


def _with_marks(documents: DataFrame, marks: DataFrame, repeated: bool) -> DataFrame:
    """Each document row with the marks of its own; their number is bounded by its length.

    Rows meet by doc_id alone where it tells them apart, which saves a shuffle of the marks.
    """
    keys = {"m_pid": F.col("doc")} | ({"m_hi": F.shiftright("s", 32)} if repeated else {})
    own = marks.groupBy(*(c.alias(k) for k, c in keys.items())).agg(F.collect_list(F.struct("kind", "k1", "k2", "s", "n")).alias("marks"))
    same = F.col("pid") == F.col("m_pid")
    return documents.join(own, same & (F.col("hi") == F.col("m_hi")) if repeated else same, "left").drop(*keys)


def _told_apart(rows: DataFrame) -> DataFrame:
    """`rows` with hi, the number of the row's text among the different ones of its doc_id, which goes to the upper bits of starts.

    Texts are told apart by their SHA-256; numbers are counted over ranges of keys, so that many rows of one id,
    or without one, are dealt out.
    """
    keyed = rows.withColumn("key", F.sha2(F.coalesce("text", F.lit("")), 256))
    known = numbered(keyed.select(F.col("pid").alias("tree"), "key").distinct(), "key").select(F.col("tree").alias("of"), F.col("key").alias("text_key"), F.col("index").alias("hi"))
    return cut(keyed.join(known, (F.col("pid") == F.col("of")) & (F.col("key") == F.col("text_key"))).select("doc_id", "pid", "hi", "text"))


def remove_repeats(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes, spans (removed byte ranges) and kept (the remaining bytes) of each document row."""
    repeated = not documents.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").isEmpty()
    rows = documents.select("doc_id", F.coalesce("doc_id", F.lit(2**63 - 1)).cast("long").alias("pid"), "text")
    rows = _told_apart(rows) if repeated else rows.select("doc_id", "pid", F.lit(0).cast("long").alias("hi"), "text")

    marks = rows.select("pid", "hi", "text").mapInArrow(_first_pass, "k1 bigint, k2 bigint, doc bigint, s bigint, nk bigint").repartition("k1")
    marks = marks.select(F.col("nk").bitwiseAND(F.lit(7)).cast("int").alias("kind"), "k1", "k2", "doc", "s", F.shiftright("nk", 3).alias("n"))
    block = F.col("kind").isin(BLOCK, REPEATING, NOTE)
    name = Window.partitionBy("block", "k1")
    marks = marks.withColumn("block", block).withColumn("rank", F.rank().over(Window.partitionBy("block", "k1", "k2").orderBy("doc", "s")))
    marks = marks.withColumns({"low": F.min("k2").over(name), "high": F.max("k2").over(name), "noted": F.max(F.col("kind") == NOTE).over(name)})
    later = block & (F.col("rank") > 1)
    unsure = block & ((F.col("low") != F.col("high")) | (F.col("kind") == REPEATING))
    kind = F.when(later, REMOVE).when(unsure, COMPARE).when(~block, F.col("kind"))
    n = F.when(later, F.col("n") + LENGTH - 1).otherwise(F.col("n"))
    k2 = F.when(block, F.col("noted").cast("long")).otherwise(F.col("k2"))
    marks = marks.where(F.col("kind") != NOTE).select(kind.alias("kind"), "k1", k2.alias("k2"), "doc", "s", n.alias("n")).where("kind IS NOT NULL")

    # the same columns as in the last step, so that Spark deals the texts out once for both
    marks = _with_marks(rows, marks, repeated).select("doc_id", "pid", "hi", "text", "marks").mapInArrow(_second_pass, f"{_MARK}, bytes binary")
    marks = marks.repartition("k1").sortWithinPartitions("k1").mapInArrow(_third_pass, _MARK).repartition("k1")
    # the neighbour before in suffix order, if it has the same key, is the previous smaller position
    earlier = F.rank().over(Window.partitionBy("kind", "k1", "k2").orderBy("doc", "s")) > 1
    is_suffix = F.col("kind") == SUFFIX
    marks = marks.withColumn("earlier", earlier).where(~is_suffix | F.col("earlier"))
    none = F.lit(0).cast("long")
    marks = marks.select(F.lit(REMOVE).alias("kind"), none.alias("k1"), none.alias("k2"), "doc", "s", F.when(is_suffix, LENGTH).otherwise(F.col("n")).alias("n"))
    kind = dict(documents.dtypes)["doc_id"]
    return _with_marks(rows, marks, repeated).select("doc_id", "pid", "hi", "text", "marks").mapInArrow(_cut, f"doc_id {kind}, n_bytes bigint, spans array<struct<start:bigint,stop:bigint>>, kept binary")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is removed from every document, and a digest of what stays."""
    done = remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, x: total + x["stop"] - x["start"])
    return done.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op2_suffix_dedup": op2_suffix_dedup}
ORACLE_SQL = {}
